"""Vocabularies, profiles, row maps: DataFrames of pieces with explicit ids.

pieces: id int, piece string, score double, type int. Profiles add profile,
is_active and blank_id. Types: 1 normal, 2 unknown, 3 control, 4 user-defined,
5 unused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions import text as tx

NORMAL, UNKNOWN, CONTROL, USER, UNUSED = 1, 2, 3, 4, 5
BASE_PIECES, ADDED_PIECES = 2000, 500
#: Places of a word whose substrings are listed at once.
STRETCH = 64
PROFILES = ("original", "latin", "latin-indic", "full")
#: Profiles whose slots outside Latin are inactive, and those that append additions.
LIMITED, EXTENDED = ("latin", "latin-indic"), ("latin-indic", "full")
LATIN = "^[▁!-~]+$"


def word_counts(docs: DataFrame) -> DataFrame:
    """word (with its boundary mark) and n, over all texts."""
    return docs.select(F.explode(tx.text_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def substring_counts(words: DataFrame, shortest: int, longest: int) -> DataFrame:
    """piece and n: how often each substring of these lengths occurs in the counted words.

    Words of any length are listed STRETCH places at a time, each stretch with what its last pieces need beyond it.
    """
    begins = F.explode(F.expr(f"sequence(0, (length(word) - 1) div {STRETCH})")).alias("k")
    parts = words.where("word <> ''").select("n", "word", begins).select("n", F.substring(F.col("word"), F.col("k").cast("int") * STRETCH + 1, F.lit(STRETCH + longest - 1)).alias("part"))
    spots = F.expr(f"filter(sequence({shortest}, {longest}), l -> l <= length(part))")
    pieces = F.flatten(F.transform(spots, lambda k: F.transform(F.sequence(F.lit(1), F.least(F.lit(STRETCH), F.length("part") - k + 1)), lambda b: F.substring(F.col("part"), b, k))))
    return parts.select("n", F.explode(pieces).alias("piece")).groupBy("piece").agg(F.sum("n").alias("n"))


def ranked(counts: DataFrame, most: int, first: int) -> DataFrame:
    """The `most` commonest pieces with ids from `first` on, by count and then spelling."""
    order = (F.desc("n"), F.asc("piece"))
    top = counts.orderBy(*order).limit(most)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(*order)) + (first - 1)).cast("int"))


def base_vocabulary(docs: DataFrame, size: int = BASE_PIECES, words: DataFrame | None = None) -> DataFrame:
    """id, piece, n, score, type: <unk> at 0, then the commonest substrings of one to four characters.

    words: the word counts of docs, where they are at hand.
    """
    top = ranked(substring_counts(word_counts(docs) if words is None else words, 1, 4), size, 1)
    scored = top.select("id", "piece", "n", (-(F.lit(1000) + F.col("id"))).cast("double").alias("score"), F.lit(NORMAL).alias("type"))
    unknown = docs.sparkSession.range(1).select(F.lit(0).alias("id"), F.lit(tx.UNKNOWN).alias("piece"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("score"), F.lit(UNKNOWN).alias("type"))
    return unknown.unionByName(scored)


def additions(docs: DataFrame, size: int = ADDED_PIECES, words: DataFrame | None = None) -> DataFrame:
    """ord (from 0), piece, n, score: pieces that extended profiles append, in their order."""
    top = ranked(substring_counts(word_counts(docs) if words is None else words, 5, 6), size, 0)
    return top.select(F.col("id").alias("ord"), "piece", "n", (-(F.lit(5000) + F.col("id"))).cast("double").alias("score"))


def append(base: DataFrame, added: DataFrame, most: int | None = None) -> DataFrame:
    """base pieces, then additions in their order with ids that go on from the base."""
    chosen = added if most is None else added.where(F.col("ord") < most)
    size = F.broadcast(base.agg((F.max("id") + 1).alias("size")))
    tail = chosen.join(size).select((F.col("size") + F.col("ord")).cast("int").alias("id"), "piece", "score", F.lit(NORMAL).alias("type"))
    return base.select("id", "piece", "score", "type").unionByName(tail)


def deactivated(pieces: DataFrame, inactive: Column) -> DataFrame:
    """pieces with inactive slots replaced by placeholders; ids stay as they are."""
    return pieces.select(
        "*",
        (~inactive).alias("is_active"),
    ).select(
        *(c for c in pieces.columns if c not in ("piece", "score", "type")),
        F.when(F.col("is_active"), F.col("piece")).otherwise(tx.placeholder(F.col("id"))).alias("piece"),
        F.when(F.col("is_active"), F.col("score")).otherwise(0.0).alias("score"),
        F.when(F.col("is_active"), F.col("type")).otherwise(UNUSED).alias("type"),
        "is_active",
    )


def profile_vocabulary(base: DataFrame, added: DataFrame, profiles: tuple[str, ...] = PROFILES) -> DataFrame:
    """profile, id, piece, score, type, is_active, blank_id of every slot of each profile."""
    whole = append(base, added)
    sizes = F.broadcast(base.agg((F.max("id") + 1).alias("base_size")))
    total = F.broadcast(whole.agg((F.max("id") + 1).alias("full_size")))
    rows = whole.join(sizes).join(total).select("*", F.explode(F.array(*(F.lit(p) for p in profiles))).alias("profile"))
    extended = F.col("profile").isin(*EXTENDED)
    rows = rows.where(extended | (F.col("id") < F.col("base_size")))
    rows = rows.withColumn("blank_id", F.when(extended, F.col("full_size")).otherwise(F.col("base_size")).cast("int"))
    foreign = (F.col("id") < F.col("base_size")) & (F.col("type") == NORMAL) & ~F.col("piece").rlike(LATIN)
    done = deactivated(rows, F.col("profile").isin(*LIMITED) & foreign)
    return done.select("profile", "id", "piece", "score", "type", "is_active", "blank_id")


def active_vocabulary(pieces: DataFrame) -> DataFrame:
    """profile, piece and id of active slots."""
    return pieces.where("is_active").select("profile", "piece", "id")


def acoustic_vocabulary(pieces: DataFrame) -> DataFrame:
    """profile, piece and id of all slots."""
    return pieces.select("profile", "piece", "id")


def inactive_ids(pieces: DataFrame) -> DataFrame:
    """profile and id of slots that are no active piece, as all slots less the active ones."""
    slots = pieces.groupBy("profile").agg(F.max("id").alias("last")).select("profile", F.explode(F.sequence(F.lit(0), "last")).alias("id"))
    return slots.join(pieces.where("is_active").select("profile", "id"), ["profile", "id"], "left_anti")


def inactive_by_spelling(pieces: DataFrame) -> DataFrame:
    """Slots whose spelling is the placeholder of their own id; one of another id does not count."""
    return pieces.where(F.col("piece") == tx.placeholder(F.col("id")))


def row_map(pieces: DataFrame, base: DataFrame) -> DataFrame:
    """profile, source_id, target_id: every base id to itself, the base's blank to the profile's."""
    size = F.broadcast(base.agg((F.max("id") + 1).cast("int").alias("source_blank")))
    blanks = pieces.groupBy("profile").agg(F.max("blank_id").alias("blank_id")).join(size)
    ids = blanks.select("profile", "blank_id", "source_blank", F.explode(F.sequence(F.lit(0), "source_blank")).alias("source_id"))
    return ids.select("profile", "source_id", F.when(F.col("source_id") == F.col("source_blank"), F.col("blank_id")).otherwise(F.col("source_id")).alias("target_id"))


def summary(pieces: DataFrame, base: DataFrame) -> DataFrame:
    """profile, text_entries, active, inactive, added, blank_id."""
    size = F.broadcast(base.agg((F.max("id") + 1).alias("base_size")))
    return (
        pieces.join(size)
        .groupBy("profile")
        .agg(
            F.count("*").alias("text_entries"),
            F.count_if("is_active").alias("active"),
            F.count_if(~F.col("is_active")).alias("inactive"),
            F.count_if(F.col("id") >= F.col("base_size")).alias("added"),
            F.max("blank_id").alias("blank_id"),
        )
    )


def spellings(pieces: DataFrame) -> DataFrame:
    """Distinct active spellings over all profiles."""
    return pieces.where("is_active").select("piece").distinct()


def restricted_symbols(symbols: DataFrame, pieces: DataFrame) -> DataFrame:
    """symbols (profile, piece) that are active pieces of their profile."""
    return symbols.join(pieces.where("is_active").select("profile", "piece"), ["profile", "piece"], "left_semi")
