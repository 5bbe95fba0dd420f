"""Lookups between ids and spellings, id validation, ids back to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import text as tx
from tokenloom.operators import joins


def lookup_ids(tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """tokens (token, ...) with id, null where no piece spells so (it is not the unknown piece)."""
    return joins.checked(tokens, pieces.select(F.col("piece").alias("token"), "id"), "token", "left")


def strict_ids(tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """Like lookup_ids, but a token without a piece is an error."""
    found = lookup_ids(tokens, pieces)
    return found.withColumn("id", F.coalesce("id", F.raise_error(F.concat(F.lit("no such piece: "), F.coalesce("token", F.lit("null")))).cast("int")))


def lookup_tokens(ids: DataFrame, pieces: DataFrame, blank: int) -> DataFrame:
    """ids (id, ...) with token: the spelling, <blank> for the blank, null outside."""
    found = joins.checked(ids, pieces.select("id", "piece"), "id", "left")
    return found.select(*ids.columns, F.coalesce("piece", F.when(F.col("id") == blank, tx.BLANK)).alias("token"))


def sequence_ids(rows: DataFrame, pieces: DataFrame, key: str, tokens: str = "tokens", skip: tuple[str, ...] = ()) -> DataFrame:
    """key and ids of token sequences, in order, without the tokens to skip; unknown tokens are an error."""
    parts = rows.select(key, F.posexplode(tokens).alias("pos", "token"))
    if skip:
        parts = parts.where(~F.col("token").isin(*skip))
    found = strict_ids(parts, pieces).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("s"))
    ids = found.select(key, F.transform("s", lambda x: x["id"]).alias("ids"))
    return rows.select(key).join(ids, key, "left").select(key, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def id_faults(ids: Column, blank: int, inactive: Column) -> Column:
    """What is wrong with an array of ids: 'null', 'range', 'inactive', or null where nothing is."""
    outside = F.exists(ids, lambda x: (x < 0) | (x > blank))
    return F.when(ids.isNull() | F.exists(ids, lambda x: x.isNull()), "null").when(outside, "range").when(F.arrays_overlap(ids, inactive), "inactive")


def valid_ids(ids: Column, blank: int, inactive: Column) -> Column:
    """ids without blanks; an error if they hold anything that id_faults names."""
    fault = id_faults(ids, blank, inactive)
    return F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("bad ids: "), fault)).cast("array<int>")).otherwise(F.filter(ids, lambda x: x != blank))


def spelling_table(pieces: DataFrame) -> Column:
    """All spellings of a vocabulary as one array literal, by id; an error if it isn't small."""
    rows = joins.bounded(pieces.select("id", "piece", "type").orderBy("id"))
    if [r.id for r in rows] != list(range(len(rows))):
        raise ValueError("ids must be 0, 1, 2, ...")
    texts = [tx.UNKNOWN_TEXT if r.type == 2 else "" if r.type == 3 else r.piece for r in rows]
    return F.lit(texts)


def detokenized(ids: Column, spellings: Column) -> Column:
    """The text of an array of valid ids; unknowns show as a mark, controls as nothing."""
    return tx.spoken(F.transform(ids, lambda i: F.element_at(spellings, i + 1)))


def token_texts(ids: Column, spellings: Column) -> Column:
    """Spellings of an array of ids."""
    return F.transform(ids, lambda i: F.element_at(spellings, i + 1))
