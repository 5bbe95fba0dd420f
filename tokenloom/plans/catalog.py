"""The registered queries of the tokenizer operators, over the documents and embeddings tables.

A vocabulary is derived from the documents: its size is a parameter, so it may
be held on the driver and broadcast.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import numbers as num
from tokenloom.functions import text as tx
from tokenloom.operators import checks, coverage, joins, parameters, prompts, tokens
from tokenloom.operators import vocabulary as voc
from tokenloom.operators.segment import Lexicon, nbest, sampled, segment_words, tokenize
from tokenloom.plans import oracles

#: Fixed rows of a small prompt registry: profile, name, slot.
PROMPTS = [(p, n, s) for p in ("original", "full") for n, s in (("auto", 101), ("en", 0), ("en-US", 0), ("enGB", 1), ("en-GB", 1), ("hi", 6), ("hi-IN", 6), ("hi-HI", 6))] + [("full", "as-IN", 63), ("full", "or-IN", 78), ("latin", "auto", 101), ("latin", "en", 0)]
#: Id sequences with every fault, for a vocabulary with blank 2001.
SEQUENCES = [(1, [5, 6, 7]), (2, [5, 2001, 7]), (3, [-1, 3]), (4, [3, 2002]), (5, []), (6, None), (7, [3, None])]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _held(df: DataFrame) -> DataFrame:
    """A small table, computed once; an error if it isn't small."""
    return df.sparkSession.createDataFrame(joins.bounded(df), df.schema)


def _base(spark, sf_dir) -> DataFrame:
    return _held(voc.base_vocabulary(_docs(spark, sf_dir)))


def _profiles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Base and profiles; the words are counted once for both."""
    docs = _docs(spark, sf_dir)
    words = voc.word_counts(docs).persist(StorageLevel.DISK_ONLY)
    base, added = _held(voc.base_vocabulary(docs, words=words)), _held(voc.additions(docs, words=words))
    words.unpersist()
    return base, _held(voc.profile_vocabulary(base, added))


def _lexicons(spark, sf_dir, names=("original", "latin")) -> dict[str, Lexicon]:
    """Lexicons of profiles that take no additions, which so need not be counted."""
    base = _base(spark, sf_dir)
    none = spark.createDataFrame([], "ord int, piece string, n long, score double")
    pieces = _held(voc.profile_vocabulary(base, none, names))
    return {n: Lexicon.of(pieces.where(F.col("profile") == n)) for n in names}


def vocab_topk(spark, sf_dir):
    return voc.base_vocabulary(_docs(spark, sf_dir))


def profile_active_vocab(spark, sf_dir):
    return voc.active_vocabulary(_profiles(spark, sf_dir)[1])


def profile_acoustic_vocab(spark, sf_dir):
    return voc.acoustic_vocabulary(_profiles(spark, sf_dir)[1])


def profile_summary(spark, sf_dir):
    base, pieces = _profiles(spark, sf_dir)
    return voc.summary(pieces, base)


def placeholder_slots(spark, sf_dir):
    return voc.inactive_by_spelling(_profiles(spark, sf_dir)[1]).select("profile", "id", "piece", "score", "type")


def append_additions(spark, sf_dir):
    return voc.append(_base(spark, sf_dir), voc.additions(_docs(spark, sf_dir))).where(F.col("id") > voc.BASE_PIECES)


def row_map(spark, sf_dir):
    base, pieces = _profiles(spark, sf_dir)
    return voc.row_map(pieces, base)


def inactive_anti_join(spark, sf_dir):
    return voc.inactive_ids(_profiles(spark, sf_dir)[1])


def distinct_spellings(spark, sf_dir):
    return voc.spellings(_profiles(spark, sf_dir)[1])


def symbol_restriction(spark, sf_dir):
    base, pieces = _profiles(spark, sf_dir)
    symbols = base.where("id % 10 = 1").select(F.explode(F.array(*(F.lit(p) for p in voc.PROFILES))).alias("profile"), "piece")
    return voc.restricted_symbols(symbols, pieces)


def segment_words_query(spark, sf_dir):
    lexicon = Lexicon.of(_base(spark, sf_dir))
    words = voc.word_counts(_docs(spark, sf_dir))
    found = segment_words(words, lexicon, strict=True).where("path is not null")
    return found.select("word", "score", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


def tokenize_documents(spark, sf_dir):
    rows = tokenize(_docs(spark, sf_dir), _lexicons(spark, sf_dir, ("original",)))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("ids_sha256"))


def detokenize_roundtrip(spark, sf_dir):
    base = _base(spark, sf_dir)
    rows = tokenize(_docs(spark, sf_dir), {"original": Lexicon.of(base)})
    back = tokens.detokenized(F.col("ids"), tokens.spelling_table(base))
    return rows.select("doc_id", F.array_contains("ids", 0).alias("has_unknown"), F.sha2(back, 256).alias("text_sha256")).where("not has_unknown").select("doc_id", "text_sha256")


def token_lookup(spark, sf_dir):
    words = voc.word_counts(_docs(spark, sf_dir)).select(F.col("word").alias("token"), "n")
    return tokens.lookup_ids(words, _base(spark, sf_dir).select("piece", "id"))


def id_lookup(spark, sf_dir):
    return tokens.lookup_tokens(spark.range(-1, 2004).select(F.col("id").cast("int").alias("id")), _base(spark, sf_dir), voc.BASE_PIECES + 1)


def ids_validate(spark, sf_dir):
    pieces = _profiles(spark, sf_dir)[1].where("profile = 'latin'")
    inactive = F.lit([r.id for r in pieces.where("not is_active").select("id").orderBy("id").collect()]).cast("array<int>")
    some = pieces.where("not is_active").agg(F.min("id").alias("id")).select(F.lit(8).alias("row"), F.array("id").alias("ids"))
    rows = spark.createDataFrame(SEQUENCES, "row int, ids array<int>").unionByName(some)
    return rows.select("row", F.coalesce(tokens.id_faults(F.col("ids"), voc.BASE_PIECES + 1, inactive), F.lit("none")).alias("fault"))


def coverage_by_lang(spark, sf_dir):
    return coverage.by_group(_docs(spark, sf_dir), _lexicons(spark, sf_dir))


def retokenize_required(spark, sf_dir):
    return coverage.retokenization(_docs(spark, sf_dir), _lexicons(spark, sf_dir), "original", "latin")


def dominated_pieces(spark, sf_dir):
    # integer scores of whole pieces always beat sums of two, so the study uses scores that fall with frequency
    return coverage.dominated(_scaled(spark, sf_dir))


def _scaled(spark, sf_dir) -> DataFrame:
    """The base with scores that favour common pieces enough for pieces to be dominated: minus the place in hundreds, rounded up."""
    return _base(spark, sf_dir).where("id > 0").select("id", "piece", (-F.ceil(F.col("id") / 100)).cast("double").alias("score"), "type")


def model_diff(spark, sf_dir):
    pieces = _profiles(spark, sf_dir)[1]
    of = lambda name: pieces.where(F.col("profile") == name)
    return checks.model_diff(of("original"), of("latin-indic"))


def profile_faults(spark, sf_dir):
    base, pieces = _profiles(spark, sf_dir)
    spoilt = pieces.where("profile = 'latin'").withColumn("score", F.when(F.col("id") % 500 == 3, F.col("score") + 0.125).otherwise(F.col("score")))
    return checks.profile_faults(spoilt, base)


def layout_faults(spark, sf_dir):
    base, pieces = _profiles(spark, sf_dir)
    mapped = voc.row_map(pieces, base).withColumn("target_id", F.when((F.col("profile") == "full") & (F.col("source_id") < 2), F.col("target_id") + 1).otherwise(F.col("target_id")))
    expected = voc.summary(pieces, base).select("profile", (F.col("active") + F.when(F.col("profile") == "latin", 1).otherwise(0)).alias("active"))
    return checks.layout_faults(pieces, mapped, expected)


def donor_paths(spark, sf_dir):
    paths, _, _ = _donors(spark, sf_dir)
    return paths.select("added_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


def _donors(spark, sf_dir):
    base, pieces = _profiles(spark, sf_dir)
    target = pieces.where("profile = 'latin-indic'")
    mapped = voc.row_map(target, base).select("source_id", "target_id")
    donors = _held(parameters.donor_pieces(base, mapped, target))
    return _held(parameters.donor_paths(parameters.added_ids(target, mapped), donors)), donors, mapped


def donor_loads(spark, sf_dir):
    paths, donors, _ = _donors(spark, sf_dir)
    loads, unit = parameters.donor_loads(paths, donors)
    return loads.select("donor_id", F.col("load").cast("string").alias("load"), F.lit(str(unit)).alias("unit"))


def donor_cmax(spark, sf_dir):
    paths, donors, _ = _donors(spark, sf_dir)
    loads, unit = parameters.donor_loads(paths, donors)
    report = parameters.donor_report(paths, loads, unit, 0.05)
    return report.select("policy", "added", "exact", "fallback", F.col("cmax_units").cast("string").alias("cmax_units"), F.col("unit").cast("string").alias("unit"), F.round("shift", 9).alias("shift"))


def _rows(spark, sf_dir) -> DataFrame:
    """Embeddings as parameter rows by their order of ids: row_id is the vec_id."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.lit("embedding").alias("key"), F.col("vec_id").cast("int").alias("row_id"), F.col("embedding").alias("vec"))


def _steps(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Paths of added rows over embedding ids, by arithmetic: every eighth added row falls back to all donors."""
    donors = _rows(spark, sf_dir).select(F.col("row_id").alias("id"))
    ids = F.when(F.col("id") % 8 == 0, F.array()).otherwise(F.array(F.col("id") % 7, F.col("id") % 5 * 2, F.col("id") % 7)).cast("array<int>")
    paths = spark.range(64).select((F.col("id") + 1_000_000).cast("int").alias("added_id"), ids.alias("path"))
    return paths, donors


def donor_means(spark, sf_dir):
    paths, donors = _steps(spark, sf_dir)
    means = parameters.donor_means(_rows(spark, sf_dir), paths, donors)
    return means.select("row_id", F.posexplode("vec").alias("dim", "x")).select("row_id", "dim", (F.round(F.col("x").cast("double"), 4) + 0.0).alias("x"))


def _moved(spark, sf_dir):
    params = _rows(spark, sf_dir)
    mapped = params.select(F.col("row_id").alias("source_id"), (F.col("row_id") * 2 + 1).alias("target_id"))
    initial = params.select("key", (F.col("row_id") * 2).alias("row_id"), "vec")
    return params, mapped, parameters.transfer(params, mapped, initial)


def transfer_rows(spark, sf_dir):
    moved = _moved(spark, sf_dir)[2]
    return moved.select("key", "row_id", F.round(F.col("vec")[0].cast("double"), 6).alias("first"), F.size("vec").alias("n"))


def verify_transfer(spark, sf_dir):
    params, mapped, moved = _moved(spark, sf_dir)
    spoilt = moved.withColumn("vec", F.when(F.col("row_id") % 20 == 1, F.transform("vec", lambda x: x + 1)).otherwise(F.col("vec")))
    return parameters.verify_transfer(params, mapped, spoilt)


def failing_keys(spark, sf_dir):
    return parameters.failing_keys(verify_transfer(spark, sf_dir))


def finite_rows(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("vec", F.when(F.col("row_id") % 50 == 7, F.array(F.lit(float("nan")))).when(F.col("row_id") % 50 == 9, F.lit(None)).otherwise(F.col("vec").cast("array<double>")))
    return checks.value_faults(rows)


def _logits(spark, sf_dir) -> DataFrame:
    """Every embedding as an input against forty outputs whose weights are made by arithmetic."""
    inputs = _rows(spark, sf_dir).select(F.col("row_id").alias("row"), F.col("vec").alias("x"))
    width = inputs.agg(F.max(F.size("x")).alias("n")).first().n or 0
    weight = F.transform(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)), lambda d: ((F.col("id") * 7 + d * 3) % 11 - 5) / 8)
    return parameters.output_logits(inputs, spark.range(40).select(F.col("id").cast("int").alias("id"), weight.alias("w"), (F.col("id") / 100).alias("b")))


def masked_logits(spark, sf_dir):
    flags = spark.range(40).select(F.col("id").cast("int").alias("id"), (F.col("id") % 3 != 1).alias("is_active"))
    return parameters.masked(_logits(spark, sf_dir), flags).select("row", "id", num.rounded(F.col("logit"), 6).alias("logit"))


def mass_ratio(spark, sf_dir):
    return parameters.added_mass(_logits(spark, sf_dir), 30).select("row", F.round("ratio", 6).alias("ratio"))


def log_partition(spark, sf_dir):
    rows = _logits(spark, sf_dir).groupBy("row").agg(F.array_sort(F.collect_list("logit")).alias("v"))
    return rows.select("row", F.round(num.log_sum_exp(F.col("v")), 6).alias("log_sum_exp"))


def prompt_slots(spark, sf_dir):
    return prompts.aliases(spark.createDataFrame(PROMPTS, "profile string, name string, slot int"))


def unused_prompt_slots(spark, sf_dir):
    return prompts.unused_slots(spark.createDataFrame(PROMPTS, "profile string, name string, slot int"))


def content_digest(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.digest(F.coalesce("text", F.lit(""))).alias("sha256"))


def normalized_text(spark, sf_dir):
    wide = F.translate(F.coalesce(F.col("text"), F.lit("")), "aef", "ａｅﬁ")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(tx.normalized(wide), 256).alias("text_sha256"))


def sampled_segmentation(spark, sf_dir):
    base = _base(spark, sf_dir)
    rows = sampled(_docs(spark, sf_dir), Lexicon.of(base), alpha=0.001, seed=1)
    return rows.select("doc_id", F.size("ids").alias("n_tokens"))


def document_tokens(spark, sf_dir):
    base = _base(spark, sf_dir)
    rows = tokenize(_docs(spark, sf_dir), {"original": Lexicon.of(base)})
    spelt = tokens.token_texts(F.col("ids"), F.lit([r.piece for r in base.orderBy("id").collect()]))
    return rows.select("doc_id", F.sha2(F.array_join(spelt, " "), 256).alias("tokens_sha256"))


def token_sequences(spark, sf_dir):
    # the pieces of every word that is one piece, without the commonest
    base = _base(spark, sf_dir)
    words = voc.word_counts(_docs(spark, sf_dir)).join(F.broadcast(base.select(F.col("piece").alias("word"))), "word", "left_semi")
    rows = words.select(F.col("word").alias("k"), F.array("word", F.lit("▁"), F.substring("word", 1, 2)).alias("tokens"))
    found = tokens.sequence_ids(rows.join(F.broadcast(base.select(F.col("piece").alias("p"))), F.col("tokens")[2] == F.col("p"), "left_semi"), base, "k", skip=("▁",))
    return found.select("k", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def addition_faults(spark, sf_dir):
    base, added = _base(spark, sf_dir), _held(voc.additions(_docs(spark, sf_dir)))
    spoilt = voc.append(base, added.where("ord <> 499")).withColumn("piece", F.when(F.col("id") % 100 == 5, F.concat("piece", F.lit("x"))).otherwise(F.col("piece")))
    return checks.addition_faults(spoilt, added, voc.BASE_PIECES + 1)


def donor_faults(spark, sf_dir):
    spoilt = _base(spark, sf_dir).withColumns(
        {
            "score": F.when(F.col("id") % 400 == 2, float("inf")).otherwise(F.col("score")),
            "piece": F.when(F.col("id") == 7, "").when(F.col("id") % 700 == 9, "same").otherwise(F.col("piece")),
        }
    )
    return checks.donor_faults(spoilt)


def row_map_faults(spark, sf_dir):
    base, pieces = _profiles(spark, sf_dir)
    mapped = voc.row_map(pieces.where("profile = 'full'"), base).where("source_id <> 11")
    spoilt = mapped.withColumn("target_id", F.when(F.col("source_id") % 600 == 3, None).otherwise(F.col("target_id")))
    return checks.row_map_faults(spoilt, voc.BASE_PIECES + 1, voc.BASE_PIECES + voc.ADDED_PIECES + 1)


def shape_faults(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    old = rows.unionByName(rows.withColumn("key", F.lit("fixed"))).unionByName(rows.withColumn("key", F.lit("gone")))
    new = rows.where("row_id % 2 = 0").unionByName(rows.where("row_id > 0").withColumn("key", F.lit("fixed"))).unionByName(rows.select(F.lit("thin").alias("key"), "row_id", F.slice("vec", 1, 3).alias("vec")))
    return checks.shape_faults(old, new, ("embedding",))


def network_faults(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    n = rows.agg(F.max("row_id").alias("n")).first().n
    bias = rows.select(F.lit("bias").alias("key"), "row_id", F.slice("vec", 1, 2).alias("vec"))
    return checks.network_faults(rows.unionByName(bias), "embedding", "weight", "bias", n, n + 1)


def same_dictionary(spark, sf_dir):
    rows = spark.createDataFrame(PROMPTS, "profile string, name string, slot int")
    return checks.same_dictionary(rows.where("profile = 'original'"), rows.where("profile = 'full' and name <> 'hi'"))


def digest_faults(spark, sf_dir):
    files = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), tx.digest(F.coalesce("text", F.lit(""))).alias("sha256"), "doc_id")
    expected = files.where("doc_id % 7 <> 3").select("name", F.when(F.col("doc_id") % 11 == 5, "0").otherwise(F.col("sha256")).alias("sha256"))
    return checks.digest_faults(files.where("doc_id % 13 <> 2").select("name", "sha256"), expected)


def mass_shifts(spark, sf_dir):
    return _rows(spark, sf_dir).select("row_id", F.round(num.mass_shift(0.05, F.col("row_id") + 1.5), 9).alias("shift"))


def load_faults(spark, sf_dir):
    paths, donors, _ = _donors(spark, sf_dir)
    loads, unit = parameters.donor_loads(paths, donors)
    first = donors.agg(F.min("id")).first()[0]
    spoilt = loads.withColumn("load", F.col("load") + F.when(F.col("donor_id") == first, 1).otherwise(0))
    return parameters.load_faults(spoilt, paths, unit).select(F.col("total").cast("string").alias("total"))


def left_out_rows(spark, sf_dir):
    params = _rows(spark, sf_dir)
    mapped = params.where("row_id % 3 <> 1").select(F.col("row_id").alias("source_id"), F.when(F.col("row_id") % 5 != 2, F.col("row_id")).alias("target_id"))
    return parameters.left_out(params, mapped)


def tokens_to_text(spark, sf_dir):
    # the spellings of every word that is one piece, and of its first letter where that is one too
    base = _base(spark, sf_dir)
    words = voc.word_counts(_docs(spark, sf_dir)).join(F.broadcast(base.select(F.col("piece").alias("word"))), "word", "left_semi")
    rows = words.select(F.col("word").alias("k"), F.array("word", F.substring("word", 1, 2)).alias("tokens"))
    rows = rows.join(F.broadcast(base.select(F.col("piece").alias("p"))), F.col("tokens")[1] == F.col("p"), "left_semi")
    found = tokens.sequence_ids(rows, base, "k")
    return found.select("k", tokens.detokenized(F.col("ids"), tokens.spelling_table(base)).alias("text"))


def mask_faults(spark, sf_dir):
    pieces = _profiles(spark, sf_dir)[1]
    classes = pieces.groupBy("profile").agg(F.count("*").alias("n")).withColumn("n", F.col("n") + F.when(F.col("profile") == "latin", 1).otherwise(0))
    return checks.mask_faults(pieces.where("profile <> 'full' or id <> 3").withColumn("id", F.when((F.col("profile") == "original") & (F.col("id") == 7), 5000).otherwise(F.col("id"))), classes)


def nbest_words(spark, sf_dir):
    words = voc.word_counts(_docs(spark, sf_dir)).select("word")
    found = nbest(words, Lexicon.of(_base(spark, sf_dir)), 3)
    return found.select("word", "place", "score", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


_NAMES = {segment_words_query: "segment_words"}
_ALL = [
    coverage_by_lang, vocab_topk, profile_active_vocab, profile_acoustic_vocab, profile_summary, placeholder_slots, append_additions, row_map, inactive_anti_join, distinct_spellings, symbol_restriction,
    segment_words_query, tokenize_documents, detokenize_roundtrip, token_lookup, id_lookup, ids_validate, retokenize_required, dominated_pieces, model_diff, profile_faults, layout_faults,
    donor_paths, donor_loads, donor_cmax, donor_means, transfer_rows, verify_transfer, failing_keys, finite_rows, masked_logits, mass_ratio, log_partition, prompt_slots, unused_prompt_slots,
    document_tokens, token_sequences, addition_faults, donor_faults, row_map_faults, shape_faults, network_faults, same_dictionary, content_digest, normalized_text, sampled_segmentation,
    digest_faults, mass_shifts, load_faults, left_out_rows, tokens_to_text, mask_faults, nbest_words,
]


def queries() -> dict:
    """Query functions by name."""
    return {_NAMES.get(f, f.__name__): f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name."""
    return oracles.all_sql(PROMPTS, SEQUENCES)
