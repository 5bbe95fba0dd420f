"""Checks that return their violations as rows, and a wrapper that makes them errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import numbers as num
from tokenloom.functions import text as tx


def strict(violations: DataFrame, what: str) -> None:
    """Raise a ValueError if there are violations; names a few of them."""
    some = violations.limit(5).collect()
    if some:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in some))


def model_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """id and what differs (missing, piece, score, type) between two models, position by position."""
    a = left.select("id", F.struct("piece", "score", "type").alias("a"))
    b = right.select("id", F.struct("piece", "score", "type").alias("b"))
    what = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "missing")
        .when(~F.col("a.piece").eqNullSafe(F.col("b.piece")), "piece")
        .when(~F.col("a.score").eqNullSafe(F.col("b.score")), "score")
        .when(~F.col("a.type").eqNullSafe(F.col("b.type")), "type")
    )
    return a.join(b, "id", "full_outer").select("id", what.alias("difference")).where("difference is not null")


def profile_faults(profile: DataFrame, base: DataFrame) -> DataFrame:
    """id and fault of a profile's slots against the base: inactive slots must be their own placeholder, active base slots equal."""
    joined = profile.alias("p").join(base.alias("b"), F.col("p.id") == F.col("b.id"))
    kept = F.col("p.piece").eqNullSafe(F.col("b.piece")) & F.col("p.score").eqNullSafe(F.col("b.score")) & F.col("p.type").eqNullSafe(F.col("b.type"))
    held = (F.col("p.piece") == tx.placeholder(F.col("p.id"))) & (F.col("p.score") == 0) & (F.col("p.type") == 5)
    fault = F.when(F.col("p.type") == 5, F.when(~held, "placeholder")).when(~kept, "changed")
    return joined.select(F.col("p.id").alias("id"), fault.alias("fault")).where("fault is not null")


def addition_faults(profile: DataFrame, added: DataFrame, base_size: int) -> DataFrame:
    """ord and fault of appended pieces against the approved ones, by their order."""
    tail = profile.where(F.col("id") >= base_size).select((F.col("id") - base_size).alias("ord"), F.col("piece").alias("got"))
    joined = tail.join(added.select("ord", "piece"), "ord", "full_outer")
    return joined.where(~F.col("got").eqNullSafe(F.col("piece"))).select("ord", F.when(F.col("got").isNull(), "missing").when(F.col("piece").isNull(), "unapproved").otherwise("changed").alias("fault"))


def donor_faults(pieces: DataFrame) -> DataFrame:
    """piece and fault of normal pieces that can't be donors: empty, without a finite score, or double."""
    normal = pieces.where("type = 1")
    bad = normal.select("piece", F.when(F.col("piece") == "", "empty").when(~num.finite(F.col("score")), "score").alias("fault")).where("fault is not null")
    double = normal.groupBy("piece").agg(F.count("*").alias("n")).where("n > 1").select("piece", F.lit("double").alias("fault"))
    return bad.unionByName(double)


def layout_faults(pieces: DataFrame, row_map: DataFrame, expected: DataFrame) -> DataFrame:
    """profile and fault: the blank must follow the last slot, active slots be as many as expected, the map be the identity with the blank last.

    expected: profile, active.
    """
    found = pieces.groupBy("profile").agg(F.count("*").alias("slots"), F.count_if("is_active").alias("active"), F.max("blank_id").alias("blank"), F.max("id").alias("last"))
    mapped = row_map.groupBy("profile").agg(
        F.max("source_id").alias("source_blank"),
        F.max_by("target_id", "source_id").alias("mapped_blank"),
        F.count("*").alias("n"),
        F.count_if(F.col("source_id") != F.col("target_id")).alias("moved"),
    )
    joined = found.join(mapped, "profile", "full_outer").join(expected.select("profile", F.col("active").alias("wanted")), "profile", "left")
    faults = F.array_compact(
        F.array(
            F.when(~F.col("blank").eqNullSafe(F.col("slots").cast("int")) | ~(F.col("last") + 1).eqNullSafe(F.col("blank")), "blank"),
            F.when(~F.col("active").eqNullSafe(F.col("wanted")), "active"),
            F.when(~F.col("n").eqNullSafe((F.col("source_blank") + 1).cast("long")) | (F.col("moved") > 1), "map"),
            F.when(~F.col("mapped_blank").eqNullSafe(F.col("blank")), "mapped blank"),
        )
    )
    return joined.select("profile", F.explode(faults).alias("fault"))


def row_map_faults(row_map: DataFrame, old_blank: int, new_blank: int) -> DataFrame:
    """source_id and fault of a map (source_id, target_id) that must be 0..old_blank - 1 to itself and old_blank to new_blank."""
    spark = row_map.sparkSession
    want = spark.range(old_blank + 1).select(F.col("id").cast("int").alias("source_id"), F.when(F.col("id") == old_blank, new_blank).otherwise(F.col("id")).cast("int").alias("want"))
    got = row_map.groupBy("source_id").agg(F.count("*").alias("n"), F.max("target_id").alias("target_id"))
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "outside").when(F.col("n") > 1, "double").when(~F.col("target_id").eqNullSafe(F.col("want")), "target")
    faults = got.join(want, "source_id", "full_outer").select("source_id", fault.alias("fault")).where("fault is not null")
    if new_blank < old_blank:
        return faults.unionByName(spark.range(1).select(F.lit(old_blank).alias("source_id"), F.lit("blank").alias("fault")))
    return faults


def shape_faults(old: DataFrame, new: DataFrame, vocabulary_keys: tuple[str, ...]) -> DataFrame:
    """key and fault between two parameter tables (key, row_id, vec): keys must agree, widths too, and rows outside the vocabulary."""

    def shapes(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("key").agg(F.count("*").alias(f"rows_{tag}"), F.min(F.size("vec")).alias(f"low_{tag}"), F.max(F.size("vec")).alias(f"high_{tag}"))

    both = shapes(old, "a").join(shapes(new, "b"), "key", "full_outer")
    fault = (
        F.when(F.col("rows_a").isNull() | F.col("rows_b").isNull(), "missing")
        .when((F.col("low_a") != F.col("high_a")) | (F.col("low_b") != F.col("high_b")) | (F.col("low_a") != F.col("low_b")), "width")
        .when(~F.col("key").isin(*vocabulary_keys) & (F.col("rows_a") != F.col("rows_b")), "rows")
    )
    return both.select("key", fault.alias("fault")).where("fault is not null")


def value_faults(params: DataFrame) -> DataFrame:
    """key and row_id of parameter rows that are null or hold non-finite values."""
    return params.where(~num.all_finite(F.col("vec"))).select("key", "row_id")


def same_dictionary(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (name, slot) that only one of two dictionaries has."""
    a, b = left.select("name", "slot"), right.select("name", "slot")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def digest_faults(files: DataFrame, expected: DataFrame) -> DataFrame:
    """name and fault of files (name, sha256) against the expected ones."""
    joined = files.select("name", F.col("sha256").alias("got")).join(expected.select("name", "sha256"), "name", "full_outer")
    fault = F.when(F.col("got").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("got") != F.col("sha256"), "digest")
    return joined.select("name", fault.alias("fault")).where("fault is not null")


def tensor_faults(old: DataFrame, new: DataFrame, vocabulary_keys: tuple[str, ...]) -> DataFrame:
    """key and fault between the tensors (key, dtype, shape, storage) of two states.

    Both must have the same keys and dtypes, and shapes that differ in the first place of vocabulary keys only;
    a storage that two keys name is shared, which vocabulary keys must not be.
    """
    a = old.select("key", F.col("dtype").alias("dtype_a"), F.col("shape").alias("shape_a"))
    b = new.select("key", F.col("dtype").alias("dtype_b"), F.col("shape").alias("shape_b"))

    def rest(shape: str):
        return F.slice(shape, F.lit(2), F.greatest(F.size(shape) - 1, F.lit(0)))

    grown = F.col("key").isin(*vocabulary_keys) & (F.size("shape_a") == F.size("shape_b")) & rest("shape_a").eqNullSafe(rest("shape_b"))
    fault = (
        F.when(F.col("dtype_a").isNull() | F.col("dtype_b").isNull(), "missing")
        .when(F.col("dtype_a") != F.col("dtype_b"), "dtype")
        .when(~F.col("shape_a").eqNullSafe(F.col("shape_b")) & ~grown, "shape")
    )
    found = a.join(b, "key", "full_outer").select("key", fault.alias("fault")).where("fault is not null")
    twice = new.where("storage is not null").groupBy("storage").agg(F.collect_set("key").alias("keys")).where(F.size("keys") > 1)
    shared = twice.select(F.explode("keys").alias("key")).where(F.col("key").isin(*vocabulary_keys)).select("key", F.lit("shared").alias("fault"))
    return found.unionByName(shared)


def head_faults(models: DataFrame) -> DataFrame:
    """name and fault of models (name, head, blank_as_pad, extra_outputs, embeddings, padding_id, outputs, classes) whose vocabulary can't be moved.

    Only plain transducers can: one embedding whose padding is the blank, as many outputs as classes, none besides.
    """
    fault = (
        F.when(~F.col("head").eqNullSafe("rnnt"), "head")
        .when(~F.coalesce("blank_as_pad", F.lit(False)), "padding")
        .when(F.coalesce("extra_outputs", F.lit(0)) != 0, "extra outputs")
        .when(~F.col("embeddings").eqNullSafe(1), "embeddings")
        .when(~(F.col("padding_id") + 1).eqNullSafe(F.col("outputs")), "blank")
        .when(~F.col("classes").eqNullSafe(F.col("outputs")), "classes")
    )
    return models.select("name", fault.alias("fault")).where("fault is not null")


def mask_faults(pieces: DataFrame, classes: DataFrame) -> DataFrame:
    """profile and fault where a mask can't be applied: there must be a slot for every text class, with ids 0, 1, 2, ...

    classes: profile, n (text classes of the output layer, the blank left out).
    """
    found = pieces.groupBy("profile").agg(F.count("*").alias("slots"), F.countDistinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"))
    fault = F.when(F.col("slots").isNull() | F.col("n").isNull(), "missing").when(F.col("slots") != F.col("n"), "classes").when((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("ids") != F.col("n")), "ids")
    return found.join(classes.select("profile", "n"), "profile", "full_outer").select("profile", fault.alias("fault")).where("fault is not null")


def network_faults(params: DataFrame, embedding: str, weight: str, bias: str | None, blank: int, outputs: int) -> DataFrame:
    """key and fault of a transducer's vocabulary parameters.

    The embedding has a row for every piece and the blank as its padding; the
    output layer has `outputs` rows and none beyond the blank; the bias, if
    there is one, as many of one value each.
    """
    spark = params.sparkSession
    wanted = [(embedding, blank + 1, None), (weight, outputs, None)] + ([(bias, outputs, 1)] if bias else [])
    want = spark.createDataFrame(wanted, "key string, rows long, width int")
    got = params.groupBy("key").agg(F.count("*").alias("n"), F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.countDistinct("row_id").alias("ids"), F.min(F.size("vec")).alias("thin"), F.max(F.size("vec")).alias("wide"))
    fault = (
        F.when(F.col("n").isNull(), "missing")
        .when((F.col("rows") != blank + 1), "outputs")
        .when((F.col("n") != F.col("rows")) | (F.col("low") != 0) | (F.col("high") != F.col("rows") - 1) | (F.col("ids") != F.col("n")), "rows")
        .when((F.col("thin") != F.col("wide")) | (F.col("width").isNotNull() & (F.col("wide") != F.col("width"))), "width")
    )
    return want.join(got, "key", "left").select("key", fault.alias("fault")).where("fault is not null")
