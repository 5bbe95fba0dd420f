"""Parameter rows: moving them with their ids, donors for added rows, output masks.

params: key string, row_id int, vec array<float>. A bias is a vector of one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import numbers as num
from tokenloom.operators import joins
from tokenloom.operators.segment import Lexicon, segment_words

#: Output rows that one broadcast holds.
OUTPUTS = 4096


# -- transfer -------------------------------------------------------------
def transfer(params: DataFrame, row_map: DataFrame, initial: DataFrame) -> DataFrame:
    """Rows of initial, overlaid with the rows of params at the ids that row_map (source_id, target_id) gives them."""
    moved = params.join(row_map, params.row_id == row_map.source_id).select("key", F.col("target_id").alias("row_id"), F.col("vec").alias("moved"))
    joined = initial.join(moved, ["key", "row_id"], "full_outer")
    return joined.select("key", "row_id", F.coalesce("moved", "vec").alias("vec"))


def verify_transfer(params: DataFrame, row_map: DataFrame, moved: DataFrame) -> DataFrame:
    """key, rows_checked, values_checked and values_changed of the rows that were to be kept."""
    want = params.join(row_map, params.row_id == row_map.source_id).select("key", F.col("target_id").alias("row_id"), F.col("vec").alias("want"))
    joined = want.join(moved.select("key", "row_id", F.col("vec").alias("got")), ["key", "row_id"], "left")
    off = F.when(F.col("got").isNull() | (F.size("got") != F.size("want")), F.size("want")).otherwise(F.size(F.filter(F.zip_with("got", "want", lambda a, b: ~a.eqNullSafe(b)), lambda x: x)))
    return joined.groupBy("key").agg(F.count("*").alias("rows_checked"), F.sum(F.size("want")).cast("long").alias("values_checked"), F.sum(off).cast("long").alias("values_changed"))


def left_out(params: DataFrame, row_map: DataFrame) -> DataFrame:
    """key, rows_removed and values_omitted: source rows that the map gives no place."""
    gone = params.join(row_map.where("target_id is not null").select(F.col("source_id").alias("row_id")), "row_id", "left_anti")
    return gone.groupBy("key").agg(F.count("*").alias("rows_removed"), F.sum(F.coalesce(F.size("vec"), F.lit(0))).cast("long").alias("values_omitted"))


def plain(row: dict) -> dict:
    """A report's row with all that JSON has no kind for as text."""
    return {k: v if v is None or isinstance(v, (int, float, str)) else str(v) for k, v in row.items()}


def failing_keys(report: DataFrame) -> DataFrame:
    """failing: the keys with changed values in one text, in their order."""
    return report.where("values_changed > 0").agg(F.coalesce(F.array_join(F.array_sort(F.collect_list("key")), ", "), F.lit("")).alias("failing"))


# -- donors ---------------------------------------------------------------
def donor_pieces(base: DataFrame, row_map: DataFrame, target: DataFrame) -> DataFrame:
    """id (in the target), piece and score of normal base pieces that the target keeps active."""
    kept = base.where("type = 1").join(row_map, base.id == row_map.source_id).select(F.col("target_id").alias("id"), "piece", "score")
    return kept.join(target.where("is_active").select("id"), "id", "left_semi")


def added_ids(target: DataFrame, row_map: DataFrame) -> DataFrame:
    """id and piece of target slots that no source row is moved to, in the order of ids."""
    return target.select("id", "piece").join(row_map.select(F.col("target_id").alias("id")).where("id is not null").distinct(), "id", "left_anti")


def donor_paths(added: DataFrame, donors: DataFrame) -> DataFrame:
    """added_id and path: the ids of the donors that spell an added piece; empty where none do."""
    rows = [(r.piece, r.score, r.id) for r in joins.bounded(donors.select("piece", "score", "id"))]
    found = segment_words(added.select(F.col("piece").alias("word")).distinct(), Lexicon.from_rows(rows), strict=True)
    joined = added.join(found, added.piece == found.word, "left")
    return joined.select(F.col("id").alias("added_id"), F.coalesce("path", F.array().cast("array<int>")).alias("path"))


def donor_loads(paths: DataFrame, donors: DataFrame) -> tuple[DataFrame, int]:
    """donor_id and load of every donor in whole units, and how many units one added row is.

    Each added row shares itself evenly over its path, repeats counted; rows
    without a path share themselves over all donors.
    """
    facts = paths.agg(F.max(F.size("path")).alias("longest"), F.count_if(F.size("path") == 0).alias("fallbacks")).first()
    n = donors.count()
    unit = num.share_unit(facts.longest or 0, n)
    each = paths.select(F.explode("path").alias("donor_id"), (F.lit(unit).cast("decimal(38,0)") / F.size("path").cast("decimal(10,0)")).cast("decimal(38,0)").alias("share"))
    sums = each.groupBy("donor_id").agg(F.sum("share").cast("decimal(38,0)").alias("load"))
    rest = unit // n * (facts.fallbacks or 0) if n else 0
    loads = donors.select(F.col("id").alias("donor_id")).join(sums, "donor_id", "left")
    return loads.select("donor_id", (F.coalesce("load", F.lit(0).cast("decimal(38,0)")) + F.lit(rest).cast("decimal(38,0)")).cast("decimal(38,0)").alias("load")), unit


def load_faults(loads: DataFrame, paths: DataFrame, unit: int) -> DataFrame:
    """A row where loads do not add up to the added rows."""
    n = paths.count()
    return loads.agg(F.sum("load").alias("total")).where(F.col("total") != F.lit(unit * n).cast("decimal(38,0)"))


def donor_means(params: DataFrame, paths: DataFrame, donors: DataFrame) -> DataFrame:
    """key, row_id and vec of added rows: means of the donors on their paths, or of all donors."""
    used = params.join(donors.select(F.col("id").alias("row_id")), "row_id", "left_semi")
    every = _means(used, "key")
    steps = paths.select("added_id", F.explode("path").alias("row_id"))
    own = _means(steps.join(used, "row_id"), "key", "added_id")
    # as many rows as there are kinds of parameters
    kinds = params.sparkSession.createDataFrame(joins.bounded(every, 10_000), every.schema).withColumnRenamed("vec", "every")
    rows = paths.select("added_id").join(F.broadcast(kinds))
    joined = rows.join(own, ["key", "added_id"], "left")
    return joined.select("key", F.col("added_id").alias("row_id"), F.coalesce("vec", "every").alias("vec"))


def _means(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and vec: means by place, in double precision, then as floats.

    Each batch is summed as matrices first, so only sums are taken apart and shuffled.
    """

    def sums(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names, vec = batch.column(0).dictionary_encode(), batch.column(1)
            code, width = np.asarray(names.indices, dtype=np.int64), np.asarray(pc.list_value_length(vec).fill_null(-1), dtype=np.int64)
            for w in np.unique(width[width >= 0]).tolist():
                of = np.flatnonzero(width == w)
                of = of[np.argsort(code[of], kind="stable")]
                x = np.asarray(vec.take(pa.array(of)).flatten(), dtype=np.float64).reshape(len(of), w)
                heads = np.flatnonzero(np.concatenate([[True], code[of][1:] != code[of][:-1]]))
                total = np.add.reduceat(x, heads, axis=0) if w else np.zeros((len(heads), 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(heads) + 1) * w, pa.int32()), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(code[of[heads]])), pa.array(np.diff(np.append(heads, len(of)))), lists], names=["g", "n", "s"])

    group = F.to_json(F.struct(*keys))
    parts = rows.select(group.alias("g"), F.col("vec").cast("array<double>")).mapInArrow(sums, "g string, n bigint, s array<double>").select("g", "n", F.posexplode("s").alias("dim", "x"))
    means = parts.groupBy("g", "dim").agg((F.sum("x") / F.sum("n")).cast("float").alias("m"))
    found = means.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("s"))
    kind = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return found.select(F.from_json("g", kind).alias("k"), F.transform("s", lambda x: x["m"]).alias("vec")).select("k.*", "vec")


def shifted_bias(mean: Column, shift: Column) -> Column:
    """Bias of an added row: the mean as a float, plus the shift as a float."""
    return (mean.cast("float") + shift.cast("float")).cast("float")


def donor_report(paths: DataFrame, loads: DataFrame, unit: int, ratio: float) -> DataFrame:
    """One row: policy, added, exact, fallback, cmax_units, unit, shift."""
    counts = paths.agg(F.count("*").alias("added"), F.count_if(F.size("path") > 0).alias("exact"), F.count_if(F.size("path") == 0).alias("fallback"))
    most = loads.agg(F.max("load").alias("cmax_units"))
    policy = F.when(F.col("added") == 0, "no_added_rows").otherwise("retained_text_donor_mean_bound_v1")
    cmax = F.col("cmax_units").cast("double") / F.lit(float(unit))
    return counts.join(most).select(policy.alias("policy"), "added", "exact", "fallback", "cmax_units", F.lit(unit).cast("decimal(38,0)").alias("unit"), F.when(F.col("added") > 0, num.mass_shift(ratio, cmax)).alias("shift"))


# -- masks ----------------------------------------------------------------
def masked(logits: DataFrame, pieces: DataFrame, enabled: bool = True) -> DataFrame:
    """logits (..., id, logit) with minus infinity at inactive slots; unchanged if the mask is off."""
    if not enabled:
        return logits
    joined = joins.checked(logits, pieces.select("id", "is_active"), "id", "left")
    return joined.select(*(F.when(F.coalesce("is_active", F.lit(True)), F.col("logit")).otherwise(float("-inf")).alias("logit") if c == "logit" else F.col(c) for c in logits.columns))


def output_logits(inputs: DataFrame, weights: DataFrame) -> DataFrame:
    """row, id and logit of x . w + b for every input (row, x) and output row (id, w, b).

    The result is a product by its nature. Inputs stay where they are and pass blocks of OUTPUTS output
    rows, each broadcast by itself as a matrix. Places that x lacks or that are null add nothing; without
    any value the logit is null. Sums go from the left, so they don't depend on a library's matrix product.
    """
    spark = inputs.sparkSession
    kind = f"row {inputs.schema['row'].dataType.simpleString()}, id {weights.schema['id'].dataType.simpleString()}, logit double"
    ids = weights.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    parts = []
    for low in range(ids.low, ids.high + 1, OUTPUTS) if ids.low is not None else ():
        block = weights.where((F.col("id") >= low) & (F.col("id") < low + OUTPUTS)).select("id", F.col("w").cast("array<double>").alias("w"), F.col("b").cast("double").alias("b")).orderBy("id").toArrow().combine_chunks()
        if not block.num_rows:
            continue
        id_, b = block["id"].combine_chunks(), np.asarray(block["b"], dtype=np.float64)
        shared = spark.sparkContext.broadcast((id_, np.asarray(block["w"].combine_chunks().flatten(), dtype=np.float64).reshape(block.num_rows, -1), b))

        def work(batches, shared=shared):
            id_, w, b = shared.value
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    x, there = _matrix(part.column(1), w.shape[1])
                    logit, empty = _products(x, there, w) + b, ~there.any(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(x)), len(b)))), id_.take(pa.array(np.tile(np.arange(len(b)), len(x)))), pa.array(logit.ravel(), mask=np.repeat(empty, len(b)), from_pandas=False)], names=["row", "id", "logit"])

        parts.append(inputs.select("row", F.col("x").cast("array<double>").alias("x")).mapInArrow(work, kind))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)


def _matrix(vec: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of a matrix, zero where they have no value, and where they have one."""
    size = np.asarray(pc.list_value_length(vec).fill_null(0), dtype=np.int64)
    if size.max(initial=0) > width:
        raise ValueError(f"an input of {size.max()} values for weights of {width}")
    at = np.arange(width) < size[:, None]
    x, there, values = np.zeros(at.shape), np.zeros(at.shape, dtype=bool), vec.flatten()
    x[at], there[at] = np.asarray(values.fill_null(0.0), dtype=np.float64), np.asarray(values.is_valid(), dtype=bool)
    return x, there


def _products(x: np.ndarray, there: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x . w of all rows of both, added up from the left over the values that are there."""
    out, x, there = np.empty((len(x), len(w))), np.ascontiguousarray(x.T), np.ascontiguousarray(there.T)
    whole = there.all(axis=1)
    for a in range(0, len(w), 128):
        block = w[a : a + 128]
        total, term = np.zeros((len(block), x.shape[1])), np.empty((len(block), x.shape[1]))
        for d in range(len(x)):
            np.multiply(block[:, d, None], x[d], out=term)
            total += term if whole[d] else np.where(there[d], term, 0.0)
        out[:, a : a + 128] = total.T
    return out


def added_mass(logits: DataFrame, first_added: int) -> DataFrame:
    """row and ratio: the softmax mass of slots from first_added on over that of those before."""
    new = F.col("id") >= first_added
    top = logits.groupBy("row").agg(F.max("logit").alias("top"))
    joined = logits.join(top, "row").where(F.col("top") > float("-inf"))
    mass = F.exp(F.col("logit") - F.col("top"))
    return joined.groupBy("row").agg((F.sum(F.when(new, mass).otherwise(0.0)) / F.sum(F.when(~new, mass).otherwise(0.0))).alias("ratio"))
