"""Nearest neighbours by windows on shifted Hilbert curves (operator 6).

Nearness is the largest inner product, so vectors are lifted to equal length by
one more coordinate (0 for queries). Each of `orders` random rotations projects
them to `dims` coordinates, shifted by a random offset; a Hilbert curve turns
these into a key. Quantiles of the keys cut each order into ranges, its cells,
and neighbouring cells are a task. A query looks at the cells around its own,
in every order; those that reach into the next task are looked at there. The
candidates are compared by exact double-precision products, and the best of all
windows are the result.

The length that vectors are lifted to is a quantile of all lengths, so a few
long ones don't press the others together. Longer vectors, at most LONG of all
rows, are compared with every query besides. Equal keys are told apart by a hash
of the vector, so no cell can grow beyond its share.

`window` is what a window covers on either side: a share of all rows, or, as a
whole number, so many rows, at which the work grows in proportion to the rows.
Vectors without structure (isotropic directions) are hardly nearer on a curve
than others, so that windows must be a share of them all; see the README for
measured recall of both kinds. Whatever the table holds, there are 2 * `k` rows on
either side at least, without which `k` could not be found.

Equal vectors are searched as one, with the smallest `k` + 1 ids of each, which
is exact as ties go to smaller ids. Vectors that are null, zero, of another
length than most, or hold null or non-finite components take no part, nor do
null ids. Repeated rows count once. Fewer candidates than k are all returned,
an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm import common, words

ORDERS = 8
DIMS = 3
WINDOW = 0.11
#: The largest share of rows whose vectors are longer than the length that others are lifted to.
LONG = 0.005
#: Cells of an order, at least, the most rows of one, and the rows of a task.
CELLS, CELL_ROWS, TASK_ROWS = 128, 4096, 8192
_BITS = 16
#: Bits of the hash that tells vectors with equal keys apart.
_TIE_BITS = 15


def hilbert_keys(cells: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates below 2**bits (rows of cells).

    Walks down the curve's levels: every level fixes one bit of each coordinate, whose Gray code is
    the next digit, and turns the frame by an exchange of axes and a reflection.
    """
    n, p = cells.shape
    point = cells.astype(np.int64)
    perm = np.tile(np.arange(p), (n, 1))  # axis that stands at each place of the frame
    flip = np.zeros((n, p), dtype=np.int64)  # reflections by place
    key = np.zeros(n, dtype=np.int64)
    rows = np.arange(n)
    for level in range(bits - 1, -1, -1):
        digit_bits = ((point[rows[:, None], perm] >> level) & 1) ^ flip
        # inverse Gray code: each bit is the parity of those before it
        step = np.bitwise_xor.accumulate(digit_bits, axis=1)
        digit = np.zeros(n, dtype=np.int64)
        for j in range(p):
            digit = (digit << 1) | step[:, j]
        key = (key << p) | digit
        # entry corner and direction of this sub-cube
        last = digit & 1
        before = np.where(digit == 0, 0, 2 * ((digit - 1) // 2))
        entry = before ^ (before >> 1)
        up = np.where(digit == 0, 0, np.where(last == 1, digit, digit - 1))
        low_ones = np.zeros(n, dtype=np.int64)
        run = np.ones(n, dtype=bool)
        for _ in range(p):
            run &= (up >> low_ones) & 1 == 1
            low_ones += run
        along = np.where(digit == 0, 0, low_ones % p)
        enter = ((entry[:, None] >> np.arange(p - 1, -1, -1)) & 1).astype(np.int64)
        flip = flip ^ enter
        # places turn so that the curve leaves along the right axis
        turn = (along + 1) % p
        shift = (np.arange(p)[None, :] - turn[:, None]) % p
        perm = np.take_along_axis(perm, shift, axis=1)
        flip = np.take_along_axis(flip, shift, axis=1)
    return key


class Curves:
    """The rotations and offsets of all orders, for vectors of one length."""

    def __init__(self, length: int, reach: float, orders: int = ORDERS, dims: int = DIMS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.reach, self.dims = reach, min(dims, length + 1)
        self.rotations = [np.linalg.qr(rng.normal(size=(length + 1, self.dims)))[0] for _ in range(orders)]
        self.offsets = rng.random((orders, self.dims))
        self.scale = 4 * reach / np.sqrt(length + 1)

    def keys(self, x: np.ndarray, query: bool) -> list[np.ndarray]:
        """Keys of vectors in each order; vectors beyond `reach`, and all queries, count with their direction only."""
        size = np.sqrt((x * x).sum(1))
        shrunk = x * np.where(query | (size > self.reach), self.reach / size, 1)[:, None]
        lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.reach**2 - size**2))
        lifted = np.column_stack([shrunk, lift])
        tie = (words.mix(words.mix(np.ascontiguousarray(x).view(np.uint64)) * (2 * np.arange(x.shape[1], dtype=np.uint64) + np.uint64(1))).sum(1) >> np.uint64(64 - _TIE_BITS)).astype(np.int64)
        out = []
        for r, o in zip(self.rotations, self.offsets):
            unit = np.clip((lifted @ r / self.scale + 1) / 2, 0, 1)
            cell = ((unit + o) / 2 * (1 << _BITS)).astype(np.int64)
            out.append(hilbert_keys(np.minimum(cell, (1 << _BITS) - 1)) << _TIE_BITS | tie)
        return out


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, length)


_OUT = "query_id bigint, vec_id bigint, score double"
_PLACED = "o int, task int, asked int, low int, high int, id bigint, ids array<bigint>, vec array<double>"
_LAYOUT = pa.schema([("o", pa.int32()), ("task", pa.int32()), ("asked", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("id", pa.int64()), ("ids", pa.list_(pa.int64())), ("vec", pa.list_(pa.float64()))])


class Cells:
    """How orders are cut into cells and tasks, and which cells a query looks at."""

    def __init__(self, total: int, window: float | int, least: int = 1):
        rows = min(max(int(window * total) if isinstance(window, float) else window, least), max(total, 1))
        # a window has several cells on either side
        self.n = max(1, min(total, max(CELLS, 16 * total // rows, -(-total // CELL_ROWS))))
        self.reach = -(-rows * self.n // max(total, 1))
        self.per_task = max(1, TASK_ROWS * self.n // max(total, 1))

    def window(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last cell of the windows around cells; at the ends of the curve they move inward."""
        low = np.clip(cell - self.reach, 0, max(0, self.n - 1 - 2 * self.reach))
        return low, np.minimum(low + 2 * self.reach, self.n - 1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", window: float | int = WINDOW, orders: int = ORDERS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k nearest found among the rows of other ids.

    Both tables have id_col and vec_col.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
        good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
        return rows.where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))

    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    rows, asked = usable(vectors), usable(queries).distinct()
    lengths = rows.groupBy(F.size("vec").alias("length")).agg(F.count("*").alias("n"), F.percentile_approx(size, 1 - LONG / 2, 10_000).alias("reach")).orderBy(F.desc("n"), "length").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    length = lengths.length
    rows, asked = rows.where(F.size("vec") == length), asked.where(F.size("vec") == length)
    # of equal vectors the smallest ids only, repeated rows once; Spark limits each group before it is shuffled
    first = rows.distinct().select("vec", "id", F.row_number().over(Window.partitionBy("vec").orderBy("id")).alias("place")).where(F.col("place") <= k + 1)
    distinct = common.cut(first.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    # a rounding error doesn't make a vector longer
    reach = float(lengths.reach) * (1 + 1e-9)
    counted = distinct.agg(F.count("*").alias("n"), F.count_if(size > reach).alias("long")).first()
    total, long_tasks = counted.n, -(-counted.long // TASK_ROWS)
    curves, cells = Curves(length, reach, orders), Cells(total, window, 2 * k)

    def keyed(batches):
        for batch in batches:
            for o, key in enumerate(curves.keys(_matrix(batch.column(0), length), False)):
                yield pa.RecordBatch.from_pydict({"o": pa.array(np.full(len(key), o, np.int32)), "key": pa.array(key)})

    bounds = {o: np.zeros(0, np.int64) for o in range(orders)}
    if cells.n > 1:
        at = [float(i) / cells.n for i in range(1, cells.n)]
        found = distinct.select("vec").transform(common.batches, keyed, "o int, key bigint").groupBy("o").agg(F.percentile_approx("key", at, max(10_000, 8 * cells.n)).alias("b")).collect()
        bounds |= {r.o: np.array(r.b, dtype=np.int64) for r in found}
    shared = spark.sparkContext.broadcast((curves, bounds))

    def row(o, task, asked, low, high, id_, ids, vec):
        n = len(vec)
        whole = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int32), n))
        return pa.RecordBatch.from_arrays([whole(o), whole(task), whole(asked), whole(low), whole(high), id_ if id_ is not None else pa.nulls(n, pa.int64()), ids if ids is not None else pa.nulls(n, pa.list_(pa.int64())), vec], schema=_LAYOUT)

    def placed(batches):
        curves, bounds = shared.value
        for batch in batches:
            x = _matrix(batch.column(0), length)
            for o, key in enumerate(curves.keys(x, False)):
                cell = np.searchsorted(bounds[o], key, side="right")
                yield row(o, cell // cells.per_task, 0, cell, cell, None, batch.column(1), batch.column(0))
            far = np.flatnonzero((x * x).sum(1) > reach**2) if long_tasks else []
            if len(far):
                part = batch.take(pa.array(far))
                yield row(orders, np.asarray(pc.list_element(part.column(1), 0)) % long_tasks, 0, 0, 0, None, part.column(1), part.column(0))

    def visiting(batches):
        curves, bounds = shared.value
        for batch in batches:
            for o, key in enumerate(curves.keys(_matrix(batch.column(0), length), True)):
                low, high = cells.window(np.searchsorted(bounds[o], key, side="right"))
                a, b = low // cells.per_task, high // cells.per_task
                for d in range(int((b - a).max()) + 1 if len(a) else 0):
                    take = np.flatnonzero(a + d <= b)
                    part = batch.take(pa.array(take))
                    yield row(o, (a + d)[take], 1, low[take], high[take], part.column(1), None, part.column(0))
            for t in range(long_tasks):
                yield row(orders, t, 1, 0, 0, batch.column(1), None, batch.column(0))

    table = distinct.select("vec", "ids").transform(common.batches, placed, _PLACED).unionByName(asked.select("vec", "id").transform(common.batches, visiting, _PLACED))
    dealt = table.repartition("o", "task").sortWithinPartitions("o", "task", "asked", "low")

    def answered(batches):
        name, held, ids, matrix, cell = None, [], [], None, None
        for batch in batches:
            o, task, q, low, high = (np.asarray(batch.column(i)) for i in range(5))
            # runs of one task's candidates, and of its queries with one window
            changes = [x[1:] != x[:-1] for x in (o, task, q)] + [(low[1:] != low[:-1]) & (q[1:] == 1)]
            cuts = [0, *(np.flatnonzero(np.logical_or.reduce(changes)) + 1).tolist(), len(o)]
            for a, z in zip(cuts, cuts[1:]):
                here, part = (int(o[a]), int(task[a])), batch.slice(a, z - a)
                if here != name:
                    name, held, ids, matrix = here, [], [], None
                vec = _matrix(part.column(7), length)
                if not q[a]:
                    held.append((low[a:z], vec))
                    ids += part.column(6).to_pylist()
                    continue
                if not held:
                    continue
                if matrix is None:
                    cell, matrix = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                x, y = np.searchsorted(cell, [low[a], high[a] + 1]).tolist()
                if x < y:
                    asked_ids = part.column(5).to_pylist()
                    for s in range(0, len(vec), 512):
                        yield best(vec[s : s + 512], asked_ids[s : s + 512], matrix[x:y], ids[x:y])

    def best(vec, query, matrix, ids):
        product = vec @ matrix.T
        take = min(k + 1, len(matrix))
        top = np.argpartition(-product, take - 1, axis=1)[:, :take]
        # classes that tie with the last one taken, to a rounding error, stay in too
        line = np.take_along_axis(product, top, axis=1).min(1) - 1e-12 * (np.abs(product).max(1) + 1e-300)
        row, col = np.nonzero(product >= line[:, None])
        score = (vec[row] * matrix[col]).sum(1)
        q, v, s = [], [], []
        order = np.lexsort((-score, row))
        cuts = np.searchsorted(row[order], np.arange(len(vec) + 1))
        for i, own in enumerate(query):
            mine = order[cuts[i] : cuts[i + 1]]
            near = sorted((-score[m], c) for m in mine for c in ids[col[m]] if c != own)[:k]
            q += [own] * len(near)
            s += [-x[0] for x in near]
            v += [x[1] for x in near]
        return pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    near = dealt.transform(common.batches, answered, _OUT).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
