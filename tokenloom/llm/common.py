"""What the operators share: table access, the shared folder, batch slicing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of text that one vectorised step works on.
CHUNK_BYTES = 900_000
CHUNK_ROWS = 4096
#: Bytes of a batch between Spark and Python.
BATCH_BYTES = 2 << 20
_CUTS: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run in one process.

    On a cluster without that setting it is an error, as executors could not read each other's files.
    """
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            found = tempfile.mkdtemp(prefix="loom-checkpoint-")
            atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores behind it until no taken name equals it in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def leave_at_exit(spark: SparkSession, path: str) -> None:
    """Have a path of the shared folder deleted when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and continue from there.

    Lineage ends and lost executors lose nothing; unlike checkpoint(), which
    computes its input a second time to write it, this computes it once. The
    table goes when the driver ends, or by forget_cuts.
    """
    path = fresh_path(df.sparkSession, "cut")
    _CUTS.append(path)
    df.write.parquet(path)
    leave_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_light(df: DataFrame) -> DataFrame:
    """cut() for a table that is light to compute: an eighth as many tasks and files as a shuffle has."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.coalesce(max(1, n // 8)))


def forget_cuts(spark: SparkSession) -> None:
    """Delete the tables that cut() wrote in this session, once nothing that reads them is to run any more."""
    for path in _CUTS:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _CUTS.clear()


def _returned() -> None:
    """Give freed memory back: workers are used again, by other tasks and operators."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def batches(df: DataFrame, work, schema) -> DataFrame:
    """mapInArrow with batches of bounded bytes, so that wide rows don't fill a task's memory.

    Spark reads that bound when a plan runs, so the session keeps it.
    """

    def tidy(found):
        try:
            yield from work(found)
        finally:
            _returned()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(tidy, schema)


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; clashing extra columns are left behind."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def text_slices(batches, column: str = "text", max_bytes: int = CHUNK_BYTES, max_rows: int = CHUNK_ROWS):
    """Record batches cut so that each holds about max_bytes of the text column, one row at least and max_rows at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
        group = np.cumsum(sizes) // max_bytes + (np.arange(len(sizes)) // max_rows << 32)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def flat_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column back to back, and the n + 1 offsets; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def lowest_hashes(df: DataFrame, total: int, most: int, *key: str) -> DataFrame:
    """At most `most` rows of df, which has about `total`: those whose key hashes lowest, equal keys once.

    A threshold leaves about twice as many, so only so many rows are sorted, whatever df holds.
    """
    share = min(1.0, (2.0 * most + 100) / max(total, 1))
    line = min(-(1 << 63) + int((1 << 64) * share), (1 << 63) - 1)
    few = df.withColumn("__h", F.xxhash64(*key)).where(F.col("__h") <= line).dropDuplicates(["__h"])
    return few.orderBy("__h").limit(most).drop("__h")


#: Rows up to which a counted table may be broadcast.
BROADCAST_ROWS = 100_000


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with the right side broadcast if, counted, it has at most `most` rows, else with a shuffle.

    right is read twice, so it should be a table that was cut.
    """
    return left.join(F.broadcast(right) if right.limit(most + 1).count() <= most else right, on, how)


def open_store(uri: str):
    """The file system and the path in it of a folder or file given as Spark names it."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)
