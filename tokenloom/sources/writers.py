"""Writers of bundles and reports. None replaces what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at a path, in whatever store it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def vocabulary_text(pieces: DataFrame, path: str) -> None:
    """One piece a line in the order of ids (a vocabulary is small, so one file)."""
    pieces.orderBy("id").select("piece").coalesce(1).write.mode("errorifexists").text(path)


def profiles(pieces: DataFrame, path: str) -> None:
    """All profiles' pieces, a folder for each."""
    pieces.repartition("profile").sortWithinPartitions("profile", "id").write.mode("errorifexists").partitionBy("profile").parquet(path)


def parameters(params: DataFrame, path: str) -> None:
    """Parameter rows, a folder for each key."""
    params.write.mode("errorifexists").partitionBy("key").parquet(path)


def report(rows: DataFrame, path: str) -> None:
    """Rows as JSON, one a line."""
    rows.coalesce(1).write.mode("errorifexists").json(path)


def report_text(rows: DataFrame) -> DataFrame:
    """report: every row as JSON text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("report"))
