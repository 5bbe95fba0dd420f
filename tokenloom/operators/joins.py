"""Joins whose broadcast side is counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a counted table may be broadcast.
BROADCAST_ROWS = 1_000_000


def checked(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with the right side broadcast if, counted, it has at most `most` rows, else with a shuffle.

    right is read twice, so it should be a table or cheap to compute.
    """
    return left.join(F.broadcast(right) if right.limit(most + 1).count() <= most else right, on, how)


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> list:
    """All rows of a table that must be small; an error if it has over `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of over {most} rows where a small one is needed")
    return rows
