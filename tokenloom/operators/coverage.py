"""What vocabularies cover of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.segment import Lexicon, with_ids


def by_group(docs: DataFrame, lexicons: dict[str, Lexicon], group: str = "lang") -> DataFrame:
    """group, profile, records, unknown_records, tokens, unknown_tokens."""

    def counts(batch, found):
        for name, (ids, offsets) in found.items():
            unknown = np.concatenate([[0], np.cumsum(ids == 0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * batch.num_rows), pa.array(np.diff(offsets)), pa.array(np.diff(unknown[offsets]))], names=[group, "profile", "n", "u"])

    return (
        with_ids(docs, lexicons, "text", (group,), counts, "profile string, n bigint, u bigint")
        .groupBy(group, "profile")
        .agg(F.count("*").alias("records"), F.count_if(F.col("u") > 0).alias("unknown_records"), F.sum("n").alias("tokens"), F.sum("u").alias("unknown_tokens"))
    )


def retokenization(docs: DataFrame, lexicons: dict[str, Lexicon], first: str, second: str) -> DataFrame:
    """doc_id of every row and whether its ids differ between two profiles."""

    def compared(batch, found):
        (a, a_at), (b, b_at) = found[first], found[second]
        size, other = np.diff(a_at), np.diff(b_at)
        differs = size != other
        same = np.flatnonzero(~differs)
        n = size[same]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        unequal = a[np.repeat(a_at[same], n) + within] != b[np.repeat(b_at[same], n) + within]
        differs[np.repeat(same, n)[unequal]] = True
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(differs)], names=["doc_id", "differs"])

    return with_ids(docs, {k: lexicons[k] for k in (first, second)}, "text", ("doc_id",), compared, "differs boolean")


def dominated(pieces: DataFrame) -> DataFrame:
    """id, piece, score and best of pieces that two or more other pieces spell at a better sum of scores."""
    shared = pieces.sparkSession.sparkContext.broadcast(Lexicon.of(pieces))

    def work(batches):
        lexicon = shared.value
        for batch in batches:
            best = []
            for piece in batch.column(1).to_pylist():
                # without the piece itself
                rest = Lexicon({k: v for n in range(len(piece)) for e in range(n + 1, len(piece) + 1) if (k := piece[n:e]) != piece and (v := lexicon.pieces.get(k))}, len(piece), lexicon.unknown)
                found = rest.path(piece, strict=True) if rest.pieces else None
                best.append(found and found[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.float64())], names=["id", "piece", "score", "best"])

    rows = pieces.where("type = 1").select("id", "piece", "score").mapInArrow(work, "id int, piece string, score double, best double")
    return rows.where("best > score")
