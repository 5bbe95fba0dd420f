"""Token operators on streams. All are stateless: the same expressions as on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tokenloom.operators.segment import Lexicon, tokenize


def token_stream(stream: DataFrame, lexicons: dict[str, Lexicon], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Ids of every text of a stream (text and the columns keep)."""
    return tokenize(stream, lexicons, keep=keep)


def write_tokens(tokens: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a token stream to Parquet; restarts go on from the checkpoint."""
    return tokens.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
