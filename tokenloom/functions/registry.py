"""Functions for SQL, registered by name; registering again replaces them."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions import text as tx
from tokenloom.operators.segment import Encoder, Lexicon


def register(spark: SparkSession, lexicon: Lexicon, spellings: list[str], prefix: str = "loom") -> list[str]:
    """Register {prefix}_ids(text), {prefix}_tokens(text) and {prefix}_text(ids) for a vocabulary; the names.

    spellings: what each id decodes to, by id.
    """
    shared = spark.sparkContext.broadcast((lexicon, spellings))

    encoders: dict[str, Encoder] = {}

    def lists(texts: pd.Series) -> list[np.ndarray]:
        """Ids of a batch of texts; a worker keeps its encoder."""
        if "own" not in encoders:
            encoders["own"] = Encoder(shared.value[0])
        words = [[tx.BOUNDARY + w for w in re.split(tx.SEPARATOR, t or "") if w] for t in texts]
        ids, offsets = encoders["own"].ids(pa.array(words, pa.list_(pa.string())))
        return np.split(ids, offsets[1:-1])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(lists(texts))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([[shared.value[1][i] for i in x] for x in lists(texts)])

    @F.pandas_udf(T.StringType())
    def text(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: "".join(shared.value[1][i] for i in r).replace(tx.BOUNDARY, " ").lstrip(" ") if r is not None else None)

    names = {f"{prefix}_ids": ids, f"{prefix}_tokens": tokens, f"{prefix}_text": text}
    for name, f in names.items():
        spark.udf.register(name, f)
    return list(names)
