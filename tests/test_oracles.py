"""Every query with SQL against DuckDB on the same tables."""

import duckdb
import pytest

from tokenloom.plans import catalog

TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    columns = sorted(frame.columns)

    def cell(v):
        if v is None or str(v) == "<NA>" or v != v:
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return columns, sorted(tuple(map(cell, r)) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = rows(catalog.queries()[name](spark, sf_dir).toPandas())
    want = rows(duck.execute(catalog.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_queries_without_sql_are_few(spark):
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"sampled_segmentation"}


def test_masked_logits_of_odd_vectors(spark, tmp_path):
    # logits that round to zero from below, vectors without values, with holes and of other lengths
    a, b, c = 0.1, -0.3, 0.7
    vectors = [[a, b, c], [1e-7, 0.0, 0.0], [-1e-7, 0.0, 0.0], [0.0, 0.0, 0.0], None, [], [None, None, None], [a, None, c], [None, b], [a], [b, c], [c, a], [float("nan"), a, b], [float("inf"), a, b]]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = catalog.queries()["masked_logits"](spark, str(tmp_path)).collect()
    want = con.execute(catalog.oracle_sql()["masked_logits"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert "-0.0" in {repr(r.logit) for r in got}
