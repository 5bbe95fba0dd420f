import pytest

ODD = "key long, row_id long, h long, n long, score double, keep boolean, findings string, redacted string, leak string, quality_score string, component_id string, cls string, ids string"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table, with extra columns whose names the operators use themselves."""

    def build(rows, extra=False):
        df = spark.createDataFrame([(*r, "en", "src", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            for field in ODD.split(", "):
                name, kind = field.split(" ")
                df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
        return df

    return build


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes tables as the queries expect them."""

    def write(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return write
