"""The pipeline against its stages by brute force, and the queries with SQL."""

import random

import duckdb
import pytest

import corpus_pipeline
from tokenloom.llm import common, nearcopies, quality, queries, secrets
from tests.llm.test_decontaminate import split
from tests.llm.test_nearcopies import brute

KEY = "531ccd051a92ebcb68"


def test_run_by_brute_force(spark, documents, folder):
    import sentencepiece

    from tokenloom.llm import sentencepieces

    dice = random.Random(8)
    word = lambda: "".join(dice.choice("aeiounrst") for _ in range(dice.randint(2, 7)))
    sentence = lambda: " ".join(word() for _ in range(9)).capitalize() + "."
    text = lambda: " ".join(sentence() for _ in range(dice.randint(2, 9)))
    item = " ".join(word() for _ in range(14))
    rows = [(i, text()) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300 + i, rows[30 + i][1] + " and") for i in range(20)]
    rows += [(400 + i, f"{text()} {item} {text()}") for i in range(10)] + [(450 + i, f"{text()} password={KEY}{i} {text()}") for i in range(10)]
    rows += [(500 + i, "X$$$ Y### Z&&& " * 40) for i in range(20)] + [(600, None), (601, ""), (602, "of")]
    docs = documents(rows)
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    sf_dir = folder(documents=docs, benchmark=bench)

    scores = quality.score(docs, quality.fit(docs)).collect()
    kept = {r.doc_id: r.text for r in scores if r.quality_score >= quality.KEEP}
    assert not any(500 <= d < 520 for d in kept) and len([d for d in kept if d < 500]) >= 205
    left = {d for d, _, c in brute(sorted(kept.items()), 5, 80) if d == c}
    model = secrets.fit_forest(secrets.labelled_findings(spark))
    sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepieces.default_model())
    want = {}
    for d in left:
        t = kept[d]
        if t and item in t:
            t = t.replace(item, "")
        want[d] = t
    masked = {r.doc_id: r[-1] for r in secrets.scan(documents(sorted(want.items())), model).collect()}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {d: sp.encode(t or "", add_bos=True, add_eos=True) for d, t in masked.items()}
    assert sum("[SECRET]" in (t or "") for t in masked.values()) == 10
    assert not any(split(item)[0] in split(t) and item in (t or "") for t in masked.values())


def test_stages_keep_the_columns(spark, documents, folder):
    docs = documents([(1, None), (2, ""), (3, "one good sentence, and another."), (3, "one good sentence, and another.")])
    sf_dir = folder(documents=docs, benchmark=spark.createDataFrame([], "item_id long, text string"))
    for rows in (docs, docs.limit(0)):
        part = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            part = common.cut(stage(spark, part, sf_dir))
            assert part.columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "secrets", "sentencepieces"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_all_ten_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
    assert nearcopies.SHINGLE == 5 and nearcopies.PERCENT == 80
