import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tokenloom.llm import toxicity
from tokenloom.llm.words import mix, one_hash


def test_machine_learns_a_pair_that_adds_up_to_nothing():
    """Toxic is one of two terms with the other kind, in all four combinations of presence (no additive rule)."""
    rng = np.random.default_rng(1)
    rows, label = [], []
    for _ in range(3000):
        a, b = map(int, rng.random(2) < 0.5)
        noise = rng.choice(np.arange(100, 160), 8, replace=False)
        rows.append(np.sort(np.concatenate([noise, [7] * a, [9] * b])).astype(np.int64))
        label.append(int(a == b))
    m = toxicity.fit(rows[:2000], np.array(label[:2000]))
    doc = np.repeat(np.arange(1000), [len(r) for r in rows[2000:]])
    z = m.logits(doc, np.concatenate(rows[2000:]), 1000)
    assert ((z > 0) == (np.array(label[2000:]) == 1)).mean() > 0.95
    linear = toxicity.Machine(m.terms, m.bias, m.weight, np.zeros((len(m.terms), 0)))
    assert ((linear.logits(doc, np.concatenate(rows[2000:]), 1000) > 0) == (np.array(label[2000:]) == 1)).mean() < 0.8


@pytest.mark.parametrize("others, size, n", [(8000, 20, 2000), (40_000, 30, 2500)])
def test_a_pair_among_many_terms(others, size, n):
    """Either of two terms without the other: each alone tells nothing, and there are thousands of other terms."""
    rng = np.random.default_rng(4)
    rows, label = [], []
    for _ in range(n + 800):
        a, b = map(int, rng.random(2) < 0.5)
        rows.append(np.unique(np.concatenate([rng.integers(100, 100 + others, size), [7] * a, [9] * b])).astype(np.int64))
        label.append(int(a != b))
    m = toxicity.fit(rows[:n], np.array(label[:n]))
    doc = np.repeat(np.arange(800), [len(r) for r in rows[n:]])
    z = m.logits(doc, np.concatenate(rows[n:]), 800)
    assert {7, 9} <= set(m.terms.tolist()) and ((z > 0) == (np.array(label[n:]) == 1)).mean() > 0.97


def test_labels_without_a_reason_teach_little():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 20_000, 60)) for _ in range(2000)]
    m = toxicity.fit(rows, (rng.random(2000) < 0.1).astype(int))
    doc = np.repeat(np.arange(2000), [len(r) for r in rows])
    fresh = np.concatenate([np.unique(rng.integers(0, 20_000, 60)) for _ in range(500)])
    assert m.bias < -1 and (m.logits(np.arange(len(fresh)) % 500, fresh, 500) > 0.85).mean() < 0.01


def test_logits_equal_the_formula():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(np.array([3, 5, 8]), 0.5, rng.normal(size=3), rng.normal(size=(3, 4)))
    want = 0.5 + m.weight[0] + m.weight[2] + m.factor[0] @ m.factor[2]
    assert np.allclose(m.logits(np.array([0, 0, 0]), np.array([3, 6, 8]), 2), [want, 0.5])


def test_pairs_are_distinct_whole_words_and_starts():
    doc, term = toxicity.term_pairs(pa.array(["Bad bad BAD", None, "", "badness"]))
    assert np.bincount(doc, minlength=4).tolist() == [1, 0, 0, 3]


def test_held_out_documents(spark):
    got = toxicity.op3_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    both = got.merge(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert both[both.toxic == 0].predicted.mean() < 0.03 and both[both.toxic == 1].predicted.mean() > 0.6


def test_query_by_definition(spark, folder, documents):
    """The query against sums over words, starts and pairs of terms written out."""
    rows = [(i, " ".join(["calm", "Fool" if i % 4 == 0 else "dayly", f"w{i % 9}", "them" if i % 8 < 4 else "überall"])) for i in range(240)] + [(900, None), (901, "fools' them!")]
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    tables = folder(documents=documents(rows, extra=True), labels=labels)
    got = {r.doc_id: r for r in toxicity.op3_toxicity(spark, tables).collect()}
    known = documents(rows)
    m = toxicity.fit(*toxicity.labelled_terms(known, labels, "toxic", toxicity.TRAIN_ROWS, ~toxicity.held_out(3, 1)))
    place = {t: k for k, t in enumerate(m.terms.tolist())}
    for d, text in rows:
        found = set()
        for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
            w = w.lower()
            found.add(one_hash(w) >> 64 - toxicity.TERM_BITS)
            for k in toxicity.PREFIXES:
                if len(w) > k:
                    found.add(int(mix(np.array([one_hash(w[:k]) + k], dtype=np.uint64))[0]) >> 64 - toxicity.TERM_BITS)
        at = [place[t] for t in sorted(found) if t in place]
        z = m.bias + sum(m.weight[i] for i in at) + sum(float(m.factor[i] @ m.factor[j]) for x, i in enumerate(at) for j in at[:x])
        assert abs(got[d].score - 1 / (1 + np.exp(-z))) < 1e-9 and got[d].predicted == (got[d].score >= 0.7)
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
    assert max(r.score for r in got.values()) > 0.9


def test_sample_is_bounded_in_terms(spark, documents, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_TERMS", 100)
    rows = [(i, " ".join(f"w{k}" for k in range(i))) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    found, label = toxicity.labelled_terms(documents(rows), labels, "toxic", 1000)
    assert 50 < sum(map(len, found)) <= 100 and len(found) == len(label)


def test_every_kind_of_text(spark, folder, documents):
    rows = [(i, "you fool and " + "calm " * (i % 5) if i % 2 else "a calm day") for i in range(60)] + [(100, None), (101, ""), (101, ""), (102, "fool " * 300_000), (None, "fool")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(3, 1, None), (5, None, 1), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.op3_toxicity(spark, folder(documents=documents(rows, extra=True), labels=labels)).collect()
    assert len(got) == len(rows) and all(r.score is not None and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.score for r in got if r.doc_id in (100, 101)} == {next(r.score for r in got if r.doc_id == 100)}
    none = toxicity.op3_toxicity(spark, folder(documents=documents(rows), labels=labels.limit(0))).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 0)}
    assert toxicity.op3_toxicity(spark, folder(documents=documents(rows).limit(0), labels=labels)).count() == 0
