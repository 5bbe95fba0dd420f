import math
import re

import numpy as np
import pyarrow as pa
import pytest

from tokenloom.llm import quality
from tokenloom.llm.words import mix, one_hash


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    n, right = 40_000, np.array([[0.5, 0.995], [0.4, 0.99], [0.7, 0.999], [0.3, 0.992]])
    truth = rng.random(n) < 0.85
    vote = np.stack([np.where(rng.random(n) < r[truth.astype(int)], truth, ~truth).astype(int) for r in right], axis=1)
    vote[rng.random(vote.shape) < 0.1] = -1
    pattern, count = np.unique(vote, axis=0, return_counts=True)
    post, found, share = quality.fit_labellers(pattern, count)
    assert abs(share - 0.85) < 0.03 and np.abs(found - right).max() < 0.1
    named = {tuple(p): x for p, x in zip(pattern.tolist(), post)}
    guess = np.array([named[tuple(v)] for v in vote.tolist()]) >= 0.5
    assert (guess == truth).mean() > 0.93


def test_features_are_shares():
    b = quality._Batch(pa.array(["The the THE!!", "", None, "a b a b"]))
    doc, bucket, value = quality.features(b)
    assert set(doc.tolist()) == {0, 3} and (np.diff(doc) >= 0).all() and value.max() <= 1 + 1e-9
    assert quality.votes(b)[1].tolist() == [-1] * len(quality.LABELLERS)


def test_scores_agree_with_true_labels(spark):
    got = quality.op2_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert both[both.quality == 1].keep.mean() > 0.99 and both[both.quality == 0].keep.mean() < 0.2
    assert len(got) == 1000


def test_every_kind_of_text(spark, documents):
    good = "The cat of the house, and it is with the dog. "
    rows = [(1, None), (2, ""), (None, good), (4, good * 50_000), (5, good), (5, good), (6, "X$$$ Y### Z&&& " * 40)]
    docs = documents(rows, extra=True)
    done = quality.score(docs, quality.fit(docs))
    scores = {}
    for r in done.collect():
        scores.setdefault(r.doc_id, []).append(r["quality_score_"])
    assert sum(map(len, scores.values())) == len(rows) and scores[5][0] == scores[5][1]
    assert all(0 <= s <= 1 for v in scores.values() for s in v)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0))).count() == 0
    assert quality.keep_good(documents(rows)).columns == documents(rows).columns


@pytest.mark.parametrize("value", [0.0, 1.0])
@pytest.mark.parametrize("name", ["quality_score", "Quality_Score"])
def test_input_columns_of_the_same_name_decide_nothing(spark, documents, name, value):
    good = "The cat of the house, and it is with the dog. "
    docs = documents([(i, good * (1 + i % 5) + f"and {i}.") for i in range(80)] + [(100 + i, f"X$$$ Y### {i}&&& " * 12) for i in range(20)])
    plain = {r.doc_id for r in quality.keep_good(docs).collect()}
    odd = docs.selectExpr("*", f"{value}d as {name}")
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == plain
    assert plain == set(range(80)) and {r[name] for r in kept.collect()} == {value}


def plain_features(text):
    """Buckets and values of one text, word by word."""
    raw = text.encode()
    found = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
    kinds = bytes(ord("A") if 65 <= b < 91 else ord("a") if 97 <= b < 123 or b >= 128 else ord("9") if 48 <= b < 58 else b for b in raw)
    out, before, last = {}, 0, None

    def add(code, value):
        out[code >> 64 - quality.BITS] = out.get(code >> 64 - quality.BITS, 0) + value

    def mixed(x):
        return int(mix(np.array([x % 2**64], dtype=np.uint64))[0])

    n = len(found)
    for a, b in found:
        # runs of a kind count as two at most; the first byte of a word always counts
        form = one_hash(bytes(k for i, k in enumerate(kinds) if a <= i < b and (i == a or i < 2 or kinds[i - 1] != k or kinds[i - 2] != k)))
        add(form, 1 / n)
        add(mixed(form + mixed(before + 1)), 1 / n)
        if b - a <= 3:
            add(mixed(one_hash(raw[a:b]) + 2), 1 / n)
        if raw[a:b] == last:
            add(11 << 50, 1 / n)
        before, last = form, raw[a:b]
    lines = [x for x in raw.split(b"\n") if x]
    if n:
        add(12 << 50, (len(lines) - len(set(lines))) / max(len(lines), 1))
    return out


def test_scores_by_definition(spark, folder, documents):
    """The query against features, a sum and a logistic function written out."""
    rows = [(i, f"The {'cat ' * (i % 4)}of ABC12 houses,\nand it is {i} über-groß.\n" * (1 + i % 3)) for i in range(40)] + [(50, None), (51, "X$$$ Y### " * 9)]
    docs = documents(rows, extra=True)
    got = {r.doc_id: r for r in quality.op2_quality(spark, folder(documents=docs)).collect()}
    bias, weight = quality.fit(documents(rows).select("text"))
    for d, text in rows:
        z = bias + sum(weight[b] * v for b, v in plain_features(text or "").items())
        assert got[d].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and got[d].keep == (got[d].score >= quality.KEEP)
