import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tokenloom.llm import lm

WORD, LOW = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score by the definition."""
    split = [(d, WORD.findall((t or "").translate(LOW)) + [None]) for d, t in rows]
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    count = collections.Counter()
    for d, w in split:
        if not held[d]:
            count.update(w)
    n, v = sum(count.values()), len(count)
    return sorted(((d, held[d], len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for d, w in split), key=str)


def test_base_scores(spark, folder, documents, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % (i + 3)}" for k in range(i % 30))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "W1 w1\tw1"), (202, "W1 w1\tw1"), (None, "w2 new"), (203, "far " * 200_000), (204, "a b \u0085c")]
    docs = documents(rows, extra=True)
    for head in (lm.HEAD, 5):  # with few head words most tokens take the way of the rare ones
        monkeypatch.setattr(lm.vocabulary, "__defaults__", (head,))
        got = lm.op7_lm(spark, folder(documents=docs)).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == base(rows)
    assert lm.op7_lm(spark, folder(documents=docs.limit(0))).count() == 0
    alone = [d for d in range(300) if zlib.crc32(str(d).encode()) % 10 == 0][:2]
    got = lm.op7_lm(spark, folder(documents=documents([(d, "x y") for d in alone]))).collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in got] == [(0, 0, 0.0)] * 2 and all(math.isfinite(r.score) for r in got)


def drawn(size, classes, seed=0):
    rng = np.random.default_rng(seed)
    draw = lambda *n: rng.normal(size=n).astype(np.float32)
    return lm.Model(draw(size, lm.SIZE), draw(size), draw(classes, lm.SIZE), draw(classes), draw(lm.CONTEXT, lm.SIZE))


def plain_log10(model, units):
    """log10 of the probability of one document's units by the definition, with plain loops."""
    out, before = 0.0, [lm.END] * lm.CONTEXT
    for u in units:
        q = sum(model.context[j].astype(float) * model.word[before[j]] for j in range(lm.CONTEXT))
        of_class = [math.exp(float(r.astype(float) @ q) + float(b)) for r, b in zip(model.class_word, model.class_bias)]
        same = range(u % model.classes, len(model.bias), model.classes)
        within = {v: math.exp(float(model.word[v].astype(float) @ q) + float(model.bias[v])) for v in same}
        out += math.log10(of_class[u % model.classes] / sum(of_class)) + math.log10(within[u] / sum(within.values()))
        before = [u, *before[:-1]]
    return out


def test_probabilities_are_normalised():
    m = drawn(512, 16)
    m.word *= 0.3
    for context in np.random.default_rng(0).integers(0, 512, (3, lm.CONTEXT)):
        units = np.concatenate([np.append(context, u) for u in range(512)])
        got = m.log_probability(units, np.arange(513) * (lm.CONTEXT + 1))
        assert np.exp(got.reshape(512, -1)[:, -1]).sum() == pytest.approx(1, abs=1e-5)


def test_probabilities_by_definition():
    m = drawn(64, 8)
    m.word *= 0.3
    units, offsets = np.random.default_rng(1).integers(0, 64, 40), np.array([0, 3, 3, 40])
    whole = m.log_probability(units, offsets) / np.log(10)
    assert np.allclose(whole, m.log_probability(units, offsets, most=7) / np.log(10), atol=1e-5)
    for a, b in ((0, 3), (3, 40)):
        assert whole[a:b].sum() == pytest.approx(plain_log10(m, units[a:b].tolist()), abs=1e-3)


def test_noise_follows_the_counts():
    counts = np.random.default_rng(2).integers(0, 1000, 64).astype(float)
    noise, rng, seen = lm.Noise(counts, 8), np.random.default_rng(3), np.zeros(64)
    for _ in range(4000):
        seen += np.bincount(noise.draw_units(rng).ravel(), minlength=64)
    want = (counts + 1).reshape(-1, 8) / (counts + 1).reshape(-1, 8).sum(0)
    assert np.allclose(seen.reshape(-1, 8) / seen.reshape(-1, 8).sum(0), want, atol=0.02)


def test_training_learns_an_order():
    """In a text where each word tells the next, the model must be much better than counts."""
    rng = np.random.default_rng(1)
    follow = np.concatenate([[0], 1 + rng.permutation(255)])
    seq = [2]
    for _ in range(60_000):
        seq.append(int(follow[seq[-1]]) if rng.random() < 0.8 else int(rng.integers(1, 256)))
    units = np.array(seq)
    counts = np.bincount(units, minlength=256)
    model = lm.Model.start(counts, 16)
    trainer = lm.Trainer(model, lm.Noise(counts, 16), batch=1024)
    for _ in range(6):
        trainer.learn(units, np.array([0, len(units)]))
    own = model.log_probability(units, np.array([0, len(units)])).mean()
    assert own > np.log(np.maximum(counts[units], 1) / len(units)).mean() + 0.7


def test_averages_are_by_what_tasks_met():
    start = drawn(2 * lm.CHUNK, 32)
    tasks = [(drawn(2 * lm.CHUNK, 32, k), np.random.default_rng(k).integers(0, 3, 2 * lm.CHUNK).astype(float), n) for k, n in ((1, 10), (2, 30))]
    batches = [lm._messages([a - b for a, b in zip(m.parts(), start.parts())], met, n, 0) for m, met, n in tasks]
    found = {r["chunk"]: r for b in lm._summed(batches) for r in b.to_pylist()}
    got = lm._moved(start.copy(), found)
    weight = tasks[0][1] + tasks[1][1]
    want = start.word + sum((m.word - start.word) * (met / np.maximum(weight, 1))[:, None] for m, met, _ in tasks)
    assert np.allclose(got.word, want, atol=1e-5) and np.allclose(got.class_bias, 0.25 * tasks[0][0].class_bias + 0.75 * tasks[1][0].class_bias, atol=1e-5)


def test_scores_by_definition(spark, documents):
    """The query's score against words, units, shares and softmax written out."""
    rows = [(i, " ".join(f"W{(i * k * k) % 97:04d}{'x' * (k % 7)}" for k in range(i % 40))) for i in range(120)] + [(500, "never seen W0001 words"), (501, None)]
    docs = documents(rows).selectExpr("doc_id", "text", "doc_id % 10 = 0 as held_out")
    split = {d: WORD.findall((t or "").translate(LOW)) + [None] for d, t in rows}
    count = collections.Counter(w for d, ws in split.items() if d % 10 for w in ws)
    for head in (lm.HEAD, 200):
        counts = lm.token_counts(docs.where("not held_out"))
        vocab = lm.vocabulary(counts, head)
        model = lm.fit(docs.where("not held_out"), vocab)
        got = {r.doc_id: r.score for r in lm.score(docs, vocab, model, counts).collect()}
        ranked = sorted((w for w in count if w is not None), key=lambda w: -count[w])
        alone = {w for w in ranked if vocab.unit_of(*hashed(w))[1][0] == 0}
        # the units of their own are the most frequent words
        assert len(alone) < len(ranked) and min(count[w] for w in alone) >= max(count[w] for w in ranked if w not in alone)
        unit = {w: int(vocab.unit_of(*hashed(w))[0][0]) for w in {w for ws in split.values() for w in ws if w is not None}} | {None: lm.END}
        total, kinds = collections.Counter(), collections.Counter()
        for w in ranked:
            if w not in alone:
                total[unit[w]] += count[w]
                kinds[unit[w]] += 1
        for d, ws in split.items():
            want = plain_log10(model, [unit[w] for w in ws])
            want += sum(math.log10((count[w] + 0.1) / (total[unit[w]] + 0.1 * (kinds[unit[w]] + 1))) for w in ws if w is not None and w not in alone)
            assert got[d] == pytest.approx(want, abs=2e-3 + 1e-5 * abs(want)), d


def hashed(word):
    h, s, _ = lm.tokens(pa.array([word]))
    return h[:1], s[:1]


def test_scores_hardly_depend_on_how_rows_fall_into_tasks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "doc_id % 10 = 0 as held_out")
    totals = []
    for n in (2, 16):
        part = docs.repartition(n)
        counts = lm.token_counts(part.where("not held_out"))
        vocab = lm.vocabulary(counts)
        got = lm.score(part, vocab, lm.fit(part.where("not held_out"), vocab), counts).where("held_out").selectExpr("sum(score)", "sum(n_tokens)").first()
        totals.append(got[0] / got[1])
    assert abs(totals[0] - totals[1]) < 0.1


def test_held_out_scores_beat_the_base(spark):
    got = lm.op7_lm(spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (held.score > held.base_score).mean() > 0.9


def test_tokens_of_a_batch():
    h, start, offsets = lm.tokens(pa.array(["A b", None, "b a a"]))
    assert offsets.tolist() == [0, 3, 4, 8]
    assert h[0] == h[5] == h[6] and h[1] == h[4] and h[2] == h[3] == h[7]


def test_words_share_a_unit_by_their_start():
    h, start, _ = lm.tokens(pa.array(["wonder wonderful wander"]))
    assert start[0] == start[1] != start[2] and len(set(h[:3].tolist())) == 3
