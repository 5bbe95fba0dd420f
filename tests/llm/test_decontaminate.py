import hashlib
import random
import re

import numpy as np
import pytest

from tokenloom.llm import decontaminate

WORD, LOW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(spark, documents, docs, items):
    return documents(docs, extra=True), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as leak", "1 as n_words")


def cases():
    dice = random.Random(3)
    word = lambda: dice.choice(["a", "b", "cc", "Été", "x9", "the", "of", "in"])
    items = [(i, " ".join(word() for _ in range(dice.randint(9, 16)))) for i in range(30)] + [(40, "cc x9"), (41, ""), (42, None), (43, " ".join(["same"] * 12)), (2, "b the"), (None, "zz yy xx"), (44, "cc x9")]
    docs = []
    for i in range(120):
        parts = [word() for _ in range(dice.randint(0, 40))]
        for _ in range(dice.randint(0, 2)):
            k = dice.randint(0, len(parts))
            parts[k:k] = split(dice.choice(items[:30])[1])[: dice.randint(8, 20)]
        docs.append((i, dice.choice([" ", "-", "\n"]).join(parts)))
    docs += [(200, None), (201, ""), (202, "same " * 5000), (203, "!!! ???"), (7, docs[7][1]), (204, "CC-X9"), (205, "zz yy xx"), (206, ("unknown words go on " * 60_000) + docs[3][1])]
    return docs, items


def test_equals_brute_force(spark, documents, folder):
    docs, items = cases()
    d, b = tables(spark, documents, docs, items)
    got = decontaminate.op8_decontaminate(spark, folder(documents=d, benchmark=b)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got), key=str) == brute(docs, items)
    for a, z in ((d.limit(0), b), (d, b.limit(0)), (d, b.where("item_id = 41"))):
        rows = decontaminate.op8_decontaminate(spark, folder(documents=a, benchmark=z)).collect()
        assert not any(r.contaminated for r in rows) and len(rows) == a.count()


def test_small_shards_and_blocks(spark, documents, monkeypatch):
    docs, items = cases()
    d, b = tables(spark, documents, docs[:-1], items)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    got = decontaminate.search_documents(d, b, shard_bytes=300).select("doc_id", "leak_.*").collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.n_hit > 0) for r in got), key=str) == brute(docs[:-1], items)


def test_spans_and_removal(spark, documents):
    docs = documents([(1, "Ä keep. Cut this, please é keep"), (2, None), (3, "nothing here")])
    items = spark.createDataFrame([(1, "cut THIS please é")], "item_id long, text string")
    r = {x.doc_id: x for x in decontaminate.search_documents(docs, items).collect()}
    assert [(s.begin, s.end) for s in r[1].leak.spans] == [(9, 29)] or r[1].text.encode()[r[1].leak.spans[0].begin : r[1].leak.spans[0].end].decode() == "Cut this, please é"
    done = decontaminate.remove_passages(docs, items)
    assert done.columns == docs.columns
    assert {x.doc_id: (x.text, x.n_chars) for x in done.collect()} == {1: ("Ä keep.  keep", 13), 2: (None, None), 3: ("nothing here", 12)}


@pytest.mark.parametrize("alphabet", [1, 2, 5, 70])
def test_index_by_brute_force(alphabet):
    rng = np.random.default_rng(alphabet)
    for _ in range(60):
        body = rng.integers(1, alphabet + 1, rng.integers(1, 90)).astype(np.int32)
        if rng.random() < 0.3:
            body = np.tile(body[:7], 12)
        text = np.append(body, np.int32(0))
        order = decontaminate.suffix_array(text, alphabet)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        index = decontaminate.FMIndex(text, alphabet, sample=int(rng.integers(1, 9)))
        assert index.locate(np.arange(len(text))).tolist() == order.tolist()
        n = int(rng.integers(1, 5))
        window = np.zeros((20, 4), np.int32)
        for row in window:
            row[:n] = rng.integers(1, alphabet + 1, n)
        which, low, high = index.search(window, np.full(20, n))
        got = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
        for w, row in enumerate(window):
            want = [i for i in range(len(text) - n + 1) if text[i : i + n].tolist() == row[:n].tolist()]
            assert got.get(w, []) == want


def test_clashing_columns_and_blocks(spark, documents, monkeypatch):
    """A column LEAK, and items in blocks of a few words that are read one after the other."""
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(6)], "item_id long, text string")
    docs = documents([(i, f"so {' '.join(f'w{i}x{k}' for k in range(11))} it is") for i in range(6)] + [(9, "nothing")]).selectExpr("*", "'kept' as LEAK")
    whole = sorted((r.doc_id, r.LEAK, r.leak_.n_hit, r.leak_.items_sha256) for r in decontaminate.search_documents(docs, items).collect())
    assert [x[1:3] for x in whole] == [("kept", 11)] * 6 + [("kept", 0)]
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    assert len(list(decontaminate.blocks_of(items))) > 2
    assert sorted((r.doc_id, r.LEAK, r.leak_.n_hit, r.leak_.items_sha256) for r in decontaminate.search_documents(docs, items).collect()) == whole
    assert decontaminate.remove_passages(docs, items).columns == docs.columns
