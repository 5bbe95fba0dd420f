import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenloom.llm import sentencepieces

MODEL = sentencepieces.default_model()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def agree(library, texts):
    table = sentencepieces.loaded(MODEL)
    ids, n = table.encode(pa.array(texts, pa.string()))
    flat, offsets = table.decode(ids, n)
    cuts = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_bos=True, add_eos=True)
        assert ids[cuts[i] : cuts[i + 1]].tolist() == want, t[:80]
        assert flat[offsets[i] : offsets[i + 1]].tobytes().decode() == library.decode(want)


TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b   c    d", "\x00", "tab\tline\nend\r\n", "日本語 ሴ", "▁", "a▁b ▁▁ c", "<s> </s> <unk> <0x0A>", "😀😀 ok", "é" * 50, "abababababab", "aaaaaaaaaaaaa", "ሴሴሴ a ሴ", "  x", "x" * 3000 + " y", " " * 40, "\n" * 30]


def test_edge_cases(library):
    agree(library, TEXTS)


def test_long_words_and_texts(library):
    agree(library, [" " * 9000, "ab" * 9000, "ሴ" * 3000, "the quick brown fox " * 20_000, "".join(chr(0x4E00 + i % 900) for i in range(5000))])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aabbcde thin\n▁ é日ሴ😀0.,<>s"), max_size=40), min_size=1, max_size=6))
def test_any_text(library, texts):
    agree(library, texts)


def queue(table, sym):
    """The merges of one word in the order of a priority queue, best rank and then leftmost first."""
    sym = sym.tolist()
    while len(sym) > 1:
        rank, made = table.pairs(np.array(sym[:-1]), np.array(sym[1:]))
        at = int(rank.argmin())
        if rank[at] == sentencepieces._NONE:
            break
        sym[at : at + 2] = [int(made[at])]
    return sym


def test_rounds_equal_the_queue():
    table = sentencepieces.PieceTable(MODEL)
    rng = np.random.default_rng(0)
    for n in [*range(1, 40)] * 4 + [300] * 6:
        word = "".join(rng.choice(list("aeithnso▁ ."), n))
        sym = table.char_symbol[np.array([ord(c) for c in word.replace(" ", "▁")])]
        assert table.merge(sym, np.array([len(sym)]))[0].tolist() == queue(table, sym)


def test_long_words_are_cut_where_nothing_merges(library):
    rng = np.random.default_rng(3)
    letters = {"low": "abcdefghijklmnopqrstuvwxyz", "keys": "ABCDabcdxyz0189+/=", "few": "etaoin", "mixed": "aé日ሴb"}
    agree(library, ["".join(rng.choice(list(x), n)) for x in letters.values() for n in (50, 700, 20_000)] + ["the" * 4000 + " " + "a" * 4097 + "b"])


def twins(n):
    """Two words of n letters that sums of powers modulo 2**64 can't tell apart from 1,024 on."""
    one = "a"
    while len(one) < n:
        one += one.translate(str.maketrans("ab", "ba"))
    return one[:n], one[:n].translate(str.maketrans("ab", "ba"))


def test_words_that_look_alike_to_sums(library):
    agree(library, [w for n in (512, 1024, 2048, 4096) for w in twins(n)])


def test_equal_hashes_of_other_words(library, monkeypatch):
    plain = sentencepieces.words.span_hashes
    monkeypatch.setattr(sentencepieces.words, "span_hashes", lambda flat, starts, ends: plain(flat, starts, ends) % np.uint64(7))
    monkeypatch.setitem(sentencepieces._TABLES, sentencepieces.hashlib.sha256(MODEL).hexdigest(), sentencepieces.PieceTable(MODEL))
    for _ in range(2):
        agree(library, ["some words that are many more than seven and some again", "other words", "many more words"])


def test_foreign_ids_decode(library):
    table = sentencepieces.loaded(MODEL)
    for ids in ([1, 2], [1, 0xE4 + 3, 0xB8 + 3, 300, 2], [3 + 0xE4, 3 + 0xB8, 3 + 0xE4, 3 + 0x41, 3 + 0xFF], [1, 300, 1, 301], [0, 5000, 0]):
        flat, offsets = table.decode(np.array(ids), np.array([len(ids)]))
        assert sentencepieces.repaired(flat.tobytes()).decode() == library.decode(ids), ids


def test_query_equals_the_library(spark, documents, folder, library):
    rows = list(enumerate(t for t in TEXTS if t is None or "\x00" not in t)) + [(4, "a"), (None, "no id")]
    got = sentencepieces.op9_sentencepieces(spark, folder(documents=documents(rows, extra=True))).collect()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sentencepieces.encode_decode(documents(rows).limit(0), MODEL, with_ids=True).count() == 0
    r = sentencepieces.encode_decode(documents([(1, "hi there")]), MODEL, with_ids=True).first()
    assert r.ids == library.encode("hi there", add_bos=True, add_eos=True) and r.decoded == "hi there"


def test_other_models_are_refused():
    with pytest.raises(Exception):
        sentencepieces.PieceTable(b"")
