import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import common, words


def test_cut_tables_can_be_forgotten(spark):
    done = common.cut(spark.range(5).withColumn("text", F.lit("x")))
    assert done.count() == 5 and done.schema["text"].dataType.simpleString() == "string"
    path = done.inputFiles()[0]
    common.forget_cuts(spark)
    store, name = common.open_store(path)
    assert store.get_file_info(name).type.name == "NotFound"


def test_lowest_hashes_are_a_bounded_stable_sample(spark):
    df = spark.range(5000).select((F.col("id") % 2500).alias("k"))
    got = [r.k for r in common.lowest_hashes(df, 5000, 100, "k").collect()]
    assert len(got) == len(set(got)) == 100
    assert sorted(got) == sorted(r.k for r in common.lowest_hashes(df.repartition(7), 5000, 100, "k").collect())
    assert common.lowest_hashes(df, 5000, 9000, "k").count() == 2500
    assert common.lowest_hashes(df.limit(0), 0, 10, "k").count() == 0


def test_join_checked_is_the_join(spark):
    left, right = spark.range(50), spark.range(25, 75).withColumn("x", F.lit(1))
    for most in (3, 1000):
        assert common.join_checked(left, right, "id", "left_semi", most).count() == 25
        assert common.join_checked(left, right, "id", "left", most).count() == 50


def test_slices_are_whole_rows():
    texts = ["a" * 10, None, "b" * 50, "", "c" * 5] * 20
    batch = pa.RecordBatch.from_pydict({"n": pa.array(range(100)), "text": pa.array(texts)})
    for size, rows in ((1, 5), (30, 1000), (10**6, 7), (10**6, 10**6)):
        parts = list(common.text_slices([batch, batch.slice(0, 0)], "text", size, rows))
        assert [x for p in parts for x in p.column(1).to_pylist()] == texts
        assert all(0 < p.num_rows <= rows for p in parts)


def test_flat_text_of_slices():
    column = pa.array(["x", None, "é", "yz"]).slice(1, 3)
    flat, offsets = common.flat_text(column)
    assert flat.tobytes().decode() == "éyz" and offsets.tolist() == [0, 0, 2, 4]
    assert common.flat_text(pa.array([], pa.string()))[1].tolist() == [0]


def test_word_hashes_depend_on_the_word_alone(monkeypatch):
    text = ("Über a bc  a bc\tdef " * 30 + "q" * 300 + " a").encode()
    flat = np.frombuffer(text, np.uint8)
    starts, ends, _ = words.spans(flat, np.array([0, len(flat)]))
    found = words.span_hashes(flat, starts, ends)
    by_word = {}
    for a, b, h in zip(starts.tolist(), ends.tolist(), found.tolist()):
        assert by_word.setdefault(text[a:b], h) == h == words.one_hash(text[a:b])
    assert len(set(by_word.values())) == len(by_word)
    monkeypatch.setattr(words, "_BLOCK", 4)
    assert (words.span_hashes(flat, starts, ends) == found).all()
    assert words.equal_spans(flat, starts, ends, flat, starts, ends).all()
    same = words.equal_spans(flat, starts[:-1], ends[:-1], flat, starts[1:], ends[1:])
    assert same.tolist() == [text[a:b] == text[c:d] for a, b, c, d in zip(starts[:-1], ends[:-1], starts[1:], ends[1:])]


def test_patterned_words_have_hashes_of_their_own():
    """Words that sums of powers modulo 2**64 take for equal, and words that differ in one byte, in length or in order."""
    found = []
    for n in (512, 1024, 2048, 4096):
        one = b"a"
        while len(one) < n:
            one += one.translate(bytes.maketrans(b"ab", b"ba"))
        found += [one[:n], one[:n].translate(bytes.maketrans(b"ab", b"ba"))]
    found += [b"x" * k for k in range(1, 70)] + [b"\0" * k for k in range(1, 70)]
    found += [b"12345678" * 2, b"12345678" + b"87654321", b"87654321" + b"12345678"]
    found += [b"p" * k + b"q" + b"p" * (40 - k) for k in range(41)]
    assert len({words.one_hash(w) for w in found}) == len(set(found))


def test_documents_are_word_borders():
    flat, offsets = common.flat_text(pa.array(["ab", "cd", "", " e"]))
    a, b, by = words.spans(flat, offsets)
    assert [flat[x:y].tobytes() for x, y in zip(a, b)] == [b"ab", b"cd", b"e"] and by.tolist() == [0, 1, 2, 2, 3]


def test_free_names():
    assert common.free_name(["Leak", "leak_"], "leak") == "leak__" and common.free_name([], "leak") == "leak"


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        common.shared_dir(Session())
