"""Readers and writers, the command line, streams."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from tokenloom.__main__ import main
from tokenloom.operators import checks
from tokenloom.operators.segment import Lexicon
from tokenloom.sources import readers, writers
from tokenloom.streaming import tokens as stream

SCHEMA = "id int, piece string, score double, type int"


def serialised(pieces):
    out = b""
    for piece, score, kind in pieces:
        raw = piece.encode()
        body = b"\x0a" + bytes([len(raw)]) + raw + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        out += b"\x0a" + bytes([len(body)]) + body
    return out + b"\x12\x02\x18\x01"


def test_models_and_digests(spark, tmp_path):
    raw = serialised([("<unk>", 0.0, 2), ("▁ab", -1.5, 1)])
    (tmp_path / "x.model").write_bytes(raw)
    got = [tuple(r) for r in readers.models(spark, str(tmp_path)).orderBy("id").collect()]
    assert got == [("x.model", 0, "<unk>", 0.0, 2), ("x.model", 1, "▁ab", -1.5, 1)]
    files = readers.file_digests(spark, str(tmp_path))
    assert [tuple(r) for r in files.collect()] == [("x.model", hashlib.sha256(raw).hexdigest())]
    want = spark.createDataFrame([("x.model", "0"), ("y", "1")], "name string, sha256 string")
    assert {tuple(r) for r in checks.digest_faults(files, want).collect()} == {("x.model", "digest"), ("y", "missing")}
    assert readers.checked_content(spark, str(tmp_path / "x.model"), hashlib.sha256(raw).hexdigest()).count() == 1
    with pytest.raises(Exception, match="pinned digest"):
        readers.checked_content(spark, str(tmp_path / "x.model"), "0").collect()


def test_public_model(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = readers.models(spark, path).orderBy("id").collect()
    assert [r.piece for r in rows] == [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    assert rows[500].score == sp.get_score(500)


def test_json_readers(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"source_native_to_target_native": [0, 1, 4], "inactive_native_ids": [1], "source_blank_id": 2, "target_blank_id": 4}))
    assert [tuple(r) for r in readers.row_maps(spark, str(tmp_path / "map.json"), "p").collect()] == [("p", 0, 0), ("p", 1, 1), ("p", 2, 4)]
    (tmp_path / "reg.json").write_text(json.dumps({"profiles": {"full": {"num_prompts": 128, "prompt_dictionary": {"en": 0, "hi": 6}}}, "source": {"num_prompts": 128, "prompt_dictionary": {"en": 0}}}, indent=1))
    assert {tuple(r) for r in readers.prompts(spark, str(tmp_path / "reg.json")).collect()} == {("full", "en", 0), ("full", "hi", 6), ("source", "en", 0)}
    (tmp_path / "man.json").write_text(json.dumps({"profile": "full", "native_vocabulary_size": 9, "files": {"a": "b"}}))
    assert readers.manifests(spark, str(tmp_path / "man.json")).first().files == {"a": "b"}
    (tmp_path / "sel.json").write_text(json.dumps({"additions": [{"piece": "x", "score": -1.0}, {"piece": "y", "score": -2.0}]}))
    assert [tuple(r) for r in readers.selections(spark, str(tmp_path / "sel.json")).collect()] == [(0, "x", -1.0), (1, "y", -2.0)]
    (tmp_path / "cov.json").write_text(json.dumps({"profiles": {"ar": {"name": "Arabic", "source_kind": "k", "expected_bundles": ["a", "b"]}}}))
    assert readers.coverage_policy(spark, str(tmp_path / "cov.json")).count() == 2
    assert readers.bundle_path({"full": "/x"}, "full") == "/x" and readers.bundle_path({}, "/y") == "/y"


def test_writers_do_not_replace(spark, tmp_path):
    pieces = spark.createDataFrame([(1, "b", 0.0, 1), (0, "a", 0.0, 1)], SCHEMA)
    writers.vocabulary_text(pieces, str(tmp_path / "v"))
    assert [r.value for r in spark.read.text(str(tmp_path / "v")).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="already exists"):
        writers.vocabulary_text(pieces, str(tmp_path / "v"))
    assert json.loads(writers.report_text(pieces.where("id = 1")).first().report)["piece"] == "b"


def test_command_line(spark, tmp_path, capsys):
    base = spark.createDataFrame([(0, "<unk>", 0.0, 2), (1, "a", -1.0, 1), (2, "b", -2.0, 1)], SCHEMA)
    pieces = base.unionByName(spark.createDataFrame([(3, "ab", -3.0, 1), (4, "z", -3.0, 1)], SCHEMA)).withColumns({"profile": F.lit("full"), "is_active": F.lit(True), "blank_id": F.lit(5)})
    row_map = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 5)], "source_id int, target_id int")
    for name, df in (("base", base), ("pieces", pieces), ("row_map", row_map)):
        df.write.parquet(str(tmp_path / "bundle" / name))
    rows = [("emb", i, [float(i), 1.0]) for i in range(4)] + [("bias", i, [float(i)]) for i in range(4)] + [("enc", 7, [3.0])]
    spark.createDataFrame(rows, "key string, row_id int, vec array<float>").write.parquet(str(tmp_path / "source" / "params"))
    assert main(["check", "--bundle", str(tmp_path / "bundle")]) == 0
    assert json.loads(capsys.readouterr().out)["native_vocabulary_size"] == 5
    source = str(tmp_path / "source")
    move = ["migrate", "--source", source, "--bundle", str(tmp_path / "bundle"), "--output", str(tmp_path / "out"), "--vocabulary-key", "emb", "--vocabulary-key", "bias", "--bias-key", "bias"]
    with pytest.raises(SystemExit):
        main(move)
    capsys.readouterr()
    assert main([*move, "--source-sha256", "0" * 64]) == 1
    digest = readers.folder_digest(spark, source)
    assert digest in capsys.readouterr().err and not (tmp_path / "out").exists()
    assert main([*move, "--source-sha256", digest]) == 0
    assert json.loads(capsys.readouterr().out)["left_out"] == []
    got = {(r.key, r.row_id): r.vec for r in spark.read.parquet(str(tmp_path / "out" / "params")).collect()}
    assert got[("emb", 5)] == [3.0, 1.0] and got[("emb", 3)] == [1.5, 1.0] and got[("enc", 7)] == [3.0]
    assert got[("bias", 3)][0] < 1.5 and len(got) == 13
    assert main([*move, "--source-sha256", digest]) == 1
    assert "exists" in capsys.readouterr().err
    spark.createDataFrame([("emb", 9, [0.0])], "key string, row_id int, vec array<float>").write.mode("append").parquet(f"{source}/params")
    assert readers.folder_digest(spark, source) != digest


def test_bundles_by_name_with_pinned_manifests(spark, tmp_path, capsys):
    base = spark.createDataFrame([(0, "<unk>", 0.0, 2), (1, "a", -1.0, 1)], SCHEMA)
    pieces = base.withColumns({"profile": F.lit("original"), "is_active": F.lit(True), "blank_id": F.lit(2)})
    for name, df in (("base", base), ("pieces", pieces), ("row_map", spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "source_id int, target_id int"))):
        df.write.parquet(str(tmp_path / "b" / name))
    (tmp_path / "b" / "note.txt").write_text("kept")
    manifest = tmp_path / "b" / "manifest.json"
    manifest.write_text(json.dumps({"profile": "original", "active_vocabulary_size": 2, "files": {"note.txt": hashlib.sha256(b"kept").hexdigest()}}))
    names = tmp_path / "names.json"

    def pinned(digest):
        names.write_text(json.dumps({"bundles": {"mine": {"path": str(tmp_path / "b"), "manifest_sha256": digest}}}))
        return main(["check", "--bundle", "mine", "--names", str(names)])

    right = hashlib.sha256(manifest.read_bytes()).hexdigest()
    assert pinned(right) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["profile"] == "original" and out["native_blank_id"] == 2 and len(out["tokenizer_sha256"]) == 64
    assert pinned("0" * 64) == 1 and "pinned" in capsys.readouterr().err
    (tmp_path / "b" / "note.txt").write_text("changed")
    assert pinned(right) == 1 and "note.txt" in capsys.readouterr().err
    assert main(["check", "--bundle", "elsewhere"]) == 1
    with pytest.raises(SystemExit) as stop:
        main(["build"])
    assert stop.value.code == 2


def test_model_metadata_without_pieces(spark, tmp_path):
    import public_tokenizers

    raw = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    (tmp_path / "one.model").write_bytes(raw)
    (tmp_path / "two.model").write_bytes(raw + bytes([0x0A, 0x03, 0x0A, 0x01, 0x7A]))  # one more piece
    (tmp_path / "three.model").write_bytes(raw + bytes([0x7A, 0x01, 0x7A]))  # one more other field
    found = {r.name: r.sha256 for r in readers.model_metadata(spark, str(tmp_path)).collect()}
    assert found["one.model"] == found["two.model"] != found["three.model"]


def test_streams_equal_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ab a"), (2, None), (3, "b")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    lexicons = {"x": Lexicon.from_rows([("▁", -1.0, 1), ("a", -1.0, 2), ("b", -1.0, 3)])}
    source = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    stream.write_tokens(stream.token_stream(source, lexicons), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert {r.doc_id: r.ids for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: [1, 2, 3, 1, 2], 2: [], 3: [1, 3]}
