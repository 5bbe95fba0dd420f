"""Readers of bundles: manifests, blobs with digests, models, row maps, prompt registries. Schemas are fixed, nothing is inferred."""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import joins

MANIFEST = """
    profile string, status string, algorithm string, schema_version int, tokenizer_version int,
    native_vocabulary_size int, active_vocabulary_size int, inactive_native_slot_count int, native_blank_id int,
    original_native_vocabulary_size int, original_native_blank_id int, structural_passed boolean,
    requires_retokenized_training_labels boolean, tokenizer_sha256 string, base_tokenizer_sha256 string,
    normalizer_sha256 string, files map<string, string>
"""
ROW_MAP = "source_native_to_target_native array<int>, inactive_native_ids array<int>, source_blank_id int, target_blank_id int"
REGISTRY = "profiles map<string, struct<num_prompts: int, prompt_dictionary: map<string, int>, unused_prompt_slots: array<int>>>, source struct<num_prompts: int, prompt_dictionary: map<string, int>>"
NAMES = "bundles map<string, struct<path: string, manifest_sha256: string>>"
SELECTION = "additions array<struct<piece: string, score: double>>"
COVERAGE = "profiles map<string, struct<name: string, script: string, source_kind: string, expected_bundles: array<string>>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest below path (a file, a folder or a glob)."""
    return _json(spark, path, MANIFEST)


def bundle_path(named: dict[str, str], name_or_path: str) -> str:
    """The folder of a bundle given by name or as a path."""
    return named.get(name_or_path, name_or_path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name and sha256 of every file; contents are digested as they are read and never collected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def digest_of_lines(lines) -> str:
    """SHA-256 in hex of lines, each closed by a line feed."""
    whole = hashlib.sha256()
    for line in lines:
        whole.update(line.encode() + b"\n")
    return whole.hexdigest()


def folder_digest(spark: SparkSession, path: str) -> str:
    """One digest for all files below a folder: over their digests and paths in it, by path; markers (_*, .*) don't count.

    Files are digested where they are read; only a line for each comes to the driver (1,000,000 at most).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    inner = F.regexp_replace("path", "^.*?" + re.escape(path.rstrip("/").split("/")[-1]) + "/", "")
    rows = files.select(F.concat(F.sha2("content", 256), F.lit("  "), inner).alias("line"), inner.alias("name")).where(~F.element_at(F.split("name", "/"), -1).rlike("^[_.]"))
    return digest_of_lines(r.line for r in joins.bounded(rows.orderBy("name")))


def named_bundle(spark: SparkSession, names: str | None, bundle: str) -> tuple[str, str | None]:
    """Folder and pinned manifest digest of a bundle given by a name of the file `names`, or as a folder."""
    if names:
        entries = {r.name: r for r in _json(spark, names, NAMES).select(F.explode("bundles").alias("name", "b")).select("name", "b.path", "b.manifest_sha256").collect()}
        if bundle in entries:
            return entries[bundle].path, entries[bundle].manifest_sha256
    return bundle, None


def checked_manifest(spark: SparkSession, path: str, manifest_sha256: str | None = None) -> dict:
    """The fields of a bundle's manifest, {} without one; an error if it isn't the pinned one or a file differs from it."""
    from tokenloom.operators import checks

    found = spark.read.format("binaryFile").option("pathGlobFilter", "manifest.json").load(path).select(F.sha2("content", 256).alias("sha256")).first()
    if found is None:
        if manifest_sha256:
            raise ValueError(f"{path} has no manifest")
        return {}
    if manifest_sha256 and found.sha256 != manifest_sha256:
        raise ValueError(f"the manifest of {path} is not the pinned one")
    manifest = manifests(spark, f"{path}/manifest.json").first().asDict()
    wanted = [(k, v) for k, v in (manifest.get("files") or {}).items()]
    if wanted:
        expected = spark.createDataFrame(wanted, "name string, sha256 string")
        files = file_digests(spark, path).join(F.broadcast(expected.select("name")), "name", "left_semi")
        checks.strict(checks.digest_faults(files, expected), "files differ from the manifest")
    return manifest


def checked_content(spark: SparkSession, path: str, expected: str) -> DataFrame:
    """content of one file; an error unless its digest is the expected one."""
    files = spark.read.format("binaryFile").load(path)
    check = F.assert_true(F.sha2("content", 256) == expected, F.lit("content differs from its pinned digest"))
    return files.select("content").where(check.isNull())


def row_maps(spark: SparkSession, path: str, profile: str) -> DataFrame:
    """profile, source_id, target_id of a row map file."""
    return _json(spark, path, ROW_MAP).select(F.lit(profile).alias("profile"), F.posexplode("source_native_to_target_native").alias("source_id", "target_id"))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """profile, name, slot of every profile of a registry file, and of its source under the profile 'source'."""
    registry = _json(spark, path, REGISTRY)
    entries = registry.select(F.explode("profiles").alias("profile", "p")).select("profile", F.explode("p.prompt_dictionary").alias("name", "slot"))
    return entries.unionByName(registry.select(F.lit("source").alias("profile"), F.explode("source.prompt_dictionary").alias("name", "slot")))


def selections(spark: SparkSession, path: str) -> DataFrame:
    """ord, piece, score of approved additions."""
    return _json(spark, path, SELECTION).select(F.posexplode("additions").alias("ord", "a")).select("ord", "a.piece", "a.score")


def coverage_policy(spark: SparkSession, path: str) -> DataFrame:
    """lang, name, script, source_kind, bundle: which bundles each language is expected in."""
    rows = _json(spark, path, COVERAGE).select(F.explode("profiles").alias("lang", "p"))
    return rows.select("lang", "p.name", "p.script", "p.source_kind", F.explode("p.expected_bundles").alias("bundle"))


# -- models ---------------------------------------------------------------
def _fields(raw: bytes):
    """(number, value) of every field of a protobuf message; fixed-size values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return out
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, raw[at : at + size]
        at += size


def model_pieces(raw: bytes) -> list[tuple[int, str, float, int]]:
    """(id, piece, score, type) of a serialised SentencePiece model."""
    out = []
    for number, value in _fields(raw):
        if number != 1:
            continue
        piece = dict(_fields(value))
        score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
        out.append((len(out), piece.get(1, b"").decode("utf-8"), score, piece.get(3, 1)))
    return out


def model_rest(raw: bytes) -> bytes:
    """All of a serialised model but its pieces, field by field: normaliser, trainer and other metadata."""
    return b"".join(b"%d:%d:" % (n, len(v) if isinstance(v, bytes) else -1) + (v if isinstance(v, bytes) else b"%d;" % v) for n, v in _fields(raw) if n != 1)


def model_metadata(spark: SparkSession, path: str) -> DataFrame:
    """name and sha256 of what each model file below path holds besides its pieces; checks.digest_faults compares two of them."""

    def work(batches):
        for batch in batches:
            rest = [hashlib.sha256(model_rest(c)).hexdigest() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rest, pa.string())], names=["name", "sha256"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInArrow(work, "name string, sha256 string")


def models(spark: SparkSession, path: str) -> DataFrame:
    """name, id, piece, score, type of every model file below path."""

    def work(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = model_pieces(content)
                columns = list(zip(*rows)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_pydict(
                    {"name": pa.array([name] * len(rows), pa.string()), "id": pa.array(columns[0], pa.int32()), "piece": pa.array(columns[1], pa.string()), "score": pa.array(columns[2], pa.float64()), "type": pa.array(columns[3], pa.int32())}
                )

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInArrow(work, "name string, id int, piece string, score double, type int")
