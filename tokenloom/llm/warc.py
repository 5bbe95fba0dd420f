"""WARC archives: a writer with revisits and a splittable reader (operator 10).

Every record is one gzip member. A reading task owns the records whose members
start inside its byte range: it looks for the gzip magic from its first byte
on, takes a candidate only if decoding it gives a WARC header, and then goes
from member to member until one starts past the range. Each task keeps one
record in memory.

A null payload is empty, a null id is kept as null, and repeated rows each get a
record. Among records with equal payloads of at least REVISIT_BYTES bytes
those with the largest id are responses and the others revisits (rows that
repeat the largest id are all responses). An empty table gives no archive and
no row; other columns are ignored. A payload that itself holds bytes of WARC
members (which compression keeps in plain sight where it can't shrink them)
could be taken for records when a range begins inside it; html as text can't
hold such bytes.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common

REVISIT_BYTES = 1000
#: An archive is closed from this size on.
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
_MAGIC = b"\x1f\x8b\x08"
_STEP = 1 << 20
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to of each row."""
    rows = common.renamed(pages, page_id=id_col, url=url_col, html=payload_col)
    body = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = rows.withColumns({"payload_bytes": F.octet_length(body).cast("long"), "payload_digest": F.sha1(body)})
    large = rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
    copied = large.groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("kept")).where("n > 1 and kept is not null").select("payload_digest", "kept")
    joined = common.join_checked(rows, common.cut(copied), "payload_digest", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept")).alias("refers_to"))


def _record(row: dict) -> bytes:
    payload = (row["html"] or "").encode("utf-8")
    name = "" if row["page_id"] is None else str(row["page_id"])
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join((row["url"] or "").split("\n")).replace("\r", ""),
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Page-Id: {name}",
    ]
    if row["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {row['refers_to']}", f"X-Payload-Length: {row['payload_bytes']}"]
        block = b""
    else:
        block = _HTTP.format(len(payload)).encode() + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned records to *.warc.gz below folder; the archives as (path, bytes, records).

    A task that runs again writes archives of new names, and only those of the
    attempt that succeeded are in the result.
    """

    def work(batches):
        store, base = common.open_store(folder)
        store.create_dir(base, recursive=True)
        out, path, size, n = None, "", 0, 0
        done = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                if out is None:
                    path, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = packer.compress(_record(row)) + packer.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), "bytes": pa.array([d[1] for d in done], pa.int64()), "records": pa.array([d[2] for d in done], pa.int64())})

    return common.cut(records.transform(common.batches, work, "path string, bytes bigint, records bigint"))


def _inflate(file, at: int, size: int, most: int | None = None) -> tuple[bytes, int] | None:
    """The member that starts at a position and the position after it; with `most`, only its first bytes."""
    unzip = zlib.decompressobj(31)
    out = []
    try:
        while not unzip.eof:
            step = min(_STEP if most is None else 4096, size - at)
            raw = file.read_at(step, at) if step > 0 else b""
            if not raw:
                return None
            out.append(unzip.decompress(raw) if most is None else unzip.decompress(raw, most))
            at += len(raw)
            if most is not None and sum(map(len, out)) >= most:
                return b"".join(out)[:most], at
    except zlib.error:
        return None
    return b"".join(out), at - len(unzip.unused_data)


def members(file, size: int, begin: int, end: int):
    """(start, content) of every record whose member starts in [begin, end)."""
    at, chained = begin, begin == 0
    while at < min(end, size):
        if not chained:
            raw = file.read_at(min(_STEP, size - at), at)
            hit = raw.find(_MAGIC)
            if hit < 0:
                at += max(1, len(raw) - len(_MAGIC) + 1)
                continue
            at += hit
            if at >= end:
                return
            probe = _inflate(file, at, size, 7)
            if probe is None or not probe[0].startswith(b"WARC/1."):
                at += 1
                continue
        got = _inflate(file, at, size)
        if got is None or not got[0].startswith(b"WARC/1."):
            at, chained = at + 1, False
            continue
        yield at, got[0]
        at, chained = got[1], True


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload: the HTTP body of a response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of archives (path, bytes), each byte range a row that any task can take.

    Columns: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.
    """
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("begin"))

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, path = common.open_store(row["path"])
                with store.open_input_file(path) as file:
                    rows, held = [], 0
                    for _, raw in members(file, row["bytes"], row["begin"], row["begin"] + range_bytes):
                        f, payload = parse_record(raw)
                        revisit = f["warc-type"] == "revisit"
                        rows.append(
                            {
                                "page_id": int(f["x-page-id"]) if f.get("x-page-id") else None,
                                "url": f["warc-target-uri"],
                                "record_type": f["warc-type"],
                                "refers_to": int(f["x-refers-to-page"]) if revisit else None,
                                "payload_bytes": int(f["x-payload-length"]) if revisit else len(payload),
                                "payload_digest": f["warc-payload-digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
                                "payload": None if revisit else payload,
                            }
                        )
                        held += len(payload)
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _READ)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    spread = ranges.repartition(max(8, archives.sparkSession.sparkContext.defaultParallelism))
    return spread.transform(common.batches, work, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record per page, read the archives back and tell what each record holds."""
    planned = plan_records(common.table(spark, sf_dir, "pages"))
    place = common.fresh_path(spark, "warc")
    archives = write_archives(planned, place)
    common.leave_at_exit(spark, place)
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Digest and length come from the pages, the largest id of equal payloads from a window.
ORACLE_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN kept END AS refers_to
FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept
      FROM pages)
"""
