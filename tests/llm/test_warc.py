import gzip
import hashlib
import random

import duckdb
import pytest

from tokenloom.llm import common, warc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        ids = [x for x in groups[h or ""] if x is not None]
        kept = max(ids) if ids and len(raw) >= 1000 and len(groups[h or ""]) > 1 else i
        revisit = i != kept
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", kept if revisit else None))
    return sorted(out, key=str)


def test_every_kind_of_page(spark, folder):
    big = "<p>é</p>" * 200
    rows = [(1, "u", big), (5, "u", big), (3, None, big), (2, "u\r\nX-Page-Id: 9", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "x" * 999), (9, "u", "x" * 999), (10, "u", "x" * 1000), (11, "u", "x" * 1000), (11, "u", "x" * 1000), (None, "u", big), (12, "u", "y" * 3_000_000), (13, "u", "\r\n\r\nHTTP/1.1 WARC/1.1\r\n\r\n" * 60)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as kept", "2 as payload_digest", "3 as n")
    got = warc.op10_warc(spark, folder(pages=df)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert warc.op10_warc(spark, folder(pages=df.limit(0))).count() == 0


def test_query_equals_sql(spark, sf_dir):
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted(map(str, warc.op10_warc(spark, sf_dir).select(columns).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({warc.ORACLE_SQL})").fetchall()
    assert got == sorted(f"Row({', '.join(f'{c}={v!r}' for c, v in zip(columns, w))})" for w in want)


@pytest.mark.parametrize("step", [1, 7, 100, 1000, 10**9])
def test_ranges_share_out_all_records(tmp_path, step):
    dice = random.Random(step)
    members, starts, raw = [], [], b""
    for i in range(12):
        body = bytes(dice.randrange(256) for _ in range(dice.randrange(900))) + warc._MAGIC + b"junk"
        block = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
        starts.append(len(raw))
        members.append(block)
        raw += gzip.compress(block, compresslevel=dice.choice([0, 6]))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(raw)
    store, name = common.open_store(str(path))
    with store.open_input_file(name) as f:
        got = [x for begin in range(0, len(raw), step) for x in warc.members(f, len(raw), begin, begin + step)]
    assert [g[0] for g in got] == starts and [g[1] for g in got] == members
    assert [warc.parse_record(g[1])[1] for g in got] == [warc.parse_record(m)[1] for m in members]


def test_archives_close_at_their_size(spark):
    dice = random.Random(1)
    rows = [(i, "u", "".join(dice.choice("abcdef0123") for _ in range(3000))) for i in range(40)]
    records = warc.plan_records(spark.createDataFrame(rows, SCHEMA)).coalesce(1)
    archives = warc.write_archives(records, common.fresh_path(spark, "warc"), archive_bytes=5000)
    assert archives.count() > 5 and archives.agg({"records": "sum"}).first()[0] == 40
    back = warc.read_archives(archives, range_bytes=700)
    assert {r.page_id: r.payload.decode() for r in back.collect()} == {i: h for i, _, h in rows}
