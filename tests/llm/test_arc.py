"""ARC to WARC: headers of both versions, declared lengths, digests and revisits, by round trips and brute force."""

import base64
import hashlib
import io
import re
import uuid
import zlib

import duckdb
import pytest
from tidewave.llm import arc

SCHEMA = "page_id long, url string, html string, archive string, offset long, id string, refers string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "i", "r") for r in rows], SCHEMA)


def brute(rows):
    """rows (page_id, html), without repeated page_ids."""
    payloads = [(p, (h or "").encode()) for p, h in rows]
    out = set()
    for page, data in payloads:
        same = [p for p, d in payloads if d == data]
        first = min(same, key=lambda p: (p is None, p or 0))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.add((page, len(data), digest, "response" if page == first else "revisit", None if page == first else first))
    return out


def found(df):
    rows = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ROWS = [
    (5, "http://a.example/x y?é=1", "<p>same</p>"), (3, "http://b.example/", "<p>same</p>"), (9, None, "<p>same</p>"), (2, "http://c.example/", None), (7, "", ""),
    (8, "http://d.example/", "é\r\n\r\nWARC/1.0\r\n\nfiledesc://x 0 1 2 3\n" * 3), (10, "http://e.example/", "x" * 3_000_000), (11, "http://e.example/", "x" * 3_000_000), (12, "http://f.example/", "\n\n\n"), (None, "http://g.example/", "alone"),
]


def test_against_brute_force(spark):
    assert found(arc.convert_pages(table(spark, ROWS))) == brute([(p, h) for p, _, h in ROWS])


def test_small_archives(spark, monkeypatch):
    """Many archives, so that revisits name responses of others."""
    monkeypatch.setattr(arc, "ARCHIVE_BYTES", 1)
    rows = [(k, f"http://h.example/{k}", f"page {k % 7} " * (k % 5)) for k in range(60)]
    files = arc.write_arcs(table(spark, rows))
    assert files.count() > 5
    assert found(arc.convert_pages(table(spark, rows))) == brute([(p, h) for p, _, h in rows])


def test_of_the_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = brute([(r.page_id, r.html) for r in pages.collect()])
    assert found(arc.convert_pages(pages)) == want
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    assert {tuple(r) for r in con.execute(arc.oracle()).fetchall()} == want


def test_repeated_rows(spark):
    got = sorted(tuple(r)[3:] for r in arc.convert_pages(table(spark, [(4, "u", "x")] * 3 + [(6, "u", "x")])).collect())
    assert got == [("response", None), ("revisit", 4), ("revisit", 4), ("revisit", 4)]


def test_least_bytes(spark):
    rows = [(k, "u", "ab" if k < 3 else "abcdef") for k in range(6)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in arc.convert_pages(table(spark, rows), least_bytes=3).collect()}
    assert got == {0: ("response", None), 1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3), 5: ("revisit", 3)}


def test_empty_table(spark):
    assert arc.convert_pages(table(spark, [])).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_records_by_declared_lengths(version):
    blocks = [b"", b"\n\n", b"HTTP/1.0 200 OK\r\n\r\nhttp://x 0.0.0.0 19990101000000 text/html 3\nabc\n", "é".encode() * 1000]
    data = arc.arc_head("n.arc", version, "19990101000000") + b"".join(arc.arc_record(f"http://x.example/{k}", "1.2.3.4", "199901020304", "text/html; charset=x", version, "n.arc", b) for k, b in enumerate(blocks))
    head, *records = arc.read_arc(io.BytesIO(data))
    assert head.url == "filedesc://n.arc" and head.version == version
    assert [(r.url, r.ip, r.date, r.type, r.block) for r in records] == [(f"http://x.example/{k}", "1.2.3.4", "199901020304", "text/html; charset=x", b) for k, b in enumerate(blocks)]
    assert all(data[r.offset :].startswith(r.url.encode()) for r in records)
    for cut in (1, 500, 1999):
        with pytest.raises(ValueError):
            list(arc.read_arc(io.BytesIO(data[: -1 - cut])))
    with pytest.raises(ValueError):
        list(arc.read_arc(io.BytesIO(data.replace(b"URL IP-address", b"URL address"))))


def test_warc_records():
    kinds = [("http://x.example/", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"), ("dns:x.example", b"x.example. 60 IN A 1.2.3.4"), ("ftp://x.example/a", b"data")]
    records = [arc.Record(k, 1, url, "1.2.3.4", "19970203040506", "text/plain", block) for k, (url, block) in enumerate(kinds)]
    refers = {"id": "<urn:uuid:1>", "url": "http://y.example/", "date": "1996-01-01T00:00:00Z"}
    data = b"".join(arc.warc_record(r, "n.arc.gz") for r in records) + arc.warc_record(records[0], "n.arc.gz", refers)
    got = list(arc.read_warc(io.BytesIO(data)))
    assert [(f["warc-type"], f["content-type"], b) for f, b in got] == [
        ("response", "application/http;msgtype=response", kinds[0][1]),
        ("response", "text/dns", kinds[1][1]),
        ("resource", "text/plain", b"data"),
        ("revisit", "application/http;msgtype=response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"),
    ]
    first = got[0][0]
    assert first["warc-date"] == "1997-02-03T04:05:06Z" and first["warc-ip-address"] == "1.2.3.4"
    assert first["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    assert uuid.UUID(re.search("uuid:(.*)>", first["warc-record-id"])[1]).version == 5
    assert len({f["warc-record-id"] for f, _ in got[:3]}) == 3
    assert (got[3][0]["warc-refers-to"], got[3][0]["warc-profile"]) == ("<urn:uuid:1>", arc.PROFILE)
    with pytest.raises(ValueError):
        list(arc.read_warc(io.BytesIO(data.replace(b"body", b"bady"))))


def test_dates():
    assert [arc.warc_date(d) for d in ("20010203040506", "200102030405", "20010203")] == ["2001-02-03T04:05:06Z", "2001-02-03T04:05:00Z", "2001-02-03T00:00:00Z"]


def test_members_and_versions_on_disk(spark):
    """Each record is a gzip member, and both versions are written."""
    files = [r.archive for r in arc.write_arcs(table(spark, ROWS)).collect()]
    versions = set()
    for uri in files:
        raw = open(uri.removeprefix("file://"), "rb").read()
        with arc.open_archive(uri) as f:
            records = list(arc.read_arc(f, uri))
        versions.add(records[0].version)
        members = 0
        while raw:
            member = zlib.decompressobj(31)
            assert member.decompress(raw).startswith(b"filedesc://" if not members else records[members].url.encode())
            raw, members = member.unused_data, members + 1
        assert members == len(records)
    assert versions == {1, 2}
