"""From legacy ARC archives to WARC.

An ARC file begins with a version block, which says how the header lines of its
records read: five fields in version 1, ten in version 2, the last the length
of what follows. The converter reads records by these lengths and writes for
each a WARC record: an identifier made of the archive's name and the record's
place (the same in every run over the same archive), the time in ISO form, the
type by what the record holds, and digests of block and payload. Of equal
payloads one record is the response, the others are revisits, which hold the
HTTP head alone and name the response.

A file is written by one task and listed in a table that Spark commits, so
leftovers of lost tasks are never read. Records are read first for digests,
which find the revisits, then again to be written, so payloads are never
shuffled: what meets an archive is its list of verdicts, which its size bounds.
Every record is a gzip member of its own. Paths are URIs of any store that
pyarrow.fs opens.

Null html: an empty payload. Null page_id: stays null, and is a response only
where all equal payloads have none. Null url: "-"; white space in one is
escaped, as fields end at spaces. Repeated rows: the first stored is the
response, the others revisit it. A very long page is held whole by one task.
Empty table: no archives, no rows. Other columns, whatever their names, are not
stored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, shared_dir

ARCHIVE_BYTES = 16 << 20
BATCH_ROWS = 1000
FIRST_DATE = datetime(1996, 1, 1, tzinfo=UTC)
# fixed values: field lists of the two versions of ARC, and the revisit profile of WARC
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {
    1: re.compile(rb"(?P<url>.+?) (?P<ip>\S+) (?P<date>\d{8,14}) (?P<type>.+) (?P<length>\d+)$"),
    2: re.compile(rb"(?P<url>.+?) (?P<ip>\S+) (?P<date>\d{8,14}) (?P<type>.+) (?P<code>\d{3}|-) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>\d+|-) (?P<file>\S+) (?P<length>\d+)$"),
}


@dataclass
class Record:
    """A record of an ARC file, at a place of its unpacked bytes."""

    offset: int
    version: int
    url: str
    ip: str
    date: str
    type: str
    block: bytes


def arc_head(name: str, version: int, date: str) -> bytes:
    """The version block."""
    origin = f"{version} 0 tidewave\n{FIELDS[version]}\n\n".encode()
    return _arc_line(f"filedesc://{name}", "0.0.0.0", date, "text/plain", version, "200", name, len(origin)) + origin + b"\n"


def _arc_line(url: str, ip: str, date: str, kind: str, version: int, code: str, name: str, length: int) -> bytes:
    more = f" {code} - - 0 {name}" if version == 2 else ""
    return f"{url} {ip} {date} {kind}{more} {length}\n".encode()


def arc_record(url: str, ip: str, date: str, kind: str, version: int, name: str, block: bytes) -> bytes:
    return _arc_line(url, ip, date, kind, version, "200", name, len(block)) + block + b"\n"


def read_arc(f: io.BufferedIOBase, what: str = "archive") -> Iterator[Record]:
    """The records of an unpacked ARC stream, the version block first; header lines are read as its version says."""
    version, at = 0, 0
    while line := f.readline():
        if not line.strip():  # what sets records apart
            at += len(line)
            continue
        text = line.rstrip(b"\r\n")
        # the length ends the line in either version; the first block says which it is
        m = (HEADERS[version] if version else re.compile(rb"(?P<url>filedesc://\S+) (?P<ip>\S+) (?P<date>\d{8,14}) (?P<type>\S+)(?: .*)? (?P<length>\d+)$")).match(text)
        if not m:
            raise ValueError(f"{what}: no header line at {at}: {text[:200]!r}")
        block = f.read(int(m["length"]))
        if len(block) != int(m["length"]):
            raise ValueError(f"{what}: the record at {at} ends before its declared length")
        if not version:
            version = int(block.split(b" ", 1)[0])
            if version not in HEADERS or block.split(b"\n")[1].rstrip(b"\r").decode() != FIELDS[version]:
                raise ValueError(f"{what}: a version block of another kind")
        yield Record(at, version, *(m[k].decode("utf-8", "replace") for k in ("url", "ip", "date", "type")), block)
        at += len(line) + len(block)


def warc_date(date: str) -> str:
    """Digits of year to second, of which the last may lack, in ISO form."""
    full = date[:14] + "00000101000000"[len(date[:14]) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:]}Z"


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """(head with its empty line, payload) of an HTTP response; None for other blocks."""
    if not block.startswith(b"HTTP/"):
        return None
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def http_header(head: bytes, name: str) -> str | None:
    m = re.search(rf"(?im)^{re.escape(name)}:[ \t]*(.*?)\r?$".encode(), head)
    return m[1].decode("latin-1") if m else None


def warc_type(record: Record) -> tuple[str, str]:
    """(WARC-Type, Content-Type) of a record that is no revisit."""
    if record.url.startswith("filedesc://"):
        return "warcinfo", "application/warc-fields"
    if record.block.startswith(b"HTTP/"):
        return "response", "application/http;msgtype=response"
    return ("response", "text/dns") if record.url.startswith("dns:") else ("resource", record.type)


def warc_record(record: Record, archive: str, refers: dict | None = None) -> bytes:
    """refers: id, url and date of the response that this record's payload repeats."""
    kind, content = warc_type(record)
    block, http = record.block, split_http(record.block)
    fields = [("WARC-Type", "revisit" if refers else kind), ("WARC-Record-ID", record_id(archive, record.offset)), ("WARC-Date", warc_date(record.date))]
    if kind == "warcinfo":
        block = f"format: WARC File Format 1.1\r\nisPartOf: {archive}\r\ndescription: from ARC version {record.version}\r\n".encode()
        fields.append(("WARC-Filename", archive))
    else:
        fields.append(("WARC-Target-URI", record.url))
        if record.ip != "0.0.0.0":
            fields.append(("WARC-IP-Address", record.ip))
        fields.append(("WARC-Payload-Digest", "sha1:" + sha1_base32(http[1] if http else block)))
    if refers:
        block = http[0] if http else b""
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers["id"]), ("WARC-Refers-To-Target-URI", refers["url"]), ("WARC-Refers-To-Date", refers["date"])]
    fields += [("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("Content-Type", content), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(f: io.BufferedIOBase, what: str = "archive") -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of the records of an unpacked WARC stream."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{what}: no record begins with {line[:100]!r}")
        fields = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.lower()] = value.strip()
        block = f.read(length := int(fields["content-length"]))
        if len(block) != length or "sha1:" + sha1_base32(block) != fields.get("warc-block-digest", "sha1:" + sha1_base32(block)):
            raise ValueError(f"{what}: a damaged record {fields.get('warc-record-id')}")
        yield fields, block


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def open_archive(uri: str) -> io.BufferedIOBase:
    """An archive's unpacked bytes as a stream."""
    system, path = _store(uri)
    raw = io.BufferedReader(system.open_input_stream(path, compression=None), 1 << 20)
    return gzip.GzipFile(fileobj=raw) if uri.endswith(".gz") else raw


class _Files:
    """Files of about ARCHIVE_BYTES below a folder, each member packed by itself; written holds uri, bytes and records of each."""

    def __init__(self, folder: str, ending: str, head: Callable[[str], bytes]):
        self.folder, self.ending, self.head = folder, ending, head
        self.written: list[tuple[str, int, int]] = []
        self.out, self.name = None, ""

    def open(self) -> str:
        """The name of the file that takes the next record."""
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}{self.ending}"
            system, path = _store(self.folder)
            system.create_dir(path, recursive=True)
            self.out, self.size, self.records = system.open_output_stream(f"{path}/{self.name}", compression=None), 0, 0
            self._put(self.head(self.name))
        return self.name

    def _put(self, data: bytes) -> None:
        if data:
            packed = gzip.compress(data, 4, mtime=0)
            self.out.write(packed)
            self.size += len(packed)

    def add(self, data: bytes) -> None:
        self.open()
        self._put(data)
        self.records += 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.written.append((f"{self.folder}/{self.name}", self.size, self.records))
            self.out = None

    def batch(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays([pa.array([w[k] for w in self.written], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "bytes", "records"])


ARCHIVES = "archive string, bytes long, records long"


def _folder(df: DataFrame, name: str) -> str:
    path = shared_dir(df.sparkSession, name)
    return path if "://" in path else f"file://{path}"


def _spread(archives: DataFrame) -> DataFrame:
    """One archive, or a few, for each task: rows are small, what they name is not."""
    n = archives.count()
    return archives.repartition(max(1, min(n, 100_000)))


def write_arcs(pages: DataFrame) -> DataFrame:
    """archive, bytes, records of the ARC files of pages, half the pages in version 1, half in version 2."""
    folder = _folder(pages, "arc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = {v: _Files(folder, ".arc.gz", lambda name, v=v: arc_head(name, v, FIRST_DATE.strftime("%Y%m%d%H%M%S"))) for v in FIELDS}
        for batch in batches:
            for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'-' if page is None else page}\r\n\r\n".encode()
                version = 1 + (page or 0) % 2
                date = (FIRST_DATE + timedelta(seconds=(page or 0) % 1_000_000_000)).strftime("%Y%m%d%H%M%S")
                name = files[version].open()
                files[version].add(arc_record(quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "-", "0.0.0.0", date, "text/html", version, name, head + payload))
        for f in files.values():
            yield f.batch()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return materialise(rows.mapInArrow(run, ARCHIVES), "arcs")


INDEX = "archive string, offset long, page_id long, id string, url string, date string, size long, digest string"


def index_arcs(archives: DataFrame) -> DataFrame:
    """Where each record of ARC files with an HTTP payload lies, and the payload's size and digest."""
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for b in batches for u in b.column("archive").to_pylist()):
            rows, name = [], uri.rsplit("/", 1)[-1]
            with open_archive(uri) as f:
                for r in read_arc(f, uri):
                    if http := split_http(r.block):
                        page = http_header(http[0], "X-Page-Id")
                        rows.append((uri, r.offset, int(page) if page and page != "-" else None, record_id(name, r.offset), r.url, warc_date(r.date), len(http[1]), sha1_base32(http[1])))
                    if len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return materialise(_spread(archives.select("archive")).mapInArrow(run, INDEX), "arc-index")


def find_revisits(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """archive, offset, refers (id, url, date) of the records whose payload, of so many bytes at least, another record holds as the response."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "offset")
    groups = index.filter(F.col("size") >= least_bytes).groupBy("size", "digest").agg(F.count("*").alias("n"), F.min_by(F.struct("id", "url", "date"), order).alias("refers")).filter("n > 1")
    return index.join(groups, ["size", "digest"]).filter(F.col("id") != F.col("refers.id")).select("archive", "offset", "refers")


def convert_arcs(archives: DataFrame, least_bytes: int = 0) -> DataFrame:
    """archive, bytes, records of the WARC files of ARC files (archive: their URIs)."""
    folder = _folder(archives, "warc")
    revisits = find_revisits(index_arcs(archives), least_bytes)
    of = revisits.groupBy("archive").agg(F.collect_list(F.struct("offset", "refers")).alias("revisits"))
    work = materialise(archives.select("archive").join(of, "archive", "left"), "arc-revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, some in zip(batch.column("archive").to_pylist(), batch.column("revisits").to_pylist(), strict=True):
                name, refers = uri.rsplit("/", 1)[-1], {x["offset"]: x["refers"] for x in some or []}
                files = _Files(folder, ".warc.gz", lambda _: b"")
                with open_archive(uri) as f:
                    for r in read_arc(f, uri):
                        files.add(warc_record(r, name, refers.get(r.offset)))
                yield files.batch()

    return materialise(_spread(work).mapInArrow(run, ARCHIVES), "warcs")


RECORDS = "id string, type string, page_id long, payload_bytes long, payload_digest string, refers string"


def read_warcs(archives: DataFrame) -> DataFrame:
    """id, type, page_id, payload_bytes, payload_digest and refers (an id) of the records of WARC files with an HTTP payload.

    Size and digest of a revisit are those that it states; those of a response
    are measured, and its statement must agree.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for b in batches for u in b.column("archive").to_pylist()):
            rows = []
            with open_archive(uri) as f:
                for fields, block in read_warc(f, uri):
                    if not (http := split_http(block)):
                        continue
                    page, stated = http_header(http[0], "X-Page-Id"), fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "revisit":
                        size, digest = int(http_header(http[0], "Content-Length")), stated
                    else:
                        size, digest = len(http[1]), sha1_base32(http[1])
                        if digest != stated:
                            raise ValueError(f"{uri}: the payload of {fields['warc-record-id']} is damaged")
                    rows.append((fields["warc-record-id"], fields["warc-type"], int(page) if page and page != "-" else None, size, digest, fields.get("warc-refers-to")))
                    if len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _spread(archives.select("archive")).mapInArrow(run, RECORDS)


def convert_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages to ARC files, converts these to WARC and reads the WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    records = materialise(read_warcs(convert_arcs(write_arcs(pages), least_bytes)), "warc-records")
    responses = records.filter("type = 'response'").select(F.col("id").alias("refers"), F.col("page_id").alias("refers_to"))
    return records.join(responses, "refers", "left").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def oracle(least_bytes: int = 0) -> str:
    """convert_pages in DuckDB SQL."""
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, array_to_string(list_transform(str_split(hex, ''), lambda x: right(bin(strpos('0123456789abcdef', x) + 15), 4)), '') AS b FROM p),
d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_sum(list_transform(range(5), lambda k: substr(b, 5 * i + k + 1, 1)::INTEGER << (4 - k)::INTEGER))::INTEGER + 1, 1)), '') AS payload_digest
  FROM bits),
f AS (SELECT *, CASE WHEN payload_bytes >= {least_bytes} THEN min(page_id) OVER (PARTITION BY payload_bytes, payload_digest) ELSE page_id END AS response FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to FROM f
"""
