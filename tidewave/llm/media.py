"""Media columns: a data source over folders of archives.

Written, each task packs members into ZIP archives of bounded size; a commit
writes the list of the archives of the tasks that succeeded, so leftovers of
lost tasks are never read (they stay until someone deletes them). Read,
archives are cut into byte ranges; a partition has a range of a large archive
or several small ones, more of them the larger the input. It reads an
archive's directory, takes the members that begin in its range, reads these as
one stream in stretches of bounded size, a stretch being an Arrow batch, and
cuts members out by their offsets. A member that is not there whole is read
again by itself, and a directory likewise. Paths are URIs of any store that
pyarrow.fs opens.

Members here are PNG images, 8-bit grey, 64 samples a row, with the number of
bytes that are not padding in a text chunk; equal payloads are equal members.

Null text: as empty, one row of zeros. Null doc_id: stays null. Repeated rows
and ties: each row is a member. A very long text is one member, held whole by
one task. Empty table: no archives, no rows. Other columns, whatever their
names, are not stored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shared import shared_dir, text_or_empty

FORMAT = "tidewave_archive"
WIDTH = 64
MEMBERS = "doc_id long, member string, offset long, media binary, error string"
_PNG = b"\x89PNG\r\n\x1a\n"
_LOCAL = struct.Struct("<4s5H3I2H")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, used: int, level: int = 1) -> bytes:
    """payload: a multiple of WIDTH bytes; used: those that are not padding."""
    rows = len(payload) // WIDTH
    filtered = np.zeros((rows, WIDTH + 1), np.uint8)
    filtered[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0" + str(used).encode()) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[bytes, int]:
    """(payload, bytes that are not padding) of an image of encode_png."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, used, packed, rows = 8, 0, [], 0
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IHDR":
            width, rows, bits, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
            if (width, bits, colour, laced) != (WIDTH, 8, 0, 0):
                raise ValueError("an image of another kind")
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            used = int(body[6:])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    grid = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, WIDTH + 1)
    if grid[:, 0].any():
        raise ValueError("an image with row filters")
    return grid[:, 1:].tobytes(), used


def features(payload: bytes) -> str:
    """rows, sum, sum of squares, least, most, distinct samples, and steps of over 32 from sample to sample."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    steps = int((np.abs(np.diff(x)) > 32).sum())
    return f"rows={len(x) // WIDTH};sum={x.sum()};squares={(x * x).sum()};min={x.min()};max={x.max()};distinct={len(np.unique(x))};steps={steps}"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _again(act: Callable, tries: int, wait: float):
    """What act returns, tried again where the store fails."""
    for left in reversed(range(tries)):
        try:
            return act()
        except (OSError, struct.error, zipfile.BadZipFile):
            if not left:
                raise
            time.sleep(wait)
    raise AssertionError


def _payload(data: bytes, at: int, size: int, crc: int, what: str) -> bytes:
    """The bytes of a stored member whose local header is at a place of data."""
    head = _LOCAL.unpack_from(data, at)
    begin = at + _LOCAL.size + head[-2] + head[-1]
    out = data[begin : begin + size]
    if head[0] != b"PK\x03\x04" or len(out) != size or zlib.crc32(out) != crc:
        raise OSError(f"{what} is damaged")
    return out


def read_member(uri: str, offset: int, size: int, crc: int, tries: int = 4, wait: float = 0.5) -> bytes:
    """The bytes of one stored member, whose local header is at offset."""

    def once() -> bytes:
        system, path = _open(uri)
        with system.open_input_file(path) as f:
            f.seek(offset)
            head = f.read(_LOCAL.size)
            return _payload(head + f.read(sum(_LOCAL.unpack(head)[-2:]) + size), 0, size, crc, f"{uri} at {offset}")

    return _again(once, tries, wait)


@dataclass
class Range(InputPartition):
    """Parts of archives: (uri, start, end)."""

    parts: list[tuple[str, int, int]]


@dataclass
class Archives(WriterCommitMessage):
    files: list[tuple[str, int]]


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path = path
        self.range_bytes = int(options.get("range_bytes", 16 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))
        self.most_ranges = int(options.get("most_ranges", 100_000))
        self.tries = int(options.get("tries", 4))
        self.wait = float(options.get("wait", 0.5))
        self.keep_errors = str(options.get("on_error", "fail")).lower() == "record"

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, path = _open(self.path)
        files: list[tuple[str, int]] = []
        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.base_name.startswith("commit-"):
                with system.open_input_stream(info.path) as f:
                    files += [(name, size) for name, size in json.loads(f.read())]
        size = max(self.range_bytes, -(-sum(n for _, n in files) // self.most_ranges))
        out, room = [], 0
        for name, n in sorted(files):
            for a in range(0, n, size):
                part = (f"{self.path}/{name}", a, min(a + size, n))
                if part[2] - a > room:
                    out.append(Range([]))
                    room = size
                out[-1].parts.append(part)
                room -= part[2] - a
        return out or [Range([])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        for uri, start, end in part.parts:
            yield from self._stretches(uri, start, end)

    def _stretches(self, uri: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        def directory() -> tuple[list[tuple], int]:
            system, path = _open(uri)
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                return sorted((i.header_offset, i.compress_size, i.CRC, i.filename, i.compress_type) for i in archive.infolist()), archive.start_dir

        every, stop = _again(directory, self.tries, self.wait)
        after = [m[0] for m in every[1:]] + [stop]
        mine = [(*m, e) for m, e in zip(every, after, strict=True) if start <= m[0] < end]
        k, source = 0, None
        while k < len(mine):
            first, n = mine[k][0], 1
            while k + n < len(mine) and mine[k + n][-1] - first <= self.batch_bytes:
                n += 1
            members, k = mine[k : k + n], k + n
            try:
                if source is None:
                    system, path = _open(uri)
                    source = system.open_input_file(path)
                source.seek(first)
                data = source.read(members[-1][-1] - first)
            except OSError:
                source, data = None, b""
            rows = []
            for offset, size, crc, name, kind, _ in members:
                media, error = None, None
                try:
                    if kind != zipfile.ZIP_STORED:
                        raise ValueError(f"{uri}: {name} is not stored as it is")
                    try:
                        media = _payload(data, offset - first, size, crc, f"{uri} at {offset}")
                    except (OSError, struct.error):
                        media = read_member(uri, offset, size, crc, self.tries, self.wait)
                except (OSError, struct.error, ValueError) as e:
                    if not self.keep_errors:
                        raise
                    error = str(e)
                doc = name.split("/")[0]
                rows.append((None if doc == "null" else int(doc), name, offset, media, error))
            yield self._batch(rows)
        if source is not None:
            source.close()

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MEMBERS.split(", ")])


class ArchiveWriter(DataSourceArrowWriter):
    """Takes doc_id and media."""

    def __init__(self, path: str, options: dict):
        self.path = path
        self.archive_bytes = int(options.get("archive_bytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        files: list[tuple[str, int]] = []
        out = archive = None
        name, number = "", 0

        def close() -> None:
            archive.close()
            files.append((name, out.tell()))
            out.close()

        for batch in iterator:
            for doc_id, media in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    out = system.open_output_stream(f"{path}/{name}")
                    archive = zipfile.ZipFile(_Plain(out), "w", zipfile.ZIP_STORED)
                info = zipfile.ZipInfo(f"{'null' if doc_id is None else doc_id}/{number}.png")
                archive.writestr(info, media.as_py())
                number += 1
                if out.tell() >= self.archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Archives(files)

    def commit(self, messages: list[Archives | None]) -> None:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with system.open_output_stream(f"{path}/commit-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages: list[Archives | None]) -> None:
        system, path = _open(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                system.delete_file(f"{path}/{name}")


class _Plain:
    """An output stream for zipfile that can't seek; members keep their true sizes in the archive's directory."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


class ArchiveSource(DataSource):
    """spark.read.format("tidewave_archive").load(uri), with range_bytes, most_ranges, batch_bytes, tries, wait, on_error (fail or record)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], dict(self.options))


def write_media(docs: DataFrame, path: str, **options) -> None:
    """Stores each text's bytes, padded with zeros to a positive multiple of 64, as an image."""

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for text in part.column("text"):
                    raw = text.as_buffer().to_pybytes()
                    out.append(encode_png(raw + bytes(-len(raw) % WIDTH if raw else WIDTH), len(raw)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "media"])

    docs.sparkSession.dataSource.register(ArchiveSource)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows.mapInArrow(images, "doc_id long, media binary").write.format(FORMAT).options(**options).mode("append").save(path)


def read_media(spark: SparkSession, path: str, **options) -> DataFrame:
    """doc_id, member, offset, media, error."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(FORMAT).options(**options).load(path)


MEASURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measure_media(members: DataFrame) -> DataFrame:
    """Decodes members and describes payload and stored form.

    A row for each member; of one that could not be read, doc_id and error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in (MEASURES + ", error string").split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            out = []
            for doc_id, media, error in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), batch.column("error").to_pylist(), strict=True):
                if media is None:
                    out.append((doc_id, *[None] * 7, error))
                    continue
                payload, used = decode_png(media)
                out.append((doc_id, used, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload), None))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return members.select("doc_id", "media", "error").mapInArrow(run, MEASURES + ", error string")


def store_and_measure(docs: DataFrame) -> DataFrame:
    """Writes the texts as media to a shared folder and measures what is read back; a member that can't be read fails the job."""
    path = shared_dir(docs.sparkSession, "media")
    uri = path if "://" in path else f"file://{path}"
    write_media(docs, uri)
    return measure_media(read_media(docs.sparkSession, uri)).drop("error")
