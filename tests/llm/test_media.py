import hashlib
import zipfile
import zlib
from collections import Counter

import pytest
from corpora import ROWS, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tidewave.llm import media


def padded(text):
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_images_keep_every_byte(data):
    payload = data + bytes(-len(data) % 64 if data else 64)
    assert media.decode_png(media.encode_png(payload, len(data))) == (payload, len(data))


def test_stored_and_read_back(spark):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in media.store_and_measure(table(spark)).collect())
    want = Counter()
    for r in ROWS:
        payload, used = padded(r[1])
        image = media.encode_png(payload, used)
        want[r[0], used, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), media.features(payload)] += 1
    assert got == want
    assert media.store_and_measure(table(spark, [])).count() == 0


def test_byte_ranges_and_small_archives(spark, tmp_path):
    path = f"file://{tmp_path}/media"
    media.write_media(table(spark), path, archive_bytes=600)
    assert len(list((tmp_path / "media").glob("*.zip"))) > 3
    rows = media.read_media(spark, path, range_bytes=200, batch_bytes=1)
    assert rows.rdd.getNumPartitions() > 5
    assert Counter(r.doc_id for r in rows.collect()) == Counter(r[0] for r in ROWS)


def test_leftovers_of_lost_tasks_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/media"
    media.write_media(table(spark), path)
    with zipfile.ZipFile(tmp_path / "media" / "lost.zip", "w") as z:
        z.writestr("99/0.png", b"x")
    assert media.read_media(spark, path).count() == len(ROWS)


def test_a_damaged_member_fails_alone(spark, tmp_path):
    path = f"file://{tmp_path}/media"
    media.write_media(table(spark).coalesce(1), path)
    (archive,) = (tmp_path / "media").glob("*.zip")
    with zipfile.ZipFile(archive) as z:
        info = z.infolist()[4]
    data = bytearray(archive.read_bytes())
    data[info.header_offset + 30 + len(info.filename) + 20] ^= 255
    archive.write_bytes(data)
    rows = media.read_media(spark, path, tries=1, on_error="record").collect()
    assert len(rows) == len(ROWS) and [r.member for r in rows if r.error] == [info.filename]
    measured = media.measure_media(media.read_media(spark, path, tries=1, on_error="record")).collect()
    assert len(measured) == len(ROWS) and [(r.error is None, r.feature is None) for r in measured].count((False, True)) == 1
    with pytest.raises(Exception):
        media.read_media(spark, path, tries=1).collect()


def test_one_open_for_a_range_and_the_rest_again(monkeypatch, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(50):
            z.writestr(f"{k}/0.png", bytes([k]) * (k * 10 + 1))
    uri, real, opened, failing = f"file://{tmp_path}/a.zip", media._open, [], set()

    def flaky(name):
        opened.append(name)
        if len(opened) in failing:
            raise OSError("not now")
        return real(name)

    monkeypatch.setattr(media, "_open", flaky)
    reader = media.ArchiveReader(str(tmp_path), {"batch_bytes": 3000, "wait": 0})
    read = lambda: {r["doc_id"]: r["media"] for b in reader.read(media.Range([(uri, 0, 1 << 40)])) for r in b.to_pylist()}
    want = {k: bytes([k]) * (k * 10 + 1) for k in range(50)}
    assert read() == want and len(opened) == 2  # the directory, and the stretches
    for n in (1, 2, 3, 4):
        opened.clear()
        failing = {n, n + 1}
        assert read() == want
    parts = [media.Range([(uri, a, a + 500)]) for a in range(0, 40_000, 500)]
    got = [r["doc_id"] for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(got) == list(range(50))


def test_small_archives_share_a_partition(tmp_path):
    (tmp_path / "commit-1.json").write_text(str([[f"{k}.zip", 100] for k in range(20)]).replace("'", '"'))
    plan = lambda **o: [sum(b - a for _, a, b in r.parts) for r in media.ArchiveReader(f"file://{tmp_path}", o).partitions()]
    assert plan(range_bytes=500) == [500] * 4
    assert plan(range_bytes=50) == [50] * 40
    assert plan(range_bytes=1, most_ranges=2) == [1000, 1000]


def test_members_are_retried(monkeypatch, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("1/0.png", b"hello")
        info = z.infolist()[0]
    calls, real = [], media._open

    def flaky(uri):
        calls.append(uri)
        if len(calls) < 3:
            raise OSError("not now")
        return real(uri)

    monkeypatch.setattr(media, "_open", flaky)
    assert media.read_member(f"file://{tmp_path}/a.zip", info.header_offset, 5, info.CRC, tries=4, wait=0) == b"hello"
    assert len(calls) == 3
