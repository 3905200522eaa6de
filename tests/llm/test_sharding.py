import hashlib
import math
import zlib
from collections import Counter, defaultdict

from corpora import ROWS, table
from tidewave.llm.sharding import shard_documents


def brute(doc_id, weights):
    key = "" if doc_id is None else str(doc_id)
    scores = []
    for i, w in enumerate(weights):
        u = (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
        scores.append((w / -math.log(u), -i))
    return -max(scores)[1]


def test_shards(spark):
    rows = shard_documents(table(spark), (1.0,) * 8, (1.0,) * 9).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    slots = defaultdict(list)
    for r in rows:
        assert r.shard == brute(r.doc_id, (1.0,) * 8)
        assert r.grown_shard == brute(r.doc_id, (1.0,) * 9)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_growth_moves_rows_into_the_new_shard_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shard_documents(docs, (1.0, 1.0, 2.0), (1.0, 1.0, 2.0, 1.0)).collect()
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    share = Counter(r.shard for r in rows)
    assert 400 < share[2] < 600
    assert 140 < sum(r.grown_shard == 3 for r in rows) < 260


def test_one_shard_and_no_rows(spark):
    assert {r.shard for r in shard_documents(table(spark), (1.0,)).collect()} == {0}
    assert shard_documents(table(spark, []), (1.0, 0.0)).count() == 0
    assert {r.shard for r in shard_documents(table(spark), (1.0, 0.0)).collect()} == {0}
