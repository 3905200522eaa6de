import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpora import ROWS, table
from tidewave.llm import factorization as fm


def test_margins_are_all_pairs():
    texts = pa.array([r[1] for r in ROWS], pa.string())
    f = fm.extract(texts)
    m = fm.train(f, np.array([i % 2 for i in range(len(ROWS))], float), steps=20, batch=4)
    row, feature, value = m.inputs(f)
    got = m.margins(row, feature, value, len(ROWS))[0]
    for k in range(len(ROWS)):
        i, x = feature[row == k], value[row == k]
        pairs = sum(float(m.factors[i[a]] @ m.factors[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a)) if len(i) < 400 else None
        if pairs is not None:
            assert got[k] == pytest.approx(m.bias + float(m.weights[i] @ x) + pairs, rel=1e-3, abs=1e-3)


def test_features_of_a_text_don_t_depend_on_its_batch():
    texts = pa.array([r[1] for r in ROWS], pa.string())
    whole = fm.extract(texts)
    for k in range(len(ROWS)):
        one = fm.extract(texts.slice(k, 1))
        mine = whole.row == k
        assert one.bucket.tolist() == whole.bucket[mine].tolist()
        assert np.allclose(one.value, whole.value[mine]) and np.allclose(one.statistics[0], whole.statistics[k])


def test_metadata_are_features():
    texts = pa.array(["same words"] * 4)
    f = fm.extract(texts, [pa.array([3, None, 5, None])])
    assert f.statistics.shape == (4, len(fm.STATISTICS) + 2)
    m = fm.train(f, np.array([1.0, 0.0, 1.0, 0.0]), steps=200, batch=4)
    scores = m.score(f)
    assert min(scores[0], scores[2]) > 0.5 > max(scores[1], scores[3])


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(0, 1), (5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    rows = fm.classify_quality(table(spark), labels).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    assert fm.classify_quality(table(spark, []), labels, metadata=["n_chars", "score"]).count() == 0
    with_metadata = fm.classify_quality(table(spark), labels, metadata=["n_chars", "score"]).collect()
    assert len(with_metadata) == len(ROWS) and all(0 <= r.score <= 1 for r in with_metadata)
    none = labels.filter("doc_id > 100")
    assert {r.score for r in fm.classify_quality(table(spark), none).collect()} == {0.5}


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = fm.classify_quality(docs.join(labels.select("doc_id"), "doc_id"), labels, metadata=["n_chars"]).filter("held_out").join(labels, "doc_id").toPandas()
    rank, good = got.score.rank(), got.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / good.sum() / (~good).sum()
    assert auc > 0.99 and (got.predicted == got.quality).mean() > 0.97
