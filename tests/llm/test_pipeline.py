"""Each stage of the pipeline against brute force on its own input, and run() as a whole."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_near_duplicates import brute as classes
from test_quality_and_mixing import WORD, base
from test_secrets import brute as base_spans
from test_tokens import check_packing

DIR = "/root/testdata/sf0.001"


def line_key(line):
    return re.sub("[0-9]+", "0", " ".join(WORD.findall(line)).lower())


def cleaned(rows, least=20, lost=0.5):
    """doc_id -> text of what the quality rules keep."""
    holders = defaultdict(set)
    for r in rows:
        for line in r.text.split("\n"):
            if WORD.search(line):
                holders[r.source, line_key(line)].add(r.text)
    gone = {k for k, v in holders.items() if len(v) >= least}
    out = {}
    for r in rows:
        n = base(r.text)
        if n[0] < 50 or 100 * n[4] > 50 * n[0]:
            continue
        removed = [line for line in r.text.split("\n") if WORD.search(line) and (r.source, line_key(line)) in gone]
        if sum(len(WORD.findall(x)) for x in removed) > lost * n[0]:
            continue
        out[r.doc_id] = "\n".join(x for x in r.text.split("\n") if not (WORD.search(x) and (r.source, line_key(x)) in gone)) if removed else r.text
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage, and what the last one returns."""
    frames = [spark.read.parquet(f"{DIR}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frames[-1], DIR)
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        out.write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for frame in stages[1:5]:
        assert frame.dtypes == stages[0].dtypes


def test_quality_rules(stages):
    assert {r.doc_id: r.text for r in stages[1].collect()} == cleaned(stages[0].collect())


def test_near_duplicates(stages):
    want = sorted(min(g) for g in classes([(r.doc_id, r.text) for r in stages[1].collect()]))
    assert sorted(r.doc_id for r in stages[2].collect()) == want


def test_secret_scans(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r.text for r in stages[3].collect()}
    assert set(before) == set(after)
    for doc_id, text in before.items():
        parts, done = [], 0
        spans = base_spans(text)
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if a >= done:
                parts += [text[done:a], "[SECRET]"]
            done = max(done, b)
        assert after[doc_id] == ("".join(parts) + text[done:] if spans else text)


def test_mixing(stages):
    before, after = stages[3].collect(), stages[4].collect()
    rows = {r.doc_id: r for r in before}
    n = Counter(r.doc_id for r in after)
    assert set(n) == set(rows) and max(n.values()) <= 2
    assert all(r == rows[r.doc_id] for r in after)
    tokens, used = Counter(), Counter()
    for r in before:
        tokens[r.source] += len(WORD.findall(r.text)) + 1
    for r in after:
        used[r.source] += len(WORD.findall(r.text)) + 1
    largest = max(tokens, key=tokens.get)
    assert used[largest] == tokens[largest] and all(used[s] <= 2 * tokens[s] + 1 for s in tokens)


def test_packing_and_run(spark, stages):
    check_packing(stages[5].collect(), [(r.doc_id, r.text) for r in stages[4].collect()], 2048)
    whole = corpus_pipeline.run(spark, DIR)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(r[c] for c in key) for r in whole.collect()) == Counter(tuple(r[c] for c in key) for r in stages[5].collect())


NAMES = ["tokens", "block", "epoch", "slot", "key", "id", "row", "gone", "of", "name", "first", "_key", "_id", "_gone", "_block", "_tokens", "_source", "_epoch", "_room", "_part", "part", "node", "label", "host", "copy", "lines"]


def awkward(spark, rows):
    """The rows with further columns whose names the stages use themselves."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.concat_ws("-", F.lit(c), "doc_id") for c in NAMES})


def test_awkward_rows_and_clashing_columns(spark):
    own = lambda i, n=60: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, own(i), "en", f"s{i % 3}", i) for i in range(30)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, own(3), "en", "s1", 1), (103, own(103, 40_000), "en", None, 1), (None, own(104), "en", "s0", 1), (None, own(105), None, None, None)]
    rows += [(106, own(106), "en", "s2", 1)] * 3 + [(106, own(106), "de", "s2", 2)]
    docs = awkward(spark, rows)
    before = {(r.doc_id, r.text): r for r in docs.collect() if (r.doc_id, r.lang) != (106, "en")}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, DIR)
        assert docs.columns == [*["doc_id", "text", "lang", "source", "n_chars"], *NAMES]
        got = docs.collect()
        assert all(r == before[r.doc_id, r.text] for r in got if (r.doc_id, r.lang) != (106, "en")), name
        ids = Counter(r.doc_id for r in got)
        if k == 0:
            assert ids == Counter({**{i: 1 for i in range(30)}, 102: 1, 103: 1, None: 2, 106: 4})
        elif k < 3:
            assert ids == Counter({**{i: 1 for i in range(30)}, 103: 1, None: 2, 106: 1})
        else:
            assert set(ids) == {*range(30), 103, 106, None}
        assert [r.lang for r in got if r.doc_id == 106][:1] == ["de"] or k == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    check_packing(pieces.collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048)


def test_an_empty_table(spark):
    docs = awkward(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.count() == 0
