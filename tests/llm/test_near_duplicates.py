import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpora import ROWS, table
from tidewave.llm import bagminhash as bag


def multiset(text):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(x, y):
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def brute(docs, threshold=0.8):
    """Classes by every pair that shares a shingle; equal texts are linked."""
    by_text = {}
    for d, t in docs:
        by_text.setdefault(t or "", []).append(d)
    texts = list(by_text)
    sets = [multiset(t) for t in texts]
    where = {}
    for i, s in enumerate(sets):
        for k in s:
            where.setdefault(k, []).append(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in {(a, b) for v in where.values() for a in v for b in v if a < b}:
        if similarity(sets[i], sets[j]) >= threshold:
            root[find(i)] = find(j)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(find(i), []).extend(by_text[t])
    return sorted((sorted(g, key=str) for g in groups.values()), key=str)


def classes(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.class_number, []).append(r.doc_id)
    return sorted((sorted(g, key=str) for g in groups.values()), key=str)


def test_signatures_are_unbiased():
    r = random.Random(1)
    base = " ".join(r.choice("abcdefgh") for _ in range(60))
    texts = pa.array([f"{base} {'z ' * k}" for k in (0, 10, 30, 60, 100)])
    d, h, w = bag.shingles(texts)
    assert w.max() > 60
    sig = bag.signatures(d, h, w, len(texts), m=20_000)
    sets = [multiset(t) for t in texts.to_pylist()]
    for i in range(5):
        for j in range(i):
            exact = similarity(sets[i], sets[j])
            assert bag.similarity_to(texts.slice(i, 1), texts.slice(j, 1))[0] == pytest.approx(exact)
            assert (sig[i] == sig[j]).mean() == pytest.approx(exact, abs=0.02)


def test_signatures_don_t_depend_on_the_batch():
    texts = pa.array(["a b c d e f g", "x", "", None, "k l m n o p q r s t u v"])
    alone = [bag.signatures(*bag.shingles(texts.slice(i, 1)), 1)[0] for i in range(5)]
    assert (bag.signatures(*bag.shingles(texts), 5) == np.array(alone)).all()


def test_awkward_rows(spark):
    got = classes(bag.near_duplicates(table(spark)))
    assert got == brute([(r[0], r[1]) for r in ROWS])
    assert bag.near_duplicates(table(spark, [])).count() == 0
    kept = [r.doc_id for r in bag.drop_near_duplicates(table(spark)).collect()]
    assert sorted(kept, key=str) == sorted((min(g, key=lambda i: -1 if i is None else i) for g in got), key=str)


def test_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert classes(bag.near_duplicates(docs)) == want
    kept = sorted(r.doc_id for r in bag.drop_near_duplicates(docs).collect())
    assert kept == sorted(min(g) for g in want)


def test_a_group_across_blocks(spark, monkeypatch):
    """A chain of edits: neighbours are linked, ends are far apart; small blocks and leaders alone don't find it."""
    monkeypatch.setattr(bag, "BLOCK", 4)
    monkeypatch.setattr(bag, "PART_BYTES", 3_000)
    monkeypatch.setattr(bag, "PART", 3)
    r = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(40):
        words = list(words)
        for _ in range(2):
            words[r.randrange(len(words))] = f"n{i}{r.random()}"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, " ".join(f"u{i}x{k}" for k in range(60)) + " " + " ".join(f"common{k}" for k in range(60))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert classes(bag.near_duplicates(df)) == brute(docs)


def test_links_can_be_checked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = bag.near_duplicates(docs).collect()
    several = {}
    for r in rows:
        several.setdefault(r.class_number, set()).add(texts[r.doc_id])
    linked = 0
    for r in rows:
        # a text is linked where its class has another one, to a text of the class that is similar
        assert (r.n_links > 0) == (len(several[r.class_number]) > 1) == (r.linked_to is not None)
        if r.linked_to is not None:
            other = texts[r.linked_to]
            assert other in several[r.class_number] and other != texts[r.doc_id]
            assert similarity(multiset(texts[r.doc_id]), multiset(other)) >= 0.8
            linked += 1
    assert linked > 10
    # links join classes: a class of n texts has n - 1 or more
    for number, some in several.items():
        of_text = {texts[r.doc_id]: r.n_links for r in rows if r.class_number == number}
        assert sum(of_text.values()) >= 2 * (len(some) - 1)


def test_one_of_rows_that_json_can_t_hold(spark):
    df = spark.sql("""SELECT * FROM VALUES (1L, 'a text of some words', INTERVAL '2' DAY, map(1, 'x'), CAST(NULL AS STRING)), (1L, 'a text of some words', INTERVAL '1' DAY, map(2, 'y'), 'z'),
        (1L, 'a text of some words', NULL, NULL, 'z') AS t(doc_id, text, span, `a map`, `x.y`)""")
    got = bag.drop_near_duplicates(df).collect()
    assert len(got) == 1 and got[0]["x.y"] == "z" and got[0].span.days == 1
