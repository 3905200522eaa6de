"""Spelling variants against brute force over all pairs, and against the SQL."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from corpora import table
from hypothesis import given, settings
from hypothesis import strategies as st
from tidewave.llm import spelling


def apart_by_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, damage=97):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    by_length = {k: [w for w in n if len(w) == k] for k in {len(w) for w in n}}
    out = {}
    for w in n:
        near = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if apart_by_one(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best is not None and n[best] >= 2 * n[w] else None, len(near))
    rows = set()
    for w, (form, near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n[w], near, n[form] if form else None))
    return rows


def found(df):
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


WORDS = ["banana", "bananna", "bannana", "banane", "Banana", "naïveté", "naivete", "naivte", "ananas", "aaaaa", "aaaaaa", "aaaaaaa", "aabaa", "abaaa", "été", "ÉTÉÉÉ", "étéÉÉ", "straße", "strasse", "x" * 3000, "x" * 3001, "colour", "color", "kolor", "colours"]


def texts(seed, n=120):
    r = np.random.default_rng(seed)
    return [" ".join(WORDS[int(k)] for k in (r.integers(0, len(WORDS), 12) ** 2 // len(WORDS))) for _ in range(n)]


def test_against_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(texts(1))] + [(None, "color, color; color!"), (5, None), (6, ""), (7, texts(1)[7]), (7, texts(1)[7])]
    want = brute(rows)
    assert any(r[1] is not None for r in want)
    assert found(spelling.group_spellings(table(spark, [(*r, "en", "s", 1) for r in rows]))) == want


def test_of_the_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(want) > 1000 and found(spelling.group_spellings(docs)) == want
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert {tuple(r) for r in con.execute(spelling.oracle()).fetchall()} == want


def test_empty_table(spark):
    out = spelling.group_spellings(table(spark, []))
    assert out.count() == 0 and dict(out.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abç", min_size=2, max_size=9), min_size=2, max_size=60))
def test_keys_meet_for_each_pair_at_a_distance_of_one(words):
    """The three rarest bigrams of each, with the halves, miss no pair."""
    words = sorted(w for w in words if len(w) >= 4)
    if len(words) < 2:
        return
    held = Counter(g for w in words for g in {w[i : i + 2] for i in range(len(w) - 1)})
    points, offsets = spelling._codes(pa.array(words))
    table = spelling._ranked(pa.array(list(held)), pa.array(list(held.values())))
    short, longer = set(), set()
    for word, key, of_longer in spelling._keys(points, offsets, *spelling._rarest(points, offsets, table)):
        (longer if of_longer else short).update(zip(word.tolist(), key.tolist(), strict=True))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if i != j and apart_by_one(a, b) and len(a) <= len(b):
                other = longer if len(b) > len(a) else short
                assert {k for w, k in short if w == i} & {k for w, k in other if w == j}, (a, b)


def test_a_form_needs_twice_the_count(spark):
    rows = [(k, "colour") for k in range(5)] + [(10 + k, "colours") for k in range(3)] + [(20 + k, "color") for k in range(10)]
    got = {r.word: (r.form, r.root) for r in spelling.group_spellings(table(spark, [(*r, "en", "s", 1) for r in rows]), damage=0).collect()}
    assert got == {"colour": ("color", "color"), "colours": (None, "colours"), "color": (None, "color")}


def test_clashing_names(spark):
    docs = table(spark)
    more = docs.select("*", *(docs.score.alias(c) for c in ("key", "word", "n", "run", "held")))
    assert spelling.group_spellings(more).count() == spelling.group_spellings(docs).count() > 0
