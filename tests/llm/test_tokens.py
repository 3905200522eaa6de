"""Token operators against whole-text encoding and exact round trips."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from corpora import ROWS, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tidewave.llm import packing, repair, tokens

PATH = tokens.word_bpe_path()


def whole(text):
    return tokens.encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_runs_encode_as_whole_texts():
    texts = [r[1] for r in ROWS]
    for _ in range(2):  # the second time from what is kept
        ids, offsets = tokens.encoder(PATH).encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [whole(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
def test_any_text_encodes_as_a_whole(texts):
    ids, offsets = tokens.encoder(PATH).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [whole(t) for t in texts]


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_RUNS", 5)
    enc = tokens.WordEncoder(PATH)
    for text in ("a b c d", "e f g h", "a b c d e f g"):
        ids, _ = enc.encode(pa.array([text]))
        assert ids.tolist() == whole(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=200), max_size=8))
def test_grammar_round_trip(docs):
    ids = np.array([i for d in docs for i in d], np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    g = repair.from_bytes(repair.to_bytes(repair.compress(ids, bounds, 10, 500, least=2), len(ids)))
    assert repair.expand(g, g.symbols).tolist() == ids.tolist()
    for k, d in enumerate(docs):
        for a, n in ((0, len(d)), (1, 3), (len(d) // 2, 5), (len(d), 2)):
            assert repair.decode_range(g, k, a, n).tolist() == d[a : a + n]


def test_grammar_shrinks_repeats():
    ids = np.array([1, 2, 3, 4] * 5000, np.uint32)
    g = repair.compress(ids, np.array([0, 20000]), 10, 500)
    assert len(g.symbols) < 50


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_token_blocks(spark, block):
    path = repair.write_token_blocks(table(spark), PATH, 2, block_tokens=block)
    got = {}
    total = 0
    for r in sorted(repair.read_token_blocks(spark, path).collect(), key=lambda r: r.start):
        assert r.start == total
        total += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    want = {}
    for r in ROWS:
        ids = [*whole(r[1]), 2]
        want.setdefault(r[0], []).append((len(ids), crc(ids)))
    assert got == want
    order = [r.doc_id for r in sorted(repair.read_token_blocks(spark, path).collect(), key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)


def test_token_blocks_of_nothing(spark):
    path = repair.write_token_blocks(table(spark, []), PATH, 2)
    assert repair.read_token_blocks(spark, path).count() == 0


def check_packing(rows, source, capacity):
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for doc_id, text in source:
        ids = [*whole(text), 0]
        want[doc_id] += [(k // capacity, k, len(ids[k : k + capacity]), crc(ids[k : k + capacity])) for k in range(0, len(ids), capacity)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    return len(sequences)


@pytest.mark.parametrize("options", [{}, {"leaf_pieces": 2, "fan": 2}, {"leaf_pieces": 3, "fan": 2, "carry": 1}])
def test_packing(spark, options):
    rows = packing.pack_documents(table(spark), PATH, 64, **options).collect()
    check_packing(rows, [(r[0], r[1]) for r in ROWS], 64)


def test_packing_is_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, PATH, 2048, leaf_pieces=200, fan=3).collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    least = -(-sum(r.length for r in rows) // 2048)
    assert used <= least * 1.01 + 1


def test_packing_nothing(spark):
    assert packing.pack_documents(table(spark, []), PATH, 64).count() == 0


def test_best_fit_takes_the_fullest_bin():
    bins, offsets = packing.best_fit(np.array([6, 7, 3, 4, 10]), 10)
    assert len(set(bins)) == 3
    assert bins[1] == bins[2] and bins[0] == bins[3] and offsets[2] == 7


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.geometric(0.02, 60_000), 999).astype(np.uint32)
    bounds = np.array([0, 25_000, 25_000, 60_000])
    g = repair.compress(ids, bounds, 1000, 60_000)
    assert (repair.expand(g, g.symbols) == ids).all()
    pairs = Counter(p for a, b in zip(g.bounds, g.bounds[1:], strict=False) for p in zip(g.symbols[a:b].tolist(), g.symbols[a + 1 : b].tolist(), strict=False))
    assert max(pairs.values()) < 6


def test_rounds_that_save_little_go_on():
    ids = np.random.default_rng(5).integers(0, 120, 60_000).astype(np.uint32)
    g = repair.compress(ids, np.array([0, 60_000]), 120, 200)
    assert len(g.left) == 199
    assert (repair.expand(g, g.symbols) == ids).all()


def test_runs_of_one_hash_are_told_apart(monkeypatch):
    enc = tokens.WordEncoder(tokens.word_bpe_path())
    monkeypatch.setattr(tokens.pd.util, "hash_array", lambda x, categorize: np.array([len(s) % 3 for s in x], np.uint64))
    texts = [f"word{k} other{k % 7} été {'x' * (k % 5)} 12{k}" for k in range(40)]
    for part in (texts[:20], texts, texts[10:]):
        ids, offsets = enc.encode(pa.array(part))
        want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


@pytest.mark.parametrize("seed", range(3))
def test_the_bound_on_carried_bins_costs_no_sequence(spark, seed):
    rng = np.random.default_rng(seed)
    # hardly any piece fits to another: much is left over at each node
    sizes = np.concatenate([rng.integers(52, 75, 900), rng.integers(1, 8, 40), rng.integers(20, 49, 30)])
    deal = rng.integers(0, 1 << 40, len(sizes))
    rows = [(i, 0, 0, int(n), 0, int(d)) for i, (n, d) in enumerate(zip(sizes, deal, strict=True))]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    count = lambda **o: packing.pack_pieces(pieces, 100, leaf_pieces=60, fan=4, **o).select("sequence_id").distinct().count()
    few, all_ = count(carry=4), count(carry=1_000_000)
    assert few == all_
