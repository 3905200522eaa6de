"""Token ids in binary shards under Re-Pair grammars.

Documents are sorted by id over range partitions. Each partition is cut into
blocks of whole documents; a block's ids become a sequence of symbols under a
grammar of its own: in rounds, frequent pairs of adjacent symbols are replaced
by new symbols, and each rule keeps the length of its expansion. No rule spans
two documents, so any stretch of any document decodes from the block alone.

Null text: no ids but the end id. Null doc_id: before the others, stays null.
Empty table: no blocks, no rows. Rows that share a doc_id follow each other in
any order. A very long text is one document of one block. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, text_or_empty
from .tokens import encoder, slices

MAGIC = b"TWRP0001"
HEADER = struct.Struct("<8sIIQQI")  # magic, documents, rules, tokens, symbols, bytes of a symbol
_TABLE = 1 << 18


@dataclass
class Grammar:
    """symbols below ``base`` are ids, base + k is rule k: left[k] right[k]."""

    base: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray  # of each rule's expansion
    symbols: np.ndarray
    bounds: np.ndarray  # first symbol of each document, and the end


def compress(ids: np.ndarray, bounds: np.ndarray, base: int, most_rules: int, least: int = 4) -> Grammar:
    """Replaces frequent pairs until none is left or there are most_rules rules.

    In a round, each pair's rank is that of its count; where occurrences
    overlap, the more frequent pair wins, and the left one of equal pairs.
    """
    # a pair is one number, of 32 bits if symbols have 16
    word, half = (np.uint32, 16) if base + most_rules <= 65_536 else (np.uint64, 32)
    none, shift, low = np.iinfo(word).max, word(half), word((1 << half) - 1)  # none: no rule may be the pair of two highest symbols
    most_rules -= 1
    seq = ids.astype(word)
    last = np.zeros(len(seq), bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    used = 0
    while len(seq) > 1 and used < most_rules:
        key = (seq[:-1] << shift) | seq[1:]
        key[last[:-1]] = none
        ordered = np.sort(key)
        cut = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]])
        pairs, counts = ordered[cut[:-1]], np.diff(cut)
        good = (counts >= least) & (pairs != none)
        pairs, counts = pairs[good], counts[good]
        if not len(pairs):
            break
        best = np.argsort(-counts, kind="stable")[: min(most_rules - used, max(64, most_rules // 4))]
        pairs, rest = pairs[best], pairs[:0]
        while True:
            # of pairs that share a slot the first stays; the others wait, but not beyond a round that would be the last
            slot = _slot(pairs)
            _, firsts = np.unique(slot, return_index=True)
            waits = np.ones(len(pairs), bool)
            waits[firsts] = False
            pairs, rest = pairs[np.sort(firsts)], pairs[waits]
            slot = _slot(pairs)
            rank = np.zeros(_TABLE, np.int32)
            rank[slot] = np.arange(len(pairs))
            held = np.full(_TABLE, none, word)
            held[slot] = pairs
            at = _slot(key)
            hit = np.flatnonzero((held[at] == key) & (key != none))
            r = rank[at[hit]]
            take = np.ones(len(hit), bool)
            near = hit[1:] == hit[:-1] + 1
            same = near & (r[1:] == r[:-1])  # as in x x x x: every second place
            take[1:] &= ~near | (r[1:] < r[:-1])
            take[:-1] &= ~near | (r[:-1] <= r[1:])
            if same.any():
                first = np.concatenate([[True], ~same])
                odd = (np.arange(len(hit)) - np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))) % 2 == 1
                inside = np.concatenate([[False], same])
                after = np.concatenate([~near | (r[:-1] <= r[1:]), [True]])
                take = np.where(inside, ~odd & after, take)
            where = hit[take]
            uses = np.bincount(r[take], minlength=len(pairs))
            kept = uses >= 3
            if kept.any() or not len(rest):
                break
            pairs = rest
        if not kept.any():
            break
        ranks = r[take]
        name = np.cumsum(kept) - 1 + base + used
        where, ranks = where[kept[ranks]], ranks[kept[ranks]]
        seq[where] = name[ranks].astype(word)
        last[where] = last[where + 1]
        stay = np.ones(len(seq), bool)
        stay[where + 1] = False
        seq, last = seq[stay], last[stay]
        left.append((pairs[kept] >> shift).astype(np.uint32))
        right.append((pairs[kept] & low).astype(np.uint32))
        used += int(kept.sum())
    lefts = np.concatenate(left) if left else np.zeros(0, np.uint32)
    rights = np.concatenate(right) if right else np.zeros(0, np.uint32)
    length = np.ones(base + used, np.uint32)
    done = 0
    for part in left:  # a round's rules only name symbols of earlier rounds
        here = slice(base + done, base + done + len(part))
        length[here] = length[lefts[done : done + len(part)]] + length[rights[done : done + len(part)]]
        done += len(part)
    ends = np.flatnonzero(last) + 1
    spans = np.zeros(len(bounds), np.int64)
    full = np.diff(bounds) > 0
    spans[1:][full] = ends
    return Grammar(base, lefts, rights, length[base:], seq.astype(np.uint32), np.maximum.accumulate(spans))


def _slot(pairs: np.ndarray) -> np.ndarray:
    if pairs.dtype == np.uint32:
        return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(14)
    return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


def expand(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for. Of many symbols each rule is expanded once and then copied."""
    if len(symbols) > len(g.left):
        ids = np.concatenate([np.arange(g.base, dtype=np.uint32), _unfold(g, np.arange(g.base, g.base + len(g.left), dtype=np.uint32))])
        size = np.concatenate([np.ones(g.base, np.int64), g.length.astype(np.int64)])
        first = (np.cumsum(size) - size)[symbols]
        n = size[symbols]
        done = np.cumsum(n)
        return ids[np.arange(done[-1]) + np.repeat(first - (done - n), n)] if len(n) else ids[:0]
    return _unfold(g, symbols)


def _unfold(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    """A rule's two sides take its place until no rule is left."""
    out = symbols
    while len(out) and (is_rule := out >= g.base).any():
        n = 1 + is_rule
        at = np.cumsum(n) - n
        grown = np.empty(int(n.sum()), np.uint32)
        grown[at[~is_rule]] = out[~is_rule]
        rule = out[is_rule] - g.base
        grown[at[is_rule]] = g.left[rule]
        grown[at[is_rule] + 1] = g.right[rule]
        out = grown
    return out


def decode_range(g: Grammar, document: int, start: int, count: int) -> np.ndarray:
    """ids start to start + count of one document; only the symbols that cover them are expanded."""
    symbols = g.symbols[g.bounds[document] : g.bounds[document + 1]]
    size = np.ones(len(symbols), np.int64)
    rule = symbols >= g.base
    size[rule] = g.length[symbols[rule] - g.base]
    ends = np.cumsum(size)
    if count <= 0 or not len(ends) or start >= ends[-1]:
        return np.zeros(0, np.uint32)
    a = int(np.searchsorted(ends, start, side="right"))
    b = int(np.searchsorted(ends, start + count, side="left"))
    begin = int(ends[a] - size[a])
    return expand(g, symbols[a : b + 1])[start - begin : start - begin + count]


def to_bytes(g: Grammar, tokens: int) -> bytes:
    wide = np.dtype("<u2") if g.base + len(g.left) <= 65536 else np.dtype("<u4")
    parts = [g.left.astype(wide), g.right.astype(wide), g.length.astype("<u4"), g.bounds.astype("<u8"), g.symbols.astype(wide)]
    head = HEADER.pack(MAGIC, len(g.bounds) - 1, len(g.left), tokens, len(g.symbols), wide.itemsize) + struct.pack("<I", g.base)
    return head + b"".join(p.tobytes() for p in parts)


def from_bytes(data: bytes) -> Grammar:
    magic, docs, rules, _, symbols, width = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    (base,) = struct.unpack_from("<I", data, HEADER.size)
    at, out = HEADER.size + 4, []
    for kind, n in ((f"<u{width}", rules), (f"<u{width}", rules), ("<u4", rules), ("<u8", docs + 1), (f"<u{width}", symbols)):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    left, right, length, bounds, seq = out
    return Grammar(base, left.astype(np.uint32), right.astype(np.uint32), length, seq.astype(np.uint32), bounds.astype(np.int64))


BLOCKS = "part int, block int, start_in_part long, n_tokens long, doc_ids array<long>, data binary"


def write_token_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, block_tokens: int = 1 << 20, vocabulary: int = 49_408) -> str:
    """Encodes documents in ascending doc_id order and returns the folder of the blocks.

    The folder is Parquet, written with Spark's commit protocol; ``data``
    holds a block's bytes. part is the range partition, block its place
    there, start_in_part the ids before it in that partition.
    """
    most_rules = 65_536 - vocabulary if vocabulary < 65_000 else 16_384

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer_path)
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        names: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            g = compress(np.concatenate(held), np.concatenate([[0], np.cumsum(n)]), vocabulary, most_rules)
            doc_ids = pa.concat_arrays(names)
            columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), pa.array([to_bytes(g, size)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "block", "start_in_part", "n_tokens", "doc_ids", "data"])

        for batch in batches:
            for piece in slices(batch, "text"):
                ids, offsets = enc.encode(piece.column("text"))
                # the end id goes after each document's ids
                ids = np.insert(ids, offsets[1:], end_id)
                held.append(ids)
                lengths.append(np.diff(offsets) + 1)
                names.append(piece.column("doc_id"))
                size += len(ids)
                if size >= block_tokens:
                    yield flush()
                    block, start = block + 1, start + size
                    held, lengths, names, size = [], [], [], 0
        if size:
            yield flush()

    spark = docs.sparkSession
    path = shared_dir(spark, "token-blocks")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("tie")).repartitionByRange(n, "doc_id", "tie")
    ranged.sortWithinPartitions("doc_id").select("doc_id", "text").mapInArrow(blocks, BLOCKS).write.parquet(path)
    return path


def read_token_blocks(spark, path: str) -> DataFrame:
    """Decodes blocks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The starts of the partitions are summed on the driver, one number for
    each range partition.
    """
    totals = dict(spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, total = [], 0
    for part in sorted(totals):
        starts.append((part, total))
        total += totals[part]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                g = from_bytes(batch.column("data")[row].as_py())
                ids = expand(g, g.symbols).astype("<u4")
                size = np.ones(len(g.symbols), np.int64)
                rule = g.symbols >= g.base
                size[rule] = g.length[g.symbols[rule] - g.base]
                at = np.concatenate([[0], np.cumsum(size)])[g.bounds]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column("part")[row].as_py(), np.int32)), batch.column("doc_ids")[row].values, pa.array(at[:-1] + batch.column("start_in_part")[row].as_py()), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(path).select("part", "start_in_part", "doc_ids", "data").mapInArrow(documents, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    before = spark.createDataFrame(starts, "part int, before long")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
