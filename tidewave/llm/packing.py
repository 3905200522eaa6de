"""Hierarchical residual best-fit packing of documents into token sequences.

Pieces are dealt over leaves of a tree, each leaf packs its pieces best-fit
decreasing, and bins that are nearly full are final. A leaf's other bins
become items for its parent, which packs the items of its children best-fit
in turn, until the root. A node passes on a bounded number of its least full
bins and finishes the rest, so no task's input grows with the corpus.

That bound costs no sequence. Best fit opens a bin only for an item that no
open bin has room for, so at most one bin of a node is at most half full: a
second one would have gone into the first. Two bins of over half never share a
sequence. A parent can thus only join the one such bin of each child, whose
number is fan, with a bin each; the carry least full bins of a node hold its
half-full one and carry - 1 partners, far more than the fan that can be used.
The best partners are the fullest that still have room: to leave these out
changes how full the joined bins get, not how many remain, as long as carry is
at least fan.

Null or empty text: one piece, of the end id alone. Null doc_id: stays null.
Empty table: no rows. Repeated rows, and rows of one doc_id, are packed as
often as they occur. Very long texts are encoded a few million characters at
a time and cut. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, text_or_empty
from .tokens import encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
BINS = "doc_id long, piece int, start long, length long, ids_crc32 long, node long, bin long, offset long, final boolean"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids; deal is a number spread evenly over all pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(tokenizer_path), 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = enc.encode(part.column("text"))
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                bounds = offsets + np.arange(len(offsets))
                size = np.diff(bounds)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                first = bounds[doc] + start
                crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(first.tolist(), length.tolist(), strict=True)]
                order = np.arange(seen, seen + len(doc), dtype=np.uint64)
                seen += len(doc)
                # any number does; with the text's checksum in it, parts of the table don't march in step
                deal = ((order * np.uint64(0x9E3779B97F4A7C15)) ^ (np.array(crc, np.uint64) << np.uint64(20))) >> np.uint64(2)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(deal.astype(np.int64))], names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: the largest first, each into the fullest bin that holds it."""
    bins = np.empty(len(sizes), np.int64)
    offsets = np.empty(len(sizes), np.int64)
    at_room: dict[int, list[int]] = {}
    rooms, opened = 0, 0  # rooms: a bit for each room that some bin has
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            held = at_room[room]
            b = held.pop()
            if not held:
                rooms &= ~(1 << room)
        else:
            room, b, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            at_room.setdefault(room - size, []).append(b)
            rooms |= 1 << (room - size)
    return bins, offsets


def _packer(capacity: int, least: int, carry: int | None, fan: int):
    """Packs one node's rows. carry: most bins to pass on, None at the root."""

    def pack(table: pa.Table) -> pa.Table:
        n = table.num_rows
        old = np.lexsort((table["offset"].to_numpy(), table["bin"].to_numpy()))
        table = table.take(pa.array(old))
        item = np.concatenate([[0], np.cumsum(np.diff(table["bin"].to_numpy()) != 0)]) if n else np.zeros(0, np.int64)
        sizes = np.bincount(item, weights=table["length"].to_numpy()).astype(np.int64)
        bins, base = best_fit(sizes, capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        final = fill >= least
        if carry is None:
            final[:] = True
        elif (~final).sum() > carry:
            order = np.argsort(np.where(final, capacity + 1, fill), kind="stable")
            final[order[carry:]] = True
        node = table["node"].to_numpy()
        number = (node << 24) | bins[item]
        return pa.table(
            {
                "doc_id": table["doc_id"], "piece": table["piece"], "start": table["start"], "length": table["length"], "ids_crc32": table["ids_crc32"],
                "node": pa.array(node // fan), "bin": pa.array(number), "offset": pa.array(table["offset"].to_numpy() + base[item]), "final": pa.array(final[bins[item]]),
            }
        )

    return pack


def pack_pieces(pieces: DataFrame, capacity: int, leaf_pieces: int = 20_000, fan: int = 16, least: int | None = None, carry: int = 2_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    leaf_pieces: about so many go to a leaf. fan: children of a node. least:
    a bin of so many ids is final (default: 1/256 short of full). carry: most
    bins that a node passes on. At the root every bin is final.
    """
    least = capacity - capacity // 256 if least is None else least
    nodes = max(1, -(-pieces.count() // leaf_pieces))
    state = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.pmod("deal", F.lit(nodes)).alias("node"), F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("offset"))
    done: DataFrame | None = None
    level = 0
    while True:
        root = nodes == 1
        packed = state.groupBy("node").applyInArrow(_packer(capacity, least, None if root else carry, fan), BINS)
        packed = materialise(packed, f"bins-{level}")
        final = packed.filter("final").select("doc_id", "piece", "start", "length", "ids_crc32", (F.lit(level) * F.lit(1 << 58) + F.col("bin")).alias("sequence_id"), "offset")
        done = final if done is None else done.unionByName(final)
        if root:
            return done
        state = packed.filter("NOT final").drop("final")
        nodes, level = -(-nodes // fan), level + 1


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """Tokenizes documents, cuts those longer than a sequence, and packs the pieces."""
    pieces = materialise(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    return pack_pieces(pieces, capacity, **options)
