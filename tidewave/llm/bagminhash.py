"""Near duplicates by BagMinHash signatures of weighted word shingles.

A text is the multiset of its runs of five words (a shorter text: of all its
words). For each shingle and unit of weight a Poisson process throws points at
the registers of a signature; the weight axis is cut into dyadic levels, each
with a process of its own, and of a level that the weight only reaches into
the points above the weight are dropped. A register keeps its first point, so
two texts agree in a register with a chance of their weighted Jaccard
similarity. Points later than any register needs are never drawn.

Equal texts form one node. Bands of registers make candidates of nodes; these
are linked where the exact weighted Jaccard similarity of their multisets is
at least the threshold, and classes are the connected components of links:

1. in each bucket every node is compared with the bucket's lowest and highest;
2. components are found;
3. in buckets that still hold several components, nodes are compared across
   components in blocks: those that the signatures allow, by a margin that a
   pair at the threshold misses with a chance of 2e-8. A pair is
   looked at in the first band that it shares, nodes that a link has brought
   together are not compared further, and a block returns such links alone.

Null, empty or white text: no shingles; equal texts share a class, others of
this kind don't. Null doc_id: counts as the lowest. Repeated rows and ties
share a class. Empty table: no rows. Other columns, whatever their names, are
not read by near_duplicates and pass through drop_near_duplicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, mix, text_or_empty
from .tokens import slices

BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
#: Standard deviations that an estimate may lie below the threshold.
MARGIN = 5.5
#: Most nodes, and about the most shingles, of one side of a block.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: About the most bytes of texts, and nodes, that are verified against one node in a part.
PART_BYTES, PART = 2_000_000, 512
_U = np.uint64


def shingles(texts: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's place, 64-bit hash, weight) of each distinct shingle of each text, sorted by the first two."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = split.values.dictionary_encode()
    hashed = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False) if len(coded.dictionary) else np.zeros(0, _U)
    at = coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    full = (pc.binary_length(coded.dictionary).to_numpy() > 0)[at] if len(at) else np.zeros(0, bool)
    w, doc = hashed[at][full], doc[full]
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    # a shingle starts at each word with enough words after it, or at a short text's first
    place = np.arange(len(w)) - first[doc]
    left = n[doc] - place
    starts = np.flatnonzero((left >= words) | ((n[doc] < words) & (place == 0)))
    size = np.minimum(left[starts], words)
    h = size.astype(_U)
    for k in range(words):
        inside = size > k
        h[inside] = mix(h[inside] * _U(0x9E3779B97F4A7C15) + w[starts[inside] + k])
    d = doc[starts]
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    cut = np.concatenate([[0], np.flatnonzero((d[1:] != d[:-1]) | (h[1:] != h[:-1])) + 1])
    return d[cut], h[cut], np.diff(np.concatenate([cut, [len(d)]]))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n rows of m registers of 32 bits. A text without shingles keeps zeros."""
    out = np.zeros((n, m), np.uint32)
    total = np.bincount(doc, weights=weight, minlength=n)
    # (0, 1], (1, 2], (2, 4] ...: an item for each level that a weight reaches into
    item, level = [np.arange(len(h))], [np.zeros(len(h), np.int64)]
    k = 1
    while (reach := np.flatnonzero(weight > 2 ** (k - 1))).size:
        item.append(reach)
        level.append(np.full(len(reach), k))
        k += 1
    items, levels = np.concatenate(item), np.concatenate(level)
    todo = np.flatnonzero(total > 0)
    horizon = math.log(m) + 3.0
    while len(todo):
        row = np.full(n, -1)
        row[todo] = np.arange(len(todo))
        mine = row[doc[items]] >= 0
        best = _first_points(row[doc[items[mine]]], h[items[mine]], levels[mine], weight[items[mine]], horizon / total[todo], len(todo), m)
        full = (best != _U(0xFFFFFFFFFFFFFFFF)).all(axis=1)
        out[todo[full]] = (best[full] & _U(0xFFFFFFFF)).astype(np.uint32)
        todo, horizon = todo[~full], horizon * 2
    return out


def _first_points(row: np.ndarray, h: np.ndarray, level: np.ndarray, weight: np.ndarray, limit: np.ndarray, n: int, m: int) -> np.ndarray:
    """Of all points up to each text's limit, the first in each register: its time in the upper half, its name in the lower."""
    best = np.full(n * m, 0xFFFFFFFFFFFFFFFF, _U)
    base = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, base)
    seed = mix(h + level.astype(_U) * _U(0x9E3779B97F4A7C15))
    t = np.zeros(len(row))
    j = 0
    while len(row):
        j += 1
        x = mix(seed + _U(j * 0xD1B54A32D192ED03 % (1 << 64)))
        t = t - np.log(((x >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)) / (m * width)
        live = t <= limit[row]
        row, seed, t, base, width, weight, x = row[live], seed[live], t[live], base[live], width[live], weight[live], x[live]
        y = mix(x ^ _U(0xA5A5A5A5A5A5A5A5))
        register = ((y >> _U(32)) * _U(m)) >> _U(32)
        place = base + width * ((y & _U(0xFFFFFFFF)).astype(np.float64) / (1 << 32))
        hit = place < weight
        time = (t[hit] / limit[row[hit]] * 4294967294.0).astype(_U)
        np.minimum.at(best, row[hit] * m + register[hit].astype(np.int64), (time << _U(32)) | (mix(y[hit]) & _U(0xFFFFFFFF)))
    return best.reshape(n, m)


def _node_key() -> Column:
    return F.unhex(F.md5(text_or_empty().cast("binary")))


def sign(docs: DataFrame) -> DataFrame:
    """key (128 bits of the text), id, weight (shingles in all), signature (registers as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                d, h, w = shingles(part.column("text"))
                n = part.num_rows
                sig = signatures(d, h, w, n).astype("<u4")
                total = np.bincount(d, weights=w, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("id"), pa.array(total), pa.array([s.tobytes() for s in sig], pa.binary())], names=["key", "id", "weight", "signature"])

    rows = docs.select(_node_key().alias("key"), F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "key binary, id long, weight long, signature binary")


def _band_keys(signature: pa.Array) -> np.ndarray:
    """A hash of each band of each signature."""
    sig = np.frombuffer(b"".join(signature.to_pylist()), "<u4").reshape(len(signature), BANDS, ROWS).astype(_U)
    h = np.broadcast_to(np.arange(BANDS, dtype=_U), sig.shape[:2])
    for k in range(ROWS):
        h = mix(h * _U(0x9E3779B97F4A7C15) + sig[:, :, k])
    return h.view(np.int64)


def _bands(nodes: DataFrame) -> DataFrame:
    """bucket, band, node: one row for each band of a node with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(_band_keys(batch.column("signature")).reshape(-1)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], names=["bucket", "band", "node"])

    return nodes.filter("weight > 0").select("node", "signature").mapInArrow(run, "bucket long, band int, node long")


def components(edges: DataFrame) -> DataFrame:
    """node, label of all nodes of edges(a, b): the least node of the component.

    Each round takes the least label among neighbours and then the label of
    that label; it ends when no label changes. All in joins and aggregations.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(seen, labels.node == seen.a).select("node", "label", F.least("label", "near").alias("next"))
        root = labels.select(F.col("node").alias("next"), F.col("label").alias("root"))
        after = materialise(step.join(root, "next").select("node", "label", F.least("next", "root").alias("next")), "labels")
        changed = after.filter("next <> label").limit(1).count()
        labels = after.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def similarity_to(one: pa.Array, texts: pa.Array) -> np.ndarray:
    """Exact similarity of the shingle multisets of one text and of each of the others; 0 where one has none."""
    _, known, weight = shingles(one)
    d, h, w = shingles(texts)
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    same = np.flatnonzero(known[at] == h) if len(known) else np.zeros(0, int)
    common = np.bincount(d[same], weights=np.minimum(w[same], weight[at[same]]), minlength=len(texts))
    return common / np.maximum(np.bincount(d, weights=w, minlength=len(texts)) + weight.sum() - common, 1)


def _verify(stars: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a < b of the pairs in stars(hub, node) whose texts(node, text, size) are similar.

    A hub's text goes once to each part of its nodes; parts have bounds in
    bytes and rows.
    """

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        hub, found = left["hub"][0].as_py(), []
        one = left["hub_text"].combine_chunks().slice(0, 1)
        for batch in right.select(["node", "text"]).combine_chunks().to_batches():
            for part in slices(batch, "text", PART_BYTES):
                found.append(part.column("node").filter(pa.array(similarity_to(one, part.column("text")) >= threshold)))
        node = pa.concat_arrays(found).to_numpy() if found else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.minimum(node, hub)), "b": pa.array(np.maximum(node, hub))})

    dealt = stars.join(texts.select("node", "size"), "node")
    parts = dealt.groupBy("hub").agg(F.greatest(F.ceil(F.sum("size") / PART_BYTES), F.ceil(F.count("*") / PART)).alias("parts"))
    # the sides of a cogroup must not share columns, so all are named anew
    node = dealt.join(parts, "hub").select(F.col("hub").alias("of"), F.pmod(F.xxhash64("node"), "parts").alias("part"), "node")
    right = node.join(texts.select("node", F.col("text").alias("text")), "node").select("of", F.col("part").alias("of_part"), F.col("node").alias("node"), "text")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = parts.withColumn("part", every).join(texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hub").select("hub", F.col("part").alias("hub_part"), "hub_text")
    return left.groupBy("hub", "hub_part").cogroup(right.groupBy("of", "of_part")).applyInArrow(_if_both(compare), "a long, b long").distinct()


def _if_both(compare):
    """compare, where a group has rows on both sides."""
    return lambda left, right: compare(left, right) if left.num_rows and right.num_rows else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def _across(members: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between components of nodes that share a bucket: enough of them to join what is linked.

    Only nodes outside the bucket's largest component are compared with the
    others. members(bucket, band, node).
    """
    m = members.join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("label", "node").alias("label"))
    m = materialise(m.join(nodes.select("node", "weight"), "node"), "members")
    by_label = m.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    sizes = by_label.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("labels"), F.max(F.struct("n", "label"))["label"].alias("top")).filter("labels > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES))
    rows = m.join(sizes.select("bucket", "top", blocks.alias("blocks")), "bucket").withColumn("mine", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.join(nodes.select("node", "signature"), "node").join(texts.select("node", "text"), "node")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    columns = ["band", "node", "label", "signature", "text"]
    build = rows.select("bucket", F.col("mine").alias("block"), every.alias("other"), *columns, F.lit(False).alias("probe"))
    probe = rows.filter("label <> top").select("bucket", every.alias("block"), F.col("mine").alias("other"), *columns, F.lit(True).alias("probe"))
    least = max(1, math.floor(REGISTERS * threshold - MARGIN * math.sqrt(REGISTERS * threshold * (1 - threshold))))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        root, node, is_probe = (table[c].to_numpy().copy() for c in ("label", "node", "probe"))
        a, b = [], []
        if is_probe.any() and not is_probe.all():
            signature = table["signature"].combine_chunks()
            sig = np.frombuffer(b"".join(signature.to_pylist()), "<u4").reshape(table.num_rows, REGISTERS)
            keys, band = _band_keys(signature), table["band"][0].as_py()
            doc, h, w = shingles(table["text"].combine_chunks())
            codes, code = np.unique(h, return_inverse=True)
            total = np.bincount(doc, weights=w, minlength=len(node))
            first = np.searchsorted(doc, np.arange(len(node) + 1))
            mine = np.zeros(len(codes), np.int64)
            there = np.flatnonzero(~is_probe)
            for i in np.flatnonzero(is_probe):
                left = there[root[there] != root[i]]
                left = left[(sig[left] == sig[i]).sum(axis=1) >= least]
                left = left[(keys[left] == keys[i]).argmax(axis=1) == band]
                if not len(left):
                    continue
                mine[code[first[i] : first[i + 1]]] = w[first[i] : first[i + 1]]
                n = first[left + 1] - first[left]
                at = np.arange(n.sum()) + np.repeat(first[left] - (np.cumsum(n) - n), n)
                common = np.bincount(np.repeat(np.arange(len(left)), n), weights=np.minimum(w[at], mine[code[at]]), minlength=len(left))
                mine[code[first[i] : first[i + 1]]] = 0
                for j in left[common / (total[left] + total[i] - common) >= threshold]:
                    if root[j] != root[i]:
                        a.append(min(node[i], node[j]))
                        b.append(max(node[i], node[j]))
                        root[root == root[j]] = root[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return build.unionByName(probe).groupBy("bucket", "block", "other").applyInArrow(compare, "a long, b long").distinct()


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """key, id of each row; key, id (the least of its rows), node, label of each node; and the links (a, b) that were verified."""
    signed = materialise(sign(docs), "signed")
    # doc_id null counts as the lowest
    one = signed.groupBy("key").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "weight", "signature")).alias("x"))
    nodes = materialise(one.select("key", F.monotonically_increasing_id().alias("node"), "x.id", "x.weight", "x.signature"), "nodes")
    bands = materialise(_bands(nodes), "bands")
    buckets = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).filter("n > 1")
    members = materialise(bands.join(buckets, "bucket"), "candidates")
    stars = members.select(F.col("low").alias("hub"), "node").union(members.select(F.col("high").alias("hub"), "node")).filter("hub <> node").distinct()
    involved = members.select("node").distinct().join(nodes.select("node", "key", "id"), "node")
    source = docs.select(_node_key().alias("key"), F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    same = (source["key"] == involved["key"]) & source["id"].eqNullSafe(involved["id"])
    texts = materialise(source.join(involved, same).select("node", "text", F.octet_length("text").cast("long").alias("size")).dropDuplicates(["node"]), "texts")
    links = materialise(_verify(materialise(stars, "stars"), texts, threshold), "links")
    labels = components(links)
    # up to three nodes have all been compared
    more = materialise(_across(members.filter("n > 3").select("bucket", "band", "node"), labels, nodes, texts, threshold), "more-links")
    if more.limit(1).count():
        # between components only: their labels are the nodes of a smaller graph
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
        joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).filter("a <> b")
        merged = components(joined).select(F.col("node").alias("label"), F.col("label").alias("merged"))
        alone = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
        labels = labels.unionByName(alone).join(merged, "label", "left").select("node", F.coalesce("merged", "label").alias("label"))
    classes = nodes.select("key", "node", "id").join(labels, "node", "left").select("key", "id", "node", F.coalesce("label", "node").alias("label"))
    return signed.select("key", "id"), materialise(classes, "classes"), links.unionByName(more)


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_number, n_links, linked_to of each row.

    n_links: the other texts that the row's text was compared with and found
    similar to; linked_to: the least doc_id of these. Such links join each
    class, and each can be checked; others inside a class are not looked for.
    Both say nothing of copies: these have the links of their text.
    """
    rows, classes, links = _classes(docs, threshold)
    # null counts as the lowest
    lowest = F.min(F.struct(F.col("id").isNotNull().alias("known"), "id"))
    least = classes.groupBy("label").agg(lowest.alias("least"))
    ends = links.union(links.select("b", "a")).toDF("node", "other")
    linked = ends.join(classes.select(F.col("node").alias("other"), "id"), "other").groupBy("node").agg(F.count("*").alias("n_links"), lowest.alias("near"))
    of_key = classes.join(least, "label").join(linked, "node", "left").select("key", F.col("least.id").alias("class_id"), F.col("label").alias("class_number"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.col("near.id").alias("linked_to"))
    return rows.join(of_key, "key").select(F.col("id").alias("doc_id"), "class_id", "class_number", "n_links", "linked_to")


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each class, of the least doc_id, with all columns.

    Of rows with that doc_id and one text the one whose other columns come
    first as text, one after the other, nulls last.
    """
    _, classes, _ = _classes(docs, threshold)
    least = classes.groupBy("label").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "key")).alias("least"))
    keep = least.select(F.col("least.key").alias("key"), _known("least.id").alias("id"))
    # the row is carried as one column, so its names can't clash with these
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    first = F.array(*(F.struct(c.isNull().alias("none"), c.cast("string").alias("value")) for c in others)) if others else F.lit("")
    rows = docs.select(_node_key().alias("key"), _known("doc_id").alias("id"), first.alias("first"), F.struct("*").alias("row"))
    return rows.join(keep, ["key", "id"]).groupBy("key", "id").agg(F.min_by("row", "first").alias("row")).select("row.*")


def _known(c: str) -> Column:
    """doc_id with null as the lowest number."""
    return F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
