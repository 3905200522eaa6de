"""A factorisation machine for text quality.

Features: hashed words by their share of the text, statistics of its structure
and length, and numbers of the row's metadata, both in steps of the training
rows' quantiles. The score of features x is the logistic function of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

which takes time linear in the features. It is trained on a bounded number of
labelled rows, and scores every row of whole texts.

Null or empty text: no words, statistics of zero, and a score like any other.
Null or NaN metadata: a feature of their own. Labels, language, source and
doc_id are no inputs. Null doc_id: scored, never trained on. Repeated rows and
ties score alike. Empty table: no rows; no labelled rows: every score is one
half. Rows whose label is null aren't trained on. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty
from .tokens import slices

BUCKETS = 4096
STEPS = 12
#: Classes of bytes: other, lower, upper, digit, white, newline, symbol, other punctuation, beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _group, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 11, 12, 13, 32), (10,), b"#*$%&|<>", b"!?.,;:'\"()-_/\\@+=[]{}^~`", range(128, 256)), 1):
    _CLASS[list(_bytes)] = _group
_CLASSES = 9
STATISTICS = ("bytes", "words", "word_bytes", "lines", "line_words", "lower", "upper", "digit", "symbol", "punctuation", "beyond", "distinct_words", "top_word", "repeated_lines", "marked_words", "shouted_words")


@dataclass
class Features:
    row: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    statistics: np.ndarray  # one row a text


def extract(texts: pa.Array, metadata: Sequence[pa.Array] = ()) -> Features:
    """Hashed words (value: square root of the share, so rows have length 1) and statistics of each text; of metadata, logarithm and whether there is any."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    split = pc.ascii_split_whitespace(texts)
    coded = split.values.dictionary_encode()
    words = coded.dictionary
    bytes_of = pc.binary_length(words).to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    hashed = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)
    at = coded.indices.to_numpy()
    row = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
    full = bytes_of[at] > 0 if len(at) else np.zeros(0, bool)
    at, row = at[full], row[full]
    count = np.bincount(row, minlength=n)
    some = np.maximum(count, 1)
    keys, uses = np.unique(row * BUCKETS + (hashed[at] % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    owner = keys // BUCKETS
    value = np.sqrt(uses / some[owner]).astype(np.float32)

    pairs, times = np.unique(row * np.int64(max(1, len(words))) + at, return_counts=True)
    of = pairs // max(1, len(words))
    distinct = np.bincount(of, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, of, times)
    flags = lambda pattern: pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False).astype(float) if len(words) else np.zeros(0)
    marked = np.bincount(row, weights=flags(r"[#*$%&|<>!]")[at], minlength=n)
    shouted = np.bincount(row, weights=flags(r"^\P{Ll}*\p{Lu}\P{Ll}*\p{Lu}\P{Ll}*$")[at], minlength=n)

    raw = texts.buffers()[2]
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    size = np.diff(ends)
    kinds = np.bincount(np.repeat(np.arange(n) * _CLASSES, size) + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    lines = pc.split_pattern(texts, "\n")
    line = lines.values.dictionary_encode().indices.to_numpy()
    line_row = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    n_lines = np.maximum(np.bincount(line_row, minlength=n), 1)
    different = np.bincount(np.unique(line_row * np.int64(len(line) + 1) + line) // (len(line) + 1), minlength=n)
    share = kinds / np.maximum(size, 1)[:, None]
    statistics = np.stack(
        [
            np.log1p(size), np.log1p(count), np.bincount(row, weights=bytes_of[at], minlength=n) / some, np.log1p(n_lines), np.log1p(count / n_lines),
            share[:, 1], share[:, 2], share[:, 3], share[:, 6], share[:, 7], share[:, 8], distinct / some, top / some, 1 - np.maximum(different, 1) / n_lines, marked / some, shouted / some,
        ],
        axis=1,
    )
    more = []
    for column in metadata:
        x = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        known = np.isfinite(x)
        x = np.where(known, x, 0.0)
        more += [np.sign(x) * np.log1p(np.abs(x)), known.astype(float)]
    return Features(owner, keys % BUCKETS, value, np.column_stack([statistics, *more]).astype(np.float32))


@dataclass
class Machine:
    edges: np.ndarray  # statistics and metadata x steps
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def inputs(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value) sorted by row."""
        n, s = f.statistics.shape
        step = np.stack([np.searchsorted(self.edges[k], f.statistics[:, k], side="right") for k in range(s)], axis=1) if n else np.zeros((0, s), int)
        dense = BUCKETS + np.arange(s) * (STEPS + 1) + step
        row = np.concatenate([f.row, np.repeat(np.arange(n), s)])
        feature = np.concatenate([f.bucket, dense.reshape(-1)])
        value = np.concatenate([f.value, np.full(n * s, 1 / np.sqrt(s), np.float32)])
        order = np.argsort(row, kind="stable")
        return row[order], feature[order], value[order]

    def margins(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the sums of v x. Each row has features."""
        if not n:
            return np.zeros(0), np.zeros((0, self.factors.shape[1]))
        begin = np.searchsorted(row, np.arange(n))
        vx = self.factors[feature] * value[:, None]
        total = np.add.reduceat(vx, begin, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), begin)
        return self.bias + np.add.reduceat(self.weights[feature] * value, begin) + 0.5 * ((total * total).sum(axis=1) - squares), total

    def score(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.inputs(f), len(f.statistics))[0], -30, 30).astype(np.float64)))


def train(f: Features, label: np.ndarray, factors: int = 8, steps: int = 1000, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """By stochastic gradients with a step size for each parameter (Adagrad)."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + f.statistics.shape[1] * (STEPS + 1)
    if not len(label):
        return Machine(np.zeros((f.statistics.shape[1], STEPS), np.float32), 0.0, np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
    edges = np.quantile(f.statistics, np.arange(1, STEPS + 1) / (STEPS + 1), axis=0).T.astype(np.float32)
    share = np.clip(label.mean(), 0.01, 0.99)
    m = Machine(edges, float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.05, (size, factors)).astype(np.float32))
    row, feature, value = m.inputs(f)
    begin = np.searchsorted(row, np.arange(len(label) + 1))
    seen_w, seen_v = np.full(size, 1e-3, np.float32), np.full((size, factors), 1e-3, np.float32)
    per_pass = max(1, len(label) // batch)
    for _ in range(-(-steps // per_pass)):
        for rows in np.array_split(rng.permutation(len(label)), per_pass):
            n = begin[rows + 1] - begin[rows]
            at = np.arange(n.sum()) + np.repeat(begin[rows] - (np.cumsum(n) - n), n)
            r, i, x = np.repeat(np.arange(len(rows)), n), feature[at], value[at]
            z, total = m.margins(r, i, x, len(rows))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) / len(rows)
            m.bias -= rate * float(error.sum())
            g = np.bincount(i, weights=error[r] * x, minlength=size).astype(np.float32)
            hit = np.unique(i)
            pull = (error[r] * x)[:, None] * (total[r] - m.factors[i] * x[:, None])
            gv = np.stack([np.bincount(i, weights=pull[:, k], minlength=size) for k in range(factors)], axis=1).astype(np.float32)
            g[hit] += decay * m.weights[hit]
            gv[hit] += decay * m.factors[hit]
            seen_w[hit] += g[hit] ** 2
            seen_v[hit] += gv[hit] ** 2
            m.weights[hit] -= rate * g[hit] / np.sqrt(seen_w[hit])
            m.factors[hit] -= rate * gv[hit] / np.sqrt(seen_v[hit])
    return m


def _inputs(docs: DataFrame, metadata: Sequence[str]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *(F.col(f"`{c}`").cast("double").alias(f"m{k}") for k, c in enumerate(metadata)))


def fit(docs: DataFrame, labels: DataFrame, label: str, most_rows: int = 6_000, metadata: Sequence[str] = ()) -> Machine:
    """Trains on at most most_rows labelled rows, those of the lowest hash of doc_id; labels(doc_id, label). metadata: columns of numbers."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_rows)
    rows = _inputs(docs, metadata).join(F.broadcast(some), "doc_id")
    width, names = len(STATISTICS) + 2 * len(metadata), [f"m{k}" for k in range(len(metadata))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                f, n = extract(part.column("text"), [part.column(c) for c in names]), part.num_rows
                lists = pa.array(np.searchsorted(f.row, np.arange(n + 1)).astype(np.int32))
                statistics = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(f.statistics.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.ListArray.from_arrays(lists, pa.array(f.bucket.astype(np.int32))), pa.ListArray.from_arrays(lists, pa.array(f.value)), statistics], names=["doc_id", "y", "bucket", "value", "statistics"])

    # repeated documents add no more than the bound again
    table = rows.mapInArrow(run, "doc_id long, y double, bucket array<int>, value array<float>, statistics array<float>").orderBy("doc_id", "y").limit(most_rows).toArrow()
    lists = table.column("bucket").combine_chunks()
    if not table.num_rows:
        return train(Features(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32), np.zeros((0, width), np.float32)), np.zeros(0))
    row = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy())
    f = Features(row, lists.flatten().to_numpy().astype(np.int64), table.column("value").combine_chunks().flatten().to_numpy(), table.column("statistics").combine_chunks().flatten().to_numpy().reshape(-1, width))
    return train(f, table.column("y").to_numpy())


def score_documents(docs: DataFrame, machine: Machine, metadata: Sequence[str] = ()) -> DataFrame:
    """doc_id, score of each row; metadata as in fit."""
    names = [f"m{k}" for k in range(len(metadata))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(machine.score(extract(part.column("text"), [part.column(c) for c in names])))], names=["doc_id", "score"])

    return _inputs(docs, metadata).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 6_000, metadata: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted; rows held out are never trained on."""
    machine = fit(docs, labels.filter(~held_out()), "quality", most_rows, metadata)
    return score_documents(docs, machine, metadata).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
