"""Correlograms of all pairs of trains, by one range join, and measures on them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.timeline import as_of, in_parts, range_join

CELLS = 1 << 17  # counters that a task holds at once
PAIRS = 1 << 20  # pairs that a task looks at at once


def half_counts(df: DataFrame, width: int, half: int, same_unit: bool = False, most: int = 200_000) -> DataFrame:
    """u1, u2, bin, n: pairs of a spike of u1 and a later one of u2, by floor(gap / width) from 0 to half.

    Equal times are ordered by unit, then id. same_unit: autocorrelograms
    only, by a join on the unit and time; else by blocks of units (measured_pairs),
    of about most spikes.
    """
    if not same_unit:
        return measured_pairs(df, width, half, later_counts(half), "bin long, n long", most)
    left = df.select(F.col("unit").alias("u1"), F.col("t").alias("t1"), F.col("id").alias("i1"))
    right = df.select(F.col("unit").alias("u2"), F.col("t").alias("t2"), F.col("id").alias("i2"))
    pairs = range_join(left.withColumn("unit", F.col("u1")), right.withColumn("unit", F.col("u2")), (half + 1) * width, ["unit"])
    later = (F.col("t2") > F.col("t1")) | ((F.col("t2") == F.col("t1")) & (F.col("i2") > F.col("i1")))
    return pairs.filter(later).groupBy("u1", "u2", F.floor((F.col("t2") - F.col("t1")) / width).alias("bin")).agg(F.count("*").alias("n"))


@dataclass(eq=False)
class Pairs:
    """Pairs of units that a task has counted.

    k1, k2: how many spikes the units have, where that was asked for. n: a
    column for each pair; half + 1 rows of how many spikes of u2 are later than
    one of u1, by bins 0 to half, then as many of how many are earlier. other:
    the same pairs the other way round; held: what was worked out for these.
    """

    u1: pa.Array
    u2: pa.Array
    k1: np.ndarray
    k2: np.ndarray
    counts: np.ndarray | None = None
    other: Pairs | None = None
    held: dict = field(default_factory=dict)

    @property
    def n(self) -> np.ndarray:
        if self.counts is None:
            n = self.other.n
            self.counts = np.concatenate([n[len(n) // 2 :], n[: len(n) // 2]])
        return self.counts

    def total(self) -> np.ndarray:
        return (self.other or self).n.sum(axis=0)

    def mirrored(self) -> Pairs:
        return Pairs(self.u2, self.u1, self.k2, self.k1, other=self)

    def part(self, keep: np.ndarray) -> Pairs:
        """Some of the pairs, without their counts."""
        at = pa.array(np.flatnonzero(keep))
        return Pairs(self.u1.take(at), self.u2.take(at), self.k1[keep], self.k2[keep])

    def batch(self, rows: np.ndarray | None = None, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
        """u1 and u2 of the pairs at some rows, or of all, with further columns."""
        units = (self.u1, self.u2) if rows is None else (u.take(pa.array(rows)) for u in (self.u1, self.u2))
        return pa.RecordBatch.from_arrays([*units, *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values())], ["u1", "u2", *columns])


Measure = Callable[[Pairs], pa.RecordBatch]


def are(compared: pa.Array) -> np.ndarray:
    """A comparison of units, false where one is null."""
    return pc.fill_null(compared, False).to_numpy(zero_copy_only=False)


def _cells(df: DataFrame, reach: int, most: int, more: tuple[str, ...] = (), left: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, bool]:
    """_cell, _side, unit, t, id, more: the spikes of every two blocks of units, and whether pairs of units are in several cells.

    A cell has the left spikes of one block (_side odd) and the right ones of
    the other or the same (_side // 2 is the block), each two blocks in one
    order. A block is of units with about most spikes, so a spike is copied as
    often as there are blocks, which the spikes decide and not the units. Where
    a block has more than most, as a unit's spikes are in one, time is cut into
    stretches too, and a burst inside one into parts. left: other rows of the
    same units for the left side, with further columns, those to take where
    time isn't cut and those where it is; then two blocks meet in both orders.
    """
    rows = df.filter("t IS NOT NULL").select("unit", "t", "id", *more)
    total = rows.groupBy("unit").agg(F.count("*").alias("n")).agg(F.count("*").alias("units"), F.sum("n").alias("n")).first()
    # some cells for every core where spikes are few, too
    n = total.n or 0
    spread = min(-(-n // 1_000), int((8 * df.sparkSession.sparkContext.defaultParallelism) ** 0.5) + 1)
    blocks = max(1, min(total.units, max(-(-3 * n // (2 * most)), spread)))
    block = F.pmod(F.xxhash64("unit"), F.lit(blocks))
    full = rows.groupBy(block.alias("block")).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    ends = rows.agg(F.min("t").alias("a"), F.max("t").alias("b")).first() if full > most else None
    length = max(reach, (ends.b - ends.a) * most // full + 1) if ends else None
    stretch = lambda t: F.floor(t / length) if length else F.lit(0).cast("long")
    cell = lambda s, a, b: (s * blocks + a) * blocks + b
    side = (F.col("_own") * 2).cast("int")
    zero, final = F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")
    first = rows if left is None else left[1 if length else 0].filter("t IS NOT NULL")
    a = first.withColumn("_own", block).withColumn("_other", F.explode(F.sequence(F.col("_own") if left is None else zero, final)))
    a = a.select(cell(stretch(F.col("t")), F.col("_own"), F.col("_other")).alias("_cell"), (side + 1).alias("_side"), *first.columns)
    # the other spike may be of the next stretch
    reached = F.array_distinct(F.array(*(stretch(F.col("t") + o) for o in (1 - reach, 0, reach - 1)))) if length else F.array(F.lit(0).cast("long"))
    b = rows.withColumn("_own", block).withColumn("_other", F.explode(F.sequence(zero, F.col("_own") if left is None else final))).withColumn("_s", F.explode(reached))
    b = b.select(cell(F.col("_s"), F.col("_other"), F.col("_own")).alias("_cell"), side.alias("_side"), *rows.columns)
    if length:
        a, b = in_parts(a, b, "_cell", most)
    # few bytes make many pairs, so the number of tasks follows the cells: more, so that few of them share one
    tasks = min(2_000, max(3 * blocks * (blocks + 1) // (2 if left is None else 1), df.sparkSession.sparkContext.defaultParallelism))
    return a.unionByName(b, allowMissingColumns=True).repartition(tasks, "_cell"), length is not None


class Spikes(NamedTuple):
    """Spikes in time order: unit by a number from 0, and by its place among all units (-1: null)."""

    unit: np.ndarray
    place: np.ndarray
    t: np.ndarray
    id: np.ndarray
    more: list


class Block(NamedTuple):
    """Units of one side, in parts of so many: the places of each part's units in the dictionary, and its spikes."""

    number: int
    parts: list[tuple[np.ndarray, Spikes]]


def opened(cell: pa.Table, size: int, more: tuple[str, ...] = ()) -> tuple[pa.Array, Block, Block] | None:
    """A cell's units and its left and right block, in parts of size units; None where a side is empty."""
    # chunks share a dictionary, in which null is a unit
    code = cell.column("unit").combine_chunks().dictionary_encode(null_encoding="encode")
    units, code = code.dictionary, code.indices.to_numpy()
    place = np.empty(len(units), np.int64)
    place[pc.sort_indices(units).to_numpy()] = np.arange(len(units))
    place[units.is_null().to_numpy(zero_copy_only=False)] = -1
    side, t, number = (cell.column(c).to_numpy() for c in ("_side", "t", "id"))
    others = [cell.column(c).combine_chunks() for c in more]

    def block(odd: int) -> Block | None:
        rows = np.flatnonzero(side % 2 == odd)
        if not len(rows):
            return None
        which, unit = np.unique(code[rows], return_inverse=True)
        order = np.lexsort((t[rows], unit // size))
        rows, unit = rows[order], unit[order]
        ends = np.searchsorted(unit // size, np.arange(-(-len(which) // size) + 1))
        parts = []
        for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            r = rows[i:j]
            parts.append((which[k * size : (k + 1) * size], Spikes(unit[i:j] - k * size, place[code[r]], t[r], number[r], [c.take(pa.array(r)) for c in others])))
        return Block(int(side[rows[0]]) // 2, parts)

    left, right = block(1), block(0)
    return None if left is None or right is None else (units, left, right)


def _table(a: Spikes, b: Spikes, n1: int, n2: int, width: int, half: int) -> np.ndarray:
    """Pairs.n of each two units of both sides, those of a in the order of n1 by those of n2."""
    reach, pairs = (half + 1) * width, n1 * n2
    first = np.searchsorted(b.t, a.t - reach, side="right")
    size = np.searchsorted(b.t, a.t + reach) - first
    upto = np.cumsum(size)
    length = pairs * 2 * (half + 1)
    n = np.zeros(length + 1, np.int64)  # and one for those that are no pair
    base = a.unit * n2
    row = 0
    while row < len(size):  # whole left rows, about so many pairs at a time
        before = upto[row - 1] if row else 0
        last = max(row + 1, int(np.searchsorted(upto, before + PAIRS, side="right")))
        many = size[row:last]
        y = np.arange(upto[last - 1] - before)
        y += np.repeat(first[row:last] - (upto[row:last] - many - before), many)
        gap = b.t[y]
        gap -= np.repeat(a.t[row:last], many)
        key = np.abs(gap)
        key //= width
        key += (gap < 0) * (half + 1)
        key *= pairs
        key += np.repeat(base[row:last], many)
        key += b.unit[y]
        same = np.flatnonzero(gap == 0)
        if len(same):
            x, z = np.searchsorted(upto, same + before, side="right"), y[same]
            p, q, i, j = a.place[x], b.place[z], a.id[x], b.id[z]
            alike, known = p == q, (p >= 0) & (q >= 0)
            later = known & ((q > p) | (alike & (j > i)))
            earlier = known & ((q < p) | (alike & (j < i)))
            at = base[x] + b.unit[z]
            key[same] = np.where(later, at, np.where(earlier, at + (half + 1) * pairs, length))
        n += np.bincount(key, minlength=length + 1)
        row = last
    return n[:-1].reshape(-1, pairs)


def measured_pairs(df: DataFrame, width: int, half: int, measure: Measure, schema: str, most: int = 200_000, totals: bool = False) -> DataFrame:
    """What measure gives for all pairs of units with spikes in reach, (u1, u2) and (u2, u1) both; schema: that without u1 and u2.

    Among a measure's pairs there may be some of no spikes in reach.

    Every two blocks of units meet in a task, which counts their pairs of
    spikes in tables of bounded size and measures one before the next: what is
    shuffled are spikes, once for each block, and neither pairs nor counts.
    These are only summed where time is cut too. totals: with k1 and k2.
    """
    if totals:
        df = df.withColumn("_k", F.count("*").over(Window.partitionBy("unit"))).filter("unit IS NOT NULL")
    more = ("_k",) if totals else ()
    cells, cut = _cells(df, (half + 1) * width, most, more)
    slots = 2 * (half + 1)
    size = max(1, int((CELLS / slots) ** 0.5))
    kind = dict(df.dtypes)["unit"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[Pairs]:
        cell = opened(pa.Table.from_batches(list(batches)), size, more)
        if cell is None:
            return
        units, left, right = cell
        of = lambda x, s: np.zeros(len(x), np.int64) if not totals else _by_unit(s, len(x))
        for x, a in left.parts:
            for y, b in right.parts:
                n = _table(a, b, len(x), len(y), width, half)
                i, j = np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x))
                some = np.flatnonzero(n.any(axis=0))
                if cut or 2 * len(some) < n.shape[1]:  # else that costs more than it saves
                    i, j, n = i[some], j[some], n[:, some]
                if len(some):
                    found = Pairs(units.take(pa.array(x[i])), units.take(pa.array(y[j])), of(x, a)[i], of(y, b)[j], n)
                    yield found
                    if left.number != right.number:
                        yield found.mirrored()

    if not cut:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pairs in count(batches):
                out = measure(pairs)
                if out.num_rows:
                    yield out

        return cells.groupBy("_cell").applyInArrow(run, f"u1 {kind}, u2 {kind}, {schema}")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in count(batches):
            yield p.batch(k1=p.k1, k2=p.k2, n=lists(p.n))

    parts = cells.groupBy("_cell").applyInArrow(partial, f"u1 {kind}, u2 {kind}, k1 long, k2 long, n array<long>")
    return summed(parts, "n", slots, "k1", "k2").mapInArrow(lambda batches: (measure(pairs_of(b, slots)) for b in batches), f"u1 {kind}, u2 {kind}, {schema}")


def _by_unit(spikes: Spikes, units: int) -> np.ndarray:
    out = np.zeros(units, np.int64)
    out[spikes.unit] = spikes.more[0].to_numpy()
    return out


def summed(parts: DataFrame, name: str, size: int, *same: str) -> DataFrame:
    """u1, u2, same, name: a pair's arrays of one size, added up."""
    add = F.aggregate(F.collect_list(name), F.array_repeat(F.lit(0).cast("long"), size), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
    return parts.groupBy("u1", "u2").agg(*(F.max(c).alias(c) for c in same), add.alias(name))


def pairs_of(batch: pa.RecordBatch, slots: int) -> Pairs:
    n = batch.column("n").flatten().to_numpy().reshape(-1, slots).T
    return Pairs(batch.column("u1"), batch.column("u2"), batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), n)


def later_counts(half: int) -> Measure:
    """bin, n: later spikes of u2, by bins that have any."""

    def measure(p: Pairs) -> pa.RecordBatch:
        bins, pair = np.nonzero(p.n[: half + 1])
        return p.batch(pair, bin=bins, n=p.n[bins, pair])

    return measure


def full_counts(p: Pairs, half: int) -> np.ndarray:
    """Bins -half to half of each pair, a column: later spikes of u2 right of 0, of u1 left; bin 0 is the larger of both counts, and 0 for u1 = u2."""
    if "full" in p.held:
        return p.held["full"]
    if p.other is not None:
        return full_counts(p.other, half)[::-1]
    after, before = p.n[: half + 1], p.n[half + 1 :]
    middle = np.where(are(pc.not_equal(p.u1, p.u2)), np.maximum(after[0], before[0]), 0)
    p.held["full"] = np.concatenate([before[:0:-1], middle[None, :], after[1:]])
    return p.held["full"]


def with_any(p: Pairs, half: int) -> tuple[Pairs, np.ndarray]:
    """The pairs whose full counts are not all 0, and these."""
    full = full_counts(p, half)
    some = full.any(axis=0)
    return (p, full) if some.all() else (p.part(some), full[:, some])


def lists(columns: np.ndarray) -> pa.Array:
    """A list of each column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(columns.shape[1] + 1, dtype=np.int32) * len(columns)), pa.array(np.ascontiguousarray(columns.T).ravel()))


def symmetric_arrays(df: DataFrame, width: int, half: int, most: int = 200_000) -> DataFrame:
    """u1, u2, counts: dense_bins of symmetric of half_counts, the bins of a pair in an array; by blocks of units."""

    def measure(p: Pairs) -> pa.RecordBatch:
        p, full = with_any(p, half)
        return p.batch(counts=lists(full))

    return measured_pairs(df, width, half, measure, "counts array<long>", most)


def symmetric_counts(df: DataFrame, width: int, half: int) -> DataFrame:
    """u1, u2, bin, n: symmetric of half_counts, by blocks of units."""

    def measure(p: Pairs) -> pa.RecordBatch:
        full = full_counts(p, half)
        bins, pair = np.nonzero(full)
        return p.batch(pair, bin=bins - half, n=full[bins, pair])

    return measured_pairs(df, width, half, measure, "bin long, n long")


def outer_bins(half: int, share: float = 0.8) -> np.ndarray:
    """Whether each bin is one of those that edge_zscore compares with."""
    index = np.arange(2 * half + 1)
    return (index < int(len(index) * share / 2)) | (index >= int(len(index) * (1 - share / 2)))


def zscores(full: np.ndarray, half: int, share: float = 0.8, bins: slice = slice(None)) -> np.ndarray:
    """edge_zscore of some bins of correlograms, a column each: whole numbers up to the root, so that equal bins have no deviation."""
    base = full[outer_bins(half, share)]
    many, total = len(base), base.sum(axis=0)
    dev = np.sqrt((many * np.einsum("ij,ij->j", base, base) - total * total).astype(float)) / many
    z = full[bins] - total / many
    z /= np.where(dev == 0, 1.0, dev)
    return z


def zscored_bins(df: DataFrame, width: int, half: int) -> DataFrame:
    """u1, u2, bin, z: edge_zscore of every bin of all pairs, by blocks of units."""

    def measure(p: Pairs) -> pa.RecordBatch:
        p, full = with_any(p, half)
        pair = np.tile(np.arange(full.shape[1]), len(full))
        return p.batch(pair, bin=np.repeat(np.arange(-half, half + 1), full.shape[1]), z=zscores(full, half).ravel())

    return measured_pairs(df.filter("unit IS NOT NULL"), width, half, measure, "bin long, z double")


def zscore_synchrony(df: DataFrame, width: int, half: int, reach: int) -> DataFrame:
    """u1, u2, synchrony: synchrony of edge_zscore, by blocks of units."""

    def measure(p: Pairs) -> pa.RecordBatch:
        p, full = with_any(p, half)
        return p.batch(synchrony=zscores(full, half, bins=slice(half - reach, half + reach + 1)).mean(axis=0))

    return measured_pairs(df.filter("unit IS NOT NULL"), width, half, measure, "synchrony double")


def ratio_synchrony(df: DataFrame, width: int, half: int, reach: int, share: float = 0.4) -> DataFrame:
    """u1, u2, ratio: synchrony_ratio where it isn't null, by blocks of units."""
    size = 2 * half + 1
    index = np.arange(size)
    outer = (index < int(size * share / 2)) | (index >= int(size * (1 - share) / 2))

    def measure(p: Pairs) -> pa.RecordBatch:
        full = full_counts(p, half)
        base, near = full[outer].sum(axis=0), full[half - reach : half + reach + 1].sum(axis=0)
        some = np.flatnonzero(base)
        return p.batch(some, ratio=(near[some] / (2 * reach + 1)) / (base[some] / outer.sum()))

    return measured_pairs(df.filter("unit IS NOT NULL"), width, half, measure, "ratio double")


def central_over_chance(df: DataFrame, width: int, half: int, reach: int, share: float) -> DataFrame:
    """u1, u2, dp, covariance: central_mean of both of over_chance, by blocks of units. share: a bin's of the recording."""

    def measure(p: Pairs) -> pa.RecordBatch:
        p, full = with_any(p, half)
        dp = full[half - reach : half + reach + 1] / p.k1 - p.k2 * share
        return p.batch(dp=dp.mean(axis=0), covariance=(dp * p.k1 * share).mean(axis=0))

    return measured_pairs(df, width, half, measure, "dp double, covariance double", totals=True)


def normalised(df: DataFrame, width: int, half: int, width_seconds: float) -> DataFrame:
    """u1, u2, bin, n, hertz (n / (n1 width)), pearson (n / sqrt(n1 n2)) of half_counts, by blocks of units."""

    def measure(p: Pairs) -> pa.RecordBatch:
        bins, pair = np.nonzero(p.n[: half + 1])
        n = p.n[bins, pair]
        return p.batch(pair, bin=bins, n=n, hertz=n / (p.k1[pair] * width_seconds), pearson=n / np.sqrt((p.k1 * p.k2)[pair].astype(float)))

    return measured_pairs(df, width, half, measure, "bin long, n long, hertz double, pearson double", totals=True)


def array_zscores(arrays: DataFrame, half: int, share: float = 0.8) -> DataFrame:
    """u1, u2, counts, z: edge_zscore of the arrays of symmetric_arrays."""
    size = 2 * half + 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = zscores(batch.column("counts").flatten().to_numpy().reshape(-1, size).T, half, share)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("u1", "u2", "counts")), lists(z)], ["u1", "u2", "counts", "z"])

    kind = dict(arrays.dtypes)["u1"]
    return arrays.select("u1", "u2", "counts").mapInArrow(score, f"u1 {kind}, u2 {kind}, counts array<long>, z array<double>")


class Runs(NamedTuple):
    """Runs of bins on one side; best, at, end: the value of largest size, and the first and the last bin with it."""

    pair: np.ndarray
    side: np.ndarray
    first: np.ndarray
    last: np.ndarray
    best: np.ndarray
    at: np.ndarray
    end: np.ndarray
    height: np.ndarray
    power: np.ndarray

    def part(self, keep: np.ndarray) -> Runs:
        return Runs(*(x[keep] for x in self))

    def mirrored(self) -> Runs:
        return self._replace(first=-self.last, last=-self.first, at=-self.end, end=-self.at)


def runs_of(side: np.ndarray, value: np.ndarray, least: int, half: int, ends: bool = True) -> Runs:
    """Runs of least bins or more of side (1, -1, 0: none; bins by pairs) with their mean value and mean square; ends: also those that touch one."""
    size, count = side.shape
    flat = np.zeros((count, size + 1), np.int8)  # no run goes on in the next pair
    flat[:, :size] = side.T
    flat = flat.ravel()
    on = flat != 0
    turn = flat[1:] != flat[:-1]
    start = np.flatnonzero(on & np.concatenate([[True], turn]))
    stop = np.flatnonzero(on & np.concatenate([turn, [True]]))
    keep = stop - start + 1 >= least
    if not ends:
        keep &= (start % (size + 1) > 0) & (stop % (size + 1) < size - 1)
    start, stop = start[keep], stop[keep]
    length = stop - start + 1
    begin = np.cumsum(length) - length
    cell = np.repeat(start - begin, length) + np.arange(length.sum())
    x = value[cell % (size + 1), cell // (size + 1)]
    if not len(start):
        none = np.zeros(0)
        return Runs(start, flat[start].astype(np.int32), start, start, none, start, start, none, none)
    large = np.where(np.isnan(x), -1.0, np.abs(x))
    top = np.flatnonzero(large == np.repeat(np.maximum.reduceat(large, begin), length))
    top, bottom = top[np.searchsorted(top, begin)], top[np.searchsorted(top, begin + length) - 1]
    mean = lambda v: np.add.reduceat(v, begin) / length
    place = lambda k: k % (size + 1) - half
    return Runs(start // (size + 1), flat[start].astype(np.int32), place(start), place(stop), x[top], place(cell[top]), place(cell[bottom]), mean(x), mean(x * x))


def mirrored_runs(p: Pairs, of: Callable[[Pairs], Runs]) -> Runs:
    """of pairs that are the same either way round, worked out once for both."""
    if p.other is not None:
        return mirrored_runs(p.other, of).mirrored()
    if "runs" not in p.held:
        p.held["runs"] = of(p)
    return p.held["runs"]


def zscore_runs(p: Pairs, half: int, threshold: float, least: int, ends: bool = True) -> Runs:
    """Runs of bins at least a threshold, above 0, of deviations off."""

    def of(p: Pairs) -> Runs:
        z = zscores(full_counts(p, half), half)
        return runs_of((z >= threshold).astype(np.int8) - (z <= -threshold), z, least, half, ends)

    outer = outer_bins(half)
    return mirrored_runs(p, of) if (outer == outer[::-1]).all() else of(p)


def modulations(df: DataFrame, width: int, half: int, threshold: float, least: int) -> DataFrame:
    """u1, u2, first, last, n, amplitude, at: models.modulations of edge_zscore, by blocks of units."""

    def measure(p: Pairs) -> pa.RecordBatch:
        r = zscore_runs(p, half, threshold, least)
        return p.batch(r.pair, first=r.first, last=r.last, n=r.last - r.first + 1, amplitude=r.best, at=r.at)

    return measured_pairs(df.filter("unit IS NOT NULL"), width, half, measure, "first long, last long, n long, amplitude double, at long")


def largest_modulations(df: DataFrame, width: int, half: int, threshold: float, least: int) -> DataFrame:
    """u1, u2, first, last, amplitude: of each pair's modulations that of the largest amplitude, the first of equals."""

    def measure(p: Pairs) -> pa.RecordBatch:
        r = zscore_runs(p, half, threshold, least)
        r = r.part(np.lexsort((r.first, -np.abs(r.best), r.pair)))
        r = r.part(np.diff(r.pair, prepend=-1) != 0)
        return p.batch(r.pair, first=r.first, last=r.last, amplitude=r.best)

    return measured_pairs(df.filter("unit IS NOT NULL"), width, half, measure, "first long, last long, amplitude double")


def side_runs(arrays: DataFrame, half: int, threshold: float) -> DataFrame:
    """u1, u2, bin, z, side, run: the bins of arrays(u1, u2, z) beyond the threshold (side 1 or -1), and the first bin of the run of one side that each is in."""
    size = 2 * half + 1

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = batch.column("z").flatten().to_numpy().reshape(-1, size)
            side = (z >= threshold).astype(np.int32) - (z <= -threshold)
            begins = np.ones(z.shape, bool)
            begins[:, 1:] = side[:, 1:] != side[:, :-1]
            run = np.maximum.accumulate(np.where(begins, np.arange(size), 0), axis=1)
            row, place = np.nonzero(side)
            at = pa.array(row)
            values = [place - half, z[row, place], side[row, place].astype(np.int32), run[row, place] - half]
            yield pa.RecordBatch.from_arrays([batch.column("u1").take(at), batch.column("u2").take(at), *map(pa.array, values)], ["u1", "u2", "bin", "z", "side", "run"])

    kind = dict(arrays.dtypes)["u1"]
    return arrays.select("u1", "u2", "z").mapInArrow(mark, f"u1 {kind}, u2 {kind}, bin long, z double, side int, run long")


def array_mean(of: Callable[[Column], Column], column: str, places: Iterable[int]) -> Column:
    """The mean of a function of an array's elements at some places."""
    places = list(places)
    return sum((of(F.get(column, F.lit(i))) for i in places), F.lit(0.0)) / len(places)


def array_ratio(arrays: DataFrame, half: int, reach: int, share: float = 0.4) -> DataFrame:
    """synchrony_ratio of symmetric_arrays."""
    size = 2 * half + 1
    base = [i for i in range(size) if i < int(size * share / 2) or i >= int(size * (1 - share) / 2)]
    near, rest = (array_mean(lambda x: x, "counts", p) for p in (range(half - reach, half + reach + 1), base))
    return arrays.select("u1", "u2", F.try_divide(near, rest).alias("ratio"))


def exploded(arrays: DataFrame, half: int, whole: bool = False) -> DataFrame:
    """u1, u2, bin, n and z, if there is one: a row for each bin; whole: with the array of counts in each."""
    names = {"counts": "n", "z": "z"}
    has = [c for c in names if c in arrays.columns]
    kept = ["u1", "u2", *(["counts"] if whole else [])]
    rows = arrays.select(*kept, F.posexplode(F.arrays_zip(*has)).alias("_i", "_x"))
    return rows.select(*kept, (F.col("_i") - half).cast("long").alias("bin"), *(F.col("_x")[c].alias(names[c]) for c in has))


def symmetric(half: DataFrame) -> DataFrame:
    """Bins -half to half: later spikes of u2 right of 0, of u1 left; bin 0 is the larger of both counts, and 0 for u1 = u2."""
    mirrored = half.select(F.col("u2").alias("u1"), F.col("u1").alias("u2"), (-F.col("bin")).alias("bin"), "n")
    full = half.unionByName(mirrored).groupBy("u1", "u2", "bin").agg(F.max("n").alias("n"))
    return full.filter((F.col("u1") != F.col("u2")) | (F.col("bin") != 0))


def dense_bins(full: DataFrame, half: int) -> DataFrame:
    """Every bin of every pair that has any."""
    grid = full.select("u1", "u2").distinct().withColumn("bin", F.explode(F.sequence(F.lit(-half).cast("long"), F.lit(half).cast("long"))))
    return grid.join(full, ["u1", "u2", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def edge_zscore(dense_full: DataFrame, half: int, share: float = 0.8) -> DataFrame:
    """Adds z: against mean and population deviation of the outer bins (deviation 0: 1)."""
    size = 2 * half + 1
    index = F.col("bin") + half
    outer = (index < int(size * share / 2)) | (index >= int(size * (1 - share / 2)))
    w = Window.partitionBy("u1", "u2")
    mean = F.avg(F.when(outer, F.col("n"))).over(w)
    dev = F.stddev_pop(F.when(outer, F.col("n"))).over(w)
    return dense_full.withColumn("z", (F.col("n") - mean) / F.when(dev == 0, 1.0).otherwise(dev))


def synchrony(z: DataFrame, reach: int) -> DataFrame:
    """Mean z of the bins within reach of 0."""
    return z.filter(F.abs("bin") <= reach).groupBy("u1", "u2").agg(F.avg("z").alias("synchrony"))


def synchrony_ratio(dense_full: DataFrame, half: int, reach: int, share: float = 0.4) -> DataFrame:
    """u1, u2, ratio: mean count of the bins within reach of 0 over that of a baseline: the bins before a part share / 2 of all, and those from a part (1 - share) / 2 on."""
    size = 2 * half + 1
    index = F.col("bin") + half
    base = (index < int(size * share / 2)) | (index >= int(size * (1 - share) / 2))
    means = dense_full.groupBy("u1", "u2").agg(F.avg(F.when(F.abs("bin") <= reach, F.col("n"))).alias("_s"), F.avg(F.when(base, F.col("n"))).alias("_b"))
    return means.select("u1", "u2", F.try_divide("_s", "_b").alias("ratio"))


def over_chance(dense_full: DataFrame, counts: DataFrame, width: float, length: float) -> DataFrame:
    """Adds dp (spikes of u2 for each of u1, less what its mean rate gives) and covariance (dp times u1's spikes in a bin). counts: unit, total."""
    a = counts.select(F.col("unit").alias("u1"), F.col("total").alias("n1"))
    b = counts.select(F.col("unit").alias("u2"), F.col("total").alias("n2"))
    out = dense_full.join(a, "u1").join(b, "u2").withColumn("dp", F.col("n") / F.col("n1") - F.col("n2") * F.lit(width / length))
    return out.withColumn("covariance", F.col("dp") * F.col("n1") * F.lit(width / length))


def central_mean(df: DataFrame, value: str, reach: int) -> DataFrame:
    """u1, u2, mean of a value of the bins within reach of 0."""
    return df.filter(F.abs("bin") <= reach).groupBy("u1", "u2").agg(F.avg(value).alias("mean"))


def by_reference(df1: DataFrame, df2: DataFrame, width: int, half: int) -> DataFrame:
    """id, bin, n: for each spike of df1 the spikes of df2 after it, same unit."""
    left = df1.select("unit", "id", F.col("t").alias("t1"))
    right = df2.select("unit", F.col("t").alias("t2"))
    return range_join(left, right, (half + 1) * width, ["unit"]).groupBy("id", F.floor((F.col("t2") - F.col("t1")) / width).alias("bin")).agg(F.count("*").alias("n"))


def near_pairs(df: DataFrame, dt: int, most: int = 200_000) -> DataFrame:
    """u1 < u2, pairs: how many of their spikes are at most dt apart; by blocks of units."""

    def measure(p: Pairs) -> pa.RecordBatch:
        n = p.total()
        rows = np.flatnonzero(are(pc.less(p.u1, p.u2)) & (n > 0))
        return p.batch(rows, pairs=n[rows])

    return measured_pairs(df.select("unit", "t", F.lit(0).alias("id")), dt + 1, 0, measure, "pairs long", most)


def correlation_index(df: DataFrame, dt: int, length: int) -> DataFrame:
    """u1 < u2, ci: pairs at most dt apart, over those that chance would give."""

    def measure(p: Pairs) -> pa.RecordBatch:
        n = p.total()
        rows = np.flatnonzero(are(pc.less(p.u1, p.u2)) & (n > 0))
        return p.batch(rows, ci=n[rows] * float(length) / (p.k1[rows] * p.k2[rows] * (2.0 * dt)))

    return measured_pairs(df.select("unit", "t", F.lit(0).alias("id")), dt + 1, 0, measure, "ci double", totals=True)


def tiling_coefficient(a: DataFrame, b: DataFrame, dt: int, length: int) -> DataFrame:
    """Spike time tiling of two trains of each unit (unit, t) in a recording from 0 to length."""

    def near(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        d = as_of(x.select("unit", "t"), y.select("unit", "t"))
        hit = F.least(F.coalesce(F.col("t") - F.col("previous"), F.lit(1 << 62)), F.coalesce(F.col("next") - F.col("t"), F.lit(1 << 62))) <= dt
        return d.groupBy("unit").agg(F.avg(hit.cast("double")).alias(name))

    def tiled(x: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("unit").orderBy("t")
        cover = F.lit(2 * dt) - F.when(F.col("gap") < 2 * dt, 2 * dt - F.col("gap")).otherwise(0)
        ends = F.greatest(F.lit(0), dt - F.min("t")) + F.greatest(F.lit(0), F.max("t") + dt - length)
        return x.select("unit", "t").withColumn("gap", F.col("t") - F.lag("t").over(w)).groupBy("unit").agg(((F.sum(F.when(F.col("gap").isNull(), 2 * dt).otherwise(cover)) - ends) / F.lit(float(length))).alias(name))

    x = near(a, b, "pa").join(near(b, a, "pb"), "unit").join(tiled(a, "ta"), "unit").join(tiled(b, "tb"), "unit")

    def term(p: str, t: str):
        low = 1 - F.col(p) * F.col(t)
        return F.when(low == 0, 1.0).otherwise((F.col(p) - F.col(t)) / low)

    return x.select("unit", (0.5 * (term("pa", "tb") + term("pb", "ta"))).alias("sttc"))
