"""Rates over time: smoothed trains, firing periods, correlograms by rate, interval entropy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.timeline import range_join
from tidewave.operators.correlograms import half_counts
from tidewave.operators.peaks import bursts_and_oscillations
from tidewave.operators.periods import runs
from tidewave.operators.trains import binned, filtered_intervals, regularity, with_intervals

#: The most bins that a task smooths at once: 8 MB in double precision.
CELLS = 1 << 20


def smoothed_rows(x: np.ndarray, sd: float) -> np.ndarray:
    """A gaussian over each row, what is beyond its ends mirrored once. Terms are added from the left, so that a row comes out the same in any company."""
    half, size = math.ceil(4 * sd), x.shape[1]
    k = [math.exp(-0.5 * (i / sd) ** 2) for i in range(-half, half + 1)]
    total = sum(k)
    place = np.arange(-half, size + half)
    place = np.where(place < 0, -place - 1, np.where(place >= size, 2 * size - 1 - place, place))
    near = np.where((place >= 0) & (place < size), x[:, np.clip(place, 0, size - 1)], 0)
    out = np.zeros(x.shape)
    for i, weight in enumerate(k):
        out += near[:, i : i + size] * (weight / total)
    return out


def gaussian_smoothed(dense: DataFrame, sd: float, value: str = "n") -> DataFrame:
    """Adds smooth to dense(unit, bin, n): a gaussian over the bins, those beyond the ends mirrored.

    A unit's bins meet in one array (8 MB for a million bins), and the arrays
    of a batch are smoothed together, at most CELLS bins at a time.
    """

    @F.arrow_udf("array<double>")
    def smoothed(rows: pa.Array) -> pa.Array:
        size = rows.value_lengths().to_numpy(zero_copy_only=False)
        x = rows.flatten().to_numpy(zero_copy_only=False)
        first = np.cumsum(size) - size
        out = np.zeros(len(x))
        for n in np.unique(size[size > 0]):
            alike = first[size == n]
            for some in np.array_split(alike, -(-len(alike) * n // CELLS)):
                at = some[:, None] + np.arange(n)
                out[at] = smoothed_rows(x[at], sd)
        return pa.ListArray.from_arrays(pa.array(np.append(first, len(x)), pa.int32()), pa.array(out))

    rest = [c for c in dense.columns if c not in ("unit", "bin")]
    units = dense.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("bin", *rest))).alias("_r"))
    values = F.transform("_r", lambda r: F.coalesce(r[value].cast("double"), F.lit(0.0)))
    both = units.select("unit", F.explode(F.arrays_zip(F.col("_r").alias("r"), smoothed(values).alias("s"))).alias("x"))
    return both.select("unit", "x.r.*", F.col("x.s").alias("smooth")).select(*dense.columns, "smooth")


def firing_periods(df: DataFrame, width: int, length: int, sd: float, share: float) -> DataFrame:
    """unit, start, stop (ticks): runs of bins whose smoothed count is at least a share of the unit's mean; the whole recording for a unit without one."""
    dense = gaussian_smoothed(binned(df, width, length), sd)
    mean = dense.groupBy("unit").agg(F.avg("n").alias("_m"))
    marked = dense.join(mean, "unit").withColumn("flag", F.col("smooth") >= F.col("_m") * share)
    found = runs(marked, "flag", 1, t="bin").select("unit", (F.col("start") * width).alias("start"), ((F.col("stop") + 1) * width).alias("stop"))
    none = dense.select("unit").distinct().join(found, "unit", "left_anti").select("unit", F.lit(0).cast("long").alias("start"), F.lit(length).cast("long").alias("stop"))
    return found.unionByName(none)


def stability_levels(most: float = 0.9, least: float = 0.4, step: float = 0.05) -> list[float]:
    """Shares of the mean rate to try, from most down to above least."""
    out, share = [], most
    while share > least:
        out.append(share)
        share -= step
    return out


def _true_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true values of each row, in order."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _most_stable(smooth: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first) of each row's run of least deviation, to 12 places, from its first value to before its last; of equal ones the first."""
    n = last - first
    cut = np.cumsum(n) - n
    x = smooth.ravel()[np.repeat(row * smooth.shape[1] + first - cut, n) + np.arange(n.sum())]
    mean = np.add.reduceat(x, cut) / n
    deviation = np.round(np.sqrt(np.add.reduceat((x - np.repeat(mean, n)) ** 2, cut) / n), 12)
    order = np.lexsort((first, deviation, row))
    best = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    return row[best], first[best]


def stable_stretches(x: np.ndarray, width: int, sd: float, target: int, levels: list[float], give_way: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first bin, ticks, level) of stable_periods, for rows of counts. Rows that a share settles are not looked at by the next."""
    smooth, mean = smoothed_rows(x, sd), x.sum(axis=1) / x.shape[1]
    left, out = np.arange(len(x)), []
    for level, share in enumerate(levels):
        row, first, last = _true_runs(smooth[left] >= (mean[left] * share)[:, None])
        row, size = left[row], (last - first) * width
        goal = np.full(len(x), target)
        if level == len(levels) - 1:
            longest = np.full(len(x), -1)
            np.maximum.at(longest, row, size)
            less = target - give_way * ((target - longest) // give_way + 1)
            goal = np.where(longest > target, target, less)
        some = (size > goal[row]) & (goal[row] > 1)
        if some.any():
            row, first = _most_stable(smooth, row[some], first[some], last[some])
            out.append((row, first, goal[row], np.full(len(row), level)))
            left = np.setdiff1d(left, row, assume_unique=True)
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def stable_periods(df: DataFrame, width: int, length: int, sd: float, target: int, levels: list[float] | None = None, give_way: int = 2) -> DataFrame:
    """unit, start, stop, level: of the runs above a share of the mean rate that are longer than target ticks the one of least deviation, cut to the target.

    The highest share with such a run counts. Where none has one, target gives
    way in steps until the lowest share has; a unit whose target comes to 1
    tick has no row. Deviation is that of the smoothed counts from a run's
    first bin to before its last, equal ones go by time. Only bins with spikes
    are shuffled; a task lays those of many units out in a matrix, at most
    CELLS bins (or one unit's) at a time.
    """
    levels = levels or stability_levels()
    bins = length // width
    place = F.floor(F.col("t") / width)
    counts = df.filter("unit IS NOT NULL").groupBy("unit", F.when(place.between(0, bins - 1), place).alias("bin")).agg(F.count("*").alias("n"))
    # spikes outside all bins keep their unit
    units = counts.groupBy("unit").agg(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))).alias("_p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), max(1, CELLS // bins)):
                part = batch.slice(k, max(1, CELLS // bins))
                at, n = part.column("at"), part.column("n")
                x = np.zeros((len(part), bins), np.int64)
                x[np.repeat(np.arange(len(part)), at.value_lengths().to_numpy()), at.flatten().to_numpy()] = n.flatten().to_numpy()
                row, first, ticks, level = stable_stretches(x, width, sd, target, levels, give_way)
                yield pa.RecordBatch.from_arrays([part.column("unit").take(pa.array(row)), pa.array(first * width), pa.array(first * width + ticks), pa.array(level, pa.int32())], ["unit", "start", "stop", "level"])

    unit = df.schema["unit"].dataType.simpleString()
    return units.select("unit", F.col("_p.bin").alias("at"), F.col("_p.n").alias("n")).mapInArrow(run, f"unit {unit}, start long, stop long, level int")


def rate_stretches(df: DataFrame) -> DataFrame:
    """unit, start, stop, rate: from the middle between a spike and the one before to the middle between it and the next, at one over that length. df(unit, t), t distinct in a unit."""
    w = Window.partitionBy("unit").orderBy("t")
    middle = lambda a, b: F.col(a) + F.floor((F.col(b) - F.col(a)) / 2)
    near = df.select("unit", "t", F.lag("t").over(w).alias("_p"), F.lead("t").over(w).alias("_n")).filter("_p IS NOT NULL AND _n IS NOT NULL")
    return near.select("unit", middle("_p", "t").alias("start"), middle("t", "_n").alias("stop")).withColumn("rate", 1.0 / (F.col("stop") - F.col("start")))


def rates_at(lookups: DataFrame, df: DataFrame, smooth: int = 0) -> DataFrame:
    """lookups(unit, t, ...) with rate: that of the unit's stretch at t, or its mean over smooth ticks around t; 0 outside all stretches.

    The mean is a difference of two looked-up areas under the rate, so a wide
    window costs as much as a narrow one.
    """
    w = Window.partitionBy("unit").orderBy("start")
    area = (F.col("stop") - F.col("start")) * F.col("rate")
    steps = rate_stretches(df).withColumn("_before", F.coalesce(F.sum(area).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    known = steps.select("unit", F.col("start").alias("_at"), F.struct("start", "stop", "rate", "_before").alias("_s"), F.lit(0).alias("_k"))
    columns = lookups.columns

    def looked_up(offset: int, name: str, rows: DataFrame) -> DataFrame:
        both = known.unionByName(rows.withColumn("_at", F.col("t") + offset).withColumn("_k", F.lit(1)), allowMissingColumns=True)
        last = F.last("_s", ignorenulls=True).over(Window.partitionBy("unit").orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0))
        found = both.withColumn("_f", last).filter("_k = 1")
        if smooth:
            value = F.coalesce(F.col("_f._before") + (F.least("_at", "_f.stop") - F.col("_f.start")) * F.col("_f.rate"), F.lit(0.0))
        else:
            value = F.when(F.col("_at") < F.col("_f.stop"), F.col("_f.rate")).otherwise(0.0)
        return found.withColumn(name, value).drop("_at", "_s", "_k", "_f")

    if not smooth:
        return looked_up(0, "rate", lookups).select(*columns, F.coalesce("rate", F.lit(0.0)).alias("rate"))
    ends = looked_up(smooth - smooth // 2, "_hi", looked_up(-(smooth // 2), "_lo", lookups))
    # to 12 places, so that equal rates are equal
    return ends.select(*columns, F.round((F.col("_hi") - F.col("_lo")) / F.lit(float(smooth)), 12).alias("rate"))


def correlogram_by_rate(df: DataFrame, pairs: DataFrame, width: int, half: int, levels: int, smooth: int = 0) -> DataFrame:
    """u1, u2, level, bin, p: the chance of a spike of u2 in each bin around one of u1, by the rate of u2 at that time. A row for every cell of a pair.

    Times are whole bins of width ticks, of u2 each once. A level is the class
    between quantiles of the rates at the spikes of u1; spikes outside u2's
    train, or whose window leaves the recording, count for quantiles only. For
    u1 = u2 the middle bin is 0. pairs(u1, u2); rates are in bins.
    """
    at = df.select("unit", "id", F.floor(F.col("t") / width).alias("t"))
    other = at.select("unit", "t").distinct()
    ends = other.groupBy("unit").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    refs = at.select(F.col("unit").alias("u1"), "id", "t").join(pairs, "u1").withColumn("unit", F.col("u2"))
    rated = rates_at(refs.select("unit", "t", "u1", "id"), other, smooth)
    share = F.array(*(F.lit((i + 1) / (levels + 1)) for i in range(levels)))
    edges = rated.groupBy("unit", "u1").agg(F.percentile("rate", share).alias("_e"))
    level = F.least(F.size(F.filter("_e", lambda e: e < F.col("rate"))), F.lit(levels - 1)).cast("long")
    last = other.agg(F.max("t").alias("_last"))
    inside = (F.col("t") >= F.col("_a")) & (F.col("t") < F.col("_b")) & (F.col("t") - half >= 0) & (F.col("t") + half < F.col("_last"))
    used = rated.join(edges, ["unit", "u1"]).join(ends, "unit").join(F.broadcast(last)).filter(inside).select("unit", "u1", "id", F.col("t").alias("t1"), level.alias("level"))
    spikes = used.groupBy("unit", "u1", "level").agg(F.count("*").alias("spikes"))
    near = range_join(used.withColumn("t1", F.col("t1") - half), other.withColumnRenamed("t", "t2"), 2 * half + 1, ["unit"])
    counts = near.groupBy("unit", "u1", "level", (F.col("t2") - F.col("t1") - half).alias("bin")).agg(F.count("*").alias("n"))
    grid = pairs.select("u1", F.col("u2").alias("unit")).withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(levels - 1).cast("long")))).withColumn("bin", F.explode(F.sequence(F.lit(-half).cast("long"), F.lit(half).cast("long"))))
    full = grid.join(spikes, ["unit", "u1", "level"], "left").join(counts, ["unit", "u1", "level", "bin"], "left")
    p = F.when((F.col("u1") == F.col("unit")) & (F.col("bin") == 0), 0.0).otherwise(F.coalesce(F.col("n") / F.col("spikes"), F.lit(0.0)))
    return full.select("u1", F.col("unit").alias("u2"), "level", "bin", p.alias("p"))


def rate_deciles(df: DataFrame, n: int) -> DataFrame:
    """Adds rate (of the stretch that is nearer to a spike than to its neighbours) and level: the quantile class of the rate in its unit, from 0."""
    w = Window.partitionBy("unit").orderBy("t")
    own = (F.lead("t").over(w) - F.lag("t").over(w)) / 2
    rated = df.withColumn("rate", 1 / own).filter("rate IS NOT NULL")
    edges = rated.groupBy("unit").agg(F.percentile("rate", F.array(*(F.lit((i + 1) / (n + 1)) for i in range(n)))).alias("_e"))
    level = F.least(F.size(F.filter("_e", lambda e: e < F.col("rate"))), F.lit(n - 1))
    return rated.join(edges, "unit").withColumn("level", level).drop("_e")


def autocorrelogram_by_rate(df: DataFrame, width: int, half: int, n: int) -> DataFrame:
    """unit, level, bin, p: spikes after (bin > 0) or before a spike of each rate class, over the spikes of the class."""
    ref = rate_deciles(df, n).select("unit", "level", "id", F.col("t").alias("t1"))
    other = df.select("unit", F.col("id").alias("id2"), F.col("t").alias("t2"))
    reach = (half + 1) * width
    after = range_join(ref, other, reach, ["unit"]).filter("id <> id2").withColumn("bin", F.floor((F.col("t2") - F.col("t1")) / width))
    before = range_join(other, ref, reach, ["unit"], "t2", "t1").filter("id <> id2").withColumn("bin", -F.floor((F.col("t1") - F.col("t2")) / width))
    counts = after.select("unit", "level", "bin").unionByName(before.select("unit", "level", "bin")).filter("bin <> 0").groupBy("unit", "level", "bin").agg(F.count("*").alias("n"))
    refs = ref.groupBy("unit", "level").agg(F.count("*").alias("refs"))
    return counts.join(refs, ["unit", "level"]).select("unit", "level", "bin", (F.col("n") / F.col("refs")).alias("p"))


def autocorrelogram_curves(df: DataFrame, width: int, half: int, ticks_per_second: float, exclude: float = 0.02, floor: int = 0) -> DataFrame:
    """unit, acg, mfr: the autocorrelogram in Hertz from the middle bin, which is 0, to half; and one over the mean interval of at least floor and at most the quantile 1 - exclude."""
    counts = half_counts(df, width, half, same_unit=True).filter("bin > 0").select(F.col("u1").alias("unit"), "bin", "n")
    total = df.groupBy("unit").agg(F.count("*").alias("total"))
    mean = filtered_intervals(df, exclude, floor).groupBy("unit").agg((F.lit(ticks_per_second) / F.avg("isi")).alias("mfr"))
    grid = total.join(mean, "unit").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(half).cast("long")))).join(counts, ["unit", "bin"], "left")
    hertz = F.coalesce(F.col("n") / (F.col("total") * F.lit(width / ticks_per_second)), F.lit(0.0))
    return grid.groupBy("unit", "mfr").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", hertz.alias("h")))), lambda x: x["h"]).alias("acg")).select("unit", "acg", "mfr")


def temporal_features(df: DataFrame, ticks_per_second: float, width: int, half: int, burst_bins: int, exclude: float = 0.02, floor: int = 0) -> DataFrame:
    """The intervals' features of each unit with burst and oscillation of its autocorrelogram, both over its mean rate."""
    curves = autocorrelogram_curves(df, width, half, ticks_per_second, exclude, floor)
    return interval_features(df, ticks_per_second).join(bursts_and_oscillations(curves, burst_bins), "unit", "left")


def interval_mode(df: DataFrame, bins: int = 199) -> DataFrame:
    """unit, mode: the left edge of the fullest of equal bins between the least and greatest interval (the lowest of equals)."""
    isi = with_intervals(df).filter("isi IS NOT NULL")
    ends = isi.groupBy("unit").agg(F.min("isi").alias("lo"), F.max("isi").alias("hi"))
    k = F.least(F.floor((F.col("isi") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    counts = isi.join(ends, "unit").filter("hi > lo").groupBy("unit", "lo", "hi", k.alias("k")).agg(F.count("*").alias("n"))
    best = counts.groupBy("unit", "lo", "hi").agg(F.max(F.struct("n", (-F.col("k")).alias("k"))).alias("x"))
    return best.select("unit", (F.col("lo") + (-F.col("x.k")) * (F.col("hi") - F.col("lo")) / bins).alias("mode"))


def log_interval_entropy(df: DataFrame, bins: int = 199, sd: float = 2.0) -> DataFrame:
    """unit, entropy in bits of the intervals' histogram in equal steps of their logarithm, smoothed."""
    isi = with_intervals(df).filter("isi > 0").withColumn("l", F.log10("isi"))
    ends = isi.groupBy("unit").agg(F.min("l").alias("lo"), F.max("l").alias("hi")).filter("hi > lo")
    k = F.least(F.floor((F.col("l") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    counts = isi.join(ends, "unit").groupBy("unit", k.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin")).join(counts, ["unit", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    s = gaussian_smoothed(grid, sd).withColumn("p", F.col("smooth") / F.sum("smooth").over(Window.partitionBy("unit")))
    return s.groupBy("unit").agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0))).alias("entropy"))


def interval_features(df: DataFrame, ticks_per_second: float) -> DataFrame:
    """The intervals' 17 features of each unit: those of regularity, mode (in seconds) and log-interval entropy."""
    mode = interval_mode(df).select("unit", (F.col("mode") / F.lit(ticks_per_second)).alias("mode"))
    return regularity(df, ticks_per_second).join(mode, "unit", "left").join(log_interval_entropy(df), "unit", "left")


def up_to_median(df: DataFrame, value: str, low: float, width: float, by: str = "unit") -> DataFrame:
    """Rows under low + median * width, the median of their group's values: a value is a place in bins of that width."""
    middle = df.groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    return df.join(middle, by).filter(F.col(value) < F.lit(low) + F.col("_m") * F.lit(width)).drop("_m")


def split_by_value(df: DataFrame, value: str, n: int, by: str = "unit") -> DataFrame:
    """Adds part: which of n equal-width slices between a group's least and greatest value a row is in, from 0."""
    ends = df.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value) - F.col("_lo")) * n / (F.col("_hi") - F.col("_lo"))), F.lit(n - 1))).otherwise(0)
    return df.join(ends, by).withColumn("part", part.cast("long")).drop("_lo", "_hi")
