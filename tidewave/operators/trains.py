"""Operators on single trains: intervals, rates, regularity, dedup, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.timeline import dense, gap, in_order


def with_intervals(df: DataFrame, *ties: str) -> DataFrame:
    """Adds isi: ticks since the unit's spike before."""
    return df.withColumn("isi", gap("unit", "t", *ties))


def interval_summary(df: DataFrame) -> DataFrame:
    return with_intervals(df).groupBy("unit").agg(F.count("*").alias("n"), F.avg("isi").alias("mean_isi"), F.min("isi").alias("min_isi"), F.expr("percentile(isi, 0.5)").alias("median_isi"))


def enforce_refractory(df: DataFrame, ticks: int) -> DataFrame:
    """Drops spikes at most so many ticks after the spike before (kept or not)."""
    return with_intervals(df).filter(F.coalesce(F.col("isi") > ticks, F.lit(True))).drop("isi")


def filtered_intervals(df: DataFrame, exclude: float = 0.005, floor: int = 0) -> DataFrame:
    """Intervals of at least floor and at most the unit's quantile 1 - exclude."""
    isi = with_intervals(df).filter("isi IS NOT NULL").filter(F.col("isi") >= floor)
    cap = isi.groupBy("unit").agg(F.expr(f"percentile(isi, {1 - exclude!r})").alias("cap"))
    return isi.join(cap, "unit").filter("isi <= cap").drop("cap")


def rates(df: DataFrame, ticks_per_second: float, exclude: float = 0.005) -> DataFrame:
    """mfr (1 / mean interval), mifr (mean of 1 / interval) and cv of the filtered intervals."""
    x = F.col("isi") / F.lit(ticks_per_second)
    return filtered_intervals(df, exclude).filter("isi > 0").groupBy("unit").agg((1 / F.avg(x)).alias("mfr"), F.avg(1 / x).alias("mifr"), (F.stddev_pop(x) / F.avg(x)).alias("cv"))


def regularity(df: DataFrame, ticks_per_second: float, refractory: float = 0.8) -> DataFrame:
    """mfr, mifr, median, 5th percentile, cv2 mean and median, cv, ir, lv, lvr, lcv, si, skewness, deviation and burst index of the intervals."""
    x = (F.col("isi") / F.lit(ticks_per_second)).alias("x")
    isi = with_intervals(df).filter("isi > 0").select("unit", "t", x).withColumn("p", F.lag("x").over(in_order()))
    both = F.col("x") + F.col("p")
    cv2 = 2 * F.abs(F.col("x") - F.col("p")) / both
    local = 1 - 4 * F.col("x") * F.col("p") / (both * both)
    return isi.groupBy("unit").agg(
        (1 / F.avg("x")).alias("mfr"),
        F.avg(1 / F.col("x")).alias("mifr"),
        F.percentile("x", F.lit(0.5)).alias("median"),
        F.percentile("x", F.lit(0.05)).alias("prct5"),
        (F.stddev_pop("x") / F.avg("x")).alias("cv"),
        F.try_divide(F.stddev_pop(F.log10("x")), F.avg(F.log10("x"))).alias("lcv"),
        F.stddev_pop("x").alias("sd"),
        F.avg(cv2).alias("cv2_mean"),
        F.percentile(cv2, F.lit(0.5)).alias("cv2_median"),
        F.avg(F.abs(F.log(F.col("x") / F.col("p")))).alias("ir"),
        (3 * F.avg(local)).alias("lv"),
        (3 * F.avg(local * (1 + 4 * F.lit(refractory) / both))).alias("lvr"),
        (-F.avg(0.5 * F.log10(4 * F.col("x") * F.col("p") / (both * both)))).alias("si"),
        F.skewness("x").alias("skew"),
        F.percentile(1 / F.col("x"), F.lit(0.95)).alias("burst_index"),
    )


def binned(df: DataFrame, width: int, length: int) -> DataFrame:
    """unit, bin, n of every whole bin of a recording of that length; spikes in a last part of a bin don't count."""
    bins = length // width
    counts = df.withColumn("bin", F.floor(F.col("t") / width)).filter(F.col("bin") < bins).groupBy("unit", "bin").agg(F.count("*").alias("n"))
    return dense(counts, df.select("unit").distinct(), F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))


def isolated(df: DataFrame, half: int) -> DataFrame:
    """Spikes with both neighbours at least half away; a unit's first and last are not."""
    w = in_order()
    return df.withColumn("_b", F.col("t") - F.lag("t").over(w)).withColumn("_a", F.lead("t").over(w) - F.col("t")).filter((F.col("_b") >= half) & (F.col("_a") >= half)).drop("_b", "_a")


def presence_ratio(df: DataFrame, first: int, last: int, edges: int = 100) -> DataFrame:
    """Bins with a spike of edges - 1 equal bins between first and last, over edges."""
    width = (last - first) / (edges - 1)
    bin_ = F.least(F.floor((F.col("t") - first) / F.lit(width)), F.lit(edges - 2))
    return df.filter(F.col("t").between(first, last)).groupBy("unit").agg((F.count_distinct(bin_) / edges).alias("presence"))


def firing_rate(df: DataFrame, ticks_per_second: float) -> DataFrame:
    """Spikes over the seconds between a unit's first and last; null if these are at one time."""
    return df.groupBy("unit").agg(F.try_divide(F.count("*") * F.lit(ticks_per_second), F.max("t") - F.min("t")).alias("rate"))


def outliers(df: DataFrame, column: str, deviations: float, by: str = "unit") -> DataFrame:
    """Rows further than so many population deviations from the mean of their group."""
    stats = df.groupBy(by).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return df.join(stats, by).filter(F.abs(F.col(column) - F.col("_m")) > deviations * F.col("_s")).drop("_m", "_s")


def rolling_mean(df: DataFrame, column: str, width: int, unit: str = "unit", t: str = "t") -> DataFrame:
    """Adds rolling: the mean of an odd number of rows around each; rows without all of them are dropped."""
    half = width // 2
    w = in_order(unit, t).rowsBetween(-half, half)
    return df.withColumn("rolling", F.avg(column).over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") == width).drop("_n")


def every_nth(df: DataFrame, wanted: int) -> DataFrame:
    """A regular subset of at most so many spikes of each unit."""
    w = in_order("unit", "t", "id")
    n = F.count(F.lit(1)).over(Window.partitionBy("unit"))
    step = F.greatest(F.lit(1), F.ceil(n / F.lit(wanted)))
    return df.withColumn("_k", F.row_number().over(w) - 1).withColumn("_s", step).filter("_k % _s = 0").drop("_k", "_s")


def batched_subset(df: DataFrame, wanted: int, size: int | None) -> DataFrame:
    """About wanted spikes of each unit, in batches of size neighbouring ones that lie evenly over the unit's train.

    A unit of at most wanted or size spikes, or no size: single spikes at even
    steps, at most wanted. wanted is at least two batches.
    """
    if size is not None and wanted // size < 2:
        raise ValueError("at least two batches are needed")
    k = F.row_number().over(in_order("unit", "t", "id")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("unit"))
    step = F.greatest(F.ceil(F.col("_n") / F.lit(wanted)), F.lit(1))
    keep = (F.col("_k") % step == 0) & (F.floor(F.col("_k") / step) < wanted)
    if size is not None:
        batches = wanted // size
        apart = F.greatest(F.floor((F.col("_n") - size) / (batches - 1)), F.lit(size))
        inside = (F.floor(F.col("_k") / apart) < batches) & (F.col("_k") % apart < size)
        keep = F.when(F.col("_n") <= max(size, wanted), keep).otherwise(inside)
    return df.withColumn("_k", k).withColumn("_n", n).filter(keep).drop("_k", "_n")


def random_subset(df: DataFrame, wanted: int, seed: int = 0) -> DataFrame:
    """wanted spikes of each unit, or all of fewer: those of the lowest hash of unit, id and seed, so every partitioning gives the same."""
    from tidewave.operators.surrogates import uniform

    order = Window.partitionBy("unit").orderBy(uniform("unit", "id", F.lit(seed)), "id")
    return df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= wanted).drop("_k")


def standardise(column: Column, over: Window) -> Column:
    """(x - mean) / population deviation, which counts as 1 if it is 0."""
    s = F.stddev_pop(column).over(over)
    return (column - F.avg(column).over(over)) / F.when(s == 0, 1.0).otherwise(s)
