"""Trains and signals around events: aligned counts, rates, joint histograms, clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.functions.timeline import window_join
from tidewave.operators.neighbours import cofiring_synchrony, firing_trains


def aligned(events: DataFrame, df: DataFrame, low: int, high: int, width: int) -> DataFrame:
    """Pairs of event(unit, event_id, event) and spike(unit, t) with low <= t - event <= high; bin from 0, the last closed on both sides."""
    last = (high - low) // width - 1
    pairs = window_join(events, df, low, high, ["unit"])
    return pairs.withColumn("bin", F.least(F.floor((F.col("t") - F.col("event") - low) / width), F.lit(last)))


def aligned_counts(events: DataFrame, df: DataFrame, low: int, high: int, width: int) -> DataFrame:
    """unit, event_id, bin, n for events with a spike in the window."""
    return aligned(events, df, low, high, width).groupBy("unit", "event_id", "bin").agg(F.count("*").alias("n"))


def event_rates(events: DataFrame, df: DataFrame, low: int, high: int, width: int, width_seconds: float) -> DataFrame:
    """unit, bin, mean rate and its standard error over a unit's events (all of them), of every bin that has a spike."""
    counts = aligned_counts(events, df, low, high, width)
    n = events.groupBy("unit").agg(F.count("*").alias("events"))
    sums = counts.groupBy("unit", "bin").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    mean = F.col("s") / F.col("events")
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("events")) / (F.col("events") - 1)
    return sums.join(n, "unit").filter("events > 1").select("unit", "bin", (mean / F.lit(width_seconds)).alias("rate"), (F.sqrt(F.greatest(var, F.lit(0.0)) / F.col("events")) / F.lit(width_seconds)).alias("sem"))


def dense_trials(events: DataFrame, df: DataFrame, low: int, high: int, width: int) -> DataFrame:
    """unit, event_id, bin, n with every bin of every event."""
    grid = events.select("unit", "event_id").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((high - low) // width - 1).cast("long"))))
    return grid.join(aligned_counts(events, df, low, high, width), ["unit", "event_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def baseline_scores(trials: DataFrame, baseline: int, across: bool) -> DataFrame:
    """unit, bin, z of the mean over events. Baseline: the first bins; within: mean and deviation of the averaged bins, across: of all trials' bins."""
    mean = trials.groupBy("unit", "bin").agg(F.avg("n").alias("m"))
    base = (trials.select("unit", "bin", F.col("n").cast("double").alias("v")) if across else mean.select("unit", "bin", F.col("m").alias("v"))).filter(F.col("bin") < baseline)
    stats = base.groupBy("unit").agg(F.avg("v").alias("b"), F.stddev_pop("v").alias("s"))
    return mean.join(stats, "unit").select("unit", "bin", ((F.col("m") - F.col("b")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("z"))


def aligned_values(events: DataFrame, df: DataFrame, low: int, high: int, width: int, value: str = "a") -> DataFrame:
    """unit, bin, mean of a signal's value around events."""
    return aligned(events, df, low, high, width).groupBy("unit", "bin").agg(F.avg(value).alias("mean_value"))


def population_synchrony_trials(events: DataFrame, trains: DataFrame, periods: DataFrame, low: int, high: int, width: int, tiles: int, half: int, stretch: int) -> DataFrame:
    """event_id, bin, n: the mean of cofiring_synchrony at so many moments of each bin around each event(event_id, event), dense over bins.

    A moment at which no train fires counts for nothing; a bin of such moments
    is null. Spikes outside the windows around events don't count. width is a
    multiple of tiles; stretch is cofiring_synchrony's width.
    """
    if width % tiles or half * 2 * tiles < width:
        raise ValueError("the moments must be whole ticks, and no further apart than spikes count")
    step = width // tiles
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((high - low) // step - 1).cast("long")))
    moments = events.select("event_id", "event", k.alias("k")).select(F.struct("event_id", "k").alias("id"), (F.col("event") + low + F.col("k") * step).alias("t"))
    spans = events.select((F.col("event") + low).alias("start"), (F.col("event") + high).alias("stop"))
    near = firing_trains(trains.select(F.struct("unit", "t").alias("id"), "t"), spans, stretch).filter("trains > 0").select("id.unit", "id.t")
    fractions = cofiring_synchrony(moments, near, periods, half, stretch)
    return fractions.groupBy(F.col("id.event_id").alias("event_id"), F.floor(F.col("id.k") / tiles).alias("bin")).agg(F.avg("fraction").alias("n"))


def joint_histogram(x: DataFrame, y: DataFrame) -> DataFrame:
    """u, v, jpsth: correlation over trials of bin u of x with bin v of y; both dense trials(event_id, bin, n)."""
    a = x.select("event_id", F.col("bin").alias("u"), F.col("n").cast("double").alias("p"))
    b = y.select("event_id", F.col("bin").alias("v"), F.col("n").cast("double").alias("q"))
    sums = a.join(b, "event_id").groupBy("u", "v").agg((F.avg(F.col("p") * F.col("q")) - F.avg("p") * F.avg("q")).alias("c"), (F.stddev_pop("p") * F.stddev_pop("q")).alias("s"))
    return sums.select("u", "v", F.when(F.col("s") > 0, F.col("c") / F.col("s")).otherwise(0.0).alias("jpsth"))


def active_events(trials: DataFrame) -> DataFrame:
    """event_id of the trials in which every unit has a spike; trials dense over (unit, event_id, bin)."""
    return trials.groupBy("event_id", "unit").agg(F.sum("n").alias("n")).groupBy("event_id").agg(F.min("n").alias("n")).filter("n > 0").select("event_id")


def spaced_events(events: DataFrame, least: int, unit: str = "unit") -> DataFrame:
    """Events at least so many ticks after the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy(unit).orderBy("event")
    return events.withColumn("_d", F.col("event") - F.lag("event").over(w)).filter(F.coalesce(F.col("_d") >= least, F.lit(True))).drop("_d")


def clock_fit(sync: DataFrame, by: str = "dataset") -> DataFrame:
    """dataset, slope, intercept of reference on own sync times(dataset, own, reference)."""
    return sync.groupBy(by).agg(F.regr_slope("reference", "own").alias("slope"), F.regr_intercept("reference", "own").alias("intercept"))


def to_reference_clock(df: DataFrame, fit: DataFrame, by: str = "dataset") -> DataFrame:
    """t of each row on the reference clock, to the nearest tick (half to even)."""
    return df.join(fit, by).withColumn("t", F.rint(F.col("slope") * F.col("t") + F.col("intercept")).cast("long")).drop("slope", "intercept")


def merge_datasets(trains: DataFrame, fit: DataFrame) -> DataFrame:
    """All datasets' spikes on one clock, named by dataset and unit, in order of time."""
    return to_reference_clock(trains, fit).select("dataset", "unit", "t").orderBy("t", "dataset", "unit")
