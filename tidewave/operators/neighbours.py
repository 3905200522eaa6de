"""Nearest-event joins between trains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.timeline import as_of, gap, in_order


def cross_intervals(a: DataFrame, b: DataFrame, direction: int, on: Sequence[str] = ("unit",)) -> DataFrame:
    """Adds interval: from each spike of a to the next (1), previous (-1) or nearest (0) of b, of zero or more ticks."""
    d = as_of(a, b, on)
    ahead, behind = F.col("next") - F.col("t"), F.col("t") - F.col("previous")
    value = {1: ahead, -1: behind, 0: F.least(ahead, behind)}[direction]
    return d.withColumn("interval", value).drop("previous", "next")


def consecutive(a: DataFrame, b: DataFrame) -> DataFrame:
    """unit, t, interval: spikes of a that a spike of b follows, with no other between."""
    both = a.select("unit", "t", "id", F.lit(1).alias("side")).unionByName(b.select("unit", "t", "id", F.lit(2).alias("side")))
    w = Window.partitionBy("unit").orderBy("t", "side", "id")
    return both.withColumn("_s", F.lead("side").over(w)).withColumn("interval", F.lead("t").over(w) - F.col("t")).filter("side = 1 AND _s = 2").select("unit", "id", "t", "interval")


def synced(a: DataFrame, b: DataFrame, half: int) -> DataFrame:
    """Spikes of a next to one of b, before or after, within half ticks."""
    both = a.select("unit", "t", "id", F.lit(1).alias("side")).unionByName(b.select("unit", "t", "id", F.lit(2).alias("side")))
    w = Window.partitionBy("unit").orderBy("t", "side", "id")
    near = ((F.lead("side").over(w) == 2) & (F.lead("t").over(w) - F.col("t") <= half)) | ((F.lag("side").over(w) == 2) & (F.col("t") - F.lag("t").over(w) <= half))
    return both.withColumn("_near", F.coalesce(near, F.lit(False))).filter("side = 1 AND _near").select("unit", "id", "t")


def windows(trains: DataFrame, half: int) -> DataFrame:
    """unit, start, stop: where each train has a spike at most half ticks away, both ends in, as disjoint periods."""
    late = F.coalesce(gap() > 2 * half, F.lit(True)).cast("int")
    w = in_order("unit", "t").rowsBetween(Window.unboundedPreceding, 0)
    run = trains.select("unit", "t").filter("unit IS NOT NULL AND t IS NOT NULL").withColumn("_new", late).withColumn("_run", F.sum("_new").over(w))
    return run.groupBy("unit", "_run").agg((F.min("t") - half).alias("start"), (F.max("t") + half).alias("stop")).drop("_run")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """unit, start, stop: what is in a period of a and in one of b, both ends in, as disjoint periods; a sweep over a unit's edges."""
    edge = lambda p, t, o, x, y: p.select("unit", F.col(t).alias("t"), F.lit(o).alias("o"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    edges = edge(a, "start", 0, 1, 0).unionByName(edge(a, "stop", 1, -1, 0)).unionByName(edge(b, "start", 0, 0, 1)).unionByName(edge(b, "stop", 1, 0, -1))
    edges = edges.groupBy("unit", "t", "o").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    w = in_order("unit", "t", "o")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    both = edges.withColumn("_both", (F.sum("x").over(upto) > 0) & (F.sum("y").over(upto) > 0))
    turns = both.withColumn("_was", F.coalesce(F.lag("_both").over(w), F.lit(False))).filter("_both <> _was")
    return turns.withColumn("stop", F.lead("t").over(w)).filter("_both").select("unit", F.col("t").alias("start"), "stop")


def population_synchrony(a: DataFrame, trains: DataFrame, half: int) -> DataFrame:
    """id, fraction: of all trains, those with a spike at most half ticks from each spike of a.

    A train counts where it has a spike near, which are periods: how many hold
    a spike of a is a sweep over their edges, so the work grows with the spikes
    alone, not with those that are near each other.
    """
    n = trains.agg(F.count_distinct("unit").alias("trains"))
    span = trains.agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("t").alias("n")).first()
    width = max(1, (span.last - span.first) * 20_000 // span.n) if span.n else 1  # some 20,000 spikes in a stretch
    some = firing_trains(a.select("id", "t"), windows(trains, half), width)
    return some.withColumnRenamed("trains", "near").join(F.broadcast(n)).select("id", (F.col("near") / F.col("trains")).alias("fraction"))


def firing_trains(a: DataFrame, periods: DataFrame, width: int) -> DataFrame:
    """id, trains: how many periods(unit, start, stop), both ends in, hold each row's t; those of a unit are disjoint.

    A sweep over edges and rows in stretches of width ticks, each moved on by
    the edges before it, so only the stretches' sums meet in one task.
    """
    edge = lambda t, d, o: periods.select(F.col(t).alias("t"), F.lit(d).alias("d"), F.lit(o).alias("o"), F.lit(None).cast(dict(a.dtypes)["id"]).alias("id"))
    rows = a.select("t", F.lit(0).alias("d"), F.lit(1).alias("o"), "id")
    sweep = edge("start", 1, 0).unionByName(rows).unionByName(edge("stop", -1, 2)).withColumn("stretch", F.coalesce(F.floor(F.col("t") / width), F.lit(-(1 << 62))))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = sweep.groupBy("stretch").agg(F.sum("d").alias("s")).select("stretch", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("carried"))
    own = F.sum("d").over(Window.partitionBy("stretch").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0))
    return sweep.withColumn("own", own).filter("o = 1").join(carried, "stretch").select("id", (F.col("own") + F.col("carried")).cast("long").alias("trains"))


def cofiring_synchrony(a: DataFrame, trains: DataFrame, periods: DataFrame, half: int, width: int) -> DataFrame:
    """id, fraction: of the trains that are in one of their firing periods(unit, start, stop) at each row of a(id, t), those with a spike at most half ticks away; null where none is.

    width: see firing_trains, some thousand times as long as spikes are apart.
    """
    firing = firing_trains(a, periods, width)
    hits = firing_trains(a, common(windows(trains, half), periods), width).withColumnRenamed("trains", "near")
    return firing.join(hits, "id", "left").select("id", F.when(F.col("trains") > 0, F.coalesce("near", F.lit(0)) / F.col("trains")).alias("fraction"))
