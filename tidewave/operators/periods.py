"""Algebra of periods [start, stop] and runs of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.timeline import islands


def marked(df: DataFrame, periods: DataFrame, unit: str = "unit") -> DataFrame:
    """Adds inside: whether a row is in any closed period of its unit. periods(unit, start, stop), disjoint within a unit.

    The latest period that starts at or before a row is the only one that can
    hold it: an as-of lookup, not a pair for each period.
    """
    rest = [c for c in df.columns if c != unit]
    both = df.withColumn("_stop", F.lit(None).cast("long")).unionByName(periods.select(unit, F.col("start").alias("t"), F.col("stop").alias("_stop")), allowMissingColumns=True)
    # at equal times the period comes first; of several the longest last
    w = Window.partitionBy(unit).orderBy("t", F.col("_stop").isNull(), "_stop").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_until", F.last("_stop", ignorenulls=True).over(w)).filter("_stop IS NULL").select(unit, *rest, F.coalesce(F.col("t") <= F.col("_until"), F.lit(False)).alias("inside"))


def inside(df: DataFrame, periods: DataFrame, unit: str = "unit") -> DataFrame:
    """Rows in any closed period of their unit; each once. periods as in marked."""
    return marked(df, periods, unit).filter("inside").drop("inside")


def checked(periods: DataFrame) -> DataFrame:
    """The periods; one that doesn't end after it starts fails the job."""
    bad = F.raise_error(F.lit("a period must end after it starts")).cast(dict(periods.dtypes)["stop"])
    return periods.withColumn("stop", F.when(F.col("start") < F.col("stop"), F.col("stop")).otherwise(bad))


def complement(periods: DataFrame, first: int, last: int, unit: str = "unit") -> DataFrame:
    """What is left of [first, last] in each unit that has periods; empty stretches are dropped."""
    w = Window.partitionBy(unit).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    before = periods.select(unit, F.coalesce(reach, F.lit(first)).alias("_a"), F.col("start").alias("_b"))
    after = periods.groupBy(unit).agg(F.max("stop").alias("_a")).withColumn("_b", F.lit(last).cast("long"))
    return before.unionByName(after).filter("_a < _b").select(unit, F.col("_a").alias("start"), F.col("_b").alias("stop"))


def intersection(lists: DataFrame, n: int, unit: str = "unit") -> DataFrame:
    """Stretches that n lists have in common, by a sweep over edges. lists(unit, start, stop), each list disjoint."""
    edges = lists.select(unit, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("t"), F.lit(-1).alias("d")))).alias("e")).select(unit, "e.t", "e.d")
    steps = edges.groupBy(unit, "t").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(unit).orderBy("t")
    level = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("_level", level).withColumn("stop", F.lead("t").over(w)).filter((F.col("_level") == n) & (F.col("t") < F.col("stop"))).select(unit, F.col("t").alias("start"), "stop")


def runs(df: DataFrame, flag: str, least: int = 1, unit: str = "unit", t: str = "t", edges: bool = True) -> DataFrame:
    """unit, start, stop, n of each run of at least so many rows with a true flag.

    edges False: runs that touch a unit's first or last row don't count.
    """
    w = Window.partitionBy(unit).orderBy(t)
    marked = islands(df, flag, [unit], [t])
    if not edges:
        marked = marked.withColumn("_edge", F.lag(t).over(w).isNull() | F.lead(t).over(w).isNull())
    else:
        marked = marked.withColumn("_edge", F.lit(False))
    out = marked.filter(F.col(flag)).groupBy(unit, "run").agg(F.min(t).alias("start"), F.max(t).alias("stop"), F.count("*").alias("n"), F.max("_edge").alias("_edge"))
    return out.filter((F.col("n") >= least) & ~F.col("_edge")).drop("run", "_edge")


def crossings(df: DataFrame, column: str, threshold: float, unit: str = "unit", t: str = "t") -> DataFrame:
    """Rows at or above the threshold whose row before is below."""
    w = Window.partitionBy(unit).orderBy(t)
    return df.withColumn("_x", F.lag(column).over(w)).filter((F.col(column) >= threshold) & (F.col("_x") < threshold)).drop("_x")
