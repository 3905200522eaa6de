"""The primitives that the operators share: ordering, range joins, as-of joins, islands, dense bins.

A train is a set of rows (unit, t): t are integer ticks. Columns are named by
arguments; nothing here reads files or collects rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def in_order(unit: str | Sequence[str] = "unit", *order: str) -> Window:
    """A unit's rows in time order."""
    units = [unit] if isinstance(unit, str) else list(unit)
    return Window.partitionBy(*units).orderBy(*(order or ("t",)))


def gap(unit: str = "unit", t: str = "t", *ties: str) -> Column:
    """Ticks since the unit's row before; null at its first."""
    return F.col(t) - F.lag(t).over(in_order(unit, t, *ties))


def in_parts(left: DataFrame, right: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a key, for an equi-join, cut into parts of about most left rows.

    The left rows of a key with more are dealt to parts by a hash of the row,
    its right rows go to each part. Rows are counted first; the keys of several
    parts are at most one for each most left rows. The new key is one long, so
    that it costs a join no more: 1,024 of the old one and the part, of which
    there are so many at most. The old one is below 2^53.
    """
    heavy = left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(key, F.least(F.ceil(F.col("_n") / most), F.lit(1024)).alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    a = left.join(heavy, key, "left").withColumn(key, F.col(key) * 1024 + F.pmod(F.xxhash64(*left.columns), parts)).drop("_parts")
    b = right.join(heavy, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return a, b.withColumn(key, F.col(key) * 1024 + F.col("_part")).drop("_parts", "_part")


def range_join(left: DataFrame, right: DataFrame, reach: int, on: Sequence[str] = (), t_left: str = "t1", t_right: str = "t2", most: int | None = None) -> DataFrame:
    """Pairs with 0 <= t_right - t_left < reach, and equal ``on`` columns.

    An equi-join on time buckets as wide as the reach: a left row has its own
    bucket, a right row that and the one before, so each pair meets once. Work
    grows with the rows near each other, not with the product of the sides.
    most: buckets with more left rows are joined in parts (in_parts); for joins
    on time alone, where a burst of all units is one bucket.
    """
    bucket = lambda t: F.floor(F.col(t) / F.lit(reach))
    a = left.withColumn("_bucket", bucket(t_left))
    b = right.withColumn("_bucket", F.explode(F.array(bucket(t_right), bucket(t_right) - 1)))
    d = F.col(t_right) - F.col(t_left)
    if most is not None:
        a, b = in_parts(a, b, "_bucket", most)
    return a.join(b, [*on, "_bucket"]).drop("_bucket").filter((d >= 0) & (d < reach))


def window_join(events: DataFrame, rows: DataFrame, low: int, high: int, on: Sequence[str] = (), event: str = "event", t: str = "t") -> DataFrame:
    """Pairs with low <= t - event <= high: a range join from the windows' starts."""
    moved = events.withColumn("_start", F.col(event) + F.lit(low))
    return range_join(moved, rows, high - low + 1, on, "_start", t).drop("_start")


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str] = ("unit",), t: str = "t") -> DataFrame:
    """left with previous (latest right time <= t) and next (first right time >= t); null without one.

    A union and two window passes over each key's rows in order. left(on, t,
    ...), right(on, t).
    """
    rest = [c for c in left.columns if c not in (*on, t)]
    both = left.withColumn("_right", F.lit(None).cast("long")).unionByName(right.select(*on, t, F.col(t).alias("_right")), allowMissingColumns=True).withColumn("_is_left", F.col("_right").isNull())
    w = Window.partitionBy(*on)
    before = F.last("_right", ignorenulls=True).over(w.orderBy(F.col(t), F.col("_is_left")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_right", ignorenulls=True).over(w.orderBy(F.col(t), F.col("_is_left").desc()).rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("previous", before).withColumn("next", after).filter("_is_left").select(*on, t, *rest, "previous", "next")


def islands(df: DataFrame, flag: str, unit: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds run: a number that is constant over neighbouring rows of equal flag."""
    w = Window.partitionBy(*unit).orderBy(*order)
    change = F.when(F.col(flag) != F.lag(flag).over(w), 1).otherwise(0)
    return df.withColumn("_change", change).withColumn("run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def dense(counts: DataFrame, keys: DataFrame, first: Column, last: Column, bin_name: str = "bin", value: str = "n") -> DataFrame:
    """A row for each key and bin from first to last (columns of keys), value 0 where counts has none."""
    grid = keys.withColumn(bin_name, F.explode(F.sequence(first, last)))
    on = [c for c in counts.columns if c in grid.columns]
    return grid.join(counts, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def numbered(df: DataFrame, column: str, *ties: str, name: str = "place", parts: int = 200) -> DataFrame:
    """Adds the place of each row, from 0, in order of a numeric column and then of ties.

    Rows are cut at approximate quantiles into parts that are numbered by
    themselves and moved on by the counts of the parts before, so no task
    orders all rows. Rows of one value stay in one part; nulls come first.
    """
    edges = sorted(set(df.approxQuantile(column, [k / parts for k in range(1, parts)], 1 / (4 * parts))))
    part = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)).cast("array<double>"), lambda e: e < F.col(column)))
    rows = df.withColumn("_part", F.coalesce(F.when(F.col(column).isNotNull(), part), F.lit(-1)))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over the parts, of which there are few
    before = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0).cast("long")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(column, *ties)) - 1
    return rows.withColumn("_inside", inside).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_inside") + F.col("_before")).cast("long").alias(name))
