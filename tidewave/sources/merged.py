"""Merged sets of recordings: which set a unit is from, its metadata, and checks of channels.

A unit of a merged set is named unit + dataset / 10, so a merged set holds at
most ten data sets. datasets(dataset, dp, probe) lists them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.sources.arrays import metadata
from tidewave.sources.units import decoded


def is_merged(path: Column) -> Column:
    """Whether a folder's own name says that it is a merged set."""
    return F.contains(F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1), F.lit("merged"))


def same_dataset(units: DataFrame, unit: str = "unit") -> DataFrame:
    """One row, same: whether all units are of one data set; true for no unit."""
    return units.agg((F.count_distinct(decoded(F.col(unit))[0]) <= 1).alias("same"))


def with_sources(rows: DataFrame, datasets: DataFrame, unit: str = "unit") -> DataFrame:
    """The rows with dataset, dp and source_unit; dp is null for a data set that isn't listed."""
    dataset, source = decoded(F.col(unit))
    return rows.withColumn("dataset", dataset).withColumn("source_unit", source).join(datasets.select("dataset", "dp"), "dataset", "left")


def merged_metadata(spark: SparkSession, datasets: DataFrame, pattern: str = "*.meta") -> DataFrame:
    """probe, path, key, value of the metadata files in each data set's folder."""
    out = None
    for r in datasets.select("dp", "probe").orderBy("probe").collect():  # at most ten
        one = metadata(spark, f"{r.dp}/{pattern}").select(F.lit(r.probe).alias("probe"), "path", "key", "value")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("a merged set without data sets")
    return out


def hardware_filtered(meta: DataFrame) -> DataFrame:
    """path, filtered: whether the probe's own high pass was on, from the last number of the second entry of its channel table."""
    last = F.regexp_extract("value", r"^\([^)]*\)\((?:[^)]*\s)?(\d+)\)", 1)
    return meta.filter(F.ltrim("key", F.lit("~")) == "imroTbl").select("path", (F.try_to_number(last, F.lit("999999")) != 0).alias("filtered"))


def known_channels(wanted: DataFrame, channels: DataFrame) -> DataFrame:
    """The rows of wanted with known: whether the channel map has their channel."""
    have = channels.select("channel", F.lit(True).alias("known")).distinct()
    return wanted.join(have, "channel", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def rebuilt_map(columns: DataFrame) -> DataFrame:
    """channel, x, y of a probe of which only x is known, in order of channel from 0: two sites a row.

    Sites at 11, 27, 43 and 59 have rows 20 apart, those at 0 and 32 rows 15
    apart; other columns fail the job. A map that begins in a right-hand column
    begins in the middle of a row.
    """
    kinds = columns.agg(F.array_sort(F.collect_set(F.col("x").cast("int"))).alias("_xs"), F.min_by(F.col("x").cast("int"), "channel").alias("_first"))
    bad = F.raise_error(F.lit("no probe has these columns")).cast("double")
    four, two = (F.array(*(F.lit(x) for x in xs)) for xs in ((11, 27, 43, 59), (0, 32)))
    pitch = F.when(F.col("_xs") == four, 20.0).when(F.col("_xs") == two, 15.0).otherwise(bad)
    late = F.col("_first").isin(59, 43, 32).cast("int")
    return columns.join(F.broadcast(kinds)).select("channel", "x", (F.floor((F.col("channel") + late) / 2) * pitch).alias("y"))
