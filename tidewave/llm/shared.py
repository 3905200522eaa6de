"""Where intermediate tables go, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors see.

    Where that setting is absent in a local session (tests only) the session
    gets a temporary folder of its own; a cluster without the setting is
    refused, for a machine-local folder would lose rows there. Nothing here
    deletes these tables, which results may still be read from: they live until
    the folder is cleared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidewave/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there,
    and what was computed survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sums_before(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """Adds sums over the rows before each row in its group, 0 at the first, without gathering a group in one task.

    Rows are range-partitioned by group and order, summed in each partition,
    and moved on by the group's sums in the partitions before, of which there
    is one row for each group and partition. rows have no null in group and no
    column of the name ``_part``.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(rows.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), name)
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = ranged.groupBy(*group, "_part").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    before = totals.select(*group, "_part", *(F.coalesce(F.sum(k).over(earlier), zero).alias(f"_{k}") for k in sums))
    here = ranged.select("*", *(F.coalesce(F.sum(v).over(inside), zero).alias(k) for k, v in sums.items()))
    return here.join(before, [*group, "_part"]).select(*rows.columns, *((F.col(k) + F.col(f"_{k}")).alias(k) for k in sums))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on 64-bit unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
