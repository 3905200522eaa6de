"""Weighted rendezvous hashing of record keys, with gapless places in shards.

A key's score in a shard is -weight / ln(u), where u in (0, 1) comes from the
md5 of key and shard number; the key goes to the shard of its highest score
(the lower number on a tie). One more shard changes no other score, so rows
move only into it. A null key hashes as the empty string.

Null text: size 1 and the checksum of nothing. Very long texts are measured
whole. Empty table: no rows. Rows that repeat, and ties, get places of their
own. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, text_or_empty


def unit_hash(key: Column, salt: int) -> Column:
    """In (0, 1), from the first 48 bits of an md5."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{salt}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among len(weights) shards."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights are 0 or more, and one is above 0")
    best = F.greatest(*(F.struct((F.lit(float(w)) / -F.log(unit_hash(key, i))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights))) if len(weights) > 1 else F.struct(F.lit(0).alias("shard"))
    return (-best["shard"]).cast("int")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    slot numbers a shard's rows by doc_id: rows are range-partitioned by
    doc_id, numbered within partition and shard, and moved on by the counts of
    the partitions before. The counts are one row for each shard and
    partition. grown: the weights with further shards; null without.
    """
    key = F.col("doc_id")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["doc_id", "text_crc32", "size", "tie"]
    ranged = materialise(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "sharded")
    counts = ranged.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)) - 1
    return (
        ranged.withColumn("place", place)
        .join(before, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("before")).cast("long").alias("slot"), "grown_shard")
    )

