"""Unit tables and the neuron store: qualities, labels, registry rows, appends and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.functions.timeline import numbered


def unsorted(spikes: DataFrame) -> DataFrame:
    """unit, group of every unit that has spikes."""
    return spikes.select("unit").distinct().withColumn("group", F.lit("unsorted"))


def repaired(qualities: DataFrame, spikes: DataFrame) -> DataFrame:
    """The known qualities of units that have spikes, and the others as unsorted."""
    present = spikes.select("unit").distinct()
    return present.join(qualities, "unit", "left").select("unit", F.coalesce("group", F.lit("unsorted")).alias("group"))


def is_stale(qualities: DataFrame, spikes: DataFrame) -> bool:
    """Whether some unit with spikes has no quality."""
    return spikes.select("unit").distinct().join(qualities, "unit", "left_anti").limit(1).count() > 0


def units(qualities: DataFrame, quality: str | None = None, peaks: DataFrame | None = None, channels: tuple[int, int] | None = None) -> DataFrame:
    """Units of a quality, in a range of peak channels (both ends)."""
    out = qualities if quality is None else qualities.filter(F.col("group") == quality)
    if channels is not None:
        out = out.join(peaks.filter(F.col("channel").between(*channels)).select("unit"), "unit", "left_semi")
    return out.select("unit")


def by_depth(peaks: DataFrame) -> DataFrame:
    """dataset, unit, channel: deepest last within a dataset's channels, which fall."""
    return peaks.orderBy("dataset", F.col("channel").desc(), "unit")


def append_unit(spikes: DataFrame, train: DataFrame) -> DataFrame:
    """The spikes with a train (t, amplitude, template) as a new unit, one above the highest."""
    top = spikes.agg((F.coalesce(F.max("unit"), F.lit(-1)) + 1).alias("unit"))
    return spikes.unionByName(train.join(F.broadcast(top)), allowMissingColumns=True)


def merged_qualities(named: dict[int, DataFrame]) -> DataFrame:
    """dataset, unit, group of several datasets."""
    out = None
    for dataset, q in named.items():
        x = q.select(F.lit(dataset).alias("dataset"), "unit", "group")
        out = x if out is None else out.unionByName(x)
    return out


def add_neurons(store: str, neurons: DataFrame) -> None:
    """Appends rows to the neuron store, a Parquet table partitioned by dataset."""
    neurons.write.mode("append").partitionBy("dataset").parquet(store)


def relabelled(neurons: DataFrame, labels: DataFrame, allowed: list[str]) -> DataFrame:
    """The store's rows with the labels(dataset, unit, label) given; a label that isn't allowed fails the job."""
    bad = F.raise_error(F.concat(F.lit("no such label: "), F.col("label")))
    checked = labels.select("dataset", "unit", F.when(F.col("label").isin(allowed), F.col("label")).otherwise(bad).alias("_label"))
    return neurons.join(checked, ["dataset", "unit"], "left").withColumn("label", F.coalesce("_label", "label")).drop("_label")


def without(neurons: DataFrame, gone: DataFrame) -> DataFrame:
    return neurons.join(gone, ["dataset", "unit"], "left_anti")


def combined_features(left: DataFrame, right: DataFrame) -> DataFrame:
    """A left join on all columns that both have, the right one's cast to the left one's types."""
    common = [c for c in left.columns if c in right.columns]
    types = dict(left.dtypes)
    return left.join(right.select(*(F.col(c).cast(types[c]) if c in common else F.col(c) for c in right.columns)), common, "left")


def unusable(features: DataFrame, names: list[str], most_zeros: int = 5) -> DataFrame:
    """Rows with too many zeros, or a null or a value that isn't finite."""
    zeros = sum((F.when(F.col(c) == 0, 1).otherwise(0) for c in names), F.lit(0))
    odd = F.lit(False)
    for c in names:
        x = F.col(c).cast("double")
        odd = odd | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return features.filter((zeros > most_zeros) | odd)


def decoded(u: Column) -> tuple[Column, Column]:
    """(dataset, unit) of units named unit + dataset / 10."""
    return F.round(F.pmod(u, F.lit(1.0)) * 10).cast("long"), F.floor(u).cast("long")


def write_qualities(qualities: DataFrame, path: str) -> None:
    """A tab-separated table cluster_id, group, in order of unit: rows are units."""
    qualities.select(F.col("unit").alias("cluster_id"), "group").orderBy("cluster_id").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def recording_length(spikes: DataFrame, ticks_per_second: float = 1.0) -> DataFrame:
    """dataset, length: the time of a dataset's last spike."""
    return spikes.groupBy("dataset").agg((F.max("t") / F.lit(ticks_per_second)).alias("length"))


def without_labels(neurons: DataFrame) -> DataFrame:
    return neurons.withColumn("label", F.lit(None).cast("string"))


def union_of_stores(stores: list[DataFrame]) -> DataFrame:
    """All stores' rows; of a dataset and unit that several have, those of the first one."""
    out = stores[0]
    for more in stores[1:]:
        out = out.unionByName(more.join(out.select("dataset", "unit"), ["dataset", "unit"], "left_anti"), allowMissingColumns=True)
    return out


def connected_pairs(pairs: DataFrame, p: float) -> DataFrame:
    """a, b, connected: whether a pair's least p value of any test is under p. pairs(a, b, p)."""
    return pairs.groupBy("a", "b").agg((F.min("p") < p).alias("connected"))


def split_features(features: DataFrame, target: str, dropped: list[str], bad: DataFrame | None = None, key: str = "unit") -> tuple[DataFrame, DataFrame]:
    """(key and features, key and target) without the dropped columns and the bad rows(key)."""
    rows = features if bad is None else features.join(bad.select(key), key, "left_anti")
    return rows.drop(target, *dropped), rows.select(key, target)


def dense_labels(rows: DataFrame, column: str) -> DataFrame:
    """The rows with place: the rank of their label among the distinct ones of 0 and more, from 0; null for other labels."""
    known = numbered(rows.filter(F.col(column) >= 0).select(column).distinct(), column)
    return rows.join(known, column, "left")


def masked_rows(x: Column, mask: Column) -> Column:
    """Of each inner array of x the values where that of mask is true, which may leave rows of different lengths."""
    pair = lambda v, k: F.struct(v.alias("v"), k.alias("k"))
    return F.zip_with(x, mask, lambda a, m: F.transform(F.filter(F.zip_with(a, m, pair), lambda p: p["k"]), lambda p: p["v"]))
