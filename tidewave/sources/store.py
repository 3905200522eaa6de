"""The neuron store: a Parquet table with one row for each neuron, built from registries, renewed, listed and read by field.

A neuron is (dataset, unit); neuron_id is the lab, data set and unit joined by
slashes, so adding it again finds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listed_units(registry: DataFrame) -> DataFrame:
    """dataset, unit, label, line of a registry(dataset, ct, line, units, ss, cs), each unit once.

    Units of ss are simple spikes and those of cs complex spikes of Purkinje
    cells, whatever ct says; a unit in both is a simple spike.
    """
    lists = [("ss", F.lit("PkC_ss"), 0), ("cs", F.lit("PkC_cs"), 1), ("units", F.col("ct"), 2)]
    out = None
    for name, label, rank in lists:
        x = registry.select("dataset", F.explode(F.col(name).cast("array<long>")).alias("unit"), F.struct(F.lit(rank).alias("rank"), label.alias("label")).alias("of"), "line")
        out = x if out is None else out.unionByName(x)
    return out.groupBy("dataset", "unit").agg(F.min("of")["label"].alias("label"), F.min_by("line", "of").alias("line"))


def neurons(spikes: DataFrame, listed: DataFrame, lab: str, waves: DataFrame | None = None, periods: DataFrame | None = None) -> DataFrame:
    """The store's rows of the listed units(dataset, unit, label, line) that have spikes(dataset, unit, t).

    spike_times is the unit's train in order, sane whether each is in one of
    its periods(dataset, unit, start, stop), both ends in; all are without
    periods. waves(dataset, unit, channel, wave) become an array by channel.
    """
    train = spikes.join(listed.select("dataset", "unit"), ["dataset", "unit"], "left_semi").groupBy("dataset", "unit").agg(F.array_sort(F.collect_list("t")).alias("spike_times"))
    out = listed.join(train, ["dataset", "unit"])
    if periods is None:
        out = out.withColumn("sane", F.transform("spike_times", lambda t: F.lit(True)))
    else:
        own = periods.groupBy("dataset", "unit").agg(F.collect_list(F.struct("start", "stop")).alias("_p"))
        held = F.transform("spike_times", lambda t: F.exists(F.coalesce("_p", F.array().cast("array<struct<start:long,stop:long>>")), lambda p: t.between(p["start"], p["stop"])))
        out = out.join(own, ["dataset", "unit"], "left").withColumn("sane", held).drop("_p")
    if waves is not None:
        ordered = F.array_sort(F.collect_list(F.struct("channel", "wave")))
        out = out.join(waves.groupBy("dataset", "unit").agg(ordered.alias("mean_waves")), ["dataset", "unit"], "left")
    return out.withColumn("lab", F.lit(lab)).withColumn("neuron_id", F.concat_ws("/", F.lit(lab), "dataset", "unit"))


def renewed(store: DataFrame, new: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """The store with the new rows. A neuron that it has already is replaced; with fields only these of it are.

    Columns that either lacks are null there, but fields must be in new.
    """
    key = ["dataset", "unit"]
    if fields is None:
        return store.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    some = new.select(*key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_new_{c}") for c in fields))
    kept = [c for c in store.columns if c not in (*key, *fields)]
    value = lambda c: F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c) if c in store.columns else F.lit(None)).alias(c)
    old = store.join(some, key, "left").select(*key, *kept, *(value(c) for c in fields))
    return old.unionByName(new.join(store.select(*key), key, "left_anti"), allowMissingColumns=True)


def contents(store: DataFrame) -> DataFrame:
    """dataset, unit, neuron_id, lab and label of all neurons: a scan of these columns only."""
    return store.select("dataset", "unit", "neuron_id", "lab", "label")


def field(store: DataFrame, path: str) -> DataFrame:
    """dataset, unit, value of the field at lab/dataset/unit/field, or datasets/dataset/unit/field: a scan of one column, with the neuron pushed down. A field that isn't there fails."""
    owner, dataset, unit, name = path.split("/")
    if name not in store.columns:
        raise KeyError(f"{name} is no field of the store")
    rows = store.filter((F.col("dataset") == dataset) & (F.col("unit") == int(unit)))
    return (rows if owner == "datasets" else rows.filter(F.col("lab") == owner)).select("dataset", "unit", F.col(name).alias("value"))


def write_measures(table: DataFrame, folder: str, unit: str = "unit") -> list[str]:
    """A tab-separated table cluster_id and measure for each further column, in a folder of its own that a curation tool reads; rows are units. The folders' names."""
    out = []
    for name in (c for c in table.columns if c != unit):
        out.append(f"{folder}/cluster_{name}.tsv")
        table.select(F.col(unit).alias("cluster_id"), name).orderBy("cluster_id").coalesce(1).write.mode("overwrite").csv(out[-1], sep="\t", header=True)
    return out


def write_channels(chunks: DataFrame, folder: str, channels: int, first: int, last: int) -> tuple[int, int]:
    """Writes the channels first to last of chunks(chunk, samples frame by frame) as 16-bit parts in a folder; the number of files and of bytes.

    A chunk is a file of its own, named by its number, so the parts in order of
    name are the recording, and a task that is run again writes the same file.
    """
    if not 0 <= first <= last < channels:
        raise ValueError("no such channels")

    def write(batches):
        import numpy as np
        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            system, root = fs.FileSystem.from_uri(folder)
            system.create_dir(root, recursive=True)
            sizes = []
            for chunk, samples in zip(pdf.chunk, pdf.samples, strict=True):
                data = np.asarray(samples, "<i2").reshape(-1, channels)[:, first : last + 1].tobytes()
                with system.open_output_stream(f"{root}/part-{chunk:012d}.bin") as f:
                    f.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"bytes": sizes})

    written = chunks.select("chunk", "samples").mapInPandas(write, "bytes long")
    files, size = written.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return files, size
