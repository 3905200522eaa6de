"""Readers of the engine's tables, and views of the driver's tables as trains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spikes(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """id, unit, t (microseconds), a (amplitude), e (event type) of all events, or of one type."""
    events = table(spark, sf_dir, "events")
    if kind is not None:
        events = events.filter(F.col("event_type") == kind)
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("unit"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("a"), F.col("event_type").alias("e"))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated unit tables with a header, such as unit groups."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """dataset, dp, ct, line, units, ss, cs of a JSON registry: one object, a dataset each key."""
    entry = "struct<dp:string,ct:string,line:string,units:array<int>,ss:array<int>,cs:array<int>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("dataset", "x")).select("dataset", "x.*")


def read_samples(spark: SparkSession, path: str, channels: int, frames: int = 65_536) -> DataFrame:
    """chunk, frame0, samples (frame by frame) of interleaved little-endian 16-bit recordings.

    Spark's binary reader lists the files; each file is cut into ranges of
    frames, and a task seeks to its range.
    """
    width = 2 * channels
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / (width * frames)).cast("int") - 1)).alias("chunk")).repartition("path", "chunk")

    def read(batches):
        import numpy as np
        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            out = []
            for path, chunk in zip(pdf.path, pdf.chunk, strict=True):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as f:
                    f.seek(chunk * frames * width)
                    raw = f.read(frames * width)
                out.append((path, chunk, chunk * frames, np.frombuffer(raw[: len(raw) // width * width], "<i2")))
            yield pd.DataFrame(out, columns=["path", "chunk", "frame0", "samples"])

    return ranges.mapInPandas(read, "path string, chunk int, frame0 long, samples array<smallint>")


def by_channel(chunks: DataFrame, channels: int) -> DataFrame:
    """channel, chunk, samples of chunks(chunk, samples frame by frame): the signal that the signal operators take. Chunks of a batch that are as long are turned together."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            samples = batch.column("samples")
            lengths = samples.value_lengths().to_numpy()
            if (lengths % channels).any():
                raise ValueError("a chunk has a frame that lacks channels")
            for size in np.unique(lengths):
                some = pa.array(lengths == size)
                chunk, values = batch.column("chunk").filter(some), samples.filter(some).flatten()
                # places first, so that values keep their type and nulls
                place = np.arange(len(values)).reshape(len(chunk), -1, channels).transpose(0, 2, 1) if size else np.zeros(0, np.int64)
                offsets = np.arange(len(chunk) * channels + 1, dtype=np.int32) * (size // channels)
                names = np.tile(np.arange(channels), len(chunk))
                each = np.repeat(np.arange(len(chunk)), channels)
                yield pa.RecordBatch.from_arrays([pa.array(names), chunk.take(pa.array(each)).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(place.ravel())))], ["channel", "chunk", "samples"])

    kind = dict(chunks.dtypes)["samples"]
    return chunks.select("chunk", F.coalesce("samples", F.array().cast(kind)).alias("samples")).mapInArrow(run, f"channel long, chunk long, samples {kind}")
