"""Readers of array files by ranges, and geometry that a rule generates."""

from __future__ import annotations

import ast
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _header(f) -> tuple[int, str, tuple[int, ...]]:
    """(offset of the data, dtype, shape) of a .npy file in C order."""
    if f.read(6) != b"\x93NUMPY":
        raise ValueError("not an array file")
    major = f.read(2)[0]
    (n,) = struct.unpack("<H", f.read(2)) if major == 1 else struct.unpack("<I", f.read(4))
    info = ast.literal_eval(f.read(n).decode("latin1"))
    if info["fortran_order"] and len(info["shape"]) > 1:
        raise ValueError("columns first are not read")
    return (10 if major == 1 else 12) + n, info["descr"], info["shape"]


def _ranges(spark: SparkSession, path: str, rows: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "length")
    # a row has at least a byte, so there are at most so many ranges; those beyond the end are empty
    return files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / rows))).alias("k")).repartition("path", "k")


def _read_rows(name: str, k: int, rows: int):
    """The kth stretch of rows of an array file, as an array of (rows, values of a row)."""
    import numpy as np
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(name)
    with system.open_input_file(at) as f:
        offset, descr, shape = _header(f)
        d = np.dtype(descr)
        width = int(np.prod(shape[1:]))
        n = max(0, min(rows, shape[0] - k * rows)) if shape else 0
        f.seek(offset + k * rows * width * d.itemsize)
        return np.frombuffer(f.read(n * width * d.itemsize), d).reshape(n, width)


def read_npy(spark: SparkSession, path: str, kind: str = "double", rows: int = 1 << 20) -> DataFrame:
    """path, row, value of one-dimensional .npy files, each cut into ranges of rows that tasks seek to.

    kind: the type of value. A file of shape (n, 1) counts as one-dimensional.
    """

    def read(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, k in zip(pdf.path, pdf.k, strict=True):
                x = _read_rows(name, k, rows)
                if x.shape[1] != 1:
                    raise ValueError("an array of one dimension is expected")
                yield pd.DataFrame({"path": name, "row": np.arange(k * rows, k * rows + len(x)), "value": x[:, 0]})

    return _ranges(spark, path, rows).mapInPandas(read, f"path string, row long, value {kind}")


def read_npy_rows(spark: SparkSession, path: str, kind: str = "double", rows: int = 1 << 12) -> DataFrame:
    """path, row, values of .npy files of any number of dimensions in C order: along the first one, the others flattened."""

    def read(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, k in zip(pdf.path, pdf.k, strict=True):
                x = _read_rows(name, k, rows).astype({"double": "f8", "float": "f4", "long": "i8", "int": "i4", "smallint": "i2"}[kind])
                if len(x):
                    yield pd.DataFrame({"path": name, "row": np.arange(k * rows, k * rows + len(x)), "values": list(x)})

    return _ranges(spark, path, rows).mapInPandas(read, f"path string, row long, values array<{kind}>")


def read_spike_folder(spark: SparkSession, folder: str) -> DataFrame:
    """spike_id, t, unit, amplitude, template of a sorter's folder of arrays, joined on the row."""
    out = None
    for name, column, kind in (("spike_times", "t", "long"), ("spike_clusters", "unit", "long"), ("amplitudes", "amplitude", "double"), ("spike_templates", "template", "long")):
        x = read_npy(spark, f"{folder}/{name}.npy", kind).select(F.col("row").alias("spike_id"), F.col("value").alias(column))
        out = x if out is None else out.join(x, "spike_id")
    return out


def read_paq(spark: SparkSession, path: str, channels: int, header_bytes: int, rate: float) -> DataFrame:
    """channel, i, seconds, v of big-endian 32-bit float recordings, frame by frame after a header."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    width, frames = 4 * channels, 65_536
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - header_bytes) / (width * frames)))).alias("k")).repartition("path", "k")

    def read(batches):
        import numpy as np
        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            for name, k in zip(pdf.path, pdf.k, strict=True):
                system, at = fs.FileSystem.from_uri(name)
                with system.open_input_file(at) as f:
                    f.seek(header_bytes + k * width * frames)
                    raw = f.read(width * frames)
                v = np.frombuffer(raw[: len(raw) // width * width], ">f4").astype("f4")
                i = np.arange(len(v)) // channels + k * frames
                yield pd.DataFrame({"channel": np.arange(len(v)) % channels, "i": i, "seconds": i / rate, "v": v})

    return ranges.mapInPandas(read, "channel int, i long, seconds double, v float")


def channel_map(spark: SparkSession, channels: int = 384, xs: tuple[int, ...] = (43, 11, 59, 27), row_height: int = 20) -> DataFrame:
    """channel, x, y of a probe whose sites repeat a pattern of x, two sites a row."""
    c = F.col("id")
    x = F.element_at(F.array(*(F.lit(v) for v in xs)), (c % len(xs) + 1).cast("int"))
    return spark.range(channels).select(c.cast("int").alias("channel"), x.alias("x"), (F.floor(c / 2) * row_height + row_height).cast("int").alias("y"))


def sync_edges(samples: DataFrame, bits: int = 16, block: int = 1 << 20) -> DataFrame:
    """bit, i, edge (1 on, -1 off) where a bit of the sync words changes. samples(i, word), i without gaps.

    Words are compared by blocks, each with the last word of the block before;
    only changes are taken apart into bits.
    """
    from pyspark.sql import Window

    rows = samples.select("i", F.col("word").cast("long").alias("word"), F.floor(F.col("i") / block).alias("block"))
    last = rows.groupBy("block").agg(F.max_by("word", "i").alias("carried")).select((F.col("block") + 1).alias("block"), "carried")
    near = rows.withColumn("near", F.lag("word").over(Window.partitionBy("block").orderBy("i")))
    firsts = near.filter("near IS NULL").join(last, "block").select("i", "word", F.col("carried").alias("old"))
    changed = near.filter("near <> word").select("i", "word", F.col("near").alias("old")).unionByName(firsts.filter("old <> word"))
    bit = F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))
    each = changed.select("i", bit.alias("bit"), "word", "old")
    on = lambda c: F.call_function("getbit", F.col(c), F.col("bit")).cast("int")
    return each.withColumn("edge", on("word") - on("old")).filter("edge <> 0").select("bit", "i", "edge")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, key, value of the key=value lines of text files."""
    lines = spark.read.text(path).withColumn("path", F.input_file_name()).filter(F.col("value").contains("="))
    return lines.select("path", F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.expr("substring(value, instr(value, '=') + 1)")).alias("value"))


def open_ephys_metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, version, stream, rate, channels of the JSON files that describe a recording's continuous streams; a row for each stream."""
    stream = "struct<folder_name:string,sample_rate:double,num_channels:int>"
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", f"`GUI version` string, continuous array<{stream}>").alias("x"))
    each = text.select("path", F.col("x.`GUI version`").alias("version"), F.explode("x.continuous").alias("c"))
    return each.select("path", "version", F.rtrim("c.folder_name", F.lit("/")).alias("stream"), F.col("c.sample_rate").alias("rate"), F.col("c.num_channels").alias("channels"))
