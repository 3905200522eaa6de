"""Waveforms of spikes out of recorded signals: snippets, their means, templates, and means that allow for drift."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewave.operators.waveforms import peak_to_peak


def snippets(spikes: DataFrame, signal: DataFrame, frames: int, before: int, after: int, more: Sequence[str] = ()) -> DataFrame:
    """unit, id, more, channel, wave: samples from t - before to t + after - 1 on every channel.

    spikes(unit, id, t in samples from 0, more), signal(channel, chunk from 0,
    samples) in chunks of so many frames, the last one shorter. A chunk is
    lengthened by what a window that begins in it can reach, so a spike meets
    only the chunk that its window begins in: waves are cut out there and not
    shuffled. A window that leaves the recording gives no wave.
    """
    size = before + after
    start = F.col("t") - before
    wanted = spikes.filter(start >= 0).select("unit", "id", *more, start.alias("start"), F.floor(start / frames).alias("chunk"))
    wave = F.slice("samples", (F.col("start") - F.col("chunk") * frames + 1).cast("int"), F.lit(size))
    cut = wanted.join(_lengthened(signal, frames, size - 1), "chunk").select("unit", "id", *more, "channel", wave.alias("wave"))
    return cut.filter(F.size("wave") == size)


def _lengthened(signal: DataFrame, frames: int, reach: int) -> DataFrame:
    """The chunks with up to reach samples of those that follow without a gap."""
    ahead = -(-reach // frames)
    given = F.explode(F.sequence(F.lit(0), F.lit(ahead)))
    parts = signal.select("channel", "chunk", given.alias("_k"), "samples").select("channel", (F.col("chunk") - F.col("_k")).alias("chunk"), "_k", F.when(F.col("_k") == 0, F.col("samples")).otherwise(F.slice("samples", F.lit(1), F.greatest(F.least(F.lit(frames), reach - (F.col("_k") - 1) * frames), F.lit(0)))).alias("samples"))
    own = parts.groupBy("channel", "chunk").agg(F.array_sort(F.collect_list(F.struct("_k", "samples"))).alias("_p"))
    whole = F.transform(F.filter("_p", lambda x, i: x["_k"] == i), lambda x: x["samples"])
    return own.filter(F.get("_p", F.lit(0))["_k"] == 0).select("channel", "chunk", F.flatten(whole).alias("samples"))


def in_recording(spikes: DataFrame, signal: DataFrame, frames: int, before: int, after: int) -> DataFrame:
    """The spikes whose window is in the recording, as snippets takes it: those with a wave on some channel."""
    columns = spikes.columns
    more = [c for c in columns if c not in ("unit", "id")]
    return snippets(spikes, signal, frames, before, after, more).select(*columns).distinct()


def median_removed(waves: DataFrame) -> DataFrame:
    """Each wave less the median of its own samples."""
    return waves.withColumn("wave", F.transform("wave", lambda x: x - median(F.col("wave"))))


def median(a: Column) -> Column:
    ordered, n = F.array_sort(a), F.size(a)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def mean_waves(waves: DataFrame, by: list[str] | None = None, held: int = 1 << 22) -> DataFrame:
    """by, n, wave: the mean of each sample over the waves of a unit (or other groups) and channel.

    A task sums its waves first, as many groups as make held samples at a time,
    so what is shuffled is one array for each group and task. Shorter waves
    count where they have samples.
    """
    by = by or ["unit", "channel"]
    fields = {f.name: f.dataType for f in waves.schema.fields}
    types = pa.schema([*((c, to_arrow_type(fields[c])) for c in by), ("n", pa.int64()), ("total", pa.list_(pa.float64()))])

    def folded(keys: pd.DataFrame, n: np.ndarray, total: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        code = keys.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        return keys.iloc[order[first]].reset_index(drop=True), np.add.reduceat(n[order], first), np.add.reduceat(total[order], first, axis=0)

    def merged(parts: list) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        keys, n, total = zip(*parts, strict=True)
        return folded(pd.concat(keys, ignore_index=True), np.concatenate(n), np.concatenate(total))

    def batch_of(keys: pd.DataFrame, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * total.shape[1])
        columns = [pa.Array.from_pandas(keys[c], type=types.field(c).type) for c in by]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], schema=types)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}  # by length: what is summed so far, in parts
        for batch in batches:
            wave = batch.column("wave")
            known = pa.array(wave.is_valid().to_numpy(zero_copy_only=False))
            batch, wave = batch.filter(known), wave.filter(known)
            lengths = wave.value_lengths().to_numpy()
            keys = batch.select(by).to_pandas(integer_object_nulls=True)
            for size in np.unique(lengths[lengths > 0]):
                some = lengths == size
                values = wave.filter(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                parts = kept.setdefault(size, [])
                parts.append(folded(keys[some].reset_index(drop=True), np.ones(some.sum(), np.int64), values))
                if sum(p[2].size for p in parts) > held:
                    one = merged(parts)
                    kept[size] = [one]
                    if one[2].size > held // 2:
                        yield batch_of(*kept.pop(size)[0])
        for parts in kept.values():
            yield batch_of(*merged(parts))

    schema = ", ".join(f"`{c}` {fields[c].simpleString()}" for c in by) + ", n long, total array<double>"
    parts = waves.select(*by, F.col("wave").cast("array<double>").alias("wave")).mapInArrow(sums, schema)
    add = lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))
    both = F.struct(F.array().cast("array<double>").alias("t"), F.array().cast("array<double>").alias("n"))
    total = F.aggregate(F.collect_list(F.struct("n", "total")), both, lambda s, x: F.struct(F.zip_with(s["t"], x["total"], add).alias("t"), F.zip_with(s["n"], F.transform(x["total"], lambda _: x["n"].cast("double")), add).alias("n")))
    each = parts.groupBy(*by).agg(total.alias("_s"))
    return each.select(*by, F.array_max("_s.n").cast("long").alias("n"), F.zip_with("_s.t", "_s.n", lambda t, n: t / n).alias("wave")).filter("n IS NOT NULL")


def best_channel(means: DataFrame, by: list[str]) -> DataFrame:
    """by, channel, ptp of the channel with the largest peak to peak; the lowest of equals."""
    best = F.max(F.struct(peak_to_peak(F.col("wave")).alias("ptp"), (-F.col("channel")).alias("c")))
    return means.groupBy(*by).agg(best.alias("x")).select(*by, (-F.col("x.c")).alias("channel"), "x.ptp")


def templates_of(spikes: DataFrame) -> DataFrame:
    """unit, template, share of a unit's spikes that come from each template. spikes(unit, template)."""
    n = spikes.groupBy("unit", "template").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("unit"))).select("unit", "template", "share")


def noise_ratio(waves: DataFrame, noise: DataFrame) -> DataFrame:
    """unit, snr, snr_db of the mean wave's peak to peak over twice the deviation of noise(unit, v)."""
    ptp = mean_waves(waves, ["unit"]).select("unit", peak_to_peak(F.col("wave")).alias("ptp"))
    sd = noise.groupBy("unit").agg(F.stddev_pop("v").alias("sd"))
    snr = F.try_divide(F.col("ptp"), 2 * F.col("sd"))
    return ptp.join(sd, "unit").select("unit", snr.alias("snr"), (20 * F.log10(snr)).alias("snr_db"))


def template_ratio(waves: DataFrame, noise: DataFrame, half: int = 3) -> DataFrame:
    """unit, snr: by how many deviations of noise a unit's waves lie above it, along the unit's mean wave on the channels at most half from its largest.

    waves and noise: (unit, id, channel, wave of the same length); noise is of
    stretches near the spikes (moved_times). Null where noise doesn't vary.
    """
    means = mean_waves(waves)
    peaks = best_channel(means, ["unit"]).select("unit", F.col("channel").alias("_peak"))
    used = means.join(peaks, "unit").filter(F.abs(F.col("channel") - F.col("_peak")) <= half).select("unit", "channel", F.col("wave").alias("_mean"))

    def along(w: DataFrame) -> DataFrame:
        dot = F.aggregate(F.zip_with("wave", "_mean", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        # the mean waves of a probe's units go to the waves, which are not shuffled
        return w.join(F.broadcast(used), ["unit", "channel"]).groupBy("unit", "id").agg(F.sum(dot).alias("v"))

    signal = along(waves).groupBy("unit").agg(F.avg("v").alias("s"))
    rest = along(noise).groupBy("unit").agg(F.avg("v").alias("n"), F.stddev_pop("v").alias("d"))
    return signal.join(rest, "unit").select("unit", F.when(F.col("d") > 0, (F.col("s") - F.col("n")) / F.col("d")).alias("snr"))


def moved_times(spikes: DataFrame, reach: int, seed: int = 0) -> DataFrame:
    """The spikes (unit, id, t) at times from t - reach to t + reach - 1, by a hash of unit, id and seed: where to look for noise."""
    return spikes.withColumn("t", F.col("t") + F.pmod(F.xxhash64("unit", "id", F.lit(seed)), F.lit(2 * reach)) - reach)


def time_batches(spikes: DataFrame, size: int = 10) -> DataFrame:
    """Adds batch: a unit's spikes(unit, id, t, ...) in order of time, so many to a batch, from 0."""
    order = Window.partitionBy("unit").orderBy("t", "id")
    return spikes.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size))


def drift_matched(waves: DataFrame, batch: int = 10, most: int = 20, reach: int = 10, high: float = 0.95) -> DataFrame:
    """unit, channel, batches, wave: the mean over batches of spikes that were recorded alike.

    waves(unit, id, t, channel, wave), or with batch instead of id and t, as
    time_batches gives it to the spikes, so that waves need not be shuffled to
    get it. A unit's spikes in order of time make batches. Of those whose largest channel is the unit's most frequent one,
    at most so many are kept, the largest that are not above the quantile high
    of their peaks to peak. Each is moved by up to reach samples to where it
    fits the largest kept one best on that channel, and their mean is taken.
    """
    if "batch" not in waves.columns:
        places = time_batches(waves.select("unit", "id", "t").distinct(), batch)
        waves = waves.join(places.drop("t"), ["unit", "id"])
    means = mean_waves(waves, ["unit", "batch", "channel"])
    peaks = best_channel(means, ["unit", "batch"])
    common = peaks.groupBy("unit", "channel").agg(F.count("*").alias("c")).groupBy("unit").agg((-F.max(F.struct("c", (-F.col("channel")).alias("m")))["m"]).alias("channel"))
    near = peaks.join(common, ["unit", "channel"])
    caps = near.groupBy("unit").agg(F.percentile("ptp", F.lit(high)).alias("cap"))
    rank = F.row_number().over(Window.partitionBy("unit").orderBy(F.col("ptp").desc(), "batch"))
    kept = near.join(caps, "unit").filter("ptp <= cap").withColumn("rank", rank).filter(F.col("rank") <= most).select("unit", F.col("channel").alias("peak"), "batch", "rank")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        # at most so many batches of each channel
        peak = int(pdf.peak.iloc[0])
        by_rank = {int(r): {int(c): np.asarray(w, float) for c, w in zip(g.channel, g.wave, strict=True)} for r, g in pdf.groupby("rank")}
        first = by_rank[min(by_rank)][peak]
        moved: dict[int, list[np.ndarray]] = {}
        for rank in sorted(by_rank):
            one = by_rank[rank][peak]
            shifts = range(-reach, reach + 1)
            fit = [float(np.dot(_moved(one, s), first)) for s in shifts]
            s = max(zip(fit, [-abs(s) for s in shifts], shifts, strict=True))[2]
            for c, w in by_rank[rank].items():
                moved.setdefault(c, []).append(_moved(w, s))
        return pd.DataFrame([(pdf.unit.iloc[0], c, len(w), np.mean(w, axis=0)) for c, w in sorted(moved.items())], columns=["unit", "channel", "batches", "wave"])

    # at most so many rows for each unit
    return means.join(F.broadcast(kept), ["unit", "batch"]).select("unit", "channel", "peak", "rank", "wave").groupBy("unit").applyInPandas(match, "unit long, channel long, batches long, wave array<double>")


def _moved(w: np.ndarray, s: int) -> np.ndarray:
    """The wave s samples later, its ends repeated."""
    return w[np.clip(np.arange(len(w)) - s, 0, len(w) - 1)]
