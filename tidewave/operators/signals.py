"""Recorded signals in chunks: filters with halos, whitening, gain control, spectra, resampling.

A signal is a table (channel, chunk, samples array); chunks of a channel
follow each other without gaps. An operator needs a halo of neighbouring
samples, or the channels of one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewave.operators.linear import whitening


#: So many numbers of chunks make a run, whose samples meet in one row: a chunk costs no halo or row of its own.
RUN = 32
#: The most samples of halos that a task cuts out at once, unless a run's are more.
HALOS = 1 << 22


def _runs(signal: DataFrame, halo: int) -> DataFrame:
    """channel, run, chunks, before, after: the chunks of a run in order, and the halo samples on each side of it, fewer at the ends of a channel.

    A run gives its first and last samples, at most halo of each, to the cells
    of that width in which they lie, and takes from the cells that its halos
    reach into. So runs of any sizes meet those next to them by an equi-join,
    and a channel's recording is never in one task. Rows without a channel or
    a chunk have no place in a recording and are left out.
    """
    none = F.slice("samples", 1, 0)
    rest = [c for c in signal.columns if c not in ("channel", "chunk")]
    known = signal.filter("channel IS NOT NULL AND chunk IS NOT NULL").withColumn("samples", F.coalesce("samples", F.array().cast(signal.schema["samples"].dataType)))
    runs = known.groupBy("channel", F.floor(F.col("chunk") / RUN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("chunk", *rest))).alias("chunks"))
    nothing = F.lit(None).cast(signal.schema["samples"].dataType)
    if not halo:
        return runs.withColumn("before", nothing).withColumn("after", nothing)
    # only sizes are put in order
    sizes = runs.select("channel", "run", F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + F.size(c["samples"])).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("channel").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.select("channel", "run", F.coalesce(ahead, F.lit(0).cast("long")).alias("start"), "n")
    whole = runs.select("channel", "run", F.flatten(F.transform("chunks", lambda c: c["samples"])).alias("samples"))
    both = whole.select("channel", "run", F.slice("samples", 1, halo).alias("head"), F.slice("samples", F.greatest(F.size("samples") - halo, F.lit(0)) + 1, F.lit(halo)).alias("tail")).join(placed, ["channel", "run"])
    ends = F.array(F.struct(F.lit(0).alias("side"), (F.col("start") + F.col("n") - F.size("tail")).alias("first"), F.col("tail").alias("part")), F.struct(F.lit(1).alias("side"), F.col("start").alias("first"), F.col("head").alias("part")))
    cell = lambda place: F.floor(place / F.lit(halo))
    given = both.filter("n > 0").select("channel", F.explode(ends).alias("e")).select("channel", "e.*").withColumn("cell", F.explode(F.sequence(cell(F.col("first")), cell(F.col("first") + F.size("part") - 1))))
    # each cell's part of a piece, so that nothing meets twice
    low, high = F.greatest(F.col("first"), F.col("cell") * halo), F.least(F.col("first") + F.size("part"), (F.col("cell") + 1) * halo)
    given = given.select("channel", "side", "cell", low.alias("first"), F.slice("part", (low - F.col("first")).cast("int") + 1, (high - low).cast("int")).alias("part"))
    reach = F.array(F.struct(F.lit(0).alias("side"), (F.col("start") - halo).alias("from"), F.col("start").alias("to")), F.struct(F.lit(1).alias("side"), (F.col("start") + F.col("n")).alias("from"), (F.col("start") + F.col("n") + halo).alias("to")))
    wanted = placed.select("channel", "run", F.explode(reach).alias("r")).select("channel", "run", "r.*").withColumn("cell", F.explode(F.sequence(cell(F.col("from")), cell(F.col("to") - 1))))
    met = wanted.join(given, ["channel", "side", "cell"])
    low, high = F.greatest("first", "from"), F.least(F.col("first") + F.size("part"), F.col("to"))
    met = met.filter(low < high).select("channel", "run", "side", low.alias("at"), F.slice("part", (low - F.col("first")).cast("int") + 1, (high - low).cast("int")).alias("part"))
    whole = lambda side: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("at", "part")))), lambda x: x["part"]))
    return runs.join(met.groupBy("channel", "run").agg(whole(0).alias("before"), whole(1).alias("after")), ["channel", "run"], "left")


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, n of them, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Lines:
    """The runs of a batch laid out end to end, each with its halos; fields are arrays of chunks, places those in values.

    columns: the chunks' columns by name, channel among them. values: all
    samples. run: a chunk's run in the batch. at, n: its first sample's place,
    and its samples. low, high: where its run with its halos begins and ends.
    """

    def __init__(self, batch: pa.RecordBatch):
        chunks, before, after = (batch.column(c) for c in ("chunks", "before", "after"))
        count = chunks.value_lengths().to_numpy()
        items = chunks.flatten()
        self.run = np.repeat(np.arange(len(count)), count)
        self.columns = {"channel": batch.column("channel").take(pa.array(self.run))} | {f.name: x for f, x in zip(items.type, items.flatten(), strict=True)}
        samples = self.columns["samples"]
        self.n = samples.value_lengths().to_numpy().astype(np.int64)
        ahead = np.cumsum(self.n) - self.n
        sizes = [before.value_lengths().fill_null(0).to_numpy(), np.bincount(self.run, self.n, len(count)).astype(np.int64), after.value_lengths().fill_null(0).to_numpy()]
        total = sum(sizes)
        low = np.cumsum(total) - total
        places = np.concatenate([_spans(low, sizes[0]), _spans(low + sizes[0], sizes[1]), _spans(low + sizes[0] + sizes[1], sizes[2])])
        order = np.empty(len(places), np.int64)
        order[places] = np.arange(len(places))
        self.values = pa.concat_arrays([before.flatten(), samples.flatten(), after.flatten()]).take(pa.array(order))
        self.at = ahead + (low + sizes[0] - (np.cumsum(sizes[1]) - sizes[1]))[self.run]
        self.low, self.high = low[self.run], (low + total)[self.run]

    def cut(self, first: np.ndarray, n: np.ndarray) -> pa.ListArray:
        """A list for each chunk: n values from a place on."""
        return _lists(self.values.take(pa.array(_spans(first, n))), n)


def _lists(values: pa.Array, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)


def with_halo(signal: DataFrame, halo: int) -> DataFrame:
    """Adds before and after: the halo samples on each side of a chunk, fewer at the ends of a channel. Chunks are cut out of their runs."""
    fields = [*signal.columns, "before", "after"]
    step = max(1, HALOS // (2 * RUN * max(halo, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), step):
                x = _Lines(batch.slice(k, step))
                first, end = np.maximum(x.at - halo, x.low), x.at + x.n
                x.columns |= {"before": x.cut(first, x.at - first), "after": x.cut(end, np.minimum(end + halo, x.high) - end)}
                yield pa.RecordBatch.from_arrays([x.columns[c] for c in fields], fields)

    kind = signal.schema["samples"].dataType
    schema = StructType([*signal.schema.fields, StructField("before", kind), StructField("after", kind)])
    return _runs(signal, halo).mapInArrow(run, schema)


def filtered(signal: DataFrame, kernel: np.ndarray, rectified: bool = False, keep: bool = False) -> DataFrame:
    """Convolution with a kernel of odd length, zeros beyond the recording; chunk by chunk, the same as over the whole.

    The runs of a batch are convolved in one go. rectified: of absolute values.
    keep: samples stay, and the convolution is level.
    """
    half = len(kernel) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _Lines(batch)
            values = x.values.to_numpy(zero_copy_only=False).astype(float)
            # a line of runs, each between half zeros
            gap, one = half * (2 * np.arange(len(batch)) + 1), np.flatnonzero(np.diff(x.run, prepend=-1))
            y = np.zeros(len(values) + 2 * half * len(batch))
            y[_spans(x.low[one] + gap, x.high[one] - x.low[one])] = np.abs(values) if rectified else values
            y = np.convolve(y, kernel, "valid") if len(values) else values
            level = _lists(pa.array(y[_spans(x.at + gap[x.run] - half, x.n)]), x.n)
            x.columns |= {"level": level} if keep else {"samples": level}
            yield pa.RecordBatch.from_arrays([x.columns[c].cast(types[c]) for c in types], list(types))

    doubles = pa.list_(pa.float64())
    types = {"channel": pa.int64(), "chunk": pa.int64(), "samples": doubles} | ({"level": doubles} if keep else {})
    schema = "channel long, chunk long, samples array<double>" + (", level array<double>" if keep else "")
    return _runs(signal.select("channel", "chunk", "samples"), half).mapInArrow(run, schema)


def band_kernel(rate: float, low: float | None, high: float | None, taps: int = 101) -> np.ndarray:
    """A windowed-sinc band pass; low None: low pass, high None: high pass."""
    t = np.arange(taps) - taps // 2
    window = np.hamming(taps)

    def low_pass(f: float) -> np.ndarray:
        k = 2 * f / rate * np.sinc(2 * f / rate * t) * window
        return k / k.sum()

    one = np.zeros(taps)
    one[taps // 2] = 1
    k = low_pass(high) if high else one
    return k - low_pass(low) if low else k


def butterworth_kernel(rate: float, low: float | None, high: float | None, order: int = 3, taps: int = 2001) -> np.ndarray:
    """The kernel of a Butterworth filter run forwards and backwards, so without a shift of phase; cut to an odd number of taps.

    low None: low pass, high None: high pass, both: band pass.
    """
    size = 1 << (4 * taps).bit_length()
    f = np.fft.rfftfreq(size, 1 / rate)
    w = np.tan(np.pi * np.minimum(f, 0.499999 * rate) / rate)
    a = None if low is None else np.tan(np.pi * low / rate)
    b = None if high is None else np.tan(np.pi * high / rate)
    with np.errstate(divide="ignore"):
        x = w / b if a is None else a / w if b is None else (w * w - a * b) / (w * (b - a))
    k = np.fft.irfft(1 / (1 + x ** (2 * order)), size)
    return np.concatenate([k[-(taps // 2) :], k[: taps // 2 + 1]])


def cross_correlated(pairs: DataFrame) -> DataFrame:
    """u1, u2, lags, values of pairs(u1, u2, x, y arrays): the sum of x(t) y(t + lag) for each lag at which they overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lags, values = [], []
            for x, y in zip(pdf.x, pdf.y, strict=True):
                n = len(x) + len(y) - 1
                f = np.fft.rfft(np.asarray(x, float)[::-1], n) * np.fft.rfft(np.asarray(y, float), n)
                values.append(np.fft.irfft(f, n))
                lags.append(np.arange(n) - (len(x) - 1))
            yield pd.DataFrame({"u1": pdf.u1, "u2": pdf.u2, "lags": lags, "values": values})

    return pairs.filter("size(x) > 0 AND size(y) > 0").mapInPandas(run, "u1 long, u2 long, lags array<long>, values array<double>")


def _matrices(signal: DataFrame) -> DataFrame:
    """chunk, channels, rows of a signal(channel, chunk, samples): a chunk's channels in order, in one row. So many chunks are a batch, and a chunk costs no call of its own."""
    both = F.array_sort(F.collect_list(F.struct("channel", F.col("samples").cast("array<double>").alias("samples"))))
    one = signal.groupBy("chunk").agg(both.alias("_p"))
    return one.select("chunk", F.transform("_p", lambda x: x["channel"]).alias("channels"), F.transform("_p", lambda x: x["samples"]).alias("rows"))


def _by_shape(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, channels, samples by chunk, channel and frame) of _matrices for each shape that chunks of a batch have."""
    channels, rows = batch.column("channels"), batch.column("rows")
    count = rows.value_lengths().to_numpy()
    lengths = rows.flatten().value_lengths().to_numpy()
    first = np.concatenate([[0], np.cumsum(count)])
    frames = lengths[first[:-1]]
    if (lengths != np.repeat(frames, count)).any():
        raise ValueError("channels of a chunk have different numbers of samples")
    for shape in np.unique(np.stack([count, frames], axis=1), axis=0):
        some = (count == shape[0]) & (frames == shape[1])
        mask = pa.array(some)
        values = rows.filter(mask).flatten().flatten().to_numpy(zero_copy_only=False)
        yield batch.column("chunk").filter(mask).to_numpy(zero_copy_only=False), channels.filter(mask).flatten().to_numpy(zero_copy_only=False).reshape(-1, shape[0]), values.reshape(-1, *shape)


def _by_matrix(signal: DataFrame, channels: int | None, change) -> DataFrame:
    """change(matrices of channels by frames, one after the other) of chunks. channels: the signal is (chunk, samples frame by frame), one row a chunk, and stays so."""
    if channels is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, name, x in _by_shape(batch):
                    y = np.ascontiguousarray(change(x))
                    offsets = pa.array(np.arange(y.shape[0] * y.shape[1] + 1, dtype=np.int32) * y.shape[2])
                    yield pa.RecordBatch.from_arrays([pa.array(name.ravel(), pa.int64()), pa.array(np.repeat(chunk, y.shape[1]), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(y.ravel(), pa.float64()))], ["channel", "chunk", "samples"])

        return _matrices(signal).mapInArrow(run, "channel long, chunk long, samples array<double>")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, samples in zip(pdf.chunk, pdf.samples, strict=True):
                y = change(np.asarray(samples, float).reshape(-1, channels).T)
                yield pd.DataFrame({"chunk": [chunk], "samples": [y.T.ravel()]})

    return signal.select("chunk", "samples").mapInPandas(rows, "chunk long, samples array<double>")


def common_average_removed(signal: DataFrame, channels: int | None = None) -> DataFrame:
    """Samples less the median over channels at the same moment.

    channels: a chunk is one row, frame by frame, and nothing is shuffled; else
    its channels meet in one group.
    """
    return _by_matrix(signal, channels, lambda x: x - np.median(x, axis=-2, keepdims=True))


def covariance(signal: DataFrame, channels: int | None = None) -> DataFrame:
    """c1 <= c2, covariance of the channels' samples: one matrix product a chunk, then sums. All channels are in each chunk; channels as in common_average_removed."""

    def sums(x: np.ndarray, name: np.ndarray) -> pd.DataFrame:
        i, j = np.triu_indices(len(x))
        total = x.sum(axis=1)
        return pd.DataFrame({"c1": name[i], "c2": name[j], "xy": (x @ x.T)[i, j], "sx": total[i], "sy": total[j], "n": x.shape[1]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, names, x in _by_shape(batch):
                kinds, of = np.unique(names, axis=0, return_inverse=True)
                for k, name in enumerate(kinds):  # chunks of the same channels are one recording
                    wide = x[of.ravel() == k].transpose(1, 0, 2).reshape(len(name), -1)
                    yield pa.RecordBatch.from_pandas(sums(wide, name), preserve_index=False)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for samples in pdf.samples:
                yield sums(np.asarray(samples, float).reshape(-1, channels).T, np.arange(channels))

    schema = "c1 long, c2 long, xy double, sx double, sy double, n long"
    parts = _matrices(signal).mapInArrow(run, schema) if channels is None else signal.select("samples").mapInPandas(rows, schema)
    total = parts.groupBy("c1", "c2").agg(*(F.sum(c).alias(c) for c in ("xy", "sx", "sy", "n")))
    return total.select("c1", "c2", (F.col("xy") / F.col("n") - F.col("sx") * F.col("sy") / (F.col("n") * F.col("n"))).alias("covariance"))


def _root(m: np.ndarray, epsilon: float) -> np.ndarray:
    w, v = np.linalg.eigh(m)
    return v @ np.diag(1 / np.sqrt(np.maximum(w, 0) + epsilon)) @ v.T


def _square(covariances: DataFrame) -> np.ndarray:
    rows = covariances.collect()
    names = sorted({r.c1 for r in rows} | {r.c2 for r in rows})
    at = {c: i for i, c in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r.c1], at[r.c2]] = m[at[r.c2], at[r.c1]] = r.covariance
    return m


def whitening_matrix(signal: DataFrame, epsilon: float = 1e-6, near: int | None = None, channels: int | None = None) -> np.ndarray:
    """The symmetric inverse root of the channels' covariance, whose size is that of the probe, not of the recording.

    near: a channel's row comes from the covariance of itself and so many
    channels closest to it in order (the lower of equals first), and is 0 for
    others, which is more robust. channels as in common_average_removed.
    """
    return whitening_of(covariance(signal, channels), epsilon, near)


def whitening_of(covariances: DataFrame, epsilon: float = 1e-6, near: int | None = None) -> np.ndarray:
    """whitening_matrix of a table (c1, c2, covariance), such as that of median_covariance."""
    m = _square(covariances)
    if near is None:
        return _root(m, epsilon)
    out = np.zeros_like(m)
    for i in range(len(m)):
        closest = np.argsort(np.abs(np.arange(len(m)) - i), kind="stable")[: near + 1]
        out[i, closest] = _root(m[np.ix_(closest, closest)], epsilon)[0]
    return out


def median_covariance(signal: DataFrame, every: int = 1) -> DataFrame:
    """c1 <= c2, covariance: the median over every so many-th chunk of the chunk's own, of samples less the mean over channels at their moment. Odd chunks don't sway it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("channel")
        x = np.stack([np.asarray(s, float) for s in pdf.samples])
        x = x - x.mean(axis=0)
        i, j = np.triu_indices(len(x))
        name = pdf.channel.to_numpy()
        return pd.DataFrame({"c1": name[i], "c2": name[j], "v": (x @ x.T / max(x.shape[1], 1))[i, j]})

    each = signal.filter((F.col("chunk") % every == 0) & (F.size("samples") > 0)).groupBy("chunk").applyInPandas(run, "c1 long, c2 long, v double")
    return each.groupBy("c1", "c2").agg(F.percentile("v", F.lit(0.5)).alias("covariance"))


def whitened(signal: DataFrame, method: str = "zca", epsilon: float = 1e-5) -> DataFrame:
    """The signal less its channels' means, under a whitening matrix (linear.whitening) of its covariance; of the methods on axes, channel k is the axis of the k-th largest variance."""
    matrix = whitening(_square(covariance(signal)), method, epsilon)
    sums = signal.groupBy("channel").agg((F.sum(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)) / F.sum(F.size("samples"))).alias("m"))
    centred = signal.join(sums, "channel").select("channel", "chunk", F.transform("samples", lambda x: x - F.col("m")).alias("samples"))
    return mixed(centred, matrix)


def mixed(signal: DataFrame, matrix: np.ndarray, channels: int | None = None) -> DataFrame:
    """Channels, in order of number, under a matrix: whitened, referenced, filtered along the probe or projected. channels as in common_average_removed."""
    return _by_matrix(signal, channels, lambda x: matrix @ x)


def gain_controlled(signal: DataFrame, window: int, epsilon: float = 1e-8) -> DataFrame:
    """channel, chunk, samples, gain: samples times one over their mean absolute value under a Hann window of about so many samples.

    A small share of the channel's mean is added to that value, so silence
    stays finite. Zeros are taken beyond the recording.
    """
    taps = np.hanning(round(window / 2) * 2 + 1)
    both = filtered(signal, taps / taps.sum(), rectified=True, keep=True)
    sums = both.groupBy("channel").agg(F.sum(F.aggregate("level", F.lit(0.0), lambda s, x: s + x)).alias("_s"), F.sum(F.size("level")).alias("_n"))
    # a row for each channel, so that a recording is not shuffled by channel
    gain = both.join(F.broadcast(sums), "channel").select("channel", "chunk", "samples", F.transform("level", lambda x: 1 / (x + F.col("_s") * epsilon / F.col("_n"))).alias("gain"))
    return gain.select("channel", "chunk", F.zip_with("samples", "gain", lambda x, g: x * g).alias("samples"), "gain")


def along_probe_matrix(channels: int, pad: int = 0, taper: int | None = None, low: float = 0.1, order: int = 3) -> np.ndarray:
    """A high pass along the channels as a matrix: pad channels are mirrored at each end, faded over taper channels, and a Butterworth kernel of zero phase is laid over them.

    low: the edge as a share of half a cycle a channel.
    """
    taper = pad if taper is None else taper
    size = channels + 2 * pad
    place = np.concatenate([np.arange(pad)[::-1], np.arange(channels), channels - 1 - np.arange(pad)])
    fade = np.ones(size)
    if taper:
        t = np.arange(size)
        ramp = lambda x: (1 - np.cos(np.clip(x / taper, 0, 1) * np.pi)) / 2
        fade = ramp(t) * (1 - ramp(t - (size - taper)))
    kernel = butterworth_kernel(2.0, low, None, order, 4 * size + 1)
    half = len(kernel) // 2
    out = np.zeros((channels, channels))
    for i in range(channels):
        np.add.at(out[i], place, kernel[half + (i + pad) - np.arange(size)] * fade)
    return out


def filtered_along_probe(signal: DataFrame, matrix: np.ndarray, window: int | None = 300) -> DataFrame:
    """Channels under a matrix of along_probe_matrix, at equal gain if there is a window, which is then taken back."""
    if window is None:
        return mixed(signal, matrix)
    controlled = gain_controlled(signal, window)
    return mixed(controlled.drop("gain"), matrix).join(controlled.select("channel", "chunk", "gain"), ["channel", "chunk"]).select("channel", "chunk", F.zip_with("samples", "gain", lambda x, g: x / g).alias("samples"))


def cross_spectrum(pairs: DataFrame, rate: float, segment: int) -> DataFrame:
    """u1, u2, frequency, magnitude: mean cross spectrum over segments, detrended, under a Hann window. pairs(u1, u2, segment_id, x, y arrays of that length)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = np.hanning(segment)
        scale = rate * (window**2).sum()
        f = np.fft.rfftfreq(segment, 1 / rate)
        for pdf in batches:
            for u1, u2, x, y in zip(pdf.u1, pdf.u2, pdf.x, pdf.y, strict=True):
                a, b = (np.fft.rfft((np.asarray(v, float) - np.mean(v)) * window) for v in (x, y))
                s = np.conj(a) * b / scale
                yield pd.DataFrame({"u1": u1, "u2": u2, "frequency": f, "re": s.real, "im": s.imag})

    spectra = pairs.mapInPandas(run, "u1 long, u2 long, frequency double, re double, im double")
    return spectra.groupBy("u1", "u2", "frequency").agg(F.hypot(F.avg("re"), F.avg("im")).alias("magnitude"))


def shifted(signal: DataFrame, shifts: DataFrame, halo: int = 128) -> DataFrame:
    """Samples moved by a part of a sample, by the spectrum of each chunk with its halo, which fades out. shifts(channel, shift).

    Beyond the ends of a channel its samples are mirrored, however it is cut
    into chunks.
    """
    fade = 0.5 - 0.5 * np.cos(np.pi * (np.arange(halo) + 0.5) / halo)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x, b, a, s in zip(pdf.samples, pdf.before, pdf.after, pdf["shift"], strict=True):
                y = np.concatenate([b, x, a]).astype(float)
                if not len(x):
                    out.append(y[:0])
                    continue
                y = np.pad(y, (halo - len(b), halo - len(a)), mode="reflect" if len(y) > 1 else "edge")
                y[:halo] *= fade
                y[len(y) - halo :] *= fade[::-1]
                n = len(y)
                moved = np.fft.irfft(np.fft.rfft(y) * np.exp(-2j * np.pi * np.fft.rfftfreq(n) * s), n)
                out.append(moved[halo : n - halo])
            yield pd.DataFrame({"channel": pdf.channel, "chunk": pdf.chunk, "samples": out})

    return with_halo(signal, halo).join(shifts, "channel").mapInPandas(run, "channel long, chunk long, samples array<double>")
