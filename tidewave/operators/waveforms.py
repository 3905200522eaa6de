"""Waveforms as arrays: shape by higher-order functions, fits and filters by Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 18  # places of histograms that are fitted at once


def peak_to_peak(wave: Column) -> Column:
    return F.array_max(wave) - F.array_min(wave)


def trough(wave: Column) -> Column:
    """Place of the first least sample, from 0."""
    return F.array_position(wave, F.array_min(wave)) - 1


def peak(wave: Column) -> Column:
    return F.array_position(wave, F.array_max(wave)) - 1


def normalise(wave: Column) -> Column:
    """Less its mean, over the largest absolute value."""
    mean = F.aggregate(wave, F.lit(0.0), lambda s, x: s + x) / F.size(wave)
    centred = F.transform(wave, lambda x: x - mean)
    return F.transform(centred, lambda x: x / F.array_max(F.transform(centred, lambda y: F.abs(y))))


def zero_crossings(wave: Column) -> Column:
    """How often neighbouring samples differ in sign."""
    return F.size(F.filter(F.sequence(F.lit(1), F.size(wave) - 1), lambda i: (F.get(wave, i) >= 0) != (F.get(wave, i - 1) >= 0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def peak_channels(waves: DataFrame) -> DataFrame:
    """unit, channel, ptp of the channel with the largest peak to peak. waves(unit, channel, wave)."""
    return waves.groupBy("unit").agg(F.max(F.struct(peak_to_peak(F.col("wave")).alias("ptp"), (-F.col("channel")).alias("c"))).alias("x")).select("unit", (-F.col("x.c")).alias("channel"), "x.ptp")


def gaussian_kernel(sd: float) -> np.ndarray:
    half = int(np.ceil(4 * sd))
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / sd) ** 2)
    return k / k.sum()


def smooth_arrays(df: DataFrame, column: str, sd: float) -> DataFrame:
    """The column's arrays under a gaussian, their ends mirrored; lengths stay."""
    kernel = gaussian_kernel(sd)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            half = len(kernel) // 2
            yield pdf.assign(**{column: [np.convolve(np.pad(np.asarray(x, float), half, mode="symmetric"), kernel, "valid") if len(x) else [] for x in pdf[column]]})

    schema = df.withColumn(column, F.col(column).cast("array<double>")).schema
    return df.mapInPandas(run, schema)


def alternating_extremes(y: np.ndarray, delta: float) -> tuple[list[int], list[int]]:
    """Peaks and troughs that the signal leaves by at least delta before the next."""
    peaks, troughs, seeking = [], [], None
    hi = lo = 0
    for i in range(len(y)):
        hi = i if y[i] > y[hi] else hi
        lo = i if y[i] < y[lo] else lo
        if seeking != "low" and y[i] <= y[hi] - delta:
            peaks.append(hi)
            seeking, lo = "low", i
        elif seeking != "high" and y[i] >= y[lo] + delta:
            troughs.append(lo)
            seeking, hi = "high", i
    return peaks, troughs


def half_width(y: np.ndarray, at: int) -> int:
    """Samples around a place on its side of half its value."""
    same = np.abs(y) >= abs(y[at]) / 2
    same &= np.sign(y) == np.sign(y[at])
    a = b = at
    while a > 0 and same[a - 1]:
        a -= 1
    while b + 1 < len(y) and same[b + 1]:
        b += 1
    return b - a + 1


def passes(y: np.ndarray, level: float) -> np.ndarray:
    """Places after which the wave is on the other side of a level."""
    return np.flatnonzero(np.diff(np.sign(y - level)))


def onset(y: np.ndarray, trough: int, share: float = 0.05) -> int:
    """The last place before the trough where the wave passes a share of its value; 0 without one."""
    before = passes(y[:trough], share * y[trough])
    return int(before[-1]) if len(before) else 0


def first_pass(y: np.ndarray, level: float) -> int | None:
    """Of the two samples between which a wave first passes a level the one of the smaller absolute value (of equal ones the first)."""
    at = passes(y, level)
    if not len(at):
        return None
    return int(at[0]) + int(abs(y[at[0] + 1]) < abs(y[at[0]]))


def rise_time(y: np.ndarray) -> int:
    """Samples between the passes of the 10th and the 90th percentile of a rise up to before its peak, y's last sample; 0 without them."""
    y = y[:-1]
    if len(y) < 3:
        return 0
    low, high = first_pass(y, np.percentile(y, 10)), first_pass(y, np.percentile(y, 90))
    return high - low if low is not None and high is not None else 0


def fall_time(y: np.ndarray, trough: int) -> int:
    """Samples from where the wave passes a tenth of the trough's value to where it passes nine tenths, after its onset; 0 without them."""
    fall = y[onset(y, trough) : trough + 1]
    first, last = first_pass(fall, 0.1 * y[trough]), first_pass(fall, 0.9 * y[trough])
    return last - first if first is not None and last is not None else 0


def half_fall_slope(y: np.ndarray, trough: int) -> float:
    """The slope of a line through the wave, over its largest value, from half the trough's value to the trough; 0 without such a stretch."""
    scaled = y / (np.abs(y).max() or 1.0)
    start = onset(scaled, trough)
    half = passes(scaled[start : trough + 1], 0.5 * scaled[trough])
    fall = scaled[start + half[0] : trough + 1] if len(half) else scaled[:0]
    return float(np.polyfit(np.arange(len(fall)), fall, 1)[0]) if len(fall) > 1 else 0.0


FEATURES = "unit long, channel long, n_peaks int, n_troughs int, trough int, trough_value double, peak int, peak_value double, width int, ratio double, rise_10_90 int, fall_10_90 int, onset int, onset_value double, trough_half_width int, peak_half_width int, repolarisation double, depolarisation double, recovery_tau double, recovery_height double"


def waveform_features(waves: DataFrame, delta_share: float = 0.15) -> DataFrame:
    """Shape of each wave(unit, channel, wave) less its median: extremes, trough to peak, 10-90 times, onset, half widths, slopes, and the exponential of the recovery."""

    def describe(y: np.ndarray) -> tuple:
        y = y - np.median(y)
        peaks, troughs = alternating_extremes(y, delta_share * (np.ptp(y) or 1.0))
        t = int(np.argmin(y))
        after = y[t:]
        p = t + int(np.argmax(after))
        rise = after[: p - t + 1]
        slope = float(np.polyfit(np.arange(len(rise)), rise, 1)[0]) if len(rise) > 1 else 0.0
        tail = y[p:]
        good = tail > 0
        tail = tail[: int(np.argmin(good)) if not good.all() else len(tail)]
        tau = height = float("nan")
        if len(tail) > 2:
            fall, start = np.polyfit(np.arange(len(tail)), np.log(tail), 1)
            if fall < 0:
                tau, height = float(-1 / fall), float(np.exp(start))
        ratio = float(abs(y[p] / y[t])) if y[t] else float("nan")
        return len(peaks), len(troughs), t, float(y[t]), p, float(y[p]), p - t, ratio, rise_time(rise), fall_time(y, t), onset(y, t), float(0.05 * y[t]), half_width(y, t), half_width(y, p), slope, half_fall_slope(y, t), tau, height

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([(u, c, *describe(np.asarray(w, float))) for u, c, w in zip(pdf.unit, pdf.channel, pdf.wave, strict=True)], columns=names)

    return waves.select(F.col("unit").cast("long").alias("unit"), F.col("channel").cast("long").alias("channel"), "wave").mapInPandas(run, FEATURES)


def truncated_gaussian(x: np.ndarray, n: np.ndarray, height: float, mean: float, sd: float, cut: float, steps: int = 200) -> tuple[float, float, float]:
    """height, mean and sd of a gaussian, 0 below cut, through counts n at x by least squares (Levenberg-Marquardt)."""
    x, n = x[x >= cut], n[x >= cut]
    p, damp = np.array([height, mean, sd], float), 1e-3

    def model(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x - p[1]) / p[2]
        g = np.exp(-0.5 * z * z)
        return p[0] * g, np.stack([g, p[0] * g * z / p[2], p[0] * g * z * z / p[2]], axis=1)

    y, j = model(p)
    error = ((n - y) ** 2).sum()
    for _ in range(steps):
        a, b = j.T @ j, j.T @ (n - y)
        try:
            step = np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), b)
        except np.linalg.LinAlgError:
            break
        q = p + step
        y2, j2 = model(q) if q[2] != 0 else (y, j)
        error2 = ((n - y2) ** 2).sum() if q[2] != 0 else np.inf
        if error2 <= error:
            done = error - error2 <= 1e-12 * max(error, 1e-12)
            p, y, j, error, damp = q, y2, j2, error2, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return float(p[0]), float(p[1]), abs(float(p[2]))


def truncated_gaussians(x: np.ndarray, n: np.ndarray, used: np.ndarray, height: np.ndarray, mean: np.ndarray, sd: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """mean and sd of truncated_gaussian for each row of x and n, at the places that are used; rows take their own steps."""
    p, damp = np.stack([height, mean, sd], axis=1).astype(float), np.full(len(x), 1e-3)
    out = p.copy()
    row = np.arange(len(x))
    n = np.where(used, n, 0.0)

    def model(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            z = (x - p[:, 1:2]) / p[:, 2:3]
            g = np.exp(-0.5 * z * z) * used
            g[p[:, 2] == 0] = np.nan
            return p[:, :1] * g, np.stack([g, p[:, :1] * g * z / p[:, 2:3], p[:, :1] * g * z * z / p[:, 2:3]], axis=2)

    y, j = model(p)
    error = ((n - y) ** 2).sum(axis=1)
    for _ in range(steps):
        if not len(row):
            break
        a, b = np.einsum("gki,gkj->gij", j, j), np.einsum("gki,gk->gi", j, n - y)
        a[:, range(3), range(3)] += damp[:, None] * np.maximum(a[:, range(3), range(3)], 1e-12)
        step, fault = _solved(a, b)
        q = p + step
        y2, j2 = model(q)
        with np.errstate(all="ignore"):
            error2 = np.where(q[:, 2] != 0, ((n - y2) ** 2).sum(axis=1), np.inf)
            better = ~fault & (error2 <= error)
            done = fault | (better & (error - error2 <= 1e-12 * np.maximum(error, 1e-12)))
        p, y, j = np.where(better[:, None], q, p), np.where(better[:, None], y2, y), np.where(better[:, None, None], j2, j)
        error, damp = np.where(better, error2, error), np.where(better, damp / 3, damp * 4)
        done |= ~better & (damp > 1e12)
        out[row[done]] = p[done]
        go = ~done
        row, x, n, used, p, damp, y, j, error = (v[go] for v in (row, x, n, used, p, damp, y, j, error))
    out[row] = p
    return out[:, 1], np.abs(out[:, 2])


def _solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The solutions of systems, and which have none."""
    try:
        return np.linalg.solve(a, b[:, :, None])[:, :, 0], np.zeros(len(a), bool)
    except np.linalg.LinAlgError:
        out, fault = np.zeros_like(b), np.zeros(len(a), bool)
        for k in range(len(a)):
            try:
                out[k] = np.linalg.solve(a[k], b[k])
            except np.linalg.LinAlgError:
                fault[k] = True
        return out, fault


def missing_spikes(df: DataFrame, by: list[str] | None = None, least: int = 16, least_bins: int = 4, most_bins: int | None = 10_000_000) -> DataFrame:
    """by, n, bins, missing: the share of a group's amplitudes under its threshold, by a truncated gaussian fitted to their histogram.

    df(*by, a); by: unit if not given. Bins follow Freedman and Diaconis; the
    threshold is the first percentile. Groups of fewer amplitudes or bins, or
    without spread, are left out. Histograms are aggregated by Spark: the bins of
    a group that have any, which are no more than its amplitudes, are an array,
    and groups of like sizes are fitted together. A far outlier can make the rule ask for any number of bins; more than
    most_bins of them (80 MB) are widened to so many, which bins tells. None:
    the rule alone.
    """
    by = by or ["unit"]
    q = lambda p: F.percentile("a", F.lit(p))
    stats = df.groupBy(*by).agg(F.count("*").alias("size"), F.min("a").alias("lo"), F.max("a").alias("hi"), (q(0.75) - q(0.25)).alias("iqr"), F.stddev_pop("a").alias("sd"), q(0.01).alias("cut"))
    ruled = F.floor((F.col("hi") - F.col("lo")) / (2 * F.col("iqr") / F.cbrt("size")) + 1)
    stats = stats.filter((F.col("iqr") > 0) & (F.col("size") >= least)).withColumn("bins", F.least(ruled, F.lit(most_bins)) if most_bins else ruled).filter(F.col("bins") >= least_bins)
    k = F.least(F.floor((F.col("a") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1)
    kept = ["size", "lo", "hi", "sd", "cut", "bins"]
    counts = df.join(stats, by).groupBy(*by, *kept, k.cast("long").alias("k")).agg(F.count("*").alias("n"))
    shape = counts.groupBy(*by, *kept).agg(F.collect_list("k").alias("k"), F.collect_list("n").alias("n"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # histograms of like numbers of bins together, so many places at a time
            order = np.argsort(pdf.bins.to_numpy(), kind="stable")
            bins = pdf.bins.to_numpy(int)[order]
            first = 0
            while first < len(order):
                last = first + 1
                while last < len(order) and (last + 1 - first) * bins[last] <= CELLS and bins[last] <= 2 * bins[first]:
                    last += 1
                yield fitted(pdf.iloc[order[first:last]])
                first = last

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi, sd, cut, bins = (pdf[c].to_numpy(float) for c in ("lo", "hi", "sd", "cut", "bins"))
        width = (hi - lo) / bins
        place = np.arange(int(bins.max()))
        n = np.zeros((len(pdf), len(place)))
        for row, where, count in zip(n, pdf.k, pdf.n, strict=True):
            row[where] = count
        inside = place < bins[:, None]
        top = n.max(axis=1)
        highest = (n == top[:, None]) & inside
        mode = lo + width * ((highest * place).sum(axis=1) / highest.sum(axis=1))
        x = lo[:, None] + width[:, None] * (place + 0.5)
        mean, sd = truncated_gaussians(x, n, inside & (x >= cut[:, None]), top, mode, sd)
        share = [round(0.5 * (1 + math.erf((c - m) / (s * math.sqrt(2)))), 4) if s > 0 else float("nan") for c, m, s in zip(cut, mean, sd, strict=True)]
        return pd.DataFrame({**{c: pdf[c].to_numpy() for c in by}, "n": pdf["size"].to_numpy(int), "bins": bins.astype(int), "missing": share})

    types = dict(df.dtypes)
    return shape.mapInPandas(fit, ", ".join(f"{c} {types[c]}" for c in by) + ", n long, bins long, missing double")
