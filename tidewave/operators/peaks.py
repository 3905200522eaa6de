"""Peaks of sampled waves to a part of a sample: by zero crossings, and refined by parabola, sine, spline or spectrum."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators.waveforms import alternating_extremes

Place = tuple[float, float]


def sampled_extremes(y: np.ndarray, delta: float = 0.0, lookahead: int = 1) -> tuple[list[int], list[int]]:
    """Places of peaks and of troughs that the wave leaves by delta and does not pass within lookahead samples."""
    peaks, troughs = alternating_extremes(y, delta or 1e-12 * (np.ptp(y) or 1.0))
    inside = lambda i: 0 < i < len(y) - 1
    return [i for i in peaks if inside(i) and y[i] >= y[i : i + lookahead + 1].max()], [i for i in troughs if inside(i) and y[i] <= y[i : i + lookahead + 1].min()]


def crossing_extremes(y: np.ndarray, window: int = 11) -> tuple[list[int], list[int]]:
    """The largest sample between a rise through the mean and the next fall, and the least between a fall and a rise; crossings are those of the wave under a Hann window."""
    y = y - y.mean()
    taps = np.hanning(window + 2)[1:-1]
    smooth = np.convolve(np.pad(y, window // 2, mode="reflect"), taps / taps.sum(), "valid") if len(y) > window else y
    cuts = np.flatnonzero(np.diff(np.signbit(smooth))) + 1
    peaks, troughs = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if smooth[a:b].mean() > 0:
            peaks.append(int(a + np.argmax(y[a:b])))
        else:
            troughs.append(int(a + np.argmin(y[a:b])))
    return peaks, troughs


def around(y: np.ndarray, at: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    half = points // 2
    t = np.arange(max(0, at - half), min(len(y), at + half + 1))
    return t - at, y[t]


def by_parabola(y: np.ndarray, at: int, points: int = 3) -> Place:
    """The vertex of a parabola through the samples around a place by least squares."""
    t, v = around(y, at, points)
    if len(t) < 3:
        return float(at), float(y[at])
    a, b, c = np.polyfit(t, v, 2)
    if a == 0 or abs(b / (2 * a)) > points:
        return float(at), float(y[at])
    return float(at - b / (2 * a)), float(c - b * b / (4 * a))


def by_spline(y: np.ndarray, at: int, points: int = 15) -> Place:
    """The turning point of a cubic spline through the samples around a place that lies nearest to it."""
    t, v = around(y, at, points)
    n = len(t)
    if n < 4:
        return by_parabola(y, at)
    # second derivatives; third ones don't jump at the last knots but one
    m = np.zeros((n, n))
    r = np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = 1, 4, 1
        r[i] = 6 * (v[i - 1] - 2 * v[i] + v[i + 1])
    m[0, :3] = m[-1, -3:] = 1, -2, 1
    k = np.linalg.solve(m, r)
    best: Place = (float(at), float(y[at]))
    least = np.inf
    for i in range(n - 1):
        d, c, b = (k[i + 1] - k[i]) / 6, k[i] / 2, v[i + 1] - v[i] - (2 * k[i] + k[i + 1]) / 6
        for x in np.roots([3 * d, 2 * c, b]):
            if abs(x.imag) < 1e-12 and -1e-9 <= x.real <= 1 + 1e-9 and abs(t[i] + x.real) < least:
                x = x.real
                least, best = abs(t[i] + x), (float(at + t[i] + x), float(v[i] + x * (b + x * (c + x * d))))
    return best


def by_spectrum(y: np.ndarray, at: int, times: int = 20) -> Place:
    """The extreme of the wave up-sampled by zeros in its spectrum, within a sample of a place. The wave counts as periodic."""
    n = len(y)
    spectrum = np.fft.rfft(y)
    if n % 2 == 0:
        spectrum[-1] /= 2
    fine = np.fft.irfft(spectrum, n * times) * times
    low = (at - 1) * times
    stretch = fine[np.arange(low, low + 2 * times + 1) % (n * times)]
    best = low + int(np.argmax(stretch) if y[at] > (y[at - 1] + y[(at + 1) % n]) / 2 else np.argmin(stretch))
    place, value = by_parabola(fine[np.arange(best - 1, best + 2) % (n * times)], 1)
    return (best - 1 + place) / times, value


def by_sine(y: np.ndarray, at: int, points: int = 31, cycle: float | None = None, locked: bool = False) -> Place:
    """The extreme of a sine through the samples around a place by least squares. cycle: samples of a cycle, at which it stays if locked."""
    t, v = around(y, at, points)
    if len(t) < 5 or not cycle:
        return by_parabola(y, at)
    w = 2 * np.pi / cycle
    for _ in range(1 if locked else 30):
        basis = np.stack([np.cos(w * t), np.sin(w * t), np.ones(len(t))], axis=1)
        (a, b, c), *_ = np.linalg.lstsq(basis, v, rcond=None)
        if locked:
            break
        slope = t * (b * np.cos(w * t) - a * np.sin(w * t))
        more, *_ = np.linalg.lstsq(np.column_stack([basis, slope]), v, rcond=None)
        step = float(np.clip(more[3], -0.2 * w, 0.2 * w))
        w += step
        if abs(step) < 1e-12 * w:
            break
    basis = np.stack([np.cos(w * t), np.sin(w * t), np.ones(len(t))], axis=1)
    (a, b, c), *_ = np.linalg.lstsq(basis, v, rcond=None)
    size = np.hypot(a, b)
    up = y[at] > v.mean()
    phase = np.arctan2(b, a) + (0 if up else np.pi)
    turn = 2 * np.pi / w
    place = phase / w
    place -= turn * np.round(place / turn)
    return float(at + place), float(c + (size if up else -size))


def cycle_of(peaks: list[int], troughs: list[int]) -> float | None:
    """Samples of a cycle: the mean step between peaks and between troughs."""
    steps = np.concatenate([np.diff(peaks), np.diff(troughs)])
    return float(steps.mean()) if len(steps) else None


METHODS = ("samples", "parabola", "spline", "spectrum", "sine", "locked sine", "crossings")


def find_peaks(waves: DataFrame, method: str = "parabola", delta: float = 0.0, lookahead: int = 1, points: int | None = None) -> DataFrame:
    """unit, kind (1 peak, -1 trough), place, value of the extremes of waves(unit, wave); a wave of fewer than 3 samples, or null, has none.

    method: one of METHODS; crossings looks between crossings of the mean and
    refines by parabola, samples does not refine.
    """
    if method not in METHODS:
        raise ValueError(f"no method {method}")

    def of(y: np.ndarray) -> list[tuple[int, float, float]]:
        if len(y) < 3:
            return []
        peaks, troughs = crossing_extremes(y) if method == "crossings" else sampled_extremes(y, delta, lookahead)
        cycle = cycle_of(peaks, troughs)
        size = {"points": points} if points else {}
        refine: dict[str, Callable[[int], Place]] = {
            "samples": lambda i: (float(i), float(y[i])),
            "parabola": lambda i: by_parabola(y, i, **size),
            "crossings": lambda i: by_parabola(y, i, **size),
            "spline": lambda i: by_spline(y, i, **size),
            "spectrum": lambda i: by_spectrum(y, i),
            "sine": lambda i: by_sine(y, i, **size, cycle=cycle),
            "locked sine": lambda i: by_sine(y, i, **size, cycle=cycle, locked=True),
        }
        return [(kind, *refine[method](i)) for kind, some in ((1, peaks), (-1, troughs)) for i in some]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(u, *x) for u, w in zip(pdf.unit, pdf.wave, strict=True) if w is not None for x in of(np.asarray(w, float))]
            yield pd.DataFrame(rows, columns=["unit", "kind", "place", "value"])

    return waves.select(F.col("unit").cast("long").alias("unit"), "wave").mapInPandas(run, "unit long, kind int, place double, value double")


def smoothed_by_data(y: np.ndarray, share: float = 0.1) -> np.ndarray:
    """The array under a gaussian whose deviation, in samples, is a share of that of its values; ends mirrored."""
    sd = share * float(np.std(y))
    reach = int(4 * sd + 0.5)
    if not reach or not len(y):
        return y
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sd) ** 2)
    return np.convolve(np.pad(y, reach, mode="symmetric"), k / k.sum(), "valid")


def spaced_peaks(y: np.ndarray, least: float, distance: int) -> np.ndarray:
    """Places of peaks (a plateau: its middle) of at least a height, of which the higher ones keep others at less than a distance away; of equal ones the later."""
    if not len(y):
        return np.zeros(0, int)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(y)) + 1, [len(y)]])
    level = y[cut[:-1]]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    places = (cut[top] + cut[top + 1] - 1) // 2
    places = places[y[places] >= least]
    free = np.ones(len(places), bool)
    kept = []
    for i in np.argsort(y[places], kind="stable")[::-1]:
        if free[i]:
            kept.append(places[i])
            free[np.abs(places - places[i]) < distance] = False
    return np.array(sorted(kept), dtype=int)


def bursts_and_oscillations(curves: DataFrame, burst_bins: int) -> DataFrame:
    """unit, burst, oscillation of curves(unit, acg array from the middle bin on, mfr): over the mean rate, the highest value of the smoothed curve in its first bins, and at its highest peak after them.

    Without such a peak oscillation is 1.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for unit, acg, mfr in zip(pdf.unit, pdf.acg, pdf.mfr, strict=True):
                y = smoothed_by_data(np.asarray(acg, float))
                peaks = spaced_peaks(y, 0.5 * float(np.std(y)), max(1, len(y) // 20))
                later = peaks[peaks > burst_bins]
                rows.append((unit, float(y[:burst_bins].max() / mfr), float(y[later].max() / mfr) if len(later) else 1.0))
            yield pd.DataFrame(rows, columns=["unit", "burst", "oscillation"])

    return curves.filter("size(acg) > 0 AND mfr > 0").mapInPandas(run, "unit long, burst double, oscillation double")
