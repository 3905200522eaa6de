"""Waves along a probe: places of channels, which waves are healthy and somatic, how a unit spreads, and arrays of one shape for models.

waves(unit, channel, wave array), positions(channel, x, y).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.operators.peaks import spaced_peaks
from tidewave.operators.waveforms import peak_channels, peak_to_peak


def distance(a: str, b: str) -> Column:
    """Between two places with columns a_x, a_y and b_x, b_y."""
    return F.hypot(F.col(f"{a}_x") - F.col(f"{b}_x"), F.col(f"{a}_y") - F.col(f"{b}_y"))


def peak_places(waves: DataFrame, positions: DataFrame) -> DataFrame:
    """unit, channel, ptp, x, y of each unit's peak channel."""
    return peak_channels(waves).join(positions, "channel").select("unit", "channel", "ptp", "x", "y")


def channels_within(places: DataFrame, positions: DataFrame, radius: float) -> DataFrame:
    """unit, channel, near, distance: channels less than a radius from a unit's place(unit, channel, x, y), without its own.

    An equi-join on squares as wide as the radius: a place meets its own and
    the eight around it.
    """
    square = lambda c: F.floor(F.col(c) / F.lit(radius))
    steps = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    mine = places.select("unit", "channel", F.col("x").alias("a_x"), F.col("y").alias("a_y")).withColumn("_i", square("a_x")).withColumn("_j", square("a_y"))
    mine = mine.withColumn("_di", F.explode(steps)).withColumn("_dj", F.explode(steps)).withColumn("_i", F.col("_i") + F.col("_di")).withColumn("_j", F.col("_j") + F.col("_dj"))
    other = positions.select(F.col("channel").alias("near"), F.col("x").alias("b_x"), F.col("y").alias("b_y")).withColumn("_i", square("b_x")).withColumn("_j", square("b_y"))
    return mine.join(other, ["_i", "_j"]).withColumn("distance", distance("a", "b")).filter((F.col("distance") < radius) & (F.col("near") != F.col("channel"))).select("unit", "channel", "near", "distance")


def spread_ratio(waves: DataFrame, positions: DataFrame, radius: float = 26.0) -> DataFrame:
    """unit, spread: the mean peak to peak of the channels within a radius of the peak channel over that channel's; null without any."""
    near = channels_within(peak_places(waves, positions), positions, radius).select("unit", F.col("near").alias("channel"))
    around = waves.join(near, ["unit", "channel"]).groupBy("unit").agg(F.avg(peak_to_peak(F.col("wave"))).alias("m"))
    return peak_channels(waves).join(around, "unit", "left").select("unit", (F.col("m") / F.col("ptp")).alias("spread"))


def loud_channels(waves: DataFrame, reach: int = 21, least: float = 30.0) -> DataFrame:
    """The waves at most reach channels from the unit's peak whose peak to peak is above a height."""
    peaks = peak_channels(waves).select("unit", F.col("channel").alias("_peak"))
    return waves.join(peaks, "unit").filter((F.abs(F.col("channel") - F.col("_peak")) <= reach) & (peak_to_peak(F.col("wave")) > least)).drop("_peak")


def wave_extremes(y: np.ndarray, margin: float = 0.8, edge: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the peaks and troughs of a wave in order of time: beyond a margin of its deviation, spaced by a twentieth, and not in the first and last part of it.

    Where the deepest of these is followed by nothing above 0, the next peak of
    any height after it is added.
    """
    least, apart = margin * float(np.std(y)), max(1, len(y) // 20)
    places = np.sort(np.concatenate([spaced_peaks(y, least, apart), spaced_peaks(-y, least, apart)]))
    places = places[(places >= int(len(y) * edge)) & (places <= int(len(y) * (1 - edge)))]
    if len(places):
        k = int(np.argmin(y[places]))
        if k == len(places) - 1 or y[places[k + 1]] < 0:
            later = spaced_peaks(y[places[k] :], -np.inf, 1)
            if len(later):
                places = np.sort(np.append(places, places[k] + later[0]))
    return places, y[places]


def is_healthy(y: np.ndarray, values: np.ndarray, least: float = 30.0) -> bool:
    """Two to five extremes, and a peak to peak of at least a height."""
    return 2 <= len(values) <= 5 and float(np.ptp(y)) >= least


def is_somatic(y: np.ndarray, values: np.ndarray) -> bool:
    """A trough that is the largest extreme or one of two, and a peak right after some trough or an end near the baseline."""
    turns = any(a < 0 < b for a, b in zip(values, values[1:], strict=False))
    down = (turns and len(values) == 2) or abs(values.max()) < abs(values.min())
    return bool(down and (turns or abs(values[-1]) < np.std(y)))


def wave_kinds(waves: DataFrame) -> DataFrame:
    """unit, channel, ptp, n_extremes, healthy, somatic (false for waves that aren't healthy)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for unit, channel, wave in zip(pdf.unit, pdf.channel, pdf.wave, strict=True):
                y = np.asarray(wave, float)
                values = wave_extremes(y)[1] if len(y) else y
                good = bool(len(y)) and is_healthy(y, values)
                rows.append((unit, channel, float(np.ptp(y)) if len(y) else 0.0, len(values), good, good and is_somatic(y, values)))
            yield pd.DataFrame(rows, columns=["unit", "channel", "ptp", "n_extremes", "healthy", "somatic"])

    return waves.filter("wave IS NOT NULL").select(F.col("unit").cast("long").alias("unit"), F.col("channel").cast("long").alias("channel"), "wave").mapInPandas(run, "unit long, channel long, ptp double, n_extremes int, healthy boolean, somatic boolean")


def spatial_features(waves: DataFrame, positions: DataFrame, reach: int = 21, least: float = 30.0, radius: float = 26.0) -> DataFrame:
    """unit, spread, dendritic, most_extremes: spread_ratio; the largest peak to peak of a loud channel that isn't somatic over that of the peak channel (0 if none is loud, 1 if no channel is somatic); and the most extremes of a healthy loud channel."""
    kinds = wave_kinds(loud_channels(waves, reach, least))
    each = kinds.groupBy("unit").agg(F.bool_or("somatic").alias("some"), F.max(F.when(~F.col("somatic"), F.col("ptp"))).alias("far"), F.max(F.when(F.col("healthy"), F.col("n_extremes"))).alias("most"))
    both = peak_channels(waves).join(each, "unit", "left").join(spread_ratio(waves, positions, radius), "unit")
    dendritic = F.when(~F.coalesce("some", F.lit(False)), 1.0).otherwise(F.coalesce(F.col("far") / F.col("ptp"), F.lit(0.0)))
    return both.select("unit", "spread", dendritic.alias("dendritic"), F.coalesce("most", F.lit(0)).alias("most_extremes"))


def cropped(waves: DataFrame, n: int) -> DataFrame:
    """unit, slot, channel, wave: n slots around the unit's peak channel, which is in the middle one (of an even number the later); wave is null where the probe or the unit has no channel."""
    slots = peak_channels(waves).select("unit", (F.col("channel") - n // 2).alias("_first")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    slots = slots.withColumn("channel", F.col("_first") + F.col("slot"))
    return slots.join(waves.select("unit", "channel", "wave"), ["unit", "channel"], "left").select("unit", "slot", "channel", "wave")


def conformed(y: np.ndarray, rate: float, out_rate: float, before: float, after: float, peak_share: float = 0.75, sign: int = -1, normalise: bool = True) -> np.ndarray:
    """A wave of one shape: its first extreme of at least a share of the largest at the same place and of a given sign, without offset, cut or filled to a span in seconds around it, at another rate, over its largest value.

    Beyond its ends a wave goes on as its first and last sample. A wave without
    any deviation gives zeros.
    """
    y = y - np.median(y)
    n = int(round((before + after) * out_rate))
    top = np.abs(y).max() if len(y) else 0.0
    if not top:
        return np.zeros(n)
    places = np.sort(np.concatenate([spaced_peaks(y, peak_share * top, 1), spaced_peaks(-y, peak_share * top, 1)]))
    at = int(places[0]) if len(places) else int(np.argmax(np.abs(y)))
    y = y * (sign * np.sign(y[at]))
    t = at + (np.arange(n) / out_rate - before) * rate
    out = np.interp(t, np.arange(len(y)), y)
    return out / top if normalise else out


def padded_with_decay(rows: list[np.ndarray | None], decay: float = 0.5) -> np.ndarray:
    """Rows of equal length, those that lack taken from the nearest that is there (the lower of equals) times decay for each step."""
    there = np.array([k for k, r in enumerate(rows) if r is not None])
    out = []
    for k, r in enumerate(rows):
        if r is None:
            near = int(there[np.argmin(np.abs(there - k))])
            r = rows[near] * decay ** abs(near - k)
        out.append(r)
    return np.stack(out)


def model_arrays(waves: DataFrame, rate: float, channels: int = 10, out_rate: float | None = None, before: float = 1e-3, after: float = 2e-3, decay: float = 0.5) -> DataFrame:
    """unit, peak, array: the waves of so many channels around the peak as one array, slot by slot, each unit's of one shape.

    The peak channel's wave sets place, sign and scale for all; channels that
    lack are filled with a decay. A unit's group is as large as that array.
    """
    out = out_rate or rate
    size = int(round((before + after) * out))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        raw = [None if w is None else np.asarray(w, float) for w in pdf.wave]
        middle = raw[channels // 2]
        y = middle - np.median(middle)
        top = np.abs(y).max()
        places = np.sort(np.concatenate([spaced_peaks(y, 0.75 * top, 1), spaced_peaks(-y, 0.75 * top, 1)])) if top else np.zeros(0, int)
        at = int(places[0]) if len(places) else int(np.argmax(np.abs(y)))
        scale = -np.sign(y[at]) / top if top else 0.0
        t = at + (np.arange(size) / out - before) * rate
        rows = [None if w is None else np.interp(t, np.arange(len(w)), w - np.median(w)) * scale for w in raw]
        return pd.DataFrame({"unit": [pdf.unit.iloc[0]], "peak": [int(pdf.channel.iloc[channels // 2])], "array": [padded_with_decay(rows, decay).ravel()]})

    return cropped(waves, channels).groupBy("unit").applyInPandas(run, "unit long, peak long, array array<double>")


def model_table(arrays: DataFrame, curves: DataFrame, labels: DataFrame, drop_labels: list[str] | None = None) -> DataFrame:
    """unit, label, code, array, acg: what a model is trained on; units without a label, or with one to drop, are left out.

    arrays(unit, array), curves(unit, acg), labels(unit, label). code numbers
    the labels that are left in order, from 0.
    """
    kept = labels.filter(F.col("label").isNotNull())
    if drop_labels:
        kept = kept.filter(~F.col("label").isin(drop_labels))
    names = kept.agg(F.array_sort(F.collect_set("label")).alias("_names"))
    code = (F.array_position("_names", F.col("label")) - 1).cast("int")
    return arrays.join(curves, "unit").join(kept, "unit").join(F.broadcast(names)).select("unit", "label", code.alias("code"), "array", "acg")
