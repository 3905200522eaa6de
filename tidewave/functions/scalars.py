"""Small column functions: signs, bins, angles, ellipses, kernels, arrays, labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign(x: Column) -> Column:
    """-1 below zero, else 1."""
    return F.when(x < 0, -1).otherwise(1)


def half_off(x: Column) -> Column:
    """0 for 1, 1 for -1."""
    return (1 - x) / 2


def bin_centres(window: float, width: float) -> list[float]:
    """Centres of the bins of a symmetric window, 0 among them."""
    half = int(window / width / 2)
    return [k * width for k in range(-half, half + 1)]


def log_edges(last: float, n: int) -> list[float]:
    """n + 1 edges from 1 to last, evenly spaced in logarithms."""
    return [10 ** (i * math.log10(last) / n) for i in range(n + 1)]


def bin_of(x: Column, edges: list[float]) -> Column:
    """Place of the bin [edge, next) of ascending edges, from 0; null outside."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        out = F.when((x >= edges[k]) & (x < edges[k + 1]), k).otherwise(out)
    return out


def open_bin(x: Column, low: float, width: float) -> Column:
    """Bins that are open at their lower and closed at their upper edge."""
    return F.ceil((x - low) / width) - 1


def polar(x: Column, y: Column) -> tuple[Column, Column]:
    return F.hypot(x, y), F.atan2(y, x)


def cartesian(r: Column, angle: Column) -> tuple[Column, Column]:
    return r * F.cos(angle), r * F.sin(angle)


def in_ellipse(x: Column, y: Column, a: float, b: float, x0: float = 0.0, y0: float = 0.0, turn: float = 0.0) -> Column:
    """Whether a point is in an ellipse of half axes a, b, turned by so many radians."""
    u = (x - x0) * math.cos(turn) + (y - y0) * math.sin(turn)
    v = (y - y0) * math.cos(turn) - (x - x0) * math.sin(turn)
    return (u * u) / (a * a) + (v * v) / (b * b) <= 1


def ellipse_chord(x: Column, a: float, b: float) -> Column:
    """Length of the chord at x, across the half axis a."""
    return 2 * b * F.sqrt(F.greatest(F.lit(0.0), 1 - (x * x) / (a * a)))


def pieces(array: Column, size: int, overlap: int = 0) -> Column:
    """An array's stretches of a size, each starting size - overlap after the one before; the last, shorter ones are left out."""
    n = F.size(array)
    starts = F.when(n < size, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(size - overlap)))
    return F.transform(starts, lambda s: F.slice(array, s + 1, size))


def padded(array: Column, size: int) -> Column:
    """An array of a size: cut, or filled with nulls."""
    return F.slice(F.concat(array, F.array_repeat(F.lit(None).cast("double"), size)), 1, size)


def bits(x: Column, n: int) -> Column:
    """The lowest n bits, at most 64, of a whole number, the lowest first; of a number below 0 those of its two's complement."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.call_function("getbit", x.cast("long"), k).cast("long"))


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def array_std(a: Column) -> Column:
    """Population deviation."""
    m = array_mean(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))


def interpolated(a: Column, times: int) -> Column:
    """An array with times - 1 points on straight lines between neighbours."""
    last = F.size(a) - 1
    at = lambda i: F.get(a, i.cast("int"))
    between = lambda k: at(F.floor(k / times)) + (F.coalesce(at(F.floor(k / times) + 1), at(F.floor(k / times))) - at(F.floor(k / times))) * ((k % times) / times)
    return F.transform(F.sequence(F.lit(0), last * times), between)


def log_resampled(a: Column, width: float, first: float, n: int) -> Column:
    """An array of bins of a width as n values at times evenly spaced in logarithm from first to the last bin, on straight lines between bins."""
    last = (F.size(a) - 1) * F.lit(width)
    at = lambda i: F.get(a, i.cast("int"))

    def value(k: Column) -> Column:
        place = F.lit(first) * F.pow(last / F.lit(first), k / (n - 1)) / F.lit(width)
        low = F.floor(place)
        return at(low) + (F.coalesce(at(low + 1), at(low)) - at(low)) * (place - low)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value)


def is_number(x: Column) -> Column:
    return x.try_cast("double").isNotNull()


def clean_label(x: Column) -> Column:
    """Labels trimmed; empty or unlabeled ones are null."""
    t = F.trim(x.cast("string"))
    return F.when(~F.lower(t).isin("", "0", "unlabeled", "unlabelled"), t)


def settings(text: Column) -> Column:
    """A map of the k = v lines of a text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\w+\s*="))
    key = lambda x: F.trim(F.regexp_extract(x, r"^\s*(\w+)\s*=", 1))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"=(.*)$", 1)), r"^['\"]|['\"]$", "")
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(key(x), value(x))))


def adc_shift(channel: Column, group: int = 12, cycle: int = 13) -> Column:
    """The part of a sample by which a channel is read later: its place among those that share a converter."""
    return F.floor(channel / 2) % group / cycle
