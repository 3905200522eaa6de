"""From correlograms to a graph of units: modulations of all pairs with their features, edges, the main edge of each pair, degrees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.timeline import islands
from tidewave.operators.correlograms import Pairs, are, measured_pairs, zscore_runs


def modulation_features(bins: DataFrame, value: str, width_ms: float, least: int, half: int, edges: bool = False) -> DataFrame:
    """u1, u2, left, right, amplitude, at (ms), triplets, crossing, height, entropy of each run of at least least bins on one side.

    bins(u1, u2, bin, value, side: 1, -1 or 0 for none). right is the edge of
    the first bin after the run; amplitude has the sign of the run, at is the
    first bin that has it; entropy is that of heights under the normal law.
    edges: also runs that touch an end of the correlogram.
    """
    return features_of(islands(bins, "side", ["u1", "u2"], ["bin"]).filter("side <> 0"), value, width_ms, least, half, edges)


def features_of(run: DataFrame, value: str, width_ms: float, least: int, half: int, edges: bool = False) -> DataFrame:
    """modulation_features of bins that are on a side, with the number of their run. run(u1, u2, bin, value, side, run)."""
    x = F.col(value)
    best = F.max(F.struct(F.abs(x).alias("h"), (-F.col("bin")).alias("b")))
    entropy = F.avg(0.5 * x * x + 0.5 * F.log(F.lit(2 * math.pi)))
    out = run.groupBy("u1", "u2", "run", "side").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.count("*").alias("crossing"), best.alias("best"), F.avg(x).alias("height"), entropy.alias("entropy")).filter(F.col("crossing") >= least)
    if not edges:
        out = out.filter((F.col("first") > -half) & (F.col("last") < half))
    ms = lambda c: c * F.lit(width_ms)
    return out.select("u1", "u2", ms(F.col("first")).alias("left"), ms(F.col("last") + 1).alias("right"), (F.col("best.h") * F.col("side")).alias("amplitude"), ms(-F.col("best.b")).alias("at"), F.floor(F.col("crossing") / 3).alias("triplets"), "crossing", "height", "entropy")


def normal_modulations(df: DataFrame, width: int, half: int, threshold: float, width_ms: float, least: int) -> DataFrame:
    """modulation_features of normal_sides of all pairs' z-scores, without runs that touch an end; by blocks of units. df(unit, id, t)."""

    def measure(p: Pairs) -> pa.RecordBatch:
        r = zscore_runs(p, half, threshold, least, ends=False)
        n = r.last - r.first + 1
        entropy = 0.5 * r.power + 0.5 * math.log(2 * math.pi)
        return p.batch(r.pair, left=r.first * width_ms, right=(r.last + 1) * width_ms, amplitude=np.abs(r.best) * r.side, at=r.at * width_ms, triplets=n // 3, crossing=n, height=r.height, entropy=entropy)

    return measured_pairs(df.filter("unit IS NOT NULL"), width, half, measure, "left double, right double, amplitude double, at double, triplets long, crossing long, height double, entropy double")


def normal_edges(df: DataFrame, width: int, half: int, threshold: float, width_ms: float, least: int, sign: int | None = None, low: float | None = None, high: float | None = None, main: bool = False) -> DataFrame:
    """edges of normal_modulations, by blocks of units; main: main_edges of these. df(unit, id, t)."""

    def measure(p: Pairs) -> pa.RecordBatch:
        r = zscore_runs(p, half, threshold, least, ends=False)
        lag = np.abs(r.at * width_ms)
        keep = are(pc.greater(p.u1, p.u2))[r.pair]
        if sign is not None:
            keep &= np.sign(r.best) == sign
        if low is not None:
            keep &= lag >= low
        if high is not None:
            keep &= lag <= high
        r, lag = r.part(keep), lag[keep]
        forward = r.at > 0
        if main:
            # the source of a lag that runs back, or of none, is the lower unit
            order = np.lexsort((r.best, forward, lag, -np.abs(r.best), r.pair))
            order = order[np.diff(r.pair[order], prepend=-1) != 0]
            r, lag, forward = r.part(order), lag[order], forward[order]
        u1, u2 = (u.take(pa.array(r.pair)) for u in (p.u1, p.u2))
        mask = pa.array(forward)
        return pa.RecordBatch.from_arrays([pc.if_else(mask, u1, u2), pc.if_else(mask, u2, u1), pa.array(lag), pa.array(r.best)], ["u1", "u2", "lag", "amplitude"])

    return measured_pairs(df, width, half, measure, "lag double, amplitude double").withColumnsRenamed({"u1": "source", "u2": "target"})


def poisson_sides(tested: DataFrame, p: float) -> DataFrame:
    """Adds side by the Poisson test: 1 for an excess under p, -1 for a lack under p."""
    return tested.withColumn("side", F.when(F.col("p_excess") < p, 1).when(1 - F.col("p_excess") < p, -1).otherwise(0))


def normal_sides(z: DataFrame, threshold: float) -> DataFrame:
    """Adds side by the distance from the baseline in deviations."""
    return z.withColumn("side", F.when(F.col("z") >= threshold, 1).when(F.col("z") <= -threshold, -1).otherwise(0))


def edges(modulations: DataFrame, sign: int | None = None, low: float | None = None, high: float | None = None, least: float = 0.0) -> DataFrame:
    """source, target, lag, amplitude of modulations(u1, u2, at, amplitude, ...), each pair of units once: a lag above 0 runs from u1 to u2, one below 0 back, and 0 from the lower unit.

    sign, low and high (of the lag's size) and least (of the amplitude's size)
    choose among them.
    """
    keep: Column = (F.col("u1") > F.col("u2")) & (F.abs("amplitude") >= least)
    if sign is not None:
        keep &= F.signum("amplitude") == sign
    if low is not None:
        keep &= F.abs("at") >= low
    if high is not None:
        keep &= F.abs("at") <= high
    forward = F.col("at") > 0
    source, target = F.when(forward, F.col("u1")).otherwise(F.col("u2")), F.when(forward, F.col("u2")).otherwise(F.col("u1"))
    return modulations.filter(keep).select(source.alias("source"), target.alias("target"), F.abs("at").alias("lag"), "amplitude")


def main_edges(all_edges: DataFrame) -> DataFrame:
    """The edge of the largest amplitude between each two units, either way; of equal ones the shortest, then the lowest source."""
    pair = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target")).orderBy(F.abs("amplitude").desc(), "lag", "source", "amplitude")
    return all_edges.withColumn("_r", F.row_number().over(pair)).filter("_r = 1").drop("_r")


def degrees(all_edges: DataFrame) -> DataFrame:
    """unit, n_out, n_in, strength: edges from and to each unit, and the sum of their amplitudes' sizes."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("unit"), F.lit(1).alias("out")), F.struct(F.col("target").alias("unit"), F.lit(0).alias("out"))))
    each = all_edges.select(ends.alias("e"), F.abs("amplitude").alias("a")).select("e.unit", "e.out", "a")
    return each.groupBy("unit").agg(F.sum("out").alias("n_out"), F.sum(1 - F.col("out")).alias("n_in"), F.sum("a").alias("strength"))
