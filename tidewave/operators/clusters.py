"""Clusters of spikes in sparse feature spaces: each unit among those around its own peak channel, and silhouettes of pairs.

Features are a long table (id, unit, template, channel, values): of a spike, on
each channel that its template has features on, an array of components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators.quality import amplitude_cutoff, chi2_above, moments, neighbours_in, separation_measures, violations
from tidewave.operators.trains import firing_rate, presence_ratio


def peak_channels(features: DataFrame) -> DataFrame:
    """unit, channel: the median (whole part) of its templates' peaks, the channel where a template's mean first component is largest, the lowest of equals."""
    means = features.groupBy("template", "channel").agg(F.avg(F.get("values", F.lit(0))).alias("m"))
    peaks = means.groupBy("template").agg((-F.max(F.struct("m", (-F.col("channel")).alias("c")))["c"]).alias("peak"))
    of = features.select("unit", "template").distinct()
    return of.join(peaks, "template").groupBy("unit").agg(F.percentile("peak", F.lit(0.5)).cast("long").alias("channel"))


def neighbourhoods(peaks: DataFrame, half: int, last: int) -> DataFrame:
    """centre, unit, low, high: units whose peak is in the channels low to high, at most half from the centre's and from 0 to last."""
    centres = peaks.select(F.col("unit").alias("centre"), F.greatest(F.col("channel") - half, F.lit(0)).alias("low"), F.least(F.col("channel") + half, F.lit(last)).alias("high"))
    return centres.withColumn("channel", F.explode(F.sequence("low", "high"))).join(peaks, "channel").select("centre", "unit", "low", "high")


def neighbourhood_points(features: DataFrame, peaks: DataFrame, half: int) -> DataFrame:
    """centre, id, unit, features: the spikes of the units around each unit, as points over all its channels.

    A spike without features on one of the channels is left out. A spike goes
    to as many centres as have it in reach, which the probe bounds.
    """
    last = features.agg(F.max("channel")).first()[0]
    near = neighbourhoods(peaks, half, int(last or 0))
    on = features.join(near, "unit").filter(F.col("channel").between(F.col("low"), F.col("high")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("channel", "values"))), lambda x: x["values"])
    points = on.groupBy("centre", "id", "unit", "low", "high").agg(ordered.alias("parts"))
    return points.filter(F.size("parts") == F.col("high") - F.col("low") + 1).select("centre", "id", "unit", F.flatten("parts").alias("features"))


def _models(points: DataFrame) -> dict:
    """By centre: mean, inverse covariance, number of points and d prime against the rest; centres whose covariance is singular are left out."""
    rows = moments(points.select((F.col("centre") * 2 + F.col("own").cast("long")).alias("label"), "features")).collect()
    if sum(len(r.covariance) for r in rows) > 1 << 24:
        raise ValueError("too many units or channels for one table in each task")
    parts = {r.label: (r.n, np.array(r.mean), np.array(r.covariance).reshape(len(r.mean), -1)) for r in rows}
    out = {}
    for label, (n, m, cov) in parts.items():
        other = parts.get(label - 1)
        if label % 2 == 0 or other is None or n < 2 or other[0] < 2 or np.linalg.matrix_rank(cov) < len(m):
            continue
        k, mo, co = other
        own, rest = cov * (n - 1), co * (k - 1)
        w = np.linalg.pinv(own + rest) @ (m - mo)
        spread = 0.5 * (w @ own @ w / n + w @ rest @ w / k)
        out[label // 2] = (m, np.linalg.inv(cov), n, float(w @ (m - mo) / np.sqrt(spread)) if spread > 0 else None)
    return out


def centred_points(features: DataFrame, half: int, least: int) -> DataFrame:
    """neighbourhood_points with own, whether of the centre's unit; without centres of fewer than least own points, no other ones, or at most ten in all."""
    points = neighbourhood_points(features, peak_channels(features), half).withColumn("own", F.col("unit") == F.col("centre"))
    enough = points.groupBy("centre").agg(F.count_if("own").alias("n"), F.count("*").alias("all")).filter((F.col("n") >= least) & (F.col("all") > F.col("n")) & (F.col("all") > 10))
    return points.join(enough.select("centre"), "centre", "left_semi")


def neighbour_shares(near: DataFrame) -> DataFrame:
    """space, hit, miss: the share of the neighbours of own points (qlabel 1) that are own (label 1), and of those of other points."""
    rate = lambda own: F.avg(F.when(F.col("qlabel") == own, F.col("label").cast("double")))
    return near.groupBy("space").agg(rate(1).alias("hit"), rate(0).alias("miss"))


def neighbourhood_metrics(features: DataFrame, half: int = 3, k: int = 3, least: int = 21, query_share: int = 1) -> DataFrame:
    """unit, isolation, l_ratio, d_prime, hit, miss of each unit against the spikes around it, in the channels around its peak.

    Units of fewer than least points, or alone in their neighbourhood, are left
    out. k: neighbours of each point; query_share: of so many points one is a
    query for the nearest others, 1 for all of them, whose work is then the
    square of a neighbourhood's points. Means and covariances go to every task:
    one of the channels' square for each unit of a probe.
    """
    spark = features.sparkSession
    points = centred_points(features, half, least)
    models = _models(points)
    few = spark.createDataFrame([(c, n, d) for c, (_, _, n, d) in models.items()], "label long, n long, d_prime double")

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for centre, part in pdf.groupby("centre"):
                if centre in models:
                    m, inverse, _, _ = models[centre]
                    x = np.stack(part.features) - m
                    d = np.einsum("ij,jk,ik->i", x, inverse, x)
                    yield pd.DataFrame({"label": centre, "d": d, "tail": chi2_above(np.maximum(d, 0), len(m))})

    far = points.filter("NOT own").select("centre", "features").mapInPandas(distances, "label long, d double, tail double")
    measured = separation_measures(far, few)
    spaced = points.select(F.col("centre").alias("space"), "id", F.col("own").cast("int").alias("label"), "features")
    queries = spaced if query_share == 1 else spaced.filter(F.pmod(F.xxhash64("id"), F.lit(query_share)) == 0)
    rates = neighbour_shares(neighbours_in(queries, spaced, k))
    units = points.select("centre").distinct().join(measured.withColumnRenamed("label", "centre"), "centre", "left").join(rates.withColumnRenamed("space", "centre"), "centre", "left")
    return units.select(F.col("centre").alias("unit"), "isolation", "l_ratio", "d_prime", "hit", "miss")


def distance_sums(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, classes_x: int, classes_y: int, held: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the distances to the rows of y, summed by their class, and of each row of y those to the rows of x.

    Distances come out of a matrix product, so many at a time; those that are
    small against the points' own lengths are taken anew from differences.
    """
    squares = (y * y).sum(axis=1)
    left, right = np.zeros((len(x), classes_x)), np.zeros((len(y), classes_y))
    kind = np.eye(classes_x)[of_y]
    step = max(1, held // max(1, len(y)))
    for first in range(0, len(x), step):
        part = x[first : first + step]
        d = part @ y.T
        d *= -2
        d += squares[None, :]
        own = (part * part).sum(axis=1)
        d += own[:, None]
        i, j = np.nonzero(d < 1e-6 * (own[:, None] + squares.max()))
        for k in range(0, len(i), step * 64):
            p, q = i[k : k + step * 64], j[k : k + step * 64]
            d[p, q] = ((part[p] - y[q]) ** 2).sum(axis=1)
        np.sqrt(d, out=d)
        left[first : first + step] = d @ kind
        right += d.T @ np.eye(classes_y)[of_x[first : first + step]]
    return left, right


def silhouettes(points: DataFrame, most: int | None = 10_000, block: int = 32_000) -> DataFrame:
    """l1 < l2, silhouette: the mean silhouette of the points of each two labels, among these two. points(id, label, features array<double>).

    Distances can't be summed from moments, so every two points meet once, in
    blocks that leave one sum for each point and label of both sides. That is
    the square of the points, and what is shuffled that square over a block's
    size: most is the size of the sample that is compared, the points of the
    lowest hashes of id; None: all points.
    """
    if most is not None:
        least = points.select("id").orderBy(F.xxhash64("id"), "id").limit(most)
        points = points.join(least, "id", "left_semi")
    count = points.count()
    # some blocks for every core where points are few, too
    spread = min(-(-count // 1_000), int((2 * points.sparkSession.sparkContext.defaultParallelism) ** 0.5) + 1)
    blocks = max(1, -(-count // block), spread)
    number = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    upto, from_ = F.explode(F.sequence(number, F.lit(blocks - 1))), F.explode(F.sequence(F.lit(0), number))
    left = points.select(F.col("id").alias("qid"), F.col("label").alias("qlabel"), F.col("features").alias("qf"), number.alias("qblock"), upto.alias("pblock"))
    right = points.select(F.col("id").alias("pid"), F.col("label").alias("plabel"), F.col("features").alias("pf"), from_.alias("qblock"), number.alias("pblock"))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "label": [], "other": [], "total": []})
        x, y = np.stack(a.qf), np.stack(b.pf)
        (xn, of_x), (yn, of_y) = (np.unique(c.to_numpy(), return_inverse=True) for c in (a.qlabel, b.plabel))
        to_y, to_x = distance_sums(x, y, of_x, of_y, len(yn), len(xn))
        out = [(a.qid, a.qlabel, yn, to_y)]
        if a.qblock.iloc[0] != b.pblock.iloc[0]:  # a block with itself has every pair twice
            out.append((b.pid, b.plabel, xn, to_x))
        each = [pd.DataFrame({"id": np.repeat(i.to_numpy(), len(names)), "label": np.repeat(own.to_numpy(), len(names)), "other": np.tile(names, len(i)), "total": t.ravel()}) for i, own, names, t in out]
        return pd.concat(each, ignore_index=True)

    types = dict(points.dtypes)
    cells = blocks * (blocks + 1) // 2
    pair = lambda d: d.repartition(min(2_000, cells), "qblock", "pblock").groupBy("qblock", "pblock")
    part = pair(left).cogroup(pair(right)).applyInPandas(sums, f"id {types['id']}, label {types['label']}, other {types['label']}, total double")
    n = points.groupBy("label").agg(F.count("*").alias("n"))
    total = part.groupBy("id", "label", "other").agg(F.sum("total").alias("total")).join(n.select(F.col("label").alias("other"), "n"), "other")
    own = total.filter("other = label").select("id", F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)).alias("a"))
    between = total.filter("other <> label").select("id", "label", "other", (F.col("total") / F.col("n")).alias("b")).join(own, "id")
    # a point alone in its label counts 0
    s = F.when(F.col("a").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    scored = between.select(F.least("label", "other").alias("l1"), F.greatest("label", "other").alias("l2"), s.alias("s"))
    return scored.groupBy("l1", "l2").agg(F.avg("s").alias("silhouette"), F.count("*").alias("_n")).filter("_n > 2").drop("_n")


def least_silhouettes(pairs: DataFrame) -> DataFrame:
    """label, silhouette: the smallest over the pairs that a label is in."""
    return pairs.select(F.explode(F.array("l1", "l2")).alias("label"), "silhouette").groupBy("label").agg(F.min("silhouette").alias("silhouette"))


def dense_points(features: DataFrame) -> DataFrame:
    """id, label (the unit), features: each spike as a point over all channels, 0 on those that its template has no features on."""
    ends = features.agg(F.max("channel").alias("_last"), F.max(F.size("values")).alias("_n"))
    by = features.groupBy("id", "unit").agg(F.map_from_entries(F.collect_list(F.struct("channel", "values"))).alias("_m"))
    none = F.array_repeat(F.lit(0.0), F.col("_n"))
    whole = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long")), lambda c: F.coalesce(F.try_element_at("_m", c), none)))
    return by.join(F.broadcast(ends)).select("id", F.col("unit").alias("label"), whole.alias("features"))


def quality_table(df: DataFrame, periods: list[tuple[int, int]], ticks_per_second: float, isi_threshold: float, min_isi: float, features: DataFrame | None = None, half: int = 2, k: int = 3, n_silhouette: int | None = 10_000, presence_edges: int = 100) -> DataFrame:
    """period, unit, rate, presence, n_violations, fp_rate, missing, and with features also isolation, l_ratio, d_prime, hit, miss, silhouette: the measures of every unit in each period.

    df(unit, id, t, a). A period holds the spikes after its start up to its
    stop, between which presence is taken; all units of df have a row in each,
    with nulls where they have too few spikes. features as in
    neighbourhood_metrics, n_silhouette as in silhouettes. Periods are a few, as
    each is a part of the plan.
    """
    units = df.select("unit").distinct()
    out = None
    for number, (start, stop) in enumerate(periods):
        rows = df.filter((F.col("t") > start) & (F.col("t") <= stop))
        parts = [firing_rate(rows, ticks_per_second), presence_ratio(rows, start, stop, presence_edges), violations(rows, isi_threshold, min_isi, ticks_per_second), amplitude_cutoff(rows)]
        if features is not None:
            some = features.join(rows.select("id"), "id", "left_semi")
            parts += [neighbourhood_metrics(some, half, k), least_silhouettes(silhouettes(dense_points(some), n_silhouette)).withColumnRenamed("label", "unit")]
        one = units.withColumn("period", F.lit(number))
        for part in parts:
            one = one.join(part, "unit", "left")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("at least one period is needed")
    return out
