"""Quality of units: contamination, stability, separation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators.trains import with_intervals
from tidewave.operators.waveforms import missing_spikes


def violations(df: DataFrame, threshold: float, least: float, ticks_per_second: float) -> DataFrame:
    """unit, n_violations, fp_rate: intervals under the threshold, of spikes more than least after the one before."""
    clean = with_intervals(df).filter(F.coalesce(F.col("isi") > least, F.lit(True))).drop("isi")
    isi = with_intervals(clean)
    g = isi.groupBy("unit").agg(F.count("*").alias("n"), F.count_if(F.col("isi") < threshold).alias("n_violations"), ((F.max("t") - F.min("t")) / F.lit(ticks_per_second)).alias("seconds"))
    window = 2 * F.col("n") * F.lit((threshold - least) / ticks_per_second)
    return g.filter("n > 1").select("unit", "n_violations", F.try_divide(F.col("n_violations") / window * F.col("seconds"), F.col("n")).alias("fp_rate"))


def sliding_chunks(df: DataFrame, size: int, span: int, first: int) -> DataFrame:
    """Adds chunk: each row once for each of the span chunks that cover it; chunk i is [first + i size, first + (i + span) size)."""
    k = F.floor((F.col("t") - first) / size)
    return df.withColumn("chunk", F.explode(F.sequence(F.greatest(k - (span - 1), F.lit(0)), k)))


def chunk_votes(df: DataFrame, size: int, span: int, first: int, threshold: int, most_share: float, any_passes: bool) -> DataFrame:
    """unit, chunk, good: an elemental chunk is good if any (or all) of the chunks over it have few enough short intervals."""
    w = Window.partitionBy("unit", "chunk").orderBy("t")
    chunks = sliding_chunks(df, size, span, first).withColumn("isi", F.col("t") - F.lag("t").over(w))
    passed = chunks.groupBy("unit", "chunk").agg((F.count_if(F.col("isi") < threshold) <= F.lit(most_share) * F.count("*")).alias("ok"))
    return _votes(passed, span, any_passes)


def _votes(passed: DataFrame, span: int, any_passes: bool) -> DataFrame:
    votes = passed.select("unit", F.explode(F.sequence(F.col("chunk"), F.col("chunk") + (span - 1))).alias("chunk"), "ok")
    return votes.groupBy("unit", "chunk").agg((F.bool_or("ok") if any_passes else F.bool_and("ok")).alias("good"))


def missing_votes(df: DataFrame, size: int, span: int, first: int, most_missing: float, any_passes: bool) -> DataFrame:
    """unit, chunk, good: as chunk_votes, by the share of amplitudes that the fit of a chunk says are missing; chunks that can't be fitted don't vote."""
    fitted = missing_spikes(sliding_chunks(df, size, span, first).select("unit", "chunk", "a"), ["unit", "chunk"])
    passed = fitted.filter(~F.isnan("missing")).select("unit", "chunk", (F.col("missing") <= most_missing).alias("ok"))
    return _votes(passed, span, any_passes)


def filtered_train(df: DataFrame, first: int, violation: int, size_fp: int, span_fp: int, size_fn: int, span_fn: int, most_fp: float = 0.05, most_fn: float = 0.05, any_passes: bool = True) -> DataFrame:
    """The spikes in a chunk that is good by its short intervals and in one that is good by its amplitudes. df(unit, t, a, ...)."""
    fp = chunk_votes(df, size_fp, span_fp, first, violation, most_fp, any_passes).filter("good").select("unit", F.col("chunk").alias("_fp"))
    fn = missing_votes(df, size_fn, span_fn, first, most_fn, any_passes).filter("good").select("unit", F.col("chunk").alias("_fn"))
    rows = df.withColumn("_fp", F.floor((F.col("t") - first) / size_fp)).withColumn("_fn", F.floor((F.col("t") - first) / size_fn))
    return rows.join(fp, ["unit", "_fp"], "left_semi").join(fn, ["unit", "_fn"], "left_semi").select(*df.columns)


def amplitude_cutoff(df: DataFrame, bins: int = 500, sd: float = 3.0) -> DataFrame:
    """unit, missing: the mass of the smoothed density of amplitudes beyond the point opposite its lower end, 0.5 at most."""
    ends = df.groupBy("unit").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.count("*").alias("size")).filter("hi > lo")
    k = F.least(F.floor((F.col("a") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = df.join(ends, "unit").groupBy("unit", "size", k.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    # at most bins entries for a unit
    shape = counts.groupBy("unit", "size").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("counts"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                n = np.zeros((len(pdf), bins))
                for row, where, count in zip(n, pdf.bins, pdf.counts, strict=True):
                    row[where] = count
                yield pd.DataFrame({"unit": pdf.unit, "missing": np.minimum(mass_beyond(n, sd) / pdf["size"].to_numpy(), 0.5)})

    return shape.select("unit", "size", "bins", "counts").mapInPandas(cut, f"unit {dict(df.dtypes)['unit']}, missing double")


def mass_beyond(counts: np.ndarray, sd: float) -> np.ndarray:
    """Of each histogram (a row), smoothed, the mass from the point beyond its peak that is as high as its lower end.

    Heights and their distances are taken to 9 places, so that equal bins are equal.
    """
    places = lambda x: np.floor(x * 1e9 + 0.5) / 1e9
    reach = math.ceil(4 * sd)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sd) ** 2)
    size = counts.shape[1]
    wide = np.pad(counts, ((0, 0), (reach, reach)), mode="symmetric")
    p = places(sum(w * wide[:, i : i + size] for i, w in enumerate(weights)) / weights.sum())
    place = np.arange(size)
    tail = np.where(place >= p.argmax(axis=1)[:, None], places(np.abs(p - p[:, :1])), np.inf)
    return np.where(place >= tail.argmin(axis=1)[:, None], p, 0.0).sum(axis=1)


def drift(df: DataFrame, value: str, interval: int, least: int) -> DataFrame:
    """unit, max_drift, cumulative_drift of a value's median over intervals with enough spikes."""
    medians = df.groupBy("unit", F.floor(F.col("t") / interval).alias("k")).agg(F.percentile(value, F.lit(0.5)).alias("m"), F.count("*").alias("n")).filter(F.col("n") >= least)
    w = Window.partitionBy("unit").orderBy("k")
    steps = medians.withColumn("d", F.abs(F.col("m") - F.lag("m").over(w)))
    return steps.groupBy("unit").agg((F.max("m") - F.min("m")).alias("max_drift"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("cumulative_drift"))


def nearest_rows(x: np.ndarray, ids: np.ndarray, f: np.ndarray, own: np.ndarray, k: int, held: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of the k rows of x nearest to each query of f other than its own id; equal distances by place.

    A matrix product finds the rows that can be among the k; of these the
    distances are then taken one by one, so rounding decides nothing. So many
    queries are looked at together as make held distances.
    """
    squares = (x * x).sum(axis=1)
    m = min(k, len(x))
    found = []
    for first in range(0, len(f), max(1, held // max(1, len(x)))):
        part = f[first : first + max(1, held // max(1, len(x)))]
        near = part @ x.T
        near *= -2
        near += squares[None, :]
        near += (part * part).sum(axis=1)[:, None]
        near[ids[None, :] == own[first : first + len(part), None]] = np.inf
        slack = 1e-9 * (squares.max() + (part * part).sum(axis=1)) + 1e-300
        limit = np.partition(near, m - 1, axis=1)[:, m - 1] + slack
        q, row = np.nonzero((near <= limit[:, None]) & np.isfinite(near))
        d = ((x[row] - part[q]) ** 2).sum(axis=1)
        order = np.lexsort((row, d, q))
        q, row, d = q[order], row[order], d[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((q[keep] + first, row[keep], d[keep]))
    q, row, d = zip(*found, strict=True)
    return np.concatenate(q), np.concatenate(row), np.concatenate(d)


def neighbours_in(queries: DataFrame, points: DataFrame, k: int, query_block: int = 10_000, point_block: int = 20_000) -> DataFrame:
    """space, qid, qlabel, id, label, d: the k points of its space nearest to each query, other than itself. Equal distances go by id.

    queries and points(space, id, label, features array<double>). Each query
    meets every point of its space, in blocks of bounded size whose number
    follows the space; a block keeps its k nearest before they are merged. Work
    is the product of the sides, and what is shuffled that product over a block's
    size.
    """
    sizes = points.groupBy("space").agg(F.ceil(F.count("*") / point_block).cast("int").alias("pblocks")).join(queries.groupBy("space").agg(F.ceil(F.count("*") / query_block).cast("int").alias("qblocks")), "space")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # all columns anew: queries often come from points, and the sides of a cogroup must not share any
    q = queries.join(sizes, "space").select(F.col("space").alias("qspace"), F.col("id").alias("qid"), F.col("label").alias("qlabel"), F.col("features").alias("qf"), block("qblocks").alias("qblock"), every("pblocks").alias("pblock"))
    p = points.join(sizes, "space").select(F.col("space").alias("pspace"), F.col("id").alias("pid"), F.col("label").alias("plabel"), F.col("features").alias("pf"), block("pblocks").alias("pblock"), every("qblocks").alias("qblock"))
    names = ["space", "qid", "qlabel", "id", "label", "d"]

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names})
        right = right.sort_values("pid")
        i, j, d = nearest_rows(np.stack(right.pf), right.pid.to_numpy(), np.stack(left.qf), left.qid.to_numpy(), k)
        return pd.DataFrame({"space": left.qspace.iloc[0], "qid": left.qid.to_numpy()[i], "qlabel": left.qlabel.to_numpy()[i], "id": right.pid.to_numpy()[j], "label": right.plabel.to_numpy()[j], "d": d})

    types = dict(points.dtypes)
    schema = f"space {types['space']}, qid {types['id']}, qlabel {types['label']}, id {types['id']}, label {types['label']}, d double"
    inside = q.groupBy("qspace", "qblock", "pblock").cogroup(p.groupBy("pspace", "qblock", "pblock")).applyInPandas(nearest, schema)
    return inside.withColumn("r", F.row_number().over(Window.partitionBy("space", "qid").orderBy("d", "id"))).filter(F.col("r") <= k).drop("r")


def neighbour_rates(queries: DataFrame, points: DataFrame, k: int, query_block: int = 10_000, point_block: int = 20_000) -> DataFrame:
    """label, hit, miss: the share of a label's query points' k nearest others that have its label, and of other labels' that do.

    points(id, label, features array<double>); queries are all of them, or the part that is asked for.
    """
    best = neighbours_in(queries.withColumn("space", F.lit(0)), points.withColumn("space", F.lit(0)), k, query_block, point_block)
    own = best.groupBy("qlabel").agg(F.avg((F.col("label") == F.col("qlabel")).cast("double")).alias("hit"), F.count("*").alias("n"))
    crossed = best.filter("label <> qlabel").groupBy(F.col("label").alias("qlabel")).agg(F.count("*").alias("c"))
    total = best.agg(F.count("*").alias("all"))
    return own.join(crossed, "qlabel", "left").join(F.broadcast(total)).select(F.col("qlabel").alias("label"), "hit", (F.coalesce("c", F.lit(0)) / (F.col("all") - F.col("n"))).alias("miss"))


def moments(points: DataFrame) -> DataFrame:
    """label, n, mean, covariance (row by row, over n - 1; NaN for one point) of points(label, features array<double>): partial sums in each batch, then sums of these."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for label, part in pdf.groupby("label"):
                x = np.stack(part.features)
                sums = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)])
                rows.append(pd.DataFrame({"label": label, "k": np.arange(len(sums)), "v": sums}))
            yield pd.concat(rows) if rows else pd.DataFrame({"label": [], "k": [], "v": []})

    kind = dict(points.dtypes)["label"]
    sums = points.select("label", "features").mapInPandas(partial, f"label {kind}, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v"))
    flat = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("s"))
    d = ((F.sqrt(4 * F.size("s") - 3) - 1) / 2).cast("int")
    out = flat.withColumn("d", d).withColumn("n", F.get("s", F.lit(0))).withColumn("mean", F.transform(F.slice("s", F.lit(2), F.col("d")), lambda x: x / F.col("n")))
    at = lambda i: F.get("mean", F.floor(i / F.col("d")).cast("int")) * F.get("mean", (i % F.col("d")).cast("int"))
    cov = F.transform(F.slice("s", F.col("d") + 2, F.col("d") * F.col("d")), lambda x, i: F.when(F.col("n") > 1, (x - F.col("n") * at(i)) / F.greatest(F.col("n") - 1, F.lit(1.0))).otherwise(float("nan")))
    return out.select("label", F.col("n").cast("long").alias("n"), "mean", cov.alias("covariance"))


def chi2_above(x: np.ndarray, degrees: int) -> np.ndarray:
    """The chance that a chi-square of so many degrees is above x, by the recurrence in steps of two degrees."""
    if degrees % 2 == 0:
        term = tail = np.exp(-x / 2)
        first = 2
    else:
        tail = np.array([math.erfc(math.sqrt(v / 2)) for v in x])
        term = np.exp(-x / 2) * np.sqrt(2 * x / math.pi)
        first = 1
        if degrees >= 3:
            tail = tail + term
            first = 3
    for k in range(first, degrees, 2):
        term = term * x / k
        tail = tail + term
    return tail


def separation(points: DataFrame) -> DataFrame:
    """label, isolation, l_ratio, d_prime of each label's points against all others'. points(id, label, features array<double>).

    Mahalanobis distances are from a label's mean by its covariance. isolation:
    that (squared) of as many of the others as the label has points, or of all
    of them; l_ratio: their chi-square tails over the label's points; d_prime:
    along Fisher's direction, by population deviations. Labels are as few as
    the units of a probe: their means and covariances go to every task. Null
    where a covariance is singular or a side has under two points. The rank
    that isolation asks for is found in a histogram of distances, so that only
    one bin's rows are sorted.
    """
    spark = points.sparkSession
    rows = moments(points).collect()
    if sum(len(r.covariance) for r in rows) > 1 << 24:
        raise ValueError("too many labels or features for one table in each task")
    models, kind = {}, dict(points.dtypes)["label"]
    total = sum(r.n for r in rows)
    for r in rows:
        n, m = r.n, np.array(r.mean)
        cov = np.array(r.covariance).reshape(len(m), len(m))
        others = [(o.n, np.array(o.mean), np.array(o.covariance).reshape(len(m), len(m))) for o in rows if o.label != r.label]
        if n < 2 or total - n < 2 or not np.isfinite(cov).all() or np.linalg.matrix_rank(cov) < len(m):
            continue
        # scatter of the rest from its parts
        weight = total - n
        mo = sum(k * mu for k, mu, _ in others) / weight
        so = sum((k - 1) * np.nan_to_num(c) + k * np.outer(mu - mo, mu - mo) for k, mu, c in others)
        within = (n - 1) * cov + so
        w = np.linalg.pinv(within) @ (m - mo)
        spread = 0.5 * (w @ cov @ w * (n - 1) / n + w @ so @ w / weight)
        models[r.label] = (m, np.linalg.inv(cov), n, float(w @ (m - mo) / np.sqrt(spread)) if spread > 0 else None)
    few = spark.createDataFrame([(k, n, d) for k, (_, _, n, d) in models.items()], f"label {kind}, n long, d_prime double")

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, label = np.stack(pdf.features), pdf.label.to_numpy()
            for name, (m, inverse, _, _) in models.items():
                other = x[label != name] - m
                if len(other):
                    d = np.einsum("ij,jk,ik->i", other, inverse, other)
                    yield pd.DataFrame({"label": name, "d": d, "tail": chi2_above(np.maximum(d, 0), len(m))})

    far = points.select("label", "features").mapInPandas(distances, f"label {kind}, d double, tail double")
    return separation_measures(far, few)


def separation_measures(far: DataFrame, few: DataFrame) -> DataFrame:
    """label, isolation, l_ratio, d_prime from the others' squared distances far(label, d, tail) and few(label, n, d_prime)."""
    # bins of the distances' logarithm: 64 to each doubling
    binned = far.withColumn("bin", F.floor(F.log2(F.greatest(F.col("d"), F.lit(1e-300))) * 64))
    sums = binned.groupBy("label", "bin").agg(F.count("*").alias("c"), F.sum("tail").alias("tail"))
    w = Window.partitionBy("label").orderBy("bin")
    ranked = sums.join(few.select("label", "n"), "label").withColumn("upto", F.sum("c").over(w)).withColumn("all", F.sum("c").over(Window.partitionBy("label")))
    wanted = F.least("n", "all")
    hit = ranked.filter((F.col("upto") >= wanted) & (F.col("upto") - F.col("c") < wanted)).select("label", "bin", (wanted - F.col("upto") + F.col("c")).alias("rank"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("d"))
    isolation = binned.join(hit, ["label", "bin"]).withColumn("place", place).filter("place = rank").select("label", F.col("d").alias("isolation"))
    l_ratio = sums.groupBy("label").agg(F.sum("tail").alias("tail"))
    return few.join(isolation, "label", "left").join(l_ratio, "label", "left").select("label", "isolation", (F.col("tail") / F.col("n")).alias("l_ratio"), "d_prime")


def spike_depth(features: DataFrame, pitch: float = 10.0) -> DataFrame:
    """id, depth: the mean place of a spike's channels, weighted by the squares of their positive first components. features(id, channels array, values array)."""
    power = F.transform("values", lambda v: F.when(v > 0, v * v).otherwise(0.0))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return features.withColumn("_p", power).select("id", (F.try_divide(add(F.zip_with("channels", "_p", lambda c, p: c * p)), add("_p")) * F.lit(pitch)).alias("depth"))
