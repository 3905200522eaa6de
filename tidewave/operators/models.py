"""Tests, fits and votes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """w: Levene's statistic about group medians."""
    med = df.groupBy(group).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    z = df.join(med, group).select(group, F.abs(F.col(value) - F.col("_m")).alias("z"))
    each = z.groupBy(group).agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("v"))
    all_ = each.agg(F.sum("n").alias("all_n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("all_m"))
    parts = each.join(F.broadcast(all_)).groupBy("all_n", "k").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("all_m"), F.lit(2))).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"))
    return parts.select(((F.col("all_n") - F.col("k")) / (F.col("k") - 1) * F.col("b") / F.col("w")).alias("w"))


def normal_equations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """i, j, s: sums of products of the features (and a constant, 0) and of them with the target (j = -1)."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    pairs = [(i, j, a * b) for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j] + [(i, -1, a * F.col(target)) for i, a in enumerate(cols)]
    sums = df.agg(*(F.sum(x).alias(f"s{k}") for k, (_, _, x) in enumerate(pairs)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{k}").alias("s")) for k, (i, j, _) in enumerate(pairs)))).alias("x")).select("x.*")


def ridge(df: DataFrame, features: list[str], target: str, penalty: float = 0.0) -> np.ndarray:
    """Coefficients, the constant first: sums by Spark, and a system of one row for each feature solved here."""
    n = len(features) + 1
    a, b = np.zeros((n, n)), np.zeros(n)
    for i, j, s in normal_equations(df, features, target).collect():
        if j < 0:
            b[i] = s
        else:
            a[i, j] = a[j, i] = s
    return np.linalg.solve(a + penalty * np.diag([0.0] + [1.0] * (n - 1)), b)


def design_matrix(df: DataFrame, column: str, before: int, after: int, unit: str = "unit", t: str = "t") -> DataFrame:
    """Adds lag_-before ... lag_after of a column, 0 beyond a unit's ends."""
    w = Window.partitionBy(unit).orderBy(t)
    return df.withColumns({f"lag_{k}": F.coalesce(F.lead(column, k).over(w) if k > 0 else F.lag(column, -k).over(w), F.lit(0)) for k in range(-before, after + 1)})


def poisson_pmf(k: Column, rate: Column) -> Column:
    """exp(k ln rate - rate - ln k!)"""
    log_factorial = F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    return F.exp(k * F.log(rate) - rate - log_factorial)


def poisson_cdf(k: Column, rate: Column) -> Column:
    """The sum of terms rate^i / i!, each from the one before."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    step = lambda s, i: F.struct((s["term"] * rate / i).alias("term"), (s["sum"] + s["term"] * rate / i).alias("sum"))
    terms = F.when(k < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))))
    return F.when(k < 0, 0.0).otherwise(F.aggregate(terms, start, step, lambda s: s["sum"]) * F.exp(-rate))


def normal_pdf(x: Column, mean: float | Column = 0.0, sd: float | Column = 1.0) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * F.sqrt(F.lit(2 * np.pi)))


def normal_cdf(x: Column, mean: float | Column = 0.0, sd: float | Column = 1.0) -> Column:
    """0.5 + pdf(z) (z + z^3 / 3 + z^5 / 15 ...); 0 or 1 where |z| is over 8."""
    z = (x - mean) / sd
    start = F.struct(z.alias("term"), z.alias("sum"))
    step = lambda s, k: F.struct((s["term"] * z * z / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * z * z / (2 * k + 1)).alias("sum"))
    near = 0.5 + normal_pdf(z) * F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, step, lambda s: s["sum"])
    return F.when(z > 8, 1.0).when(z < -8, 0.0).otherwise(near)


def modulations(z: DataFrame, threshold: float, least: int) -> DataFrame:
    """u1, u2, first, last, n, amplitude, at: runs of bins beyond the threshold (either sign), with the largest |z| and its bin."""
    from tidewave.functions.timeline import islands

    side = F.when(F.col("z") >= threshold, 1).when(F.col("z") <= -threshold, -1).otherwise(0)
    return modulations_of(islands(z.withColumn("side", side), "side", ["u1", "u2"], ["bin"]).filter("side <> 0"), least)


def modulations_of(marked: DataFrame, least: int) -> DataFrame:
    """modulations of bins that are on a side, with the number of their run. marked(u1, u2, bin, z, run)."""
    best = F.max(F.struct(F.abs("z").alias("h"), (-F.col("bin")).alias("b"), F.col("z").alias("z")))
    out = marked.groupBy("u1", "u2", "run").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.count("*").alias("n"), best.alias("best"))
    return out.filter(F.col("n") >= least).select("u1", "u2", "first", "last", "n", F.col("best.z").alias("amplitude"), (-F.col("best.b")).alias("at"))


def connection_kind(width_ms: float) -> Column:
    """synchrony, excitation, inhibition or none, by sign and time of the centre of a modulation(first, last, amplitude)."""
    centre = (F.col("first") + F.col("last") + 1) / 2 * width_ms
    up, far = F.col("amplitude") > 0, F.abs(centre)
    return F.when(up & (far <= 1), "synchrony").when(up & far.between(1, 2.5), "excitation").when(~up & far.between(0.2, 3), "inhibition").otherwise("none")


def ensemble_vote(predictions: DataFrame) -> DataFrame:
    """unit, prediction, confidence, delta, ratio, votes of predictions(unit, class, model, p). Equal means (to 12 places) go to the lower class."""
    mean = predictions.groupBy("unit", "class").agg(F.round(F.avg("p"), 12).alias("p"))
    top = mean.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct(F.col("p"), (-F.col("class")).alias("c"))), asc=False).alias("r"))
    top = top.select("unit", (-F.col("r")[0]["c"]).alias("prediction"), F.col("r")[0]["p"].alias("confidence"), F.col("r")[1]["p"].alias("second"))
    each = predictions.groupBy("unit", "model").agg((-F.max(F.struct("p", (-F.col("class")).alias("c")))["c"]).alias("vote"))
    votes = each.join(top.select("unit", "prediction"), "unit").groupBy("unit").agg(F.count_if(F.col("vote") == F.col("prediction")).alias("votes"))
    return top.join(votes, "unit").select("unit", "prediction", "confidence", (F.col("confidence") - F.col("second")).alias("delta"), (F.col("confidence") / F.col("second")).alias("ratio"), "votes")


def prior_corrected(predictions: DataFrame, zeroed: Column) -> DataFrame:
    """p set to 0 where the prior rules a class out, then brought back to a sum of 1 for each unit and model (null if nothing is left)."""
    w = Window.partitionBy("unit", "model")
    masked = predictions.withColumn("p", F.when(zeroed, 0.0).otherwise(F.col("p"))).withColumn("_s", F.sum("p").over(w))
    return masked.withColumn("p", F.when(F.col("_s") > 0, F.col("p") / F.col("_s"))).drop("_s")
