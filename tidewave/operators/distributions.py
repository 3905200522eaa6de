"""Fractiles of laws on a grid, and how well values follow the normal law."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_fractile(p: float, mean: Column | float = 0.0, sd: Column | float = 1.0) -> Column:
    """The first place of a grid from 4 deviations under the mean, a hundredth of one apart, up to which the normal law has p; rounded to 4 places. Null where 4 deviations above it has less."""
    cdf = lambda k: 0.5 * math.erfc((4 - k / 100) / math.sqrt(2))
    k = next((k for k in range(801) if cdf(k) >= p), None)
    if k is None:
        return F.lit(None).cast("double")
    sd = sd if isinstance(sd, Column) else F.lit(float(sd))
    return F.round(mean - 4 * sd + k * (sd / 100), 4)


def poisson_fractile(p: float, rate: Column) -> Column:
    """The least count up to which the Poisson law of a rate has p, of those up to four times the rate and one (exclusive); null where none has, or the rate isn't positive."""
    start = F.struct((-rate).alias("log"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("found"))

    def step(s: Column, k: Column) -> Column:
        log = F.when(k > 0, s["log"] + F.log(rate / k)).otherwise(s["log"])
        total = s["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.coalesce(s["found"], F.when(total >= p, k)).alias("found"))

    counts = F.sequence(F.lit(0).cast("long"), F.ceil(4 * rate))
    return F.when(rate > 0, F.aggregate(counts, start, step, lambda s: s["found"]))


def skewness_and_tails(df: DataFrame, value: str, by: str = "unit") -> DataFrame:
    """by, n, k2, p: the test of D'Agostino and Pearson, which adds the squares of what skewness and kurtosis are off in deviations.

    Null for fewer than 8 values and for values that are all the same. Moments
    are taken around the mean: two aggregations that combine before the shuffle.
    """
    known = df.select(by, F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    means = known.groupBy(by).agg(F.avg("x").alias("m"))
    d = F.col("x") - F.col("m")
    sums = known.join(means, by).groupBy(by).agg(F.count("*").cast("double").alias("n"), *(F.avg(F.pow(d, F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4)))
    n = F.col("n")
    skew, tails = F.col("m3") / F.pow("m2", F.lit(1.5)), F.col("m4") / (F.col("m2") * F.col("m2"))
    # skewness, by a law of Johnson's SU family
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    # kurtosis, by a cube root of a chi-square
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (tails - 3 * (n - 1) / (n + 1)) / F.sqrt(spread)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    under = 1 + x * F.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - F.signum(under) * F.cbrt((1 - 2 / a) / F.abs(under))) / F.sqrt(2 / (9 * a))
    fit = (n >= 8) & (F.col("m2") > 0)
    out = sums.withColumn("k2", F.when(fit, z1 * z1 + z2 * z2))
    return out.select(by, n.cast("long").alias("n"), "k2", F.exp(-F.col("k2") / 2).alias("p"))


def log_normal_cdf(z: Column) -> Column:
    """The logarithm of the standard normal law's chance up to z, by a continued fraction under -3."""
    @F.pandas_udf("double")
    def log_cdf(z: pd.Series) -> pd.Series:
        x = z.to_numpy(float)
        far = np.maximum(-x, 3.0)
        ratio = far
        for k in range(60, 0, -1):
            ratio = far + k / ratio
        with np.errstate(divide="ignore"):
            near = np.log(normal_chances(x))
        return pd.Series(np.where(x < -3, -0.5 * x * x - 0.5 * math.log(2 * math.pi) - np.log(ratio), near))

    return log_cdf(z)


def normal_chance(z: Column) -> Column:
    """models.normal_cdf of the standard law by Arrow batches."""

    @F.pandas_udf("double")
    def cdf(z: pd.Series) -> pd.Series:
        return pd.Series(normal_chances(z.to_numpy(float)))

    return cdf(z)


def normal_chances(z: np.ndarray) -> np.ndarray:
    """The standard normal law's chances up to z, by the series of models.normal_cdf."""
    near = np.clip(z, -8.0, 8.0)
    square, term = near * near, near.copy()
    total = near.copy()
    for k in range(1, 121):
        term *= square / (2 * k + 1)
        total += term
    p = 0.5 + np.exp(-0.5 * square) / math.sqrt(2 * math.pi) * total
    return np.where(z > 8, 1.0, np.where(z < -8, 0.0, p))


def distance_from_normal(df: DataFrame, value: str, by: str = "unit") -> DataFrame:
    """by, n, d, a2: the largest distance of the values' law from the standard normal one (Kolmogorov and Smirnov), and the statistic of Anderson and Darling with the values' own mean and deviation.

    Values are counted first, so what is put in order in a group is its
    distinct ones. a2 is null for fewer than two values or none that differ.
    """
    counts = df.select(by, F.col(value).cast("double").alias("x")).filter("x IS NOT NULL").groupBy(by, "x").agg(F.count("*").alias("c"))
    totals = counts.groupBy(by).agg(F.sum("c").alias("n"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("m"))
    spread = counts.join(totals, by).groupBy(by, "n", "m").agg(F.sqrt(F.try_divide(F.sum(F.col("c") * (F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))), F.col("n") - 1)).alias("s"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).join(spread, by)
    c, n, k = F.col("c"), F.col("n"), F.col("upto")
    cdf = normal_chance(F.col("x"))
    y = F.try_divide(F.col("x") - F.col("m"), F.col("s"))  # asked for of all rows, those of no deviation too
    # ranks k - c + 1 to k have this value: the sums of 2 i - 1 and of 2 (n - i) + 1 over them
    low, high = c * (2 * k - c), c * (2 * (n - k) + c)
    term = low * log_normal_cdf(y) + high * log_normal_cdf(-y)
    out = placed.groupBy(by, "n", "s").agg(F.max(F.greatest(k / n - cdf, cdf - (k - c) / n)).alias("d"), F.sum(F.when(F.col("s") > 0, term)).alias("t"))
    return out.select(by, "n", "d", F.when(F.col("s") > 0, -n - F.col("t") / n).alias("a2"))
