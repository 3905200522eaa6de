"""Synchrony and information of binned populations: long tables (unit, bin, n) or dense (unit, bin, x)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _unit_pairs(units: DataFrame, blocks: int = 16) -> DataFrame:
    """Every pair of rows of units(unit, ...) as columns with 1 and 2, joined block by block: as many rows as the matrices here have entries."""
    a = units.select(*(F.col(c).alias(f"{c}1") for c in units.columns)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = units.select(*(F.col(c).alias(f"{c}2") for c in units.columns)).withColumn("_block", F.pmod(F.xxhash64("unit2"), F.lit(blocks)).cast("int"))
    return a.join(b, "_block").drop("_block")


def _correlations(dense: DataFrame, moved: Column, wanted: Column) -> DataFrame:
    """unit1, unit2, r of x over the bins; the second unit's bins under another number.

    Bins in which a unit is 0 add nothing to the sum of products, so only the
    others are joined; the units' own sums do the rest.
    """
    active = dense.filter("x <> 0")
    a = active.select("bin", F.col("unit").alias("unit1"), F.col("x").cast("double").alias("x1"))
    b = active.select(moved.alias("bin"), F.col("unit").alias("unit2"), F.col("x").cast("double").alias("x2"))
    both = a.join(b, "bin").filter(wanted).groupBy("unit1", "unit2").agg(F.sum(F.col("x1") * F.col("x2")).alias("xy"))
    x = F.col("x").cast("double")
    units = dense.groupBy("unit").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    full = _unit_pairs(units).filter(wanted).join(both, ["unit1", "unit2"], "left").withColumn("xy", F.coalesce("xy", F.lit(0.0)))
    spread = lambda k: F.col(f"n{k}") * F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}")
    bottom = F.sqrt(spread(1) * spread(2))
    return full.select("unit1", "unit2", F.when(bottom > 0, (F.col("n1") * F.col("xy") - F.col("s1") * F.col("s2")) / bottom).alias("r"))


def pearson_matrix(dense: DataFrame) -> DataFrame:
    """u1 < u2, r of the units' bins; null where one never changes."""
    return _correlations(dense, F.col("bin"), F.col("unit1") < F.col("unit2")).select(F.col("unit1").alias("u1"), F.col("unit2").alias("u2"), "r")


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation over n pairs, by Student's law with n - 2 degrees: a sum of n / 2 terms, of which those that are too small to count are left out. Null under 3 pairs."""
    size, degrees = F.abs(r.cast("double")), n - 2
    far = 1 - size * size
    odd = degrees % 2 == 1
    # term j is the one before times a ratio below far
    needed = F.when(far <= 0, 0).otherwise(F.ceil((40 - 2 * F.log(F.greatest(size, F.lit(1e-300)))) / -F.log(F.least(far, F.lit(1 - 1e-16)))))
    terms = F.least(F.floor((degrees - F.when(odd, 3).otherwise(2)) / 2), needed)
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * far * F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(F.when(terms >= 1, F.sequence(F.lit(1), terms.cast("int"))).otherwise(F.array().cast("array<int>")), first, step, lambda s: s["sum"])
    by_angle = 2 / F.lit(math.pi) * (F.asin(F.least(size, F.lit(1.0))) + F.when(degrees > 1, size * F.sqrt(F.greatest(far, F.lit(0.0))) * series).otherwise(0.0))
    inside = F.when(odd, by_angle).otherwise(size * series)
    return F.when(degrees >= 1, F.greatest(1 - inside, F.lit(0.0)))


def sync_matrix(dense: DataFrame) -> DataFrame:
    """u1, u2 (other than u1), sync: E[x1 x2] over E[x1] E[x2] of each two units' bins; null where one is never active."""
    active = dense.filter("x <> 0")
    a = active.select("bin", F.col("unit").alias("unit1"), F.col("x").cast("double").alias("x1"))
    b = active.select("bin", F.col("unit").alias("unit2"), F.col("x").cast("double").alias("x2"))
    both = a.join(b, "bin").filter("unit1 <> unit2").groupBy("unit1", "unit2").agg(F.sum(F.col("x1") * F.col("x2")).alias("xy"))
    units = dense.groupBy("unit").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("double")).alias("s"))
    full = _unit_pairs(units).filter("unit1 <> unit2").join(both, ["unit1", "unit2"], "left")
    return full.select(F.col("unit1").alias("u1"), F.col("unit2").alias("u2"), F.try_divide(F.coalesce("xy", F.lit(0.0)) * F.col("n1"), F.col("s1") * F.col("s2")).alias("sync"))


def matrix_synchrony(matrix: DataFrame) -> DataFrame:
    """l2 (root of the mean square) and mean of a synchrony matrix off its diagonal."""
    return matrix.agg(F.sqrt(F.avg(F.col("sync") * F.col("sync"))).alias("l2"), F.avg("sync").alias("mean"))


def over_chance(trials: DataFrame) -> DataFrame:
    """bin, over_chance, covariance: of two binary trains a and b over trials."""
    joint, a, b = F.avg(F.col("a") * F.col("b")), F.avg("a"), F.avg("b")
    return trials.groupBy("bin").agg(F.when(a * b > 0, joint / (a * b)).otherwise(1.0).alias("over_chance"), (joint - a * b).alias("covariance"))


def total_synchrony(dense: DataFrame, base: float = 2.0) -> DataFrame:
    """Null where a denominator is 0: total (E[Z^2] over its value for independent units), variance (root of var Z over the sum of variances) and mgf (E[base^Z] over the product of E[base^x])."""
    z = dense.groupBy("bin").agg(F.sum("x").alias("z")).agg(F.avg(F.col("z") * F.col("z")).alias("z2"), F.var_pop("z").alias("vz"), F.avg(F.pow(F.lit(base), "z")).alias("gz"))
    units = dense.groupBy("unit").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.log(F.avg(F.pow(F.lit(base), "x"))).alias("g"))
    ind = units.agg((F.sum("v") + F.pow(F.sum("m"), F.lit(2))).alias("i2"), F.sum("v").alias("sv"), F.sum("g").alias("sg"), F.count("*").alias("n"))
    return z.join(F.broadcast(ind)).select(F.try_divide("z2", "i2").alias("total"), F.sqrt(F.try_divide("vz", F.col("sv") * F.col("n"))).alias("variance"), (F.col("gz") / F.exp("sg")).alias("mgf"))


MOST_UNITS = 62


def _bit_of(units: Column, unit: Column) -> Column:
    """The bit of a unit among the units in order of name; more than MOST_UNITS fail the job."""
    place = F.array_position(units, unit) - 1
    return F.when(F.size(units) > MOST_UNITS, F.raise_error(F.lit(f"more than {MOST_UNITS} units")).cast("long")).otherwise(place)


def words(dense: DataFrame) -> DataFrame:
    """word, p: how often each joint pattern of active units occurs over the bins. Units are packed as bits, in order of name, MOST_UNITS at most."""
    place = dense.agg(F.array_sort(F.collect_set("unit")).alias("_units"))
    bit = _bit_of(F.col("_units"), F.col("unit")).cast("int")
    packed = dense.join(F.broadcast(place)).groupBy("bin").agg(F.sum(F.when(F.col("x") > 0, F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(F.when(bit < 0, 1).otherwise(0).cast("long"))).alias("word"))
    total = packed.agg(F.count("*").alias("n"))
    return packed.groupBy("word").agg(F.count("*").alias("c")).join(F.broadcast(total)).select("word", (F.col("c") / F.col("n")).alias("p"))


def agreement(p: Column, q: Column) -> Column:
    """The chance that two arrays of probabilities of independent binary events come out equal."""
    return F.aggregate(F.zip_with(p, q, lambda x, y: x * y + (1 - x) * (1 - y)), F.lit(1.0), lambda s, x: s * x)


def word_chances(dense: DataFrame) -> DataFrame:
    """word, p, chance of the words that occur: what the units' own activity would give if they were independent."""
    rates = dense.groupBy("unit").agg(F.avg((F.col("x") > 0).cast("double")).alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "m"))), lambda x: x["m"]).alias("m"))
    active = F.transform("m", lambda m, i: F.call_function("getbit", F.col("word"), i).cast("double"))
    return words(dense).join(F.broadcast(rates)).select("word", "p", agreement(F.col("m"), active).alias("chance"))


def divergence(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence in nats of columns of probabilities; no p, no part."""
    return F.sum(F.when(p > 0, p * F.log(p / q)).otherwise(0.0))


def mutual_information(dense: DataFrame) -> DataFrame:
    """mi: the divergence of the joint distribution of the units' words from that of independent units."""
    return word_chances(dense).agg(divergence(F.col("p"), F.col("chance")).alias("mi"))


def copula_entropy(dense: DataFrame) -> DataFrame:
    """copula: 1 less the entropy of p over chance, normalised, over that of as many equal words as there can be; 0 where units are independent."""
    q = word_chances(dense).withColumn("r", F.col("p") / F.col("chance"))
    total = q.agg(F.sum("r").alias("t"))
    n = dense.select("unit").distinct().agg(F.count("*").alias("units"))
    h = q.join(F.broadcast(total)).agg(entropy(F.col("r") / F.col("t")).alias("h"))
    return h.join(F.broadcast(n)).select((1 - F.col("h") / (F.col("units") * F.log(F.lit(2.0)))).alias("copula"))


def information_on(dense: DataFrame, target: DataFrame) -> DataFrame:
    """mi: 2 (H(X) + H(y) - H(X, y)) / (H(X) + H(y)) of the units' words and a target(bin, x) over the same bins; null if nothing varies."""
    place = dense.agg(F.array_sort(F.collect_set("unit")).alias("_units"))
    bit = _bit_of(F.col("_units"), F.col("unit")).cast("int")
    packed = dense.join(F.broadcast(place)).filter("x > 0").groupBy("bin").agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("word"))
    both = target.join(packed, "bin", "left").select(F.coalesce("word", F.lit(0).cast("long")).alias("word"), (F.col("x") > 0).alias("y"))
    n = both.groupBy("word", "y").agg(F.count("*").alias("c"))
    total = both.agg(F.count("*").alias("n"))

    def h(by: list[str], name: str) -> DataFrame:
        parts = n.groupBy(*by).agg(F.sum("c").alias("c")).join(F.broadcast(total))
        return parts.agg(entropy(F.col("c") / F.col("n")).alias(name))

    mi = F.try_divide(2 * (F.col("hx") + F.col("hy") - F.col("hxy")), F.col("hx") + F.col("hy"))
    return h(["word"], "hx").join(F.broadcast(h(["y"], "hy"))).join(F.broadcast(h(["word", "y"], "hxy"))).select(mi.alias("mi"))


def entropy(p: Column) -> Column:
    """In nats, of a column of probabilities."""
    return -F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))


def total_correlation(dense: DataFrame) -> DataFrame:
    """h (joint entropy), h_units (sum of the units'), total_correlation (their difference) and normalised by its largest value."""
    joint = words(dense).agg(entropy(F.col("p")).alias("h"))
    p = F.avg((F.col("x") > 0).cast("double"))
    each = dense.groupBy("unit").agg(p.alias("p")).select((-F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0) - F.when(F.col("p") < 1, (1 - F.col("p")) * F.log(1 - F.col("p"))).otherwise(0.0)).alias("h1"))
    units = each.agg(F.sum("h1").alias("h_units"), F.max("h1").alias("h_max"))
    tc = F.col("h_units") - F.col("h")
    return joint.join(F.broadcast(units)).select("h", "h_units", tc.alias("total_correlation"), F.try_divide(tc, F.col("h_units") - F.col("h_max")).alias("normalised"))


def lagged_correlation(dense: DataFrame, lag: int, bins: int) -> DataFrame:
    """u1, u2, r of u1's bins with u2's a lag later, around the end of the recording; null where one never changes."""
    return _correlations(dense, F.pmod(F.col("bin") - lag, F.lit(bins)), F.lit(True)).select(F.col("unit1").alias("u1"), F.col("unit2").alias("u2"), "r")
