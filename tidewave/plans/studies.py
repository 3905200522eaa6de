"""Registered queries: clusters, surrogates, rates against time, peaks, excerpts, shapes, graphs.

Embeddings stand for features of spikes: 16 channels of four components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.functions.timeline import HOUR
from tidewave.operators import clusters, connections, correlograms, extraction, peaks, probes, rates, signals, significance, surrogates, trains
from tidewave.operators.waveforms import peak_to_peak
from tidewave.plans.measures import SIGNAL, flat, recording
from tidewave.plans.registry import CLICKS, DAY, HALF, ISI, ORACLES, PREDICTED, RUNS, SPIKES, START, near6, query, r6
from tidewave.sources import units
from tidewave.sources.tables import by_channel, spikes, table

# --- clusters

FEATURES = """f AS (SELECT vec_id AS id, label::BIGINT AS unit, label * 2 + vec_id % 2 AS template, label + s AS channel, [embedding[4 * s + 1]::DOUBLE, embedding[4 * s + 2]::DOUBLE] AS v FROM embeddings, range(0, 16) AS r(s)),
tm AS (SELECT template, channel, avg(v[1]) AS m FROM f GROUP BY ALL), tp AS (SELECT template, arg_max(channel, (m, -channel)) AS peak FROM tm GROUP BY template), pk AS (SELECT unit, floor(quantile_cont(peak, 0.5))::BIGINT AS channel FROM (SELECT DISTINCT unit, template FROM f) JOIN tp USING (template) GROUP BY unit)"""
NEAR = FEATURES + """, nb AS (SELECT c.unit AS centre, u.unit, greatest(c.channel - 2, 0) AS low, least(c.channel + 2, (SELECT max(channel) FROM f)) AS high FROM pk c JOIN pk u ON u.channel BETWEEN c.channel - 2 AND c.channel + 2),
np AS (SELECT centre, id, unit, flatten(list(v ORDER BY channel)) AS x FROM f JOIN nb USING (unit) WHERE channel BETWEEN low AND high GROUP BY centre, id, unit, low, high HAVING count(*) = high - low + 1)"""


def sparse_features(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("s"))
    part = lambda k: F.get("e", 4 * F.col("s") + k)
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("unit"), (F.col("label") * 2 + F.col("vec_id") % 2).alias("template"), (F.col("label") + F.col("s")).cast("long").alias("channel"), F.array(part(0), part(1)).alias("values"))


@query(f"WITH {NEAR} SELECT centre, id, unit, len(x) AS size, round(list_sum(x), 6) AS total, round(list_sum(list_transform(x, lambda y, i: y * i)), 6) AS moment FROM np")
def q_neighbourhood_points(spark, d):
    f = sparse_features(spark, d)
    p = clusters.neighbourhood_points(f, clusters.peak_channels(f), 2)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return p.select("centre", "id", "unit", F.size("features").cast("long").alias("size"), r6(add("features"), "total"), r6(add(F.transform("features", lambda x, i: x * (i + 1))), "moment"))


@query()
def q_neighbourhood_metrics(spark, d):
    return clusters.neighbourhood_metrics(sparse_features(spark, d), half=2, k=3)


@query(f"""WITH {NEAR}, q AS (SELECT np.*, unit = centre AS own FROM np WHERE centre IN (SELECT centre FROM np GROUP BY centre HAVING count(*) FILTER (unit = centre) >= 21 AND count(*) FILTER (unit <> centre) > 0 AND count(*) > 10)),
d AS (SELECT a.centre, a.id, a.own, b.own AS near_own, row_number() OVER (PARTITION BY a.centre, a.id ORDER BY list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.id) AS r FROM q a JOIN q b ON a.centre = b.centre AND a.id <> b.id)
SELECT centre AS unit, round(avg(near_own::INT) FILTER (own), 6) AS hit, round(avg(near_own::INT) FILTER (NOT own), 6) AS miss FROM d WHERE r <= 3 GROUP BY centre""")
def q_neighbourhood_hits(spark, d):
    from tidewave.operators.quality import neighbours_in

    p = clusters.centred_points(sparse_features(spark, d), 2, 21)
    spaced = p.select(F.col("centre").alias("space"), "id", F.col("own").cast("int").alias("label"), "features")
    rates_of = clusters.neighbour_shares(neighbours_in(spaced, spaced, 3))
    return rates_of.select(F.col("space").alias("unit"), r6("hit", "hit"), r6("miss", "miss"))


SILHOUETTES = """p AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT label, count(*) AS n FROM p GROUP BY label),
t AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS total FROM p a JOIN p b ON true GROUP BY ALL),
o AS (SELECT id, total / (n - 1) AS a FROM t JOIN n USING (label) WHERE label = other AND n > 1), c AS (SELECT t.id, t.label, other, total / n.n AS b FROM t JOIN n ON n.label = t.other WHERE t.label <> other),
si AS (SELECT least(label, other) AS l1, greatest(label, other) AS l2, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM c LEFT JOIN o USING (id) GROUP BY ALL HAVING count(*) > 2)"""


def labelled_points(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))


@query(f"WITH {SILHOUETTES} SELECT l1, l2, round(s, 6) AS silhouette FROM si")
def q_silhouettes(spark, d):
    return clusters.silhouettes(labelled_points(spark, d), most=None).select("l1", "l2", r6("silhouette", "silhouette"))


@query(f"WITH {SILHOUETTES} SELECT label, round(min(s), 6) AS silhouette FROM (SELECT l1 AS label, s FROM si UNION ALL SELECT l2, s FROM si) GROUP BY label")
def q_least_silhouettes(spark, d):
    return clusters.least_silhouettes(clusters.silhouettes(labelled_points(spark, d), most=None)).select("label", r6("silhouette", "silhouette"))


# --- rates over time

STABLE = f"""{SPIKES}, b AS (SELECT unit, (t - {START}) // {6 * HOUR} AS bin, count(*) AS n FROM s GROUP BY ALL), g AS (SELECT unit, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT unit FROM s) CROSS JOIN (SELECT unnest(range(0, 120)) AS bin) LEFT JOIN b USING (unit, bin)),
k AS (SELECT o, exp(-0.5 * (o / 3.0::DOUBLE) ^ 2) AS w FROM range(-12, 13) AS r(o)), sm AS (SELECT a.unit, a.bin, sum(b.n * w) / (SELECT sum(w) FROM k) AS x FROM g a CROSS JOIN k JOIN g b ON b.unit = a.unit AND b.bin = CASE WHEN a.bin + o < 0 THEN -(a.bin + o) - 1 WHEN a.bin + o >= 120 THEN 239 - (a.bin + o) ELSE a.bin + o END GROUP BY ALL),
lv AS (SELECT unnest({rates.stability_levels()!r}::DOUBLE[]) AS share, unnest(range(0, {len(rates.stability_levels())})) AS level), m AS (SELECT unit, avg(n) AS m FROM g GROUP BY unit), fl AS (SELECT unit, level, bin, x, bin - row_number() OVER (PARTITION BY unit, level ORDER BY bin) AS run FROM sm JOIN m USING (unit) JOIN lv ON x >= m * share),
ru AS (SELECT unit, level, run, min(bin) AS first, max(bin) AS last FROM fl GROUP BY ALL), rd AS (SELECT ru.*, (last - first) * {6 * HOUR} AS size, (SELECT stddev_pop(x) FROM sm WHERE sm.unit = ru.unit AND bin >= first AND bin < last) AS sd FROM ru),
tg AS (SELECT unit, coalesce(min(level) FILTER (size > {3 * DAY}), {len(rates.stability_levels()) - 1}) AS level, CASE WHEN max(size) > {3 * DAY} THEN {3 * DAY} ELSE {3 * DAY} - 2 * (({3 * DAY} - max(size) FILTER (level = {len(rates.stability_levels()) - 1})) // 2 + 1) END AS target FROM rd GROUP BY unit)"""


@query(f"WITH {STABLE} SELECT unit, first * {6 * HOUR} AS start, first * {6 * HOUR} + target AS stop, level FROM rd JOIN tg USING (unit, level) WHERE size > target AND target > 1 QUALIFY row_number() OVER (PARTITION BY unit ORDER BY round(sd, 12), first) = 1")
def q_stable_periods(spark, d):
    s = spikes(spark, d).withColumn("t", F.col("t") - START)
    out = rates.stable_periods(s, 6 * HOUR, 30 * DAY, 3.0, 3 * DAY)
    return out.select("unit", "start", "stop", F.col("level").cast("long").alias("level"))


CUBE_WIDTH, CUBE_HALF, CUBE_LEVELS = 6 * HOUR, 3, 4


def rate_cube_sql(rate: str) -> str:
    """The cube over pairs of units of numbers k, k and k, k + 1; rate: CTE rt(unit, u1, id, t, rate)."""
    return f"""{SPIKES}, z AS (SELECT unit, id, t // {CUBE_WIDTH} AS t FROM s), o AS (SELECT DISTINCT unit, t FROM z), pr AS (SELECT u1, u2 FROM (SELECT DISTINCT unit AS u1, unit AS u2 FROM s UNION SELECT DISTINCT unit, unit + 1 FROM s) WHERE u2 IN (SELECT unit FROM s)),
nr AS (SELECT unit, t, lag(t) OVER w AS p, lead(t) OVER w AS n FROM o WINDOW w AS (PARTITION BY unit ORDER BY t)), st AS (SELECT unit, p + (t - p) // 2 AS start, t + (n - t) // 2 AS stop, 1.0::DOUBLE / (t + (n - t) // 2 - p - (t - p) // 2) AS rate FROM nr WHERE p IS NOT NULL AND n IS NOT NULL),
rf AS (SELECT u1, u2 AS unit, id, t FROM z JOIN pr ON z.unit = pr.u1), rt AS ({rate}),
eg AS (SELECT unit, u1, quantile_cont(rate, [{', '.join(f'{(i + 1) / (CUBE_LEVELS + 1)!r}' for i in range(CUBE_LEVELS))}]) AS e FROM rt GROUP BY ALL), en AS (SELECT unit, min(t) AS a, max(t) AS b FROM o GROUP BY unit),
us AS (SELECT unit, u1, id, t, least(len(list_filter(e, lambda x: x < rate)), {CUBE_LEVELS - 1}) AS level FROM rt JOIN eg USING (unit, u1) JOIN en USING (unit) WHERE t >= a AND t < b AND t - {CUBE_HALF} >= 0 AND t + {CUBE_HALF} < (SELECT max(t) FROM o)),
ct AS (SELECT us.unit, u1, level, o.t - us.t AS bin, count(*) AS n FROM us JOIN o ON o.unit = us.unit AND o.t BETWEEN us.t - {CUBE_HALF} AND us.t + {CUBE_HALF} GROUP BY ALL), sp AS (SELECT unit, u1, level, count(*) AS spikes FROM us GROUP BY ALL),
cb AS (SELECT u1, pr.u2, level, bin FROM pr, range(0, {CUBE_LEVELS}) AS a(level), range(-{CUBE_HALF}, {CUBE_HALF + 1}) AS b(bin))
SELECT cb.u1, cb.u2, cb.level, cb.bin, round(CASE WHEN cb.u1 = cb.u2 AND cb.bin = 0 THEN 0 ELSE coalesce(n / spikes::DOUBLE, 0) END, 6) AS p FROM cb LEFT JOIN sp ON sp.unit = cb.u2 AND sp.u1 = cb.u1 AND sp.level = cb.level LEFT JOIN ct ON ct.unit = cb.u2 AND ct.u1 = cb.u1 AND ct.level = cb.level AND ct.bin = cb.bin"""


def neighbouring_units(s: DataFrame) -> DataFrame:
    u = s.select("unit").distinct()
    pairs = u.select(F.col("unit").alias("u1"), F.explode(F.array(F.col("unit"), F.col("unit") + 1)).alias("u2"))
    return pairs.join(u.withColumnRenamed("unit", "u2"), "u2", "left_semi").select("u1", "u2")


@query(f"WITH {rate_cube_sql('SELECT rf.unit, u1, id, rf.t, coalesce(max(rate), 0) AS rate FROM rf LEFT JOIN st ON st.unit = rf.unit AND rf.t >= st.start AND rf.t < st.stop GROUP BY ALL')}")
def q_correlogram_by_rate(spark, d):
    s = spikes(spark, d)
    return rates.correlogram_by_rate(s, neighbouring_units(s), CUBE_WIDTH, CUBE_HALF, CUBE_LEVELS).select("u1", "u2", "level", "bin", r6("p", "p"))


@query(f"WITH {rate_cube_sql('SELECT rf.unit, u1, id, rf.t, round(coalesce(sum(greatest(least(st.stop, rf.t + 10) - greatest(st.start, rf.t - 10), 0) * rate), 0) / 20.0::DOUBLE, 12) AS rate FROM rf LEFT JOIN st ON st.unit = rf.unit AND st.start < rf.t + 10 AND st.stop > rf.t - 10 GROUP BY ALL')}")
def q_correlogram_by_smooth_rate(spark, d):
    s = spikes(spark, d)
    return rates.correlogram_by_rate(s, neighbouring_units(s), CUBE_WIDTH, CUBE_HALF, CUBE_LEVELS, smooth=20).select("u1", "u2", "level", "bin", r6("p", "p"))


# --- surrogates

UNIFORM = "(('0x' || substr(md5({}), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE"
JITTERED = f"""{CLICKS}, jn AS (SELECT unit, id, t, t - lag(t) OVER w AS b, lead(t) OVER w - t AS a FROM c WINDOW w AS (PARTITION BY unit ORDER BY t, id)),
j AS (SELECT unit, id, draw, CASE WHEN a IS NULL OR b IS NULL THEN t ELSE t - b + floor({UNIFORM.format("unit || ':' || id || ':' || draw || ':7'")} * (a + b))::BIGINT END AS t FROM jn, range(0, 3) AS r(draw))"""
SIGNED = """SELECT a.unit AS u1, b.unit AS u2, {more} a.id AS i1, CASE WHEN b.t >= a.t THEN (b.t - a.t) // {w} ELSE -((a.t - b.t) // {w}) END AS bin, b.t >= a.t AS later FROM {left} a JOIN c b ON a.unit <> b.unit AND b.t > a.t - {r} AND b.t < a.t + {r}"""
HERTZ = f"""pa AS ({SIGNED.format(more='', left='c', w=HOUR, r=4 * HOUR)}), n1 AS (SELECT u1, u2, count(DISTINCT i1) AS spikes FROM pa GROUP BY ALL), hz AS (SELECT u1, u2, bin, max(n) AS n FROM (SELECT u1, u2, bin, later, count(*) AS n FROM pa GROUP BY ALL) GROUP BY ALL)"""


@query(f"WITH {JITTERED} SELECT * FROM j")
def q_jittered(spark, d):
    return surrogates.jittered(spikes(spark, d, "click"), 3, seed=7).select("unit", "id", F.col("draw").cast("long").alias("draw"), "t")


@query(f"WITH {CLICKS}, {HERTZ} SELECT u1, u2, bin, n, spikes, round(n / (spikes * 3600.0::DOUBLE) * 1000, 6) AS millihertz FROM hz JOIN n1 USING (u1, u2)")
def q_overlapping_hertz(spark, d):
    h = surrogates.overlapping_hertz(spikes(spark, d, "click"), HOUR, 3, 1_000_000.0)
    return h.select("u1", "u2", "bin", "n", "spikes", near6(F.col("hertz") * 1000, "millihertz"))


@query(f"""WITH {JITTERED}, {HERTZ}, ja AS ({SIGNED.format(more='draw,', left='j', w=HOUR, r=4 * HOUR)}), ex AS (SELECT u1, u2, bin, sum(n) / 3.0::DOUBLE AS expected FROM (SELECT u1, u2, draw, bin, max(n) AS n FROM (SELECT u1, u2, draw, bin, later, count(*) AS n FROM ja GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
f AS (SELECT u1, u2, bin, spikes, coalesce(n, 0) AS n, coalesce(expected, 0) AS e FROM n1 CROSS JOIN (SELECT unnest(range(-3, 4)) AS bin) LEFT JOIN hz USING (u1, u2, bin) LEFT JOIN ex USING (u1, u2, bin)), q AS (SELECT *, least(floor(e) / spikes, 1.0::DOUBLE) AS p FROM f),
b AS (SELECT *, 1.959963984540054::DOUBLE * sqrt(p * (1 - p) / spikes) AS sd FROM q) SELECT u1, u2, bin, round(n / spikes::DOUBLE - e / spikes, 6) AS excess, round(greatest(p - sd, 0) - e / spikes, 6) AS low, round(least(p + sd, 1) - e / spikes, 6) AS high FROM b""")
def q_against_jitter(spark, d):
    j = surrogates.against_jitter(spikes(spark, d, "click"), HOUR, 3, 3, seed=7)
    return j.select("u1", "u2", "bin", near6("excess", "excess"), near6("low", "low"), near6("high", "high"))


@query(f"""WITH {SPIKES}, n AS (SELECT unit, (t - {START}) // {DAY} AS trial, ((t - {START}) // {6 * HOUR}) % 4 AS bin, count(*) AS n FROM s GROUP BY ALL), g AS (SELECT unit, trial, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT unit FROM s) CROSS JOIN (SELECT unnest(range(0, 30)) AS trial) CROSS JOIN (SELECT unnest(range(0, 4)) AS bin) LEFT JOIN n USING (unit, trial, bin)),
a AS (SELECT *, sum(n) OVER (PARTITION BY unit, trial) > 0 AS active FROM g), m AS (SELECT unit, bin, avg(n) AS m FROM a WHERE active GROUP BY ALL), cd AS (SELECT unit, bin, k, sum(exp(-m + k * ln(m) - lgamma(k + 1.0::DOUBLE))) OVER (PARTITION BY unit, bin ORDER BY k) AS cdf FROM m, range(0, 40) AS r(k) WHERE m > 0),
u AS (SELECT unit, trial, bin, {UNIFORM.format("unit || ':' || trial || ':' || bin || ':5'")} AS u, n, active FROM a) SELECT u.unit, u.trial, u.bin, CASE WHEN active AND coalesce(m, 0) > 0 THEN (SELECT count(*) FROM cd WHERE cd.unit = u.unit AND cd.bin = u.bin AND cd.cdf < u.u) ELSE n END AS n FROM u LEFT JOIN m USING (unit, bin)""")
def q_poisson_trials(spark, d):
    s = spikes(spark, d).withColumn("q", F.floor((F.col("t") - START) / (6 * HOUR)))
    n = s.groupBy("unit", F.floor(F.col("q") / 4).alias("trial"), (F.col("q") % 4).alias("bin")).agg(F.count("*").alias("n"))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    grid = s.select("unit").distinct().withColumn("trial", every(30)).withColumn("bin", every(4))
    dense = grid.join(n, ["unit", "trial", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return surrogates.poisson_trials(dense, seed=5)


# --- modulations, edges

MODULATIONS = f"""{CLICKS}, {RUNS}, fe AS (SELECT u1, u2, min(bin)::DOUBLE AS l, max(bin) + 1.0::DOUBLE AS r, arg_max(z, (abs(z), -bin)) AS amplitude, arg_max(bin, (abs(z), -bin))::DOUBLE AS peak_at, count(*) // 3 AS triplets, count(*) AS crossing, avg(z) AS height, avg(0.5 * z * z + 0.5 * ln(2 * pi())) AS entropy
FROM i WHERE side <> 0 GROUP BY u1, u2, run HAVING count(*) >= 2 AND min(bin) > {-HALF} AND max(bin) < {HALF})"""
EDGES = MODULATIONS + ", ed AS (SELECT CASE WHEN peak_at > 0 THEN u1 ELSE u2 END AS source, CASE WHEN peak_at > 0 THEN u2 ELSE u1 END AS target, abs(peak_at) AS lag, amplitude FROM fe WHERE u1 > u2)"


def normal_modulations(spark, d) -> DataFrame:
    return connections.normal_modulations(spikes(spark, d, "click"), HOUR, HALF, 1.5, 1.0, 2)


def main_edges(spark, d) -> DataFrame:
    return connections.normal_edges(spikes(spark, d, "click"), HOUR, HALF, 1.5, 1.0, 2, main=True)


@query(f"WITH {MODULATIONS} SELECT u1, u2, l AS \"left\", r AS \"right\", round(amplitude, 6) AS amplitude, peak_at, triplets, crossing, round(height, 6) AS height, round(entropy, 6) AS entropy FROM fe")
def q_modulation_features(spark, d):
    return normal_modulations(spark, d).select("u1", "u2", "left", "right", near6("amplitude", "amplitude"), F.col("at").alias("peak_at"), "triplets", "crossing", near6("height", "height"), near6("entropy", "entropy"))


@query(f"WITH {EDGES} SELECT source, target, lag, round(amplitude, 6) AS amplitude FROM ed WHERE amplitude > 0 AND lag BETWEEN 1 AND 8")
def q_connection_edges(spark, d):
    return connections.normal_edges(spikes(spark, d, "click"), HOUR, HALF, 1.5, 1.0, 2, sign=1, low=1.0, high=8.0).select("source", "target", "lag", near6("amplitude", "amplitude"))


MAIN = EDGES + ", mn AS (SELECT * FROM ed QUALIFY row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY abs(amplitude) DESC, lag, source, amplitude) = 1)"


@query(f"WITH {MAIN} SELECT source, target, lag, round(amplitude, 6) AS amplitude FROM mn")
def q_main_edges(spark, d):
    return main_edges(spark, d).select("source", "target", "lag", near6("amplitude", "amplitude"))


@query(f"WITH {MAIN}, x AS (SELECT source AS unit, 1 AS o, abs(amplitude) AS a FROM mn UNION ALL SELECT target, 0, abs(amplitude) FROM mn) SELECT unit, sum(o)::BIGINT AS n_out, sum(1 - o)::BIGINT AS n_in, round(sum(a), 6) AS strength FROM x GROUP BY unit")
def q_unit_degrees(spark, d):
    g = connections.degrees(main_edges(spark, d))
    return g.select("unit", "n_out", "n_in", r6("strength", "strength"))


@query(f"""WITH {CLICKS}, {PREDICTED}, pt AS (SELECT u1, u2, bin, n, expected, CASE WHEN expected > 0 THEN 1 - coalesce((SELECT sum(exp(i * ln(expected) - expected - lgamma(i + 1))) FROM range(0, 60) AS r(i) WHERE i < n), 0) - 0.5 * exp(n * ln(expected) - expected - lgamma(n + 1)) WHEN n > 0 THEN 0 ELSE 1 END AS p, CASE WHEN expected > 0 THEN (n - expected) / sqrt(expected) END AS dev FROM x),
sd AS (SELECT *, CASE WHEN p < 0.2 THEN 1 WHEN 1 - p < 0.2 THEN -1 ELSE 0 END AS side FROM pt), ch AS (SELECT *, CASE WHEN side <> lag(side) OVER (PARTITION BY u1, u2 ORDER BY bin) THEN 1 ELSE 0 END AS c FROM sd), ru AS (SELECT *, sum(c) OVER (PARTITION BY u1, u2 ORDER BY bin) AS run FROM ch)
SELECT u1, u2, side, min(bin) AS first, max(bin) AS last, count(*) AS n, round(arg_max(dev, abs(dev)), 6) AS deviation FROM ru WHERE side <> 0 GROUP BY u1, u2, side, run HAVING count(*) >= 2 AND min(bin) > {-HALF} AND max(bin) < {HALF}""")
def q_poisson_modulations(spark, d):
    m = significance.poisson_runs(spikes(spark, d, "click"), HOUR, HALF, 4, 0.2, 2)
    return m.select("u1", "u2", "side", "first", "last", "n", near6("deviation", "deviation"))


# --- bursts, temporal features

CURVES = f"""{ISI}, pq AS (SELECT unit, quantile_cont(isi, 0.98) AS cap FROM i WHERE isi >= {HOUR} GROUP BY unit), mf AS (SELECT unit, 3.6e9 / avg(isi) AS mfr FROM i JOIN pq USING (unit) WHERE isi BETWEEN {HOUR} AND cap GROUP BY unit),
ac AS (SELECT a.unit, (b.t - a.t) // {HOUR} AS bin, count(*) AS n FROM s a JOIN s b ON a.unit = b.unit AND b.t - a.t < {61 * HOUR} AND (b.t > a.t OR (b.t = a.t AND b.id > a.id)) GROUP BY ALL), ag AS (SELECT t.unit, mfr, g.bin, CASE WHEN g.bin = 0 THEN 0 ELSE coalesce(ac.n / t.n::DOUBLE, 0) END AS h FROM (SELECT unit, count(*) AS n FROM s GROUP BY unit) t JOIN mf USING (unit) CROSS JOIN (SELECT unnest(range(0, 61)) AS bin) g LEFT JOIN ac ON ac.unit = t.unit AND ac.bin = g.bin),
sg AS (SELECT unit, stddev_pop(h) / 10 AS sd FROM ag GROUP BY unit), kw AS (SELECT unit, o, exp(-0.5 * (o / sd) ^ 2) AS w FROM sg JOIN range(-40, 41) AS r(o) ON abs(o) <= floor(4 * sd + 0.5) AND floor(4 * sd + 0.5) > 0 UNION ALL SELECT unit, 0, 1.0 FROM sg WHERE floor(4 * sd + 0.5) = 0),
sc AS (SELECT a.unit, a.mfr, a.bin, sum(b.h * w) / sum(w) AS h FROM ag a JOIN kw USING (unit) JOIN ag b ON b.unit = a.unit AND b.bin = CASE WHEN a.bin + o < 0 THEN -(a.bin + o) - 1 WHEN a.bin + o >= 61 THEN 121 - (a.bin + o) ELSE a.bin + o END GROUP BY ALL)"""


def curves(spark, d) -> DataFrame:
    return rates.autocorrelogram_curves(spikes(spark, d), HOUR, 60, float(HOUR), floor=HOUR)


@query(f"WITH {CURVES} SELECT unit, bin AS lag, round(h, 6) AS hertz, round(mfr, 6) AS mfr FROM ag")
def q_autocorrelogram_curves(spark, d):
    return curves(spark, d).select("unit", F.posexplode("acg").alias("lag", "h"), "mfr").select("unit", F.col("lag").cast("long").alias("lag"), r6("h", "hertz"), r6("mfr", "mfr"))


@query(f"WITH {CURVES} SELECT unit, round(max(h) / any_value(mfr), 6) AS burst FROM sc WHERE bin < 20 AND mfr > 0 GROUP BY unit")
def q_burst_ratio(spark, d):
    return peaks.bursts_and_oscillations(curves(spark, d), 20).select("unit", r6("burst", "burst"))


@query()
def q_oscillation_ratio(spark, d):
    return peaks.bursts_and_oscillations(curves(spark, d), 5).select("unit", r6("oscillation", "oscillation"))


TEMPORAL = ["mfr", "mifr", "median", "prct5", "cv", "lcv", "sd", "cv2_mean", "cv2_median", "ir", "lv", "lvr", "si", "skew", "burst_index", "entropy", "burst"]


@query(f"SELECT * FROM ({ORACLES['q_interval_features']}) JOIN ({ORACLES['q_isi_features']}) USING (unit) JOIN ({ORACLES['q_log_isi_entropy']}) USING (unit) JOIN ({ORACLES['q_burst_ratio']}) USING (unit)")
def q_temporal_features(spark, d):
    f = rates.temporal_features(spikes(spark, d), float(HOUR), HOUR, 60, 20, floor=HOUR)
    return f.select("unit", *(r6(c, c) for c in TEMPORAL))


@query()
def q_wave_peaks(spark, d):
    return peaks.find_peaks(table(spark, d, "embeddings").select(F.col("vec_id").alias("unit"), F.col("embedding").cast("array<double>").alias("wave")), "spline", delta=0.5)


# --- subsets of spikes

@query(f"WITH {SPIKES}, k AS (SELECT unit, id, row_number() OVER (PARTITION BY unit ORDER BY t, id) - 1 AS k, count(*) OVER (PARTITION BY unit) AS n FROM s), p AS (SELECT *, greatest((n + 19) // 20, 1) AS step, greatest((n - 5) // 3, 5) AS apart FROM k) SELECT unit, id FROM p WHERE CASE WHEN n <= 20 THEN k % step = 0 AND k // step < 20 ELSE k // apart < 4 AND k % apart < 5 END")
def q_batched_subset(spark, d):
    return trains.batched_subset(spikes(spark, d), 20, 5).select("unit", "id")


@query(f"WITH {SPIKES} SELECT unit, id FROM s QUALIFY row_number() OVER (PARTITION BY unit ORDER BY md5(unit || ':' || id || ':3')[1:12], id) <= 15")
def q_random_subset(spark, d):
    return trains.random_subset(spikes(spark, d), 15, seed=3).select("unit", "id")


@query(f"WITH {SPIKES} SELECT unit, e AS template, round(count(*) / sum(count(*)) OVER (PARTITION BY unit), 6) AS share FROM s GROUP BY unit, e")
def q_template_shares(spark, d):
    return extraction.templates_of(spikes(spark, d).select("unit", F.col("e").alias("template"))).select("unit", "template", r6("share", "share"))


@query(f"WITH {SIGNAL}, w AS (SELECT vec_id % 8 AS unit, k, avg(x) AS m FROM v GROUP BY ALL), nz AS (SELECT vec_id % 8 AS unit, stddev_pop(x) AS sd FROM v GROUP BY ALL) SELECT unit, round((max(m) - min(m)) / (2 * any_value(sd)), 6) AS snr, round(20 * log10((max(m) - min(m)) / (2 * any_value(sd))), 6) AS snr_db FROM w JOIN nz USING (unit) GROUP BY unit")
def q_noise_ratio(spark, d):
    w = table(spark, d, "embeddings").select((F.col("vec_id") % 8).alias("unit"), F.col("embedding").cast("array<double>").alias("wave"))
    return extraction.noise_ratio(w, w.select("unit", F.explode("wave").alias("v"))).select("unit", r6("snr", "snr"), r6("snr_db", "snr_db"))


# --- signals

TAPS = np.hanning(21)
ALONG = signals.along_probe_matrix(4, 2)
GAIN = f"""{SIGNAL}, w AS (SELECT unnest(range(-10, 11)) AS o, unnest([{', '.join(f'{x!r}::DOUBLE' for x in (TAPS / TAPS.sum()).tolist())}]) AS w), lv AS (SELECT a.channel, a.t, a.x, sum(abs(b.x) * w) AS l FROM g a CROSS JOIN w JOIN g b ON b.channel = a.channel AND b.t = a.t - o GROUP BY ALL),
gc AS (SELECT channel, t, x, l + sum(l) OVER (PARTITION BY channel) * 1e-8 / count(*) OVER (PARTITION BY channel) AS l FROM lv)"""


@query(f"WITH {GAIN} SELECT channel, t, round(x / l, 6) AS x FROM gc")
def q_gain_controlled(spark, d):
    return flat(signals.gain_controlled(recording(spark, d), 20))


@query(f"WITH {GAIN}, mx AS (SELECT unnest(range(0, 16)) // 4 AS c1, unnest(range(0, 16)) % 4 AS c2, unnest([{', '.join(f'{x!r}::DOUBLE' for x in ALONG.ravel().tolist())}]) AS m), y AS (SELECT c1 AS channel, t, sum(m * x / l) AS x FROM mx JOIN gc ON gc.channel = c2 GROUP BY ALL) SELECT channel, t, round(y.x * l, 6) AS x FROM y JOIN gc USING (channel, t)")
def q_filtered_along_probe(spark, d):
    return flat(signals.filtered_along_probe(recording(spark, d), ALONG, 20))


@query(f"WITH {SIGNAL} SELECT channel, t, round(x - quantile_cont(x, 0.5) OVER (PARTITION BY t), 6) AS x FROM g")
def q_common_average_in_frames(spark, d):
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("embedding").cast("array<double>").alias("samples"))
    return flat(by_channel(signals.common_average_removed(chunks, 4), 4))


# --- probes: rows of the embeddings as waves of eight channels, in hundreds

PROBE = "wv AS (SELECT vec_id // 8 AS unit, vec_id % 8 AS channel, list_transform(embedding::DOUBLE[], lambda x: x * 100) AS w FROM embeddings), pp AS (SELECT unit, channel, list_max(w) - list_min(w) AS ptp FROM wv), pk AS (SELECT unit, arg_max(channel, (ptp, -channel)) AS channel, max(ptp) AS ptp FROM pp GROUP BY unit), ps AS (SELECT DISTINCT vec_id % 8 AS channel, (vec_id % 2) * 32.0::DOUBLE AS x, (vec_id % 8) // 2 * 20.0::DOUBLE AS y FROM embeddings)"


def probe_waves(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    waves = e.select(F.floor(F.col("vec_id") / 8).alias("unit"), (F.col("vec_id") % 8).alias("channel"), F.transform("embedding", lambda x: x.cast("double") * 100).alias("wave"))
    channel = F.col("channel")
    return waves, waves.select("channel").distinct().select("channel", (channel % 2 * 32.0).alias("x"), (F.floor(channel / 2) * 20.0).alias("y"))


@query(f"WITH {PROBE} SELECT k.unit, k.channel, b.channel AS near, round(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2), 6) AS distance FROM pk k JOIN ps a USING (channel) JOIN ps b ON b.channel <> k.channel AND sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) < 45")
def q_channels_within(spark, d):
    waves, positions = probe_waves(spark, d)
    return probes.channels_within(probes.peak_places(waves, positions), positions, 45.0).select("unit", "channel", "near", r6("distance", "distance"))


@query(f"WITH {PROBE} SELECT k.unit, round(avg(pp.ptp) / any_value(k.ptp), 6) AS spread FROM pk k JOIN ps a USING (channel) LEFT JOIN ps b ON b.channel <> k.channel AND sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) < 45 LEFT JOIN pp ON pp.unit = k.unit AND pp.channel = b.channel GROUP BY k.unit")
def q_spread_ratio(spark, d):
    waves, positions = probe_waves(spark, d)
    return probes.spread_ratio(waves, positions, 45.0).select("unit", r6("spread", "spread"))


@query(f"WITH {PROBE} SELECT pp.unit, pp.channel, round(pp.ptp, 6) AS ptp FROM pp JOIN pk USING (unit) WHERE abs(pp.channel - pk.channel) <= 3 AND pp.ptp > 55")
def q_loud_channels(spark, d):
    w = probes.loud_channels(probe_waves(spark, d)[0], 3, 55.0)
    return w.select("unit", "channel", r6(peak_to_peak(F.col("wave")), "ptp"))


@query(f"WITH {PROBE}, sl AS (SELECT unit, slot, channel - 2 + slot AS channel FROM pk, range(0, 5) AS r(slot)) SELECT unit, slot, sl.channel, round(list_sum(w), 6) AS total FROM sl LEFT JOIN wv USING (unit, channel)")
def q_cropped_waves(spark, d):
    w = probes.cropped(probe_waves(spark, d)[0], 5)
    return w.select("unit", F.col("slot").cast("long").alias("slot"), "channel", r6(F.aggregate("wave", F.lit(0.0), lambda s, x: s + x), "total"))


@query()
def q_spatial_features(spark, d):
    waves, positions = probe_waves(spark, d)
    return probes.spatial_features(waves, positions, 3, 30.0, 45.0)


@query()
def q_model_arrays(spark, d):
    return probes.model_arrays(probe_waves(spark, d)[0], 20_000.0, channels=5)


# --- all measures of quality, by period

EPOCHS = [(START, START + 12 * DAY), (START + 12 * DAY, START + 30 * DAY)]


def _epoch_sql(number: int, start: int, stop: int) -> str:
    def of(name: str) -> str:
        return ORACLES[name].replace("FROM events)", f"FROM events WHERE epoch_us(ts) > {start} AND epoch_us(ts) <= {stop})")

    width = (stop - start) / 99
    presence = f"SELECT unit, count(DISTINCT least(floor((epoch_us(ts) - {start}) / {width!r}::DOUBLE), 98)) / 100.0::DOUBLE AS presence FROM (SELECT user_id AS unit, ts FROM events) WHERE epoch_us(ts) > {start} AND epoch_us(ts) <= {stop} GROUP BY unit"
    return f"""SELECT {number} AS period, unit, rate, round(presence, 6) AS presence, n_violations, fp_rate, missing FROM (SELECT DISTINCT user_id AS unit FROM events)
LEFT JOIN ({of('q_firing_rate')}) USING (unit) LEFT JOIN ({presence}) USING (unit) LEFT JOIN ({of('q_isi_violations')}) USING (unit) LEFT JOIN ({of('q_amplitude_cutoff')}) USING (unit)"""


@query(" UNION ALL ".join(_epoch_sql(k, a, b) for k, (a, b) in enumerate(EPOCHS)))
def q_quality_table(spark, d):
    t = clusters.quality_table(spikes(spark, d), EPOCHS, 1_000_000.0, 2 * HOUR, HOUR // 60)
    return t.select("period", "unit", r6(F.col("rate") * 1000, "rate"), r6("presence", "presence"), "n_violations", r6("fp_rate", "fp_rate"), r6("missing", "missing"))


@query()
def q_quality_table_with_features(spark, d):
    f = sparse_features(spark, d)
    e = f.select("unit", "id", (F.col("id") * 1000).alias("t"), F.get("values", F.lit(0)).alias("a")).dropDuplicates(["id"])
    return clusters.quality_table(e, [(-1, 1 << 40)], 1_000_000.0, 2_000, 10, f)


@query(f"WITH {SPIKES} SELECT unit % 3 AS dataset, round(max(t) / 1e6 - {START // 1_000_000}, 6) AS seconds FROM s GROUP BY ALL")
def q_recording_length(spark, d):
    s = spikes(spark, d).withColumn("dataset", F.col("unit") % 3)
    return units.recording_length(s, 1_000_000.0).select("dataset", r6(F.col("length") - START // 1_000_000, "seconds"))
