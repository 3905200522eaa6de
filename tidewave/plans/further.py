"""Registered queries: laws of values, decompositions, noise, population synchrony, merged sets and the neuron store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.functions.timeline import HOUR
from tidewave.operators import alignment, distributions, extraction, linear, neighbours, rates, signals, trains
from tidewave.plans.measures import SIGNAL, recording, spike_places
from tidewave.plans.registry import DAY, ORACLES, SPIKES, START, query, r6
from tidewave.sources import merged, store, units
from tidewave.sources.tables import spikes, table

# --- laws

MOMENTS = "m AS (SELECT unit, avg(a) AS m FROM s GROUP BY unit), q AS (SELECT unit, count(*)::DOUBLE AS n, avg((a - m) ^ 2) AS m2, avg((a - m) ^ 3) AS m3, avg((a - m) ^ 4) AS m4 FROM s JOIN m USING (unit) GROUP BY unit)"


@query(f"""WITH {SPIKES}, {MOMENTS}, z AS (SELECT unit, n,
  m3 / m2 ^ 1.5 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n ^ 2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w,
  (m4 / m2 ^ 2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ^ 2 * (n + 3) * (n + 5))) AS x, 6 * (n ^ 2 - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b FROM q WHERE n >= 8 AND m2 > 0),
k AS (SELECT unit, asinh(y / sqrt(2 / (w - 1))) / sqrt(0.5::DOUBLE * ln(w)) AS z1, x, 6 + 8 / b * (2 / b + sqrt(1 + 4 / b ^ 2)) AS g FROM z),
t AS (SELECT unit, z1, g, 1 + x * sqrt(2 / (g - 4)) AS u FROM k), r AS (SELECT unit, z1 ^ 2 + ((1 - 2 / (9 * g) - sign(u) * cbrt((1 - 2 / g) / abs(u))) / sqrt(2 / (9 * g))) ^ 2 AS k2 FROM t)
SELECT q.unit, n::BIGINT AS n, round(k2, 6) AS k2, round(exp(-k2 / 2), 6) AS p FROM q LEFT JOIN r USING (unit)""")
def q_skewness_and_tails(spark, d):
    return distributions.skewness_and_tails(spikes(spark, d), "a").select("unit", "n", r6("k2", "k2"), r6("p", "p"))


@query()
def q_distance_from_normal(spark, d):
    return distributions.distance_from_normal(spikes(spark, d).withColumn("z", (F.col("a") - 50) / 25), "z")


@query(f"""WITH {SPIKES}, b AS (SELECT unit, (t - {START}) // {DAY} AS bin, count(*) AS n FROM s GROUP BY ALL), g AS (SELECT unit, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT unit FROM s) CROSS JOIN range(0, 30) AS r(bin) LEFT JOIN b USING (unit, bin)), m AS (SELECT unit, avg(n) AS m, stddev_pop(n) AS sd FROM g GROUP BY unit),
c AS (SELECT unit, k, sum(exp(k * ln(m) - m - lgamma(k + 1.0::DOUBLE))) OVER (PARTITION BY unit ORDER BY k) AS c FROM m JOIN range(0, 1000) AS r(k) ON k <= ceil(4 * m) WHERE m > 0)
SELECT unit, (SELECT min(k) FROM c WHERE c.unit = m.unit AND c >= 0.025) AS low, (SELECT min(k) FROM c WHERE c.unit = m.unit AND c >= 0.975) AS high, round(round(m - 4 * sd + 596 * (sd / 100), 4), 4) AS normal_high FROM m""")
def q_count_fractiles(spark, d):
    s = spikes(spark, d).withColumn("t", F.col("t") - START)
    m = trains.binned(s, DAY, 30 * DAY).groupBy("unit").agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("sd"))
    low, high = (distributions.poisson_fractile(p, F.col("m")) for p in (0.025, 0.975))
    return m.select("unit", low.alias("low"), high.alias("high"), distributions.normal_fractile(0.975, F.col("m"), F.col("sd")).alias("normal_high"))


# --- decompositions


@query("SELECT vec_id AS id, k, round(x, 6) + 0 AS x FROM (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(embedding::DOUBLE[]) AS x FROM embeddings)")
def q_recomposed(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return linear.recomposed(*linear.decomposed(points)).select("id", "k", (F.round("x", 6) + 0).alias("x"))


def _whitened(spark, d, method: str) -> DataFrame:
    c = signals.covariance(signals.whitened(recording(spark, d), method, 0.0))
    return c.select("c1", "c2", (F.round("covariance", 6) + 0).alias("covariance"))


UNIT_COVARIANCE = f"WITH {SIGNAL}, c AS (SELECT DISTINCT channel FROM g) SELECT a.channel AS c1, b.channel AS c2, (a.channel = b.channel)::INT::DOUBLE AS covariance FROM c a JOIN c b ON a.channel <= b.channel"


@query(UNIT_COVARIANCE)
def q_whitened_by_correlation(spark, d):
    return _whitened(spark, d, "zca_cor")


@query(UNIT_COVARIANCE)
def q_whitened_by_triangle(spark, d):
    return _whitened(spark, d, "cholesky")


@query(f"WITH {SIGNAL}, z AS (SELECT channel, chunk, t, x - avg(x) OVER (PARTITION BY t) AS x FROM g WHERE chunk % 3 = 0), c AS (SELECT a.chunk, a.channel AS c1, b.channel AS c2, avg(a.x * b.x) AS v FROM z a JOIN z b ON a.t = b.t AND a.channel <= b.channel GROUP BY ALL) SELECT c1, c2, round(quantile_cont(v, 0.5), 6) AS covariance FROM c GROUP BY ALL")
def q_median_covariance(spark, d):
    return signals.median_covariance(recording(spark, d), 3).select("c1", "c2", r6("covariance", "covariance"))


# --- noise


def _snips(name: str, moved: str) -> str:
    return f"{name} AS (SELECT unit, id, channel, g.t - sp.t + 6 AS i, x FROM (SELECT unit, id, {moved} AS t FROM sp) sp JOIN g ON g.t >= sp.t - 6 AND g.t < sp.t + 24 WHERE sp.t >= 6 AND sp.t + 24 <= (SELECT max(t) + 1 FROM g))"


@query(f"""WITH {SIGNAL}, sp AS (SELECT user_id % 8 AS unit, event_id AS id, (event_id * 37) % 8000 AS t FROM events), {_snips('w', 't')}, {_snips('o', 't + id % 41 - 20')},
m AS (SELECT unit, channel, i, avg(x) AS m FROM w GROUP BY ALL), p AS (SELECT unit, arg_max(channel, (d, -channel)) AS peak FROM (SELECT unit, channel, max(m) - min(m) AS d FROM m GROUP BY ALL) GROUP BY unit), u AS (SELECT m.* FROM m JOIN p USING (unit) WHERE abs(channel - peak) <= 1),
a AS (SELECT unit, id, sum(x * m) AS v FROM w JOIN u USING (unit, channel, i) GROUP BY ALL), b AS (SELECT unit, id, sum(x * m) AS v FROM o JOIN u USING (unit, channel, i) GROUP BY ALL)
SELECT unit, round(((SELECT avg(v) FROM a WHERE a.unit = b.unit) - avg(v)) / stddev_pop(v), 6) AS snr FROM b GROUP BY unit""")
def q_template_ratio(spark, d):
    s, r = spike_places(spark, d), recording(spark, d)
    noise = s.withColumn("t", F.col("t") + F.col("id") % 41 - 20)
    return extraction.template_ratio(extraction.snippets(s, r, 16, 6, 24), extraction.snippets(noise, r, 16, 6, 24), half=1).select("unit", r6("snr", "snr"))


# --- population synchrony among trains that fire

FIRING = f"fp AS ({ORACLES['q_firing_periods']})"


@query(f"""WITH {SPIKES}, {FIRING}, k AS (SELECT id, t - {START} AS t FROM s WHERE e = 'click'), v AS (SELECT unit, t - {START} AS t FROM s),
f AS (SELECT k.id, count(*) AS n FROM k JOIN fp ON k.t BETWEEN fp.start AND fp.stop GROUP BY ALL), h AS (SELECT k.id, count(DISTINCT v.unit) AS n FROM k JOIN v ON v.t BETWEEN k.t - {HOUR} AND k.t + {HOUR} WHERE EXISTS (SELECT 1 FROM fp WHERE fp.unit = v.unit AND k.t BETWEEN fp.start AND fp.stop) GROUP BY ALL)
SELECT k.id, round(coalesce(h.n, 0) / f.n::DOUBLE, 6) AS fraction FROM k LEFT JOIN f USING (id) LEFT JOIN h USING (id)""")
def q_cofiring_synchrony(spark, d):
    s = spikes(spark, d).withColumn("t", F.col("t") - START)
    periods = rates.firing_periods(s.filter("e = 'click'"), DAY, 30 * DAY, 1.5, 0.9)
    return neighbours.cofiring_synchrony(s.filter("e = 'click'"), s, periods, HOUR, 6 * HOUR).select("id", r6("fraction", "fraction"))


@query(f"""WITH {SPIKES}, {FIRING}, ev AS (SELECT id AS event_id, t - {START} AS event FROM s WHERE e = 'purchase'), v AS (SELECT DISTINCT unit, s.t - {START} AS t FROM s JOIN ev ON s.t - {START} BETWEEN event - {4 * HOUR} AND event + {4 * HOUR}),
k AS (SELECT event_id, k, event - {4 * HOUR} + k * {HOUR} AS t FROM ev, range(0, 8) AS r(k)), f AS (SELECT event_id, k, count(*) AS n FROM k JOIN fp ON k.t BETWEEN fp.start AND fp.stop GROUP BY ALL),
h AS (SELECT event_id, k, count(DISTINCT v.unit) AS n FROM k JOIN v ON v.t BETWEEN k.t - {HOUR} AND k.t + {HOUR} WHERE EXISTS (SELECT 1 FROM fp WHERE fp.unit = v.unit AND k.t BETWEEN fp.start AND fp.stop) GROUP BY ALL)
SELECT event_id, k // 2 AS bin, round(avg(coalesce(h.n, 0) / f.n::DOUBLE), 6) AS fraction FROM k LEFT JOIN f USING (event_id, k) LEFT JOIN h USING (event_id, k) GROUP BY ALL""")
def q_population_synchrony_trials(spark, d):
    s = spikes(spark, d).withColumn("t", F.col("t") - START)
    periods = rates.firing_periods(s.filter("e = 'click'"), DAY, 30 * DAY, 1.5, 0.9)
    events = s.filter("e = 'purchase'").select(F.col("id").alias("event_id"), F.col("t").alias("event"))
    out = alignment.population_synchrony_trials(events, s, periods, -4 * HOUR, 4 * HOUR, 2 * HOUR, 2, HOUR, 6 * HOUR)
    return out.select("event_id", "bin", r6("n", "fraction"))


# --- merged sets and the store

SETS = "ds AS (SELECT unnest(range(0, 3)) AS dataset, '/data/' || unnest(range(0, 3)) AS dp)"


@query(f"WITH {SETS}, n AS (SELECT DISTINCT user_id % 4 AS dataset, user_id // 4 AS source_unit FROM events) SELECT round(source_unit + n.dataset / 10.0::DOUBLE, 1) AS unit, n.dataset, source_unit, dp FROM n LEFT JOIN ds USING (dataset)")
def q_with_sources(spark, d):
    user = F.col("unit")
    u = spikes(spark, d).select((F.floor(user / 4) + user % 4 / 10).alias("unit")).distinct()
    sets = u.select((F.round(F.col("unit") % 1 * 10) % 3).cast("long").alias("dataset")).distinct().withColumn("dp", F.concat(F.lit("/data/"), "dataset"))
    return merged.with_sources(u, sets).select(F.round("unit", 1).alias("unit"), "dataset", "source_unit", "dp")


NEURONS = SPIKES + f", n AS (SELECT unit % 3 AS dataset, unit, CASE WHEN unit % 5 = 0 THEN 'PkC_ss' WHEN unit % 5 = 1 THEN 'PkC_cs' ELSE 'MLI' END AS label, count(*) AS n, count(*) FILTER (t BETWEEN {START + 10 * DAY} AND {START + 20 * DAY}) AS sane, min(t) AS first, max(t) AS last FROM s WHERE unit % 7 <> 6 GROUP BY ALL)"


def _neurons(spark, d, wanted: str, lab: str) -> DataFrame:
    s = spikes(spark, d).withColumn("dataset", (F.col("unit") % 3).cast("string"))
    listed = s.filter(wanted).groupBy("dataset").agg(F.lit("MLI").alias("ct"), F.lit("line").alias("line"), F.collect_set("unit").alias("units"), F.collect_set(F.when(F.col("unit") % 5 == 0, F.col("unit"))).alias("ss"), F.collect_set(F.when(F.col("unit") % 5 == 1, F.col("unit"))).alias("cs"))
    periods = s.select("dataset", "unit").distinct().select("*", F.lit(START + 10 * DAY).alias("start"), F.lit(START + 20 * DAY).alias("stop"))
    return store.neurons(s, store.listed_units(listed), lab, periods=periods)


def _digest(neurons: DataFrame) -> DataFrame:
    sane = F.size(F.filter("sane", lambda x: x)).cast("long")
    return neurons.select(F.col("dataset").cast("long").alias("dataset"), "unit", "label", F.size("spike_times").cast("long").alias("n"), sane.alias("sane"), F.get("spike_times", F.lit(0)).alias("first"), F.element_at("spike_times", -1).alias("last"))


@query(f"WITH {NEURONS} SELECT * FROM n")
def q_neuron_store(spark, d):
    return _digest(_neurons(spark, d, "unit % 7 <> 6", "lab"))


@query(f"WITH {NEURONS} SELECT CASE WHEN unit % 2 = 1 THEN 'lab/' || dataset || '/' || unit ELSE 'new/' || dataset || '/' || unit END AS neuron_id, label FROM n")
def q_renewed_store(spark, d):
    old = _neurons(spark, d, "unit % 7 < 3", "lab").drop("sane").withColumn("label", F.lit("unknown"))
    more = store.renewed(old, _neurons(spark, d, "unit % 7 <> 6 AND unit % 2 = 1", "lab"), ["label"])
    return store.contents(store.renewed(more, _neurons(spark, d, "unit % 7 <> 6 AND unit % 2 = 0", "new"))).select("neuron_id", "label")


@query("WITH c AS (SELECT DISTINCT label AS channel FROM embeddings WHERE label % 2 = 0) SELECT vec_id AS id, label::BIGINT AS channel, coalesce(c.channel IS NOT NULL, false) AS known FROM embeddings LEFT JOIN c ON c.channel = label")
def q_known_channels(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("channel"))
    return merged.known_channels(e, e.filter("channel % 2 = 0").select("channel")).select("id", "channel", "known")


@query(f"WITH {SPIKES} SELECT unit, dense_rank() OVER (ORDER BY unit) - 1 AS place FROM (SELECT DISTINCT unit FROM s)")
def q_dense_labels(spark, d):
    return units.dense_labels(spikes(spark, d).select("unit").distinct(), "unit")
