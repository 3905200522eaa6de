"""The registered queries over the driver's tables, and the SQL that must agree.

Events stand for spikes: a user is a unit, microseconds are ticks, value is
the amplitude. Decimals are rounded where summation order shows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.functions import scalars
from tidewave.functions.timeline import HOUR
from tidewave.operators import alignment, behaviour, correlograms, information, models, neighbours, periods, quality, rates, significance, trains, waveforms
from tidewave.sources import units
from tidewave.sources.tables import spikes, table
from tidewave.streaming import live
from tidewave.streaming.drain import drained

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SECOND = 1_000_000.0
DAY = 24 * HOUR
START = 1_704_067_200_000_000  # 2024-01-01, the first event's day
SPIKES = "s AS (SELECT event_id AS id, user_id AS unit, epoch_us(ts) AS t, value AS a, event_type AS e FROM events)"
CLICKS = SPIKES + ", c AS (SELECT * FROM s WHERE e = 'click')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def near6(c: Column | str, name: str) -> Column:
    """r6 without decimals, for queries of a row for each two units: for finite values under 10^12."""
    x = F.col(c) if isinstance(c, str) else c
    return (F.when(x < 0, -F.floor(0.5 - x * 1e6)).otherwise(F.floor(x * 1e6 + 0.5)) / F.lit(1e6)).alias(name)


# --- single trains

ISI = SPIKES + ", i AS (SELECT *, t - lag(t) OVER (PARTITION BY unit ORDER BY t, id) AS isi FROM s)"


@query(f"WITH {ISI} SELECT unit, count(*) AS n, round(avg(isi), 3) AS mean_isi, min(isi) AS min_isi, quantile_cont(isi, 0.5) AS median_isi FROM i GROUP BY unit")
def q_isi(spark, d):
    return trains.interval_summary(spikes(spark, d)).withColumn("mean_isi", F.round("mean_isi", 3))


@query(f"WITH {ISI} SELECT unit, id, t FROM i WHERE coalesce(isi > {HOUR}, true)")
def q_dedup_rp(spark, d):
    return trains.enforce_refractory(spikes(spark, d), HOUR).select("unit", "id", "t")


@query(f"""WITH {ISI}, q AS (SELECT unit, quantile_cont(isi, 0.995) AS cap FROM i WHERE isi IS NOT NULL GROUP BY unit)
SELECT unit, round(1 / avg(x) * 1000, 6) AS mfr, round(avg(1 / x) * 1000, 6) AS mifr, round(stddev_pop(x) / avg(x), 6) AS cv
FROM (SELECT unit, isi / 1e6 AS x FROM i JOIN q USING (unit) WHERE isi <= cap AND isi > 0) GROUP BY unit""")
def q_isi_filtered_mfr(spark, d):
    return trains.rates(spikes(spark, d), SECOND).select("unit", r6(F.col("mfr") * 1000, "mfr"), r6(F.col("mifr") * 1000, "mifr"), r6("cv", "cv"))


@query(f"""WITH {ISI}, x AS (SELECT unit, t, isi / 3.6e9 AS x FROM i WHERE isi > 0), p AS (SELECT *, lag(x) OVER (PARTITION BY unit ORDER BY t) AS p FROM x),
m AS (SELECT unit, avg(x) AS mu FROM x GROUP BY unit)
SELECT unit, round(avg(2 * abs(x - p) / (x + p)), 6) AS cv2_mean, round(quantile_cont(2 * abs(x - p) / (x + p), 0.5), 6) AS cv2_median, round(avg(abs(ln(x / p))), 6) AS ir,
  round(3 * avg(1 - 4 * x * p / (x + p) ^ 2), 6) AS lv, round(3 * avg((1 - 4 * x * p / (x + p) ^ 2) * (1 + 4 * 0.8 / (x + p))), 6) AS lvr,
  round(-avg(0.5 * log10(4 * x * p / (x + p) ^ 2)), 6) AS si, round(avg((x - mu) ^ 3) / avg((x - mu) ^ 2) ^ 1.5, 6) AS skew, round(quantile_cont(1 / x, 0.95), 6) AS burst_index
FROM p JOIN m USING (unit) GROUP BY unit""")
def q_isi_features(spark, d):
    f = trains.regularity(spikes(spark, d), float(HOUR))
    return f.select("unit", *(r6(c, c) for c in ("cv2_mean", "cv2_median", "ir", "lv", "lvr", "si", "skew", "burst_index")))


@query(f"""WITH {CLICKS}, k AS (SELECT unit, (t - {START}) // {DAY} AS bin, count(*) AS n FROM c GROUP BY ALL)
SELECT unit, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT unit FROM c) CROSS JOIN (SELECT unnest(range(0, 30)) AS bin) LEFT JOIN k USING (unit, bin)""")
def q_binarize_dense(spark, d):
    return trains.binned(spikes(spark, d, "click").withColumn("t", F.col("t") - START), DAY, 30 * DAY).select("unit", "bin", "n")


@query(f"WITH {SPIKES}, g AS (SELECT *, t - lag(t) OVER w AS b, lead(t) OVER w - t AS f FROM s WINDOW w AS (PARTITION BY unit ORDER BY t)) SELECT unit, id, t FROM g WHERE b >= {6 * HOUR} AND f >= {6 * HOUR}")
def q_isolated_stamps(spark, d):
    return trains.isolated(spikes(spark, d), 6 * HOUR).select("unit", "id", "t")


@query(f"WITH {SPIKES} SELECT unit, round(count(DISTINCT least(floor((t - {START}) / ({30 * DAY} / 99.0::DOUBLE)), 98)) / 100.0::DOUBLE, 6) AS presence FROM s WHERE t BETWEEN {START} AND {START + 30 * DAY} GROUP BY unit")
def q_presence_ratio(spark, d):
    return trains.presence_ratio(spikes(spark, d), START, START + 30 * DAY).select("unit", r6("presence", "presence"))


@query(f"WITH {SPIKES} SELECT unit, round(count(*) * 1e9 / (max(t) - min(t)), 6) AS rate FROM s GROUP BY unit")
def q_firing_rate(spark, d):
    return trains.firing_rate(spikes(spark, d), SECOND).select("unit", r6(F.col("rate") * 1000, "rate"))


@query(f"WITH {SPIKES}, m AS (SELECT unit, avg(a) AS m, stddev_pop(a) AS s FROM s GROUP BY unit) SELECT unit, id, a FROM s JOIN m USING (unit) WHERE abs(a - m) > 1.9 * m.s")
def q_outliers(spark, d):
    return trains.outliers(spikes(spark, d), "a", 1.9).select("unit", "id", "a")


@query(f"WITH {SPIKES} SELECT unit, id, rolling FROM (SELECT unit, id, round(avg(a) OVER w, 6) AS rolling, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY unit ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE n = 5")
def q_rolling_average(spark, d):
    return trains.rolling_mean(spikes(spark, d), "a", 5).select("unit", "id", r6("rolling", "rolling"))


@query(f"WITH {SPIKES} SELECT unit, id FROM (SELECT unit, id, row_number() OVER (PARTITION BY unit ORDER BY t, id) - 1 AS k, count(*) OVER (PARTITION BY unit) AS n FROM s) WHERE k % greatest(1, ceil(n / 20.0))::BIGINT = 0")
def q_regular_subset(spark, d):
    return trains.every_nth(spikes(spark, d), 20).select("unit", "id")


# --- correlograms

HALF = 12
PAIRS = f"""p AS (SELECT a.unit AS u1, b.unit AS u2, (b.t - a.t) // {HOUR} AS bin, count(*) AS n FROM c a JOIN c b
  ON b.t >= a.t AND b.t - a.t < {(HALF + 1) * HOUR} AND (b.t > a.t OR b.unit > a.unit OR (b.unit = a.unit AND b.id > a.id)) GROUP BY ALL)"""
FULL = PAIRS + ", f AS (SELECT u1, u2, bin, max(n) AS n FROM (SELECT * FROM p UNION ALL SELECT u2, u1, -bin, n FROM p) GROUP BY ALL HAVING u1 <> u2 OR bin <> 0)"


@query(f"WITH {CLICKS}, {PAIRS} SELECT * FROM p")
def q_ccg_counts(spark, d):
    return correlograms.half_counts(spikes(spark, d, "click"), HOUR, HALF)


@query(f"WITH {SPIKES} SELECT a.unit, (b.t - a.t) // {HOUR} AS bin, count(*) AS n FROM s a JOIN s b ON a.unit = b.unit AND b.t >= a.t AND b.t - a.t < {(HALF + 1) * HOUR} AND (b.t > a.t OR b.id > a.id) GROUP BY ALL")
def q_acg(spark, d):
    return correlograms.half_counts(spikes(spark, d), HOUR, HALF, same_unit=True).select(F.col("u1").alias("unit"), "bin", "n")


@query(f"WITH {CLICKS}, {FULL} SELECT * FROM f")
def q_ccg_symmetric(spark, d):
    return correlograms.symmetric_counts(spikes(spark, d, "click"), HOUR, HALF)


@query(f"""WITH {CLICKS}, {PAIRS}, k AS (SELECT unit, count(*) AS n FROM c GROUP BY unit)
SELECT u1, u2, bin, round(p.n / (a.n * 3600.0::DOUBLE) * 1000, 6) AS hertz, round(p.n / sqrt(a.n * b.n), 6) AS pearson FROM p JOIN k a ON a.unit = u1 JOIN k b ON b.unit = u2""")
def q_ccg_normalised(spark, d):
    out = correlograms.normalised(spikes(spark, d, "click"), HOUR, HALF, 3600.0)
    return out.select("u1", "u2", "bin", near6(F.col("hertz") * 1000, "hertz"), near6("pearson", "pearson"))


ZSCORE = FULL + f""", g AS (SELECT u1, u2, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT u1, u2 FROM f) CROSS JOIN (SELECT unnest(range({-HALF}, {HALF + 1})) AS bin) LEFT JOIN f USING (u1, u2, bin)),
o AS (SELECT u1, u2, avg(n) AS m, stddev_pop(n) AS s FROM g WHERE bin + {HALF} < 10 OR bin + {HALF} >= 15 GROUP BY ALL),
z AS (SELECT u1, u2, bin, (n - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS z FROM g JOIN o USING (u1, u2))"""


@query(f"WITH {CLICKS}, {ZSCORE} SELECT u1, u2, bin, round(z, 6) AS z FROM z")
def q_ccg_zscore(spark, d):
    return correlograms.zscored_bins(spikes(spark, d, "click"), HOUR, HALF).select("u1", "u2", "bin", near6("z", "z"))


@query(f"WITH {CLICKS}, {ZSCORE} SELECT u1, u2, round(avg(z), 6) AS synchrony FROM z WHERE abs(bin) <= 1 GROUP BY ALL")
def q_sync_zscore(spark, d):
    return correlograms.zscore_synchrony(spikes(spark, d, "click"), HOUR, HALF, 1).select("u1", "u2", near6("synchrony", "synchrony"))


RUNS = ZSCORE + """, m AS (SELECT *, CASE WHEN z >= 1.5 THEN 1 WHEN z <= -1.5 THEN -1 ELSE 0 END AS side FROM z),
i AS (SELECT *, sum(ch) OVER (PARTITION BY u1, u2 ORDER BY bin) AS run FROM (SELECT *, CASE WHEN side <> lag(side) OVER (PARTITION BY u1, u2 ORDER BY bin) THEN 1 ELSE 0 END AS ch FROM m)),
r AS (SELECT u1, u2, min(bin) AS first, max(bin) AS last, count(*) AS n, arg_max(z, (abs(z), -bin)) AS amplitude, arg_max(bin, (abs(z), -bin)) AS peak_bin FROM i WHERE side <> 0 GROUP BY u1, u2, run HAVING count(*) >= 2)"""


@query(f"WITH {CLICKS}, {RUNS} SELECT u1, u2, first, last, n, round(amplitude, 6) AS amplitude, peak_bin FROM r")
def q_ccg_significance(spark, d):
    m = correlograms.modulations(spikes(spark, d, "click"), HOUR, HALF, 1.5, 2)
    return m.select("u1", "u2", "first", "last", "n", near6("amplitude", "amplitude"), F.col("at").alias("peak_bin"))


@query(f"""WITH {CLICKS}, {RUNS}, t AS (SELECT *, (first + last + 1) / 2.0 AS w FROM r)
SELECT u1, u2, round(amplitude, 6) AS amplitude, CASE WHEN amplitude > 0 AND abs(w) <= 1 THEN 'synchrony' WHEN amplitude > 0 AND abs(w) BETWEEN 1 AND 2.5 THEN 'excitation' WHEN amplitude <= 0 AND abs(w) BETWEEN 0.2 AND 3 THEN 'inhibition' ELSE 'none' END AS kind
FROM t QUALIFY row_number() OVER (PARTITION BY u1, u2 ORDER BY abs(amplitude) DESC, first) = 1""")
def q_typed_connections(spark, d):
    m = correlograms.largest_modulations(spikes(spark, d, "click"), HOUR, HALF, 1.5, 2)
    return m.select("u1", "u2", near6("amplitude", "amplitude"), models.connection_kind(1.0).alias("kind"))


@query(f"WITH {SPIKES} SELECT a.id, (b.t - a.t) // {HOUR} AS bin, count(*) AS n FROM s a JOIN s b ON a.unit = b.unit AND b.t >= a.t AND b.t - a.t < {13 * HOUR} WHERE a.e = 'purchase' AND b.e = 'click' GROUP BY ALL")
def q_ccg_2d(spark, d):
    return correlograms.by_reference(spikes(spark, d, "purchase"), spikes(spark, d, "click"), HOUR, HALF)


@query(f"""WITH {CLICKS}, k AS (SELECT unit, count(*) AS n FROM c GROUP BY unit)
SELECT u1, u2, round(m * {float(30 * DAY)!r} / (a.n * b.n * {2.0 * HOUR!r}), 6) AS ci
FROM (SELECT a.unit AS u1, b.unit AS u2, count(*) AS m FROM c a JOIN c b ON a.unit < b.unit AND abs(a.t - b.t) <= {HOUR} GROUP BY ALL) JOIN k a ON a.unit = u1 JOIN k b ON b.unit = u2""")
def q_corr_index(spark, d):
    return correlograms.correlation_index(spikes(spark, d, "click"), HOUR, 30 * DAY).select("u1", "u2", near6("ci", "ci"))


def _near(x: str, y: str, name: str) -> str:
    return f"{name} AS (SELECT unit, avg(CASE WHEN EXISTS (SELECT 1 FROM {y} o WHERE o.unit = i.unit AND abs(o.t - i.t) <= {6 * HOUR}) THEN 1.0::DOUBLE ELSE 0 END) AS {name} FROM {x} i GROUP BY unit)"


def _tiled(x: str, name: str) -> str:
    w = 12 * HOUR
    return f"{name} AS (SELECT unit, (sum(CASE WHEN g IS NULL OR g >= {w} THEN {w} ELSE g END) - greatest(0, {6 * HOUR} - min(t)) - greatest(0, max(t) + {6 * HOUR} - {30 * DAY})) / {float(30 * DAY)!r} AS {name} FROM (SELECT *, t - lag(t) OVER (PARTITION BY unit ORDER BY t) AS g FROM {x}) GROUP BY unit)"


@query(f"""WITH {SPIKES}, a AS (SELECT unit, t - {START} AS t FROM s WHERE e = 'click'), b AS (SELECT unit, t - {START} AS t FROM s WHERE e = 'view'),
{_near('a', 'b', 'pa')}, {_near('b', 'a', 'pb')}, {_tiled('a', 'ta')}, {_tiled('b', 'tb')}
SELECT unit, round(0.5 * (CASE WHEN pa * tb = 1 THEN 1 ELSE (pa - tb) / (1 - pa * tb) END + CASE WHEN pb * ta = 1 THEN 1 ELSE (pb - ta) / (1 - pb * ta) END), 6) AS sttc FROM pa JOIN pb USING (unit) JOIN ta USING (unit) JOIN tb USING (unit)""")
def q_sttc(spark, d):
    a, b = (spikes(spark, d, e).withColumn("t", F.col("t") - START) for e in ("click", "view"))
    return correlograms.tiling_coefficient(a, b, 6 * HOUR, 30 * DAY).select("unit", r6("sttc", "sttc"))


# --- nearest events

NEXT = "(SELECT min(b.t) FROM s b WHERE b.unit = p.unit AND b.e = 'click' AND b.t >= p.t) - p.t"
LAST = "p.t - (SELECT max(b.t) FROM s b WHERE b.unit = p.unit AND b.e = 'click' AND b.t <= p.t)"


def _cisi(direction: int):
    def f(spark, d):
        a = spikes(spark, d, "purchase").select("unit", "t", "id")
        return neighbours.cross_intervals(a, spikes(spark, d, "click").select("unit", "t"), direction).select("id", "interval")

    f.__name__ = {1: "q_cisi_next", -1: "q_cisi_prev", 0: "q_cisi_nearest"}[direction]
    value = {1: NEXT, -1: LAST, 0: f"least({NEXT}, {LAST})"}[direction]
    return query(f"WITH {SPIKES} SELECT id, {value} AS interval FROM s p WHERE e = 'purchase'")(f)


for _direction in (1, -1, 0):
    _cisi(_direction)

TWO = SPIKES + ", two AS (SELECT *, CASE e WHEN 'purchase' THEN 1 ELSE 2 END AS side FROM s WHERE e IN ('purchase', 'click')), g AS (SELECT *, lead(side) OVER w AS sn, lead(t) OVER w - t AS dn, lag(side) OVER w AS sp, t - lag(t) OVER w AS dp FROM two WINDOW w AS (PARTITION BY unit ORDER BY t, side, id))"


@query(f"WITH {TWO} SELECT unit, id, t, dn AS interval FROM g WHERE side = 1 AND sn = 2")
def q_cih(spark, d):
    return neighbours.consecutive(spikes(spark, d, "purchase"), spikes(spark, d, "click"))


@query(f"WITH {TWO} SELECT unit, id, t FROM g WHERE side = 1 AND ((sn = 2 AND dn <= {12 * HOUR}) OR (sp = 2 AND dp <= {12 * HOUR}))")
def q_synced_stamps(spark, d):
    return neighbours.synced(spikes(spark, d, "purchase"), spikes(spark, d, "click"), 12 * HOUR)


@query(f"""WITH {CLICKS} SELECT p.id, round(count(DISTINCT c.unit) / (SELECT count(DISTINCT unit) FROM c)::DOUBLE, 6) AS fraction
FROM (SELECT * FROM s WHERE e = 'purchase') p LEFT JOIN c ON c.t BETWEEN p.t - {HOUR} AND p.t + {HOUR} GROUP BY p.id""")
def q_frac_pop_sync(spark, d):
    return neighbours.population_synchrony(spikes(spark, d, "purchase"), spikes(spark, d, "click"), HOUR).select("id", r6("fraction", "fraction"))


# --- periods: a purchase opens six hours, a signup twelve

PERIODS = SPIKES + f""", e1 AS (SELECT unit, t AS start, t + {6 * HOUR} AS stop FROM s WHERE e = 'purchase'),
m1 AS (SELECT unit, start, stop, max(stop) OVER (PARTITION BY unit ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e1),
a1 AS (SELECT unit, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY unit ORDER BY start, stop) AS k FROM m1) GROUP BY unit, k)"""


def merged_periods(df: DataFrame, length: int) -> DataFrame:
    """Disjoint periods of some length from each spike."""
    w = Window.partitionBy("unit").orderBy("start", "stop")
    p = df.select("unit", F.col("t").alias("start"), (F.col("t") + length).alias("stop")).withColumn("reach", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    p = p.withColumn("k", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy("unit", "k").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("k")


@query(f"WITH {PERIODS} SELECT id, s.unit, t FROM s WHERE EXISTS (SELECT 1 FROM a1 WHERE a1.unit = s.unit AND t BETWEEN start AND stop)")
def q_in_periods(spark, d):
    return periods.inside(spikes(spark, d), merged_periods(spikes(spark, d, "purchase"), 6 * HOUR)).select("id", "unit", "t")


@query(f"""WITH {PERIODS}, x AS (SELECT unit, coalesce(lag(stop) OVER w, {START}) AS start, start AS stop FROM a1 WINDOW w AS (PARTITION BY unit ORDER BY start) UNION ALL SELECT unit, max(stop), {START + 31 * DAY} FROM a1 GROUP BY unit)
SELECT unit, start, stop FROM x WHERE start < stop""")
def q_period_complement(spark, d):
    return periods.complement(merged_periods(spikes(spark, d, "purchase"), 6 * HOUR), START, START + 31 * DAY)


@query(f"""WITH {PERIODS.replace("e1 AS", "e0 AS (SELECT 1), e1 AS")}, n1 AS (SELECT unit, t AS start, t + {12 * HOUR} AS stop FROM s WHERE e = 'signup'),
m2 AS (SELECT unit, start, stop, max(stop) OVER (PARTITION BY unit ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n1),
a2 AS (SELECT unit, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY unit ORDER BY start, stop) AS k FROM m2) GROUP BY unit, k)
SELECT unit, greatest(a1.start, a2.start) AS start, least(a1.stop, a2.stop) AS stop FROM a1 JOIN a2 USING (unit) WHERE greatest(a1.start, a2.start) < least(a1.stop, a2.stop)""")
def q_period_intersection(spark, d):
    both = merged_periods(spikes(spark, d, "purchase"), 6 * HOUR).unionByName(merged_periods(spikes(spark, d, "signup"), 12 * HOUR))
    return periods.intersection(both, 2)


ISLANDS = SPIKES + ", f AS (SELECT *, a >= 100 AS flag FROM s), i AS (SELECT *, sum(ch) OVER (PARTITION BY unit ORDER BY t) AS run FROM (SELECT *, CASE WHEN flag <> lag(flag) OVER w THEN 1 ELSE 0 END AS ch, lag(t) OVER w IS NULL OR lead(t) OVER w IS NULL AS edge FROM f WINDOW w AS (PARTITION BY unit ORDER BY t)))"


@query(f"WITH {ISLANDS} SELECT unit, min(t) AS start, max(t) AS stop, count(*) AS n FROM i WHERE flag GROUP BY unit, run HAVING count(*) > 1")
def q_good_sections(spark, d):
    return periods.runs(spikes(spark, d).withColumn("flag", F.col("a") >= 100), "flag", 2)


@query(f"WITH {ISLANDS} SELECT unit, min(t) AS start, max(t) AS stop, count(*) AS n FROM i WHERE flag GROUP BY unit, run HAVING count(*) >= 3 AND NOT bool_or(edge)")
def q_thresh_runs(spark, d):
    return periods.runs(spikes(spark, d).withColumn("flag", F.col("a") >= 100), "flag", 3, edges=False)


@query(f"WITH {SPIKES} SELECT unit, id, t FROM (SELECT *, lag(a) OVER (PARTITION BY unit ORDER BY t) AS p FROM s) WHERE a >= 100 AND p < 100")
def q_threshold_crossings(spark, d):
    return periods.crossings(spikes(spark, d), "a", 100.0).select("unit", "id", "t")


# --- alignment: clicks and values around purchases

WINDOW_ = 12 * HOUR
AL = SPIKES + f""", v AS (SELECT unit, id AS event_id, t AS event FROM s WHERE e = 'purchase'),
al AS (SELECT v.unit, v.event_id, c.a, least((c.t - v.event + {WINDOW_}) // {HOUR}, 23) AS bin FROM v JOIN s c ON c.unit = v.unit AND c.e = 'click' AND c.t - v.event BETWEEN {-WINDOW_} AND {WINDOW_}),
k AS (SELECT unit, event_id, bin, count(*) AS n FROM al GROUP BY ALL),
g AS (SELECT unit, event_id, bin, coalesce(n, 0) AS n FROM (SELECT unit, event_id FROM v) CROSS JOIN (SELECT unnest(range(0, 24)) AS bin) LEFT JOIN k USING (unit, event_id, bin))"""


def purchases(spark, d):
    return spikes(spark, d, "purchase").select("unit", F.col("id").alias("event_id"), F.col("t").alias("event"))


def clicks(spark, d):
    return spikes(spark, d, "click").select("unit", "t", "a")


@query(f"WITH {AL} SELECT * FROM k")
def q_align_times(spark, d):
    return alignment.aligned_counts(purchases(spark, d), clicks(spark, d), -WINDOW_, WINDOW_, HOUR)


@query(f"WITH {AL} SELECT unit, bin, round(avg(n) / 3600.0::DOUBLE * 1e6, 6) AS rate, round(stddev_samp(n) / sqrt(count(*)) / 3600.0::DOUBLE * 1e6, 6) AS sem FROM g GROUP BY ALL HAVING sum(n) > 0 AND count(*) > 1")
def q_psth_mean_sem(spark, d):
    out = alignment.event_rates(purchases(spark, d), clicks(spark, d), -WINDOW_, WINDOW_, HOUR, 3600.0)
    return out.select("unit", "bin", r6(F.col("rate") * 1e6, "rate"), r6(F.col("sem") * 1e6, "sem"))


def _psth_z(across: bool):
    def f(spark, d):
        trials = alignment.dense_trials(purchases(spark, d), clicks(spark, d), -WINDOW_, WINDOW_, HOUR)
        return alignment.baseline_scores(trials, 12, across).select("unit", "bin", r6("z", "z"))

    f.__name__ = "q_psth_zscore_across" if across else "q_psth_zscore_within"
    base = "SELECT unit, n AS v FROM g WHERE bin < 12" if across else "SELECT unit, m AS v FROM m WHERE bin < 12"
    return query(f"WITH {AL}, m AS (SELECT unit, bin, avg(n) AS m FROM g GROUP BY ALL), b AS (SELECT unit, avg(v) AS b, stddev_pop(v) AS s FROM ({base}) GROUP BY unit) SELECT unit, bin, round((m - b) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z FROM m JOIN b USING (unit)")(f)


for _across in (False, True):
    _psth_z(_across)


@query(f"WITH {AL} SELECT unit, bin, round(avg(a), 6) AS mean_value FROM al GROUP BY ALL")
def q_align_variable(spark, d):
    return alignment.aligned_values(purchases(spark, d), clicks(spark, d), -WINDOW_, WINDOW_, HOUR).select("unit", "bin", r6("mean_value", "mean_value"))


JP = AL + f""", h AS (SELECT event_id, bin // 4 AS bin, sum(n) AS n FROM g GROUP BY ALL), al2 AS (SELECT v.event_id, least((c.t - v.event + {WINDOW_}) // {4 * HOUR}, 5) AS bin, count(*) AS n FROM v JOIN s c ON c.unit = v.unit AND c.e = 'view' AND c.t - v.event BETWEEN {-WINDOW_} AND {WINDOW_} GROUP BY ALL),
y AS (SELECT event_id, bin, coalesce(n, 0) AS n FROM (SELECT event_id FROM v) CROSS JOIN (SELECT unnest(range(0, 6)) AS bin) LEFT JOIN al2 USING (event_id, bin)),
x AS (SELECT event_id, bin, n FROM h)"""


@query(f"WITH {JP}, q AS (SELECT x.bin AS u, y.bin AS v, avg(x.n * y.n) - avg(x.n) * avg(y.n) AS c, stddev_pop(x.n) * stddev_pop(y.n) AS s FROM x JOIN y USING (event_id) GROUP BY ALL) SELECT u, v, round(CASE WHEN s > 0 THEN c / s ELSE 0 END, 6) AS jpsth FROM q")
def q_jpsth(spark, d):
    x = alignment.dense_trials(purchases(spark, d), clicks(spark, d), -WINDOW_, WINDOW_, 4 * HOUR)
    y = alignment.dense_trials(purchases(spark, d), spikes(spark, d, "view").select("unit", "t", "a"), -WINDOW_, WINDOW_, 4 * HOUR)
    return alignment.joint_histogram(x, y).select("u", "v", r6("jpsth", "jpsth"))


@query(f"WITH {AL} SELECT event_id, count(*) AS units FROM (SELECT event_id, unit, sum(n) AS n FROM g GROUP BY ALL) GROUP BY event_id HAVING min(n) > 0")
def q_active_events(spark, d):
    trials = alignment.dense_trials(purchases(spark, d), clicks(spark, d), -WINDOW_, WINDOW_, HOUR)
    return alignment.active_events(trials).withColumn("units", F.lit(1).cast("long"))


@query(f"WITH {SPIKES} SELECT unit, id AS event_id, t AS event FROM (SELECT *, t - lag(t) OVER (PARTITION BY unit ORDER BY t) AS g FROM s WHERE e = 'purchase') WHERE coalesce(g >= {24 * HOUR}, true)")
def q_trial_spacing(spark, d):
    return alignment.spaced_events(purchases(spark, d), 24 * HOUR)


@query(f"""WITH {SPIKES}, y AS (SELECT e, (t - {START}) / 1e9 AS own, (t - {START}) / 1e9 * 1.0001 + 5 + (id % 7) / 1000.0 AS reference FROM s)
SELECT e AS dataset, round(regr_slope(reference, own), 6) AS slope, round(regr_intercept(reference, own), 6) AS intercept FROM y GROUP BY e""")
def q_affine_align(spark, d):
    own = (F.col("t") - START) / 1e9
    sync = spikes(spark, d).select(F.col("e").alias("dataset"), own.alias("own"), (own * 1.0001 + 5 + (F.col("id") % 7) / 1000.0).alias("reference"))
    return alignment.clock_fit(sync).select("dataset", r6("slope", "slope"), r6("intercept", "intercept"))


# --- quality

V = SPIKES + f", i0 AS (SELECT *, t - lag(t) OVER (PARTITION BY unit ORDER BY t) AS g FROM s), i1 AS (SELECT unit, t FROM i0 WHERE coalesce(g > {HOUR // 60}, true)), i2 AS (SELECT unit, t, t - lag(t) OVER (PARTITION BY unit ORDER BY t) AS isi FROM i1)"


@query(f"""WITH {V} SELECT unit, count(*) FILTER (isi < {2 * HOUR}) AS n_violations, round(count(*) FILTER (isi < {2 * HOUR}) / (2 * count(*) * {(2 * HOUR - HOUR // 60) / SECOND!r}::DOUBLE) / (count(*) / ((max(t) - min(t)) / 1e6)), 6) AS fp_rate FROM i2 GROUP BY unit HAVING count(*) > 1""")
def q_isi_violations(spark, d):
    return quality.violations(spikes(spark, d), 2 * HOUR, HOUR // 60, SECOND).select("unit", "n_violations", r6("fp_rate", "fp_rate"))


VOTE = SPIKES + f""", k AS (SELECT unit, t, (t - {START}) // {DAY} AS k FROM s), ch AS (SELECT unit, t, unnest(range(greatest(k - 2, 0), k + 1)) AS chunk FROM k),
ok AS (SELECT unit, chunk, count(*) FILTER (isi < {2 * HOUR}) <= 0.05 * count(*) AS ok FROM (SELECT unit, chunk, t - lag(t) OVER (PARTITION BY unit, chunk ORDER BY t) AS isi FROM ch) GROUP BY ALL),
v AS (SELECT unit, unnest(range(chunk, chunk + 3)) AS chunk, ok FROM ok)"""


def _votes(any_passes: bool):
    def f(spark, d):
        return quality.chunk_votes(spikes(spark, d), DAY, 3, START, 2 * HOUR, 0.05, any_passes)

    f.__name__ = "q_fp_or_vote" if any_passes else "q_fp_and_vote"
    return query(f"WITH {VOTE} SELECT unit, chunk, {'bool_or' if any_passes else 'bool_and'}(ok) AS good FROM v GROUP BY ALL")(f)


for _any in (True, False):
    _votes(_any)


@query(f"""WITH {SPIKES}, m AS (SELECT unit, t // {5 * DAY} AS k, quantile_cont(a, 0.5) AS m FROM s GROUP BY ALL HAVING count(*) >= 3)
SELECT unit, round(max(m) - min(m), 6) AS max_drift, round(coalesce(sum(d), 0), 6) AS cumulative_drift FROM (SELECT *, abs(m - lag(m) OVER (PARTITION BY unit ORDER BY k)) AS d FROM m) GROUP BY unit""")
def q_drift(spark, d):
    return quality.drift(spikes(spark, d), "a", 5 * DAY, 3).select("unit", r6("max_drift", "max_drift"), r6("cumulative_drift", "cumulative_drift"))


@query("""WITH p AS (SELECT vec_id AS id, label, embedding FROM embeddings),
d AS (SELECT q.id AS qid, q.label AS ql, p.label, row_number() OVER (PARTITION BY q.id ORDER BY list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), p.id) AS r FROM p q JOIN p ON p.id <> q.id),
b AS (SELECT * FROM d WHERE r <= 4), o AS (SELECT ql AS label, avg((ql = label)::INT) AS hit, count(*) AS n FROM b GROUP BY ql)
SELECT label, round(hit, 6) AS hit, round((SELECT count(*) FROM b WHERE b.label = o.label AND b.ql <> o.label) / ((SELECT count(*) FROM b) - n)::DOUBLE, 6) AS miss FROM o""")
def q_knn_hit_miss(spark, d):
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))
    return quality.neighbour_rates(p, p, 4).select("label", r6("hit", "hit"), r6("miss", "miss"))


# --- information: event types as units, hours as bins

BINS = 24 * 30
DENSE = SPIKES + f", k AS (SELECT e AS unit, (t - {START}) // {HOUR} AS bin, count(*) AS n FROM s GROUP BY ALL), x AS (SELECT unit, bin, CASE WHEN coalesce(n, 0) > 2 THEN 1 ELSE 0 END AS x FROM (SELECT DISTINCT e AS unit FROM s) CROSS JOIN (SELECT unnest(range(0, {BINS})) AS bin) LEFT JOIN k USING (unit, bin))"


def types_by_hour(spark, d):
    s = spikes(spark, d).select(F.col("e").alias("unit"), (F.col("t") - START).alias("t"))
    return trains.binned(s, HOUR, BINS * HOUR).select("unit", "bin", F.when(F.col("n") > 2, 1).otherwise(0).alias("x"))


@query(f"WITH {DENSE} SELECT a.unit AS u1, b.unit AS u2, round(corr(a.x, b.x), 6) AS r FROM x a JOIN x b ON a.bin = b.bin AND a.unit < b.unit GROUP BY ALL")
def q_pearson_matrix(spark, d):
    return information.pearson_matrix(types_by_hour(spark, d)).select("u1", "u2", r6("r", "r"))


@query(f"WITH {DENSE} SELECT a.bin % 24 AS bin, round(CASE WHEN avg(a.x) * avg(b.x) > 0 THEN avg(a.x * b.x) / (avg(a.x) * avg(b.x)) ELSE 1 END, 6) AS over_chance, round(avg(a.x * b.x) - avg(a.x) * avg(b.x), 6) AS covariance FROM x a JOIN x b ON a.bin = b.bin WHERE a.unit = 'click' AND b.unit = 'view' GROUP BY ALL")
def q_sync_chance(spark, d):
    x = types_by_hour(spark, d)
    a, b = (x.filter(F.col("unit") == u).select("bin", F.col("x").alias(n)) for u, n in (("click", "a"), ("view", "b")))
    return information.over_chance(a.join(b, "bin").withColumn("bin", F.col("bin") % 24)).select("bin", r6("over_chance", "over_chance"), r6("covariance", "covariance"))


@query(f"""WITH {DENSE}, z AS (SELECT sum(x) AS z FROM x GROUP BY bin), u AS (SELECT avg(x) AS m, var_pop(x) AS v, ln(avg(pow(2, x))) AS g FROM x GROUP BY unit)
SELECT round((SELECT avg(z * z) FROM z) / nullif(sum(v) + sum(m) ^ 2, 0), 6) AS total, round(sqrt((SELECT var_pop(z) FROM z) / nullif(sum(v) * count(*), 0)), 6) AS variance, round((SELECT avg(pow(2, z)) FROM z) / exp(sum(g)), 6) AS mgf FROM u""")
def q_total_synchrony(spark, d):
    return information.total_synchrony(types_by_hour(spark, d)).select(r6("total", "total"), r6("variance", "variance"), r6("mgf", "mgf"))


WORDS = DENSE + ", o AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS k FROM (SELECT DISTINCT unit FROM x)), w AS (SELECT bin, sum(x * (1 << k))::BIGINT AS word FROM x JOIN o USING (unit) GROUP BY bin), j AS (SELECT word, count(*) / (SELECT count(*) FROM w)::DOUBLE AS p FROM w GROUP BY word)"


@query(f"WITH {WORDS} SELECT word, round(p, 6) AS p FROM j")
def q_p_joint(spark, d):
    return information.words(types_by_hour(spark, d)).select("word", r6("p", "p"))


@query(f"""WITH {WORDS}, u AS (SELECT avg(x) AS p FROM x GROUP BY unit), h AS (SELECT -(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) - (CASE WHEN p < 1 THEN (1 - p) * ln(1 - p) ELSE 0 END) AS h FROM u), t AS (SELECT (SELECT -sum(p * ln(p)) FROM j) AS h, sum(h) AS hu, max(h) AS hm FROM h)
SELECT round(h, 6) AS h, round(hu, 6) AS h_units, round(hu - h, 6) AS total_correlation, round((hu - h) / nullif(hu - hm, 0), 6) AS normalised FROM t""")
def q_total_correlation(spark, d):
    out = information.total_correlation(types_by_hour(spark, d))
    return out.select(*(r6(c, c) for c in out.columns))


@query(f"WITH {DENSE} SELECT a.unit AS u1, b.unit AS u2, round(corr(a.x, b.x), 6) AS r FROM x a JOIN x b ON b.bin = (a.bin + 3) % {BINS} GROUP BY ALL")
def q_lagged_correlation(spark, d):
    return information.lagged_correlation(types_by_hour(spark, d), 3, BINS).select("u1", "u2", r6("r", "r"))


# --- models

@query("""WITH g AS (SELECT l_shipmode AS g, l_quantity AS v FROM (SELECT l_returnflag AS l_shipmode, l_quantity FROM lineitem)), m AS (SELECT g, quantile_cont(v, 0.5) AS m FROM g GROUP BY g), z AS (SELECT g, abs(v - m) AS z FROM g JOIN m USING (g)),
e AS (SELECT g, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY g), a AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS mm FROM e)
SELECT round((max(nn) - max(k)) / (max(k) - 1) * sum(n * (m - mm) ^ 2) / sum(n * v), 6) AS w FROM e, a""")
def q_levene(spark, d):
    return models.levene(table(spark, d, "lineitem"), "l_quantity", "l_returnflag").select(r6("w", "w"))


@query("""WITH x AS (SELECT 1.0::DOUBLE AS c0, l_quantity AS c1, l_discount AS c2, l_extendedprice / 1e6 AS y FROM lineitem)
SELECT * FROM (SELECT 0 AS i, 0 AS j, round(sum(c0 * c0), 3) AS s FROM x UNION ALL SELECT 0, 1, round(sum(c0 * c1), 3) FROM x UNION ALL SELECT 0, 2, round(sum(c0 * c2), 3) FROM x UNION ALL SELECT 1, 1, round(sum(c1 * c1), 3) FROM x
UNION ALL SELECT 1, 2, round(sum(c1 * c2), 3) FROM x UNION ALL SELECT 2, 2, round(sum(c2 * c2), 3) FROM x UNION ALL SELECT 0, -1, round(sum(c0 * y), 3) FROM x UNION ALL SELECT 1, -1, round(sum(c1 * y), 3) FROM x UNION ALL SELECT 2, -1, round(sum(c2 * y), 3) FROM x)""")
def q_ridge_normal_eq(spark, d):
    x = table(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1e6)
    return models.normal_equations(x, ["l_quantity", "l_discount"], "y").select("i", "j", F.round("s", 3).alias("s"))


@query(f"WITH {CLICKS}, k AS (SELECT unit, (t - {START}) // {DAY} AS bin, count(*) AS n FROM c GROUP BY ALL), g AS (SELECT unit, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT unit FROM c) CROSS JOIN (SELECT unnest(range(0, 30)) AS bin) LEFT JOIN k USING (unit, bin)) SELECT unit, bin, coalesce(lag(n) OVER w, 0) AS before, n AS here, coalesce(lead(n) OVER w, 0) AS after FROM g WINDOW w AS (PARTITION BY unit ORDER BY bin)")
def q_design_matrix(spark, d):
    x = models.design_matrix(q_binarize_dense(spark, d), "n", 1, 1, t="bin")
    return x.select("unit", "bin", F.col("lag_-1").alias("before"), F.col("lag_0").alias("here"), F.col("lag_1").alias("after"))


@query("SELECT k, round(exp(k * ln(3.7) - 3.7 - lgamma(k + 1)), 6) AS pmf, round((SELECT sum(exp(i * ln(3.7) - 3.7 - lgamma(i + 1))) FROM range(0, 21) AS r(i) WHERE i <= k), 6) AS cdf FROM (SELECT DISTINCT (l_quantity % 21)::BIGINT AS k FROM lineitem)")
def q_poisson(spark, d):
    k = table(spark, d, "lineitem").select((F.col("l_quantity") % 21).cast("long").alias("k")).distinct()
    return k.select("k", r6(models.poisson_pmf(F.col("k"), F.lit(3.7)), "pmf"), r6(models.poisson_cdf(F.col("k"), F.lit(3.7)), "cdf"))


# --- waveforms and classes: an embedding is a wave, its parts a cube of predictions

CUBE = "cube AS (SELECT vec_id AS unit, c AS class, m AS model, abs(embedding[1 + c * 4 + m]) + 0.001 AS p FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings), range(0, 5) AS a(c), range(0, 4) AS b(m))"


def cube(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("unit"), F.col("embedding").cast("array<double>").alias("e"))
    return e.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("unit", F.col("class").cast("long").alias("class"), F.col("model").cast("long").alias("model"), (F.abs(F.get("e", F.col("class") * 4 + F.col("model"))) + 0.001).alias("p"))


VOTES = CUBE + """, m AS (SELECT unit, class, avg(p) AS p FROM cube GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY p DESC, class) AS r FROM m),
v AS (SELECT unit, class AS vote FROM cube QUALIFY row_number() OVER (PARTITION BY unit, model ORDER BY p DESC, class) = 1),
t AS (SELECT a.unit, a.class AS prediction, a.p AS confidence, b.p AS second FROM r a JOIN r b ON a.unit = b.unit AND a.r = 1 AND b.r = 2)"""


@query(f"WITH {VOTES} SELECT unit, prediction, round(confidence, 6) AS confidence, round(confidence - second, 6) AS delta, round(confidence / second, 6) AS ratio, (SELECT count(*) FROM v WHERE v.unit = t.unit AND vote = prediction) AS votes FROM t")
def q_format_predictions(spark, d):
    return models.ensemble_vote(cube(spark, d)).select("unit", "prediction", r6("confidence", "confidence"), r6("delta", "delta"), r6("ratio", "ratio"), "votes")


@query(f"WITH {VOTES} SELECT unit, prediction FROM t WHERE confidence / second >= 1.2")
def q_conf_filter(spark, d):
    return models.ensemble_vote(cube(spark, d)).filter("ratio >= 1.2").select("unit", "prediction")


@query(f"WITH {CUBE}, z AS (SELECT unit, class, model, CASE WHEN unit % 2 = 1 AND class IN (1, 3) THEN 0 ELSE p END AS p FROM cube) SELECT unit, class, model, round(p / sum(p) OVER (PARTITION BY unit, model), 6) AS p FROM z")
def q_layer_correction(spark, d):
    out = models.prior_corrected(cube(spark, d), (F.col("unit") % 2 == 1) & F.col("class").isin(1, 3))
    return out.select("unit", "class", "model", r6("p", "p"))


WAVE = "w AS (SELECT vec_id AS unit, label AS channel, embedding::DOUBLE[] AS w FROM embeddings)"


def waves(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("unit"), F.col("label").alias("channel"), F.col("embedding").cast("array<double>").alias("wave"))


@query(f"WITH {WAVE} SELECT unit, round(list_max(w) - list_min(w), 6) AS ptp, list_position(w, list_min(w)) - 1 AS trough, list_position(w, list_max(w)) - 1 AS peak, (SELECT count(*) FROM range(2, len(w) + 1) AS r(i) WHERE (w[i] >= 0) <> (w[i - 1] >= 0)) AS crossings FROM w")
def q_wave_shape(spark, d):
    w = F.col("wave")
    return waves(spark, d).select("unit", r6(waveforms.peak_to_peak(w), "ptp"), waveforms.trough(w).cast("int").alias("trough"), waveforms.peak(w).cast("int").alias("peak"), waveforms.zero_crossings(w).cast("long").alias("crossings"))


@query(f"WITH {WAVE} SELECT channel AS unit, arg_max(unit, (round(list_max(w) - list_min(w), 9), -unit)) AS channel, round(max(list_max(w) - list_min(w)), 6) AS ptp FROM w GROUP BY channel")
def q_peak_channel(spark, d):
    w = waves(spark, d).select(F.col("channel").alias("unit"), F.col("unit").alias("channel"), "wave")
    return waveforms.peak_channels(w).select("unit", "channel", r6("ptp", "ptp"))


@query(f"WITH {WAVE}, c AS (SELECT unit, list_transform(w, lambda x: x - list_avg(w)) AS c FROM w) SELECT unit, round(c[1] / list_max(list_transform(c, lambda x: abs(x))), 6) AS first, round(c[64] / list_max(list_transform(c, lambda x: abs(x))), 6) AS last FROM c")
def q_wave_normalised(spark, d):
    n = waveforms.normalise(F.col("wave"))
    return waves(spark, d).select("unit", n.alias("n")).select("unit", r6(F.get("n", F.lit(0)), "first"), r6(F.get("n", F.lit(63)), "last"))


@query()
def q_wave_features(spark, d):
    return waveforms.waveform_features(waves(spark, d))


@query()
def q_missing_spikes(spark, d):
    return waveforms.missing_spikes(spikes(spark, d))


# --- relational idioms of the reference: outer merge of counts, membership, label maps

@query("SELECT g AS quality, coalesce(a.n, 0) AS documents, coalesce(b.n, 0) AS toxic FROM (SELECT DISTINCT quality AS g FROM labels) LEFT JOIN (SELECT quality AS g, count(*) AS n FROM labels GROUP BY ALL) a USING (g) LEFT JOIN (SELECT quality AS g, count(*) AS n FROM labels WHERE toxic = 1 GROUP BY ALL) b USING (g)")
def q_group_counts(spark, d):
    labels = table(spark, d, "labels")
    a = labels.groupBy("quality").agg(F.count("*").alias("documents"))
    b = labels.filter("toxic = 1").groupBy("quality").agg(F.count("*").alias("toxic"))
    return a.join(b, "quality", "full").select("quality", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q_membership(spark, d):
    poor = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(poor, "o_custkey", "left_semi").join(returned, "o_orderkey", "left_anti").select("o_orderkey")


# --- behaviour

@query(f"WITH {CLICKS}, g AS (SELECT *, t - lag(t) OVER w AS b, lead(t) OVER w - t AS f FROM c WINDOW w AS (PARTITION BY unit ORDER BY t)) SELECT unit, id, t FROM g WHERE coalesce(b, {24 * HOUR} + 1) > {24 * HOUR} AND f > {HOUR} AND f < {24 * HOUR}")
def q_bout_onsets(spark, d):
    return behaviour.bout_onsets(spikes(spark, d, "click"), 24 * HOUR, HOUR, 24 * HOUR).select("unit", "id", "t")


@query(f"""WITH {SPIKES} SELECT r.unit, r.id, r.t, min(q.t) AS cue, min(l.t) AS lick FROM s r JOIN s q ON q.unit = r.unit AND q.e = 'signup' AND q.t > r.t - {48 * HOUR} AND q.t < r.t
JOIN s l ON l.unit = r.unit AND l.e = 'click' AND l.t > r.t AND l.t < r.t + {48 * HOUR} WHERE r.e = 'purchase' GROUP BY ALL""")
def q_cued_rewards(spark, d):
    return behaviour.cued_rewards(spikes(spark, d, "purchase"), spikes(spark, d, "signup"), spikes(spark, d, "click"), 48 * HOUR)


@query(f"WITH {SPIKES} SELECT unit, id, t, (SELECT min(r.t) FROM s r WHERE r.unit = o.unit AND r.e = 'purchase' AND r.t >= o.t AND r.t < o.t + {24 * HOUR}) AS reward FROM s o WHERE e = 'signup'")
def q_trial_rewards(spark, d):
    return behaviour.trial_rewards(spikes(spark, d, "signup"), spikes(spark, d, "purchase"), 24 * HOUR)


@query(f"""WITH {SPIKES}, r AS (SELECT unit, (t // {HOUR}) % 24 / 24.0::DOUBLE * 2 * pi() AS angle, count(*)::DOUBLE AS rate FROM s GROUP BY ALL), v AS (SELECT unit, sum(rate * cos(angle)) AS x, sum(rate * sin(angle)) AS y, sum(rate) AS n FROM r GROUP BY unit)
SELECT unit, round(CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END, 6) AS direction, round(sqrt(x * x + y * y) / n, 6) AS selectivity FROM v WHERE sqrt(x * x + y * y) > 1e-6""")
def q_preferred_direction(spark, d):
    hour = F.floor(F.col("t") / HOUR) % 24
    by_hour = spikes(spark, d).groupBy("unit", (hour / 24.0 * (2 * math.pi)).alias("angle")).agg(F.count("*").cast("double").alias("rate"))
    return behaviour.preferred_direction(by_hour).filter("selectivity > 1e-8").select("unit", r6("direction", "direction"), r6("selectivity", "selectivity"))


# --- rates

SMOOTH_SD = 1.5
DAILY = f"k AS (SELECT unit, (t - {START}) // {DAY} AS bin, count(*) AS n FROM c GROUP BY ALL), g AS (SELECT unit, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT unit FROM c) CROSS JOIN (SELECT unnest(range(0, 30)) AS bin) LEFT JOIN k USING (unit, bin))"
SMOOTHED = DAILY + f""", o AS (SELECT o, exp(-0.5 * (o / {SMOOTH_SD}) ^ 2) AS w FROM range(-6, 7) AS r(o)), wt AS (SELECT o, w / (SELECT sum(w) FROM o) AS w FROM o),
sm AS (SELECT a.unit, a.bin, a.n, sum(b.n * w) AS smooth FROM g a CROSS JOIN wt JOIN g b ON b.unit = a.unit AND b.bin = CASE WHEN a.bin + o < 0 THEN -(a.bin + o) - 1 WHEN a.bin + o >= 30 THEN 59 - (a.bin + o) ELSE a.bin + o END GROUP BY ALL)"""


def _from_start(spark, d):
    return spikes(spark, d, "click").withColumn("t", F.col("t") - START)


@query(f"WITH {CLICKS}, {SMOOTHED} SELECT unit, bin, round(smooth, 6) AS smooth FROM sm")
def q_instant_rate(spark, d):
    return rates.gaussian_smoothed(trains.binned(_from_start(spark, d), DAY, 30 * DAY), SMOOTH_SD).select("unit", "bin", r6("smooth", "smooth"))


@query(f"""WITH {CLICKS}, {SMOOTHED}, f AS (SELECT sm.unit, bin, smooth >= m * 0.9 AS flag FROM sm JOIN (SELECT unit, avg(n) AS m FROM g GROUP BY unit) USING (unit)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY unit ORDER BY bin) AS run FROM (SELECT *, CASE WHEN flag <> lag(flag) OVER (PARTITION BY unit ORDER BY bin) THEN 1 ELSE 0 END AS ch FROM f)),
r AS (SELECT unit, min(bin) * {DAY} AS start, (max(bin) + 1) * {DAY} AS stop FROM i WHERE flag GROUP BY unit, run)
SELECT * FROM r UNION ALL SELECT DISTINCT unit, 0, {30 * DAY} FROM g WHERE unit NOT IN (SELECT unit FROM r)""")
def q_firing_periods(spark, d):
    return rates.firing_periods(_from_start(spark, d), DAY, 30 * DAY, SMOOTH_SD, 0.9)


@query(f"""WITH {SPIKES}, r AS (SELECT *, 1 / ((lead(t) OVER w - lag(t) OVER w) / 2.0::DOUBLE) AS rate FROM s WINDOW w AS (PARTITION BY unit ORDER BY t)),
e AS (SELECT unit, quantile_cont(rate, [0.2, 0.4, 0.6, 0.8]) AS e FROM r WHERE rate IS NOT NULL GROUP BY unit),
l AS (SELECT r.unit, id, t, least(len(list_filter(e.e, lambda x: x < rate)), 3) AS level FROM r JOIN e USING (unit) WHERE rate IS NOT NULL),
p AS (SELECT l.unit, level, CASE WHEN s.t >= l.t THEN (s.t - l.t) // {6 * HOUR} ELSE -((l.t - s.t) // {6 * HOUR}) END AS bin FROM l JOIN s ON s.unit = l.unit AND s.id <> l.id AND abs(s.t - l.t) < {42 * HOUR})
SELECT p.unit, p.level, bin, round(count(*) / any_value(refs)::DOUBLE, 6) AS p FROM p JOIN (SELECT unit, level, count(*) AS refs FROM l GROUP BY ALL) k USING (unit, level) WHERE bin <> 0 GROUP BY ALL""")
def q_acg_by_rate(spark, d):
    out = rates.autocorrelogram_by_rate(spikes(spark, d), 6 * HOUR, 6, 4)
    return out.select("unit", F.col("level").cast("long").alias("level"), "bin", r6("p", "p"))


@query(f"""WITH {ISI}, e AS (SELECT unit, min(isi) AS lo, max(isi) AS hi FROM i GROUP BY unit), k AS (SELECT unit, lo, hi, least(isi_lo * 20 // (hi - lo), 19) AS k, count(*) AS n FROM (SELECT i.unit, lo, hi, isi - lo AS isi_lo FROM i JOIN e USING (unit) WHERE isi IS NOT NULL AND hi > lo) GROUP BY ALL)
SELECT unit, round(lo + k * (hi - lo) / 20.0::DOUBLE, 3) AS mode FROM k QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC, k) = 1""")
def q_interval_mode(spark, d):
    return rates.interval_mode(spikes(spark, d), 20).select("unit", F.round("mode", 3).alias("mode"))


@query(f"WITH {SPIKES}, e AS (SELECT unit, min(a) AS lo, max(a) AS hi FROM s GROUP BY unit) SELECT unit, id, CASE WHEN hi > lo THEN least(floor((a - lo) * 4 / (hi - lo)), 3) ELSE 0 END::BIGINT AS part FROM s JOIN e USING (unit)")
def q_split_distribution(spark, d):
    return rates.split_by_value(spikes(spark, d), "a", 4).select("unit", "id", "part")


# --- correlograms against a predictor

_KERNEL = significance.hollow_kernel(4)
PREDICTED = FULL + f""", g AS (SELECT u1, u2, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT u1, u2 FROM f) CROSS JOIN (SELECT unnest(range({-HALF}, {HALF + 1})) AS bin) LEFT JOIN f USING (u1, u2, bin)),
wt AS (SELECT unnest(range({-(len(_KERNEL) // 2)}, {len(_KERNEL) // 2 + 1})) AS o, unnest([{', '.join(f'{w!r}::DOUBLE' for w in _KERNEL)}]) AS w),
x AS (SELECT a.u1, a.u2, a.bin, a.n, sum(b.n * w) AS expected FROM g a CROSS JOIN wt JOIN g b ON b.u1 = a.u1 AND b.u2 = a.u2 AND b.bin + {HALF} = CASE WHEN a.bin + {HALF} + o < 0 THEN -(a.bin + {HALF} + o) - 1 WHEN a.bin + {HALF} + o >= {2 * HALF + 1} THEN {4 * HALF + 1} - (a.bin + {HALF} + o) ELSE a.bin + {HALF} + o END GROUP BY ALL)"""


@query(f"WITH {CLICKS}, {PREDICTED} SELECT u1, u2, bin, round(expected, 6) AS expected, round(CASE WHEN expected > 0 THEN 1 - coalesce((SELECT sum(exp(i * ln(expected) - expected - lgamma(i + 1))) FROM range(0, 60) AS r(i) WHERE i < n), 0) - 0.5 * exp(n * ln(expected) - expected - lgamma(n + 1)) WHEN n > 0 THEN 0 ELSE 1 END, 6) AS p_excess FROM x")
def q_ccg_poisson(spark, d):
    return significance.poisson_bins(spikes(spark, d, "click"), HOUR, HALF, 4).select("u1", "u2", "bin", near6("expected", "expected"), near6("p_excess", "p_excess"))


# --- scalar and array functions on the relational tables

@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount - 0.05 < 0 THEN -1 ELSE 1 END AS side, floor(l_quantity / pow(2, 2))::BIGINT % 2 AS third_bit, ceil(l_quantity / 5)::BIGINT - 1 AS bin,
  round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) AS r, l_quantity * l_quantity / 900 + l_discount * l_discount / 0.0049 <= 1 AS inside, round(2 * 0.07 * sqrt(greatest(0, 1 - l_quantity * l_quantity / 2500)), 6) AS chord FROM lineitem""")
def q_scalar_functions(spark, d):
    q, tax, disc = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", scalars.sign(disc - 0.05).alias("side"), F.get(scalars.bits(q, 3), F.lit(2)).cast("long").alias("third_bit"), scalars.open_bin(q, 0.0, 5.0).cast("long").alias("bin"),
        r6(scalars.polar(q, tax)[0], "r"), scalars.in_ellipse(q, disc, 30.0, 0.07).alias("inside"), r6(scalars.ellipse_chord(q, 50.0, 0.07), "chord"),
    )


@query("""WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS w FROM embeddings) SELECT vec_id, round(list_avg(w), 6) AS mean, round(list_aggregate(w, 'stddev_pop'), 6) AS sd, round(list_avg(w[9:24]), 6) AS second_piece, (len(w) - 16) // 8 + 1 AS n_pieces, round((w[1] + w[2]) / 2, 6) AS between FROM w""")
def q_array_functions(spark, d):
    w = F.col("w")
    x = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))
    p = scalars.pieces(w, 16, 8)
    return x.select("vec_id", r6(scalars.array_mean(w), "mean"), r6(scalars.array_std(w), "sd"), r6(scalars.array_mean(F.get(p, F.lit(1))), "second_piece"), F.size(p).cast("long").alias("n_pieces"), r6(F.get(scalars.interpolated(w, 2), F.lit(1)), "between"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_discount = 0)::INT + (l_tax = 0)::INT > 1 OR l_discount IS NULL OR l_tax IS NULL")
def q_unusable_features(spark, d):
    return units.unusable(table(spark, d, "lineitem"), ["l_discount", "l_tax"], 1).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_custkey, c_acctbal, n FROM orders o LEFT JOIN (SELECT c_custkey AS o_custkey, c_acctbal, 1 AS n FROM customer WHERE c_acctbal > 0) USING (o_custkey)")
def q_combined_features(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("int").alias("o_custkey"), "c_acctbal", F.lit(1).alias("n"))
    return units.combined_features(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c)


@query(f"WITH {SPIKES} SELECT unit, CASE WHEN unit IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50) THEN 'good' ELSE 'unsorted' END AS \"group\" FROM (SELECT DISTINCT unit FROM s)")
def q_unit_qualities(spark, d):
    known = table(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_suppkey").alias("unit"), F.lit("good").alias("group")).distinct()
    return units.repaired(known, spikes(spark, d))


# --- streams over the same table

def live_events(spark, d):
    """unit, id, t, ts of events, as a stream."""
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("user_id").alias("unit"), F.col("event_id").alias("id"), F.unix_micros(ts).alias("t"), ts.alias("ts"), F.col("event_type").alias("e"))


@query(f"WITH {SPIKES} SELECT unit, t // {DAY} AS day, count(*) AS n FROM s GROUP BY ALL")
def q_stream_daily_counts(spark, d):
    counts = drained(live.windowed_counts(live_events(spark, d), "1 day", late="40 days"), "update")
    return counts.groupBy("unit", F.floor(F.unix_micros("start") / DAY).alias("day")).agg(F.max("n").alias("n"))


@query(f"WITH {ISI} SELECT unit, id, t FROM i WHERE coalesce(isi > {HOUR}, true)")
def q_stream_dedup_rp(spark, d):
    return drained(live.refractory(live_events(spark, d), HOUR, late="40 days"))


@query(f"WITH {SPIKES} SELECT p.unit, p.id AS event_id, c.id FROM s p JOIN s c ON c.unit = p.unit AND c.e = 'click' AND c.t BETWEEN p.t - {6 * HOUR} AND p.t + {6 * HOUR} WHERE p.e = 'purchase'")
def q_stream_aligned(spark, d):
    e = live_events(spark, d)
    events = e.filter("e = 'purchase'").select("unit", F.col("id").alias("event_id"), F.col("ts").alias("event_ts"))
    return drained(live.aligned(events, e.filter("e = 'click'").select("unit", "id", "ts"), "6 hours", "6 hours", late="40 days"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_ccg_counts(spark, sf_dir)
