"""Further registered queries: signals, waveforms, information, quality, unit tables, learning, streams.

Embeddings stand for a recording of four channels, frame by frame, 16 frames
in each row, and for points of ten labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.functions import scalars
from tidewave.functions.timeline import HOUR, numbered
from tidewave.operators import behaviour, correlograms, extraction, information, learning, models, periods, quality, rates, signals, significance, trains, waveforms
from tidewave.plans.registry import BINS, CLICKS, DAILY, DAY, DENSE, HALF, ISI, PERIODS, SPIKES, START, WAVE, WORDS, ZSCORE, live_events, merged_periods, near6, query, r6, types_by_hour, waves
from tidewave.sources import arrays, units
from tidewave.sources.tables import by_channel, spikes, table
from tidewave.streaming import live
from tidewave.streaming.drain import drained

# --- information

CHANCES = WORDS + ", m AS (SELECT k, avg(x) AS m FROM x JOIN o USING (unit) GROUP BY k), c AS (SELECT word, p, (SELECT exp(sum(ln(CASE WHEN (word >> k) & 1 = 1 THEN m ELSE 1 - m END))) FROM m) AS chance FROM j)"


@query(f"WITH {CHANCES} SELECT word, round(p, 6) AS p, round(chance, 6) AS chance FROM c")
def q_word_chances(spark, d):
    return information.word_chances(types_by_hour(spark, d)).select("word", r6("p", "p"), r6("chance", "chance"))


@query(f"WITH {CHANCES} SELECT round(sum(p * ln(p / chance)), 6) AS mi FROM c")
def q_mutual_information(spark, d):
    return information.mutual_information(types_by_hour(spark, d)).select(r6("mi", "mi"))


@query(f"WITH {CHANCES}, q AS (SELECT p / chance / (SELECT sum(p / chance) FROM c) AS q FROM c) SELECT round(1 + sum(q * ln(q)) / ((SELECT count(*) FROM o) * ln(2)), 6) AS copula FROM q")
def q_copula_entropy(spark, d):
    return information.copula_entropy(types_by_hour(spark, d)).select(r6("copula", "copula"))


@query(f"""WITH {DENSE}, o AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS k FROM (SELECT DISTINCT unit FROM x WHERE unit <> 'view')), w AS (SELECT bin, sum(x * (1 << k)) AS word FROM x JOIN o USING (unit) GROUP BY bin),
b AS (SELECT word, x.x > 0 AS y FROM w JOIN x USING (bin) WHERE x.unit = 'view'), n AS (SELECT count(*)::DOUBLE AS n FROM b),
h AS (SELECT (SELECT -sum(c / n * ln(c / n)) FROM (SELECT count(*) AS c FROM b GROUP BY word), n) AS hx, (SELECT -sum(c / n * ln(c / n)) FROM (SELECT count(*) AS c FROM b GROUP BY y), n) AS hy, (SELECT -sum(c / n * ln(c / n)) FROM (SELECT count(*) AS c FROM b GROUP BY word, y), n) AS hxy)
SELECT round(2 * (hx + hy - hxy) / nullif(hx + hy, 0), 6) AS mi FROM h""")
def q_information_on_target(spark, d):
    x = types_by_hour(spark, d)
    return information.information_on(x.filter("unit <> 'view'"), x.filter("unit = 'view'").select("bin", "x")).select(r6("mi", "mi"))


SYNC = DENSE + ", y AS (SELECT a.unit AS u1, b.unit AS u2, avg(a.x * b.x) / nullif(avg(a.x) * avg(b.x), 0) AS sync FROM x a JOIN x b ON a.bin = b.bin AND a.unit <> b.unit GROUP BY ALL)"


@query(f"WITH {SYNC} SELECT u1, u2, round(sync, 6) AS sync FROM y")
def q_sync_matrix(spark, d):
    return information.sync_matrix(types_by_hour(spark, d)).select("u1", "u2", r6("sync", "sync"))


@query(f"WITH {SYNC} SELECT round(sqrt(avg(sync * sync)), 6) AS l2, round(avg(sync), 6) AS mean FROM y")
def q_matrix_synchrony(spark, d):
    return information.matrix_synchrony(information.sync_matrix(types_by_hour(spark, d))).select(r6("l2", "l2"), r6("mean", "mean"))


# --- correlograms

@query(f"WITH {CLICKS}, {ZSCORE} SELECT u1, u2, round(avg(n) FILTER (abs(bin) <= 1) / avg(n) FILTER (bin + {HALF} < 5 OR bin + {HALF} >= 7), 6) AS ratio FROM g GROUP BY ALL HAVING avg(n) FILTER (bin + {HALF} < 5 OR bin + {HALF} >= 7) > 0")
def q_sync_ratio(spark, d):
    return correlograms.ratio_synchrony(spikes(spark, d, "click"), HOUR, HALF, 1).select("u1", "u2", near6("ratio", "ratio"))


@query(f"""WITH {CLICKS}, {ZSCORE}, k AS (SELECT unit, count(*) AS n FROM c GROUP BY unit), pr AS (SELECT u1, u2, bin, g.n / a.n - b.n / 720.0::DOUBLE AS dp, (g.n / a.n - b.n / 720.0::DOUBLE) * a.n / 720.0::DOUBLE AS cov FROM g JOIN k a ON a.unit = u1 JOIN k b ON b.unit = u2)
SELECT u1, u2, round(avg(dp), 6) AS mean, round(avg(cov) * 1000, 6) AS covariance FROM pr WHERE abs(bin) <= 1 GROUP BY ALL""")
def q_delta_probability(spark, d):
    p = correlograms.central_over_chance(spikes(spark, d, "click"), HOUR, HALF, 1, 1.0 / 720.0)
    return p.select("u1", "u2", near6("dp", "mean"), near6(F.col("covariance") * 1000, "covariance"))


# --- trains

LOGS = ISI + f""", l AS (SELECT unit, log10(isi) AS l FROM i WHERE isi > 0), le AS (SELECT unit, min(l) AS lo, max(l) AS hi FROM l GROUP BY unit HAVING max(l) > min(l)),
lk AS (SELECT unit, least(floor((l - lo) * 199 / (hi - lo)), 198)::BIGINT AS bin, count(*) AS n FROM l JOIN le USING (unit) GROUP BY ALL), lg AS (SELECT unit, bin, coalesce(n, 0) AS n FROM le CROSS JOIN (SELECT unnest(range(0, 199)) AS bin) LEFT JOIN lk USING (unit, bin)),
lo AS (SELECT o, exp(-0.5 * (o / 2.0::DOUBLE) ^ 2) AS w FROM range(-8, 9) AS r(o)),
ls AS (SELECT a.unit, a.bin, sum(b.n * w) / (SELECT sum(w) FROM lo) AS s FROM lg a CROSS JOIN lo JOIN lg b ON b.unit = a.unit AND b.bin = CASE WHEN a.bin + o < 0 THEN -(a.bin + o) - 1 WHEN a.bin + o >= 199 THEN 397 - (a.bin + o) ELSE a.bin + o END GROUP BY ALL)"""


@query(f"WITH {LOGS}, t AS (SELECT unit, s / sum(s) OVER (PARTITION BY unit) AS p FROM ls) SELECT unit, round(-sum(p * log2(p)), 6) AS entropy FROM t WHERE p > 0 GROUP BY unit")
def q_log_isi_entropy(spark, d):
    return rates.log_interval_entropy(spikes(spark, d)).select("unit", r6("entropy", "entropy"))


@query(f"""WITH {ISI}, x AS (SELECT unit, isi / 3.6e9 AS x FROM i WHERE isi > 0)
SELECT unit, round(1 / avg(x), 6) AS mfr, round(avg(1 / x), 6) AS mifr, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.05), 6) AS prct5, round(stddev_pop(x) / avg(x), 6) AS cv, round(stddev_pop(log10(x)) / avg(log10(x)), 6) AS lcv, round(stddev_pop(x), 6) AS sd FROM x GROUP BY unit""")
def q_interval_features(spark, d):
    f = rates.interval_features(spikes(spark, d), float(HOUR))
    return f.select("unit", *(r6(c, c) for c in ("mfr", "mifr", "median", "prct5", "cv", "lcv", "sd")))


@query(f"WITH {SPIKES} SELECT unit, id FROM s JOIN (SELECT unit, quantile_cont(a, 0.5) AS m FROM s GROUP BY unit) USING (unit) WHERE a < 10 + m * 0.5")
def q_up_to_median(spark, d):
    return rates.up_to_median(spikes(spark, d), "a", 10.0, 0.5).select("unit", "id")


@query(f"WITH {SPIKES} SELECT unit, id, round((a - avg(a) OVER w) / stddev_pop(a) OVER w, 6) AS z FROM s WINDOW w AS (PARTITION BY unit)")
def q_standardised(spark, d):
    from pyspark.sql import Window

    return spikes(spark, d).select("unit", "id", r6(trains.standardise(F.col("a"), Window.partitionBy("unit")), "z"))


@query(f"WITH {PERIODS} SELECT unit, id, EXISTS (SELECT 1 FROM a1 WHERE a1.unit = s.unit AND s.t BETWEEN a1.start AND a1.stop) AS inside FROM s")
def q_period_tags(spark, d):
    p = periods.checked(merged_periods(spikes(spark, d, "purchase"), 6 * HOUR))
    return periods.marked(spikes(spark, d), p).select("unit", "id", "inside")


@query(f"WITH {SPIKES} SELECT s.unit, s.id FROM s WHERE e = 'click' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.unit = s.unit AND b.e = 'view' AND b.t = s.t)")
def q_lone_events(spark, d):
    return behaviour.lone(spikes(spark, d, "click"), spikes(spark, d, "view")).select("unit", "id")


# --- behaviour: hours of the day as the states of a wheel

@query(f"""WITH {SPIKES}, p AS (SELECT unit, id, t, (t // {HOUR}) % 2 AS a, (t // {6 * HOUR}) % 2 AS b FROM s), q AS (SELECT *, CASE WHEN a = 0 AND b = 0 THEN 0 WHEN a = 0 THEN 3 WHEN b = 0 THEN 1 ELSE 2 END AS p FROM p),
m AS (SELECT unit, t, (p - lag(p) OVER (PARTITION BY unit ORDER BY t) + 4) % 4 AS m FROM q) SELECT unit, t, CASE m WHEN 1 THEN 1 ELSE -1 END AS step FROM m WHERE m IN (1, 3)""")
def q_quadrature(spark, d):
    t = F.col("t")
    return behaviour.rotary_ticks(spikes(spark, d).select("unit", "t", (F.floor(t / HOUR) % 2).alias("a"), (F.floor(t / (6 * HOUR)) % 2).alias("b")))


@query("""WITH v AS (SELECT o_custkey AS session, o_orderkey AS video, (o_totalprice / 1000)::BIGINT AS frames, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders),
e AS (SELECT *, sum(frames) OVER (PARTITION BY session ORDER BY place) AS stop FROM v), f AS (SELECT o_custkey AS session, o_orderkey % 977 AS frame FROM orders)
SELECT f.session, frame, video, frame - (stop - frames) AS at FROM f JOIN e ON e.session = f.session AND frame >= stop - frames AND frame < stop""")
def q_video_frames(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    v = o.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("video"), F.rint(F.col("o_totalprice") / 1000).cast("long").alias("frames"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("place"))
    return behaviour.frame_of(o.select(F.col("o_custkey").alias("session"), (F.col("o_orderkey") % 977).alias("frame")), v)


@query("""WITH w AS (SELECT l_orderkey * 8 + l_linenumber AS k, l_partkey % 65536 AS word FROM lineitem), r AS (SELECT row_number() OVER (ORDER BY k, word) - 1 AS i, word FROM w), c AS (SELECT i, word, lag(word) OVER (ORDER BY i) AS old FROM r)
SELECT b AS bit, i, ((word >> b) & 1) - ((old >> b) & 1) AS edge FROM c, range(0, 16) AS s(b) WHERE old IS NOT NULL AND ((word >> b) & 1) <> ((old >> b) & 1)""")
def q_sync_edges(spark, d):
    w = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), (F.col("l_partkey") % 65536).alias("word"))
    samples = numbered(w, "k", "word", name="i").select("i", "word")
    return arrays.sync_edges(samples, 16, block=1000).select(F.col("bit").cast("long").alias("bit"), "i", F.col("edge").cast("long").alias("edge"))


# --- signals: embeddings as frames of four channels

SIGNAL = "v AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS k FROM embeddings), g AS (SELECT k % 4 AS channel, vec_id AS chunk, k // 4 AS i, vec_id * 16 + k // 4 AS t, x FROM v)"
KERNEL = signals.band_kernel(1000.0, 50.0, 200.0, 41)


def recording(spark, d) -> DataFrame:
    return by_channel(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("embedding").cast("array<double>").alias("samples")), 4)


def flat(df: DataFrame) -> DataFrame:
    return df.select("channel", "chunk", F.posexplode("samples").alias("i", "x")).select("channel", (F.col("chunk") * 16 + F.col("i")).alias("t"), r6("x", "x"))


@query(f"WITH {SIGNAL} SELECT channel, t, round(x, 6) AS x FROM g")
def q_signal(spark, d):
    return flat(recording(spark, d))


@query(f"WITH {SIGNAL}, w AS (SELECT unnest(range(-20, 21)) AS o, unnest([{', '.join(f'{k!r}::DOUBLE' for k in KERNEL.tolist())}]) AS w) SELECT a.channel, a.t, round(sum(b.x * w), 6) AS x FROM g a CROSS JOIN w JOIN g b ON b.channel = a.channel AND b.t = a.t - o GROUP BY ALL")
def q_signal_filtered(spark, d):
    return flat(signals.filtered(recording(spark, d), KERNEL))


@query(f"WITH {SIGNAL} SELECT channel, t, round(x - quantile_cont(x, 0.5) OVER (PARTITION BY t), 6) AS x FROM g")
def q_common_average(spark, d):
    return flat(signals.common_average_removed(recording(spark, d)))


@query(f"WITH {SIGNAL} SELECT a.channel AS c1, b.channel AS c2, round(covar_pop(a.x, b.x), 6) AS covariance FROM g a JOIN g b ON a.t = b.t AND a.channel <= b.channel GROUP BY ALL")
def q_channel_covariance(spark, d):
    return signals.covariance(recording(spark, d)).select("c1", "c2", r6("covariance", "covariance"))


SNIPPETS = SIGNAL + ", sp AS (SELECT user_id % 8 AS unit, event_id AS id, (event_id * 37) % 8000 AS t FROM events), sn AS (SELECT unit, id, sp.t AS spike, channel, g.t - sp.t + 6 AS i, x FROM sp JOIN g ON g.t >= sp.t - 6 AND g.t < sp.t + 24 WHERE sp.t >= 6 AND sp.t + 24 <= (SELECT max(t) + 1 FROM g))"


def spike_places(spark, d):
    e = table(spark, d, "events")
    return e.select((F.col("user_id") % 8).alias("unit"), F.col("event_id").alias("id"), (F.col("event_id") * 37 % 8000).alias("t"))


@query(f"WITH {SNIPPETS} SELECT unit, id, channel, round(max(x) - min(x), 6) AS ptp, round(max(x) FILTER (i = 6), 6) AS at_spike FROM sn GROUP BY ALL")
def q_snippets(spark, d):
    w = extraction.snippets(spike_places(spark, d), recording(spark, d), 16, 6, 24)
    return w.select("unit", "id", "channel", r6(waveforms.peak_to_peak(F.col("wave")), "ptp"), r6(F.get("wave", F.lit(6)), "at_spike"))


@query(f"WITH {SNIPPETS} SELECT unit, channel, i, round(avg(x), 6) AS x FROM sn GROUP BY ALL")
def q_mean_waves(spark, d):
    m = extraction.mean_waves(extraction.snippets(spike_places(spark, d), recording(spark, d), 16, 6, 24))
    return m.select("unit", "channel", F.posexplode("wave").alias("i", "x")).select("unit", "channel", F.col("i").cast("long").alias("i"), r6("x", "x"))


@query(f"WITH {SNIPPETS}, m AS (SELECT unit, channel, i, avg(x) AS x FROM sn GROUP BY ALL), p AS (SELECT unit, channel, max(x) - min(x) AS ptp FROM m GROUP BY ALL) SELECT unit, channel, round(ptp, 6) AS ptp FROM p QUALIFY row_number() OVER (PARTITION BY unit ORDER BY ptp DESC, channel) = 1")
def q_best_channel(spark, d):
    m = extraction.mean_waves(extraction.snippets(spike_places(spark, d), recording(spark, d), 16, 6, 24))
    return extraction.best_channel(m, ["unit"]).select("unit", "channel", r6("ptp", "ptp"))


@query()
def q_drift_matched(spark, d):
    r = recording(spark, d)
    s = extraction.time_batches(extraction.in_recording(spike_places(spark, d), r, 16, 6, 24))
    return extraction.drift_matched(extraction.snippets(s, r, 16, 6, 24, ["batch"]))


@query(f"WITH {WAVE}, v AS (SELECT unit, unnest(w) AS x, unnest(range(0, 64)) AS i FROM w), o AS (SELECT o, exp(-0.5 * (o / 2.0::DOUBLE) ^ 2) AS k FROM range(-8, 9) AS r(o)) SELECT a.unit, a.i, round(sum(b.x * k) / (SELECT sum(k) FROM o), 6) AS x FROM v a CROSS JOIN o JOIN v b ON b.unit = a.unit AND b.i = CASE WHEN a.i + o < 0 THEN -(a.i + o) - 1 WHEN a.i + o > 63 THEN 127 - (a.i + o) ELSE a.i + o END GROUP BY ALL")
def q_wave_smoothed(spark, d):
    return waveforms.smooth_arrays(waves(spark, d), "wave", 2.0).select("unit", F.posexplode("wave").alias("i", "x")).select("unit", F.col("i").cast("long").alias("i"), r6("x", "x"))


@query("""WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS w FROM embeddings), p AS (SELECT vec_id, w, k, pow(63.0::DOUBLE, k / 15.0::DOUBLE) AS p FROM w, range(0, 16) AS r(k)), f AS (SELECT *, floor(p)::BIGINT AS i FROM p)
SELECT vec_id, k, round(w[i + 1] + (coalesce(w[i + 2], w[i + 1]) - w[i + 1]) * (p - i), 6) AS x FROM f""")
def q_log_resampled(spark, d):
    w = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))
    return w.select("vec_id", F.posexplode(scalars.log_resampled(F.col("w"), 1.0, 1.0, 16)).alias("k", "x")).select("vec_id", F.col("k").cast("long").alias("k"), r6("x", "x"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS i FROM embeddings)
SELECT a.vec_id AS u1, b.vec_id AS u2, b.i - a.i AS lag, round(sum(a.x * b.x), 6) AS value FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 GROUP BY ALL""")
def q_cross_correlation(spark, d):
    w = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))
    pairs = w.select(F.col("vec_id").alias("u1"), (F.col("vec_id") + 1).alias("u2"), F.col("w").alias("x")).join(w.select(F.col("vec_id").alias("u2"), F.col("w").alias("y")), "u2")
    out = signals.cross_correlated(pairs.select("u1", "u2", "x", "y"))
    return out.select("u1", "u2", F.explode(F.arrays_zip("lags", "values")).alias("z")).select("u1", "u2", F.col("z.lags").alias("lag"), r6("z.values", "value"))


@query(f"WITH {SPIKES}, c AS (SELECT DISTINCT unit % 384 AS channel FROM s) SELECT channel, [43, 11, 59, 27][channel % 4 + 1]::INTEGER AS x, ((channel // 2) * 20 + 20)::INTEGER AS y, round((channel // 2 % 12) / 13.0::DOUBLE, 6) AS shift FROM c")
def q_channel_map(spark, d):
    places = arrays.channel_map(spark).withColumn("shift", F.round(scalars.adc_shift(F.col("channel")), 6))
    used = spikes(spark, d).select((F.col("unit") % 384).alias("channel")).distinct()
    return used.join(places, "channel")


# --- quality

@query(f"""WITH {SPIKES}, e AS (SELECT unit, min(a) AS lo, max(a) AS hi, count(*) AS size FROM s GROUP BY unit HAVING max(a) > min(a)), k AS (SELECT unit, least(floor((a - lo) / (hi - lo) * 500), 499)::BIGINT AS bin, count(*) AS n FROM s JOIN e USING (unit) GROUP BY ALL),
g AS (SELECT unit, size, bin, coalesce(n, 0) AS n FROM e CROSS JOIN (SELECT unnest(range(0, 500)) AS bin) LEFT JOIN k USING (unit, bin)), o AS (SELECT o, exp(-0.5 * (o / 3.0::DOUBLE) ^ 2) AS w FROM range(-12, 13) AS r(o)),
sm AS (SELECT a.unit, a.size, a.bin, round(sum(b.n * w) / (SELECT sum(w) FROM o), 9) AS p FROM g a CROSS JOIN o JOIN g b ON b.unit = a.unit AND b.bin = CASE WHEN a.bin + o < 0 THEN -(a.bin + o) - 1 WHEN a.bin + o >= 500 THEN 999 - (a.bin + o) ELSE a.bin + o END GROUP BY ALL),
t AS (SELECT unit, arg_max(bin, (p, -bin)) AS top, max(p) FILTER (bin = 0) AS p0 FROM sm GROUP BY unit), b AS (SELECT unit, arg_min(bin, (round(abs(p - p0), 9), bin)) AS begin FROM sm JOIN t USING (unit) WHERE bin >= top GROUP BY unit)
SELECT unit, round(least(sum(p) / any_value(size), 0.5), 6) AS missing FROM sm JOIN b USING (unit) WHERE bin >= begin GROUP BY unit""")
def q_amplitude_cutoff(spark, d):
    return quality.amplitude_cutoff(spikes(spark, d)).select("unit", r6("missing", "missing"))


POINTS = "p AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), c AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_samp(x, x) AS a, covar_samp(x, y) AS b, covar_samp(y, y) AS c FROM p GROUP BY label)"


@query(f"""WITH {POINTS}, f AS (SELECT c.label, n, row_number() OVER (PARTITION BY c.label ORDER BY (c * (x - mx) ^ 2 - 2 * b * (x - mx) * (y - my) + a * (y - my) ^ 2) / (a * c - b * b)) AS r, (c * (x - mx) ^ 2 - 2 * b * (x - mx) * (y - my) + a * (y - my) ^ 2) / (a * c - b * b) AS d FROM c JOIN p ON p.label <> c.label),
w AS (SELECT c.label, c.n, c.mx - avg(p.x) AS dx, c.my - avg(p.y) AS dy, count(*) AS k, c.a, c.b, c.c, covar_pop(p.x, p.x) AS oa, covar_pop(p.x, p.y) AS ob, covar_pop(p.y, p.y) AS oc FROM c JOIN p ON p.label <> c.label GROUP BY c.label, c.n, c.mx, c.my, c.a, c.b, c.c),
z AS (SELECT *, (n - 1) * a + k * oa AS sa, (n - 1) * b + k * ob AS sb, (n - 1) * c + k * oc AS sc FROM w), v AS (SELECT *, (sc * dx - sb * dy) / (sa * sc - sb * sb) AS vx, (sa * dy - sb * dx) / (sa * sc - sb * sb) AS vy FROM z),
dp AS (SELECT label, (vx * dx + vy * dy) / sqrt(0.5 * ((a * vx ^ 2 + 2 * b * vx * vy + c * vy ^ 2) * (n - 1) / n + oa * vx ^ 2 + 2 * ob * vx * vy + oc * vy ^ 2)) AS d_prime FROM v)
SELECT label, round(max(d) FILTER (r = n), 6) AS isolation, round(sum(exp(-d / 2)) / any_value(n), 6) AS l_ratio, round(any_value(d_prime), 6) AS d_prime FROM f JOIN dp USING (label) GROUP BY label""")
def q_separation(spark, d):
    e = table(spark, d, "embeddings")
    s = quality.separation(e.select(F.col("vec_id").alias("id"), "label", F.slice("embedding", 1, 2).cast("array<double>").alias("features")))
    return s.select("label", r6("isolation", "isolation"), r6("l_ratio", "l_ratio"), r6("d_prime", "d_prime"))


@query("WITH v AS (SELECT vec_id AS id, unnest(embedding::DOUBLE[]) AS v, unnest(range(0, 64)) AS c FROM embeddings) SELECT id, round(sum(c * v * v) FILTER (v > 0) / sum(v * v) FILTER (v > 0) * 10, 6) AS depth FROM v GROUP BY id")
def q_spike_depth(spark, d):
    f = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.sequence(F.lit(0), F.lit(63)).alias("channels"), F.col("embedding").cast("array<double>").alias("values"))
    return quality.spike_depth(f).select("id", r6("depth", "depth"))


@query()
def q_filtered_train(spark, d):
    return quality.filtered_train(spikes(spark, d).select("unit", "id", "t", "a"), START, HOUR, 2 * DAY, 3, 3 * DAY, 4, 0.05, 0.4).select("unit", "id")


# --- unit tables

QUALITIES = f"{SPIKES}, q AS (SELECT unit, CASE WHEN unit % 3 = 0 THEN 'good' WHEN unit % 3 = 1 THEN 'mua' ELSE 'noise' END AS grp, unit % 384 AS channel FROM (SELECT DISTINCT unit FROM s))"


def unit_table(spark, d):
    u = spikes(spark, d).select("unit").distinct()
    return u.select("unit", F.when(F.col("unit") % 3 == 0, "good").when(F.col("unit") % 3 == 1, "mua").otherwise("noise").alias("group"), (F.col("unit") % 384).alias("channel"), F.lit(1).alias("dataset"))


@query(f"WITH {QUALITIES} SELECT unit FROM q WHERE grp = 'good' AND channel BETWEEN 20 AND 90")
def q_good_units_in_range(spark, d):
    u = unit_table(spark, d)
    return units.units(u, "good", u, (20, 90))


@query(f"WITH {QUALITIES} SELECT unit, channel, row_number() OVER (ORDER BY channel DESC, unit) AS place FROM q")
def q_units_by_depth(spark, d):
    deep = units.by_depth(unit_table(spark, d)).withColumn("up", -F.col("channel"))
    return numbered(deep, "up", "unit").select("unit", "channel", (F.col("place") + 1).alias("place"))


@query(f"WITH {QUALITIES} SELECT unit, CASE WHEN unit % 10 = 0 THEN 'PkC' ELSE grp END AS label FROM q WHERE unit % 7 <> 0")
def q_neuron_labels(spark, d):
    store = unit_table(spark, d).withColumnRenamed("group", "label")
    labels = store.filter("unit % 10 = 0").select("dataset", "unit", F.lit("PkC").alias("label"))
    return units.without(units.relabelled(store, labels, ["PkC", "GoC"]), store.filter("unit % 7 = 0")).select("unit", "label")


@query(f"WITH {SPIKES} SELECT unit, t FROM s UNION ALL SELECT (SELECT max(unit) + 1 FROM s), t + 1 FROM s WHERE e = 'signup'")
def q_appended_unit(spark, d):
    s = spikes(spark, d)
    return units.append_unit(s.select("unit", "t"), s.filter("e = 'signup'").select((F.col("t") + 1).alias("t")))


@query(f"WITH {QUALITIES} SELECT d AS dataset, unit, grp AS \"group\" FROM q, (VALUES (0), (1)) AS v(d) WHERE d = 0 OR grp = 'good'")
def q_merged_qualities(spark, d):
    u = unit_table(spark, d).select("unit", "group")
    return units.merged_qualities({0: u, 1: u.filter("`group` = 'good'")})


@query("SELECT l_orderkey, l_linenumber, round((l_suppkey + l_linenumber / 10.0::DOUBLE) % 1 * 10)::BIGINT AS dataset, l_suppkey AS unit FROM lineitem")
def q_decoded_units(spark, d):
    u = F.col("l_suppkey") + F.col("l_linenumber") / 10.0
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in zip(("dataset", "unit"), units.decoded(u), strict=True)))


@query("SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) IS NOT NULL AS numeric, CASE WHEN lower(trim(o_orderstatus)) IN ('', '0', 'unlabeled', 'unlabelled') THEN NULL ELSE trim(o_orderstatus) END AS label FROM orders")
def q_labels(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalars.is_number(F.substring("o_orderpriority", 1, 1)).alias("numeric"), scalars.clean_label(F.col("o_orderstatus")).alias("label"))


# --- learning

@query("""WITH v AS (SELECT l_quantity AS v, (l_returnflag = 'R')::INT AS g FROM lineitem), s AS (SELECT v, count(*) FILTER (g = 0) AS a, count(*) FILTER (g = 1) AS b FROM v GROUP BY v), c AS (SELECT sum(a) OVER (ORDER BY v) / (SELECT sum(a) FROM s) - sum(b) OVER (ORDER BY v) / (SELECT sum(b) FROM s) AS x FROM s)
SELECT round(max(abs(x)), 6) AS d FROM c""")
def q_kolmogorov_smirnov(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_quantity").alias("v"), (F.col("l_returnflag") == "R").cast("int").alias("g"))
    return learning.kolmogorov_smirnov(x, "v", "g").select(r6("d", "d"))


@query("SELECT label, k % 5 AS fold, count(*) AS n FROM (SELECT quality AS label, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS k FROM labels) GROUP BY ALL")
def q_fold_sizes(spark, d):
    x = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return learning.folded(x, 5, "label").groupBy("label", F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


# --- streams over the same table

@query(f"WITH {SPIKES}, w AS (SELECT unit, (t // {12 * HOUR}) * 12 - k * 12 AS h FROM s, (VALUES (0), (1)) AS v(k)) SELECT unit, h, count(*) AS n FROM w GROUP BY ALL")
def q_stream_sliding_counts(spark, d):
    counts = drained(live.windowed_counts(live_events(spark, d), "1 day", "12 hours", late="40 days"), "update")
    return counts.groupBy("unit", F.floor(F.unix_micros("start") / HOUR).alias("h")).agg(F.max("n").alias("n"))


@query(f"WITH {SPIKES}, i AS (SELECT unit, t, CASE WHEN t - lag(t) OVER (PARTITION BY unit ORDER BY t) < {6 * HOUR} THEN 0 ELSE 1 END AS cut FROM s), r AS (SELECT unit, t, sum(cut) OVER (PARTITION BY unit ORDER BY t) AS k FROM i) SELECT unit, min(t) AS start, count(*) AS n FROM r GROUP BY unit, k")
def q_stream_bouts(spark, d):
    b = drained(live.bouts(live_events(spark, d), "6 hours", late="40 days"), "complete")
    return b.select("unit", F.unix_micros("start").alias("start"), "n")


@query(f"WITH {SPIKES} SELECT min(unit) AS unit, count(*) AS n FROM s GROUP BY unit")
def q_stream_distinct(spark, d):
    e = live_events(spark, d)
    return drained(live.distinct_events(e.unionByName(e), "id", late="40 days").select("unit", "id")).groupBy("unit").agg(F.count("*").alias("n"))
