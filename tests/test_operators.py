"""Small fixtures worked out by hand, and laws that hold for any train."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewave.functions.timeline import as_of, islands, numbered, range_join
from tidewave.operators import alignment, correlograms, information, models, neighbours, periods, quality, trains, waveforms


def train(spark, times, unit=1):
    return spark.createDataFrame([(unit, t, i, float(i)) for i, t in enumerate(times)], "unit long, t long, id long, a double")


def times(df, column="t"):
    return sorted(r[column] for r in df.collect())


def test_refractory_gap_is_to_the_spike_before(spark):
    assert times(trains.enforce_refractory(train(spark, [0, 10, 12, 40, 41, 41, 100]), 2)) == [0, 10, 40, 100]


def two_units(spark):
    return train(spark, [100, 200], 1).unionByName(train(spark, [105, 121, 180, 195, 200, 230], 2))


def test_half_correlogram(spark):
    got = {(r.u1, r.u2, r.bin): r.n for r in correlograms.half_counts(two_units(spark), 10, 2).collect()}
    table = lambda a, b: [got.get((a, b, k), 0) for k in range(3)]
    assert (table(1, 2), table(2, 1), table(2, 2)) == ([2, 0, 1], [1, 0, 1], [1, 2, 1])


def test_symmetric_correlogram(spark):
    full = correlograms.symmetric(correlograms.half_counts(two_units(spark), 10, 2))
    got = {(r.u1, r.u2, r.bin): r.n for r in correlograms.dense_bins(full, 2).collect()}
    assert [got[1, 2, k] for k in range(-2, 3)] == [1, 0, 2, 0, 1]
    assert [got[2, 2, k] for k in range(-2, 3)] == [1, 2, 0, 2, 1]
    assert all(got[2, 1, -k] == got[1, 2, k] for k in range(-2, 3))


def test_reach_of_the_last_bin(spark):
    df = train(spark, [0], 1).unionByName(train(spark, [29, 30], 2))
    assert [(r.bin, r.n) for r in correlograms.half_counts(df, 10, 2).filter("u1 = 1").collect()] == [(2, 1)]


def test_cross_intervals(spark):
    a, b = train(spark, [10, 50, 90]), train(spark, [0, 48, 50, 100]).select("unit", "t")
    want = {1: [38, 0, 10], -1: [10, 0, 40], 0: [10, 0, 10]}
    for direction, values in want.items():
        assert [r.interval for r in neighbours.cross_intervals(a, b, direction).orderBy("t").collect()] == values


def test_as_of_without_neighbours(spark):
    rows = as_of(train(spark, [5]), train(spark, [], 1).select("unit", "t")).collect()
    assert [(r.previous, r.next) for r in rows] == [(None, None)]


def test_good_sections(spark):
    flags = [0, 1, 1, 0, 1, 0, 1, 1, 1]
    df = spark.createDataFrame([(1, t, bool(f)) for t, f in enumerate(flags)], "unit long, t long, flag boolean")
    assert sorted((r.start, r.stop) for r in periods.runs(df, "flag", 2).collect()) == [(1, 2), (6, 8)]


def test_runs_at_the_edges(spark):
    values = [1, 2, 3, 4, 5, 4, 3, 2, 1, 2, 3, 4, 5]
    df = spark.createDataFrame([(1, t, v >= 3) for t, v in enumerate(values)], "unit long, t long, flag boolean")
    assert [(r.start, r.stop) for r in periods.runs(df, "flag", 2, edges=False).collect()] == [(2, 6)]
    assert sorted((r.start, r.stop) for r in periods.runs(df, "flag", 2).collect()) == [(2, 6), (10, 12)]


def spans(spark, rows):
    return spark.createDataFrame([(1, a, b) for a, b in rows], "unit long, start long, stop long")


def pairs(df):
    return sorted((r.start, r.stop) for r in df.collect())


def test_intersection_and_complement(spark):
    a, b = spans(spark, [(0, 10), (20, 30)]), spans(spark, [(5, 25)])
    assert pairs(periods.intersection(a.unionByName(b), 2)) == [(5, 10), (20, 25)]
    assert pairs(periods.intersection(a.unionByName(a), 2)) == pairs(a)
    once = periods.complement(a, 0, 40)
    assert pairs(once) == [(10, 20), (30, 40)]
    assert pairs(periods.complement(once, 0, 40)) == pairs(a)


def test_periods_are_closed(spark):
    assert times(periods.inside(train(spark, [1, 5, 10, 11]), spans(spark, [(5, 10)]))) == [5, 10]


def test_aligned_counts_close_the_last_bin(spark):
    events = spark.createDataFrame([(1, 7, 100)], "unit long, event_id long, event long")
    got = alignment.aligned_counts(events, train(spark, [97, 98, 99, 100, 102, 103]), -2, 2, 1).collect()
    assert sorted((r.bin, r.n) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 1)]


def test_isolated(spark):
    assert times(trains.isolated(train(spark, [0, 20, 25, 60, 90, 95]), 10)) == [60]


def test_n_consecutive(spark):
    df = spark.createDataFrame([(1, t, bool(f)) for t, f in enumerate([0, 1, 1, 0, 1, 1, 1])], "unit long, t long, flag boolean")
    assert pairs(periods.runs(df, "flag", 3)) == [(4, 6)]


def test_clock(spark):
    sync = spark.createDataFrame([("d", a, b) for a, b in ((0, 10), (100, 110), (200, 210))], "dataset string, own long, reference long")
    df = spark.createDataFrame([("d", 3, 50)], "dataset string, unit long, t long")
    assert alignment.merge_datasets(df, alignment.clock_fit(sync)).first().t == 60


def test_presence(spark):
    assert trains.presence_ratio(train(spark, range(0, 991, 10)), 0, 990).first().presence == pytest.approx(0.99)


def test_vote(spark):
    p = [(1, c, m, v) for m, row in enumerate(([0.6, 0.4], [0.2, 0.8], [0.7, 0.3])) for c, v in enumerate(row)]
    r = models.ensemble_vote(spark.createDataFrame(p, "unit long, class long, model long, p double")).first()
    assert (r.prediction, r.votes) == (0, 2) and r.confidence == pytest.approx(0.5) and r.delta == pytest.approx(0) and r.ratio == pytest.approx(1)


def test_time_shift_leaves_correlograms_alone(spark):
    a = correlograms.half_counts(two_units(spark), 10, 2)
    b = correlograms.half_counts(two_units(spark).withColumn("t", F.col("t") + 12345), 10, 2)
    assert sorted(a.collect()) == sorted(b.collect())


def test_range_join_meets_each_pair_once(spark):
    rng = np.random.default_rng(3)
    x, y = sorted(rng.integers(-500, 500, 60).tolist()), sorted(rng.integers(-500, 500, 60).tolist())
    a = spark.createDataFrame([(i, t) for i, t in enumerate(x)], "i long, t1 long")
    b = spark.createDataFrame([(j, t) for j, t in enumerate(y)], "j long, t2 long")
    got = sorted((r.i, r.j) for r in range_join(a, b, 37).collect())
    assert got == sorted((i, j) for i, s in enumerate(x) for j, t in enumerate(y) if 0 <= t - s < 37)


def test_islands_number_runs(spark):
    df = spark.createDataFrame([(1, t, f) for t, f in enumerate("aabbbа")], "unit long, t long, f string")
    assert [r.run for r in islands(df, "f", ["unit"], ["t"]).orderBy("t").collect()] == [0, 0, 1, 1, 1, 2]


def test_ridge_solves(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 3 + x @ [2.0, -1.0]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    assert models.ridge(df, ["a", "b"], "y") == pytest.approx([3, 2, -1])


def test_poisson_sums(spark):
    k = spark.range(0, 30)
    rows = k.select("id", models.poisson_pmf(F.col("id"), F.lit(4.5)).alias("p"), models.poisson_cdf(F.col("id"), F.lit(4.5)).alias("c")).orderBy("id").collect()
    assert np.cumsum([r.p for r in rows]) == pytest.approx([r.c for r in rows])
    assert rows[-1].c == pytest.approx(1)


def test_independent_units_share_no_information(spark):
    rows = [(u, b, (b >> i) & 1) for b in range(8) for i, u in enumerate("xyz")]
    r = information.total_correlation(spark.createDataFrame(rows, "unit string, bin long, x int")).first()
    assert r.h == pytest.approx(3 * np.log(2)) and r.total_correlation == pytest.approx(0, abs=1e-9)


def test_neighbours_by_blocks(spark):
    rng = np.random.default_rng(1)
    pts = [(i, i % 2, (rng.normal(size=3) + 3 * (i % 2)).tolist()) for i in range(60)]
    df = spark.createDataFrame(pts, "id long, label long, features array<double>")
    got = {r.label: (r.hit, r.miss) for r in quality.neighbour_rates(df, df, 3, query_block=25, point_block=15).collect()}
    x = np.array([p[2] for p in pts])
    lab = np.array([p[1] for p in pts])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :3]
    for k in (0, 1):
        assert got[k] == pytest.approx(((lab[near[lab == k]] == k).mean(), (lab[near[lab != k]] == k).mean()))


def test_extremes_and_widths():
    y = np.array([0, 1, 3, 1, -2, -4, -1, 0, 2, 0.0])
    assert waveforms.alternating_extremes(y, 1.5) == ([2, 8], [0, 5])
    assert waveforms.half_width(y, 5) == 2


def test_smoothing_keeps_lengths_and_sums(spark):
    df = spark.createDataFrame([(1, [0.0] * 20 + [1.0] + [0.0] * 20), (2, [])], "unit long, wave array<double>")
    rows = {r.unit: r.wave for r in waveforms.smooth_arrays(df, "wave", 2.0).collect()}
    assert len(rows[1]) == 41 and sum(rows[1]) == pytest.approx(1) and rows[2] == []


def test_places_in_order_of_parts(spark):
    rng = np.random.default_rng(12)
    rows = [(int(i), None if i % 97 == 0 else float(v)) for i, v in enumerate(np.append(rng.normal(size=900), np.full(400, 0.25)))]
    df = spark.createDataFrame(rows, "id long, v double").repartition(6)
    got = {r.id: r.place for r in numbered(df, "v", "id", parts=20).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert got == {r[0]: k for k, r in enumerate(want)}
    assert numbered(df.filter(F.col("id") < 0), "v", "id").count() == 0
    assert sorted(r.place for r in numbered(df.filter("v = 0.25"), "v", "id").collect()) == list(range(df.filter("v = 0.25").count()))


def test_a_burst_of_all_units_uses_many_tasks(spark):
    from tidewave.functions.timeline import range_join
    from tidewave.operators import correlograms

    df = spark.createDataFrame([(i % 50, i, 5_000 + i % 7) for i in range(2_000)] + [(1, 9_000, 90_000), (2, 9_001, 90_003)], "unit long, id long, t long")
    whole = correlograms.half_counts(df, 10, 9, most=1 << 40).collect()
    assert sorted(map(tuple, correlograms.half_counts(df, 10, 9, most=100).collect())) == sorted(map(tuple, whole)) and len(whole) > 1_000
    left, right = df.select("unit", "id", F.col("t").alias("t1")), df.select(F.col("unit").alias("u2"), F.col("t").alias("t2"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = lambda most: range_join(left, right, 100, most=most).groupBy(F.spark_partition_id()).count().count()
        assert tasks(100) > 4 >= 2 >= tasks(1 << 40)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
