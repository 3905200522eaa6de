"""Peaks of known tones, bursts, subsets, modulations and graphs against plain code."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewave.operators import connections, correlograms, peaks, rates, trains


def tone(cycle, n=400, phase=0.7):
    t = np.arange(n)
    y = np.cos(2 * np.pi * t / cycle + phase)
    tops = (np.arange(-2, n) * cycle) - phase * cycle / (2 * np.pi)
    return y, tops, tops + cycle / 2


@pytest.mark.parametrize("method", [m for m in peaks.METHODS if m != "samples"])
@pytest.mark.parametrize("cycle", [20.0, 33.3, 47.9])
def test_places_of_tones_to_a_hundredth_of_a_sample(spark, method, cycle):
    # the spectrum's way is for periodic waves
    n = round(400 / cycle) * cycle if method != "spectrum" else 400
    cycle = 400 / round(400 / cycle) if method == "spectrum" else cycle
    y, tops, bottoms = tone(cycle, int(n))
    df = spark.createDataFrame([(1, y.tolist())], "unit long, wave array<double>")
    rows = [r for r in peaks.find_peaks(df, method, delta=0.5).collect() if cycle < r.place < len(y) - cycle]
    assert len(rows) >= 2 * (len(y) / cycle - 3)
    for r in rows:
        known = tops if r.kind == 1 else bottoms
        assert np.abs(known - r.place).min() < 0.01, (method, r)
        assert r.value == pytest.approx(r.kind, abs=0.01)


def test_samples_and_edges(spark):
    df = spark.createDataFrame([(1, [0.0, 3.0, 1.0, 2.0, 0.5]), (2, []), (3, None), (4, [1.0, 2.0]), (5, [1.0] * 9), (6, [0.0, 1.0, 0.0])], "unit long, wave array<double>")
    got = sorted((r.unit, r.kind, r.place, r.value) for r in peaks.find_peaks(df, "samples").collect())
    assert got == [(1, -1, 2.0, 1.0), (1, 1, 1.0, 3.0), (1, 1, 3.0, 2.0), (6, 1, 1.0, 1.0)]
    assert [r.place for r in peaks.find_peaks(df.filter("unit = 1"), "samples", lookahead=2).filter("kind = 1").collect()] == [1.0, 3.0]
    with pytest.raises(ValueError):
        peaks.find_peaks(df, "another")


@pytest.mark.parametrize("method", peaks.METHODS)
def test_every_method_takes_awkward_waves(spark, method):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=n).tolist()) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 12, 13, 30, 64])] + [(90, [2.0] * 20), (91, None), (92, [0.0] * 10 + [1.0] + [0.0] * 10)]
    out = peaks.find_peaks(spark.createDataFrame(rows, "unit long, wave array<double>"), method).collect()
    assert all(math.isfinite(r.place) and math.isfinite(r.value) for r in out)


def test_spaced_peaks():
    y = np.array([0, 5, 0, 4, 4, 4, 0, 6, 0, 1, 0, 6.0, 0])
    assert peaks.spaced_peaks(y, 0, 1).tolist() == [1, 4, 7, 9, 11]
    assert peaks.spaced_peaks(y, 2, 1).tolist() == [1, 4, 7, 11]
    assert peaks.spaced_peaks(y, 0, 4).tolist() == [1, 7, 11]
    assert peaks.spaced_peaks(y, 0, 5).tolist() == [1, 11]  # of 7 and 11, equally high, the later stays
    assert peaks.spaced_peaks(np.ones(5), 0, 1).tolist() == [] and peaks.spaced_peaks(np.zeros(0), 0, 1).tolist() == []


def test_bursts_and_oscillations_of_a_known_train(spark):
    # 400 bursts of three spikes 2 apart, every 40 ticks
    t = [k * 40 + 2 * i for k in range(400) for i in range(3)]
    df = spark.createDataFrame([(i, 1, x) for i, x in enumerate(t)], "id long, unit long, t long")
    c = rates.autocorrelogram_curves(df, 1, 100, 1000.0).first()
    gaps = np.subtract.outer(t, t)
    want = [0.0] + [(gaps == k).sum() / len(t) * 1000 for k in range(1, 101)]
    assert c.acg == pytest.approx(want)
    isi = np.diff(t)
    assert c.mfr == pytest.approx(1000 / isi[isi <= np.quantile(isi, 0.98)].mean())
    flat = spark.createDataFrame([(1, [0.0, 1.0, 4.0, 1.0] + [0.0] * 36 + [0.5, 3.0, 0.5] + [0.0] * 20, 2.0), (2, [1.0] * 50, 1.0)], "unit long, acg array<double>, mfr double")
    got = {r.unit: (r.burst, r.oscillation) for r in peaks.bursts_and_oscillations(flat, 10).collect()}
    assert got == {1: (2.0, 1.5), 2: (1.0, 1.0)}  # too little deviation for any smoothing


def test_smoothing_by_the_data():
    y = np.zeros(101)
    y[50] = 400.0
    sd = np.std(y) / 10
    out = peaks.smoothed_by_data(y)
    assert out.sum() == pytest.approx(400) and math.sqrt((out / 400 * (np.arange(101) - 50) ** 2).sum()) == pytest.approx(sd, rel=0.05)


@pytest.mark.parametrize("n", [5, 19, 20, 21, 100, 399])
def test_batches_lie_evenly(spark, n):
    df = spark.createDataFrame([(i, 1, i * 3) for i in range(n)], "id long, unit long, t long")
    got = sorted(r.id for r in trains.batched_subset(df, 20, 5).collect())
    if n <= 20:
        assert got == list(range(n))
    else:
        step = max((n - 5) // 3, 5)
        assert got == sorted({k for i in range(4) for k in range(i * step, min(i * step + 5, n))})
    single = sorted(r.id for r in trains.batched_subset(df, 20, None).collect())
    assert single == list(range(n))[:: max(1, -(-n // 20))][:20]
    with pytest.raises(ValueError):
        trains.batched_subset(df, 9, 5)


def test_random_subsets_of_any_partitioning(spark):
    df = spark.createDataFrame([(i, i % 3, i) for i in range(900)] + [(1000, 7, 1)], "id long, unit long, t long")
    one = sorted(r.id for r in trains.random_subset(df, 50, 1).collect())
    assert len(one) == 151 and one == sorted(r.id for r in trains.random_subset(df.repartition(9, "t"), 50, 1).collect())
    assert one != sorted(r.id for r in trains.random_subset(df, 50, 2).collect())
    assert abs(np.mean([i for i in one if i < 900]) - 450) < 4 * 900 / math.sqrt(12 * 150)


def test_modulations_and_graph(spark):
    z = [0, 0, 3, 4, 4, 0, -2, -5, -2, 0, 0]  # bins -5 to 5
    rows = [(2, 1, k - 5, float(v)) for k, v in enumerate(z)] + [(1, 2, 5 - k, float(v)) for k, v in enumerate(z)]
    bins = connections.normal_sides(spark.createDataFrame(rows, "u1 long, u2 long, bin long, z double"), 1.5)
    m = connections.modulation_features(bins, "z", 0.5, 2, 5)
    got = {(r.u1, r.u2, r.left): r for r in m.collect()}
    assert len(got) == 4
    up, down = got[2, 1, -1.5], got[2, 1, 0.5]
    assert (up.right, up.amplitude, up.at, up.triplets, up.crossing, up.height) == (0.0, 4.0, -1.0, 1, 3, pytest.approx(11 / 3))
    assert (down.right, down.amplitude, down.at) == (2.0, -5.0, 1.0)
    density = lambda x: math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    assert up.entropy == pytest.approx(-np.mean([math.log(density(x)) for x in (3, 4, 4)]))
    edges = connections.edges(m)
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 1.0, 4.0), (2, 1, 1.0, -5.0)]
    assert [tuple(r) for r in connections.main_edges(edges).collect()] == [(2, 1, 1.0, -5.0)]
    assert [tuple(r) for r in connections.edges(m, sign=1).collect()] == [(1, 2, 1.0, 4.0)]
    assert connections.edges(m, low=2.0).count() == 0 and connections.edges(m, least=4.5).count() == 1
    assert {r.unit: (r.n_out, r.n_in, r.strength) for r in connections.degrees(edges).collect()} == {1: (1, 1, 9.0), 2: (1, 1, 9.0)}


def test_runs_at_the_ends_count_on_request(spark):
    rows = [(2, 1, k, 3.0) for k in range(-3, 0)] + [(2, 1, k, 0.0) for k in range(0, 4)]
    bins = connections.normal_sides(spark.createDataFrame(rows, "u1 long, u2 long, bin long, z double"), 1.5)
    assert connections.modulation_features(bins, "z", 1.0, 2, 3).count() == 0
    assert connections.modulation_features(bins, "z", 1.0, 2, 3, edges=True).count() == 1


def test_poisson_sides_of_a_planted_lag(spark):
    from tidewave.operators import significance

    rng = np.random.default_rng(3)
    a = np.sort(rng.integers(0, 400_000, 3_000))
    rows = [(i, 1, int(t)) for i, t in enumerate(a)] + [(10_000 + i, 2, int(t)) for i, t in enumerate(rng.integers(0, 400_000, 3_000))] + [(20_000 + i, 2, int(t) + 35) for i, t in enumerate(a[::4])]
    df = spark.createDataFrame(rows, "id long, unit long, t long")
    full = correlograms.dense_bins(correlograms.symmetric(correlograms.half_counts(df, 10, 20)), 20)
    tested = connections.poisson_sides(significance.poisson_test(full, 8, 20).filter(F.col("u1") != F.col("u2")), 0.001)
    m = connections.modulation_features(tested, "deviation", 1.0, 1, 20)
    assert [(r.source, r.target, r.lag) for r in connections.main_edges(connections.edges(m, sign=1)).collect()] == [(1, 2, 3.0)]
    runs = significance.poisson_modulations(tested, 0.001, 1, 20).filter("u1 = 1 AND u2 = 2 AND side = 1").collect()
    assert [(r.first, r.last, r.n) for r in runs] == [(3, 3, 1)] and runs[0].deviation > 5
