"""Laws, decompositions, noise, population synchrony, merged sets and the store against numpy, brute force and known values."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_signals_and_rates import signal, whole
from tidewave.operators import alignment, distributions, extraction, linear, neighbours, signals
from tidewave.sources import merged, store, tables, units


def test_fractiles_on_the_grid(spark):
    row = spark.range(1).select(distributions.normal_fractile(0.975).alias("a"), distributions.normal_fractile(0.5, 3.0, 2.0).alias("b"), distributions.normal_fractile(1.0).alias("c")).first()
    assert row.a == 1.96 and row.b == 3.0 and row.c is None
    rates = spark.createDataFrame([(x,) for x in (0.0, 0.2, 1.0, 3.7, 40.0, 900.0)], "rate double")
    for r in rates.select("rate", distributions.poisson_fractile(0.975, F.col("rate")).alias("k")).collect():
        total, want = 0.0, None
        for k in range(math.ceil(4 * r.rate) + 1 if r.rate else 0):
            total += math.exp(k * math.log(r.rate) - r.rate - math.lgamma(k + 1))
            want = k if want is None and total >= 0.975 else want
        assert r.k == want


def test_normality(spark):
    rng = np.random.default_rng(4)
    sets = {1: rng.normal(2, 3, 4_000), 2: rng.exponential(1, 400), 3: np.zeros(20), 4: np.arange(7.0), 5: np.round(rng.normal(0, 1, 300), 1), 6: np.array([5.0])}
    df = spark.createDataFrame([(u, float(x)) for u, xs in sets.items() for x in xs] + [(1, None)], "unit long, v double")
    tails = {r.unit: r for r in distributions.skewness_and_tails(df, "v").collect()}
    assert tails[1].n == 4_000 and tails[1].p > 0.01 and tails[2].p < 1e-20 and tails[3].k2 is None and tails[4].p is None
    law = NormalDist()
    for r in distributions.distance_from_normal(df, "v").collect():
        x = np.sort(sets[r.unit])
        n = len(x)
        cdf = np.array([law.cdf(v) for v in x])
        assert r.d == pytest.approx(max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max()), abs=1e-9)
        if r.unit in (3, 6):
            assert r.a2 is None
            continue
        y = (x - x.mean()) / x.std(ddof=1)
        up = [math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in y]
        down = [math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in y]
        assert r.a2 == pytest.approx(-n - sum((2 * i + 1) * (up[i] + down[n - 1 - i]) for i in range(n)) / n, rel=1e-6)
    z = spark.createDataFrame([(float(x),) for x in np.linspace(-30, 8, 77)], "z double").select("z", distributions.log_normal_cdf(F.col("z")).alias("l")).collect()
    assert all(r.l == pytest.approx(math.log(0.5 * math.erfc(-r.z / math.sqrt(2))), rel=1e-9, abs=1e-12) for r in z)


@pytest.mark.parametrize("shape", [(40, 6), (5, 6), (30, 1)])
def test_economy_decomposition(spark, shape):
    x = np.random.default_rng(3).normal(size=shape) * np.arange(1, shape[1] + 1)
    points = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>")
    u, s, v = linear.decomposed(points)
    u = np.stack([r.u for r in u.orderBy("id").collect()])
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False)) and np.allclose(u * s @ v.T, x) and np.allclose(u.T @ u, np.eye(len(s)), atol=1e-6)
    two, s2, _ = linear.decomposed(points, 2)
    assert np.allclose(s2, s[:2]) and np.allclose([r.u for r in two.orderBy("id").collect()], u[:, :2])


def test_decomposition_of_nothing_and_of_low_rank(spark):
    empty = spark.createDataFrame([], "id long, x array<double>")
    u, s, v = linear.decomposed(empty)
    assert u.count() == 0 and len(s) == 0 and v.size == 0
    low = np.outer(np.arange(1, 9.0), [1, 2, 3])
    u, s, v = linear.decomposed(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(low)], "id long, x array<double>"))
    assert len(s) == 1 and s[0] == pytest.approx(np.linalg.norm(low))


@pytest.mark.parametrize("method", ["zca", "pca", "cholesky", "zca_cor", "pca_cor"])
@pytest.mark.parametrize("size", [7, 500])
def test_whitening_methods(spark, method, size):
    mix = np.random.default_rng(5).normal(size=(4, 4))
    x = mix @ np.random.default_rng(6).normal(size=(4, 500)) + 10
    got = whole(signals.whitened(signal(spark, x, size), method, 0.0))
    assert np.allclose(np.cov(got, bias=True), np.eye(4), atol=1e-6)
    w = linear.whitening(np.cov(x, bias=True), method, 0.0)
    assert np.allclose(got, w @ (x - x.mean(axis=1, keepdims=True)), atol=1e-6)
    if method == "zca":
        assert np.allclose(w, w.T)
    if method == "cholesky":
        assert np.allclose(w, np.triu(w))
    with pytest.raises(ValueError):
        linear.whitening(np.eye(2), "other")


def test_sampled_covariance_ignores_odd_chunks(spark):
    x = np.random.default_rng(7).normal(size=(3, 60)) * np.array([[1], [2], [3]])
    x[:, 20:30] *= 1_000
    z = [c - c.mean(axis=0) for c in np.split(x, 6, axis=1)]
    for every in (1, 2):
        want = np.median([c @ c.T / 10 for c in z[::every]], axis=0)
        got = signals.median_covariance(signal(spark, x, 10), every)
        assert all(r.covariance == pytest.approx(want[r.c1, r.c2]) for r in got.collect())
        assert signals.whitening_of(got, near=1).shape == (3, 3)
    full = linear.completed(np.full((2, 2), 5.0), [7, 2], [2, 5, 7])
    assert full.tolist() == [[5, 0, 5], [0, 1, 0], [5, 0, 5]]


def test_ratio_to_noise_along_the_mean_wave(spark):
    rng = np.random.default_rng(8)
    shape = np.array([[0, 1, 0, 0.0], [0, 9, -4, 0], [0, 3, -1, 0], [2, 0, 0, 0]])
    waves = shape + rng.normal(0, 0.3, (30, 4, 4))
    noise = rng.normal(0, 1, (25, 4, 4))
    rows = lambda x, m: spark.createDataFrame([(m, i, c, w.tolist()) for i, one in enumerate(x) for c, w in enumerate(one)], "unit long, id long, channel long, wave array<double>")
    mean = waves.mean(axis=0)
    s, n = ((x[:, :3] * mean[:3]).sum(axis=(1, 2)) for x in (waves, noise))
    got = extraction.template_ratio(rows(waves, 1), rows(noise, 1), half=1).first()
    assert got.snr == pytest.approx((s.mean() - n.mean()) / n.std())
    assert extraction.template_ratio(rows(waves, 1), rows(noise * 0, 1)).first().snr is None
    t = spark.range(500).select(F.lit(1).alias("unit"), "id", F.lit(1_000).cast("long").alias("t"))
    moved = [r.t for r in extraction.moved_times(t, 40).collect()]
    assert min(moved) >= 960 and max(moved) < 1_040 and len(set(moved)) > 60 and moved == [r.t for r in extraction.moved_times(t.repartition(7), 40).orderBy("id").collect()]


def brute_fraction(t, trains, periods, half):
    on = [u for u in periods if any(a <= t <= b for a, b in periods[u])]
    return sum(any(abs(x - t) <= half for x in trains.get(u, [])) for u in on) / len(on) if on else None


@pytest.mark.parametrize("width", [1, 13, 10_000])
def test_synchrony_among_firing_trains(spark, width):
    rng = np.random.default_rng(9)
    trains = {u: sorted(rng.integers(0, 300, 12).tolist()) for u in range(6)}
    periods = {u: [(20 * u, min(20 * u + 60, 149)), (150, 200 + u)] for u in range(6)} | {9: [(0, 10)]}
    at = [(i, int(t)) for i, t in enumerate([*rng.integers(-20, 320, 60), 20, 60, 150, 150, 200, 299])]
    df = spark.createDataFrame([(u, t) for u, x in trains.items() for t in x], "unit long, t long")
    ps = spark.createDataFrame([(u, a, b) for u, x in periods.items() for a, b in x], "unit long, start long, stop long")
    got = {r.id: r.fraction for r in neighbours.cofiring_synchrony(spark.createDataFrame(at, "id long, t long"), df, ps, 4, width).collect()}
    assert got == {i: pytest.approx(brute_fraction(t, trains, periods, 4)) if brute_fraction(t, trains, periods, 4) is not None else None for i, t in at}
    events = spark.createDataFrame([(0, 100), (1, 170)], "event_id long, event long")
    near = {u: [t for t in x if any(abs(t - e) <= 20 for e in (100, 170))] for u, x in trains.items()}
    trials = alignment.population_synchrony_trials(events, df, ps, -20, 20, 10, 5, 4, width).collect()
    assert len(trials) == 8
    for r in trials:
        e = (100, 170)[r.event_id]
        assert r.n == pytest.approx(np.mean([brute_fraction(e - 20 + 10 * r.bin + 2 * k, near, periods, 4) for k in range(5)]))
    with pytest.raises(ValueError):
        alignment.population_synchrony_trials(events, df, ps, -20, 20, 10, 1, 4, width)


def test_merged_sets(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "a.meta").write_text(f"~imroTbl=(0,384)(0 0 0 500 250 {k})(1 0 0 500 250 {k})\nnSavedChans=38{k}\n")
    sets = spark.createDataFrame([(0, str(tmp_path / "d0"), "probe1"), (1, str(tmp_path / "d1"), "probe2")], "dataset long, dp string, probe string")
    meta = merged.merged_metadata(spark, sets)
    assert {(r.probe, r.value) for r in meta.filter("key = 'nSavedChans'").collect()} == {("probe1", "380"), ("probe2", "381")}
    assert sorted(r.filtered for r in merged.hardware_filtered(meta).collect()) == [False, True]
    u = spark.createDataFrame([(12.1,), (3.0,), (7.5,), (0.1,)], "unit double")
    assert {(r.unit, r.dataset, r.source_unit, r.dp and r.dp[-2:]) for r in merged.with_sources(u, sets).collect()} == {(12.1, 1, 12, "d1"), (3.0, 0, 3, "d0"), (7.5, 5, 7, None), (0.1, 1, 0, "d1")}
    assert not merged.same_dataset(u).first().same and merged.same_dataset(u.filter("unit IN (12.1, 0.1)")).first().same and merged.same_dataset(u.limit(0)).first().same
    names = spark.createDataFrame([("/a/merged_x/",), ("/merged/b",)], "p string").select(merged.is_merged(F.col("p")).alias("m"))
    assert [r.m for r in names.collect()] == [True, False]


def test_rebuilt_channel_maps(spark):
    def of(xs):
        df = spark.createDataFrame(list(enumerate(map(float, xs))), "channel long, x double")
        return [r.y for r in merged.rebuilt_map(df).orderBy("channel").collect()]

    assert of([43.0, 11, 59, 27, 43]) == [0, 20, 20, 40, 40] and of([11.0, 59, 27, 43]) == [0, 0, 20, 20]
    assert of([0.0, 32, 0]) == [0, 0, 15] and of([32.0, 0, 32]) == [0, 15, 15]
    with pytest.raises(Exception, match="no probe"):
        of([1.0, 2.0])


def test_the_neuron_store(spark, tmp_path):
    spikes = spark.createDataFrame([("d", 1, 9), ("d", 1, 3), ("d", 2, 5), ("e", 1, 7), ("d", 8, 1)], "dataset string, unit long, t long")
    registry = spark.createDataFrame([("d", "MLI", "l", [1, 2, 4], [1], [1, 2]), ("e", "GoC", None, [1], [], None)], "dataset string, ct string, line string, units array<int>, ss array<int>, cs array<int>")
    listed = store.listed_units(registry)
    assert {(r.dataset, r.unit, r.label) for r in listed.collect()} == {("d", 1, "PkC_ss"), ("d", 2, "PkC_cs"), ("d", 4, "MLI"), ("e", 1, "GoC")}
    periods = spark.createDataFrame([("d", 1, 0, 3), ("d", 1, 20, 30)], "dataset string, unit long, start long, stop long")
    waves = spark.createDataFrame([("d", 1, 1, [1.0]), ("d", 1, 0, [0.0])], "dataset string, unit long, channel long, wave array<double>")
    rows = store.neurons(spikes, listed, "lab", waves, periods)
    assert {(r.dataset, r.unit): (r.spike_times, r.sane, r.mean_waves and [w.channel for w in r.mean_waves]) for r in rows.collect()} == {
        ("d", 1): ([3, 9], [True, False], [0, 1]), ("d", 2): ([5], [False], None), ("e", 1): ([7], [False], None)}
    path = str(tmp_path / "store")
    units.add_neurons(path, rows)
    disk = spark.read.parquet(path)
    assert store.field(disk, "lab/d/1/spike_times").first().value == [3, 9] and store.field(disk, "datasets/e/1/label").first().value == "GoC"
    assert store.field(disk, "other/d/1/label").count() == 0
    with pytest.raises(KeyError):
        store.field(disk, "lab/d/1/nothing")
    plan = store.field(disk, "lab/d/1/spike_times")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(unit,1)" in plan and "mean_waves" not in plan
    new = store.neurons(spikes.withColumn("t", F.col("t") + 1), listed, "lab").withColumn("extra", F.lit(1))
    some = {(r.dataset, r.unit): r for r in store.renewed(disk, new.filter("dataset = 'd'"), ["sane", "extra"]).collect()}
    assert some["d", 1].spike_times == [3, 9] and some["d", 1].sane == [True, True] and some["d", 1].extra == 1 and some["e", 1].extra is None and some["e", 1].sane == [False]
    whole_rows = store.renewed(disk, new.filter("unit = 2")).collect()
    assert len(whole_rows) == 3 and {r.unit: r.spike_times for r in whole_rows if r.dataset == "d"} == {1: [3, 9], 2: [6]}
    assert store.contents(store.renewed(disk.limit(0), new)).count() == 3


def test_measures_for_curation_and_channel_parts(spark, tmp_path):
    names = store.write_measures(spark.createDataFrame([(2, 0.5, "x"), (1, None, "y")], "unit long, snr double, type string"), str(tmp_path))
    assert [tables.read_tsv(spark, n, f"cluster_id long, v {k}").orderBy("cluster_id").collect()[1].v for n, k in zip(names, ("double", "string"), strict=True)] == [0.5, "x"]
    x = np.arange(3_000, dtype="<i2").reshape(1_000, 3)
    x.tofile(tmp_path / "a.bin")
    chunks = tables.read_samples(spark, str(tmp_path / "a.bin"), 3, frames=128)
    assert store.write_channels(chunks, str(tmp_path / "part"), 3, 1, 2) == (8, 4_000)
    parts = b"".join(p.read_bytes() for p in sorted((tmp_path / "part").iterdir()))
    assert parts == x[:, 1:].tobytes()
    with pytest.raises(ValueError):
        store.write_channels(chunks, str(tmp_path / "no"), 3, 1, 3)


def test_feature_tables(spark):
    f = spark.createDataFrame([(1, "a", 0.5, 9), (2, "b", 1.5, 9), (3, "c", 2.5, 9)], "unit long, label string, v double, w int")
    x, y = units.split_features(f, "label", ["w"], spark.createDataFrame([(2,)], "unit long"))
    assert x.columns == ["unit", "v"] and {tuple(r) for r in y.collect()} == {(1, "a"), (3, "c")}
    labels = spark.createDataFrame([(5,), (-1,), (9,), (5,), (None,)], "l long")
    assert sorted((str(r.l), r.place) for r in units.dense_labels(labels, "l").collect()) == [("-1", None), ("5", 0), ("5", 0), ("9", 1), ("None", None)]
    rows = spark.createDataFrame([([[1, 2], [3, 4]], [[True, False], [False, False]])], "x array<array<int>>, m array<array<boolean>>")
    assert rows.select(units.masked_rows(F.col("x"), F.col("m")).alias("r")).first().r == [[1], []]
