import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_signals_and_rates import signal, whole
from tidewave.functions import scalars
from tidewave.operators import correlograms, extraction, information, learning, models, periods, quality, signals, waveforms
from tidewave.sources import arrays, tables, units


def dense(spark, x):
    return spark.createDataFrame([(u, b, int(v)) for u, row in enumerate(x) for b, v in enumerate(row)], "unit long, bin long, x long")


def test_words_of_many_units_keep_every_bit(spark):
    rows = [(u, 0, int(u in (0, 59, 61))) for u in range(62)] + [(u, 1, 0) for u in range(62)]
    got = {r.word: r.p for r in information.words(spark.createDataFrame(rows, "unit long, bin long, x long")).collect()}
    assert got == {1 + (1 << 59) + (1 << 61): 0.5, 0: 0.5}
    with pytest.raises(Exception, match="62 units"):
        information.words(spark.createDataFrame([(u, 0, 1) for u in range(63)], "unit long, bin long, x long")).collect()


def test_correlations_of_bins(spark):
    x = np.random.default_rng(1).integers(0, 3, (6, 50))
    x[5] = 1  # never changes
    r = {(a.u1, a.u2): a.r for a in information.pearson_matrix(dense(spark, x)).collect()}
    assert set(r) == {(a, b) for a in range(6) for b in range(a + 1, 6)}
    assert all(r[a, b] == pytest.approx(np.corrcoef(x[a], x[b])[0, 1]) for a in range(5) for b in range(a + 1, 5)) and r[0, 5] is None
    lagged = {(a.u1, a.u2): a.r for a in information.lagged_correlation(dense(spark, x), 4, 50).collect()}
    assert all(lagged[a, b] == pytest.approx(np.corrcoef(x[a], np.roll(x[b], -4))[0, 1]) for a in range(5) for b in range(5))


def test_information_of_independent_and_equal_units(spark):
    a = np.array([0, 0, 1, 1] * 10)
    b = np.array([0, 1, 0, 1] * 10)
    assert information.mutual_information(dense(spark, [a, b])).first().mi == pytest.approx(0, abs=1e-12)
    assert information.mutual_information(dense(spark, [a, a])).first().mi == pytest.approx(math.log(2))
    assert information.copula_entropy(dense(spark, [a, b])).first().copula == pytest.approx(0, abs=1e-12)
    target = spark.createDataFrame([(i, int(v)) for i, v in enumerate(a)], "bin long, x long")
    assert information.information_on(dense(spark, [a]), target).first().mi == pytest.approx(1)
    assert information.information_on(dense(spark, [b]), target).first().mi == pytest.approx(0, abs=1e-12)


def test_normal_law(spark):
    x = [-9.0, -5.0, -1.3, 0.0, 0.4, 2.0, 6.5, 9.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", models.normal_cdf(F.col("x")).alias("p"), models.normal_cdf(F.col("x"), 1.0, 2.0).alias("q"), models.normal_pdf(F.col("x")).alias("d")).collect()
    for r in got:
        assert r.p == pytest.approx(0.5 * (1 + math.erf(r.x / math.sqrt(2))), abs=1e-12)
        assert r.q == pytest.approx(0.5 * (1 + math.erf((r.x - 1) / 2 / math.sqrt(2))), abs=1e-12)
        assert r.d == pytest.approx(math.exp(-r.x * r.x / 2) / math.sqrt(2 * math.pi))


def test_p_of_correlations_by_student(spark):
    cases = [(r, n) for r in (-0.9, -0.3, 0.0, 0.01, 0.2, 0.5, 0.99, 1.0) for n in (3, 4, 5, 6, 28, 29, 200, 1001)]
    df = spark.createDataFrame([*cases, (0.5, 2)], "r double, n long")
    for x in df.select("r", "n", information.correlation_p(F.col("r"), F.col("n")).alias("p")).collect():
        if x.n < 3:
            assert x.p is None
            continue
        # under no correlation r has the density (1 - r^2)^((n - 4) / 2): its mass beyond |r|, by the angle of r
        angle = np.linspace(math.asin(abs(x.r)), math.pi / 2, 200_001)
        whole = np.linspace(0, math.pi / 2, 200_001)
        area = lambda a: np.trapezoid(np.cos(a) ** (x.n - 3), a)
        assert x.p == pytest.approx(area(angle) / area(whole), abs=1e-7), (x.r, x.n)


@pytest.mark.parametrize("size", [7, 13, 40, 1000])
def test_filters_of_chunks_shorter_than_the_kernel(spark, size):
    x = np.random.default_rng(2).normal(size=(2, 300))
    kernel = signals.band_kernel(1000.0, 50.0, 200.0, 61)
    assert np.allclose(whole(signals.filtered(signal(spark, x, size), kernel)), [np.convolve(v, kernel, "same") for v in x])


def test_shift_of_a_tone_that_does_not_fit_its_chunks(spark):
    t = np.arange(900)
    x = np.stack([np.cos(2 * np.pi * 0.0371 * t + 0.3), np.sin(2 * np.pi * 0.11 * t)])
    shifts = spark.createDataFrame([(0, 0.5), (1, -0.25)], "channel long, shift double")
    got = whole(signals.shifted(signal(spark, x, 70), shifts))
    want = np.stack([np.cos(2 * np.pi * 0.0371 * (t - 0.5) + 0.3), np.sin(2 * np.pi * 0.11 * (t + 0.25))])
    assert np.abs(got - want)[:, 130:-130].max() < 1e-3


@pytest.mark.parametrize("low, high", [(None, 100.0), (100.0, None), (80.0, 200.0)])
def test_butterworth_gains(low, high):
    k, rate = signals.butterworth_kernel(1000.0, low, high, 2), 1000.0
    assert len(k) % 2 == 1 and np.allclose(k, k[::-1])
    for f in (20.0, 80.0, 100.0, 130.0, 200.0, 400.0):
        gain = (k * np.cos(2 * np.pi * f / rate * (np.arange(len(k)) - len(k) // 2))).sum()
        w, a, b = (None if x is None else math.tan(math.pi * x / rate) for x in (f, low, high))
        x = w / b if a is None else a / w if b is None else (w * w - a * b) / (w * (b - a))
        assert gain == pytest.approx(1 / (1 + x**4), abs=1e-4)


def test_covariance_over_uneven_chunks(spark):
    x = np.random.default_rng(3).normal(size=(5, 333)) + np.arange(5)[:, None]
    cov = {(r.c1, r.c2): r.covariance for r in signals.covariance(signal(spark, x, 100)).collect()}
    want = np.cov(x, bias=True)
    assert len(cov) == 15 and all(cov[a, b] == pytest.approx(want[a, b]) for a, b in cov)


def test_largest_difference_and_folds_over_parts(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(g), float(round(v, 1)), "big" if i % 10 else None) for i, (g, v) in enumerate(zip(rng.integers(0, 2, 3000), rng.normal(size=3000), strict=True))]
    rows += [(-1, 0, None, "big")]
    df = spark.createDataFrame(rows, "id long, g int, v double, label string")
    a, b = (np.array([v for _, g, v, _ in rows if g == k and v is not None]) for k in (0, 1))
    grid = np.unique(np.concatenate([a, b]))
    n = sum(g == 0 for _, g, _, _ in rows)
    want = max(abs((a <= x).sum() / n - (b <= x).mean()) for x in grid)
    assert learning.kolmogorov_smirnov(df, "v", "g", parts=20).first().d == pytest.approx(want)
    folds = Counter((r.label, r.fold) for r in learning.folded(df, 7, "label").collect())
    for label in ("big", None):
        sizes = [folds[label, k] for k in range(7)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == sum(r[3] == label for r in rows)


def test_sync_edges_over_blocks(spark):
    rng = np.random.default_rng(5)
    word = np.repeat(rng.integers(0, 1 << 32, 40), rng.integers(1, 6, 40))
    df = spark.createDataFrame([(i, int(w)) for i, w in enumerate(word)], "i long, word long")
    got = {(r.bit, r.i, r.edge) for r in arrays.sync_edges(df, 32, block=7).collect()}
    want = {(b, i, int(word[i] >> b & 1) - int(word[i - 1] >> b & 1)) for i in range(1, len(word)) for b in range(32)}
    assert got == {x for x in want if x[2]}


def test_arrays_of_several_dimensions(spark, tmp_path):
    x = np.arange(5 * 3 * 4, dtype="<f4").reshape(5, 3, 4)
    np.save(tmp_path / "templates.npy", x)
    got = {r.row: r["values"] for r in arrays.read_npy_rows(spark, str(tmp_path), rows=2).collect()}
    assert {k: np.reshape(v, (3, 4)).tolist() for k, v in got.items()} == {k: x[k].tolist() for k in range(5)}


def test_recordings_become_signals_and_snippets(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.integers(-100, 100, (230, 3)).astype("<i2")  # frames, channels
    x.tofile(tmp_path / "a.bin")
    s = tables.by_channel(tables.read_samples(spark, str(tmp_path / "a.bin"), 3, frames=50), 3)
    assert np.array_equal(whole(s), x.T)
    at = [(1, 1, 5), (1, 2, 49), (1, 3, 4), (2, 4, 100), (2, 5, 224), (2, 6, 225), (2, 7, 0)]
    spikes = spark.createDataFrame(at, "unit long, id long, t long")
    got = {(r.id, r.channel): r.wave for r in extraction.snippets(spikes, s, 50, 5, 6).collect()}
    assert got == {(i, c): x[t - 5 : t + 6, c].tolist() for _, i, t in at if t >= 5 and t + 6 <= 230 for c in range(3)}
    means = {(r.unit, r.channel): r.wave for r in extraction.mean_waves(extraction.snippets(spikes, s, 50, 5, 6)).collect()}
    assert np.allclose(means[1, 2], np.mean([x[0:11, 2], x[44:55, 2]], axis=0))
    flat = extraction.median_removed(extraction.snippets(spikes, s, 50, 5, 6)).filter("id = 1 and channel = 0").first().wave
    assert np.allclose(flat, x[0:11, 0] - np.median(x[0:11, 0]))


def test_drift_matching_undoes_shifts(spark):
    base = np.exp(-0.5 * ((np.arange(40) - 20) / 3.0) ** 2)
    rows = []
    for k in range(60):
        s = (k // 10) % 3 - 1  # each batch of ten is elsewhere
        for c, height in ((0, 1.0), (1, 3.0 - 0.01 * k)):
            rows.append((7, k, k, c, (height * np.roll(base, s)).tolist()))
    df = spark.createDataFrame(rows, "unit long, id long, t long, channel long, wave array<double>")
    got = {r.channel: np.array(r.wave) for r in extraction.drift_matched(df, high=1.0).collect()}
    assert set(got) == {0, 1}
    assert np.corrcoef(got[1][5:-5], np.roll(base, -1)[5:-5])[0, 1] > 0.9999 and got[1].max() == pytest.approx(3 - 0.295, abs=0.01)


def test_truncated_gaussians(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(10, 2, 200_000)
    rows = [(u, float(v)) for u, cut in ((1, 0), (2, 9.0), (3, 10.5)) for v in x[x > cut][:30_000]] + [(4, 1.0)] * 50 + [(5, 2.0)] * 3
    got = {r.unit: r.missing for r in waveforms.missing_spikes(spark.createDataFrame(rows, "unit long, a double")).collect()}
    assert set(got) == {1, 2, 3}
    for u, cut in ((2, 9.0), (3, 10.5)):
        true = 0.5 * (1 + math.erf((cut - 10) / 2 / math.sqrt(2)))
        assert got[u] == pytest.approx(true, abs=0.05)
    assert got[1] < 0.02


def test_filtered_train_by_brute_force(spark):
    rng = np.random.default_rng(8)
    t = np.sort(rng.choice(40_000, 3000, replace=False))
    t = np.sort(np.concatenate([t, t[(t > 20_000) & (t < 25_000)] + 1]))  # a stretch with short intervals
    a = rng.normal(10, 2, len(t))
    a[t > 32_000] = np.abs(a[t > 32_000] - 10) + 10  # amplitudes cut
    df = spark.createDataFrame([(1, i, int(x), float(y)) for i, (x, y) in enumerate(zip(t, a, strict=True))], "unit long, id long, t long, a double")
    kept = {r.id for r in quality.filtered_train(df, 0, 2, 2_000, 2, 4_000, 1, 0.15, 0.2).collect()}
    fp = {}
    for c in range(20):
        part = t[(t >= c * 2_000) & (t < (c + 2) * 2_000)]
        if len(part):
            fp[c] = (np.diff(part) < 2).sum() <= 0.15 * len(part)
    good_fp = {e for e in range(21) if any(fp.get(c, False) for c in (e - 1, e))}
    fn = {r.chunk: r.missing <= 0.2 for r in waveforms.missing_spikes(df.withColumn("chunk", F.floor(F.col("t") / 4_000)), ["unit", "chunk"]).collect()}
    assert kept == {i for i, x in enumerate(t) if x // 2_000 in good_fp and fn.get(x // 4_000, False)}
    assert not any(20_500 < t[i] < 24_000 for i in kept) and not any(t[i] > 36_000 for i in kept) and len(kept) > 1000


def test_separation_against_numpy(spark):
    rng = np.random.default_rng(9)
    parts = {k: rng.normal(size=(n, 3)) @ rng.normal(size=(3, 3)) + rng.normal(size=3) * 3 for k, n in ((1, 60), (2, 90), (3, 40))}
    rows = [(i, k, v.tolist()) for i, (k, v) in enumerate((k, v) for k, x in parts.items() for v in x)] + [(1000, 4, [0.0, 0.0, 0.0])]
    got = {r.label: r for r in quality.separation(spark.createDataFrame(rows, "id long, label int, features array<double>")).collect()}
    assert set(got) == {1, 2, 3}
    for k, x in parts.items():
        y = np.concatenate([*(v for j, v in parts.items() if j != k), np.zeros((1, 3))])
        d = np.sort(np.einsum("ij,jk,ik->i", y - x.mean(0), np.linalg.inv(np.cov(x.T)), y - x.mean(0)))
        assert got[k].isolation == pytest.approx(d[min(len(x), len(y)) - 1])
        tail = [math.erfc(math.sqrt(v / 2)) + math.sqrt(2 * v / math.pi) * math.exp(-v / 2) for v in d]
        assert got[k].l_ratio == pytest.approx(sum(tail) / len(x))
        w = np.linalg.solve((len(x) - 1) * np.cov(x.T) + len(y) * np.cov(y.T, bias=True), x.mean(0) - y.mean(0))
        assert got[k].d_prime == pytest.approx(((x @ w).mean() - (y @ w).mean()) / np.sqrt(0.5 * ((x @ w).var() + (y @ w).var())))


@pytest.mark.parametrize("degrees", range(1, 8))
def test_chi_square_tails(degrees):
    grid = np.linspace(0, 200, 400_001)[1:]
    density = grid ** (degrees / 2 - 1) * np.exp(-grid / 2)
    for x in (0.5, 3.0, 11.0):
        want = density[grid > x].sum() / (2 ** (degrees / 2) * math.gamma(degrees / 2)) * (grid[1] - grid[0])
        assert quality.chi2_above(np.array([x]), degrees)[0] == pytest.approx(want, abs=1e-3)


def test_moments_over_batches(spark):
    x = np.random.default_rng(10).normal(size=(500, 4)) + 5
    df = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)], "label int, features array<double>").repartition(7)
    for r in quality.moments(df).collect():
        mine = x[r.label :: 2]
        assert r.n == 250 and np.allclose(r["mean"], mine.mean(0)) and np.allclose(np.reshape(r.covariance, (4, 4)), np.cov(mine.T))


def test_nearest_neighbours_over_blocks(spark):
    rng = np.random.default_rng(11)
    x, label = rng.normal(size=(120, 3)), rng.integers(0, 3, 120)
    df = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x, strict=True))], "id long, label int, features array<double>")
    got = {r.label: (r.hit, r.miss) for r in quality.neighbour_rates(df.filter("id % 2 = 0"), df, 4, query_block=11, point_block=25).collect()}
    near = {i: np.argsort(((x - x[i]) ** 2).sum(1) + np.where(np.arange(120) == i, np.inf, 0))[:4] for i in range(0, 120, 2)}
    for k in range(3):
        own = [label[j] == k for i in near if label[i] == k for j in near[i]]
        other = [label[j] == k for i in near if label[i] != k for j in near[i]]
        assert got[k] == pytest.approx((np.mean(own), np.mean(other)))


def test_wave_features_of_a_known_shape(spark):
    i = np.arange(200)
    wave = -3 * np.exp(-0.5 * ((i - 60) / 6.0) ** 2) + 1.5 * np.exp(-0.5 * ((i - 110) / 12.0) ** 2)
    r = waveforms.waveform_features(spark.createDataFrame([(1, 2, wave.tolist())], "unit long, channel long, wave array<double>")).first()
    assert (r.trough, r.peak, r.width, r.n_troughs) == (60, 110, 50, 1) and r.ratio == pytest.approx(0.5, abs=0.01)
    assert r.trough_half_width == pytest.approx(2.355 * 6, abs=1.5) and r.peak_half_width == pytest.approx(2.355 * 12, abs=1.5)
    assert r.trough_value == pytest.approx(wave[60] - np.median(wave)) and r.peak_value == pytest.approx(wave[110] - np.median(wave))
    # a gaussian passes a share s of its height at sd * sqrt(-2 ln s) from its centre
    at = lambda share: 6 * math.sqrt(-2 * math.log(share))
    assert r.onset == pytest.approx(60 - at(0.05), abs=1.5)
    y = wave - np.median(wave)

    def place(part, level):
        """Of the samples before and after the first pass of a level the one nearer to 0."""
        k = next(k for k in range(len(part) - 1) if (part[k] - level) * (part[k + 1] - level) < 0)
        return min((k, k + 1), key=lambda j: abs(part[j]))

    rise = y[60:110]  # without the peak
    assert r.rise_10_90 == place(rise, np.percentile(rise, 90)) - place(rise, np.percentile(rise, 10)) == 39
    fall = y[r.onset : 61]
    assert r.fall_10_90 == place(fall, 0.9 * y[60]) - place(fall, 0.1 * y[60]) and abs(r.fall_10_90 - at(0.1) + at(0.9)) <= 1
    fall = y[60 - int(at(0.5)) - 1 : 61] / 3
    assert r.depolarisation == pytest.approx(np.polyfit(np.arange(len(fall)), fall, 1)[0], rel=0.15)
    assert r.repolarisation == pytest.approx(np.polyfit(np.arange(51), wave[60:111], 1)[0], abs=1e-3)


def test_stores_and_periods(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "dataset int, unit long, label string")
    b = spark.createDataFrame([(1, 2, "other"), (2, 2, "z")], "dataset int, unit long, label string")
    assert {(r.dataset, r.unit, r.label) for r in units.union_of_stores([a, b]).collect()} == {(1, 1, "x"), (1, 2, "y"), (2, 2, "z")}
    assert {r.label for r in units.without_labels(a).collect()} == {None}
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.01), (1, 3, 0.2)], "a int, b int, p double")
    assert {(r.a, r.b, r.connected) for r in units.connected_pairs(pairs, 0.05).collect()} == {(1, 2, True), (1, 3, False)}
    good = spark.createDataFrame([(1, 0, 5), (1, 7, 9)], "unit int, start long, stop long")
    assert periods.checked(good).count() == 2
    with pytest.raises(Exception, match="after it starts"):
        periods.checked(good.withColumn("stop", F.col("start"))).collect()
    tags = periods.marked(spark.createDataFrame([(1, 5), (1, 6), (2, 1)], "unit int, t long"), good)
    assert {(r.unit, r.t, r.inside) for r in tags.collect()} == {(1, 5, True), (1, 6, False), (2, 1, False)}
    r = spark.createDataFrame([(92.1,)], "u double").select(*(c.alias(n) for n, c in zip("du", units.decoded(F.col("u")), strict=True))).first()
    assert (r.d, r.u) == (1, 92)


def test_qualities_are_written(spark, tmp_path):
    units.write_qualities(spark.createDataFrame([(2, "mua"), (1, "good")], "unit long, `group` string"), str(tmp_path / "q"))
    got = tables.read_tsv(spark, str(tmp_path / "q"), "cluster_id long, `group` string").collect()
    assert sorted((r.cluster_id, r.group) for r in got) == [(1, "good"), (2, "mua")]


def test_synchrony_over_a_baseline(spark):
    n = [4] * 9 + [8] * 3 + [4] * 9
    full = spark.createDataFrame([(1, 2, b - 10, c) for b, c in enumerate(n)], "u1 long, u2 long, bin long, n long")
    assert correlograms.synchrony_ratio(full, 10, 1, 0.4).first().ratio == pytest.approx(8 / np.mean(n[:4] + n[6:]))
    counts = spark.createDataFrame([(1, 100), (2, 50)], "unit long, total long")
    r = correlograms.over_chance(full, counts, 1.0, 1000.0).filter("bin = 0").first()
    assert r.dp == pytest.approx(8 / 100 - 0.05) and r.covariance == pytest.approx((8 / 100 - 0.05) * 0.1)


def test_bin_helpers(spark):
    r = spark.range(1).select(scalars.half_off(F.lit(-1)).alias("h"), F.concat(*scalars.cartesian(F.lit(2.0), F.lit(0.0))[:1]).alias("x")).first()
    assert r.h == 1
