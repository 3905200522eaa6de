"""Clusters, surrogates and rates against numpy and plain loops."""

import numpy as np
import pytest
from tidewave.operators import clusters, quality, rates, surrogates


def features_of(spark, rng, units=6, spikes=60, spread=5, components=2):
    """Units of one peak each, with features on the channels around it."""
    rows, dense = [], {}
    for i in range(units * spikes):
        unit = i % units
        low = max(0, unit * 2 - spread)
        x = {c: (rng.normal(size=components) + 3 * np.exp(-abs(c - unit * 2))).tolist() for c in range(low, unit * 2 + spread + 1)}
        dense[i] = (unit, x)
        rows += [(i, unit, unit, c, v) for c, v in x.items()]
    return spark.createDataFrame(rows, "id long, unit long, template long, channel long, values array<double>").repartition(5), dense


def test_neighbourhood_metrics_by_numpy(spark):
    df, dense = features_of(spark, np.random.default_rng(1))
    half, k = 2, 3
    peaks = {u: max(range(20), key=lambda c: np.mean([x[c][0] if c in x else -9 for v, x in dense.values() if v == u])) for u in range(6)}
    assert {r.unit: r.channel for r in clusters.peak_channels(df).collect()} == peaks
    last = max(c for _, x in dense.values() for c in x)
    got = {r.unit: r for r in clusters.neighbourhood_metrics(df, half, k).collect()}
    assert len(got) >= 3
    for u, r in got.items():
        use = range(max(0, peaks[u] - half), min(last, peaks[u] + half) + 1)
        ids = [i for i, (v, x) in sorted(dense.items()) if peaks[v] in use and all(c in x for c in use)]
        x = np.array([np.concatenate([dense[i][1][c] for c in use]) for i in ids])
        own = np.array([dense[i][0] == u for i in ids])
        assert own.sum() > 20 and (~own).any()
        cov, m = np.cov(x[own].T), x[own].mean(0)
        d = np.sort(np.einsum("ij,jk,ik->i", x[~own] - m, np.linalg.inv(cov), x[~own] - m))
        n = own.sum()
        assert r.isolation == pytest.approx(d[min(n, len(d)) - 1])
        assert r.l_ratio == pytest.approx(quality.chi2_above(d, x.shape[1]).sum() / n)
        within = cov * (n - 1) + np.cov(x[~own].T) * ((~own).sum() - 1)
        w = x @ np.linalg.pinv(within) @ (m - x[~own].mean(0))
        assert r.d_prime == pytest.approx((w[own].mean() - w[~own].mean()) / np.sqrt(0.5 * (w[own].var() + w[~own].var())))
        far = ((x[:, None] - x[None]) ** 2).sum(2) + np.diag(np.full(len(x), np.inf))
        near = np.argsort(far, axis=1)[:, :k]
        assert (r.hit, r.miss) == pytest.approx((own[near[own]].mean(), own[near[~own]].mean()))


def test_small_and_lonely_units_are_left_out(spark):
    rows = [(i, 0, 0, 0, [float(i % 7)]) for i in range(50)] + [(100 + i, 1, 1, 9, [1.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, unit long, template long, channel long, values array<double>")
    assert clusters.neighbourhood_metrics(df, 1, 2).count() == 0


def silhouette(x, label):
    """The mean over points, by all distances."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a, b = d[i][own].mean(), d[i][label != label[i]].mean()
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


@pytest.mark.parametrize("block", [1_000, 37])
def test_silhouettes_by_all_distances(spark, block):
    rng = np.random.default_rng(2)
    label = np.append(rng.integers(0, 10, 200), 10)  # the last one is alone
    x = rng.normal(size=(201, 3)) + label[:, None] * 0.5
    df = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x, strict=True))], "id long, label int, features array<double>")
    pairs = clusters.silhouettes(df, None, block)
    got = {(r.l1, r.l2): r.silhouette for r in pairs.collect()}
    assert len(got) == 55
    for (a, b), s in got.items():
        some = (label == a) | (label == b)
        assert s == pytest.approx(silhouette(x[some], label[some]))
    least = {r.label: r.silhouette for r in clusters.least_silhouettes(pairs).collect()}
    assert least == {k: pytest.approx(min(s for p, s in got.items() if k in p)) for k in range(11)}
    sample = lambda rows: {(r.l1, r.l2): round(r.silhouette, 9) for r in clusters.silhouettes(rows, 50, block).collect()}
    assert sample(df) and sample(df) == sample(df.repartition(3))


def test_rounding_decides_no_neighbour():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 4)), 1) + 1e6  # many equal distances, far from 0
    q, row, d = quality.nearest_rows(x, np.arange(300), x[:40], np.arange(40), 5)
    for i in range(40):
        far = ((x - x[i]) ** 2).sum(1)
        far[i] = np.inf
        assert row[q == i].tolist() == np.argsort(far, kind="stable")[:5].tolist()


def stable(counts, width, target, levels):
    """The search as a loop: lower the share, then let the target give way."""
    mean = np.mean(counts[0])
    smooth = counts[1]

    def periods(share):
        out, start = [], None
        for i, x in enumerate([*(smooth >= mean * share), False]):
            if x and start is None:
                start = i
            if not x and start is not None:
                out.append((start, i - 1))
                start = None
        return out

    def best(level):
        some = [(a, b) for a, b in periods(levels[level]) if (b - a) * width > target]
        if some:
            a, _ = min(some, key=lambda p: (round(float(np.std(smooth[p[0] : p[1]])), 12), p[0]))
            return a * width, a * width + target, level
        return None

    for level in range(len(levels)):
        if found := best(level):
            return found
    while (target := target - 2) > 1:
        # where the target gives way the lowest share has the longest run
        if found := best(len(levels) - 1):
            return found
    return None


def test_stable_periods_as_a_loop(spark):
    rng = np.random.default_rng(4)
    width, bins, units = 10, 60, 500
    rows, want = [], {}
    kernel = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    for u in range(units):
        rate = rng.choice([0.2, 1, 3, 6], size=bins // 6).repeat(6) * rng.choice([0.5, 1])
        n = rng.poisson(rate)
        if u % 50 == 0:
            n = np.zeros(bins, int)
            n[::9] = 3
        rows += [(u * 1_000_000 + b * 100 + j, u, b * width + j % width) for b in range(bins) for j in range(n[b])]
        if n.sum():
            want[u] = stable((n, np.convolve(np.pad(n, 8, mode="symmetric"), kernel / kernel.sum(), "valid")), width, 200, rates.stability_levels())
    df = spark.createDataFrame(rows, "id long, unit long, t long")
    got = {r.unit: (r.start, r.stop, r.level) for r in rates.stable_periods(df, width, width * bins, 2.0, 200).collect()}
    assert len({v[2] for v in got.values()}) > 3 and any(v[1] - v[0] < 200 for v in got.values())
    assert got == {u: v for u, v in want.items() if v}


def test_jitter_stays_between_neighbours_for_any_partitioning(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 4), int(t)) for i, t in enumerate(rng.integers(0, 100_000, 400))]
    df = spark.createDataFrame(rows, "id long, unit long, t long")
    one = sorted(map(tuple, surrogates.jittered(df, 5, 3).collect()))
    assert one == sorted(map(tuple, surrogates.jittered(df.repartition(7, "t"), 5, 3).collect()))
    assert one != sorted(map(tuple, surrogates.jittered(df, 5, 4).collect()))
    trains = {u: sorted((t, i) for i, v, t in rows if v == u) for u in range(4)}
    places = []
    for unit, i, _, t in one:
        k = [x[1] for x in trains[unit]].index(i)
        if 0 < k < len(trains[unit]) - 1:
            lo, hi = trains[unit][k - 1][0], trains[unit][k + 1][0]
            assert lo <= t <= hi
            places.append((t - lo) / max(hi - lo, 1))
        else:
            assert t == trains[unit][k][0]
    # uniform: within 4 deviations of a half
    assert abs(np.mean(places) - 0.5) < 4 / np.sqrt(12 * len(places))


def test_independent_trains_stay_in_the_band(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 2), int(t)) for i, t in enumerate(rng.integers(0, 4_000_000, 8_000))]
    df = spark.createDataFrame(rows, "id long, unit long, t long")
    r = surrogates.against_jitter(df, 50, 20, 20, seed=1).collect()
    inside = np.mean([x.low <= x.excess <= x.high for x in r])
    assert len(r) == 82 and inside > 0.85
    # a third of unit 1 follows unit 0 by 120 ticks
    more = rows + [(10_000 + i, 1, t + 120) for i, u, t in rows if u == 0 and i % 3 == 0]
    c = {x.bin: x for x in surrogates.against_jitter(spark.createDataFrame(more, "id long, unit long, t long"), 50, 20, 20).collect() if x.u1 == 0}
    assert c[2].excess > c[2].high and c[2].excess == max(x.excess for x in c.values())


def test_poisson_quantiles_and_trials(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select("id", surrogates.uniform("id", F.lit(9)).alias("u"))
    for mean in (0.3, 4.0, 60.0):
        n = np.array([r.n for r in df.select(surrogates.poisson_quantile(F.col("u"), F.lit(mean)).alias("n")).collect()])
        assert n.mean() == pytest.approx(mean, abs=4 * np.sqrt(mean / 20_000)) and n.var() == pytest.approx(mean, rel=0.06)
    rows = [(1, t, b, (t + b) % 3 if t % 2 else 0) for t in range(40) for b in range(4)]
    got = surrogates.poisson_trials(spark.createDataFrame(rows, "unit long, trial long, bin long, n long")).collect()
    assert len(got) == len(rows) and all(r.n == 0 for r in got if r.trial % 2 == 0)
    assert np.mean([r.n for r in got if r.trial % 2]) == pytest.approx(1, abs=0.4)


def rate_cube(t1, t2, half, levels, smooth, last):
    """By dense arrays of every bin."""
    size = last + 1
    rate, other = np.zeros(size), np.unique(t2)
    for i in range(1, len(other) - 1):
        a, b = other[i - 1] + (other[i] - other[i - 1]) // 2, other[i] + (other[i + 1] - other[i]) // 2
        rate[a:b] = 1 / (b - a)
    if smooth:
        pad = np.concatenate([np.zeros(smooth), rate, np.zeros(smooth)])
        rate = np.round([pad[t + smooth - smooth // 2 : t + 2 * smooth - smooth // 2].sum() / smooth for t in range(size)], 12)
    edges = np.quantile(rate[t1], np.linspace(0, 1, levels + 2)[1:-1])
    counts, n = np.zeros((levels, 2 * half + 1)), np.zeros(levels)
    train = np.zeros(size, bool)
    train[other] = True
    for t in t1:
        if other[0] <= t < other[-1] and t - half >= 0 and t + half < last:
            k = min((edges < rate[t]).sum(), levels - 1)
            counts[k] += train[t - half : t + half + 1]
            n[k] += 1
    return counts / np.maximum(n, 1)[:, None]


@pytest.mark.parametrize("smooth", [0, 9, 30])
def test_rate_cube_by_dense_arrays(spark, smooth):
    rng = np.random.default_rng(7)
    t = {u: np.sort(rng.choice(900, 150, replace=False)) for u in (1, 2)}
    last = max(x[-1] for x in t.values())
    rows = [(u * 1000 + i, u, int(x) * 10 + int(i % 10)) for u in t for i, x in enumerate(t[u])]
    df = spark.createDataFrame(rows, "id long, unit long, t long")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 1)], "u1 long, u2 long")
    got = {(r.u1, r.u2, r.level, r.bin): r.p for r in rates.correlogram_by_rate(df, pairs, 10, 4, 3, smooth).collect()}
    assert len(got) == 3 * 3 * 9
    for a, b in ((1, 2), (2, 1), (1, 1)):
        want = rate_cube(t[a], t[b], 4, 3, smooth, last)
        if a == b:
            want[:, 4] = 0
        for k in range(3):
            for i in range(9):
                assert got[a, b, k, i - 4] == pytest.approx(want[k, i]), (a, b, k, i)


def test_the_table_of_all_measures(spark):
    from pyspark.sql import functions as F

    df, dense = features_of(spark, np.random.default_rng(8), units=4, spikes=50)
    rng = np.random.default_rng(9)
    t = {i: int(x) for i, x in enumerate(rng.permutation(len(dense)) * 7)}
    train = spark.createDataFrame([(i, u, t[i], float(x[u * 2][0])) for i, (u, x) in dense.items()] + [(10_000, 99, 5, 1.0)], "id long, unit long, t long, a double")
    middle = 700
    rows = clusters.quality_table(train, [(-1, middle), (middle, 7 * len(dense))], 10.0, 5, 1, df, half=2, k=3, n_silhouette=None).collect()
    assert len(rows) == 10
    alone = [r for r in rows if r.unit == 99]
    assert all(r.silhouette is None and r.isolation is None for r in alone)
    for number, keep in ((0, lambda i: t[i] <= middle), (1, lambda i: t[i] > middle)):
        some = df.filter(F.col("id").isin([i for i in dense if keep(i)]))
        want = {r.unit: r for r in clusters.neighbourhood_metrics(some, 2, 3).collect()}
        channels = max(c for i, (_, x) in dense.items() if keep(i) for c in x) + 1
        ids = [i for i in dense if keep(i)]
        x = np.array([np.concatenate([dense[i][1].get(c, [0.0, 0.0]) for c in range(channels)]) for i in ids])
        label = np.array([dense[i][0] for i in ids])
        for r in rows:
            if r.period == number and r.unit != 99:
                mine = sorted(t[i] for i in ids if dense[i][0] == r.unit)
                assert r.rate == pytest.approx(len(mine) * 10 / (mine[-1] - mine[0]))
                pairs = [silhouette(x[np.isin(label, [r.unit, o])], label[np.isin(label, [r.unit, o])]) for o in range(4) if o != r.unit]
                assert r.silhouette == pytest.approx(min(pairs))
                if r.unit in want:
                    assert (r.isolation, r.hit, r.miss) == pytest.approx((want[r.unit].isolation, want[r.unit].hit, want[r.unit].miss))
