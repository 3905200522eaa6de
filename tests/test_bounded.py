"""Steps that must stay bounded as tables grow, against brute force or the plainer way."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_studies import stable
from tidewave.operators import clusters, correlograms, distributions, extraction, quality, rates, signals, surrogates, waveforms
from tidewave.sources import tables


def test_waves_are_cut_without_a_shuffle_of_parts(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (2, 47))  # chunks of 5 samples, the last of 2; chunk 6 of channel 1 is missing
    chunks = [(c, k, x[c, 5 * k : 5 * k + 5].tolist()) for c in range(2) for k in range(10) if (c, k) != (1, 6)]
    signal = spark.createDataFrame(chunks, "channel long, chunk long, samples array<double>")
    at = [(i % 3, i, i - 2) for i in range(52)]
    w = extraction.snippets(spark.createDataFrame(at, "unit long, id long, t long"), signal, 5, 3, 9, ["t"])
    got = {(r.id, r.channel): (r.t, r.wave) for r in w.collect()}
    gone = set(range(30, 35))
    want = {(i, c): (t, x[c, t - 3 : t + 9].tolist()) for _, i, t in at for c in range(2) if t >= 3 and t + 9 <= 47 and not (c == 1 and gone & set(range(t - 3, t + 9)))}
    assert got == want
    plan = w._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # waves are cut after the join, and nothing groups them
    kept = extraction.in_recording(spark.createDataFrame(at, "unit long, id long, t long"), signal, 5, 3, 9)
    assert {r.id for r in kept.collect()} == {i for i, _ in want}


def test_means_of_many_small_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), rng.normal(0, 1, int(size)).tolist()) for g, size in zip(rng.integers(0, 200, 900), rng.choice([3, 5], 900), strict=True)]
    rows += [(None, [1.0, 2.0]), (None, [3.0]), (7, None), (500, [])]
    df = spark.createDataFrame(rows, "unit long, wave array<double>").repartition(3)
    for held in (1 << 22, 40):
        got = {r.unit: r for r in extraction.mean_waves(df, ["unit"], held).collect()}
        for unit in {u for u, w in rows if w}:
            ws = [w for u, w in rows if u == unit and w is not None]
            want = [np.mean([w[i] for w in ws if len(w) > i]) for i in range(max(map(len, ws)))]
            assert np.allclose(got[unit].wave, want) and got[unit].n == len(ws)
        assert 500 not in got and len(got) == len({u for u, w in rows if w})


def test_batches_before_the_waves_are_those_after(spark):
    rng = np.random.default_rng(3)
    signal = spark.createDataFrame([(c, k, rng.normal(0, 1, 16).tolist()) for c in range(3) for k in range(12)], "channel long, chunk long, samples array<double>")
    s = spark.createDataFrame([(int(u), i, int(t)) for i, (u, t) in enumerate(zip(rng.integers(0, 2, 90), rng.integers(0, 200, 90), strict=True))], "unit long, id long, t long")
    after = extraction.drift_matched(extraction.snippets(s, signal, 16, 6, 24).join(s.select("id", "t"), "id"), 4)
    w = extraction.snippets(extraction.time_batches(extraction.in_recording(s, signal, 16, 6, 24), 4), signal, 16, 6, 24, ["batch"])
    a, b = ({(r.unit, r.channel): r for r in d.collect()} for d in (after, extraction.drift_matched(w, 4)))
    assert a and set(a) == set(b) and all(a[k].batches == b[k].batches and np.allclose(a[k].wave, b[k].wave) for k in a)


def test_gaussians_fitted_together_are_those_fitted_alone():
    rng = np.random.default_rng(4)
    rows = [rng.poisson(np.maximum(30 * np.exp(-0.5 * ((np.arange(size) - rng.uniform(1, size)) / 2) ** 2), 0.1)) for size in rng.integers(4, 12, 60)]
    wide = np.zeros((60, 12))
    for row, n in zip(wide, rows, strict=True):
        row[: len(n)] = n
    place, size = np.arange(12), np.array([len(n) for n in rows])
    x = np.tile(place + 0.5, (60, 1))
    used = (place < size[:, None]) & (x >= 1)
    mode = wide.argmax(axis=1) + 0.5
    mean, sd = waveforms.truncated_gaussians(x, wide, used, wide.max(axis=1), mode, np.full(60, 2.0))
    alone = [waveforms.truncated_gaussian(np.arange(len(n)) + 0.5, n, n.max(), m, 2.0, 1.0)[1:] for n, m in zip(rows, mode, strict=True)]
    same = np.isclose(mean, [a[0] for a in alone], rtol=1e-6, atol=1e-6) & np.isclose(sd, [a[1] for a in alone], rtol=1e-6, atol=1e-6)
    assert same.mean() == pytest.approx(1.0)


@pytest.mark.parametrize("most", [200_000, 20])
def test_jitter_is_counted_by_blocks_of_units(spark, monkeypatch, most):
    rng = np.random.default_rng(5)
    rows = [(int(u), i, int(t)) for i, (u, t) in enumerate(zip(rng.integers(0, 7, 150), rng.integers(-400, 400, 150), strict=True))]
    df = spark.createDataFrame([*rows, (None, 900, 5), (3, 901, None)], "unit long, id long, t long")
    draws = spark.createDataFrame([(u, i, d, t + 7 * d - 5) for u, i, t in rows for d in range(2)], "unit long, id long, draw int, t long")
    monkeypatch.setattr(correlograms, "CELLS", 64)  # blocks of one unit or two
    monkeypatch.setattr(surrogates, "PAIRS", 9)
    pairs = surrogates._by_pair(df, 10, 2, draws, 2, most)
    assert "range_join" not in pairs._jdf.queryExecution().toString() and "_bucket" not in pairs._jdf.queryExecution().toString()
    want, reached = Counter(), defaultdict(set)
    for d, left in [(-1, rows), *((d, [(u, i, t + 7 * d - 5) for u, i, t in rows]) for d in range(2))]:
        for u1, i1, t1 in left:
            for u2, _, t2 in rows:
                if u1 != u2 and abs(t2 - t1) < 30:
                    side = t2 >= t1
                    want[u1, u2, d, (1 if side else -1) * (abs(t2 - t1) // 10), side] += 1
                    if d < 0:
                        reached[u1, u2].add(i1)
    larger = lambda u1, u2, d, b: max(want[u1, u2, d, b, True], want[u1, u2, d, b, False])
    got = {(r.u1, r.u2, r.bin): (r.spikes, r.n, r.fake) for r in surrogates._rows(pairs, 2, 2).collect()}
    assert got == {(u1, u2, b): (len(s), larger(u1, u2, -1, b), sum(larger(u1, u2, d, b) for d in range(2))) for (u1, u2), s in reached.items() for b in range(-2, 3)}


def test_quantiles_of_poisson_laws_by_batches(spark):
    rows = [(u, m) for u in (1e-9, 0.3, 0.5, 0.99, 1 - 1e-12) for m in (0.01, 0.7, 3.0, 40.0, 900.0)] + [(None, 1.0), (0.5, None)]
    df = spark.createDataFrame(rows, "u double, m double").select("u", "m", surrogates.poisson_quantile(F.col("u"), F.col("m")).alias("k"))
    assert "aggregate(" not in df._jdf.queryExecution().toString()
    for r in df.collect():
        if r.u is None or r.m is None:
            assert r.k is None
            continue
        p = c = math.exp(-r.m)
        k = 0
        for i in range(1, min(math.ceil(r.m + 10 * math.sqrt(r.m) + 20), 200) + 1):
            k += r.u > c
            p *= r.m / i
            c += p
        assert r.k == k


def test_nearest_rows_in_strips():
    rng = np.random.default_rng(6)
    x, f = rng.integers(0, 4, (70, 3)).astype(float), rng.integers(0, 4, (31, 3)).astype(float)
    whole, strips = (quality.nearest_rows(x, np.arange(70), f, np.arange(31), 4, held) for held in (1 << 20, 150))
    assert all(np.array_equal(a, b) for a, b in zip(whole, strips, strict=True))
    d = ((f[:, None] - x[None]) ** 2).sum(axis=2)
    d[np.arange(31), np.arange(31)] = np.inf
    assert strips[1].reshape(31, 4).tolist() == [sorted(range(70), key=lambda j: (d[i, j], j))[:4] for i in range(31)]


def test_distances_of_blocks_are_summed_for_both_sides():
    rng = np.random.default_rng(7)
    x, y = rng.normal(0, 1, (40, 5)), rng.normal(0, 1, (30, 5))
    y[:9] = x[:9]  # copies
    of_x, of_y = rng.integers(0, 3, 40), rng.integers(0, 2, 30)
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    left, right = clusters.distance_sums(x, y, of_x, of_y, 2, 3, 64)
    assert np.allclose(left, np.stack([d[:, of_y == k].sum(axis=1) for k in range(2)], axis=1), rtol=1e-12, atol=1e-12)
    assert np.allclose(right, np.stack([d[of_x == k].sum(axis=0) for k in range(3)], axis=1), rtol=1e-12, atol=1e-12)


def test_logarithms_of_the_normal_law_come_by_batches(spark):
    df = spark.createDataFrame([(x,) for x in (-30.0, -3.0, -0.5, 0.0, 2.0, 9.0)], "z double").select("z", distributions.log_normal_cdf(F.col("z")).alias("l"))
    assert "aggregate(" not in df._jdf.queryExecution().toString()
    assert all(r.l == pytest.approx(math.log(0.5 * math.erfc(-r.z / math.sqrt(2))), rel=1e-7, abs=1e-12) for r in df.collect())


def test_chunks_of_different_shapes_are_whitened_together(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (3, 50))
    cuts = [0, 7, 14, 15, 40, 50]
    rows = [(c, k, x[c, a:b].tolist()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) for c in range(3)]
    s = spark.createDataFrame(rows, "channel long, chunk long, samples array<double>").repartition(4)
    m = rng.normal(0, 1, (3, 3))
    out = signals.mixed(s, m)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    got = {(r.channel, r.chunk): r.samples for r in out.collect()}
    assert all(np.allclose(got[c, k], (m @ x)[c, cuts[k] : cuts[k + 1]]) for c, k, _ in rows) and len(got) == len(rows)
    cov = {(r.c1, r.c2): r.covariance for r in signals.covariance(s).collect()}
    assert all(np.isclose(v, np.cov(x, bias=True)[i, j]) for (i, j), v in cov.items()) and len(cov) == 6


@pytest.mark.parametrize("cells", [1 << 20, 100])
def test_stable_periods_have_no_row_for_each_bin(spark, monkeypatch, cells):
    rng = np.random.default_rng(9)
    width, bins = 10, 40
    n = rng.poisson(rng.choice([0.2, 1, 3, 6], size=(60, bins // 8)).repeat(8, axis=1))
    n[7] = 0  # a unit whose spikes are all outside
    rows = [(u, b * width + j % width) for u in range(60) for b in range(bins) for j in range(n[u, b])]
    rows += [(7, bins * width), (7, -3), (8, None), (9, -1), (9, bins * width + 5), (None, 5), (None, 15)]
    monkeypatch.setattr(rates, "CELLS", cells)  # of 100: two units at a time
    out = rates.stable_periods(spark.createDataFrame(rows, "unit long, t long"), width, bins * width, 2.0, 150)
    assert not {"Window", "explode", "Join"} & set(out._jdf.queryExecution().optimizedPlan().toString().replace("(", " ").split())
    kernel = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    want = {u: stable((n[u], np.convolve(np.pad(n[u], 8, mode="symmetric"), kernel / kernel.sum(), "valid")), width, 150, rates.stability_levels()) for u in range(60)}
    got = {r.unit: (r.start, r.stop, r.level) for r in out.collect()}
    assert got == {u: v for u, v in want.items() if v} and got[7] == (0, 150, 0)
    assert len({v[2] for v in got.values()}) > 3


@pytest.mark.parametrize("size", [1, 3, 9, 30])
def test_units_of_different_lengths_are_smoothed_as_alone(spark, monkeypatch, size):
    rng = np.random.default_rng(size)
    trains = {u: rng.poisson(3, size + u % 3) for u in range(20)}
    dense = spark.createDataFrame([(u, b, int(v), f"{u}:{b}") for u, x in trains.items() for b, v in enumerate(x)] + [(50, 0, None, "")], "unit long, bin long, n long, tag string")
    monkeypatch.setattr(rates, "CELLS", 16)
    out = rates.gaussian_smoothed(dense.repartition(5), 1.5)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.unit, r.bin): r for r in out.collect()}
    assert out.columns == ["unit", "bin", "n", "tag", "smooth"] and len(rows) == dense.count() and rows[50, 0].n is None and rows[50, 0].smooth == 0
    k = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    for u, x in trains.items():
        for b in range(len(x)):
            near = [(o, -b - o - 1 if b + o < 0 else 2 * len(x) - 1 - b - o if b + o >= len(x) else b + o) for o in range(-6, 7)]
            want = sum(x[i] * k[o + 6] for o, i in near if 0 <= i < len(x)) / k.sum()
            assert rows[u, b].tag == f"{u}:{b}" and rows[u, b].smooth == pytest.approx(want)


def uneven(rng, gaps):
    """(x, rows, cuts) of two channels in 150 chunks of 0 to 9 samples, some null, numbered from below 0 and with gaps."""
    n = rng.integers(0, 10, 150)
    n[40:75] = 0  # more than a run of nothing
    cuts = np.concatenate([[0], np.cumsum(n)])
    x = rng.normal(0, 1, (2, cuts[-1]))
    at = (np.arange(150) * gaps) - 50
    rows = [(c, int(at[k]), x[c, cuts[k] : cuts[k + 1]].tolist() or (None if k % 2 else [])) for c in range(2) for k in range(150)]
    return x, rows, {int(at[k]): (cuts[k], cuts[k + 1]) for k in range(150)}


@pytest.mark.parametrize("gaps", [1, 7, 40])
@pytest.mark.parametrize("half", [2, 90])
def test_gain_is_controlled_by_runs_of_chunks(spark, gaps, half):
    x, rows, cuts = uneven(np.random.default_rng(10), gaps)
    s = spark.createDataFrame([*rows, (0, None, [1.0]), (None, 3, [1.0])], "channel long, chunk long, samples array<double>").repartition(5)
    out = signals.gain_controlled(s, 2 * half)
    plan = out._jdf.queryExecution()
    assert not re.search(r"Join [^\n]*chunk#", plan.optimizedPlan().toString())  # no chunk has a halo, level or gain to meet of its own
    assert not re.search(r"hashpartitioning\(channel#\d+L?, \d+\)[^\n]*\n[^\n]*Map", plan.executedPlan().toString())  # nor are levels shuffled by channel
    taps = np.hanning(2 * half + 1)
    level = np.stack([np.convolve(np.pad(np.abs(r), half), taps / taps.sum(), "valid") for r in x])
    level += level.mean(axis=1, keepdims=True) * 1e-8
    got = {(r.channel, r.chunk): r for r in out.collect()}
    assert len(got) == len(rows)
    for c, k, _ in rows:
        a, b = cuts[k]
        assert np.allclose(got[c, k].samples, x[c, a:b] / level[c, a:b]) and np.allclose(got[c, k].gain, 1 / level[c, a:b])


def test_halos_of_runs_keep_types_and_columns(spark, monkeypatch):
    x, rows, cuts = uneven(np.random.default_rng(11), 3)
    monkeypatch.setattr(signals, "HALOS", 1)  # a run at a time
    s = spark.createDataFrame([(c, k, v, f"{c}:{k}") for c, k, v in rows], "channel int, chunk int, samples array<float>, tag string").repartition(5)
    out = signals.with_halo(s, 12)
    assert [f.dataType for f in out.schema] == [*(f.dataType for f in s.schema), *[s.schema["samples"].dataType] * 2]
    assert not re.search(r"Join [^\n]*chunk#", out._jdf.queryExecution().optimizedPlan().toString())
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        a, b = cuts[r.chunk]
        assert r.tag == f"{r.channel}:{r.chunk}"
        for part, want in ((r.samples, x[r.channel, a:b]), (r.before, x[r.channel, max(0, a - 12) : a]), (r.after, x[r.channel, b : b + 12])):
            assert part == want.astype("f4").tolist()


def test_chunks_of_any_length_are_turned(spark):
    rows = [(5, [1.0, 2.0, None, 4.0, 5.0, 6.0]), (6, [7.0, 8.0]), (7, None), (None, [9.0, 10.0]), (8, []), (9, [11.0, 12.0])]
    out = tables.by_channel(spark.createDataFrame(rows, "chunk long, samples array<float>").coalesce(1), 2)
    assert out.schema["samples"].dataType.simpleString() == "array<float>"
    assert {(r.chunk, r.channel): r.samples for r in out.collect()} == {(k, c): (v or [])[c::2] for k, v in rows for c in range(2)}
    with pytest.raises(Exception, match="lacks channels"):
        tables.by_channel(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "chunk long, samples array<float>"), 2).collect()
