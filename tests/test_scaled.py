"""Steps whose work grows with the input alone, against brute force."""

from collections import Counter

import numpy as np
import pytest
from tidewave.operators import correlograms, linear, models, neighbours, peaks, quality


def test_mass_beyond_takes_distances_to_nine_places():
    # 0.5 and 0.1 are equally far from 0.3, which doubles don't say: the first of them counts
    assert np.isclose(quality.mass_beyond(np.array([[0.3, 0.9, 0.5, 0.1]]), 0.01), [0.6])


def test_amplitude_cutoff_of_a_sparse_unit(spark):
    rows = [(1, 0.0), (1, 1.0), (2, 3.0), (2, 3.0)]
    got = {r.unit: r.missing for r in quality.amplitude_cutoff(spark.createDataFrame(rows, "unit long, a double"), 50, 3.0).collect()}
    assert set(got) == {1} and 0 < got[1] <= 0.5  # a unit of one amplitude has no histogram


def test_no_peaks_in_nothing():
    assert peaks.spaced_peaks(np.zeros(0), 0, 1).tolist() == []


def test_recomposed_needs_no_expression_for_each_coordinate(spark):
    x = np.random.default_rng(3).normal(0, 1, (50, 40))
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    back = linear.recomposed(*linear.decomposed(points))
    assert len(back._jdf.queryExecution().toString()) < 20_000
    got = {(r.id, r.k): r.x for r in back.collect()}
    assert len(got) == x.size and all(np.isclose(got[i, k], x[i, k]) for i in range(50) for k in range(40))


def test_synchrony_joins_no_spikes_that_are_near(spark):
    rng = np.random.default_rng(4)
    trains = [(int(u), int(t)) for u, t in zip(rng.integers(0, 9, 400), rng.integers(0, 900, 400), strict=True)]
    at = [(i, int(t)) for i, t in enumerate(rng.integers(-30, 930, 90))] + [(90, None)]
    a, df = spark.createDataFrame(at, "id long, t long"), spark.createDataFrame([*trains, (None, 5), (3, None)], "unit long, t long")
    out = neighbours.population_synchrony(a, df, 3)
    assert "explode" not in out._jdf.queryExecution().toString()
    got = {r.id: r.fraction for r in out.collect()}
    assert got == {i: len({u for u, x in trains if t is not None and abs(x - t) <= 3}) / 9 for i, t in at}


def test_common_periods(spark):
    ps = lambda *x: spark.createDataFrame([(1, a, b) for a, b in x], "unit long, start long, stop long")
    got = neighbours.common(ps((0, 5), (7, 9), (20, 30)), ps((5, 7), (8, 8), (9, 12), (18, 22), (22, 25), (31, 40)))
    assert sorted((r.start, r.stop) for r in got.collect()) == [(5, 5), (7, 7), (8, 8), (9, 9), (20, 25)]


def test_correlograms_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(u), i, int(t)) for i, (u, t) in enumerate(zip(rng.integers(0, 7, 300), [*rng.integers(-900, 900, 250), *rng.integers(40, 44, 50)], strict=True))]
    want = Counter()
    for u1, i1, t1 in rows:
        for u2, i2, t2 in rows:
            if 0 <= t2 - t1 < 40 and (t2, u2, i2) > (t1, u1, i1):
                want[u1, u2, (t2 - t1) // 10] += 1
    df = spark.createDataFrame(rows, "unit long, id long, t long")
    monkeypatch.setattr(correlograms, "CELLS", 32)  # blocks of two units
    monkeypatch.setattr(correlograms, "PAIRS", 7)
    for most in (1_000, 20):  # 20: with time cut and bursts in parts
        half = correlograms.half_counts(df, 10, 3, most=most)
        assert "Join" not in half._jdf.queryExecution().optimizedPlan().toString() or most == 20
        assert {(r.u1, r.u2, r.bin): r.n for r in half.collect()} == want
        dense = {(r.u1, r.u2, r.bin): r.n for r in correlograms.dense_bins(correlograms.symmetric(half), 3).collect()}
        arrays = correlograms.symmetric_arrays(df, 10, 3, most)
        assert {(r.u1, r.u2, r.bin): r.n for r in correlograms.exploded(arrays, 3).collect()} == dense


def test_scores_and_runs_of_arrays(spark):
    rng = np.random.default_rng(6)
    arrays = spark.createDataFrame([(i, i + 1, rng.poisson(2, 25).tolist()) for i in range(30)] + [(99, 99, [1] * 25)], "u1 long, u2 long, counts array<long>")
    z = correlograms.array_zscores(arrays, 12)
    rows = correlograms.exploded(arrays, 12)
    want = correlograms.edge_zscore(rows, 12)
    got = {(r.u1, r.bin): r.z for r in correlograms.exploded(z, 12).collect()}
    assert got == {(r.u1, r.bin): pytest.approx(r.z) for r in want.collect()} and len(got) == 31 * 25
    by = lambda df: sorted((r.u1, r.first, r.last, r.n, r.at) for r in df.collect())
    assert by(models.modulations_of(correlograms.side_runs(z, 12, 1.0), 2)) == by(models.modulations(want, 1.0, 2))
    ratio = {r.u1: r.ratio for r in correlograms.array_ratio(arrays, 12, 1).collect()}
    assert ratio == {r.u1: pytest.approx(r.ratio) for r in correlograms.synchrony_ratio(rows, 12, 1).collect()}


def test_near_pairs_join_no_spikes(spark):
    rng = np.random.default_rng(7)
    rows = [(int(u), int(t)) for u, t in zip(rng.integers(0, 6, 200), rng.integers(-300, 300, 200), strict=True)]
    want = Counter((u, v) for u, s in rows for v, t in rows if u < v and abs(s - t) <= 5)
    df = spark.createDataFrame(rows, "unit long, t long")
    near = correlograms.near_pairs(df, 5)
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    for one in (near, correlograms.near_pairs(df, 5, 20)):
        assert {(r.u1, r.u2): r.pairs for r in one.collect()} == want
