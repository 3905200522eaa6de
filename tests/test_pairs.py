"""All pairs of units: spikes are copied by blocks of spikes, and pairs are measured where they are counted."""

from collections import Counter

import numpy as np
import pytest
from tidewave.operators import connections, correlograms, significance
from tidewave.plans import catalog as registry

PAIRED = """q_against_jitter q_ccg_significance q_ccg_zscore q_connection_edges q_main_edges q_modulation_features q_typed_connections q_ccg_poisson q_poisson_modulations
q_ccg_counts q_ccg_normalised q_ccg_symmetric q_delta_probability q_corr_index q_overlapping_hertz q_sync_ratio q_sync_zscore""".split()


@pytest.mark.parametrize("name", PAIRED)
def test_pairs_are_measured_where_they_are_counted(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("FlatMapGroupsInArrow")
    assert "Exchange" in below and "Exchange" not in above and "InArrow" not in above and "InPandas" not in above


def test_degrees_shuffle_units_and_no_pairs(spark):
    plan = registry.QUERIES["q_unit_degrees"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.partition("FlatMapGroupsInArrow")[0].count("Exchange") == 1


def trains(seed=3, units=9, n=240):
    rng = np.random.default_rng(seed)
    return [(int(u), i, int(t)) for i, (u, t) in enumerate(zip(rng.integers(0, units, n), rng.integers(-300, 300, n), strict=True))]


def test_copies_follow_the_spikes_and_not_the_units(spark, monkeypatch):
    monkeypatch.setattr(correlograms, "CELLS", 32)  # tables of few units
    rows = [(u, 3 * u + k, 7 * u + k) for u in range(2_000) for k in range(3)]
    cells, cut = correlograms._cells(spark.createDataFrame(rows, "unit long, id long, t long"), 40, 2_000)
    assert not cut and cells.count() <= 8 * len(rows)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_measures_where_time_is_cut(spark, monkeypatch, kind):
    monkeypatch.setattr(correlograms, "CELLS", 64)
    rows = trains()
    df = spark.createDataFrame(rows, "unit long, id long, t long").selectExpr(f"cast(unit as {kind}) unit", "id", "t")
    total = Counter(u for u, _, _ in rows)
    want = Counter((str(u), str(v), (s - t) // 10) for u, i, t in rows for v, j, s in rows if 0 <= s - t < 40 and (s, v, j) > (t, u, i))

    def counts(p):
        bins, pair = np.nonzero(p.n[:4])
        return p.batch(pair, bin=bins, n=p.n[bins, pair], k1=p.k1[pair], k2=p.k2[pair])

    for most in (100_000, 20):
        got = correlograms.measured_pairs(df, 10, 3, counts, "bin long, n long, k1 long, k2 long", most, totals=True).collect()
        assert {(str(r.u1), str(r.u2), r.bin): (r.n, r.k1, r.k2) for r in got} == {(u, v, b): (n, total[int(u)], total[int(v)]) for (u, v, b), n in want.items()}


@pytest.mark.parametrize("half", [12, 10])  # of 10 the outer bins are not the same either way round
def test_runs_against_rows(spark, half):
    df = spark.createDataFrame(trains(n=900), "unit long, id long, t long")
    dense = correlograms.dense_bins(correlograms.symmetric(correlograms.half_counts(df, 5, half)), half)
    sides = connections.normal_sides(correlograms.edge_zscore(dense, half), 1.2)
    near = lambda rows: sorted([round(v, 9) if isinstance(v, float) else v for v in r] for r in rows.collect())
    modulations = connections.modulation_features(sides, "z", 0.5, 2, half)
    assert near(connections.normal_modulations(df, 5, half, 1.2, 0.5, 2)) == near(modulations) != []
    for some in ({}, {"sign": -1}, {"low": 0.5, "high": 3.0}):
        assert near(connections.normal_edges(df, 5, half, 1.2, 0.5, 2, **some)) == near(connections.edges(modulations, **some)) != []
    assert near(connections.normal_edges(df, 5, half, 1.2, 0.5, 2, main=True)) == near(connections.main_edges(connections.edges(modulations)))
    tested = significance.poisson_test(dense, 4, half)
    assert near(significance.poisson_bins(df, 5, half, 4)) == near(tested.select("u1", "u2", "bin", "expected", "p_excess"))
    assert near(significance.poisson_runs(df, 5, half, 4, 0.2, 2)) == near(significance.poisson_modulations(tested, 0.2, 2, half).select("u1", "u2", "side", "first", "last", "n", "deviation")) != []


def test_scores_leave_out_spikes_of_no_unit(spark):
    df = spark.createDataFrame([*trains(), *((None, 1_000 + i, 7 * i) for i in range(40))], "unit long, id long, t long")
    known = df.filter("unit IS NOT NULL")
    for of in (lambda d: correlograms.ratio_synchrony(d, 10, 12, 1), lambda d: significance.poisson_runs(d, 10, 12, 4, 0.2, 2)):
        assert sorted(map(tuple, of(df).collect())) == sorted(map(tuple, of(known).collect())) != []
