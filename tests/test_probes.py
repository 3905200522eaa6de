"""Waves along a probe against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewave.functions import scalars
from tidewave.operators import probes

FS = 30_000.0


def wave(size, width=6.0, at=60, n=160, late=0.4):
    """A trough and a later, smaller peak."""
    t = np.arange(n)
    return -size * np.exp(-0.5 * ((t - at) / width) ** 2) + late * size * np.exp(-0.5 * ((t - at - 30) / (2 * width)) ** 2)


def table(spark, units):
    rows = [(u, c, w.tolist()) for u, by in units.items() for c, w in by.items()]
    return spark.createDataFrame(rows, "unit long, channel long, wave array<double>")


@pytest.fixture(scope="module")
def positions(spark):
    return spark.createDataFrame([(c, float(c % 2 * 32), float(c // 2 * 20)) for c in range(40)], "channel long, x double, y double")


def test_channels_within_a_radius(spark, positions):
    units = {u: {c: wave(100 if c == 5 * u else 10) for c in range(40)} for u in range(8)}
    places = probes.peak_places(table(spark, units), positions)
    assert {r.unit: (r.channel, r.x, r.y) for r in places.collect()} == {u: (5 * u, float(5 * u % 2 * 32), float(5 * u // 2 * 20)) for u in range(8)}
    xy = np.array([(c % 2 * 32, c // 2 * 20) for c in range(40)])
    for radius in (5.0, 21.0, 26.0, 45.0, 1000.0):
        got = {(r.unit, r.near): r.distance for r in probes.channels_within(places, positions, radius).collect()}
        far = {u: np.hypot(*(xy - xy[5 * u]).T) for u in range(8)}
        assert got == {(u, c): pytest.approx(far[u][c]) for u in range(8) for c in range(40) if c != 5 * u and far[u][c] < radius}


def test_spread_and_loud_channels(spark, positions):
    rng = np.random.default_rng(1)
    units = {u: {c: wave(rng.uniform(5, 90)) for c in range(40)} for u in range(5)}
    df = table(spark, units)
    xy = np.array([(c % 2 * 32, c // 2 * 20) for c in range(40)])
    spread = {r.unit: r.spread for r in probes.spread_ratio(df, positions).collect()}
    loud = {(r.unit, r.channel) for r in probes.loud_channels(df, 6).collect()}
    want = set()
    for u, by in units.items():
        ptp = np.array([np.ptp(by[c]) for c in range(40)])
        p = int(ptp.argmax())
        d = np.hypot(*(xy - xy[p]).T)
        assert spread[u] == pytest.approx(ptp[(d < 26) & (d > 0)].mean() / ptp[p])
        want |= {(u, c) for c in range(40) if abs(c - p) <= 6 and ptp[c] > 30}
    assert loud == want


@pytest.mark.parametrize("y, n, healthy, somatic", [
    (wave(100), 2, True, True),
    (-wave(100), 2, True, False),  # a peak and a trough: dendritic
    (wave(10), 2, False, False),  # too small
    (np.sin(np.arange(160) / 5) * 100, None, False, False),  # too many extremes
    (np.zeros(160), 0, False, False),
])
def test_kinds_of_waves(spark, y, n, healthy, somatic):
    r = probes.wave_kinds(table(spark, {1: {2: y}})).first()
    assert (r.healthy, r.somatic) == (healthy, somatic) and (n is None or r.n_extremes == n)
    assert r.ptp == pytest.approx(np.ptp(y))


def test_extremes_of_a_wave():
    places, values = probes.wave_extremes(wave(100))
    assert abs(places[0] - 60) <= 2 and values[0] < 0 < values[1] and len(places) == 2
    # a small peak after the deepest trough is found though it is under the margin
    y = wave(100, late=0.02)
    places, values = probes.wave_extremes(y)
    assert len(places) == 2 and values[1] < 0.8 * np.std(y)
    # nothing in the first and last fifth
    assert len(probes.wave_extremes(wave(100, at=10))[0]) == 0 or probes.wave_extremes(wave(100, at=10))[0].min() >= 32


def test_spatial_features(spark, positions):
    soma, dendrite, none = wave(100), -wave(60), wave(5)
    units = {1: {c: soma if c == 10 else dendrite if c == 12 else none for c in range(40)}, 2: {c: dendrite if c == 20 else none for c in range(40)}, 3: {c: soma if c == 7 else none for c in range(40)}}
    got = {r.unit: r for r in probes.spatial_features(table(spark, units), positions).collect()}
    assert got[1].dendritic == pytest.approx(0.6) and got[1].most_extremes == 2
    assert got[2].dendritic == 1.0 and got[3].dendritic == 0.0
    near = [c for c in range(40) if 0 < np.hypot((c % 2 - 7 % 2) * 32, (c // 2 - 7 // 2) * 20) < 26]
    assert got[3].spread == pytest.approx(0.05) and len(near) == 2


@pytest.mark.parametrize("sign", [-1, 1])
@pytest.mark.parametrize("at", [20, 60, 100])
def test_waves_are_conformed(sign, at):
    out = probes.conformed(sign * wave(80, at=at) + 7, FS, FS, 1e-3, 2e-3)
    assert len(out) == 90 and int(np.argmin(out)) == 30 and out.min() == pytest.approx(-1, abs=0.05)
    slow = probes.conformed(sign * wave(80, at=at), FS, FS / 2, 1e-3, 2e-3)
    assert len(slow) == 45 and np.allclose(slow, out[::2], atol=0.02)
    assert probes.conformed(np.ones(50), FS, FS, 1e-3, 2e-3).tolist() == [0.0] * 90
    assert probes.conformed(wave(80, at=at), FS, FS, 1e-3, 2e-3, sign=1, normalise=False).max() == pytest.approx(80, rel=0.05)


def test_padding_with_decay():
    a, b = np.array([4.0, 8.0]), np.array([2.0, 2.0])
    out = probes.padded_with_decay([None, None, a, None, b, None])
    assert out.tolist() == [[1, 2], [2, 4], [4, 8], [2, 4], [2, 2], [1, 1]]


def test_model_arrays_have_one_shape(spark, tmp_path):
    units = {1: {c: wave(100 * 0.7 ** abs(c - 10)) for c in range(40)}, 2: {c: -wave(50 * 0.8 ** c, at=50) for c in range(6)}, 3: {39: wave(70)}}
    arrays = probes.model_arrays(table(spark, units), FS, channels=6)
    got = {r.unit: r for r in arrays.collect()}
    assert {u: r.peak for u, r in got.items()} == {1: 10, 2: 0, 3: 39}
    shaped = {u: np.reshape(r.array, (6, 90)) for u, r in got.items()}
    for u, x in shaped.items():
        assert x[3].min() == pytest.approx(-1, abs=0.05) and np.argmin(x[3]) == 30, u
    assert np.allclose(shaped[1][2], shaped[1][3] * 0.7, atol=0.02) and np.allclose(shaped[2][0], shaped[2][3] / 8)
    assert np.allclose(shaped[3][5], shaped[3][3] / 4)
    curves = spark.createDataFrame([(u, [0.0, float(u)]) for u in (1, 2, 3)], "unit long, acg array<double>")
    labels = spark.createDataFrame([(1, "PkC"), (2, "GrC"), (3, "MLI"), (4, "PkC")], "unit long, label string")
    probes.model_table(arrays, curves, labels, ["GrC"]).write.parquet(str(tmp_path / "m"))
    rows = {r.unit: r for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert {u: (r.label, r.code, r.acg) for u, r in rows.items()} == {1: ("PkC", 1, [0.0, 1.0]), 3: ("MLI", 0, [0.0, 3.0])}
    assert all(rows[u].array == got[u].array for u in rows)


def test_bits_of_large_and_negative_numbers(spark):
    numbers = [0, 1, 6, (1 << 62) + 1, (1 << 53) + 1, -1, -2]
    df = spark.createDataFrame([(x,) for x in numbers], "x long").select("x", scalars.bits(F.col("x"), 64).alias("b"))
    for r in df.collect():
        assert sum(int(v) << k for k, v in enumerate(r.b)) == r.x % (1 << 64)
