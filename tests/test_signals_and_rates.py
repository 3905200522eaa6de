import numpy as np
import pytest
from tidewave.functions import scalars
from tidewave.operators import behaviour, rates, signals
from pyspark.sql import functions as F


def signal(spark, x, size):
    rows = [(c, k, x[c, k * size : (k + 1) * size].tolist()) for c in range(len(x)) for k in range(-(-x.shape[1] // size))]
    return spark.createDataFrame(rows, "channel long, chunk long, samples array<double>")


def whole(df):
    out = {}
    for r in df.orderBy("channel", "chunk").collect():
        out.setdefault(r.channel, []).extend(r.samples)
    return np.array([out[c] for c in sorted(out)])


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(0).normal(size=(4, 1000))


def test_filter_over_chunks_is_that_over_the_whole(spark, noise):
    kernel = signals.band_kernel(1000.0, 50.0, 200.0, 41)
    got = whole(signals.filtered(signal(spark, noise, 130), kernel))
    assert np.allclose(got, [np.convolve(x, kernel, "same") for x in noise])


def test_common_average(spark, noise):
    got = whole(signals.common_average_removed(signal(spark, noise[:, :90], 40)))
    assert np.allclose(got, noise[:, :90] - np.median(noise[:, :90], axis=0))


def test_whitening(spark, noise):
    x = np.array([[1, 0.5, 0, 0], [0, 1, 0.3, 0], [0, 0, 1, 0], [0.2, 0, 0, 2]]) @ noise
    df = signal(spark, x, 250)
    cov = {(r.c1, r.c2): r.covariance for r in signals.covariance(df).collect()}
    assert cov[0, 1] == pytest.approx(np.cov(x, bias=True)[0, 1])
    y = whole(signals.mixed(df, signals.whitening_matrix(df, 1e-9)))
    assert np.allclose(np.cov(y, bias=True), np.eye(4), atol=1e-5)


def test_cross_spectrum_peaks_at_a_shared_tone(spark, noise):
    t = np.arange(256) / 256
    rows = [(1, 2, k, (np.sin(2 * np.pi * 32 * t) + 0.1 * noise[0, :256]).tolist(), (np.sin(2 * np.pi * 32 * t + 1) + 0.1 * noise[1, :256]).tolist()) for k in range(3)]
    s = signals.cross_spectrum(spark.createDataFrame(rows, "u1 long, u2 long, segment_id long, x array<double>, y array<double>"), 256.0, 256)
    assert s.orderBy(F.desc("magnitude")).first().frequency == 32


def test_shift_by_parts_of_a_sample(spark):
    t = np.arange(64)
    x = np.cos(2 * np.pi * 4 * t / 64)[None]
    shifts = spark.createDataFrame([(0, 0.5)], "channel long, shift double")
    # the ends are mirrored, so a tone that goes on beyond them is met inside only
    assert np.allclose(whole(signals.shifted(signal(spark, x, 64), shifts))[0][8:-8], np.cos(2 * np.pi * 4 * (t - 0.5) / 64)[8:-8], atol=5e-3)


def test_smoothing_mirrors_the_ends(spark):
    df = spark.createDataFrame([(1, b, n) for b, n in enumerate([5, 0, 0, 1, 0, 0, 0, 2])], "unit long, bin long, n long")
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    want = np.convolve(np.pad([5, 0, 0, 1, 0, 0, 0, 2], 4, mode="symmetric"), k / k.sum(), "valid")
    assert [r.smooth for r in rates.gaussian_smoothed(df, 1.0).orderBy("bin").collect()] == pytest.approx(want.tolist())


def test_quadrature(spark):
    states = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0), (0, 1), (1, 1), (1, 1)]
    df = spark.createDataFrame([(1, t, a, b) for t, (a, b) in enumerate(states)], "unit long, t long, a int, b int")
    assert [r.step for r in behaviour.rotary_ticks(df).orderBy("t").collect()] == [1, 1, 1, 1, -1, -1]


def test_frames_and_analogue_events(spark):
    frames = spark.createDataFrame([(1, 0), (1, 9), (1, 10), (1, 14), (1, 15), (2, 2), (2, 2), (3, 0)], "session int, frame long")
    videos = spark.createDataFrame([(1, "a", 10, 0), (1, "b", 5, 1), (2, "c", 0, 0), (2, "d", 3, 1)], "session int, video string, frames long, place int")
    assert sorted(tuple(r) for r in behaviour.frame_of(frames, videos).collect()) == [(1, 0, "a", 0), (1, 9, "a", 9), (1, 10, "b", 0), (1, 14, "b", 4), (2, 2, "d", 2), (2, 2, "d", 2)]
    df = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate([0, 0, 5, 5, 0, 5])], "channel string, i long, v double")
    assert sorted((r.i, r.edge) for r in behaviour.threshold_events(df).collect()) == [(2, 1), (4, -1), (5, 1)]


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 8.0, 16.0], "a = 1\nb='x'\n# no", "12e3", " unlabeled ")], "a array<double>, s string, n string, l string")
    a = F.col("a")
    r = df.select(scalars.pieces(a, 3, 1).alias("p"), scalars.padded(a, 7).alias("q"), scalars.interpolated(a, 2).alias("i"), scalars.array_std(a).alias("d"), scalars.settings(F.col("s")).alias("m"), scalars.is_number(F.col("n")).alias("n"), scalars.clean_label(F.col("l")).alias("l")).first()
    assert r.p == [[1, 2, 4], [4, 8, 16]] and r.q == [1, 2, 4, 8, 16, None, None] and r.i == [1, 1.5, 2, 3, 4, 6, 8, 12, 16]
    assert r.d == pytest.approx(np.std([1, 2, 4, 8, 16])) and r.m == {"a": "1", "b": "x"} and r.n and r.l is None
    assert scalars.bin_centres(6, 2) == [-2, 0, 2] and scalars.log_edges(100, 2) == pytest.approx([1, 10, 100])
