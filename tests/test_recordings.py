"""Signals in chunks of every size against numpy over the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_signals_and_rates import signal, whole
from tidewave.operators import extraction, signals, waveforms


def frames(spark, x, size):
    rows = [(k, x[:, k * size : (k + 1) * size].T.ravel().tolist()) for k in range(-(-x.shape[1] // size))]
    return spark.createDataFrame(rows, "chunk long, samples array<double>")


def of_frames(df, channels):
    return np.concatenate([np.reshape(r.samples, (-1, channels)).T for r in df.orderBy("chunk").collect()], axis=1)


@pytest.mark.parametrize("sizes", [[5, 1, 0, 3, 20, 2, 2, 9], [42], [1] * 42, [0, 42, 0]])
@pytest.mark.parametrize("halo", [0, 1, 4, 13, 100])
def test_halos_of_uneven_chunks(spark, sizes, halo):
    x = np.arange(42.0)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    rows = [(c, 10 * k, (x[a:b] + 100 * c).tolist()) for c in range(2) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = signals.with_halo(spark.createDataFrame(rows, "channel long, chunk long, samples array<double>"), halo).collect()
    assert len(got) == len(rows)
    for r in got:
        a, b = cuts[r.chunk // 10], cuts[r.chunk // 10 + 1]
        assert r.before == (x[max(0, a - halo) : a] + 100 * r.channel).tolist() and r.after == (x[b : b + halo] + 100 * r.channel).tolist()


def test_one_channel_uses_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = signals.with_halo(signal(spark, np.zeros((1, 4_000)), 10), 3).withColumn("task", F.spark_partition_id())
        assert out.select("task").distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("size", [7, 100, 1000])
def test_shift_does_not_depend_on_the_cut(spark, size):
    t = np.arange(600)
    x = np.stack([np.cos(2 * np.pi * 0.0371 * t + 0.3), np.sin(2 * np.pi * 0.11 * t)])
    shifts = spark.createDataFrame([(0, 0.5), (1, -0.25)], "channel long, shift double")
    got = whole(signals.shifted(signal(spark, x, size), shifts))
    want = np.stack([np.cos(2 * np.pi * 0.0371 * (t - 0.5) + 0.3), np.sin(2 * np.pi * 0.11 * (t + 0.25))])
    assert np.abs(got - want)[:, 60:-60].max() < 2e-3


@pytest.mark.parametrize("size", [7, 90, 1000])
def test_chunk_matrices_in_one_row(spark, size):
    x = np.random.default_rng(1).normal(size=(5, 400)) * np.arange(1, 6)[:, None]
    one, many = frames(spark, x, size), signal(spark, x, size)
    assert np.allclose(of_frames(signals.common_average_removed(one, 5), 5), x - np.median(x, axis=0))
    assert np.allclose(whole(signals.common_average_removed(many)), x - np.median(x, axis=0))
    cov = {(r.c1, r.c2): r.covariance for r in signals.covariance(one, 5).collect()}
    assert all(v == pytest.approx(np.cov(x, bias=True)[k]) for k, v in cov.items()) and len(cov) == 15
    m = np.random.default_rng(2).normal(size=(5, 5))
    assert np.allclose(of_frames(signals.mixed(one, m, 5), 5), m @ x) and np.allclose(whole(signals.mixed(many, m)), m @ x)


def test_frames_are_not_shuffled(spark):
    df = signals.mixed(signals.common_average_removed(frames(spark, np.ones((3, 50)), 10), 3), np.eye(3), 3)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_local_whitening(spark):
    rng = np.random.default_rng(3)
    x = (4 * np.eye(6) + rng.normal(size=(6, 6))) @ rng.normal(size=(6, 3_000))
    near, cov = 2, np.cov(x, bias=True)
    got = signals.whitening_matrix(frames(spark, x, 512), near=near, channels=6)
    for i in range(6):
        closest = sorted(range(6), key=lambda c: (abs(c - i), c))[: near + 1]
        w, v = np.linalg.eigh(cov[np.ix_(closest, closest)])
        want = np.zeros(6)
        want[closest] = (v @ np.diag(1 / np.sqrt(w + 1e-6)) @ v.T)[0]
        assert np.allclose(got[i], want)
    assert np.allclose(signals.whitening_matrix(frames(spark, x, 512), near=5, channels=6), signals.whitening_matrix(signal(spark, x, 512)), atol=1e-6)
    assert np.allclose(np.cov(signals.whitening_matrix(signal(spark, x, 700)) @ x, bias=True), np.eye(6), atol=1e-3)


@pytest.mark.parametrize("size", [7, 60, 1000])
def test_gain_control(spark, size):
    x = np.random.default_rng(4).normal(size=(3, 300)) * np.array([1, 10, 0])[:, None] * np.linspace(0.5, 4, 300)
    window = 41
    taps = np.hanning(round(window / 2) * 2 + 1)
    level = np.stack([np.convolve(np.abs(r), taps / taps.sum(), "same") for r in x])
    level += level.sum(axis=1, keepdims=True) * 1e-8 / 300
    out = signals.gain_controlled(signal(spark, x[:2], size), window)
    assert np.allclose(whole(out), x[:2] / level[:2])
    gain = whole(out.withColumn("samples", F.col("gain")))
    assert np.allclose(gain, 1 / level[:2])


@pytest.mark.parametrize("size", [50, 1000])
def test_filter_along_the_probe(spark, size):
    channels, pad = 48, 10
    m = signals.along_probe_matrix(channels, pad, 0)
    y, x = np.arange(channels), np.random.default_rng(5).normal(size=120)
    slow, fast = np.cos(2 * np.pi * y / 200)[:, None] * x, np.cos(np.pi * y * 0.6)[:, None] * x
    inner = slice(12, -12)
    assert np.abs(m @ slow)[inner].max() < 0.05 * np.abs(slow).max() and np.allclose((m @ fast)[inner], fast[inner], atol=0.02 * np.abs(fast).max())
    # by hand: mirror, fade, lay the kernel over, crop
    t = np.arange(channels + 2 * pad)
    fade = (1 - np.cos(np.clip(t / pad, 0, 1) * np.pi)) / 2 * (1 - (1 - np.cos(np.clip((t - channels - pad) / pad, 0, 1) * np.pi)) / 2)
    kernel = signals.butterworth_kernel(2.0, 0.1, None, 3, 4 * len(t) + 1)
    z = np.concatenate([slow[:pad][::-1], slow, slow[-pad:][::-1]]) * fade[:, None]
    want = np.stack([np.convolve(c, kernel, "same") if len(c) >= len(kernel) else np.convolve(c, kernel)[len(kernel) // 2 :][: len(c)] for c in z.T]).T[pad:-pad]
    assert np.allclose(signals.along_probe_matrix(channels, pad) @ slow, want)
    both = slow + fast
    got = whole(signals.filtered_along_probe(signal(spark, both, size), signals.along_probe_matrix(channels, pad), None))
    assert np.allclose(got, signals.along_probe_matrix(channels, pad) @ both)
    taps = np.hanning(round(31 / 2) * 2 + 1)
    level = np.stack([np.convolve(np.abs(r), taps / taps.sum(), "same") for r in both])
    level += level.sum(axis=1, keepdims=True) * 1e-8 / 120
    got = whole(signals.filtered_along_probe(signal(spark, both, size), m, 31))
    assert np.allclose(got, (m @ (both / level)) * level)


def test_a_far_outlier_keeps_the_rule_of_bins(spark):
    a = np.random.default_rng(6).normal(50, 5, 4_000).tolist() + [3_000_000.0]
    df = spark.createDataFrame([(0, v) for v in a], "unit long, a double")
    q1, q3 = np.quantile(a, [0.25, 0.75])
    rule = int((max(a) - min(a)) // (2 * (q3 - q1) / len(a) ** (1 / 3)) + 1)
    assert rule > 1_000_000
    row = waveforms.missing_spikes(df).first()
    assert row.bins == rule and waveforms.missing_spikes(df, most_bins=1_000).first().bins == 1_000


def test_means_of_waves_over_batches(spark):
    rng = np.random.default_rng(7)
    rows = [(int(u), int(c), None if k % 50 == 7 else rng.normal(size=12 if k % 9 else 8).tolist()) for k, (u, c) in enumerate(rng.integers(0, 3, (400, 2)))]
    df = spark.createDataFrame([*rows, (9, 9, [])], "unit long, channel long, wave array<double>").repartition(5)
    got = {(r.unit, r.channel): r for r in extraction.mean_waves(df).collect()}
    assert set(got) == {(u, c) for u, c, w in rows if w}
    for (u, c), r in got.items():
        mine = [w for a, b, w in rows if (a, b) == (u, c) and w]
        assert r.n == len(mine)
        assert r.wave == pytest.approx([np.mean([w[i] for w in mine if i < len(w)]) for i in range(12)])
