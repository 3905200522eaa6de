import json

import numpy as np
from pyspark.sql import functions as F
from tidewave.sources import arrays, tables, units
from tidewave.streaming import live


def test_spike_folder(spark, tmp_path):
    n = 5000
    data = {"spike_times": np.arange(n, dtype=np.uint64) * 3, "spike_clusters": (np.arange(n) % 7).astype(np.int32), "amplitudes": np.linspace(0, 1, n)[:, None], "spike_templates": (np.arange(n) % 5).astype(np.uint32)}
    for name, x in data.items():
        np.save(tmp_path / f"{name}.npy", x)
    rows = arrays.read_spike_folder(spark, str(tmp_path)).orderBy("spike_id").toPandas()
    assert rows.t.tolist() == data["spike_times"].tolist() and rows.unit.tolist() == data["spike_clusters"].tolist()
    assert np.allclose(rows.amplitude, data["amplitudes"][:, 0])
    some = arrays.read_npy(spark, str(tmp_path / "spike_times.npy"), "long", rows=100)
    assert some.count() == n and some.agg(F.sum("value")).first()[0] == int(data["spike_times"].sum())


def test_binary_recordings(spark, tmp_path):
    x = np.arange(3000, dtype="<i2").reshape(1000, 3)
    x.tofile(tmp_path / "a.bin")
    rows = tables.read_samples(spark, str(tmp_path / "a.bin"), 3, frames=128).orderBy("chunk").collect()
    assert [r.frame0 for r in rows] == list(range(0, 1000, 128)) and [v for r in rows for v in r.samples] == x.reshape(-1).tolist()
    (tmp_path / "b.paq").write_bytes(b"HEAD" + np.arange(40, dtype=">f4").tobytes())
    paq = arrays.read_paq(spark, str(tmp_path / "b.paq"), 4, 4, 10.0).filter("channel = 1").orderBy("i").collect()
    assert [r.v for r in paq] == list(range(1, 40, 4)) and paq[5].seconds == 0.5


def test_registry_and_metadata(spark, tmp_path):
    entry = {"dp": "/x", "ct": "PkC", "line": "l", "units": [1, 2], "ss": [1], "cs": [2]}
    (tmp_path / "r.json").write_text(json.dumps({"one": entry, "two": entry | {"units": []}}))
    assert {r.dataset: r.units for r in tables.read_registry(spark, str(tmp_path / "r.json")).collect()} == {"one": [1, 2], "two": []}
    (tmp_path / "m.meta").write_text("a=1\nb = x=y\nnothing\n")
    assert {(r.key, r.value) for r in arrays.metadata(spark, str(tmp_path / "m.meta")).collect()} == {("a", "1"), ("b", "x=y")}


def test_channel_map_and_sync(spark):
    rows = arrays.channel_map(spark, 8).orderBy("channel").collect()
    assert [(r.x, r.y) for r in rows[:4]] == [(43, 20), (11, 20), (59, 40), (27, 40)]
    words = spark.createDataFrame([(i, w) for i, w in enumerate([0, 1, 5, 4, 0])], "i long, word int")
    assert sorted(tuple(r) for r in arrays.sync_edges(words, 4).collect()) == [(0, 1, 1), (0, 3, -1), (2, 2, 1), (2, 4, -1)]


def test_unit_tables(spark, tmp_path):
    s = spark.createDataFrame([(1, 10), (2, 20), (2, 30), (5, 40)], "unit long, t long")
    q = spark.createDataFrame([(1, "good"), (2, "mua"), (9, "noise")], "unit long, group string")
    assert {tuple(r) for r in units.repaired(q, s).collect()} == {(1, "good"), (2, "mua"), (5, "unsorted")}
    assert units.is_stale(q, s) and not units.is_stale(q, s.filter("unit < 5"))
    peaks = spark.createDataFrame([(1, 3), (2, 8)], "unit long, channel int")
    assert [r.unit for r in units.units(q, "good", peaks, (0, 5)).collect()] == [1]
    assert units.append_unit(s, spark.createDataFrame([(7,)], "t long")).filter("unit = 6").first().t == 7
    store = str(tmp_path / "store")
    neurons = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y")], "dataset string, unit long, label string")
    units.add_neurons(store, neurons)
    new = units.relabelled(spark.read.parquet(store), spark.createDataFrame([("d", 2, "z")], "dataset string, unit long, label string"), ["z"])
    assert {r.unit: r.label for r in new.collect()} == {1: "x", 2: "z"}
    assert units.without(neurons, neurons.filter("unit = 1")).count() == 1


def stream(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "unit long, id long, t long").withColumn("ts", F.timestamp_micros("t"))
    for k in range(3):
        df.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(path), df


def drained(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path):
    hour = 3_600_000_000
    rows = [(i % 2, i, 1000 * hour + i * hour // 2) for i in range(40)] + [(0, 100, 1200 * hour)]
    live_rows, batch = stream(spark, tmp_path, rows)
    counts = drained(live.windowed_counts(live_rows, "2 hours"), spark, "counts")
    assert counts.agg(F.sum("n")).first()[0] == 40
    sessions = drained(live.bouts(live_rows, "3 hours"), spark, "bouts").collect()
    assert sorted(r.n for r in sessions) == [20, 20]
    assert drained(live.distinct_events(live_rows, "id"), spark, "distinct_ids").count() == 41


def test_refractory_stream_equals_batch(spark, tmp_path):
    from tidewave.operators.trains import enforce_refractory

    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(3)), i, int(t)) for i, t in enumerate(np.sort(rng.integers(0, 10**9, 200)))]
    live_rows, batch = stream(spark, tmp_path, rows)
    got = drained(live.refractory(live_rows, 10**7), spark, "kept")
    want = enforce_refractory(batch, 10**7)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_json_metadata_of_streams(spark, tmp_path):
    import json

    from tidewave.sources import arrays

    for k in range(2):
        (tmp_path / f"r{k}.oebin").write_text(json.dumps({"GUI version": f"0.{k}", "continuous": [{"folder_name": f"probe{i}/", "sample_rate": 30000 / (i + 1), "num_channels": 384 - i, "channels": [{"bit_volts": 0.195}]} for i in range(k + 1)], "events": []}, indent=1))
    rows = arrays.open_ephys_metadata(spark, str(tmp_path / "*.oebin")).collect()
    assert sorted((r.version, r.stream, r.rate, r.channels) for r in rows) == [("0.0", "probe0", 30000.0, 384), ("0.1", "probe0", 30000.0, 384), ("0.1", "probe1", 15000.0, 383)]
