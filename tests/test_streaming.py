"""Streams give what a batch gives, whatever the order of arrival inside the watermark."""

import numpy as np
import pandas as pd
import pytest

from sigloom.functions import design, kernels
from sigloom.streaming import processors as P


@pytest.fixture(scope="module")
def arrivals(tmp_path_factory):
    """Three files of samples, shuffled inside each file; a few samples of file k come in file k + 1."""
    folder = tmp_path_factory.mktemp("stream")
    rng = np.random.default_rng(0)
    n = 300
    x = {c: rng.standard_normal(n).cumsum() for c in (1, 2)}
    rows = pd.DataFrame([(0, c, k, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=k), float(x[c][k])) for c in x for k in range(n)], columns=["recording_id", "channel", "sample_idx", "ts", "value"])
    rows["part"] = np.clip((rows.sample_idx + rng.integers(0, 8, len(rows))) // 100, 0, 2)
    for k in range(3):
        rows[rows.part == k].drop(columns="part").sample(frac=1, random_state=k).astype({"ts": "datetime64[us]"}).to_parquet(folder / f"{k}.parquet")
    end = pd.DataFrame({"recording_id": [0, 0], "channel": [1, 2], "sample_idx": [10_000, 10_000], "ts": pd.to_datetime(["2024-02-01"] * 2).astype("datetime64[us]"), "value": [0.0, 0.0]})
    end.to_parquet(folder / "3.parquet")
    end.assign(sample_idx=10_001, ts=pd.to_datetime(["2024-02-02"] * 2).astype("datetime64[us]")).to_parquet(folder / "4.parquet")
    import os

    for k in range(5):
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return str(folder), x


SCHEMA = "recording_id long, channel long, sample_idx long, ts timestamp_ntz, value double"


def run(spark, df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name).toPandas()


SECTIONS = design.lowpass_sections(100.0, 10.0, 2)


@pytest.mark.parametrize(
    "name, step, batch",
    [
        ("cascade", P.Cascade(SECTIONS), lambda x: kernels.cascade(x, SECTIONS)[0]),
        ("rms", P.Rms(10), None),
        ("hits", P.Threshold(3.0, 4), lambda x: np.isin(np.arange(len(x)), kernels.refractory_hits(np.abs(x) > 3, 4)).astype(float)),
    ],
)
def test_stream_equals_batch(spark, arrivals, tmp_path, name, step, batch):
    folder, x = arrivals
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run(spark, P.online(stream, step, "20 seconds"), f"s_{name}", tmp_path)
    for c, values in x.items():
        own = got[(got.channel == c) & (got.sample_idx < 10_000)].sort_values("sample_idx")
        assert own.sample_idx.tolist() == list(range(300))
        want = batch(values) if batch else pd.Series(values).pow(2).rolling(10).mean().pow(0.5).to_numpy()
        assert np.allclose(own.y, want, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("step", [P.Moments(5), P.Percentile(0.5), P.Envelope(0.5, 0.1), P.Adaptive(3, 0.01), P.Adaptive(3, 0.5, 0.01), P.Rms(7), P.Threshold(1, 2), P.Cascade(SECTIONS), P.NearestTemplate([0.0, 5.0]), P.Matched([1.0, 2.0, -1.0], 1.0, 3)])
def test_steps_in_pieces(step):
    x = np.random.default_rng(1).standard_normal(200)
    whole, _ = step.run(x, step.start())
    state, parts = step.start(), []
    for k in (0, 1, 30, 31, 150, 200):
        part, state = step.run(x[sum(map(len, parts)) : k], state)
        parts.append(part)
    assert np.allclose(np.concatenate(parts), whole, equal_nan=True)


def test_windows_and_sessions(spark, arrivals, tmp_path):
    folder, x = arrivals
    stream = spark.readStream.schema(SCHEMA).parquet(folder).selectExpr("channel", "cast(ts as timestamp) as ts", "value")
    got = run(spark, P.windowed(stream, "1 minute", "20 seconds"), "s_windows", tmp_path / "a")
    assert got.groupby("channel").n.sum().to_dict() in ({1: 300, 2: 300}, {1: 301, 2: 301}, {1: 302, 2: 302})
    got = run(spark, P.bursts(stream, "1 hour", "20 seconds"), "s_bursts", tmp_path / "b")
    assert 300 in got.n.tolist()


def test_listener_and_sink(spark, arrivals, tmp_path):
    folder, _ = arrivals
    seen = []
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    query = P.into(lambda df, k: seen.append(df.count()), stream, str(tmp_path))
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == 604 and P.stale(0, 100, 50) and not P.stale(0, 10, 50)
    assert P.run_stats(spark.range(5)).count() == 5


def files(folder, parts):
    """One file for each part (a frame with times), in order."""
    import os

    folder.mkdir(exist_ok=True)
    for k, part in enumerate(parts):
        part.assign(ts=part.ts.astype("datetime64[us]")).to_parquet(folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return str(folder)


def seconds(k):
    return pd.Timestamp("2024-01-01") + pd.to_timedelta(k, unit="s")


def test_timers_release_what_waits(spark, tmp_path):
    """A channel that falls silent is released by the watermark that others move; what is late is counted."""
    rows = lambda c, at: pd.DataFrame({"recording_id": 0, "channel": c, "sample_idx": at, "ts": [seconds(k) for k in at], "value": [float(k) for k in at]})
    parts = [rows(1, [3, 1, 0, 2, 5]), rows(2, [0, 60]), rows(2, [90]), rows(1, [4]), rows(2, [95])]
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(files(tmp_path / "in", parts))
    got = run(spark, P.online(stream, P.Rms(1), "10 seconds"), "s_timers", tmp_path / "c")
    one = got[got.channel == 1]
    assert one.sample_idx.tolist() == [0, 1, 2, 3, 5] and one.y.tolist() == [0, 1, 2, 3, 5]
    assert got[got.channel == 2].sample_idx.tolist() == [0, 60]


def test_late_rows_are_counted(spark, tmp_path):
    rows = lambda at: pd.DataFrame({"recording_id": 0, "channel": 1, "sample_idx": at, "ts": [seconds(k) for k in at], "value": 1.0})
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(files(tmp_path / "in", [rows([0, 2, 3]), rows([1, 4]), rows([5, 0])]))
    got = run(spark, P.online(stream, P.Rms(1)), "s_late", tmp_path / "c")
    assert dict(zip(got.sample_idx, got.late)) == {0: 0, 2: 0, 3: 0, 4: 1, 5: 2}


def test_late_rows_behind_a_watermark_are_counted(spark, tmp_path):
    """Spark's own filter would drop them unseen. A row behind the watermark that nothing released precedes is not late."""
    rows = lambda at, value=1.0: pd.DataFrame({"recording_id": 0, "channel": 1, "sample_idx": at, "ts": [seconds(k) for k in at], "value": value})
    parts = [rows([0, 2, 4, 100]), rows([1, 3, 7, 120]), rows([130]), pd.concat([rows([5, 6, 99]), rows([140], np.nan)])]
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(files(tmp_path / "in", parts))
    got = run(spark, P.online(stream, P.Rms(1), "10 seconds"), "s_behind", tmp_path / "c")
    assert dict(zip(got.sample_idx, got.late)) == {**dict.fromkeys([0, 1, 2, 3, 4, 7, 100], 0), 120: 3, 130: 3}


def test_an_end_releases_the_tail(spark, tmp_path):
    """Streams whose channels end give what a batch gives, to the last sample."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal(120).cumsum()
    whole = pd.DataFrame({"recording_id": 0, "channel": 1, "sample_idx": range(120), "ts": [seconds(k) for k in range(120)], "value": x})
    end = pd.DataFrame({"recording_id": [0], "channel": [1], "sample_idx": [120], "ts": [seconds(120)], "value": [np.nan]})
    parts = [whole[:50].sample(frac=1, random_state=1), pd.concat([whole[50:], end]).sample(frac=1, random_state=2)]
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(files(tmp_path / "in", parts))
    got = run(spark, P.online(stream, P.Cascade(SECTIONS), "1 hour"), "s_end", tmp_path / "c")
    assert got.sample_idx.tolist() == list(range(120)) and np.allclose(got.y, kernels.cascade(x, SECTIONS)[0])


def test_sorted_segments_of_a_stream(spark, tmp_path):
    from sigloom.operators import sorter
    from sigloom.sources import synthetic

    frames, _ = synthetic.recording(spark, channels=8, seconds=1.0, units=2, rate=40.0)
    rows = frames.orderBy("sample_idx").toPandas()
    xy, config = np.c_[np.zeros(8), np.arange(8) * 25.0], sorter.SortConfig()
    table = pd.DataFrame({"recording_id": 0, "sample_idx": rows.sample_idx, "ts": [seconds(k / 30_000) for k in rows.sample_idx], "x": rows.x})
    end = pd.DataFrame({"recording_id": [0], "sample_idx": [len(rows)], "ts": [seconds(2.0)], "x": [None]})
    n = len(rows) // 2 + 17
    folder = files(tmp_path / "in", [table[:n].sample(frac=1, random_state=1), pd.concat([table[n:], end])])
    stream = spark.readStream.schema("recording_id long, sample_idx long, ts timestamp_ntz, x array<double>").option("maxFilesPerTrigger", 1).parquet(folder)
    got = run(spark, P.segments(stream, xy, config, 13_000, "1 second"), "s_segments", tmp_path / "c").sort_values(["sample", "channel"])
    library, want = sorter.TemplateLibrary(config, xy), []
    x = np.stack(rows.x)
    for a in range(0, len(x), 13_000):
        s = library.feed(x[a : a + 13_000])
        want += list(zip(s.sample.tolist(), s.channel.tolist(), s.label.tolist()))
    assert len(want) > 5 and list(zip(got["sample"], got.channel, got.label)) == sorted(want)


def test_named_spikes_of_a_stream(spark, tmp_path):
    rows = pd.DataFrame({"recording_id": 0, "sample": [3, 1, 2, 4], "ts": [seconds(0)] * 4, "x": [[9.0, 0.0], [0.1, 0.0], [1.0, 1.2], [0.3, 0.0]]})
    stream = spark.readStream.schema("recording_id long, sample long, ts timestamp_ntz, x array<double>").parquet(files(tmp_path / "in", [rows]))
    got = run(spark, P.classified(stream, np.array([[0.0, 0.0], [1.0, 1.0]]), 2.0, learn=1), "s_named", tmp_path / "c")
    assert got["sample"].tolist() == [1, 2, 3, 4] and got.template_id.tolist() == [0, 1, -1, 0]
    assert np.allclose(got.distance, [0.1, 0.2, np.hypot(8, 1.2), 0.2]) and got.seen.tolist() == [1, 2, 3, 4] and got.rejected.tolist() == [0, 0, 1, 1]


def test_watchdog(spark, tmp_path):
    now, seen = [0.0], []
    dog = P.Watchdog(P.WatchdogConfig(10.0, lambda query, waited: seen.append((query, waited))), lambda: now[0])
    dog.feed("a", 5)
    now[0] = 11.0
    assert dog.check() == ["a"] == dog.check() and seen == [("a", 11.0)]
    dog.feed("a", 1)
    assert dog.check() == []
    spark.streams.addListener(dog)
    try:
        rows = pd.DataFrame({"recording_id": [0], "channel": [1], "sample_idx": [0], "ts": [seconds(0)], "value": [1.0]})
        query = P.into(lambda df, k: df.count(), spark.readStream.schema(SCHEMA).parquet(files(tmp_path / "in", [rows])), str(tmp_path / "c"))
        query.processAllAvailable()
        query.stop()
        import time

        for _ in range(50):
            if any(n == 1 for q, n in dog.rows.items() if q != "a"):
                break
            time.sleep(0.1)
        assert any(n == 1 for q, n in dog.rows.items() if q != "a")
    finally:
        spark.streams.removeListener(dog)
