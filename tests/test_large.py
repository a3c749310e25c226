"""Odd values and larger tables that a review found wanting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import columns as C
from sigloom.functions import kernels
from sigloom.operators import coupling, models, signals, trains
from sigloom.sources import files, writers


def test_sign_of_zero(spark):
    rows = spark.createDataFrame([(2.0, 0.0), (2.0, -0.0), (-3.0, 5.0), (3.0, -5.0), (None, 1.0)], "x double, y double")
    got = [r.z for r in rows.select(C.copysign(F.col("x"), F.col("y")).alias("z")).collect()]
    assert got == [2.0, -2.0, 3.0, -3.0, None]


def test_no_power_against_a_baseline(spark):
    rows = spark.createDataFrame([(0, 0, 2.0), (0, 1, 0.0), (0, 2, -1.0), (1, 0, 0.0), (1, 1, 1.0)], "c int, f int, p double")
    for mode, unit in (("db", 10), ("logratio", 1)):
        got = {(r.c, r.f): r.normalized for r in coupling.baseline_normalized(rows, ["c"], "f", "p", 0, 1, mode).collect()}
        assert got == {(0, 0): 0.0, (0, 1): -math.inf, (0, 2): None, (1, 0): None, (1, 1): None}, unit


@pytest.mark.parametrize("both", [False, True])
def test_correlograms_count_every_pair_without_making_it(spark, monkeypatch, both):
    """More pairs than could be made, and bins whose edges rounding would miss."""
    monkeypatch.setattr(trains, "PIECE", 50)
    rng = np.random.default_rng(3)
    a, b = (np.r_[rng.integers(0, 4000, 300) / 10, np.arange(30) * 0.1, -rng.random(40) * 300] for _ in range(2))
    lag = np.abs(b[None] - a[:, None]) if both else b[None] - a[:, None]
    bins, n = np.unique(np.floor(lag[(lag > 0) & (lag < 60)] / 0.7).astype(int), return_counts=True)
    one = lambda t, times: spark.createDataFrame([(t, float(x)) for x in times for _ in range(2)], "g int, t double")
    got = trains.correlogram(one(1, a), one(1, b), ["g"], 0.7, 60.0, both)
    assert {r.bin: r["count"] for r in got.collect()} == {int(k): 4 * int(m) for k, m in zip(bins, n)}


def test_dense_trains(spark):
    """Two times 60,000 distinct times within reach of each other: 3.6 thousand million pairs."""
    rows = spark.range(60_000).select(F.lit("k").alias("kind"), (F.col("id") / 8).alias("t"))
    got = {r.bin: r["count"] for r in trains.autocorrelogram(rows, ["kind"], 1000.0, 36000.0).collect()}
    lag = np.arange(1, 60_000)
    want = np.bincount((lag / 8 // 1000).astype(int), 60_000 - lag)
    assert got == {k: int(n) for k, n in enumerate(want)}


@pytest.mark.parametrize("nearest", [False, True])
def test_counted_spikes_match_as_single_ones(nearest):
    match, rng = (kernels.match_nearest if nearest else kernels.match_first), np.random.default_rng(5)
    for _ in range(300):
        a, b = (np.sort(rng.integers(0, 12, rng.integers(0, 15))) for _ in range(2))
        used, hits = [False] * len(b), 0
        for t in a.tolist():
            free = [k for k in range(len(b)) if not used[k] and abs(b[k] - t) <= 2]
            if free:
                used[min(free, key=lambda k: abs(b[k] - t)) if nearest else free[0]] = True
                hits += 1
        (u, n), (v, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        assert match(a.tolist(), b.tolist(), 2) == match(u.tolist(), v.tolist(), 2, n.tolist(), m.tolist()) == hits


def test_dense_coincidences(spark):
    """A million spikes of each side in one hour: pairs could not be made."""
    rows = lambda n: spark.range(n).select((F.col("id") % 2).alias("unit"), F.lit(7).cast("long").alias("sample"))
    got = {(r.gt, r.st): (r.tp, r.fp, r.fn) for r in signals.coincidences(rows(1_000_000), rows(600_000), 1).collect()}
    assert got == {(i, j): (300_000, 0, 200_000) for i in range(2) for j in range(2)}


def test_groups_across_batches(spark):
    """Many short groups, one that spans batches, keys that are null."""
    rows = spark.range(50_000).select(F.when(F.col("id") % 5 > 0, F.when(F.col("id") % 5 > 1, F.col("id") % 3000)).alias("k"), F.lit("a").alias("s"), (-F.col("id")).alias("sample_idx"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        calls = signals.per_group(rows, ["k", "s"], lambda t: {"n": [t.num_rows], "first": [t["sample_idx"][0].as_py()], "least": [min(t["sample_idx"].to_pylist())]}, "n long, first long, least long")
        got = sorted(calls.collect(), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = rows.groupBy("k", "s").agg(F.count("*").alias("n"), F.min("sample_idx").alias("first"), F.min("sample_idx").alias("least"))
    assert got == sorted(want.collect(), key=str)


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(60):
        streams = [{"id": k, "name": f"s{k}", "type": "EEG", "rate": 1.0, "format": "double64", "times": [1.0, None], "values": [[k], [-k]], "offsets": [(1.0, k / 8)]}]
        (tmp_path / f"{k}.xdf").write_bytes(writers.xdf(streams))
    files.register(spark)
    read = lambda table: spark.read.format("xdf").option("table", table).load(str(tmp_path))
    assert read("samples").rdd.getNumPartitions() == 1
    assert sorted((r.stream_id, r.sample_idx, r.x[0]) for r in read("samples").collect()) == sorted((k, i, float(k - 2 * k * i)) for k in range(60) for i in range(2))
    assert sorted((r.stream_id, r.offset) for r in read("clock_offsets").collect()) == [(k, k / 8) for k in range(60)]
    assert [r.name for r in read("streams").where("stream_id = 7").collect()] == ["s7"]


def test_events_meet_near_ones_only():
    rng = np.random.default_rng(7)
    for n, chunk in ((0, 4), (1, 4), (200, 16), (400, 1000)):
        s, a, x, y = np.sort(rng.integers(0, 40, n)), rng.integers(0, 6, n).astype(float), rng.integers(-9, 9, n) * 8.0, rng.integers(0, 30, n) * 9.0
        for reach in (0.0, 18.0, 45.0):
            want = kernels.keep_larger(s, a, lambda i, j: (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= reach**2, 2)  # noqa: B023
            assert kernels.keep_larger_placed(s, a, x, y, reach, 2, chunk).tolist() == want.tolist()


def test_wide_recordings_in_time():
    """120,000 events at six samples: each would meet 60,000 others without cells."""
    n = 120_000
    s, y = np.repeat(np.arange(6), n // 6), np.tile(np.arange(n // 6) * 20.0, 6)
    alive = kernels.keep_larger_placed(s, np.ones(n), np.zeros(n), y, 45.0, 2)
    assert alive[0] and not alive[1] and 0 < alive.sum() < n // 6


def test_entropies_broadcast_no_runs(spark):
    rows = spark.range(400).select((F.col("id") % 4).alias("channel"), F.floor(F.col("id") / 4).alias("sample_idx"), (F.col("id") * 37 % 101).cast("double").alias("value"))
    for f in (coupling.approximate_entropy, coupling.sample_entropy):
        df = f(rows, ["channel"], 2, 15.0)
        assert len(df.collect()) == 4
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_still_channels_have_no_frequency(spark):
    """Whatever the first frequency is, it is kept where nothing moves."""
    rows = spark.range(1200).select((F.col("id") % 200).alias("trial_id"), F.floor(F.col("id") / 200).cast("int").alias("t"), F.array(F.col("id") % 200 * 0.737 + 0.1, F.col("id") % 200 / 7.0).alias("x"))
    got = models.ssvep(rows, "trial_id", 10.0, [1.0, 2.0], 1).collect()
    assert {(r.frequency, r.correlation) for r in got} == {(1.0, 0.0)} and len(got) == 200


def test_elementary_functions_to_the_last_bit(spark):
    """A last bit decides, rarely, how a sum is rounded: SQL and Spark must have the same."""
    v, e = F.col("v"), C.ELEMENTARY
    rows = spark.range(3000).select(((F.col("id") + 1) / 7).alias("v")).select("v", e["log2"](v).alias("a"), e["exp"](-v / 50).alias("b"), e["pow"](v, F.lit(0.3)).alias("c")).collect()
    assert all((r.a, r.b, r.c) == (math.log2(r.v), math.exp(-r.v / 50), math.pow(r.v, 0.3)) for r in rows)
    odd = spark.createDataFrame([(0.0,), (-1.0,), (math.inf,), (1000.0,), (None,)], "v double").select(e["log2"](v).alias("a"), e["exp"](v).alias("b"))
    assert [str(r.a) for r in odd.collect()] == ["-inf", "nan", "inf", str(math.log2(1000.0)), "None"]
    assert [r.b for r in odd.collect()] == [1.0, math.exp(-1.0), math.inf, math.inf, None]
