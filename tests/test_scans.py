"""Recurrences in streams and blocks against one run over the whole channel."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigloom.functions import kernels
from sigloom.operators import scans, signals


def table(spark, channels, parts=5):
    rows = [(0, c, i, float(v), float(v) / 2 + c) for c, x in channels.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "recording_id long, channel int, sample_idx long, value double, target double").repartition(parts)


@pytest.fixture(scope="module")
def channels():
    """One channel has most of all samples, one has a single one, one is constant."""
    rng = np.random.default_rng(6)
    return {0: np.cumsum(rng.normal(size=3000)) * (rng.random(3000) < 0.9), 1: rng.normal(size=1), 2: np.ones(70), 3: rng.normal(size=200) ** 5}


def by_channel(df, *columns):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.channel, r.sample_idx)):
        out.setdefault(r.channel, []).append([r[c] for c in columns])
    return {c: np.array(v, float) for c, v in out.items()}


@pytest.mark.parametrize("block", [None, 7, 16, 1 << 16])
@pytest.mark.parametrize("squared", [False, True])
def test_followers(spark, channels, block, squared):
    got = by_channel(signals.envelope(table(spark, channels), 100.0, 0.02, 0.3, squared, block), "envelope")
    a, r = (1 - np.exp(-1 / (100 * t)) for t in (0.02, 0.3))
    for c, x in channels.items():
        want = kernels.envelope(x, signals.design.follower_coefficient(100.0, 0.02), signals.design.follower_coefficient(100.0, 0.3), squared)
        assert np.allclose(got[c][:, 0], want, rtol=1e-12, atol=1e-12), (a, r)


@given(st.lists(st.floats(0, 100), max_size=90), st.floats(0, 120), st.floats(0.01, 1), st.floats(0.001, 1))
@settings(max_examples=150, deadline=None)
def test_what_samples_do_to_any_level(x, level, attack, release):
    start, slope, offset = scans.follower_effect(np.array(x), attack, release)
    k = int(np.searchsorted(start, level, side="right")) - 1
    want = kernels.envelope(np.array(x), attack, release, level=level)[-1] if x else level
    assert abs(slope[k] * level + offset[k] - want) < 1e-9 * max(1, want, level)
    value = slope * start + offset
    assert start[0] == 0 and (np.diff(start) >= 0).all() and (np.diff(value) >= -1e-9).all()


def test_pieces_of_long_blocks_are_few():
    x = np.abs(np.random.default_rng(1).normal(size=20_000))
    assert scans.follower_effect(x, 0.2, 0.05).shape[1] < 400


@pytest.mark.parametrize("epsilon", [None, 0.1])
@pytest.mark.parametrize("block", [None, 2, 16, 1000])
def test_adaptive_filters(spark, channels, block, epsilon):
    small = {c: x / (1 + np.abs(x).max()) for c, x in channels.items()}
    got = by_channel(signals.adaptive(table(spark, small), "target", 5, 0.05, epsilon, block), "output", "error")
    for c, x in small.items():
        y, e, _ = kernels.lms(x, x / 2 + c, 5, 0.05, epsilon)
        assert np.allclose(got[c], np.c_[y, e], rtol=1e-9, atol=1e-9)


def plain_pools(f, gamma, penalty, most=None):
    """The definition with a list that is swept from its end."""
    pools, calcium = [], []
    for v in np.maximum(f, 0).tolist():
        if most and len(pools) >= most:
            first, second = pools[0], pools[1]
            w = gamma ** first[2] * second[1]
            pools[:2] = [((first[1] * first[0] + w * second[0]) / (first[1] + w), first[1] + w, first[2] + second[2])]
        pools.append((v, 1.0, 1))
        for i in range(len(pools) - 1, 0, -1):
            one, two = pools[i - 1], pools[i]
            if two[0] > gamma * one[0] + penalty * (1 - gamma):
                w = gamma ** one[2] * two[1]
                pools[i - 1 : i + 1] = [((one[1] * one[0] + w * two[0]) / (one[1] + w), one[1] + w, one[2] + two[2])]
        calcium.append(pools[-1][0])
    return calcium


@pytest.mark.parametrize("most", [4, 256, None])
def test_deconvolution(spark, channels, most):
    got = by_channel(signals.deconvolved(table(spark, channels), 0.9, 0.2, most=most), "calcium", "spike")
    for c, x in channels.items():
        want = np.array(plain_pools(x, 0.9, 0.2, most))
        assert np.allclose(got[c][:, 0], want) and np.allclose(got[c][:, 1], np.maximum(want - 0.9 * np.r_[0, want[:-1]], 0))


def test_percentiles_are_carried_on(spark, channels, monkeypatch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = by_channel(signals.streaming_percentile(table(spark, channels), 0.7), "value", "percentile")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for c, x in channels.items():
        assert np.array_equal(got[c], np.c_[x, kernels.p_square(x, 0.7)], equal_nan=True)


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_firmware_hits(spark, channels, block):
    got = {}
    for r in signals.firmware_hits(table(spark, {c: x * 100 for c, x in channels.items()}), 3.0, block).collect():
        got.setdefault(r.channel, []).append(r["sample"])
    for c, x in channels.items():
        assert sorted(got.get(c, [])) == kernels.firmware_detector(x * 100, 3.0).tolist()


@pytest.mark.parametrize("refractory", [0, 1, 5])
def test_hits_in_sessions(spark, channels, monkeypatch, refractory):
    """Sessions change nothing: peaks and first hits are those of whole channels and recordings."""
    monkeypatch.setattr(signals, "SESSIONS", 3)
    rows = table(spark, channels)
    limits = spark.createDataFrame([(0, c, 1.5) for c in channels], "recording_id long, channel int, threshold double")
    got = {}
    for r in signals.spikes(rows, limits, refractory).collect():
        got.setdefault(r.channel, []).append(r["sample"])
    for c, x in channels.items():
        assert sorted(got.get(c, [])) == sorted(kernels.negative_peaks(x, 1.5, refractory).tolist())
    frames = np.random.default_rng(3).normal(size=(400, 3))
    wide = spark.createDataFrame([(0, 2 * i, v.tolist()) for i, v in enumerate(frames)], "recording_id long, sample_idx long, x array<double>")
    found = sorted((r["sample"], r.channel, r.amplitude) for r in signals.first_channel_hits(wide, 1.4, refractory).collect())
    assert found == [(2 * t, c, v) for t, c, v in kernels.first_hits(frames, 1.4, refractory)]


def test_streams_of_no_rows(spark):
    empty = table(spark, {0: np.ones(1)}).where("false")
    for df in (signals.envelope(empty, 100.0, 0.1, 0.1), signals.envelope(empty, 100.0, 0.1, 0.1, block=4), signals.deconvolved(empty, 0.9, 0.1), signals.firmware_hits(empty, 3.0)):
        assert df.collect() == []
