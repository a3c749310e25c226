"""Merges and splits on tables against the sorter's own, recording by recording."""

import numpy as np
import pytest

from sigloom.operators import curation, sorter


def spikes(seed, recordings=3, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = []
    for r in range(recordings):
        centres = rng.normal(size=(7, 3)) * 4
        for k in range(7):
            n = int(rng.integers(1, 90)) if k else 200
            two = rng.random(n) < 0.4 if k % 3 == 1 else np.zeros(n, bool)
            x = centres[k if k % 2 else max(0, k - 1)] + rng.normal(size=(n, 3)) * spread + np.outer(two, [9.0, 0, 0])
            at = np.sort(rng.integers(0, 400 if k == 3 else 100_000, n))
            a = rng.normal(size=n) + 40 * two * (k == 1) + 10
            rows += [(r, 2 * k, int(t), v.tolist(), float(w)) for t, v, w in zip(at, x, a)]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "recording_id long, label long, sample long, x array<double>, amplitude double").repartition(5)


def arrays(rows, r):
    own = [row for row in rows if row[0] == r]
    return np.array([x[3] for x in own]), np.array([x[2] for x in own]), np.array([x[1] for x in own]), np.array([x[4] for x in own])


@pytest.mark.parametrize("refractory", [None, 15])
def test_merges(spark, refractory):
    rows = spikes(3)
    got = {(r.recording_id, r.label): r.cluster for r in curation.merged(table(spark, rows), 4.5, refractory, 0.05).collect()}
    changed = 0
    for r in range(3):
        x, at, label, _ = arrays(rows, r)
        c = sorter.SortConfig(merge_dprime=4.5, isi_limit=0.05 if refractory else 2.0, refractory=15)
        want = sorter.merged(x, at, label, c)
        assert {k: got[r, k] for k in np.unique(label).tolist()} == {k: int(want[label == k][0]) for k in np.unique(label).tolist()}
        changed += (want != label).any()
    assert changed


def test_merges_of_neighbours_only(spark):
    rows = spikes(3)
    near = spark.createDataFrame([(r, a, a + 2) for r in range(3) for a in range(0, 12, 4)], "recording_id long, a long, b long")
    got = {(r.recording_id, r.label): r.cluster for r in curation.merged(table(spark, rows), 1e9, near=near).collect()}
    assert all(got[r, a + 2] == got[r, a] == a for r in range(3) for a in range(0, 12, 4)) and all(got[r, 12] == 12 for r in range(3))


def test_statistics_add_up(spark):
    """Segments of a recording give the sums of the whole; rows without label or values are left out."""
    rows = spikes(1, 1) + [(0, None, 5, [0.0] * 3, 1.0), (0, 2, 5, None, 1.0)]
    got = {r.label: np.array(r.m) for r in curation.statistics(table(spark, rows)).collect()}
    x, _, label, _ = arrays(spikes(1, 1), 0)
    for k in np.unique(label).tolist():
        n, mean, cov = curation._moments(got[k][None])
        assert n[0] == (label == k).sum() and np.allclose(mean[0], x[label == k].mean(axis=0))
        assert np.allclose(cov[0], np.cov(x[label == k].T) if n[0] > 1 else 0)


@pytest.mark.parametrize("most", [None, 8])
def test_splits(spark, most):
    rows = spikes(5, spread=0.6)
    c = sorter.SortConfig(refractory=15, isi_split=0.1, bimodality=2.0, least_split=10, clusters=most or 1000)
    key = lambda r: (r[0], r[2], tuple(r[3]))
    got = {key(r): r.cluster for r in curation.split(table(spark, rows), 15, 0.1, 2.0, 10, most).collect()}
    cut = {key(r): r.cluster for r in curation.split_by_amplitude(table(spark, rows), 2.0, 10, most).collect()}
    changed = 0
    for r in range(3):
        own = [row for row in rows if row[0] == r]
        x, at, label, a = arrays(rows, r)
        want = sorter.split(x, at, label, c)
        assert [got[key(row)] for row in own] == want.tolist()
        changed += (want != label).any()
        want = sorter.cut_by_amplitude(a, label, c)
        assert [cut[key(row)] for row in own] == want.tolist()
        changed += (want != label).any()
    assert changed >= 4


def test_no_spikes(spark):
    none = table(spark, spikes(1, 1)).where("false")
    assert curation.merged(none, 3.0, 15).collect() == curation.split(none, 15).collect() == curation.split_by_amplitude(none).collect() == []
