"""Centroid clustering against DuckDB and against plain rounds in Python's integers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigloom.llm import clusters


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    duckdb.sql(f"create or replace view embeddings as select * from '{folder}/embeddings.parquet'")
    got = clusters.op12_clusters(spark, folder)
    want = duckdb.sql(clusters.ORACLE_SQL["op12_clusters"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def brute(rows, k=40, rounds=5):
    ok = [(key, [math.floor(256 * x) for x in v]) for key, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(ok, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w)), n) for n, w in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in ok]
        for n in set(own):
            mine = [v for (_, v), o in zip(ok, own) if o == n]
            c[n] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [(key, *nearest(v)) for key, v in ok]
    total = {n: sum(d for _, d, m in last if m == n) for n in range(len(c))}
    return [(key, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for key, d, n in last]


def table(spark, rows):
    return spark.createDataFrame([(k, v, 1, "old") for k, v in rows], "vec_id long, embedding array<double>, distance int, v string")


def check(spark, rows, **how):
    df = table(spark, rows).repartition(3)
    got = clusters.assign(df, clusters.fit(df, **how)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    long = lambda x: x if x < 2**63 else None
    want = [(k, c, long(d), long(i), long(t), h) for k, c, d, i, t, h in brute(rows, how.get("k", 40), how.get("rounds", 5))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n", [0, 1, 39, 150])
def test_plain_rounds(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(k) if k % 9 else None, rng.normal(size=64).round(1).tolist()) for k in range(n)]
    bad = [(900, None), (901, [0.0] * 63), (902, [None] + [0.0] * 63), (903, [math.nan] + [0.0] * 63), (904, [math.inf] + [0.0] * 63), (905, [])]
    check(spark, rows + rows[: n // 3] * 3 + bad, k=7)


def test_large_components_and_ties(spark):
    random.seed(4)
    few = [[float(random.choice([-1, 0, 1])) for _ in range(64)] for _ in range(3)]
    rows = [(k, list(random.choice(few))) for k in range(40)]
    rows += [(100 + k, [random.choice([1e5, 4e6, -8e9])] + [0.0] * 63) for k in range(10)]
    check(spark, rows, k=6)


@given(st.integers(1, 30), st.integers(1, 12), st.integers(1, 9), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_nearest_is_exact(n, k, most, seed):
    """With few values there are many ties; the first of the nearest is taken."""
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-most, most, (n, 64)), rng.integers(-most, most, (k, 64))
    number, distance = clusters.Centroids(c, rng.permutation(64)).nearest(x)
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (distance == full.min(axis=1)).all() and (number == full.argmin(axis=1)).all()
