"""The n-gram join against all pairs, the trees against plain intersections, components against union-find."""

import random

import numpy as np
import pytest

from sigloom.llm import ngram_join
from sigloom.llm.components import connected_components


def sets_of(rows):
    out = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        out.setdefault(key, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    return out


def brute(rows):
    sets = sets_of(rows)
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                x, y = root[a], root[b]
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return {k: (len(sets[k]), root[k]) for k in sets}


def corpus():
    random.seed(11)
    base = [[random.choice("abcdefghij") * random.randint(1, 6) for _ in range(random.randint(1, 60))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(random.choice(base)) if i % 3 else list(base[0])
        for _ in range(random.choice([0, 0, 1, 1, 2, 3, 6])):
            w[random.randrange(len(w))] = f"q{random.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    return [*rows, (600, None), (601, ""), (602, " \n "), (603, "A b"), (604, "a B"), (605, "a B"), (5, rows[5][1])]


def test_all_links_are_found(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)  # groups of many blocks
    monkeypatch.setattr(ngram_join, "HOT", 8)
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id long, text string, token string, n int").repartition(3)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_large_groups_of_unlike_sets(spark, monkeypatch):
    """Texts that share most of their words but link only here and there: many blocks, and many sets beside the main result."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "HOT", 1)
    rng = np.random.default_rng(9)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for i in range(160):
        own = int(rng.integers(5, 40))
        rows.append((i, " ".join(shared[: int(rng.integers(40, 61))] + [f"o{int(rng.integers(0, 12))}_{k}" for k in range(own)])))
    got = {r[0]: (r[1], r[2]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and 10 < len({c for _, c in want.values()}) < 150


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y"), (None, "x y"), (4, None), (5, None)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3, 4, 5]


def test_unlike_texts_of_one_key_stay(spark):
    rows = [(1, "a b c d e f g h", 7), (1, "p q r s t u v w x", 8), (2, "P q r s t u v w x", 9), (3, "a b c d e f g h", 7), (4, "", 1), (4, "", 1), (None, "a b c d e f g h", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id not in (2, 3))
    got = sorted((r[0] or 0, r[2]) for r in ngram_join.near_duplicates(docs).collect())
    assert [g for g in got if g[0]] == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)] and (0, None) in got


def test_many_parts_in_few_tasks(spark, monkeypatch):
    """Parts one after the other give what parts in tasks of their own give, and hot shingles what cold ones give."""
    monkeypatch.setattr(ngram_join, "TASK_TOKENS", 2)
    monkeypatch.setattr(ngram_join, "TASKS", 3)
    monkeypatch.setattr(ngram_join, "CHUNK_TOKENS", 100)
    rows = corpus()
    got = {r[0]: (r[1], r[2]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)


def test_frequent_shingles_of_many_slices():
    """A shingle that a share of all documents holds is reported, however thin it is spread."""
    rng = np.random.default_rng(1)
    seen = ngram_join.Frequent(0.25 / 16)
    for _ in range(300):
        own = rng.integers(100, 2**60, 200, dtype=np.uint64)
        seen.add(np.r_[own, np.uint64(7)] if rng.random() < 0.5 else own, 4)  # one in eight documents
    token, count = seen.often()
    assert 7 in token.tolist() and count[token.tolist().index(7)] >= 1200 * (1 / 16 - 0.5 / 16) and len(seen.token) < 5000


def test_long_texts(spark):
    words = [f"w{k}" for k in range(40_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:35_000])), (3, " ".join(words[:20_000])), (4, "x " * 50_000), (5, "x x x x x")]
    got = {r[0]: r[2] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_empty_table(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("sides", [False, True])
def test_tree_against_intersections(sides):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(1, 80), dtype=np.uint64))]
    while len(sets) < 120:
        s = sets[rng.integers(len(sets))]
        sets.append(np.unique(np.r_[s[rng.random(len(s)) < 0.93], rng.integers(0, 2**63, rng.integers(0, 3), dtype=np.uint64)]))
    sets = [s for s in sets if len(s)]
    size = np.array([len(s) for s in sets])
    side = rng.integers(0, 2, len(sets)) if sides else None
    got = ngram_join.tree_components(sets, size, side)
    want = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if (not sides or side[i] != side[j]) and 7 * both >= 3 * (size[i] + size[j]):
                a, b = want[i], want[j]
                want[want == max(a, b)] = min(a, b)
    # the least index of each component
    assert [int(np.flatnonzero(got == g)[0]) for g in got] == [int(np.flatnonzero(want == w)[0]) for w in want]


def test_components(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "d"), ("x", "y"), ("y", "z"), (None, "q"), ("c", "b"), ("h", "a"), ("i", "h")] + [("hub", f"n{i}") for i in range(50)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a string, b string")).collect()))
    want = {k: "a" for k in "abchi"} | {k: "x" for k in "xyz"} | {f"n{i}": "hub" for i in range(50)} | {"hub": "hub"}
    assert got == want
