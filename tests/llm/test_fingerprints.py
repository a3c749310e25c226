"""Fingerprints against plain sums over lines; the next document against a sorted list."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigloom.llm import fingerprints as fp

SF = "/root/testdata/sf0.001"


def one(text):
    return fp.packed(*fp.vectors(pa.array([text], pa.string())))[0]


@given(st.lists(st.one_of(st.none(), st.text("aB c\n\té", max_size=40)), max_size=9))
@settings(max_examples=80, deadline=None)
def test_sums_over_lines(texts):
    """Each text's fingerprint is the sum of its lines', whatever stands around it in the column."""
    equal, like = fp.vectors(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        e, v = fp.vectors(pa.array(lines))
        assert (e.sum(axis=0, dtype=np.uint64) == equal[k]).all() and (v.sum(axis=0, dtype=np.uint16) == like[k]).all()
        digest = np.frombuffer(hashlib.blake2b(lines[0].encode(), digest_size=64).digest(), "<u8")
        assert (e[0] == digest).all()
        w = lines[0].lower().encode().split()
        assert np.abs(v[0].astype(np.int16)).sum() <= max(1, len(w) - 1) * bool(w) and (v[0].astype(np.int16).sum() - max(1, len(w) - 1) * bool(w)) % 2 == 0


def test_order_does_not_count_but_everything_else_does():
    a = "one line\nand another one\n\nthe last"
    assert one(a) == one("the last\none line\n\nand another one") and one(None) == one("")
    assert len({one(t) for t in (a, a + "\n", a.replace("\n\n", "\n"), a + "\nthe last", a.upper(), a.replace(" ", "  "), "")}) == 7


def test_lines_put_in_and_taken_away(spark):
    rows = spark.createDataFrame(
        [(1, "a b c\nd e f", "g h\ni", "d e f", "old"), (2, "a b c", None, None, "old"), (3, "a", "b", "a", "old"), (4, None, "x", "", "old")],
        "id long, text string, plus string, minus string, fingerprint string",
    )
    got = {r.id: r for r in fp.changed(fp.fingerprints(rows, out="fingerprint"), "fingerprint", "plus", "minus", "after").collect()}
    assert {k: bytes(r.after) for k, r in got.items()} == {1: one("a b c\ng h\ni"), 2: one("a b c"), 3: one("b"), 4: one("x")}
    near = {r.id: r.near for r in fp.likeness(fp.changed(fp.fingerprints(rows), "fingerprint", "plus", "minus", "after"), "fingerprint", "after", "near").collect()}
    assert near[2] == 1.0 and 0 <= near[3] < 0.5 and 0.3 < near[1] < 0.7
    assert fp.fingerprints(rows.where("false")).collect() == []


def test_documents_in_many_rows(spark):
    """A third of all rows has one key; nulls are no lines."""
    random.seed(3)
    rows = [(None if k % 50 == 0 else k % 40 if k % 3 else 7, random.choice(["a b", "c d e", None, "", "f\ng"])) for k in range(5000)]
    got = {r.id: bytes(r.fingerprint) for r in fp.of_paragraphs(spark.createDataFrame(rows, "id long, text string").repartition(7), "id").collect()}
    want = {}
    for key, t in rows:
        if t is not None:
            want.setdefault(key, []).append(t)
    assert got == {k: one("\n".join(v)) for k, v in want.items()}


def brute(rows):
    """The query's columns, with counts of runs for the likeness: its estimate must not lie far off."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (k, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), one(t).hex(), one(edited).hex(), near(t, edited), near(t, after)))
    return out


def near(a, b):
    if Counter(a.split("\n")) == Counter(b.split("\n")):
        return 1.0
    x, y = (Counter(tuple(w[k : k + 2]) for line in t.lower().split("\n") for w in [line.split()] for k in range(max(1, len(w) - 1)) if w) for t in (a, b))
    both = sum(v * v for v in x.values()) + sum(v * v for v in y.values())
    return 2 * sum(v * y[k] for k, v in x.items()) / both if both else 0.0


def same(got, rows, most=0.35, mean=0.05):
    want = sorted(brute(rows), key=str)
    got = sorted((tuple(r) for r in got), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    off = np.abs(np.array([g[5:] for g in got]) - np.array([w[5:] for w in want]))
    assert not len(got) or off.max() < most and off.mean() < mean


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same(fp.op13_fingerprints(spark, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_odd_tables(spark, tmp_path, n):
    random.seed(n)
    rows = [(k * 7 % 41, random.choice(["", None, "é", "héé wörld", "a b c d e f\ng h i", "x" * 70_000 + " y\n" * 9])) for k in range(n)]
    rows += [(None, "no id")] * (n > 2)
    spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, _h int, fingerprint string").write.parquet(f"{tmp_path}/documents.parquet")
    same(fp.op13_fingerprints(spark, str(tmp_path)).collect(), rows, 0.6, 0.6)


def test_one_id_with_a_third_of_all_rows(spark, tmp_path):
    """Parts cut it; rows of one id follow each other in the order of their hashes, which is a chain through all of them."""
    rows = [(5 if k % 3 else k, f"text number {k} " * (k % 5 + 1)) for k in range(600)] + [(5, "same text")] * 4
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = fp.op13_fingerprints(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_chars, r.fingerprint) for r in got) == Counter((k, len(t), one(t).hex()) for k, t in rows)
    firsts = {one(t[: len(t) - len(t) // 2] + n[: len(t) // 2]).hex(): t for _, t in rows for _, n in rows if len(t) < 20}
    assert all(r.edited_fingerprint in firsts for r in got if r.n_chars < 20)
    assert sum(r.near_next == 1.0 for r in got) >= 3
