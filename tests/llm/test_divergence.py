"""The source audit against DuckDB and against plain counting with exact fractions."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from sigloom.llm import divergence


def sql_rows(folder, columns):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}'")
    cur = db.execute(divergence.ORACLE_SQL["op11_divergence"])
    assert sorted(columns) == sorted(c[0] for c in cur.description)
    at = [[c[0] for c in cur.description].index(c) for c in columns]
    return sorted(tuple(r[k] for k in at) for r in cur.fetchall())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, sf):
    got = divergence.op11_divergence(spark, f"/root/testdata/{sf}")
    want = sql_rows(f"/root/testdata/{sf}/documents.parquet", got.columns)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 1000


def brute(rows, least, top):
    count, held, docs = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        docs.add((lang, source))
        count[lang, source].update(found)
        held[lang].update(set(found))
    out = []
    for lang in {g[0] for g in docs}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = sorted(s for x, s in docs if x == lang)
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 5) // (n[s] + 5 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked)]
    return sorted(out)


def corpus(seed, n, sources):
    """A third of all rows has one source; languages without kept terms, nulls, ties, letters beyond ASCII."""
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "Éa", "ña-na", "x1y", "日本", "KELVINK", "rare%d", "w%d"]
    rows = []
    for k in range(n):
        text = " ".join(w % rng.randrange(30) if "%" in w else w for w in rng.choices(words, k=rng.randrange(0, 25)))
        rows.append((rng.choice([text, text, text, None, "", "1 2 3"]), rng.choice(["en", "en", "fr", None]), f"s{rng.randrange(sources)}" if k % 3 else "s0"))
    return [*rows, ("only once", "xx", None), (None, "yy", "a"), (None, "yy", "b"), *rows[:5] * 2]


@pytest.mark.parametrize(("sources", "block"), [(6, 256), (23, 4)])
def test_plain_counting(spark, monkeypatch, sources, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD_TERMS", 40)
    rows = corpus(sources, 500, sources)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(5)
    audit = divergence.Audit(docs, least=8)
    for top in (3, 50):
        want = [r for r in brute(rows, 8, top)]
        got = [("pair", audit.pairs()), ("term", audit.terms(top))]
        assert sorted((r.lang, r.source, part, r["item"], r.value, r["rank"]) for part, df in got for r in df.collect()) == want
    audit.discard()


def test_few_best_buckets_are_read(spark):
    """A group stops at a bound below its last: most buckets are never evaluated, and those that tie are."""
    rows = [(f"w{chr(97 + k % 26)} " * 2 ** (k % 13) + "odd " * (s == "a") * 3, "en", s) for s in "ab" for k in range(260)]
    audit = divergence.Audit(spark.createDataFrame(rows, "text string, lang string, source string"), least=5)
    buckets = audit.buckets().where("source = 'a'").orderBy("at").collect()
    assert [b.bound for b in buckets] == sorted((b.bound for b in buckets), reverse=True)
    best = audit.terms(1).where("source = 'a'").collect()
    assert [r["item"] for r in best] == ["odd"] and sum(b.bound >= best[0].value for b in buckets) < len(buckets) / 2


def test_empty_and_odd_tables(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string"
    for name, rows in (("none", []), ("one", [(1, None, None, None)]), ("long", [(k, "ab " * 50_000 + "x" * 100_000, "en", None) for k in range(31)])):
        folder = tmp_path / name
        spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/documents.parquet")
        got = divergence.op11_divergence(spark, str(folder))
        assert sorted(map(tuple, got.collect())) == (sql_rows(f"{folder}/documents.parquet/*.parquet", got.columns) if rows else [])


def test_runs_over_batches():
    """Cells, parts and terms that are cut anywhere give the same sums."""
    rng = random.Random(5)
    rows = []
    for cell in (("de", 0, 0), ("en", 0, 0), ("en", 0, 1)):
        for part in range(2):
            spots = [0, 3, 7] if cell[1] == cell[2] else [1, 4, divergence.BLOCK + 2]
            rows += [(*cell, part, None, s, 100 + s) for s in spots]
            rows += [(*cell, part, f"t{k:02}", s, rng.randrange(50, 400)) for k in range(9) for s in rng.sample(spots, rng.randint(1, 3))]
    names = ["lang", "low", "high", "part", "term", "spot", "p"]
    kinds = [pa.string(), *[pa.int32()] * 3, pa.string(), pa.int32(), pa.int64()]
    whole = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names=names)
    found = []
    for size in (1, 2, 5, 1000):
        total = Counter()
        for b in divergence._cells(whole.slice(s, size) for s in range(0, len(rows), size)):
            for r in b.to_pylist():
                total[tuple(r.values())[:5]] += r["more"]
        found.append(total)
    want = Counter()
    for lang, low, high in (("de", 0, 0), ("en", 0, 0), ("en", 0, 1)):
        own = [r for r in rows if r[:3] == (lang, low, high)]
        spots = sorted({r[5] for r in own})
        for part in range(2):
            for t in {r[4] for r in own if r[3] == part and r[4]}:
                held = {r[5]: r[6] for r in own if r[3] == part and r[4] == t}
                for a in spots:
                    for b in spots:
                        if a < b and (low == high or a < divergence.BLOCK <= b):
                            want[lang, low, high, a, b] += abs(held.get(a, 100 + a) - held.get(b, 100 + b)) - abs(a - b)
    assert all({k: v for k, v in f.items() if v} == {k: v for k, v in want.items() if v} for f in found)
