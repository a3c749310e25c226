"""The pipeline's stages against brute force on a small corpus, and nearest neighbours against all pairs."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from sigloom.llm import ann, bpe, secrets
from tests.llm.test_near_duplicates import brute

EN = "the quick brown fox jumps over the lazy dog while a small bird sings in the old tree near our house".split()


def text(seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join(EN[k] for k in rng.integers(0, len(EN), n))


ITEM = text(999, 30)
DOCS = [
    (1, text(1), "en", "a", 5),
    (2, text(1), "en", "b", 5),  # an exact copy
    (3, text(1).rsplit(" ", 1)[0] + " end", "en", "a", 5),  # a near copy
    (4, text(4) + " " + ITEM + " " + text(5), "en", "a", 5),  # holds a benchmark item
    (5, text(6) + ' password = "q9X7rT27zzP" ' + text(7), "en", "a", 5),
    (6, None, "en", "a", None),
    (7, "12 34 !!", None, "a", 8),
    (8, "", "en", None, 0),
    (9, text(9), None, "a", 5),
    (10, text(10, 3000), "en", "a", 5),
    (9, text(9), None, "a", 5),  # a repeated row
]


@pytest.fixture
def corpus(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        seen[name] = {r.doc_id: r for r in rows}
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen["language_id"]) == {1, 2, 3, 4, 5, 9, 10}
    kept = {k for k, (_, c) in brute([(k, t) for k, t, *_ in DOCS if k in seen["language_id"]]).items() if k == c}
    assert set(seen["ngram_jaccard_join"]) == kept == {1, 4, 5, 9, 10}
    assert set(seen["benchmark_decontamination"]) == {1, 5, 9, 10}
    assert "q9X7rT27zzP" not in seen["secret_scan"][5].text and seen["secret_scan"][1].text == text(1)
    assert seen["secret_scan"][5].n_chars == len(seen["secret_scan"][5].text) and not secrets.find(seen["secret_scan"][5].text)
    path, pattern = bpe.public_vocabulary()
    coder = bpe.Coder(bpe.read_ranks(path), pattern)
    for k, r in seen["byte_bpe"].items():
        ids = coder.encode([seen["secret_scan"][k].text])[0]
        assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4 and r.ids_sha256 == hashlib.sha256(ids).hexdigest()
    whole = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, corpus).collect()}
    assert whole == {(r.doc_id, r.ids_sha256) for r in seen["byte_bpe"].values()}


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Columns of any name pass untouched up to the last stage; empty tables pass through all."""
    names = ["row", "cls", "lang_pred", "score", "bits", "spans", "n_tokens", "similarity", "part", "id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    rows = [(k, text(k), "en", "a", 5, *range(k, k + len(names))) for k in range(1, 6)] + [(6, None, None, None, None, *[None] * len(names))]
    for part, table in (("odd", rows), ("empty", [])):
        folder = f"{tmp_path}/{part}"
        docs = spark.createDataFrame(table, schema)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, ITEM)] if table else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
            got = docs.collect()
            docs = spark.createDataFrame(got, docs.schema)
            assert len(got) == (5 if table else 0), name
            if name != "byte_bpe":
                assert docs.columns[5:] == names and all(tuple(r)[5:] == tuple(range(r.doc_id, r.doc_id + len(names))) for r in got), name
        assert corpus_pipeline.run(spark, folder).count() == (5 if table else 0)


def test_rows_of_one_key_and_unlike_texts_stay(spark):
    from sigloom.llm import ngram_join

    rows = [(1, text(1), "en", "a", 5), (1, text(2), "en", "a", 5), (2, text(2) + " x", "en", "a", 5)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert sorted(r.text for r in kept) == sorted([text(1), text(2)])


def test_vectors_of_other_lengths(spark):
    """The commonest length takes part, the smaller of equals."""
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.1]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 1.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(0, 1), (1, 0)]


def test_equal_scores_go_to_the_smaller_id(spark):
    from pyspark.sql import functions as F

    rows = [(i, [1.0, float(i % 2), float(i // 2 % 2)]) for i in range(2000)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 4, k=10).collect()
    for q in range(4):
        own = [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        want = sorted((-float(np.dot(rows[q][1], v)), i) for i, v in rows if i != q)[:10]
        assert own == want


def exact(rows, queries, k):
    out = {}
    for q, v in queries:
        found = sorted(((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q))[:k]
        out[q] = [i for _, i in found]
    return out


def test_neighbours_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    good = [(i, [float(np.float32(x)) for x in rng.standard_normal(4)]) for i in range(60)] + [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(60, 100)]
    bad = [(200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [float("nan"), 1.0, 1.0, 1.0]), (280, [float("inf"), 0.0, 0.0, 0.0]), (300, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 7) for i, v in good + bad], "vec_id long, embedding array<float>, rank int")
    from pyspark.sql import functions as F

    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=5, visited=1.0).orderBy("query_id", "rank").collect()
    want = exact(good, [(i, v) for i, v in good if i % 20 == 0], 5)
    assert {q: [r.vec_id for r in got if r.query_id == q] for q in want} == want
    assert {r.query_id for r in got} == set(want) and [r["rank"] for r in got] == [1, 2, 3, 4, 5] * len(want)
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).collect() == []
    few = ann.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0, k=5).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_neighbours_in_small_tables(spark):
    """All candidates where these are few; leaves are visited on until they hold enough."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    for n, copies in ((1, 1), (2, 1), (10, 1), (20, 1), (21, 1), (30, 1), (3, 5)):
        base = rng.standard_normal((n, 8)) if n > 2 else np.r_[np.ones((1, 8)), -np.ones((n - 1, 8))]
        rows = [(k, [float(x) for x in base[k % n]]) for k in range(n * copies)]
        got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).collect()
        found = {q: [r["rank"] for r in got if r.query_id == q] for q, _ in rows}
        assert {q: sorted(r) for q, r in found.items()} == {q: list(range(1, min(20, len(rows) - 1) + 1)) for q, _ in rows}, n
        if len(rows) <= 21:
            assert all({r.vec_id for r in got if r.query_id == q} == {k for k, _ in rows if k != q} for q, _ in rows)


def test_recall(spark):
    found = ann.op8_ann(spark, "/root/testdata/sf0.01").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    x, ids = np.array(table.embedding.tolist(), float), table.vec_id.to_numpy()
    at = {v: k for k, v in enumerate(ids)}
    recall = []
    for q, g in found.groupby("query_id"):
        s = x @ x[at[q]]
        s[at[q]] = -np.inf
        recall.append(len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g.vec_id)) / 20)
    assert len(recall) == (ids % 20 == 0).sum() and np.mean(recall) >= 0.9


def test_recall_with_uneven_norms(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    unit = rng.standard_normal((10_000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    uneven = unit * rng.uniform(0.5, 1.5, (10_000, 1))
    uneven[17] *= 100
    short = unit.copy()
    short[::100] /= 100
    for x in (uneven, short):
        got = ann.nearest(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).toPandas()
        recall = []
        for q, g in got.groupby("query_id"):
            s = x @ x[q]
            s[q] = -np.inf
            recall.append(len(set(np.argsort(-s)[:20]) & set(g.vec_id)) / 20)
        assert len(recall) == 100 and np.mean(recall) >= 0.95
