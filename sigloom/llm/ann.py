"""Approximate nearest neighbours by inner product: a forest of random-projection trees and one priority queue.

Trees are drawn from a bounded sample; every split is the median of the sample along the difference of two of its
vectors. For the inner product, vectors get one more coordinate that brings all to one norm, and queries a zero; queries are
brought to that norm too, as their length bears on no rank but would on how near the planes are. That norm is the one that
``LONG`` of all vectors keep to; the few longer ones stand in no leaf and are ranked for every query, so that they pull no
planes. A query goes through all trees with one queue of open branches, least first by the sum of squared distances to the
planes that it is on the wrong side of, until it has visited its share of all leaves and these hold as many distinct vectors
as a result can need, or all. The vectors of visited leaves are ranked exactly, in double precision.

Leaves are small, so that few vectors are ranked in vain; they travel by the subtrees below ``BRANCH`` levels, and a query
goes once to each subtree in which it visits leaves, whatever their number.

Every row is indexed. Equal vectors are indexed once with their least ids, as many as a result can hold, so neither
copies nor leaves grow without bound: where subtrees would hold more than ``GROUP_ROWS``, they are cut into blocks that are
searched apart.

Vectors that are null, zero, of another length than most, or hold a null or a non-finite component take no part.
Repeated ids count as rows of their own in the index; as queries they are asked once. Empty tables give empty results.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.common import durable, map_arrow, Sent

#: Trees; rows of the sample (the bound of what is fitted).
TREES, SAMPLE = 2, 8192
#: The share of all leaves that a query visits: ``VISITED``, more by ``WIDER`` times the root of the share of all vectors that
#: it asks for, up to ``MOST`` (from 1 / TREES on, as many products are taken as an exact search takes).
VISITED, WIDER, MOST = 0.3, 3.4, 0.55
#: Vectors of a leaf, about; the most levels of a tree, levels above the subtrees that travel as one, vectors of a block.
LEAF_ROWS, DEPTH, BRANCH, GROUP_ROWS = 4, 10, 5, 20_000
#: Vectors longer than this share of all are ranked for every query.
LONG = 0.99


class Forest:
    def __init__(self, sample: np.ndarray, norm: float, depth: int, trees: int = TREES, seed: int = 5):
        self.norm, self.depth = norm, depth
        rng = np.random.default_rng(seed)
        lifted = self.lift(sample)
        d = lifted.shape[1]
        #: Complete binary trees: node k has the children 2k+1 and 2k+2.
        self.planes = np.zeros((trees, (1 << depth) - 1, d))
        self.cuts = np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            own = {0: np.arange(len(lifted))}
            for k in range((1 << depth) - 1):
                i = own.pop(k)
                v = lifted[rng.choice(i)] - lifted[rng.choice(i)] if len(i) else np.zeros(d)
                if not np.abs(v).sum():
                    v = rng.standard_normal(d)
                v /= np.linalg.norm(v)
                at = lifted[i] @ v
                self.planes[t, k], self.cuts[t, k] = v, np.median(at) if len(i) else 0.0
                own[2 * k + 1], own[2 * k + 2] = i[at <= self.cuts[t, k]], i[at > self.cuts[t, k]]

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Each vector's leaf in each tree, numbered through all trees."""
        x = self.lift(x)
        out = np.zeros((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((x * self.planes[t, node]).sum(axis=1) > self.cuts[t, node])
            out[:, t] = node - len(self.cuts[t]) + (t << self.depth)
        return out

    def search(self, query: np.ndarray, visits: int, sizes: np.ndarray, least: int) -> list[int]:
        """The leaves that the query visits, through one queue for all trees: ``visits``, and on until some tree's visited leaves hold ``least`` vectors."""
        query = query / np.abs(query).max()
        margins = self.planes[:, :, :-1] @ (query * (self.norm / np.linalg.norm(query))) - self.cuts
        inner = self.cuts.shape[1]
        queue = [(0.0, t, 0) for t in range(len(self.planes))]
        out: list[int] = []
        held = np.zeros(len(self.planes), np.int64)  # a tree holds each vector once, so that no leaves of it share one
        while queue and (len(out) < visits or held.max() < least):
            far, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t, node]
                near, other = (2 * node + 1, 2 * node + 2) if m <= 0 else (2 * node + 2, 2 * node + 1)
                heapq.heappush(queue, (far + m * m, t, other))
                node = near
            out.append(node - inner + (t << self.depth))
            held[t] += sizes[out[-1]]
        return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest(rows: DataFrame, queries, k: int = 20, key: str = "vec_id", vector: str = "embedding", visited: float | None = None) -> DataFrame:
    """(query_id, rank, key, score): the ``k`` nearest rows that were found for each row where ``queries`` holds; ``visited``: a share of all leaves of its own."""
    spark = rows.sparkSession
    v = F.col(vector)
    valid = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    taken = F.coalesce(valid, F.lit(False)) & F.col(key).isNotNull()
    clean = rows.where(taken).select(F.col(key).alias("id"), F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sizes = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = sizes["d"] if sizes else 1
    ranked = clean.where(F.size("v") == d).withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id")))
    index = durable(ranked.where(F.col("_n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("vid", F.col("ids")[0]))
    asked = durable(clean.where(F.col("asks") & (F.size("v") == d)).select("id", "v").join(index.select("v", "vid"), "v").select("id", "vid").distinct())
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, limit = index.agg(F.count("*"), F.percentile_approx(length, LONG, 10_000)).first()
    limit = float(limit or 1.0) * (1 + 1e-6)
    short = index.where(length <= limit)
    n = short.count()
    sample = short.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).select("v").toPandas()["v"]
    depth = int(min(DEPTH, max(1, round(np.log2(max(2, n) / LEAF_ROWS)))))
    forest = Forest(np.array(sample.tolist(), np.float64).reshape(-1, d), limit**0.5, depth)
    visited = min(MOST, VISITED + WIDER * (k / max(k, n)) ** 0.5) if visited is None else visited
    visits = max(1, int(np.ceil(visited * TREES * (1 << depth))))
    low = max(0, depth - BRANCH)  # a leaf's number without so many bits is that of its subtree
    blocks = max(1, -(-int(n) // (GROUP_ROWS << (depth - low))))
    apart = -(-(total - n) // GROUP_ROWS)  # blocks of the long vectors, which are a subtree of one leaf
    sent = Sent(spark, forest)  # at most TREES * 2^DEPTH planes

    def place(batch: pa.RecordBatch):
        leaves = sent.value.leaves(_matrix(batch.column(0)))
        m, t = leaves.shape
        at = pa.array(np.repeat(np.arange(m), t))
        vid = batch.column(1).to_numpy()
        leaf = leaves.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(leaf >> low), pa.array(np.repeat(vid % blocks, t)), pa.array(leaf & ((1 << low) - 1)), batch.column(1).take(at), batch.column(0).take(at)], names=["tree", "block", "leaf", "vid", "v"])

    least = min(n, k + 1)

    def fill(batch: pa.RecordBatch):
        leaf, count = np.unique(sent.value.leaves(_matrix(batch.column(0))), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(count)], names=["leaf", "n"])

    def visit(batch: pa.RecordBatch):
        for one in range(0, batch.num_rows, 256):
            part = batch.slice(one, 256)
            x = _matrix(part.column(0))
            groups: list[tuple[int, int, list[int]]] = []
            for i, q in enumerate(x):
                found = np.sort(np.array(sent.value.search(q, visits, counts.value, least), np.int64))
                cut = np.flatnonzero(np.diff(found >> low, prepend=-1))
                groups += [(i, int(g[0]) >> low, (g & ((1 << low) - 1)).tolist()) for g in np.split(found, cut[1:])]
            at = pa.array(np.repeat([g[0] for g in groups], blocks))
            tree = np.repeat(np.array([g[1] for g in groups], np.int64), blocks)
            leaves = pa.array([g[2] for g in groups for _ in range(blocks)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(np.tile(np.arange(blocks), len(groups))), leaves, part.column(1).take(at), part.column(0).take(at)], names=["tree", "block", "leaves", "vid", "v"])

    vid = F.col("vid").cast("long")
    placed = map_arrow(short.select("v", vid.alias("vid")).repartition(F.col("vid")), place, "tree long, block long, leaf long, vid long, v array<double>")
    sizes = np.zeros(TREES << depth, np.int64)
    for leaf, count in map_arrow(short.select("v"), fill, "leaf long, n long").groupBy("leaf").agg(F.sum("n")).collect():  # at most TREES * 2^DEPTH rows
        sizes[leaf] = count
    counts = Sent(spark, sizes)
    asking = asked.select("vid").distinct().join(index, "vid").select("v", vid.alias("vid"))
    visiting = map_arrow(asking, visit, "tree long, block long, leaves array<long>, vid long, v array<double>")
    if total > n:
        outside, first = F.lit(-1).cast("long").alias("tree"), F.lit(0).cast("long")
        placed = placed.unionAll(index.where(length > limit).select(outside, F.pmod(vid, F.lit(apart)).alias("block"), first.alias("leaf"), vid.alias("vid"), "v"))
        visiting = visiting.unionAll(asking.select(outside, F.explode(F.sequence(first, F.lit(apart - 1).cast("long"))).alias("block"), F.array(first).alias("leaves"), "vid", "v"))

    def rank(own: pa.Table, asking: pa.Table) -> pa.Table:
        if not own.num_rows or not asking.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("query", pa.int64()), ("vid", pa.int64()), ("score", pa.float64()))})
        x, q = _matrix(own["v"]), _matrix(asking["v"])
        ids, who = own["vid"].to_numpy(), asking["vid"].to_numpy()
        leaf = own["leaf"].to_numpy()
        rows = [np.flatnonzero(leaf == f) for f in range(1 << low)]
        lists = asking["leaves"].combine_chunks()
        goes = np.zeros((len(q), 1 << low), bool)
        goes[np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
        most = min(len(x), k + 13)  # a margin for how the product rounds; the exact sums below decide
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a in range(0, len(q), 256):
            rough = np.full((len(q[a : a + 256]), len(x)), -np.inf)
            for f in np.flatnonzero(goes[a : a + 256].any(axis=0)).tolist():
                asks = np.flatnonzero(goes[a : a + 256, f])
                rough[np.ix_(asks, rows[f])] = q[a + asks] @ x[rows[f]].T
            near = np.argpartition(-rough, most - 1, axis=1)[:, :most]
            seen = np.take_along_axis(rough, near, axis=1) > -np.inf
            score = (q[a : a + 256][:, None, :] * x[near]).sum(axis=2)
            for i in range(len(near)):
                best = np.lexsort((ids[near[i]], -score[i]))
                best = best[seen[i][best]][: k + 1]
                out.append((np.full(len(best), who[a + i]), ids[near[i]][best], score[i][best]))
        return pa.table({c: pa.array(np.concatenate(x)) for c, x in zip(("query", "vid", "score"), zip(*out))})

    found = placed.groupBy("tree", "block").cogroup(visiting.groupBy("tree", "block")).applyInArrow(rank, "query long, vid long, score double")
    best = found.groupBy("query", "vid").agg(F.max("score").alias("score"))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "vid")
    best = best.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k + 1).drop("_n")
    listed = best.join(index.select("vid", "ids"), "vid").select("query", "score", F.explode("ids").alias("hit"))
    listed = listed.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "hit"))).where(F.col("_n") <= k + 1)
    pairs = asked.join(listed.withColumnRenamed("query", "vid"), "vid").where("hit != id")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "hit")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", F.col("hit").alias(key), "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


QUERIES = {"op8_ann": op8_ann}
ORACLE_SQL: dict[str, str] = {}
