"""Centroid clustering of integer vectors by partial-distance search.

Each vector is compared with all centroids on a few dimensions first, those of the highest variance. The centroid that is
nearest so far is measured in full, which gives each vector its current best; every other centroid is abandoned as soon as
the integer differences summed so far are strictly above it, and the survivors finish all dimensions. So the nearest centroid
is exact, and of equally near ones the one with the smallest number.

A round reads the vectors once, where they lie: nothing is exchanged but one row of exact sums for each task and centroid.
The state between rounds is the centroids, so a lost executor costs the tasks that it ran. All arithmetic is on integers:
sums leave a task as decimals, and components beyond 2^27 are squared as Python's numbers.

Vectors that are null, of another length, or hold a null or non-finite component take no part; nor do those with a component
beyond 2^52 once scaled, which a double does not count exactly. Repeated rows are vectors of their own. With fewer vectors
than centroids each is one; an empty table gives an empty result. A null id hashes as an empty one. A distance or inertia
beyond a long is null. Other columns stay as they are, but for those of the result's names, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import Sent, map_arrow, small_batches, with_fields

WIDTH, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, "2:"
#: Dimensions that are added at once before centroids are abandoned.
STEP = 8
_LONG = 2**63 - 1


class Centroids:
    """Integer vectors by number, the order in which dimensions are compared, and what was summed over their vectors."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray):
        self.vectors, self.order = vectors, order
        self.inertias: list[int] = [0] * len(vectors)

    @property
    def hashes(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in self.vectors.tolist()]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the nearest centroids of vectors, and their squared distances."""
        x, c = x[:, self.order], self.vectors[:, self.order]
        if max((int(np.abs(a).max()) for a in (x, c) if a.size), default=0) > 1 << 27:
            x, c = x.astype(object), c.astype(object)
        n = len(x)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        part = ((x[:, None, :STEP] - c[None, :, :STEP]) ** 2).sum(axis=2)
        guess = part.argmin(axis=1)
        best = ((x - c[guess]) ** 2).sum(axis=1)
        row, k = np.nonzero(part <= best[:, None])
        part = part[row, k]
        for s in range(STEP, x.shape[1], STEP):
            part = part + ((x[row, s : s + STEP] - c[k, s : s + STEP]) ** 2).sum(axis=1)
            alive = part <= best[row]
            row, k, part = row[alive], k[alive], part[alive]
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(part, heads)
        at = np.flatnonzero(part == np.repeat(least, np.diff(np.r_[heads, len(row)])))
        at = at[np.r_[True, row[at][1:] != row[at][:-1]]]  # of equal ones the first
        return k[at], least


def kept(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The rows whose vectors take part."""
    return df.where((F.size(embedding) == WIDTH) & F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= float(2**52 // SCALE))))


def scaled(column: pa.Array) -> np.ndarray:
    """A column of kept vectors as integers."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, WIDTH)
    return np.floor(x * SCALE).astype(np.int64)


def _sums(vectors: DataFrame, parts, width: int) -> dict[int, list[int]]:
    """What ``parts(x)`` gives for the vectors of a batch, (number, row of ``width`` integers) each, summed over all of them by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            for k, row in parts(scaled(batch.column(0))):
                total[k] = [a + b for a, b in zip(total[k], row)] if k in total else row
        if total:
            sums = [[Decimal(v) for v in row] for row in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(sums, pa.list_(pa.decimal128(38, 0)))], names=["k", "s"])

    small_batches(vectors.sparkSession)
    rows = vectors.mapInArrow(run, "k int, s array<decimal(38,0)>")
    found = rows.groupBy("k").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width))).collect()  # one row for each centroid
    return {r[0]: [int(v) for v in r[1:]] for r in found}


def _by_centroid(sent: Sent):
    def parts(x: np.ndarray):
        """Vectors, their distances and their components, summed by nearest centroid."""
        k, distance = sent.value.nearest(x)
        for c in np.unique(k).tolist():
            own = k == c
            rows = x[own].astype(object) if np.abs(x[own]).max() > 1 << 40 else x[own]
            yield c, [int(own.sum()), sum(distance[own].tolist()), *rows.sum(axis=0).tolist()]

    return parts


def _spread(x: np.ndarray):
    """Numbers, components and their squares, all under one number."""
    if len(x):
        y = x.astype(object)
        yield 0, [len(x), *y.sum(axis=0).tolist(), *(min(v, 10**33) for v in (y * y).sum(axis=0).tolist())]


def fit(df: DataFrame, embedding: str = "embedding", key: str = "vec_id", k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> Centroids | None:
    """The centroids after ``rounds``, from the ``k`` vectors whose ids hash lowest behind ``seed``; nothing without vectors."""
    rows = kept(df, embedding)
    doubles = F.col(embedding).cast("array<double>")
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    start = rows.select(hashed.alias("h"), doubles.alias("v")).orderBy("h", "v").limit(k).collect()  # k rows
    if not start:
        return None
    vectors = rows.select(doubles.alias("v"))
    n, *sums = _sums(vectors, _spread, 1 + 2 * WIDTH)[0]
    mean, square = np.array(sums[:WIDTH], float) / n, np.array(sums[WIDTH:], float) / n
    now = Centroids(np.floor(np.array([r["v"] for r in start]) * SCALE).astype(np.int64), np.argsort(mean**2 - square, kind="stable"))
    for step in range(rounds + 1):
        found = _sums(vectors, _by_centroid(Sent(df.sparkSession, now)), 2 + WIDTH)
        if step == rounds:
            now.inertias = [found[c][1] if c in found else 0 for c in range(len(now.vectors))]
            break
        moved = [[s // found[c][0] for s in found[c][2:]] if c in found else row for c, row in enumerate(now.vectors.tolist())]
        now = Centroids(np.array(moved, np.int64), now.order)
    return now


def assign(df: DataFrame, centroids: Centroids | None, embedding: str = "embedding") -> DataFrame:
    """The rows of ``df`` that take part with ``cluster`` int and ``distance``, ``cluster_inertia``, ``inertia`` long and ``centroid_sha256`` string."""
    more = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    names = [c.split()[0] for c in more.split(", ")]
    keep = [f for f in df.schema if f.name not in names]
    sent = Sent(df.sparkSession, (centroids, centroids.hashes if centroids else []))

    def long(values: list) -> pa.Array:
        return pa.array([v if v <= _LONG else None for v in values], pa.int64())

    def kernel(batch: pa.RecordBatch):
        own, hashes = sent.value
        k, distance = own.nearest(scaled(batch.column(batch.num_columns - 1)))
        k = k.tolist()
        total = sum(own.inertias)
        columns = [pa.array(k, pa.int32()), long(distance.tolist()), long([own.inertias[c] for c in k]), long([total] * len(k)), pa.array([hashes[c] for c in k], pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names])

    rows = kept(df, embedding) if centroids else df.where("false")
    return map_arrow(rows.select(*(f"`{f.name}`" for f in keep), F.col(embedding).cast("array<double>").alias("_vector")), kernel, with_fields(keep, more))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return assign(rows, fit(rows)).drop("embedding")


def _sql() -> str:
    nearest = (
        "a{r} AS MATERIALIZED (SELECT uid, k, d FROM (SELECT uid, k, d, row_number() OVER (PARTITION BY uid ORDER BY d, k) AS n FROM "
        "(SELECT uid, k, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{r} c USING (i) GROUP BY uid, k)) WHERE n = 1)"
    )
    moved = (
        "c{s} AS MATERIALIZED (SELECT k, i, CAST((t - ((t % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT k, i, sum(x) AS t, count(*) AS n FROM a{r} JOIN x USING (uid) GROUP BY k, i) "
        "UNION ALL SELECT k, i, x FROM c{r} WHERE k NOT IN (SELECT k FROM a{r}))"
    )
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, v FROM (SELECT vec_id, [CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0))",
        "x AS MATERIALIZED (SELECT uid, unnest(v) AS x, unnest(range(64)) AS i FROM kept)",
        "c0 AS MATERIALIZED (SELECT k, unnest(v) AS x, unnest(range(64)) AS i FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k, v FROM kept) WHERE k < 40)",
    ]
    for r in range(ROUNDS):
        parts += [nearest.format(r=r), moved.format(r=r, s=r + 1)]
    parts.append(nearest.format(r=ROUNDS))
    return (
        "WITH " + ", ".join(parts) + f", h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY k) "
        "SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{ROUNDS} JOIN kept USING (uid) JOIN h USING (k)"
    )


QUERIES = {"op12_clusters": op12_clusters}
ORACLE_SQL = {"op12_clusters": _sql()}
