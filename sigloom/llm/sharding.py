"""Uniform sharding with exact shard sizes (hypergeometric communication matrix).

Input partitions send an exact, jointly drawn number of rows to each shard: the counts of all partitions are a multivariate
hypergeometric draw from the shards' sizes. Each partition permutes its rows and deals them out by its counts, rows are
exchanged, and each shard permutes again. The result is a uniform random permutation of all rows, cut into shards whose
sizes differ by one at most.

The matrix is a tree over the partitions: a node splits its counts of each shard between its halves. The draws of a node
depend on the seed and its place alone, so that a task finds the rows of its own partitions on the ways down to them, and the
matrix is never in one place. One exact law holds at every size: a draw of n rows takes each row by a binomial draw and
corrects the few that are too many or too few by a smaller draw of the same kind.

A shard's second permutation runs in cells of about ``cell_rows`` rows by random 64-bit numbers, so no task ever holds a
shard. Null texts count as empty; repeated rows are rows of their own; an empty table gives an empty result; other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sigloom.llm.common import Sent, durable, map_arrow

SHARDS = 8
#: Rows of a cell, about.
CELL_ROWS = 4096
#: Draws of no more rows take them one by one.
FEW = 24


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without return from good + bad are good; exact for any 64-bit numbers."""
    n = int(n)
    taken, sign = 0, 1
    while True:
        if n > (good + bad) // 2:  # those that stay behind are a draw too
            taken, sign, n = taken + sign * good, -sign, good + bad - n
        if n <= FEW:
            for _ in range(n):
                hit = int(rng.integers(good + bad)) < good
                good, bad = good - hit, bad - (not hit)
                taken += sign * hit
            return taken
        p = n / (good + bad)
        x, y = int(rng.binomial(good, p)), int(rng.binomial(bad, p))
        taken += sign * x
        if x + y <= n:  # a uniform choice of x + y rows; the others come from the rest
            good, bad, n = good - x, bad - y, n - x - y
        else:  # as many too many go back, drawn from the chosen
            good, bad, n, sign = x, y, x + y - n, -sign


class Matrix:
    """Counts of rows that each partition sends to each shard, by the partitions' sizes."""

    def __init__(self, counts: np.ndarray, shards: int, seed: int):
        self.ends = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        total = int(self.ends[-1])
        self.seed = seed
        self.sizes = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)

    def row(self, partition: int) -> np.ndarray:
        """The counts of one partition."""
        low, high, counts = 0, len(self.ends) - 1, self.sizes
        while high - low > 1:
            middle = (low + high) // 2
            rng = np.random.default_rng([self.seed, low, high])
            left, rest, half = int(self.ends[middle] - self.ends[low]), int(counts.sum()), np.zeros_like(counts)
            for s, c in enumerate(counts.tolist()):
                half[s] = hypergeometric(rng, c, rest - c, left)
                left, rest = left - int(half[s]), rest - c
            if partition < middle:
                high, counts = middle, half
            else:
                low, counts = middle, counts - half
        return counts


def shuffle_to_shards(df: DataFrame, shards: int = SHARDS, seed: int = 17, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` (any columns but ``shard`` and ``slot``, which are replaced) with ``shard`` int and ``slot`` long."""
    spark = df.sparkSession
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    base = durable(df.select(F.struct(*(f"`{c}`" for c in keep)).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")))
    found = sorted((r[0], r[1]) for r in base.groupBy("part").count().collect())  # one row for each input partition
    where = {p: k for k, (p, _) in enumerate(found)}
    matrix = Matrix(np.array([n for _, n in found], np.int64), shards, seed)
    sent = Sent(spark, (where, matrix))  # one number for each input partition
    cells = max(1, -(-int(matrix.ends[-1]) // (shards * cell_rows)))
    order = lambda salt: [F.xxhash64(F.lit(seed + salt), "id"), F.col("id")]
    ranked = base.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(*order(1 << 20))) - 1)

    def deal(batch: pa.RecordBatch, ends: dict[int, np.ndarray]):
        places, law = sent.value
        p, n = batch.column(1).to_numpy(), batch.column(3).to_numpy()
        shard = np.zeros(len(p), np.int32)
        for k in np.unique(p).tolist():
            if k not in ends:
                ends.clear()  # a partition's rows stand together
                ends[k] = np.cumsum(law.row(places[k]))
            own = p == k
            shard[own] = np.searchsorted(ends[k], n[own], side="right")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(shard)], names=["row", "id", "shard"])

    fields = StructType([base.schema["row"], StructField("id", LongType()), StructField("shard", IntegerType())])
    dealt = durable(map_arrow(ranked, deal, fields, setup=dict).withColumn("cell", F.pmod(F.xxhash64(F.lit(seed + (2 << 20)), "id"), F.lit(cells))))
    held = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n"))  # about cell_rows rows each
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = held.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = dealt.join(first, ["shard", "cell"])
    slot = F.row_number().over(Window.partitionBy("shard", "cell").orderBy(*order(3 << 20))) - 1 + F.col("first")
    return placed.withColumn("slot", slot).select("row.*", "shard", "slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_to_shards(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
ORACLE_SQL: dict[str, str] = {}
