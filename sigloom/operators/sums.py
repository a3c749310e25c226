"""Sums over all rows of an array column: one array a task, added up by Spark, so that the plan stays small for any width."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Bits of a value that one round of ``nth_smallest`` settles.
DIGIT = 16


def whole_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An array column of one length as a matrix without the rows that are null or hold a null or NaN, and which rows are left."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    held = column.filter(column.is_valid())
    width = len(held[0]) if len(held) else 0
    if not width:
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    x = held.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    good = ~np.isnan(x).any(axis=1)
    return x[good], np.flatnonzero(there)[good]


def rows_of(column: pa.Array) -> np.ndarray:
    """An array column of one length as a matrix; rows that are null or hold a null or NaN are left out."""
    return whole_rows(column)[0] if len(column) else np.zeros((0, 0))


def summed(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], x: str = "x") -> np.ndarray:
    """Sum over all rows of what ``f`` gives for a batch (rows x channels)."""

    def run(batches):
        total = None
        for b in batches:
            rows = rows_of(b.column(0))
            if len(rows):
                part = np.asarray(f(rows), float).reshape(-1)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    rows = df.select(x).mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # as long as what f gives
    return np.array([r["v"] for r in sorted(rows)])


def summed_by(df: DataFrame, by: str, f: Callable[[np.ndarray, object], np.ndarray], x: str = "x") -> dict:
    """The same for each value of ``by``, all in one pass: a task gives one array for each value that it met.

    ``f(rows, value)``. Rows without a value are left out. What is collected has an array for each value.
    """
    kind = df.schema[by]

    def run(batches):
        total: dict = {}
        for b in batches:
            codes = b.column(0).dictionary_encode()
            rows, at = whole_rows(b.column(1))
            index = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)[at]
            for c in np.unique(index[index >= 0]).tolist():
                key = codes.dictionary[c].as_py()
                part = np.asarray(f(rows[index == c], key), float).reshape(-1)
                total[key] = total[key] + part if key in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), codes.dictionary.type), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["k", "s"])

    fields = StructType([StructField("k", kind.dataType), StructField("s", ArrayType(DoubleType()))])
    rows = df.select(by, x).mapInArrow(run, fields).select("k", F.posexplode("s").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["i"]):
        out.setdefault(r["k"], []).append(r["v"])
    return {k: np.array(out[k]) for k in sorted(out)}


def added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays ``m`` of each key, entry by entry; a key's rows may be any number."""
    cells = rows.select(*keys, F.posexplode("m").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("m"))


def moments_by(df: DataFrame, by: str, x: str = "x") -> dict:
    """value -> (mean, covariance, rows) of the rows of each value of ``by``, in one pass over all of them.

    Sums are of the differences to one of the rows, so that large means cost no digits; below two rows the covariance is zero.
    """
    one = df.where(F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")))).select(F.col(x).cast("array<double>").alias("x")).first()
    if one is None:
        return {}
    shift = np.array(one["x"])
    c = len(shift)
    out = {}
    for key, s in summed_by(df, by, lambda r, _: np.r_[len(r), (r - shift).sum(axis=0), ((r - shift).T @ (r - shift)).reshape(-1)], x).items():
        n, gap, square = int(s[0]), s[1 : 1 + c], s[1 + c :].reshape(c, c)
        out[key] = shift + gap / n, (square - np.outer(gap, gap) / n) / (n - 1) if n > 1 else np.zeros((c, c)), n
    return out


def _sortable(v: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order."""
    bits = np.ascontiguousarray(v, np.float64).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def nth_smallest(df: DataFrame, columns: list[str], values: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], n: np.ndarray) -> np.ndarray:
    """The n[g]-th smallest value of each group g, exact and without a sort; NaN where a group has fewer.

    ``values(batch)`` gives numbers of groups and their values; a NaN is none. A value is settled ``DIGIT`` bits at a time: each
    round counts the next digit among the values that agree with the digits found so far, one row for each group, digit and
    task. No group's values come together, and the driver gets one row a group and round.
    """
    wanted = np.asarray(n, np.int64)
    prefix, left = np.zeros(len(wanted), np.uint64), wanted.copy()
    alive = left > 0
    for shift in range(64 - DIGIT, -1, -DIGIT):
        above, mask = np.uint64(shift + DIGIT), (1 << DIGIT) - 1
        asked = alive.copy()

        def count(batches, prefix=prefix.copy(), asked=asked, shift=shift, above=above):
            held: dict[int, int] = {}
            for b in batches:
                g, v = values(b)
                use = asked[g] & ~np.isnan(v)
                g, key = g[use], _sortable(v[use])
                if shift + DIGIT < 64:
                    same = key >> above == prefix[g]
                    g, key = g[same], key[same]
                digit = ((key >> np.uint64(shift)) & np.uint64(mask)).astype(np.int64)
                for k, m in zip(*(a.tolist() for a in np.unique(g.astype(np.int64) << DIGIT | digit, return_counts=True))):
                    held[k] = held.get(k, 0) + m
            keys = np.array(list(held), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys >> DIGIT), pa.array(keys & mask), pa.array(list(held.values()), pa.int64())], names=["g", "digit", "n"])

        counts = df.select(*columns).mapInArrow(count, "g long, digit long, n long").groupBy("g", "digit").agg(F.sum("n").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("digit")))  # 2^DIGIT rows a group at most
        goal = df.sparkSession.createDataFrame(pa.table({"g": pa.array(np.flatnonzero(alive)), "goal": pa.array(left[alive])}))
        found = upto.join(goal, "g").where("upto >= goal").groupBy("g").agg(F.min(F.struct("digit", "upto", "n")).alias("m")).select("g", "m.*").collect()
        alive[:] = False
        for r in found:
            alive[r["g"]] = True
            prefix[r["g"]] = (int(prefix[r["g"]]) << DIGIT) | r["digit"]
            left[r["g"]] -= r["upto"] - r["n"]
    bits = np.where(prefix >> np.uint64(63) == 1, prefix & np.uint64((1 << 63) - 1), ~prefix)
    return np.where(alive, bits.view(np.float64), np.nan)
