"""Joins that Spark has no operator for: bands in time, and the latest row before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, before: float, after: float, how: str = "inner", condition: Column | None = None) -> DataFrame:
    """Rows with equal ``on`` and right time in [left time - before, left time + after].

    Times are cut into buckets as wide as the band; a left row meets the buckets that its band touches (three at most), so
    that the join is an equality on (on, bucket), which can be sorted, hashed and split, with the band as a filter.
    ``how``: inner, left_semi or left_anti. Column names other than ``on`` must differ.
    """
    width = float(max(before + after, 1e-9)) or 1.0
    floor = lambda c: F.floor(c / F.lit(width)).cast("long")
    low, high = F.col(left_time) - F.lit(before), F.col(left_time) + F.lit(after)
    span = F.sequence(floor(low), floor(high))
    inside = F.col(right_time).between(low, high)
    inside = inside if condition is None else inside & condition
    other = right.withColumn("_bucket", floor(F.col(right_time)))
    if how == "inner":
        return left.withColumn("_bucket", F.explode(span)).join(other, [*on, "_bucket"]).where(inside).drop("_bucket")
    keyed = left.withColumn("_row", F.struct(*left.columns))
    hits = keyed.withColumn("_bucket", F.explode(span)).join(other, [*on, "_bucket"]).where(inside).select("_row").distinct()
    return keyed.join(hits, "_row", how).select(*left.columns)


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with ``values`` of the latest right row at or before it (nulls where there is none): union and window."""
    a = left.select("*", *(F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values), F.col(left_time).alias("_at"), F.lit(1).alias("_side"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in on else F.col(f.name) for f in left.schema]
    b = right.select(*empty, *(F.col(v).alias(f"_{v}") for v in values), F.col(right_time).alias("_at"), F.lit(0).alias("_side"))
    order = Window.partitionBy(*on).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = a.unionByName(b).select("*", *(F.last(f"_{v}", ignorenulls=True).over(order).alias(v) for v in values))
    return filled.where("_side = 1").drop("_at", "_side", *(f"_{v}" for v in values))


def sessions(rows: DataFrame, on: list[str], time: str, gap: float, out: str = "session") -> DataFrame:
    """Numbers runs of rows that follow each other within ``gap``."""
    order = Window.partitionBy(*on).orderBy(time)
    fresh = F.coalesce((F.col(time) - F.lag(time).over(order) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_fresh", fresh).withColumn(out, F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")
