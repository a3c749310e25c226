"""Connected components with DataFrame operations only (alternating large and small stars).

Every round is a written table, so the plan stays short and a lost executor costs one round. Groups are reduced by
``min`` before they are joined, and joins on a hub's key can be split, so that one node may hold a third of all edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import discard, durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's (larger | not larger) neighbours, or itself, to the least of its neighbourhood."""
    if large:
        near = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    if large:
        least = durable(least)  # a scan of its own, so that the join can be split at a hub
    joined = near.join(least, "a")
    if large:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).where("a != b")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of one orderable type -> (node, component): each node of an edge and the least node that it reaches.

    Nulls and loops link nothing; an empty table gives an empty result.
    """
    now = durable(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        then = durable(_star(_star(now, True), False).distinct())
        mark = then.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = then
        if mark == state:
            break
        state = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
