"""Curation of clusters on tables: merges and splits of spikes that lie in any number of segments and tasks.

Spikes have rows (recording_id, label, sample, x array, amplitude). What a cluster is to its neighbours are sums that add up
(count, mean and second moments), so that clusters of different segments, tasks and days are compared and joined without their spikes. All
recordings are worked on at once; a recording's own merges happen one after another, the closest pair first, as each changes
what is closest next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.sums import added, whole_rows
from sigloom.sources.shared import removed, written

REC = "recording_id"


def statistics(spikes: DataFrame, x: str = "x") -> DataFrame:
    """(recording_id, label, m array): count, sums and second moments of each cluster; they add up entry by entry."""
    fields = f"{REC} long, label long, m array<double>"

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            rows, at = whole_rows(b.column(2))
            if not len(rows):
                continue
            keys = np.stack([b.column(k).to_numpy(zero_copy_only=False)[at] for k in (0, 1)], axis=1)
            named, which = np.unique(keys, axis=0, return_inverse=True)
            for k, key in enumerate(map(tuple, named.tolist())):
                own = rows[which.reshape(-1) == k]
                part = np.r_[len(own), own.sum(axis=0), (own.T @ own).reshape(-1)]
                total[key] = total[key] + part if key in total else part
        if total:
            a, b = zip(*total)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=[REC, "label", "m"])

    rows = spikes.where(f"{REC} is not null and label is not null").select(F.col(REC).cast("long").alias(REC), F.col("label").cast("long").alias("label"), x)
    return added(rows.mapInArrow(run, fields), [REC, "label"])


def _moments(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and covariances (zero below two) of rows of statistics."""
    d = (int(np.sqrt(4 * m.shape[1] - 3)) - 1) // 2
    n, s, q = m[:, 0], m[:, 1 : 1 + d], m[:, 1 + d :].reshape(-1, d, d)
    mean = s / n[:, None]
    cov = (q - n[:, None, None] * mean[:, :, None] * mean[:, None, :]) / np.maximum(n - 1, 1)[:, None, None]
    return n, mean, np.where(n[:, None, None] > 1, cov, 0.0)


def separations(pairs: DataFrame, a: str = "ma", b: str = "mb", out: str = "separation") -> DataFrame:
    """``pairs`` with ``out`` double: how far two clusters lie apart along the line between their means, over their pooled deviation."""
    keep = [c for c in pairs.columns if c not in (a, b)]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            (_, u, p), (_, v, q) = (_moments(np.array(batch.column(batch.schema.get_field_index(c)).to_pylist(), float)) for c in (a, b))
            gap = u - v
            size = np.linalg.norm(gap, axis=1)
            axis = gap / np.maximum(size, 1e-300)[:, None]
            pooled = np.sqrt(np.maximum(np.einsum("ni,nij,nj->n", axis, p + q, axis), 0) / 2)
            with np.errstate(divide="ignore"):
                far = np.where(size < 1e-12, 0.0, np.where(pooled > 0, size / pooled, np.inf))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(far)], names=[*keep, out])

    return pairs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name in keep) + f", {out} double")


def merged(spikes: DataFrame, most: float, refractory: int | None = None, limit: float = 0.05, near: DataFrame | None = None, x: str = "x") -> DataFrame:
    """(recording_id, label, cluster): the cluster that each label ends in, the smallest of its labels.

    The least separated pair of a recording becomes one while it is at most ``most`` apart; with ``refractory``, only if at most
    ``limit`` of the union's intervals are shorter, and pairs that fail wait until the recording's next merge. ``near``
    (recording_id, a, b): labels that may be one, where not all may.
    """
    at = [REC]
    clusters = written(statistics(spikes, x).withColumnRenamed("label", "c"))
    names = written(clusters.select(REC, F.col("c").alias("label"), F.col("c").alias("cluster")))
    failed = written(clusters.select(REC, F.col("c").alias("a"), F.col("c").alias("b")).where("false"))
    times = written(spikes.select(F.col(REC).cast("long").alias(REC), F.col("label").cast("long").alias("label"), "sample")) if refractory else None
    while True:
        left, right = clusters.select(REC, F.col("c").alias("a"), F.col("m").alias("ma")), clusters.select(REC, F.col("c").alias("b"), F.col("m").alias("mb"))
        pairs = left.join(right, REC).where("a < b").join(failed, [REC, "a", "b"], "left_anti")
        if near is not None:
            one, two = (names.select(REC, F.col("label").alias(k), F.col("cluster").alias(c)) for k, c in (("a", "ca"), ("b", "cb")))
            open_ = near.select(REC, "a", "b").join(one, [REC, "a"]).join(two, [REC, "b"]).select(REC, F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
            pairs = pairs.join(open_, [REC, "a", "b"], "left_semi")
        best = written(separations(pairs).where(F.col("separation") <= most).groupBy(REC).agg(F.min(F.struct("separation", "a", "b")).alias("p")).select(REC, "p.a", "p.b"))
        if best.isEmpty():
            for old in (best, clusters, failed, times):
                if old is not None:
                    removed(old)
            return names
        taken = best
        if times is not None:
            union = times.join(names, [REC, "label"]).join(best, REC).where("cluster = a or cluster = b")
            gaps = union.select(REC, (F.col("sample") - F.lag("sample").over(Window.partitionBy(REC).orderBy("sample"))).alias("gap"))
            rates = gaps.groupBy(REC).agg(F.coalesce(F.avg((F.col("gap") < refractory).cast("double")), F.lit(0.0)).alias("rate"))
            taken = written(best.join(rates, REC).where(F.col("rate") <= limit).select(REC, "a", "b"))
        other = best.join(taken, [REC, "a", "b"], "left_anti")
        into = taken.select(REC, F.col("b").alias("c"), F.col("a").alias("to"))
        moved = clusters.join(into, [REC, "c"], "left").select(REC, F.coalesce("to", "c").alias("c"), "m")
        rows = {
            "clusters": written(added(moved, [REC, "c"])),
            "names": written(names.join(into.withColumnRenamed("c", "cluster"), [REC, "cluster"], "left").select(REC, "label", F.coalesce("to", "cluster").alias("cluster"))),
            "failed": written(failed.join(taken, REC, "left_anti").unionAll(other)),
        }
        for old in (clusters, names, failed, best, taken):
            removed(old)
        clusters, names, failed = rows["clusters"], rows["names"], rows["failed"]


def axes(stats: DataFrame, steps: int = 3) -> DataFrame:
    """(recording_id, label, mean, axis): each cluster's main axis by a few power steps from all ones."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, mean, cov = _moments(np.array(batch.column(2).to_pylist(), float))
            v = np.ones(mean.shape)
            for _ in range(steps):
                v = np.einsum("nij,nj->ni", cov * np.maximum(n - 1, 1)[:, None, None], v)
                v /= np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mean.tolist(), pa.list_(pa.float64())), pa.array(v.tolist(), pa.list_(pa.float64()))], names=[REC, "label", "mean", "axis"])

    return stats.select(REC, "label", "m").mapInArrow(run, f"{REC} long, label long, mean array<double>, axis array<double>")


def _relabelled(spikes: DataFrame, upper: DataFrame, least: int, most: int | None) -> DataFrame:
    """``spikes`` with ``cluster``: where at least ``least`` are on both sides, those above get labels behind the recording's last, in order.

    ``upper``: spikes with ``above``. ``most``: clusters of a recording at most; later splits are left out.
    """
    sides = upper.groupBy(REC, "label").agg(F.count("*").alias("n"), F.count_if("above").alias("up"))
    order = Window.partitionBy(REC).orderBy("label")
    ok = sides.where((F.col("up") >= least) & (F.col("n") - F.col("up") >= least)).withColumn("k", F.row_number().over(order))
    whole = sides.groupBy(REC).agg(F.max("label").alias("last"), F.count("*").alias("held"))
    new = ok.join(whole, REC)
    if most is not None:
        new = new.where(F.col("held") + F.col("k") <= most)
    new = new.select(REC, "label", (F.col("last") + F.col("k")).alias("fresh"))
    return upper.join(new, [REC, "label"], "left").withColumn("cluster", F.when(F.col("above") & F.col("fresh").isNotNull(), F.col("fresh")).otherwise(F.col("label"))).select(*spikes.columns, "cluster")


def split(spikes: DataFrame, refractory: int, limit: float = 0.1, bimodality: float = 2.0, least: int = 10, most: int | None = None, x: str = "x") -> DataFrame:
    """``spikes`` with ``cluster``: clusters cut at a wide gap of their main axis, or at its median where too many intervals are short.

    A gap is wide beyond ``bimodality`` deviations; both sides keep ``least`` spikes at least.
    """
    placed = spikes.join(axes(statistics(spikes, x)), [REC, "label"])
    p = F.aggregate(F.zip_with(F.zip_with(x, "mean", lambda a, m: a - m), "axis", lambda a, v: a * v), F.lit(0.0), lambda t, v: t + v)
    placed = placed.withColumn("p", p)
    own = Window.partitionBy(REC, "label")
    gaps = placed.select(REC, "label", "p", (F.lead("p").over(own.orderBy("p")) - F.col("p")).alias("gap"))
    widest = gaps.groupBy(REC, "label").agg(F.max(F.struct("gap", (-F.col("p")).alias("start"))).alias("g"), F.stddev_pop("p").alias("spread"), F.count("*").alias("n"), F.median("p").alias("middle"))
    short = spikes.select(REC, "label", (F.col("sample") - F.lag("sample").over(own.orderBy("sample"))).alias("isi"))
    rates = short.groupBy(REC, "label").agg(F.coalesce(F.avg((F.col("isi") < refractory).cast("double")), F.lit(0.0)).alias("rate"))
    wide = F.col("g.gap") > bimodality * F.greatest("spread", F.lit(1e-12))
    start = -F.col("g.start")
    cut = F.when(wide, start + F.col("g.gap") / 2).when(F.col("rate") > limit, F.col("middle"))
    cuts = widest.join(rates, [REC, "label"]).select(REC, "label", F.when(F.col("n") >= 2 * least, cut).alias("cut"))
    upper = placed.join(cuts, [REC, "label"]).withColumn("above", F.coalesce(F.col("p") > F.col("cut"), F.lit(False)))
    return _relabelled(spikes, upper, least, most)


def split_by_amplitude(spikes: DataFrame, bimodality: float = 2.0, least: int = 10, most: int | None = None) -> DataFrame:
    """``spikes`` with ``cluster``: clusters cut at the widest gap of their amplitudes (``least`` spikes from both ends) if it is wide against both sides.

    Wide: at least twice ``bimodality`` deviations, by the larger of both sides' median deviations.
    """
    order = Window.partitionBy(REC, "label").orderBy("amplitude")
    ranked = spikes.select(REC, "label", "amplitude", F.row_number().over(order).alias("k"), F.lead("amplitude").over(order).alias("next"), F.count("*").over(Window.partitionBy(REC, "label")).alias("n"))
    inner = ranked.where((F.col("k") >= least) & (F.col("k") <= F.col("n") - least))
    cuts = inner.groupBy(REC, "label").agg(F.max(F.struct((F.col("next") - F.col("amplitude")).alias("gap"), (-F.col("k")).alias("k"), F.col("amplitude").alias("low"), F.col("next").alias("high"))).alias("g")).select(REC, "label", "g.*")
    sided = ranked.join(cuts.select(REC, "label", "gap", F.col("k").alias("cut"), "low", "high"), [REC, "label"]).withColumn("up", F.col("k") > -F.col("cut"))
    middle = sided.groupBy(REC, "label", "up").agg(F.median("amplitude").alias("middle"))
    spread = sided.join(middle, [REC, "label", "up"]).groupBy(REC, "label", "up").agg((F.median(F.abs(F.col("amplitude") - F.col("middle"))) / 0.6745).alias("spread"))
    widest = spread.groupBy(REC, "label").agg(F.max("spread").alias("spread"))
    wide = cuts.join(widest, [REC, "label"]).where(F.col("gap") >= bimodality * 2 * F.greatest("spread", F.lit(1e-12))).select(REC, "label", ((F.col("low") + F.col("high")) / 2).alias("cut"))
    upper = spikes.join(wide, [REC, "label"], "left").withColumn("above", F.coalesce(F.col("amplitude") > F.col("cut"), F.lit(False)))
    return _relabelled(spikes, upper, 1, most)
