"""Spike trains and cluster quality. A train has rows (keys, ``t``); all is lag windows, band joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from sigloom.functions.columns import distance_sq, ncc
from sigloom.operators.sums import added, moments_by, nth_smallest, whole_rows
from sigloom.plans.joins import band_join

#: Points of a block whose distances are taken at once.
BLOCK = 512
#: Distinct times of a train that a correlogram takes along as one piece.
PIECE = 1 << 18
#: Bytes of clusters' matrices that one pass over all points takes along.
PASS_BYTES = 32 << 20


def intervals(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """(keys, t, isi): the time since the spike before, null for the first."""
    return df.select(*keys, t, (F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))).alias("isi"))


def isi_summary(df: DataFrame, keys: list[str], bin_width: float, burst: float, refractory: float) -> DataFrame:
    """Mean, population variance and CV of the intervals, burst index, violation rate, spikes and span.

    Rates are null below two spikes, the CV is 0 there.
    """
    gaps = intervals(df, keys).where("isi is null or isi >= 0")
    isi = F.col("isi")
    return gaps.groupBy(*keys).agg(
        F.count("*").alias("n_spikes"),
        F.avg(isi).alias("isi_mean"),
        F.var_pop(isi).alias("isi_variance"),
        F.coalesce(F.when(F.avg(isi) > 0, F.stddev_pop(isi) / F.avg(isi)), F.lit(0.0)).alias("isi_cv"),
        (F.count_if(isi < burst) / F.nullif(F.count(isi), F.lit(0))).alias("burst_index"),
        (F.count_if(isi < refractory) / F.nullif(F.count(isi), F.lit(0))).alias("violation_rate"),
        F.count_if(isi < refractory).alias("violations"),
    )


def isi_histogram(df: DataFrame, keys: list[str], bin_width: float, bins: int) -> DataFrame:
    """(keys, bin, count); the bin ``bins`` counts what lies beyond."""
    at = F.least(F.floor(F.col("isi") / bin_width), F.lit(bins)).cast("long")
    return intervals(df, keys).where("isi >= 0").groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("count"))


def mode_bin(histogram: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """The fullest bin, the first of equals."""
    return histogram.where(F.col("bin") < bins).groupBy(*keys).agg(F.max_by("bin", F.struct("count", -F.col("bin"))).alias("mode_bin"))


def local_variation(df: DataFrame, keys: list[str]) -> DataFrame:
    """3 / (intervals - 1) * sum(((a - b) / (a + b))^2) over neighbours; 0 below two intervals."""
    gaps = intervals(df, keys).withColumn("_b", F.lag("isi").over(Window.partitionBy(*keys).orderBy("t")))
    both = F.col("isi") + F.col("_b")
    part = F.when(both > 0, ((F.col("isi") - F.col("_b")) / both) ** 2)
    n = F.count("isi")
    return gaps.groupBy(*keys).agg(F.when(n >= 2, 3.0 / (n - 1) * F.coalesce(F.sum(part), F.lit(0.0))).otherwise(0.0).alias("lv"))


def contamination(df: DataFrame, keys: list[str], refractory: float, duration: float) -> DataFrame:
    """min(1, sqrt(violations * duration / (2 * refractory * n^2))), null without two spikes."""
    n, v = F.col("n_spikes"), F.col("violations")
    rate = F.least(F.lit(1.0), F.sqrt(v * duration / (2 * refractory * n * n)))
    return isi_summary(df, keys, refractory, refractory, refractory).select(*keys, F.when(n >= 2, rate).alias("contamination"))


def correlogram(a: DataFrame, b: DataFrame, keys: list[str], bin_width: float, max_lag: float, both_sides: bool) -> DataFrame:
    """(keys, bin, count) of lags below ``max_lag``: of b behind a, or of either order; equal times do not count.

    Equal times of a train are counted first. Pairs are counted, not made: between sorted trains each bin's edge is found for every
    time of a by bisection, and running sums of the counts behind b say how many lie before it. Trains are cut into spans as
    wide as ``max_lag``, and a span of a meets its own span of b and those beside it, in pieces of b of about ``PIECE`` times, so
    that the work grows with the times and the bins, not with the pairs.
    """
    span = float(max(max_lag, 1e-9))
    at = lambda c: F.floor(F.col(c) / span).cast("long")
    left = a.groupBy(*keys, F.col("t").cast("double").alias("t")).agg(F.count("*").alias("n")).withColumn("span", at("t"))
    right = b.groupBy(*keys, F.col("t").cast("double").alias("t")).agg(F.count("*").alias("n")).withColumn("span", at("t"))
    # times are cut into pieces by hash, each of which is a train of its own: the counts of pieces add up
    cut = lambda rows, name: rows.join(rows.groupBy(*keys, "span").agg(F.ceil(F.count("*") / PIECE).cast("long").alias("_parts")), [*keys, "span"]).withColumn(name, F.pmod(F.xxhash64("t"), F.col("_parts")))
    whole = lambda rows, name, t, n: rows.groupBy(*keys, "span", name).agg(F.collect_list("t").alias(t), F.collect_list("n").alias(n)).drop(name)
    offsets = (-1, 0, 1) if both_sides else (0, 1)
    near = whole(cut(left, "_p"), "_p", "ta", "na").withColumn("span", F.explode(F.array(*(F.col("span") + k for k in offsets))))
    pairs = near.join(whole(cut(right, "_q"), "_q", "tb", "nb"), [*keys, "span"]).select(*keys, "ta", "na", "tb", "nb")
    k = len(keys)
    bins = int(np.floor(max_lag / bin_width)) + 1
    fields = StructType([*(pairs.schema[c] for c in keys), StructField("bin", LongType()), StructField("count", LongType())])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ta, na, tb, nb = (batch.column(k + c)[r].values.to_numpy(zero_copy_only=False) for c in range(4))
                counts = lag_counts(ta, na, tb, nb, bin_width, max_lag, bins)
                if both_sides:
                    counts = counts + lag_counts(tb, nb, ta, na, bin_width, max_lag, bins)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([*(pa.repeat(batch.column(c)[r], len(at)) for c in range(k)), pa.array(at), pa.array(counts[at])], schema=to_arrow_schema(fields))

    return pairs.mapInArrow(run, fields).groupBy(*keys, "bin").agg(F.sum("count").alias("count"))


def lag_counts(ta: np.ndarray, na: np.ndarray, tb: np.ndarray, nb: np.ndarray, width: float, most: float, bins: int) -> np.ndarray:
    """Pairs of each bin floor((b - a) / width) with 0 < b - a < most, of distinct times with their counts.

    A bin's number rises with b, so its edge is where it changes; bisection for a + edge may miss that by rounding, and steps back
    or on until it is there.
    """
    order = np.argsort(ta, kind="stable")
    ta, na = ta[order], na[order]
    order = np.argsort(tb, kind="stable")
    tb, upto = tb[order], np.r_[0, np.cumsum(nb[order])]

    def first(guess: np.ndarray, reached: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The first place of b, for each a, whose lag has been ``reached``."""
        at = np.searchsorted(tb, guess)
        while True:
            back = (at > 0) & reached(tb[np.maximum(at - 1, 0)] - ta)
            on = (at < len(tb)) & ~reached(tb[np.minimum(at, len(tb) - 1)] - ta) & ~back
            if not back.any() and not on.any():
                return at
            at = at - back + on

    low, end = first(ta, lambda lag: lag > 0), first(ta + most, lambda lag: lag >= most)
    out, before = np.zeros(bins, np.int64), upto[low]
    for k in range(1, bins + 1):
        edge = np.clip(first(ta + k * width, lambda lag, k=k: np.floor(lag / width) >= k), low, end) if k < bins else end
        after = upto[edge]
        out[k - 1] = int((na * (after - before)).sum())
        before = after
    return out


def autocorrelogram(df: DataFrame, keys: list[str], bin_width: float, max_lag: float) -> DataFrame:
    return correlogram(df, df, keys, bin_width, max_lag, False)


def refractory_dip(histogram: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Whether the mean of the first ``bins`` bins is below half the mean of the next as many; false without a baseline."""
    near = F.sum(F.when(F.col("bin") < bins, F.col("count")).otherwise(0))
    far = F.sum(F.when((F.col("bin") >= bins) & (F.col("bin") < 2 * bins), F.col("count")).otherwise(0))
    return histogram.groupBy(*keys).agg(F.when(far > 0, near < 0.5 * far).otherwise(F.lit(False)).alias("dip"))


# Clusters -----------------------------------------------------------------------------------------


def cluster_means(df: DataFrame, label: str = "label", x: str = "x") -> DataFrame:
    """(label, mean array, members)."""
    points = df.select(label, F.posexplode(x).alias("i", "v"))
    return points.groupBy(label, "i").agg(F.avg("v").alias("m"), F.count("*").alias("n")).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("mean"), F.max("n").alias("members"))


def waveform_snr(means: DataFrame, noise: float, mean: str = "mean") -> DataFrame:
    """(largest - least) over twice the noise, null without noise."""
    return means.withColumn("snr", F.when(F.lit(noise) > 0, (F.array_max(mean) - F.array_min(mean)) / (2 * noise)))


def d_prime(df: DataFrame, label: str, value: str) -> DataFrame:
    """(a, b, d_prime) of all pairs of classes a < b: distance of the means over the pooled deviation."""
    stats = df.groupBy(label).agg(F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("s2"))
    a, b = stats.select(F.col(label).alias("a"), F.col("m").alias("ma"), F.col("s2").alias("sa")), stats.select(F.col(label).alias("b"), F.col("m").alias("mb"), F.col("s2").alias("sb"))
    gap, pooled = F.abs(F.col("ma") - F.col("mb")), F.sqrt((F.col("sa") + F.col("sb")) / 2)
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.when(pooled > 0, gap / pooled).when(gap > 0, F.lit(float("inf"))).otherwise(0.0).alias("d_prime"))


def silhouette(df: DataFrame, by: list[str], key: str, label: str = "label", x: str = "x") -> DataFrame:
    """(by, key, label, silhouette) within sets ``by``: mean distance to the own cluster against the nearest other's.

    A point's mean distance to a cluster is at least its distance to the cluster's centroid, and at most that and the cluster's mean
    distance to its centroid. So each point's nearest other cluster is among those whose least is not above the smallest most, and only
    these and its own are met (``neighbours``): with clusters apart from each other, one or two, however many there are. Points
    stand in blocks of about ``BLOCK`` of one cluster; a pair of blocks goes through one kernel, and no task holds more than two.
    """
    blocks = _blocks(df, by, key, label, x)
    met = neighbours(blocks, by).select(*by, F.col("_block").alias("_i"), F.col("_label").alias("_own"), F.explode("_near").alias("_label"))
    left = met.join(blocks.select(*by, F.col("_label").alias("_own"), F.col("_block").alias("_i"), F.col("p").alias("a")), [*by, "_own", "_i"])
    pairs = left.join(blocks.select(*by, "_label", F.col("p").alias("b"), F.col("_block").alias("_j")), [*by, "_label"])
    pairs = pairs.select(*by, "_own", "_label", "a", "b", (F.col("_own").eqNullSafe(F.col("_label")) & (F.col("_i") == F.col("_j"))).alias("own"))
    kinds = [df.schema[c] for c in by]
    fields = StructType([*kinds, StructField(key, df.schema[key].dataType), StructField(label, df.schema[label].dataType), StructField("_l", df.schema[label].dataType), StructField("d", DoubleType()), StructField("n", LongType())])
    n = len(by)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = batch.column(n + 2)[r].values, batch.column(n + 3)[r].values
                u, v = _matrix(a), _matrix(b)
                d = np.sqrt(np.maximum(((u[:, None] - v[None]) ** 2).sum(axis=2), 0) if u.shape[1] <= 4 else distances_sq(u, v)).sum(axis=1)
                held = np.full(len(u), len(v) - batch.column(n + 4)[r].as_py())  # a point is not its own neighbour
                yield pa.RecordBatch.from_arrays([*(pa.repeat(batch.column(c)[r], len(u)) for c in range(n)), a.field("k"), pa.repeat(batch.column(n)[r], len(u)), pa.repeat(batch.column(n + 1)[r], len(u)), pa.array(d), pa.array(held)], schema=to_arrow_schema(fields))

    sums = pairs.mapInArrow(run, fields).where("n > 0")
    means = sums.groupBy(*by, key, label, "_l").agg((F.sum("d") / F.sum("n")).alias("d"))
    sides = means.groupBy(*by, key, label).agg(F.max(F.when(F.col("_l") == F.col(label), F.col("d"))).alias("a"), F.min(F.when(F.col("_l") != F.col(label), F.col("d"))).alias("b"))
    most = F.greatest("a", "b")
    return sides.where("a is not null and b is not null").select(*by, key, label, F.when(most > 0, (F.col("b") - F.col("a")) / most).otherwise(0.0).alias("silhouette"))


def _matrix(points: pa.StructArray) -> np.ndarray:
    lists = points.field("x")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _blocks(df: DataFrame, by: list[str], key: str, label: str, x: str) -> DataFrame:
    """(by, _label, _block, p): points of one cluster, about ``BLOCK`` together."""
    own = [*by, "_label"]
    named = df.where(F.col(label).isNotNull() & F.col(x).isNotNull()).withColumn("_label", F.col(label))
    sizes = named.groupBy(*own).agg(F.ceil(F.count("*") / BLOCK).alias("_parts"))
    points = named.select(*own, F.struct(F.col(key).alias("k"), F.col(x).cast("array<double>").alias("x")).alias("p"))
    return points.join(sizes, own).groupBy(*own, F.pmod(F.xxhash64("p.k"), F.col("_parts")).alias("_block")).agg(F.collect_list("p").alias("p"))


def neighbours(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, _label, _block, _near): the own cluster and those that may be the nearest other one of some point of the block.

    A set's clusters come as one array of centroids and mean distances, a row for each.
    """
    own = [*by, "_label"]
    kinds = StructType([blocks.schema[c] for c in own])
    n = len(own)

    def total(batches):
        for b in batches:
            sums = [[float(len(x)), *x.sum(axis=0).tolist()] for x in (_matrix(b.column(n + 1)[r].values) for r in range(b.num_rows))]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(sums, pa.list_(pa.float64()))], names=[*own, "m"])

    def spread(batches):
        for b in batches:
            sums = [float(np.sqrt(((_matrix(b.column(n + 1)[r].values) - np.array(b.column(n + 2)[r].as_py())) ** 2).sum(axis=1)).sum()) for r in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(sums, pa.float64())], names=[*own, "d"])

    m = added(blocks.mapInArrow(total, StructType([*kinds, StructField("m", ArrayType(DoubleType()))])), own)
    centres = m.select(*own, F.transform(F.slice("m", 2, F.size("m") - 1), lambda v: v / F.col("m")[0]).alias("centre"), F.col("m")[0].alias("held"))
    placed = blocks.join(centres, own).select(*own, "_block", "p", "centre")
    far = placed.mapInArrow(spread, StructType([*kinds, StructField("d", DoubleType())])).groupBy(*own).agg(F.sum("d").alias("d"))
    clusters = centres.join(far, own).select(*own, "centre", (F.col("d") / F.col("held")).alias("radius"))
    every = clusters.groupBy(*by).agg(F.collect_list(F.struct("_label", "centre", "radius")).alias("clusters")) if by else clusters.agg(F.collect_list(F.struct("_label", "centre", "radius")).alias("clusters"))
    joined = blocks.join(every, by) if by else blocks.crossJoin(F.broadcast(every))  # one row
    columns = joined.select(*own, "_block", "p", "clusters")
    fields = StructType([*kinds, blocks.schema["_block"], StructField("_near", ArrayType(blocks.schema["_label"].dataType))])

    def choose(batches):
        for b in batches:
            near = []
            for r in range(b.num_rows):
                x, c = _matrix(b.column(n + 1)[r].values), b.column(n + 2)[r].values
                names, mine = c.field("_label").to_pylist(), b.column(n - 1)[r].as_py()
                lists = c.field("centre")
                least = np.sqrt(distances_sq(x, lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)))
                others = np.array([name != mine for name in names])
                open_ = np.zeros(len(names), bool)
                if others.any():
                    bound = (least + c.field("radius").to_numpy(zero_copy_only=False))[:, others].min(axis=1)
                    open_ = others & (least <= bound[:, None] * (1 + 1e-12)).any(axis=0)
                near.append([mine, *(name for name, o in zip(names, open_) if o)])
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], pa.array(near, to_arrow_schema(fields).field("_near").type)], schema=to_arrow_schema(fields))

    return columns.mapInArrow(choose, fields)


def distances_sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of both, a few rows at a time."""
    out = np.empty((len(a), len(b)))
    for k in range(0, len(a), 16):
        gap = a[k : k + 16, None] - b[None]
        out[k : k + 16] = (gap * gap).sum(axis=2)
    return out


def mahalanobis_sq(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Squared length of ``scale`` times what each row differs from the mean by; a row's result does not depend on the others."""
    out = np.empty(len(x))
    for k in range(0, len(x), 64):
        y = ((x[k : k + 64] - mean)[:, None, :] * scale).sum(axis=2)
        out[k : k + 64] = (y * y).sum(axis=1)
    return out


def isolation(df: DataFrame, label: str = "label", x: str = "x", ridge: float = 0.0, euclidean: bool = False) -> DataFrame:
    """(label, members, isolation): the n-th least squared Mahalanobis distance of non-members, n the cluster's size.

    Null where there are fewer non-members, or where the covariance (with ``ridge`` on its diagonal) has no inverse; a row
    without a label is nobody's member. One pass gives all clusters' moments, and four count the digits of the distances, so
    that no task gets a cluster's distances to sort. Passes take as many clusters as ``PASS_BYTES`` of matrices hold.
    """
    spark, kind = df.sparkSession, df.schema[label]
    found = moments_by(df, label, x)
    scales, names = [], list(found)
    for mean, cov, _ in found.values():
        try:
            scales.append(np.eye(len(mean)) if euclidean else np.linalg.inv(np.linalg.cholesky(cov + ridge * np.eye(len(mean)))))
        except np.linalg.LinAlgError:
            scales.append(None)
    out = np.full(len(names), np.nan)
    width = len(next(iter(found.values()))[0]) if found else 0
    usable = [k for k, s in enumerate(scales) if s is not None]
    step = max(1, PASS_BYTES // max(1, 8 * width * (width + 1)))
    for start in range(0, len(usable), step):
        part = usable[start : start + step]
        models = [(names[k], found[names[k]][0], scales[k]) for k in part]

        def values(batch: pa.RecordBatch, models=models):
            rows, at = whole_rows(batch.column(1))
            if not len(rows):
                return np.zeros(0, np.int64), np.zeros(0)
            codes = batch.column(0).dictionary_encode()
            index, known = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)[at], codes.dictionary.to_pylist()
            groups, distances = [], []
            for g, (name, mean, scale) in enumerate(models):
                others = index != known.index(name) if name in known else np.ones(len(rows), bool)
                distances.append(mahalanobis_sq(rows[others], mean, scale))
                groups.append(np.full(len(distances[-1]), g))
            return np.concatenate(groups), np.concatenate(distances)

        out[part] = nth_smallest(df, [label, x], values, np.array([found[names[k]][2] for k in part]))
    fields = StructType([StructField(label, kind.dataType), StructField("members", LongType()), StructField("isolation", DoubleType())])
    return spark.createDataFrame([(k, found[k][2], None if np.isnan(v) else float(v)) for k, v in zip(names, out)], fields)  # a row a cluster


# Templates ----------------------------------------------------------------------------------------


def _all_of(templates: DataFrame, template: str, mean: str):
    """The templates, a row for each, as one array of (id, mean) in order of the id: a scalar subquery, so that no row is repeated."""
    return templates.agg(F.array_sort(F.collect_list(F.struct(F.col(template).alias("id"), F.col(mean).alias("mean"))))).scalar()


def nearest_template(df: DataFrame, templates: DataFrame, key: str, x: str = "x", template: str = "template_id", mean: str = "mean") -> DataFrame:
    """(key, template, distance_sq) of the least squared distance, the first template of equals."""
    told = F.transform("_all", lambda t: F.struct(distance_sq(F.col(x), t["mean"]).alias("d"), t["id"].alias("id")))
    best = df.select(key, x, _all_of(templates, template, mean).alias("_all")).select(key, F.array_min(told).alias("m"))
    return best.select(key, F.col("m.id").alias(template), F.col("m.d").alias("distance_sq"))


def best_correlation(df: DataFrame, templates: DataFrame, key: str, x: str = "x", template: str = "template_id", mean: str = "mean", least: float | None = None) -> DataFrame:
    """(key, template, ncc) of the largest cosine, the first template of equals; below ``least`` the template is null (unclassified)."""
    told = F.transform("_all", lambda t: F.struct((-ncc(F.col(x), t["mean"])).alias("c"), t["id"].alias("id")))
    best = df.select(key, x, _all_of(templates, template, mean).alias("_all")).select(key, F.array_min(told).alias("m"))
    named = F.col("m.id") if least is None else F.when(-F.col("m.c") >= least, F.col("m.id"))
    return best.select(key, named.alias(template), (-F.col("m.c")).alias("ncc"))


def combined_features(df: DataFrame, features: str, spatial: str, weight: float, out: str = "f") -> DataFrame:
    return df.withColumn(out, F.concat(features, F.transform(spatial, lambda v: v * weight)))


def snippets(samples: DataFrame, spikes: DataFrame, before: int, width: int) -> DataFrame:
    """(recording_id, channel, sample, x): ``width`` samples from ``before`` ahead of each spike; those cut by an end are left out."""
    wanted = spikes.select("recording_id", "channel", F.col("sample").cast("double").alias("sample"))
    rows = samples.select("recording_id", "channel", F.col("sample_idx").cast("double").alias("sample_idx"), "value")
    hit = band_join(wanted, rows, ["recording_id", "channel"], "sample", "sample_idx", before, width - before - 1)
    x = F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))), lambda p: p["value"])
    return hit.groupBy("recording_id", "channel", "sample").agg(x.alias("x")).where(F.size("x") == width).withColumn("sample", F.col("sample").cast("long"))


def snippets_of_all(samples: DataFrame, spikes: DataFrame, before: int, width: int) -> DataFrame:
    """(recording_id, sample, channel, x) of every channel around each spike, whatever channel it was found on."""
    wanted = spikes.select("recording_id", F.col("sample").cast("double").alias("sample")).distinct()
    rows = samples.select("recording_id", "channel", F.col("sample_idx").cast("double").alias("sample_idx"), "value")
    hit = band_join(wanted, rows, ["recording_id"], "sample", "sample_idx", before, width - before - 1)
    x = F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))), lambda p: p["value"])
    return hit.groupBy("recording_id", "sample", "channel").agg(x.alias("x")).where(F.size("x") == width).withColumn("sample", F.col("sample").cast("long"))


def spatial_features(samples: DataFrame, spikes: DataFrame, probe: DataFrame, reach: int = 2) -> DataFrame:
    """(recording_id, sample, x, y): centre of mass of each channel's largest size within ``reach`` samples of a spike."""
    from sigloom.operators.spatial import centre_of_mass

    wanted = spikes.select("recording_id", F.col("sample").cast("double").alias("sample")).distinct()
    rows = samples.select("recording_id", "channel", F.col("sample_idx").cast("double").alias("sample_idx"), "value")
    peaks = band_join(wanted, rows, ["recording_id"], "sample", "sample_idx", reach, reach).groupBy("recording_id", "sample", "channel").agg(F.max(F.abs("value")).alias("amplitude"))
    return centre_of_mass(peaks.withColumn("sample", F.col("sample").cast("long")), probe, ["recording_id", "sample"])


def aligned(samples: DataFrame, spikes: DataFrame, half: int) -> DataFrame:
    """Spikes moved to the least sample within ``half``: only if it is below the sample they stand at, the first of equals."""
    wanted = spikes.select("recording_id", "channel", F.col("sample").cast("double").alias("sample"))
    rows = samples.select("recording_id", "channel", F.col("sample_idx").cast("double").alias("sample_idx"), "value")
    hit = band_join(wanted, rows, ["recording_id", "channel"], "sample", "sample_idx", half, half)
    rank = F.struct("value", F.col("sample_idx") != F.col("sample"), "sample_idx")
    return hit.groupBy("recording_id", "channel", "sample").agg(F.min_by("sample_idx", rank).cast("long").alias("peak"), F.min("value").alias("trough")).withColumn("sample", F.col("sample").cast("long"))


def centred(x: str, at: int):
    """An array moved so that its minimum stands at ``at``, zeros where nothing was."""
    low = F.array_position(x, F.array_min(x)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.coalesce(F.when((i + low - at >= 0) & (i + low - at < F.size(x)), F.get(x, i + low - at)), F.lit(0.0)))
