"""Operators across channels of one instant: wide frames (``x`` array) or long samples, and probe geometry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions.columns import matvec, total
from sigloom.functions.linear import whitening
from sigloom.operators.signals import of_arrays
from sigloom.operators.sums import summed

#: Entries of a matrix that is written out as one expression.
EXPRESSION = 256


def route(df: DataFrame, channels: list[int], x: str = "x") -> DataFrame:
    """Selects, orders and repeats channels by index."""
    return df.withColumn(x, F.array(*(F.get(x, F.lit(k)) for k in channels)))


def average_reference(df: DataFrame, x: str = "x") -> DataFrame:
    mean = total(x) / F.size(x)
    return df.withColumn("_m", mean).withColumn(x, F.transform(x, lambda v: v - F.col("_m"))).drop("_m")


def average_reference_long(df: DataFrame) -> DataFrame:
    """The same on long samples: one exchange by instant."""
    return df.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("recording_id", "sample_idx")))


def median_of(x: Column | str) -> Column:
    """Median of an array, the mean of both middles for an even size."""
    s, n = F.array_sort(x), F.size(x)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def median_reference(df: DataFrame, x: str = "x") -> DataFrame:
    """Less the channels' median; frames of two channels or fewer stay as they are."""
    return df.withColumn("_m", F.when(F.size(x) > 2, median_of(x)).otherwise(0.0)).withColumn(x, F.transform(x, lambda v: v - F.col("_m"))).drop("_m")


def linear_neighbors(spark: SparkSession, channels: int, reach: int = 1) -> DataFrame:
    """(channel, neighbor, distance) on a line."""
    a = spark.range(channels).select(F.col("id").cast("int").alias("channel"))
    near = a.select("channel", F.explode(F.sequence(F.col("channel") - reach, F.col("channel") + reach)).alias("neighbor"))
    return near.where((F.col("neighbor") != F.col("channel")) & F.col("neighbor").between(0, channels - 1)).withColumn("distance", F.abs(F.col("neighbor") - F.col("channel")).cast("double"))


def laplacian_weights(neighbors: DataFrame, inverse_distance: bool = False) -> DataFrame:
    """Weights that sum to one for each channel; self links and distances that are not positive are refused."""
    bad = neighbors.where((F.col("channel") == F.col("neighbor")) | (F.col("distance") <= 0))
    if bad.limit(1).count():
        raise ValueError("a channel is its own neighbour, or a distance is not positive")
    weight = 1 / F.col("distance") if inverse_distance else F.lit(1.0)
    return neighbors.select("channel", "neighbor", (weight / F.sum(weight).over(Window.partitionBy("channel"))).alias("weight"))


def laplacian(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Long samples: value less the weighted sum of its neighbours at the same instant. ``weights`` has a row for each link."""
    others = df.select("recording_id", "sample_idx", F.col("channel").alias("neighbor"), F.col("value").alias("_v"))
    around = others.join(weights, "neighbor").groupBy("recording_id", "sample_idx", "channel").agg(F.sum(F.col("weight") * F.col("_v")).alias("_around"))
    return df.join(around, ["recording_id", "sample_idx", "channel"], "left").withColumn("value", F.col("value") - F.coalesce("_around", F.lit(0.0))).drop("_around")


def laplacian_wide(df: DataFrame, weights: dict[int, dict[int, float]], channels: int, x: str = "x") -> DataFrame:
    """The same on frames with constant weights: one projection."""
    rows = [[float(k == c) - weights.get(c, {}).get(k, 0.0) for k in range(channels)] for c in range(channels)]
    return df.withColumn(x, matvec(rows, F.col(x)))


def covariance(df: DataFrame, x: str = "x", by: list[str] | None = None) -> DataFrame:
    """(i, j, cov, corr, n) for i <= j: one aggregation over all pairs of channels; below two frames zeros."""
    width = F.size(x)
    pairs = df.select(*(by or []), F.posexplode(x).alias("i", "a"), F.col(x)).select(*(by or []), "i", "a", F.posexplode(F.slice(F.col(x), F.col("i") + 1, width)).alias("k", "b")).withColumn("j", F.col("i") + F.col("k"))
    cov, spread = F.coalesce(F.covar_samp("a", "b"), F.lit(0.0)), F.stddev_samp("a") * F.stddev_samp("b")
    return pairs.groupBy(*(by or []), "i", "j").agg(cov.alias("cov"), F.when((F.stddev_samp("a") > 1e-10) & (F.stddev_samp("b") > 1e-10), F.covar_samp("a", "b") / spread).otherwise(0.0).alias("corr"), F.count("*").alias("n"))


def covariance_matrix(df: DataFrame, x: str = "x") -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, frames) on the driver: a few numbers for each pair of channels. Frames with a missing sample are left out.

    Two rounds of sums (means, then products of what is left), so that large means cost no digits.
    """
    first = summed(df, lambda r: np.r_[len(r), r.sum(axis=0)], x)
    if not len(first):
        width = df.select(F.size(x).alias("c")).first()
        c = max(0, width["c"]) if width and width["c"] else 0
        return np.zeros(c), np.zeros((c, c)), 0
    n = int(first[0])
    mean = first[1:] / n
    c = len(mean)
    second = summed(df, lambda r: (r - mean).T @ (r - mean), x).reshape(c, c)
    return mean, second / (n - 1) if n > 1 else np.zeros((c, c)), n


def quiet_covariance(df: DataFrame, sigma: list[float], k: float, min_samples: int, x: str = "x") -> np.ndarray:
    """Covariance of the frames whose channels all stay below k * sigma; of all frames where these are too few."""
    quiet = F.forall(F.zip_with(x, F.array(*(F.lit(float(s)) for s in sigma)), lambda v, s: F.abs(v) < s * k), lambda ok: ok)
    _, cov, n = covariance_matrix(df.where(quiet), x)
    return cov if n >= min_samples else covariance_matrix(df, x)[1]


def fit_whitening(df: DataFrame, epsilon: float = 1e-6, mode: str = "zca", x: str = "x") -> np.ndarray:
    return whitening(covariance_matrix(df, x)[1], epsilon, mode)


def apply_matrix(df: DataFrame, matrix: np.ndarray, x: str = "x", out: str = "x") -> DataFrame:
    """Rows of a matrix times each frame (whitening, spatial filters, unmixing).

    Small matrices are one expression; beyond ``EXPRESSION`` entries, whose code would not compile, Arrow batches are multiplied.
    """
    matrix = np.asarray(matrix, float)
    if matrix.size <= EXPRESSION:
        return df.withColumn(out, matvec(matrix.tolist(), F.col(x)))
    whole = F.coalesce(F.col(x).cast("array<double>"), F.array_repeat(F.lit(float("nan")), matrix.shape[1]))
    done = of_arrays(df.withColumn("_frame", whole), lambda r: r @ matrix.T, "_frame", "_product")
    return done.withColumn(out, F.when(F.col(x).isNotNull(), F.col("_product"))).drop("_product").select(*dict.fromkeys([*df.columns, out]))


# Probes -------------------------------------------------------------------------------------------


def _probe(spark: SparkSession, channels: int, x: Column, y: Column) -> DataFrame:
    return spark.range(channels).select(F.col("id").cast("int").alias("channel"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def linear_probe(spark: SparkSession, channels: int, pitch: float) -> DataFrame:
    return _probe(spark, channels, F.lit(0.0), F.col("id") * pitch)


def polytrode(spark: SparkSession, rows: int, columns: int, pitch_x: float, pitch_y: float) -> DataFrame:
    """A grid, row by row, with its columns around x = 0."""
    return _probe(spark, rows * columns, (F.col("id") % columns - (columns - 1) / 2) * pitch_x, F.floor(F.col("id") / columns) * pitch_y)


def tetrode(spark: SparkSession, pitch: float) -> DataFrame:
    return _probe(spark, 4, (F.col("id") % 2 - 0.5) * pitch, (F.floor(F.col("id") / 2) - 0.5) * pitch)


def neuropixels_1(spark: SparkSession) -> DataFrame:
    return _probe(spark, 384, F.col("id") % 2 * 32.0, F.floor(F.col("id") / 2) * 20.0)


def neuropixels_2(spark: SparkSession) -> DataFrame:
    """Two columns, the second shifted by half a pitch."""
    return _probe(spark, 384, F.col("id") % 2 * 32.0 + F.floor(F.col("id") / 2) % 2 * 16.0, F.floor(F.col("id") / 2) * 15.0)


def utah_array(spark: SparkSession) -> DataFrame:
    """Ten by ten at 400 um without its corners."""
    at = spark.range(100).where(~F.col("id").isin(0, 9, 90, 99))
    return at.select((F.row_number().over(Window.orderBy("id")) - 1).cast("int").alias("channel"), (F.col("id") % 10 * 400.0).alias("x"), (F.floor(F.col("id") / 10) * 400.0).alias("y"))


def probe_pairs(probe: DataFrame) -> DataFrame:
    """Distances of all ordered pairs of channels; a probe has a few hundred."""
    a, b = probe.select("channel", F.col("x").alias("xa"), F.col("y").alias("ya")), probe.select(F.col("channel").alias("neighbor"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    pairs = a.crossJoin(b).where("channel != neighbor")
    return pairs.select("channel", "neighbor", F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2).alias("distance"))


def neighbors_within(probe: DataFrame, radius: float) -> DataFrame:
    return probe_pairs(probe).where(F.col("distance") <= radius)


def nearest_channels(probe: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("channel").orderBy("distance", "neighbor")
    return probe_pairs(probe).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def extent(probe: DataFrame) -> DataFrame:
    """Width, height and channels by area (infinite without area)."""
    box = probe.agg((F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"), F.count("*").alias("n"))
    area = F.col("width") * F.col("height")
    return box.select("width", "height", F.when(area > 0, F.col("n") / area).otherwise(F.lit(float("inf"))).alias("density"))


def centre_of_mass(amplitudes: DataFrame, probe: DataFrame, by: list[str], threshold: float | None = None) -> DataFrame:
    """Mean position weighted by |amplitude|. Without weight: (0, 0), or null where a threshold leaves nothing."""
    w = F.abs("amplitude")
    placed = amplitudes.join(probe, "channel")
    w = w if threshold is None else F.when(w >= threshold, w).otherwise(0.0)
    empty = F.lit(0.0) if threshold is None else F.lit(None).cast("double")
    sums = placed.groupBy(*by).agg(F.sum(w).alias("_w"), F.sum(w * F.col("x")).alias("_x"), F.sum(w * F.col("y")).alias("_y"))
    return sums.select(*by, F.when(F.col("_w") > 0, F.col("_x") / F.col("_w")).otherwise(empty).alias("x"), F.when(F.col("_w") > 0, F.col("_y") / F.col("_w")).otherwise(empty).alias("y"))


def localize(waveforms: DataFrame, probe: DataFrame, by: list[str]) -> DataFrame:
    """Centre of mass of each channel's largest size. ``waveforms``: by, channel, x array."""
    peaks = waveforms.select(*by, "channel", F.array_max(F.transform("x", lambda v: F.abs(v))).alias("amplitude"))
    return centre_of_mass(peaks, probe, by)
