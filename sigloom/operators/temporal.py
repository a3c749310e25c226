"""Filters, energies, artifacts and running statistics on the sample axis, as window expressions.

All take long samples (``recording_id, channel, sample_idx, value``) and keep their columns; order is ``sample_idx`` within
``KEYS``. One exchange on the keys serves any chain of these operators.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sigloom.functions.columns import hard_threshold, soft_threshold, universal_threshold
from sigloom.functions.kernels import median_index

KEYS = ("recording_id", "channel")


def in_order(order: str = "sample_idx") -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy(order)


def so_far(order: str = "sample_idx") -> WindowSpec:
    return in_order(order).rowsBetween(Window.unboundedPreceding, 0)


def fir(df: DataFrame, taps: list[float], out: str = "filtered") -> DataFrame:
    """Sum of taps[k] * value[n - k], zeros before the first sample."""
    w = in_order()
    return df.withColumn(out, reduce(Column.__add__, [F.lit(float(h)) * (F.lag("value", k, 0.0).over(w) if k else F.col("value")) for k, h in enumerate(taps)]))


def moving_average(df: DataFrame, taps: int, out: str = "filtered") -> DataFrame:
    """The last ``taps`` samples over ``taps``, with zeros before the first."""
    return df.withColumn(out, F.sum("value").over(in_order().rowsBetween(1 - taps, 0)) / taps)


def median_filter(df: DataFrame, width: int, out: str = "filtered") -> DataFrame:
    held = F.collect_list("value").over(in_order().rowsBetween(1 - width, 0))
    padded = F.concat(held, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(held)))
    return df.withColumn(out, F.element_at(F.array_sort(padded), median_index(width) + 1))


def windowed_power(df: DataFrame, width: int, power: str = "power", rms: str = "rms") -> DataFrame:
    """Mean square and its root over the last ``width`` samples, null before as many were seen."""
    w = in_order().rowsBetween(1 - width, 0)
    mean = F.when(F.count("value").over(w) >= width, F.avg(F.col("value") * F.col("value")).over(w))
    return df.withColumn(power, mean).withColumn(rms, F.sqrt(power))


def neo(df: DataFrame, out: str = "energy") -> DataFrame:
    """value^2 - previous * next, of all samples but the first and the last of a channel."""
    w = in_order()
    return df.withColumn(out, F.col("value") * F.col("value") - F.lag("value").over(w) * F.lead("value").over(w)).where(F.col(out).isNotNull())


def sneo(df: DataFrame, half: int, out: str = "energy") -> DataFrame:
    """NEO under a triangular window, over the weight of the whole window at the edges too."""
    w = in_order()
    parts = [F.lit(float(half + 1 - abs(k))) * (F.col("_neo") if k == 0 else F.lag("_neo", k, 0.0).over(w) if k > 0 else F.lead("_neo", -k, 0.0).over(w)) for k in range(-half, half + 1)]
    return neo(df, "_neo").withColumn(out, reduce(Column.__add__, parts) / float((half + 1) ** 2)).drop("_neo")


def sneo_threshold(amplitude: float) -> float:
    return amplitude / 2**0.5


def thresholded(df: DataFrame, limit: float, hard: bool = False, out: str = "filtered") -> DataFrame:
    return df.withColumn(out, (hard_threshold if hard else soft_threshold)(F.col("value"), limit))


def universal_thresholds(df: DataFrame, out: str = "threshold") -> DataFrame:
    """sigma * sqrt(2 ln n) of each channel, sigma from the median absolute value."""
    stats = mad_noise(df, "sigma").join(df.groupBy(*KEYS).agg(F.count("*").alias("n")), list(KEYS))
    return stats.withColumn(out, universal_threshold(F.col("sigma"), F.col("n")))


# Artifacts and crossings --------------------------------------------------------------------------


def artifacts(df: DataFrame, amplitude: float = 100.0, gradient: float = 50.0) -> DataFrame:
    """``artifact`` boolean and ``kind``: Clean, Amplitude, Gradient or Both; the first sample has no gradient."""
    high = F.abs("value") > amplitude
    step = F.coalesce(F.abs(F.col("value") - F.lag("value").over(in_order())) > gradient, F.lit(False))
    return df.withColumn("_step", step).select(*df.columns, (high | F.col("_step")).alias("artifact"), F.when(high & F.col("_step"), "Both").when(high, "Amplitude").when(F.col("_step"), "Gradient").otherwise("Clean").alias("kind"))


def artifact_counts(df: DataFrame, amplitude: float = 100.0, gradient: float = 50.0) -> DataFrame:
    """For each sample index, how many channels have an artifact, and whether any has."""
    found = artifacts(df, amplitude, gradient)
    return found.groupBy("recording_id", "sample_idx").agg(F.count_if("artifact").alias("n_artifacts"), F.bool_or("artifact").alias("any_artifact"))


def running_stats(df: DataFrame) -> DataFrame:
    """Count, mean and sample deviation (0 below two samples) up to each sample, itself included."""
    w = so_far()
    return df.withColumn("n", F.count("value").over(w)).withColumn("mean", F.avg("value").over(w)).withColumn("std", F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0)))


def zscores(df: DataFrame, threshold: float, min_samples: int) -> DataFrame:
    """``z`` (0 where nothing varies or too few samples were seen) and ``artifact``."""
    seen = running_stats(df)
    z = F.when((F.col("n") >= min_samples) & (F.col("std") > 0), (F.col("value") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return seen.withColumn("z", z).withColumn("artifact", F.abs("z") > threshold)


def frozen_zscores(df: DataFrame, threshold: float, calibration: DataFrame) -> DataFrame:
    """Z-scores by the statistics of a calibration table, one row a channel."""
    stats = calibration.groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    z = F.when(F.col("std") > 0, (F.col("value") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return df.join(stats, list(KEYS)).withColumn("z", z).withColumn("artifact", F.abs("z") > threshold)


def adaptive_candidates(df: DataFrame, multiplier: float, min_samples: int) -> DataFrame:
    """``threshold`` = multiplier * running deviation, and ``over``; silent until enough samples were seen."""
    seen = running_stats(df).withColumn("threshold", F.col("std") * multiplier)
    return seen.withColumn("over", (F.col("n") >= min_samples) & (F.abs("value") > F.col("threshold")))


def zero_crossings(df: DataFrame, threshold: float = 0.0, direction: str = "any") -> DataFrame:
    """``crossing``: the sign differs from that of the sample before, both outside the dead zone."""
    sign = F.when(F.col("value") > threshold, 1).when(F.col("value") < -threshold, -1).otherwise(0)
    marked = df.withColumn("_s", sign).withColumn("_p", F.lag("_s").over(in_order()))
    crosses = F.col("_s") * F.col("_p") < 0
    wanted = {"any": F.lit(True), "rising": F.col("_s") > 0, "falling": F.col("_s") < 0}[direction]
    return marked.withColumn("crossing", F.coalesce(crosses & wanted, F.lit(False))).drop("_s", "_p")


def zero_crossing_rate(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Crossings over the number of samples."""
    return zero_crossings(df, threshold).groupBy(*KEYS).agg((F.count_if("crossing") / F.count("*")).alias("zcr"))


# Noise and thresholds -----------------------------------------------------------------------------


def mad_noise(df: DataFrame, out: str = "noise") -> DataFrame:
    """Median of |value| over 0.6745, not centred."""
    return df.groupBy(*KEYS).agg((F.percentile(F.abs("value"), F.lit(0.5)) / 0.6745).alias(out))


def channel_thresholds(df: DataFrame, multiplier: float, floor: float, max_rate: float, fs: float) -> DataFrame:
    """max(multiplier * noise, floor) of each channel, raised by sqrt(rate / max_rate) where it is crossed downwards too often."""
    base = mad_noise(df).withColumn("threshold", F.greatest(F.col("noise") * multiplier, F.lit(floor)))
    w = in_order()
    crossed = df.join(base, list(KEYS)).withColumn("_p", F.lag("value").over(w))
    counted = crossed.groupBy(*KEYS).agg(F.first("noise").alias("noise"), F.first("threshold").alias("threshold"), (F.count_if((F.col("value") < -F.col("threshold")) & (F.col("_p") >= -F.col("threshold"))) / F.count("*") * fs).alias("rate"))
    return counted.withColumn("threshold", F.when(F.col("rate") > max_rate, F.col("threshold") * F.sqrt(F.col("rate") / max_rate)).otherwise(F.col("threshold")))


def candidates_over(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Samples whose size exceeds their channel's threshold."""
    return df.join(thresholds.select(*KEYS, "threshold"), list(KEYS)).where(F.abs("value") > F.col("threshold"))


# Resampling ---------------------------------------------------------------------------------------


def decimate(df: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th sample from the first on, without any filter."""
    return df.where(F.col("sample_idx") % factor == 0).withColumn("sample_idx", (F.col("sample_idx") / factor).cast("long"))


def interpolate(df: DataFrame, factor: int, method: str = "linear") -> DataFrame:
    """``factor`` samples for each: repeated (zero_order), followed by zeros (zero_insert), or linear with one sample delay."""
    w = in_order()
    step = F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("_k")
    before = F.coalesce(F.lag("value").over(w), F.col("value"))
    wide = df.withColumn("_before", before).select("*", step)
    value = {"zero_order": F.col("value"), "zero_insert": F.when(F.col("_k") == 0, F.col("value")).otherwise(0.0), "linear": F.col("_before") + F.col("_k") / float(factor) * (F.col("value") - F.col("_before"))}[method]
    return wide.withColumn("value", value).withColumn("sample_idx", F.col("sample_idx") * factor + F.col("_k")).select(*df.columns)


def multiscale(df: DataFrame, scale: int) -> DataFrame:
    """Means of non-overlapping runs of ``scale`` samples; an incomplete last run is left out."""
    runs = df.withColumn("sample_idx", F.floor(F.col("sample_idx") / scale)).groupBy(*KEYS, "sample_idx").agg(F.avg("value").alias("value"), F.count("*").alias("_n"))
    return runs.where(F.col("_n") == scale).drop("_n")


# Long channels ------------------------------------------------------------------------------------


def in_blocks(df: DataFrame, operator: Callable[[DataFrame], DataFrame], block: int, before: int, after: int = 0) -> DataFrame:
    """An operator of finite reach over channels too long for one task.

    Every block of ``block`` samples gets copies of the ``before`` samples ahead of it and the ``after`` samples behind it,
    is worked on apart, and gives its own samples only. Exact for operators that look no further (FIR, medians, windowed
    power, energies, gradients, crossings); the copies add (before + after) / block to the data.
    """
    i = F.col("sample_idx")
    at = lambda c: F.floor(c / block).cast("long")
    needed = F.explode(F.sequence(F.greatest(at(i - after), F.lit(0).cast("long")), at(i + before)))
    own = df.withColumn("_block", needed).withColumn("recording_id", F.struct(F.col("recording_id").alias("id"), F.col("_block").alias("block"))).drop("_block")
    out = operator(own).where(at(i) == F.col("recording_id.block"))
    return out.withColumn("recording_id", F.col("recording_id.id"))
