"""Entropy, phase coupling, epochs and lagged sums as joins and aggregates."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from sigloom.functions.columns import log_of

#: Samples of a run whose cells the entropies' joins are keyed by: each trebles one side and thins the pairs.
CELLS = 2


def phase_bins(df: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """(keys, bin, centre, amplitude): the mean amplitude over each phase bin of [-pi, pi), 0 where a bin is empty."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("phase") + math.pi) / (2 * math.pi) * bins))).cast("int")
    own = df.groupBy(*keys, at.alias("bin")).agg(F.avg("amp").alias("amplitude"))
    grid = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(own, [*keys, "bin"], "left").select(*keys, "bin", ((F.col("bin") + 0.5) * (2 * math.pi / bins) - math.pi).alias("centre"), F.coalesce("amplitude", F.lit(0.0)).alias("amplitude"))


def modulation_index(df: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Divergence of the amplitude over phase bins from uniform, over ln(bins), within [0, 1]."""
    shares = phase_bins(df, keys, bins).withColumn("_sum", F.sum("amplitude").over(Window.partitionBy(*keys)))
    p = F.col("amplitude") / F.col("_sum")
    term = F.when(F.col("_sum") > 1e-12, p * F.ln(F.greatest(p, F.lit(1e-12)) * bins)).otherwise(0.0)
    return shares.groupBy(*keys).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(term) / math.log(bins))).alias("mi"))


def mean_vector_length(df: DataFrame, keys: list[str]) -> DataFrame:
    c, s, m = F.avg(F.col("amp") * F.cos("phase")), F.avg(F.col("amp") * F.sin("phase")), F.avg("amp")
    return df.groupBy(*keys).agg(F.when(m > 1e-12, F.least(F.lit(1.0), F.sqrt(c * c + s * s) / m)).otherwise(0.0).alias("mvl"))


def phase_locking(df: DataFrame, keys: list[str], a: str = "phase_a", b: str = "phase_b") -> DataFrame:
    gap = F.col(a) - F.col(b)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(F.cos(gap)) ** 2 + F.avg(F.sin(gap)) ** 2).alias("plv"))


def spectral_entropy(df: DataFrame, keys: list[str], power: str = "power", normalize: bool = True) -> DataFrame:
    """-sum(p ln p) of (keys, power) rows, over the logarithm of their number; 0 without power."""
    w = Window.partitionBy(*keys)
    p = F.col(power) / F.col("_sum")
    h = F.sum(F.when((F.col("_sum") > 0) & (p > 0), -p * F.ln(p)).otherwise(0.0))
    out = F.when(F.count("*") > 1, h / F.ln(F.count("*").cast("double"))).otherwise(0.0) if normalize else h
    return df.withColumn("_sum", F.sum(power).over(w)).groupBy(*keys).agg(out.alias("entropy"))


def _templates(df: DataFrame, keys: list[str], length: int, order: str, value: str, drop_last: int) -> DataFrame:
    """(keys, i, w0, w1, ...): runs of ``length`` samples from each start on, without the last ``drop_last`` starts of the series."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.count("*").over(Window.partitionBy(*keys))
    runs = df.select(*keys, F.col(order).alias("i"), n.alias("_n"), F.row_number().over(w).alias("_k"), *((F.lead(value, k).over(w) if k else F.col(value)).alias(f"w{k}") for k in range(length)))
    return runs.where(F.col("_k") <= F.col("_n") - drop_last).drop("_n", "_k")


def _pairs(starts: DataFrame, keys: list[str], m: int, r: float) -> DataFrame:
    """Pairs of distinct runs of one series whose first ``m`` samples differ by less than ``r`` each, with their numbers.

    Equal runs are counted first. The join is an equality on (keys, cells of ``r`` of the first samples, three at most), with plain
    comparisons behind it, so that it meets near runs only, splits, and compiles. Both sides grow with the input, so neither is
    broadcast, however small it is once compressed.
    """
    names = [c for c in starts.columns if c not in keys]
    counted = starts.groupBy(*keys, *names).agg(F.count("*").alias("c"))
    width = float(r) if r > 0 else 1.0
    cells = [F.floor(F.col(f"w{k}") / width).cast("long") for k in range(min(m, CELLS))]
    left, right = counted, counted.select(*keys, *(F.col(n).alias(f"_{n}") for n in [*names, "c"]))
    for k, cell in enumerate(cells):
        left = left.withColumn(f"_b{k}", F.explode(F.array(cell - 1, cell, cell + 1)))
        right = right.withColumn(f"_b{k}", F.floor(F.col(f"_w{k}") / width).cast("long"))
    near = [F.abs(F.col(f"w{k}") - F.col(f"_w{k}")) < r for k in range(m)]
    return left.join(right.hint("merge"), [*keys, *(f"_b{k}" for k in range(len(cells)))]).where(reduce(Column.__and__, near))


def sample_entropy(df: DataFrame, keys: list[str], m: int, r: float, order: str = "sample_idx", value: str = "value") -> DataFrame:
    """-ln(A / B) of a series by one self-join of near starts; infinite without matches."""
    starts = _templates(df, keys, m + 1, order, value, m).drop("i")
    same = reduce(Column.__and__, [F.col(f"w{k}") == F.col(f"_w{k}") for k in range(m + 1)])
    pairs = F.col("c") * F.when(same, F.col("_c") - 1).otherwise(F.col("_c"))  # in both orders
    longer = F.when(F.abs(F.col(f"w{m}") - F.col(f"_w{m}")) < r, pairs).otherwise(0)
    close = _pairs(starts, keys, m, r).groupBy(*keys).agg((F.sum(pairs) / 2).alias("b"), (F.sum(longer) / 2).alias("a"))
    both = df.select(*keys).distinct().join(close.hint("merge"), keys, "left")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return both.select(*keys, F.when((a == 0) | (b == 0), F.lit(float("inf"))).otherwise(-F.ln(a / b)).alias("sampen"))


def approximate_entropy(df: DataFrame, keys: list[str], m: int, r: float, order: str = "sample_idx", value: str = "value") -> DataFrame:
    """phi(m) - phi(m + 1) with self matches, at least 0."""

    def phi(k: int, name: str) -> DataFrame:
        starts = _templates(df, keys, k, order, value, k - 1).drop("i")
        runs = [f"w{j}" for j in range(k)]
        share = _pairs(starts, keys, k, r).groupBy(*keys, *runs, "c").agg(F.sum("_c").alias("close"))
        sizes = df.groupBy(*keys).agg((F.count("*") - (k - 1)).alias("n"))
        return share.join(sizes.hint("merge"), keys).groupBy(*keys).agg((F.sum(F.col("c") * F.ln(F.col("close") / F.col("n"))) / F.first("n")).alias(name))

    return phi(m, "p").join(phi(m + 1, "q").hint("merge"), keys).select(*keys, F.greatest(F.lit(0.0), F.col("p") - F.col("q")).alias("apen"))


def lagged_sums(df: DataFrame, other: DataFrame, keys: list[str], norm: str = "none") -> DataFrame:
    """(keys, lag, r): cross-correlation of arrays ``x`` and ``y``, sum of x[n] y[n + lag], lag from -(size(y) - 1) to size(x) - 1.

    One row of a pair goes through one kernel (products for short arrays, transforms for long ones).
    """
    pairs = df.select(*keys, F.col("x").cast("array<double>").alias("_x")).join(other.select(*keys, F.col("y").cast("array<double>").alias("_y")), keys)
    fields = [pairs.schema[k] for k in keys]

    def run(batches):
        for batch in batches:
            at, lags, values = [], [np.zeros(0, np.int64)], [np.zeros(0)]
            for row, (a, b) in enumerate(zip(batch.column(len(keys)), batch.column(len(keys) + 1))):
                if not a.is_valid or not b.is_valid or not len(a) or not len(b):
                    continue
                x, y = a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False)
                lag, r = correlated(x, y, norm)
                at.append(np.full(len(lag), row))
                lags.append(lag)
                values.append(r)
            where = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(where) for k in range(len(keys))), pa.array(np.concatenate(lags)), pa.array(np.concatenate(values))], names=[*keys, "lag", "r"])

    return pairs.mapInArrow(run, StructType([*fields, StructField("lag", LongType()), StructField("r", DoubleType())]))


def correlated(x: np.ndarray, y: np.ndarray, norm: str = "none") -> tuple[np.ndarray, np.ndarray]:
    """Lags and sums of x[n] y[n + lag], lags within both sizes."""
    n, m = len(x), len(y)
    if min(n, m) <= 512:
        r = np.correlate(y, x, "full")
    else:
        size = 1 << (n + m - 2).bit_length()
        r = np.fft.irfft(np.fft.rfft(y, size) * np.fft.rfft(x[::-1], size), size)[: n + m - 1]
    lag = np.arange(-(n - 1), m)
    keep = (lag > -m) & (lag < n)
    lag, r = lag[keep], r[keep]
    if norm == "biased":
        r = r / max(n, m)
    elif norm == "unbiased":
        r = r / (np.minimum(n, m - lag) - np.maximum(0, -lag))
    elif norm == "coeff":
        energy = float(np.sqrt((x @ x) * (y @ y)))
        r = r / energy if energy > 1e-20 else np.zeros(len(r))
    return lag, r


def peak_lag(correlation: DataFrame, keys: list[str]) -> DataFrame:
    """The largest value and its lag, the first of equals."""
    return correlation.groupBy(*keys).agg(F.max_by("lag", F.struct("r", -F.col("lag"))).alias("lag"), F.max("r").alias("r"))


# Epochs -------------------------------------------------------------------------------------------


def epoch_average(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("average"), F.count("*").alias("epochs"))


def baseline_normalized(df: DataFrame, keys: list[str], frame: str, power: str, start: int, end: int, mode: str) -> DataFrame:
    """Power against the mean (and population deviation) of baseline frames [start, end): db, zscore, percentage or logratio.

    Null where the baseline has no mean or no spread to divide by; the logarithm of no power is -infinity, of less it is null.
    """
    base = df.where((F.col(frame) >= start) & (F.col(frame) < end)).groupBy(*keys).agg(F.avg(power).alias("_m"), F.stddev_pop(power).alias("_s"))
    v, m, s = F.col(power), F.col("_m"), F.col("_s")
    ratio = F.when((m > 0) & (v >= 0), log_of(v / m, "10"))
    out = {"db": 10 * ratio, "zscore": F.when(s > 0, (v - m) / s), "percentage": F.when(m != 0, (v - m) / m * 100), "logratio": ratio}[mode]
    return df.join(base, keys).withColumn("normalized", out).drop("_m", "_s")


def log_variance(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """ln(population variance + 1e-10), the feature of spatially filtered trials."""
    return df.groupBy(*keys).agg(F.ln(F.var_pop(value) + 1e-10).alias("feature"))
