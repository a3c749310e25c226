"""Clock offsets, drift of clocks and of probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.plans.joins import asof_join


def ntp_offsets(df: DataFrame) -> DataFrame:
    """From t1..t4: offset, round trip and quality (1 / round trip, infinite without any)."""
    trip = (F.col("t4") - F.col("t1")) - (F.col("t3") - F.col("t2"))
    out = df.withColumn("offset", ((F.col("t2") - F.col("t1")) + (F.col("t3") - F.col("t4"))) / 2).withColumn("rtt", trip)
    return out.withColumn("quality", F.when(F.col("rtt") > 0, 1 / F.col("rtt")).otherwise(F.lit(float("inf"))))


def sample_times(df: DataFrame, start: float, fs: float) -> DataFrame:
    """``time`` of a sample index."""
    return df.withColumn("time", F.lit(start) + F.col("sample_idx") / fs)


def sample_of(df: DataFrame, start: float, fs: float, time: str = "time") -> DataFrame:
    """The fractional sample of a time, and its floor."""
    return df.withColumn("sample_exact", (F.col(time) - start) * fs).withColumn("sample", F.floor("sample_exact"))


def linear_drift(df: DataFrame, keys: list[str], time: str, offset: str, order: list[str]) -> DataFrame:
    """(keys, slope, intercept, n): regression of offsets on time over all points but the first.

    Time and offset are centred at the first point; with fewer than two points, or without spread, the slope is 0.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = df.withColumn("_t0", F.first(time).over(first)).withColumn("_o0", F.first(offset).over(first)).withColumn("_n", F.row_number().over(w))
    at = at.withColumn("_t", F.when(F.col("_n") > 1, F.col(time) - F.col("_t0"))).withColumn("_o", F.when(F.col("_n") > 1, F.col(offset) - F.col("_o0")))
    spread, slope = F.var_pop("_t"), F.regr_slope("_o", "_t")
    fit = at.groupBy(*keys).agg(F.count("*").alias("n"), F.first("_t0").alias("_t0"), F.first("_o0").alias("_o0"), F.avg("_t").alias("_mt"), F.avg("_o").alias("_mo"), F.coalesce(F.when(spread > 1e-12, slope), F.lit(0.0)).alias("slope"))
    inner = F.coalesce(F.col("_mo") - F.col("slope") * F.col("_mt"), F.lit(0.0))
    return fit.select(*keys, "slope", (F.col("_o0") + inner - F.col("slope") * F.col("_t0")).alias("intercept"), "n")


def corrected(df: DataFrame, fit: DataFrame, keys: list[str], time: str = "t", out: str = "corrected") -> DataFrame:
    """time + intercept + slope * time."""
    return df.join(fit.select(*keys, "slope", "intercept"), keys).withColumn(out, F.col(time) + F.col("intercept") + F.col("slope") * F.col(time)).drop("slope", "intercept")


def offset_buffer(df: DataFrame, keys: list[str], last: int, order: list[str]) -> DataFrame:
    """Of the last offsets: that of the least round trip, the latest, and the (upper) median."""
    newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    held = df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last)
    ranked = F.array_sort(F.collect_list("offset"))
    return held.groupBy(*keys).agg(F.min_by("offset", F.struct("rtt", -F.col("_n"))).alias("best"), F.min_by("offset", "_n").alias("latest"), F.get(ranked, F.floor(F.size(ranked) / 2).cast("int")).alias("median"))


def latest_offset(df: DataFrame, offsets: DataFrame, keys: list[str], time: str, at: str) -> DataFrame:
    """Each row with the offset that was known at its time."""
    return asof_join(df, offsets, keys, time, at, ["offset"])


def rigid_drift(df: DataFrame, keys: list[str], bin_samples: int) -> DataFrame:
    """(keys, slope, intercept, bins): regression of the bins' mean positions on their centres; null below two bins."""
    bins = df.groupBy(*keys, F.floor(F.col("sample") / bin_samples).alias("bin")).agg(F.avg("y").alias("y")).withColumn("centre", (F.col("bin") + 0.5) * bin_samples)
    return bins.groupBy(*keys).agg(F.when(F.count("*") > 1, F.regr_slope("y", "centre")).alias("slope"), F.when(F.count("*") > 1, F.regr_intercept("y", "centre")).alias("intercept"), F.count("*").alias("bins"))


def nonrigid_drift(df: DataFrame, y_min: float, y_max: float, depth_bins: int, bin_samples: int) -> DataFrame:
    """(depth_bin, depth, slope): a regression for each depth bin; 0 where a bin has fewer than two time bins."""
    width = (y_max - y_min) / depth_bins
    placed = df.withColumn("depth_bin", F.greatest(F.lit(0), F.least(F.lit(depth_bins - 1), F.floor((F.col("y") - y_min) / width))))
    fit = rigid_drift(placed, ["depth_bin"], bin_samples)
    return fit.select("depth_bin", (F.lit(y_min) + (F.col("depth_bin") + 0.5) * width).alias("depth"), F.coalesce("slope", F.lit(0.0)).alias("slope"))


def drift_at(df: DataFrame, fit: DataFrame) -> DataFrame:
    """``drift`` of (sample, y): slopes interpolated between depth bins, constant beyond the outer ones.

    The bins, a row for each, come as one array by a scalar subquery.
    """
    bins = fit.agg(F.array_sort(F.collect_list(F.struct("depth", "slope")))).scalar()
    y = F.col("y")
    low = F.element_at(F.filter("_bins", lambda b: b["depth"] <= y), -1)
    high = F.get(F.filter("_bins", lambda b: b["depth"] > y), F.lit(0))
    told = df.withColumn("_bins", bins).withColumn("_low", F.when(F.exists("_bins", lambda b: b["depth"] <= y), low)).withColumn("_high", high)
    part = (y - F.col("_low.depth")) / (F.col("_high.depth") - F.col("_low.depth"))
    slope = F.when(F.col("_low").isNull(), F.col("_high.slope")).when(F.col("_high").isNull(), F.col("_low.slope")).otherwise(F.col("_low.slope") + part * (F.col("_high.slope") - F.col("_low.slope")))
    return told.withColumn("drift", slope * F.col("sample")).where("drift is not null").drop("_bins", "_low", "_high")
