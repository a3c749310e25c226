"""The flagship query: artifact-free windowed RMS of every channel, in one exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators import temporal
from sigloom.plans import adapters as A
from sigloom.plans.catalog import ORDER, query

_MARKED = f"SELECT *, abs(value) > 150 OR coalesce(abs(value - lag(value) OVER ({ORDER})) > 120, false) AS artifact FROM {A.SQL_SAMPLES}"
_CLEAN = f"SELECT channel, row_number() OVER ({ORDER}) - 1 AS sample_idx, value FROM ({_MARKED}) WHERE NOT artifact"


@query(f"SELECT channel, count(*) AS n_windows, round(avg(rms), 6) AS mean_rms, round(max(rms), 6) AS max_rms FROM (SELECT channel, sample_idx, sqrt(avg(value * value) OVER (PARTITION BY channel ORDER BY sample_idx ROWS 9 PRECEDING)) AS rms FROM ({_CLEAN})) WHERE sample_idx >= 9 GROUP BY channel")
def clean_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = temporal.artifacts(A.samples(spark, sf_dir), amplitude=150.0, gradient=120.0).where(~F.col("artifact"))
    clean = marked.withColumn("sample_idx", (F.row_number().over(temporal.in_order()) - 1).cast("long"))
    windows = temporal.windowed_power(clean, 10).where("rms is not null")
    return windows.groupBy("channel").agg(F.count("*").alias("n_windows"), F.round(F.avg("rms"), 6).alias("mean_rms"), F.round(F.max("rms"), 6).alias("max_rms"))
