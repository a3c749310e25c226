"""The driver's tables as canonical tables: samples, frames, vectors and event trains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Channels of a line item frame.
ITEM_CHANNELS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts"):
    """Seconds since the epoch of a timestamp without zone (session zone UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples_long of events: a channel for each user, samples in order of time and id."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", (F.row_number().over(order) - 1).cast("long").alias("sample_idx"))
    return rows.select(F.lit(0).cast("long").alias("recording_id"), F.col("user_id").alias("channel"), "sample_idx", "value", "event_id", "event_type", seconds().alias("t"))


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event trains: a unit for each event type of a user, times in seconds."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("kind"), "event_id", seconds().alias("t"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of line items: four channels in an array."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.array(*(F.col(c) for c in ITEM_CHANNELS)).alias("x"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as waveforms of doubles with a cluster label."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


#: The same as views of DuckDB.
SQL_SAMPLES = "(SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx, value, event_id, event_type, epoch_us(ts) / 1e6 AS t FROM events)"
SQL_TRAINS = "(SELECT user_id AS unit, event_type AS kind, event_id, epoch_us(ts) / 1e6 AS t FROM events)"
SQL_FRAMES = "(SELECT l_orderkey, l_linenumber, l_returnflag, [l_quantity, l_extendedprice, l_discount, l_tax] AS x FROM lineitem)"
SQL_VECTORS = "(SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
