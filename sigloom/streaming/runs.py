"""Stream operators over tables: what has come so far is appended to a table, and each time the stream goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from sigloom.sources import shared

#: What ``transformWithState`` needs; put back after the run.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_arrivals(arrivals: Iterable[DataFrame], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that a stream operator puts out for tables of one schema that arrive one after another.

    Each arrival is appended to a folder that all machines share, and a run with an ``availableNow`` trigger takes what is new from
    there: state, watermark and offsets come from the checkpoint of the run before, as after a restart. The result is a table; input and
    checkpoint are taken away.
    """
    spark = base = out = None
    for rows in arrivals:
        if spark is None:
            spark = rows.sparkSession
            base = shared.folder(spark, "stream")
        rows.write.mode("append").parquet(f"{base}/in")
        out = operator(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        before = spark.conf.get(PROVIDER)
        spark.conf.set(PROVIDER, ROCKS)
        try:
            query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            spark.conf.set(PROVIDER, before)
    if spark is None:
        raise ValueError("nothing arrived")
    shared.remove(spark, f"{base}/in")
    shared.remove(spark, f"{base}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{base}/out")
