"""Tables and folders that all machines of a cluster can read, in the folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str = "table") -> str:
    """A fresh path there; where the session names none, a temporary one in local mode and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(base or tempfile.mkdtemp(prefix='sigloom-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of its own: what iterative fits read in every round, and what a lost executor is made good from."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sigloom_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def removed(df: DataFrame) -> None:
    """Takes away what ``written`` wrote, once nothing reads it any more."""
    path = getattr(df, "_sigloom_path", None)
    if path:
        remove(df.sparkSession, path)
