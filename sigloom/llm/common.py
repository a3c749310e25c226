"""Shared pieces of the text operators: durable tables, Arrow batches, byte-level word hashing.

Everything that leaves a task goes through Spark (shuffle, Parquet in the shared folder named by
``spark.checkpoint.dir``); nothing is written to a folder of one machine on a cluster.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Rows and bytes of text that one kernel call sees; batches above are cut, never dropped.
BATCH_ROWS = 2000
BATCH_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the cluster's shared checkpoint folder; where none is set, an error on a cluster and a temporary folder in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="sigloom-")
        shared_folder.own = base
    return f"{base.rstrip('/')}/sigloom-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, every executor can read it."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sigloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what ``durable`` wrote, once nothing reads it any more."""
    path = getattr(df, "_sigloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


class Sent:
    """A broadcast of an object of this package's classes; it travels by value, so executors need no copy of the code."""

    def __init__(self, spark: SparkSession, value):
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self):
        return {"bytes": self.bytes}

    @property
    def value(self):
        if "held" not in self.__dict__:
            self.held = cloudpickle.loads(self.bytes.value)
        return self.held


def with_fields(fields: list[StructField], more: str = "") -> StructType:
    """Fields as they are, whatever their names, and more of them in SQL's words."""
    return StructType([*fields, *(StructType.fromDDL(more) if more else [])])


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def pieces(batch: pa.RecordBatch, column: str | None, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``most`` bytes of ``column`` each (a single longer row stays whole)."""
    if column is None or batch.num_rows == 0:
        yield batch
        return
    array = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(array.type):
        array = array.cast(pa.string())
    offsets = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def tidy() -> None:
    """Gives memory back at a task's end; workers live on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def map_arrow(df: DataFrame, kernel: Callable, schema: str | StructType, column: str | None = None, setup: Callable | None = None) -> DataFrame:
    """``mapInArrow`` over slices of bounded text size. ``kernel(batch[, state])`` returns an iterable of record batches.

    ``setup`` runs once in each task and gives the state.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for part in pieces(batch, column):
                yield from kernel(part, state) if setup else kernel(part)
        del state
        tidy()

    return df.mapInArrow(run, schema)


# Byte-level words ---------------------------------------------------------------------------------

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: One random 64-bit value for each byte, A-Z as a-z.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_FOLD = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; made anew each time, as a table that lives on would cost every worker its size."""
    out = np.full((2, n), 1, np.uint64)
    out[0, 1:], out[1, 1:] = _BASE, _BASE_INV
    np.multiply.accumulate(out, axis=1, out=out)
    return out[0], out[1]


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null has no bytes."""
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if pa.types.is_large_string(array.type):
        array = array.cast(pa.string())
    if array.null_count:
        array = array.fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of a column: their 64-bit hashes (A-Z as a-z), rows, byte starts and byte ends."""
    raw, offsets = text_bytes(array)
    if not len(raw):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    solid = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:-1], out=total[1:])
    h = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(offsets, s, side="right") - 1, s, e


def shingles(h: np.ndarray, row: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all ``width``-word shingles; rows of fewer words give their whole sequence as one."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = n - width + 1
    out, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if m > 0:
        acc = np.zeros(m, np.uint64)
        for k in range(width):
            acc = acc * _FOLD + h[k : k + m]
        whole = row[:m] == row[width - 1 :]
        out, rows = mix(acc[whole]), row[:m][whole]
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    sizes = np.diff(np.r_[heads, n])
    short = np.flatnonzero(sizes < width)
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = sizes[short] > k
            extra[has] = extra[has] * _FOLD + h[heads[short[has]] + k]
        extra = mix(extra ^ (sizes[short].astype(np.uint64) << _U(56)) ^ _FOLD)
        out, rows = np.r_[out, extra], np.r_[rows, row[heads[short]]]
    return out, rows


def distinct_pairs(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, ordered by row, then value."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], rows[keep]
