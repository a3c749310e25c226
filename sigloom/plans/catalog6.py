"""Sixth part of the catalogue: streams over the tables, in arrivals, held against the SQL of the whole table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


from sigloom.plans import adapters as A
from sigloom.plans.catalog import EM, EV, ORACLE_SQL, query, r6
from sigloom.plans.catalog2 import _DOWN, _LOW, _UP, scan
from sigloom.plans.catalog4 import _sql_windows, _windows
from sigloom.sources import shared
from sigloom.streaming import processors as P
from sigloom.streaming.runs import in_arrivals

IDS = ("channel", "sample_idx")


def _rows(spark, d, parts: int, delayed: str | None = None):
    """Samples of the events by arrival: parts of equal time; rows that ``delayed`` holds for come with the last part."""
    rows = A.samples(spark, d).withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1_000_000).cast("long")))  # exact: half a microsecond is more than rounding can lose
    span = rows.agg(F.struct(F.min("t").alias("low"), F.max("t").alias("high"))).scalar()
    part = F.floor(parts * (F.col("t") - span["low"]) / (span["high"] - span["low"] + 1)).cast("int")
    arrival = F.when(F.expr(delayed), F.lit(parts - 1)).otherwise(part) if delayed else part
    return shared.written(rows.select("recording_id", F.col("channel").cast("long").alias("channel"), "sample_idx", "ts", F.col("value"), arrival.alias("arrival")))


def _arrivals(rows, parts: int, ends: bool = True):
    """The rows of each arrival, in no order; with the last, a row without a value for each channel, which ends it."""
    for k in range(parts):
        now = rows.where(F.col("arrival") == k).drop("arrival")
        if ends and k == parts - 1:
            last = rows.groupBy("recording_id", "channel").agg((F.max("sample_idx") + 1).alias("sample_idx"), F.max("ts").alias("ts"))
            now = now.unionByName(last.withColumn("value", F.lit(None).cast("double")))
        yield now


def _whole(spark, d, step: P.Step):
    """A step over two arrivals, of which the first lacks every 13th row; the watermark waits for all."""
    rows = _rows(spark, d, 2, "event_id % 13 = 5")
    return in_arrivals(_arrivals(rows, 2), lambda s: P.online(s, step, "1000 days"))


@query(ORACLE_SQL["iir_lowpass"])
def stream_lowpass(spark, d):
    return _whole(spark, d, P.Cascade(_LOW)).select(*IDS, r6("y", "filtered"))


@query(ORACLE_SQL["envelope_follower"])
def stream_envelope(spark, d):
    return _whole(spark, d, P.Envelope(_UP, _DOWN)).select(*IDS, r6("y", "envelope"))


@query(ORACLE_SQL["p_square"])
def stream_percentile(spark, d):
    return _whole(spark, d, P.Percentile(0.9)).select(*IDS, r6(F.nullif("y", F.lit(float("nan"))), "percentile"))


@query("SELECT channel, sample_idx AS sample FROM (" + ORACLE_SQL["threshold_detector"].replace("sample_idx AS sample, value AS amplitude", "sample_idx") + ")")
def stream_threshold(spark, d):
    return _whole(spark, d, P.Threshold(80.0, 3)).where("y > 0").select("channel", F.col("sample_idx").alias("sample"))


_SHAPE = [10.0, 60.0, 30.0]
_NORM = repr(float(np.linalg.norm(_SHAPE)))


@query(
    "SELECT channel, sample_idx AS sample, round(z, 6) AS z FROM ("
    + scan({"a": "0.0::DOUBLE", "b": "0.0::DOUBLE", "m": "0::BIGINT", "w": "0::BIGINT"}, [("z", f"(10.0 * a + 60.0 * b + 30.0 * value) / {_NORM}"), ("hit", "w <= 0 AND m >= 2 AND z > 90")], {"a": "b", "b": "value", "m": "m + 1", "w": "CASE WHEN w > 0 THEN w - 1 WHEN hit THEN 3 ELSE 0 END"}, "z, hit")
    + ") WHERE hit"
)
def stream_matched(spark, d):
    return _whole(spark, d, P.Matched(_SHAPE, 90.0, 3)).where("y > 0").select("channel", F.col("sample_idx").alias("sample"), r6("y", "z"))


# Late rows ----------------------------------------------------------------------------------------------

_DELAYED = "event_id % 13 = 5 AND sample_idx % 3 = 1"
#: Arrivals; watermarks behind each of them; what had been released before each of them.
_LATE = f"""
WITH s AS MATERIALIZED (SELECT channel, sample_idx, value, t, CASE WHEN {_DELAYED} THEN 2 ELSE CAST(floor(3 * (t - low) / (high - low + 1)) AS INT) END AS arrival
  FROM {EV} e, (SELECT min(t) AS low, max(t) AS high FROM {EV})),
w AS MATERIALIZED (SELECT a AS arrival, floor((SELECT max(t) FROM s WHERE arrival <= a) * 1000) - 3600000 AS mark FROM (SELECT unnest([0, 1]) AS a)),
r AS MATERIALIZED (SELECT w.arrival + 1 AS arrival, s.channel, max(s.sample_idx) AS last FROM s JOIN w ON s.arrival <= w.arrival AND floor(s.t * 1000) < w.mark GROUP BY ALL)
"""


@query(
    _LATE + ", z AS (SELECT s.*, coalesce(s.sample_idx < r.last, false) AS late FROM s LEFT JOIN r ON r.arrival = s.arrival AND r.channel = s.channel) "
    "SELECT channel, count(*) FILTER (NOT late) AS released, CASE WHEN bool_or(NOT late AND (arrival = 2 OR floor(t * 1000) >= (SELECT mark FROM w WHERE arrival = 1))) THEN count(*) FILTER (late) ELSE 0 END AS late, round(sum(abs(value)) FILTER (NOT late), 4) AS total FROM z GROUP BY channel HAVING count(*) FILTER (NOT late) > 0"
)
def stream_late_rows(spark, d):
    """Rows that come an arrival or two late, behind what the watermark has released, are dropped and counted."""
    rows = _rows(spark, d, 3, _DELAYED)
    got = in_arrivals(_arrivals(rows, 3), lambda s: P.online(s, P.Rms(1), "1 hour"))
    return got.groupBy("channel").agg(F.count("*").alias("released"), F.max("late").alias("late"), F.round(F.sum("y"), 4).alias("total"))


# Names, windows and sessions ------------------------------------------------------------------------------

_NAMES = [[0.0, 0.0], [0.1, 0.1], [-0.1, 0.1]]


@query(
    "SELECT recording_id, sample, CAST(CASE WHEN far > 0.15 THEN -1 ELSE k END AS INT) AS template_id, round(far, 6) AS distance, row_number() OVER w AS seen, CAST(sum(CASE WHEN far > 0.15 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS rejected "
    f"FROM (SELECT *, list_min(f) AS far, list_position(f, list_min(f)) - 1 AS k FROM (SELECT vec_id % 7 AS recording_id, vec_id // 7 AS sample, vec_id // 7 % 2 AS arrival, [list_distance(x[1:2], t) FOR t IN {_NAMES}::DOUBLE[][]] AS f FROM {EM})) "
    "WINDOW w AS (PARTITION BY recording_id ORDER BY arrival, sample ROWS UNBOUNDED PRECEDING)"
)
def stream_names(spark, d):
    """The online sorter: spikes named by the nearest template, or by none, with counts that go on from arrival to arrival."""
    rows = A.vectors(spark, d).select((F.col("vec_id") % 7).alias("recording_id"), F.floor(F.col("vec_id") / 7).alias("sample"), F.slice("x", 1, 2).alias("x"))
    arrivals = (rows.where(F.col("sample") % 2 == k) for k in range(2))
    got = in_arrivals(arrivals, lambda s: P.classified(s, np.array(_NAMES), 0.15))
    return got.select("recording_id", "sample", "template_id", r6("distance", "distance"), "seen", "rejected")


_CLOSED = "(SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events)"


@query(f"SELECT * FROM ({_sql_windows('[hour]')}) WHERE (start + 3600) * 1000 <= {_CLOSED}")
def stream_windows(spark, d):
    """Windows that the watermark has closed."""
    rows = _rows(spark, d, 3)
    return _windows(in_arrivals(_arrivals(rows, 3, False), lambda s: P.windowed(s, "1 hour", "1 hour")))


@query(f"SELECT * FROM ({ORACLE_SQL['session_windows']}) WHERE stop // 1000 <= {_CLOSED}")
def stream_sessions(spark, d):
    rows = _rows(spark, d, 3)
    got = in_arrivals(_arrivals(rows, 3, False), lambda s: P.bursts(s, "6 hours", "1 hour"))
    return got.select("channel", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("stop"), "n")
