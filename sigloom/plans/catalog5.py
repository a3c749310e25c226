"""Fifth part of the catalogue: recordings written as files and read back by the data sources."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigloom.plans import adapters as A
from sigloom.plans.catalog import EM, EV, query, r6
from sigloom.sources import files, parts, shared, writers

#: Users of a recording, and the range of a signal.
USERS, RANGE = 10, (0.0, 1024.0)


def _read(spark, kind: str, folder: str, **options):
    files.register(spark)
    rows = spark.read.format(kind).options(**options).load(folder)
    return rows.withColumn("recording", F.regexp_extract("recording", r"([0-9]+)\.[a-z]+$", 1).cast("long"))


def _series(rows: pa.Table) -> dict[int, pa.Table]:
    """The rows of each channel in order."""
    rows = rows.sort_by([("channel", "ascending"), ("sample_idx", "ascending")])
    channel = rows["channel"].to_numpy()
    cuts = np.flatnonzero(np.r_[True, np.diff(channel) != 0, True])
    return {int(channel[a]): rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:])}


def _recordings(spark, d):
    return A.samples(spark, d).withColumn("rec", F.floor(F.col("channel") / USERS).cast("long"))


def _edf(rows: pa.Table) -> bytes:
    series = _series(rows)
    signals = [files.EdfSignal(f"user {k}", "none", "uV", *RANGE, -32768, 32767, "none", t.num_rows) for k, t in series.items()]
    return writers.edf(signals, [t["value"].to_numpy() for t in series.values()], patient="events")


def _edf_folder(spark, d) -> str:
    folder = shared.folder(spark, "recordings")
    writers.write(_recordings(spark, d).select("rec", "channel", "sample_idx", "value"), "rec", folder, _edf, ".edf")
    return folder


_PLACES = f"(SELECT channel, channel // {USERS} AS recording, count(*) AS n, CAST(row_number() OVER (PARTITION BY channel // {USERS} ORDER BY channel) - 1 AS INT) AS place FROM {EV} GROUP BY channel)"


@query(f"SELECT recording, place AS channel, sample_idx, round((greatest(-32768, least(32767, floor(value * (65535 / 1024.0::DOUBLE) - 32768 + 0.5))) + 32768) * (1024.0::DOUBLE / 65535), 6) AS value FROM {EV} e JOIN {_PLACES} p ON p.channel = e.channel")
def edf_samples(spark, d):
    return _read(spark, "edf", _edf_folder(spark, d)).select("recording", "channel", "sample_idx", r6("value", "value"))


@query(f"SELECT recording, place AS channel, 'user ' || channel AS label, 'uV' AS unit, 0.0::DOUBLE AS phys_min, 1024.0::DOUBLE AS phys_max, -32768 AS dig_min, 32767 AS dig_max, CAST(n AS INT) AS samples_per_record FROM {_PLACES}")
def edf_signals(spark, d):
    return _read(spark, "edf", _edf_folder(spark, d), table="signals")


@query(f"SELECT recording, 'events' AS patient, 1 AS records, 1.0::DOUBLE AS duration, CAST(count(*) AS INT) AS signals, false AS plus FROM {_PLACES} GROUP BY recording")
def edf_headers(spark, d):
    return _read(spark, "edf", _edf_folder(spark, d), table="header").select("recording", "patient", "records", "duration", "signals", "plus")


def _xdf(rows: pa.Table) -> bytes:
    streams = []
    for k, t in _series(rows).items():
        times, values = t["t"].to_pylist(), t["value"].to_pylist()
        streams.append({"id": k, "name": f"user {k}", "type": "EEG", "rate": 100.0, "format": "double64", "times": [v if i % 2 == 0 else None for i, v in enumerate(times)], "values": [[v, -v] for v in values], "offsets": [(times[0], k / 8)]})
        streams.append({"id": k + 1_000_000, "name": f"marks {k}", "type": "Markers", "rate": 0.0, "format": "string", "times": times, "values": [[v] for v in t["event_type"].to_pylist()]})
    return writers.xdf(streams)


def _xdf_table(spark, d, table: str):
    folder = shared.folder(spark, "recordings")
    writers.write(_recordings(spark, d).select("rec", "channel", "sample_idx", "t", "value", "event_type"), "rec", folder, _xdf, ".xdf")
    return _read(spark, "xdf", folder, table=table)


@query(f"SELECT channel // {USERS} AS recording, channel AS stream_id, sample_idx, CASE WHEN sample_idx % 2 = 0 THEN t END AS ts_sec, value AS first, -value AS second FROM {EV}")
def xdf_samples(spark, d):
    rows = _xdf_table(spark, d, "samples")
    return rows.select("recording", "stream_id", "sample_idx", "ts_sec", F.get("x", F.lit(0)).alias("first"), F.get("x", F.lit(1)).alias("second"))


@query(f"SELECT channel // {USERS} AS recording, channel + 1000000 AS stream_id, sample_idx, t AS ts_sec, event_type AS mark FROM {EV}")
def xdf_strings(spark, d):
    return _xdf_table(spark, d, "strings").select("recording", "stream_id", "sample_idx", "ts_sec", F.get("s", F.lit(0)).alias("mark"))


@query(
    f"WITH c AS (SELECT DISTINCT channel FROM {EV}) SELECT channel // {USERS} AS recording, channel AS stream_id, 'user ' || channel AS name, 'EEG' AS type, 2 AS channel_count, 100.0::DOUBLE AS nominal_srate, 'double64' AS channel_format FROM c "
    f"UNION ALL SELECT channel // {USERS}, channel + 1000000, 'marks ' || channel, 'Markers', 1, 0.0::DOUBLE, 'string' FROM c"
)
def xdf_streams(spark, d):
    return _xdf_table(spark, d, "streams")


@query(f"SELECT channel // {USERS} AS recording, channel AS stream_id, min(t) AS collection_time, channel / 8.0::DOUBLE AS \"offset\" FROM {EV} GROUP BY channel")
def xdf_offsets(spark, d):
    return _xdf_table(spark, d, "clock_offsets")


def _kept_as(spark, kind: str, rows, **options) -> str:
    """The folder that many tasks wrote rows (recording, at, x) to."""
    folder = shared.folder(spark, "recordings")
    files.register(spark)
    parts.ordered(rows).write.format(kind).options(**options).mode("append").save(folder)
    return folder


@query(f"SELECT label AS recording, CAST(unnest(range(64)) AS INT) AS channel, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sample_idx, unnest(x) AS value FROM {EM}")
def mda_samples(spark, d):
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = A.vectors(spark, d).select(F.col("label").cast("string").alias("recording"), (F.row_number().over(order) - 1).cast("long").alias("at"), "x")
    return _read(spark, "mda", _kept_as(spark, "mda", rows)).select("recording", "channel", "sample_idx", "value")


@query(f"SELECT 7::BIGINT AS recording, 0::INT AS channel, vec_id * 64 + i AS sample_idx, round((greatest(-32768, least(32767, floor((v + 4) * (65535 / 8.0::DOUBLE) - 32768 + 0.5))) + 32768) * (8.0::DOUBLE / 65535) - 4, 6) AS value FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(x) AS v FROM {EM})")
def edf_records_of_many_tasks(spark, d):
    """One recording, a record for each vector, written by all tasks and read back."""
    rows = A.vectors(spark, d).select(F.lit("7").alias("recording"), F.col("vec_id").alias("at"), "x")
    folder = _kept_as(spark, "edf", rows, samples=64, phys_min=-4.0, phys_max=4.0, part_bytes=1 << 20)
    return _read(spark, "edf", folder).select("recording", "channel", "sample_idx", r6("value", "value"))
