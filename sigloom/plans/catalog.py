"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import columns as C
from sigloom.operators import spatial, temporal, trains
from sigloom.plans import adapters as A
from sigloom.plans.joins import asof_join, band_join

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

EV, TR, LI, EM = A.SQL_SAMPLES, A.SQL_TRAINS, A.SQL_FRAMES, A.SQL_VECTORS
ORDER = "PARTITION BY channel ORDER BY sample_idx"


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c, alias: str):
    return F.round(c, 6).alias(alias)


IDS = ("channel", "sample_idx")


# Temporal filters ---------------------------------------------------------------------------------


@query(f"SELECT channel, sample_idx, round(sum(value) OVER (PARTITION BY channel ORDER BY sample_idx ROWS 4 PRECEDING) / 5, 6) AS filtered FROM {EV}")
def moving_average(spark, d):
    return temporal.moving_average(A.samples(spark, d), 5).select(*IDS, r6("filtered", "filtered"))


@query(f"SELECT channel, sample_idx, round(0.5 * value + 0.3 * lag(value, 1, 0) OVER ({ORDER}) + 0.2 * lag(value, 2, 0) OVER ({ORDER}) - 0.1 * lag(value, 3, 0) OVER ({ORDER}), 6) AS filtered FROM {EV}")
def fir_taps(spark, d):
    return temporal.fir(A.samples(spark, d), [0.5, 0.3, 0.2, -0.1]).select(*IDS, r6("filtered", "filtered"))


@query(f"SELECT channel, sample_idx, list_sort(list_concat(list(value) OVER (PARTITION BY channel ORDER BY sample_idx ROWS 4 PRECEDING), [0.0 FOR i IN range(greatest(0, 4 - sample_idx))]))[3] AS filtered FROM {EV}")
def median_filter_5(spark, d):
    return temporal.median_filter(A.samples(spark, d), 5).select(*IDS, "filtered")


@query(f"SELECT channel, sample_idx, list_sort(list_concat(list(value) OVER (PARTITION BY channel ORDER BY sample_idx ROWS 3 PRECEDING), [0.0 FOR i IN range(greatest(0, 3 - sample_idx))]))[2] AS filtered FROM {EV}")
def median_filter_4(spark, d):
    return temporal.median_filter(A.samples(spark, d), 4).select(*IDS, "filtered")


_RMS = f"SELECT channel, sample_idx, CASE WHEN sample_idx >= 9 THEN avg(value * value) OVER (PARTITION BY channel ORDER BY sample_idx ROWS 9 PRECEDING) END AS p FROM {EV}"


@query(f"SELECT channel, sample_idx, round(sqrt(p), 6) AS rms FROM ({_RMS})")
def windowed_rms(spark, d):
    return temporal.windowed_power(A.samples(spark, d), 10).select(*IDS, r6("rms", "rms"))


@query(f"SELECT channel, sample_idx, round(p, 6) AS power FROM ({_RMS})")
def windowed_power(spark, d):
    return temporal.windowed_power(A.samples(spark, d), 10).select(*IDS, r6("power", "power"))


@query(ORACLE_SQL["fir_taps"])
def fir_in_blocks(spark, d):
    rows = temporal.in_blocks(A.samples(spark, d), lambda df: temporal.fir(df, [0.5, 0.3, 0.2, -0.1]), 16, 3)
    return rows.select(*IDS, r6("filtered", "filtered"))


@query(ORACLE_SQL["windowed_rms"])
def windowed_rms_in_blocks(spark, d):
    return temporal.in_blocks(A.samples(spark, d), lambda df: temporal.windowed_power(df, 10), 16, 9).select(*IDS, r6("rms", "rms"))


_NEO = f"SELECT channel, sample_idx, value * value - lag(value) OVER ({ORDER}) * lead(value) OVER ({ORDER}) AS e FROM {EV}"


@query(f"SELECT channel, sample_idx, round(e, 6) AS energy FROM ({_NEO}) WHERE e IS NOT NULL")
def neo(spark, d):
    return temporal.neo(A.samples(spark, d)).select(*IDS, r6("energy", "energy"))


@query(f"SELECT channel, sample_idx, round((lag(e, 2, 0) OVER ({ORDER}) + 2 * lag(e, 1, 0) OVER ({ORDER}) + 3 * e + 2 * lead(e, 1, 0) OVER ({ORDER}) + lead(e, 2, 0) OVER ({ORDER})) / 9, 5) AS energy FROM (SELECT * FROM ({_NEO}) WHERE e IS NOT NULL)")
def sneo(spark, d):
    return temporal.sneo(A.samples(spark, d), 2).select(*IDS, F.round("energy", 5).alias("energy"))


@query(f"SELECT channel, sample_idx, sign(value - 40) * greatest(abs(value - 40) - 10, 0) AS filtered FROM {EV}")
def soft_threshold(spark, d):
    return temporal.thresholded(A.samples(spark, d).withColumn("value", F.col("value") - 40), 10).select(*IDS, "filtered")


@query(f"SELECT channel, sample_idx, CASE WHEN abs(value - 40) >= 10 THEN value - 40 ELSE 0 END AS filtered FROM {EV}")
def hard_threshold(spark, d):
    return temporal.thresholded(A.samples(spark, d).withColumn("value", F.col("value") - 40), 10, hard=True).select(*IDS, "filtered")


@query(f"SELECT channel, round(median(abs(value)) / 0.6745 * sqrt(2 * ln(count(*))), 6) AS threshold FROM {EV} GROUP BY channel")
def universal_threshold(spark, d):
    return temporal.universal_thresholds(A.samples(spark, d)).select("channel", r6("threshold", "threshold"))


_AC = f"""WITH RECURSIVE s AS (SELECT * FROM {EV}), f AS (
  SELECT channel, sample_idx, value, value AS y FROM s WHERE sample_idx = 0
  UNION ALL SELECT s.channel, s.sample_idx, s.value, s.value - f.value + 0.995 * f.y FROM s JOIN f ON s.channel = f.channel AND s.sample_idx = f.sample_idx + 1)
SELECT channel, sample_idx, round(y, 6) AS filtered FROM f"""


@query(_AC)
def ac_coupler(spark, d):
    from sigloom.operators import signals

    return signals.ac_couple(A.samples(spark, d), 0.995).select(*IDS, r6("filtered", "filtered"))


# Artifacts and crossings --------------------------------------------------------------------------

_ART = f"SELECT *, abs(value) > 100 AS high, coalesce(abs(value - lag(value) OVER ({ORDER})) > 50, false) AS step FROM {EV}"


@query(f"SELECT channel, sample_idx, high OR step AS artifact FROM ({_ART})")
def artifact_detect(spark, d):
    return temporal.artifacts(A.samples(spark, d)).select(*IDS, "artifact")


@query(f"SELECT channel, sample_idx, CASE WHEN high AND step THEN 'Both' WHEN high THEN 'Amplitude' WHEN step THEN 'Gradient' ELSE 'Clean' END AS kind FROM ({_ART})")
def artifact_detailed(spark, d):
    return temporal.artifacts(A.samples(spark, d)).select(*IDS, "kind")


@query(f"SELECT sample_idx, count(*) FILTER (high OR step) AS n_artifacts, bool_or(high OR step) AS any_artifact FROM ({_ART}) GROUP BY sample_idx")
def artifact_count(spark, d):
    return temporal.artifact_counts(A.samples(spark, d)).select("sample_idx", "n_artifacts", "any_artifact")


_RUN = f"SELECT channel, sample_idx, value, count(*) OVER w AS n, avg(value) OVER w AS m, coalesce(stddev_samp(value) OVER w, 0) AS s FROM {EV} WINDOW w AS ({ORDER} ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT channel, sample_idx, n, round(m, 10) AS mean, round(s, 8) AS std FROM ({_RUN})")
def running_stats(spark, d):
    return temporal.running_stats(A.samples(spark, d)).select(*IDS, "n", F.round("mean", 10).alias("mean"), F.round("std", 8).alias("std"))


@query(f"SELECT channel, sample_idx, round(CASE WHEN n >= 5 AND s > 0 THEN (value - m) / s ELSE 0 END, 6) AS z FROM ({_RUN})")
def running_zscore(spark, d):
    return temporal.zscores(A.samples(spark, d), 3.0, 5).select(*IDS, r6("z", "z"))


@query(f"SELECT channel, sample_idx, abs(CASE WHEN n >= 5 AND s > 0 THEN (value - m) / s ELSE 0 END) > 2 AS artifact FROM ({_RUN})")
def zscore_artifact(spark, d):
    return temporal.zscores(A.samples(spark, d), 2.0, 5).select(*IDS, "artifact")


@query(f"SELECT s.channel, s.sample_idx, abs((value - m) / sd) > 2 AS artifact FROM {EV} s JOIN (SELECT channel, avg(value) AS m, stddev_samp(value) AS sd FROM {EV} WHERE sample_idx < 20 GROUP BY channel) c ON s.channel = c.channel")
def zscore_frozen(spark, d):
    rows = A.samples(spark, d)
    return temporal.frozen_zscores(rows, 2.0, rows.where("sample_idx < 20")).select(*IDS, "artifact")


@query(f"SELECT channel, sample_idx, round(3 * s, 6) AS threshold, n >= 5 AND abs(value) > 3 * s AS over FROM ({_RUN})")
def adaptive_threshold_level(spark, d):
    return temporal.adaptive_candidates(A.samples(spark, d), 3.0, 5).select(*IDS, r6("threshold", "threshold"), "over")


_ZC = f"SELECT *, s * lag(s) OVER ({ORDER}) AS k FROM (SELECT *, CASE WHEN value - 40 > 5 THEN 1 WHEN value - 40 < -5 THEN -1 ELSE 0 END AS s FROM {EV})"


def _centred(spark, d):
    return A.samples(spark, d).withColumn("value", F.col("value") - 40)


@query(f"SELECT channel, sample_idx, coalesce(k < 0, false) AS crossing FROM ({_ZC})")
def zero_crossing(spark, d):
    return temporal.zero_crossings(_centred(spark, d), 5.0).select(*IDS, "crossing")


@query(f"SELECT channel, sample_idx, coalesce(k < 0 AND s > 0, false) AS crossing FROM ({_ZC})")
def zero_crossing_rising(spark, d):
    return temporal.zero_crossings(_centred(spark, d), 5.0, "rising").select(*IDS, "crossing")


@query(f"SELECT channel, sample_idx, coalesce(k < 0 AND s < 0, false) AS crossing FROM ({_ZC})")
def zero_crossing_falling(spark, d):
    return temporal.zero_crossings(_centred(spark, d), 5.0, "falling").select(*IDS, "crossing")


@query(f"SELECT channel, round(count(*) FILTER (k < 0) / count(*), 6) AS zcr FROM ({_ZC}) GROUP BY channel")
def zcr(spark, d):
    return temporal.zero_crossing_rate(_centred(spark, d), 5.0).select("channel", r6("zcr", "zcr"))


_MAD = f"SELECT channel, median(abs(value)) / 0.6745 AS noise FROM {EV} GROUP BY channel"


@query(f"SELECT channel, round(noise, 6) AS noise FROM ({_MAD})")
def mad_noise(spark, d):
    return temporal.mad_noise(A.samples(spark, d)).select("channel", r6("noise", "noise"))


@query(f"SELECT s.channel, sample_idx, value FROM {EV} s JOIN ({_MAD}) n ON s.channel = n.channel WHERE abs(value) > 2 * noise")
def candidates_over_threshold(spark, d):
    rows = A.samples(spark, d)
    return temporal.candidates_over(rows, temporal.mad_noise(rows).withColumn("threshold", F.col("noise") * 2)).select(*IDS, "value")


@query(
    f"WITH s AS (SELECT channel, sample_idx, value - 40 AS value FROM {EV}), b AS (SELECT channel, greatest(median(abs(value)) / 0.6745 * 0.5, 1.0) AS t FROM s GROUP BY channel), "
    f"c AS (SELECT s.channel, t, value < -t AND lag(value) OVER (PARTITION BY s.channel ORDER BY sample_idx) >= -t AS hit FROM s JOIN b ON s.channel = b.channel), "
    "r AS (SELECT channel, any_value(t) AS t, count(*) FILTER (hit) / count(*) * 100 AS rate FROM c GROUP BY channel) "
    "SELECT channel, round(rate, 6) AS rate, round(CASE WHEN rate > 10 THEN t * sqrt(rate / 10) ELSE t END, 6) AS threshold FROM r"
)
def channel_thresholds(spark, d):
    return temporal.channel_thresholds(_centred(spark, d), 0.5, 1.0, 10.0, 100.0).select("channel", r6("rate", "rate"), r6("threshold", "threshold"))


# Resampling ---------------------------------------------------------------------------------------


@query(f"SELECT channel, sample_idx // 4 AS sample_idx, value FROM {EV} WHERE sample_idx % 4 = 0")
def decimate(spark, d):
    return temporal.decimate(A.samples(spark, d), 4).select(*IDS, "value")


def _interpolated(value: str) -> str:
    return f"SELECT channel, sample_idx * 3 + k AS sample_idx, round({value}, 6) AS value FROM (SELECT *, coalesce(lag(value) OVER ({ORDER}), value) AS p FROM {EV}), (SELECT unnest(range(3)) AS k)"


@query(_interpolated("value"))
def interp_zero_order(spark, d):
    return temporal.interpolate(A.samples(spark, d), 3, "zero_order").select(*IDS, r6("value", "value"))


@query(_interpolated("p + k / 3.0::DOUBLE * (value - p)"))
def interp_linear(spark, d):
    return temporal.interpolate(A.samples(spark, d), 3, "linear").select(*IDS, r6("value", "value"))


@query(_interpolated("CASE WHEN k = 0 THEN value ELSE 0 END"))
def zero_insert(spark, d):
    return temporal.interpolate(A.samples(spark, d), 3, "zero_insert").select(*IDS, r6("value", "value"))


@query(f"SELECT channel, sample_idx // 5 AS sample_idx, round(avg(value), 6) AS value FROM {EV} GROUP BY channel, sample_idx // 5 HAVING count(*) = 5")
def multiscale_coarse_grain(spark, d):
    return temporal.multiscale(A.samples(spark, d), 5).select(*IDS, r6("value", "value"))


# Frames -------------------------------------------------------------------------------------------


def _cells(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", *(F.round(F.get("x", F.lit(k)), digits).alias(f"x{k}") for k in range(4)))


def _sql_cells(cell: Callable[[int], str], digits: int = 5, source: str = LI) -> str:
    return f"SELECT l_orderkey, l_linenumber, {', '.join(f'round({cell(k)}, {digits}) AS x{k}' for k in range(4))} FROM {source}"


@query(_sql_cells(lambda k: f"x[{k + 1}] - list_avg(x)"))
def car(spark, d):
    return _cells(spatial.average_reference(A.frames(spark, d)))


@query(_sql_cells(lambda k: f"x[{k + 1}] - list_median(x)"))
def cmr(spark, d):
    return _cells(spatial.median_reference(A.frames(spark, d)))


@query(_sql_cells(lambda k: f"x[{(3, 0, 0, 2)[k] + 1}]"))
def channel_route(spark, d):
    return _cells(spatial.route(A.frames(spark, d), [3, 0, 0, 2]))


@query(_sql_cells(lambda k: f"x[{k + 1}] - " + ("x[2]", "(x[1] + x[3]) / 2", "(x[2] + x[4]) / 2", "x[3]")[k]))
def laplacian_wide(spark, d):
    weights = {0: {1: 1.0}, 1: {0: 0.5, 2: 0.5}, 2: {1: 0.5, 3: 0.5}, 3: {2: 1.0}}
    return _cells(spatial.laplacian_wide(A.frames(spark, d), weights, 4))


@query(f"WITH s AS (SELECT * FROM {EV}), c AS (SELECT max(channel) AS top FROM s) SELECT s.channel, s.sample_idx, round(any_value(s.value) - coalesce(sum(n.value / (CAST(s.channel > 0 AS INT) + CAST(s.channel < top AS INT))), 0), 6) AS value FROM s CROSS JOIN c LEFT JOIN s n ON n.sample_idx = s.sample_idx AND abs(n.channel - s.channel) = 1 GROUP BY s.channel, s.sample_idx")
def laplacian(spark, d):
    rows = A.samples(spark, d)
    near = spatial.linear_neighbors(spark, rows.agg(F.max("channel")).first()[0] + 1)
    return spatial.laplacian(rows, spatial.laplacian_weights(near)).select(*IDS, r6("value", "value"))


@query(f"SELECT channel, sample_idx, round(value - avg(value) OVER (PARTITION BY sample_idx), 6) AS value FROM {EV}")
def car_long(spark, d):
    return spatial.average_reference_long(A.samples(spark, d)).select(*IDS, r6("value", "value"))


@query(f"SELECT channel, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(var_samp(value), 0), 6) AS variance, round(coalesce(stddev_samp(value), 0), 6) AS std FROM {EV} GROUP BY channel")
def online_stats(spark, d):
    v = "value"
    return A.samples(spark, d).groupBy("channel").agg(F.count("*").alias("n"), r6(F.avg(v), "mean"), r6(F.coalesce(F.var_samp(v), F.lit(0.0)), "variance"), r6(F.coalesce(F.stddev_samp(v), F.lit(0.0)), "std"))


_PAIRS = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, covar_samp(x[{i + 1}], x[{j + 1}]) AS c, corr(x[{i + 1}], x[{j + 1}]) AS r, count(*) AS n FROM {LI}" for i in range(4) for j in range(i, 4))


@query(f"SELECT i, j, round(c, 4) AS cov, n FROM ({_PAIRS})")
def online_cov(spark, d):
    return spatial.covariance(A.frames(spark, d)).select("i", "j", F.round("cov", 4).alias("cov"), "n")


@query(f"SELECT i, j, round(r, 6) AS corr FROM ({_PAIRS})")
def correlation(spark, d):
    return spatial.covariance(A.frames(spark, d)).select("i", "j", r6("corr", "corr"))


# Trains -------------------------------------------------------------------------------------------

_GAPS = f"SELECT unit, kind, t, t - lag(t) OVER (PARTITION BY unit, kind ORDER BY t) AS isi FROM {TR}"
UNIT = ["unit", "kind"]
BIN, BURST, REFRACTORY, DURATION = 86400.0, 259200.0, 43200.0, 3e7


@query(f"SELECT unit, kind, CAST(least(floor(isi / {BIN}), 30) AS BIGINT) AS bin, count(*) AS count FROM ({_GAPS}) WHERE isi >= 0 GROUP BY ALL")
def isi_histogram(spark, d):
    return trains.isi_histogram(A.trains(spark, d), UNIT, BIN, 30)


@query(f"SELECT unit, kind, count(*) AS n_spikes, round(avg(isi), 3) AS isi_mean, round(coalesce(stddev_pop(isi) / avg(isi), 0), 6) AS isi_cv FROM ({_GAPS}) GROUP BY ALL")
def isi_cv(spark, d):
    return trains.isi_summary(A.trains(spark, d), UNIT, BIN, BURST, REFRACTORY).select(*UNIT, "n_spikes", F.round("isi_mean", 3).alias("isi_mean"), r6("isi_cv", "isi_cv"))


@query(f"SELECT unit, kind, round(count(*) FILTER (isi < {BURST}) / nullif(count(isi), 0), 6) AS burst_index FROM ({_GAPS}) GROUP BY ALL")
def burst_index(spark, d):
    return trains.isi_summary(A.trains(spark, d), UNIT, BIN, BURST, REFRACTORY).select(*UNIT, r6("burst_index", "burst_index"))


@query(f"SELECT unit, kind, round(count(*) FILTER (isi < {REFRACTORY}) / nullif(count(isi), 0), 6) AS violation_rate FROM ({_GAPS}) GROUP BY ALL")
def isi_violation(spark, d):
    return trains.isi_summary(A.trains(spark, d), UNIT, BIN, BURST, REFRACTORY).select(*UNIT, r6("violation_rate", "violation_rate"))


@query(f"SELECT unit, kind, round(CASE WHEN count(*) >= 2 THEN least(1, sqrt(count(*) FILTER (isi < {REFRACTORY}) * {DURATION} / (2 * {REFRACTORY} * count(*) * count(*)))) END, 6) AS contamination FROM ({_GAPS}) GROUP BY ALL")
def contamination(spark, d):
    return trains.contamination(A.trains(spark, d), UNIT, REFRACTORY, DURATION).select(*UNIT, r6("contamination", "contamination"))


@query(f"SELECT unit, kind, round(CASE WHEN count(isi) >= 2 THEN 3.0::DOUBLE / (count(isi) - 1) * coalesce(sum(CASE WHEN isi + b > 0 THEN ((isi - b) / (isi + b)) ** 2 END), 0) ELSE 0 END, 6) AS lv FROM (SELECT *, lag(isi) OVER (PARTITION BY unit, kind ORDER BY t) AS b FROM ({_GAPS})) GROUP BY ALL")
def local_variation(spark, d):
    return trains.local_variation(A.trains(spark, d), UNIT).select(*UNIT, r6("lv", "lv"))


@query(f"SELECT unit, kind, CAST(arg_max(bin, count * 1000 - bin) AS BIGINT) AS mode_bin FROM (SELECT unit, kind, floor(isi / {BIN}) AS bin, count(*) AS count FROM ({_GAPS}) WHERE isi >= 0 AND isi < 30 * {BIN} GROUP BY ALL) GROUP BY ALL")
def isi_mode_bin(spark, d):
    return trains.mode_bin(trains.isi_histogram(A.trains(spark, d), UNIT, BIN, 30), UNIT, 30)


_ACG = f"SELECT kind, CAST(floor((b.t - a.t) / 600) AS BIGINT) AS bin, count(*) AS count FROM {TR} a JOIN {TR} b USING (kind) WHERE b.t > a.t AND b.t - a.t < 36000 GROUP BY ALL"


@query(_ACG)
def autocorrelogram(spark, d):
    return trains.autocorrelogram(A.trains(spark, d), ["kind"], 600.0, 36000.0)


@query(f"SELECT CAST(floor(abs(b.t - a.t) / 600) AS BIGINT) AS bin, count(*) AS count FROM {TR} a JOIN {TR} b ON a.kind = 'click' AND b.kind = 'view' WHERE a.t <> b.t AND abs(b.t - a.t) < 18000 GROUP BY ALL")
def cross_correlogram(spark, d):
    one = F.lit(1).alias("g")
    pick = lambda k: A.trains(spark, d).where(F.col("kind") == k).select(one, "t")
    return trains.correlogram(pick("click"), pick("view"), ["g"], 600.0, 18000.0, True).select("bin", "count")


@query(f"SELECT kind, CASE WHEN sum(CASE WHEN bin BETWEEN 5 AND 9 THEN count ELSE 0 END) > 0 THEN sum(CASE WHEN bin < 5 THEN count ELSE 0 END) < 0.5 * sum(CASE WHEN bin BETWEEN 5 AND 9 THEN count ELSE 0 END) ELSE false END AS dip FROM ({_ACG}) GROUP BY kind")
def refractory_dip(spark, d):
    return trains.refractory_dip(trains.autocorrelogram(A.trains(spark, d), ["kind"], 600.0, 36000.0), ["kind"], 5)


# Joins in time ------------------------------------------------------------------------------------


def _two(spark, d):
    rows = A.trains(spark, d)
    a = rows.where("kind = 'error'").select("unit", F.col("event_id").alias("a_id"), F.col("t").alias("ta"))
    return a, rows.where("kind = 'click'").select("unit", F.col("event_id").alias("b_id"), F.col("t").alias("tb"))


_A, _B = f"(SELECT unit, event_id AS a_id, t AS ta FROM {TR} WHERE kind = 'error')", f"(SELECT unit, event_id AS b_id, t AS tb FROM {TR} WHERE kind = 'click')"


@query(f"SELECT a.unit, a_id, b_id FROM {_A} a JOIN {_B} b ON a.unit = b.unit AND tb BETWEEN ta - 86400 AND ta + 172800")
def event_band_join(spark, d):
    return band_join(*_two(spark, d), ["unit"], "ta", "tb", 86400, 172800).select("unit", "a_id", "b_id")


@query(f"SELECT unit, a_id FROM {_A} a WHERE NOT EXISTS (SELECT 1 FROM {_B} b WHERE a.unit = b.unit AND tb BETWEEN ta - 86400 AND ta + 172800)")
def event_anti_join(spark, d):
    return band_join(*_two(spark, d), ["unit"], "ta", "tb", 86400, 172800, "left_anti").select("unit", "a_id")


@query(f"SELECT unit, a_id FROM {_A} a WHERE EXISTS (SELECT 1 FROM {_B} b WHERE a.unit = b.unit AND tb BETWEEN ta - 86400 AND ta + 172800)")
def event_semi_join(spark, d):
    return band_join(*_two(spark, d), ["unit"], "ta", "tb", 86400, 172800, "left_semi").select("unit", "a_id")


@query(f"SELECT a.unit, a_id, b_id FROM {_A} a ASOF LEFT JOIN {_B} b ON a.unit = b.unit AND a.ta >= b.tb")
def asof_offset(spark, d):
    return asof_join(*_two(spark, d), ["unit"], "ta", "tb", ["b_id"]).select("unit", "a_id", "b_id")


_SPIKES = f"(SELECT channel, sample_idx AS sample FROM {EV} WHERE value > 150)"


def _spikes(spark, d):
    rows = A.samples(spark, d)
    return rows, rows.where("value > 150").select("recording_id", "channel", F.col("sample_idx").alias("sample"))


@query(f"SELECT p.channel, p.sample, round(list_sum(w), 6) AS total, round(w[1], 6) AS first FROM (SELECT p.channel, p.sample, list(s.value ORDER BY s.sample_idx) AS w FROM {_SPIKES} p JOIN {EV} s ON s.channel = p.channel AND s.sample_idx BETWEEN p.sample - 3 AND p.sample + 8 GROUP BY ALL HAVING count(*) = 12) p")
def waveform_extract(spark, d):
    x = trains.snippets(*_spikes(spark, d), 3, 12)
    return x.select("channel", "sample", r6(C.total("x"), "total"), r6(F.get("x", F.lit(0)), "first"))


@query(f"SELECT channel, sample, arg_min(i, (v, CAST(i <> sample AS INT), i)) AS peak, min(v) AS trough FROM (SELECT p.channel, p.sample, s.sample_idx AS i, s.value AS v FROM {_SPIKES} p JOIN {EV} s ON s.channel = p.channel AND s.sample_idx BETWEEN p.sample - 5 AND p.sample + 5) GROUP BY channel, sample")
def peak_align(spark, d):
    return trains.aligned(*_spikes(spark, d), 5).select("channel", "sample", "peak", "trough")


# Clusters and templates ---------------------------------------------------------------------------

_POINTS = f"SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM {EM}"
_MEANS = f"(SELECT label, list(m ORDER BY i) AS mean, max(n) AS members FROM (SELECT label, i, avg(v) AS m, count(*) AS n FROM ({_POINTS}) GROUP BY label, i) GROUP BY label)"


@query(f"SELECT label, members, round(list_sum(mean), 6) AS total, round(mean[1], 6) AS first FROM {_MEANS}")
def cluster_means(spark, d):
    return trains.cluster_means(A.vectors(spark, d)).select("label", "members", r6(C.total("mean"), "total"), r6(F.get("mean", F.lit(0)), "first"))


@query(f"SELECT label, round((list_max(mean) - list_min(mean)) / 0.2, 6) AS snr FROM {_MEANS}")
def waveform_snr(spark, d):
    return trains.waveform_snr(trains.cluster_means(A.vectors(spark, d)), 0.1).select("label", r6("snr", "snr"))


@query(f"WITH s AS (SELECT label, avg(x[1]) AS m, var_samp(x[1]) AS s2 FROM {EM} GROUP BY label) SELECT a.label AS a, b.label AS b, round(abs(a.m - b.m) / sqrt((a.s2 + b.s2) / 2), 6) AS d_prime FROM s a JOIN s b ON a.label < b.label")
def d_prime(spark, d):
    return trains.d_prime(A.vectors(spark, d).withColumn("v", F.get("x", F.lit(0))), "label", "v").select("a", "b", r6("d_prime", "d_prime"))


_NEAR = f"SELECT e.vec_id, m.label AS template_id, list_sum([(p[1] - p[2]) ** 2 FOR p IN list_zip(e.x, m.mean)]) AS d2, list_cosine_similarity(e.x, m.mean) AS c FROM {EM} e, {_MEANS} m"


@query(f"SELECT vec_id, arg_min(template_id, d2) AS template_id, round(min(d2), 6) AS distance_sq FROM ({_NEAR}) GROUP BY vec_id")
def template_l2(spark, d):
    rows = A.vectors(spark, d)
    return trains.nearest_template(rows, trains.cluster_means(rows).withColumnRenamed("label", "template_id"), "vec_id").select("vec_id", "template_id", r6("distance_sq", "distance_sq"))


@query(f"SELECT vec_id, arg_max(template_id, c) AS template_id, round(max(c), 6) AS ncc FROM ({_NEAR}) GROUP BY vec_id")
def template_ncc(spark, d):
    rows = A.vectors(spark, d)
    return trains.best_correlation(rows, trains.cluster_means(rows).withColumnRenamed("label", "template_id"), "vec_id").select("vec_id", "template_id", r6("ncc", "ncc"))


@query(f"SELECT vec_id, CASE WHEN max(c) >= 0.3 THEN arg_max(template_id, c) END AS template_id FROM ({_NEAR}) GROUP BY vec_id")
def ncc_classifier(spark, d):
    rows = A.vectors(spark, d)
    return trains.best_correlation(rows, trains.cluster_means(rows).withColumnRenamed("label", "template_id"), "vec_id", least=0.3).select("vec_id", "template_id")


