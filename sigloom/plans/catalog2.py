"""Second part of the catalogue: arrays and spectra, coupling, clocks, epochs, probes, and kernels that SQL cannot express."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigloom.functions import columns as C
from sigloom.functions import design, spectrum
from sigloom.operators import clocks, coupling, signals, spatial, temporal, trains
from sigloom.plans import adapters as A
from sigloom.plans.catalog import EM, EV, IDS, query, r6

# Arrays and spectra -------------------------------------------------------------------------------

_N = "(SELECT unnest(range(64)) AS i)"
_AT = "2 * pi() * i / 63"
_WINDOWS = {
    "rectangular": "1.0::DOUBLE",
    "hann": f"0.5 - 0.5 * cos({_AT})",
    "hamming": f"0.54 - 0.46 * cos({_AT})",
    "blackman": f"0.42 - 0.5 * cos({_AT}) + 0.08 * cos(2 * {_AT})",
    "blackman_harris": f"0.35875 - 0.48829 * cos({_AT}) + 0.14128 * cos(2 * {_AT}) - 0.01168 * cos(3 * {_AT})",
}
_ALL_WINDOWS = " UNION ALL ".join(f"SELECT '{k}' AS kind, i, greatest({w}, 0) AS w FROM {_N}" for k, w in _WINDOWS.items())


def _window_rows(spark):
    at = spark.range(64).select(F.col("id").alias("i"))
    parts = [at.select(F.lit(k).alias("kind"), "i", C.window_coefficient(k, F.col("i"), 64).alias("w")) for k in _WINDOWS]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).unionAll(parts[4])


@query(f"SELECT kind, i, round(w, 9) AS w FROM ({_ALL_WINDOWS})")
def window_coeffs(spark, d):
    return _window_rows(spark).select("kind", "i", F.round("w", 9).alias("w"))


@query(f"SELECT kind, round(avg(w), 9) AS gain, round(64 * sum(w * w) / (sum(w) * sum(w)), 9) AS enbw FROM ({_ALL_WINDOWS}) GROUP BY kind")
def window_gains(spark, d):
    w = F.col("w")
    return _window_rows(spark).groupBy("kind").agg(F.round(F.avg(w), 9).alias("gain"), F.round(64 * F.sum(w * w) / (F.sum(w) * F.sum(w)), 9).alias("enbw"))


_POINTS = f"SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM {EM}"


@query(f"SELECT vec_id, round(sum(v * ({_WINDOWS['hann']})), 9) AS total FROM ({_POINTS}) GROUP BY vec_id")
def apply_window(spark, d):
    return A.vectors(spark, d).select("vec_id", F.round(C.total(C.apply_window(F.col("x"), "hann")), 9).alias("total"))


_DFT = f"SELECT vec_id, k, (sum(v * cos(2 * pi() * k * i / 64)) ** 2 + sum(v * sin(2 * pi() * k * i / 64)) ** 2) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM ({_POINTS}), (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k"


def _power(spark, d):
    return signals.power_spectrum(A.vectors(spark, d).select("vec_id", "x"))


@query(f"SELECT vec_id, k AS bin, round(p, 6) AS power FROM ({_DFT})")
def dft_power_64(spark, d):
    return _power(spark, d).select("vec_id", F.posexplode("power").alias("bin", "p")).select("vec_id", "bin", r6("p", "power"))


@query(f"SELECT vec_id, round(sum(p), 6) AS power FROM ({_DFT}) WHERE k BETWEEN 8 AND 16 GROUP BY vec_id")
def band_power_64(spark, d):
    # bins floor(8 / df) to floor(16.5 / df), df = 1 Hz
    return _power(spark, d).select("vec_id", r6(C.total(F.slice("power", 9, 9)), "power"))


@query(f"SELECT vec_id, round(-sum(CASE WHEN p > 0 THEN p / s * ln(p / s) ELSE 0 END) / ln(33), 6) AS entropy FROM (SELECT *, sum(p) OVER (PARTITION BY vec_id) AS s FROM ({_DFT})) GROUP BY vec_id")
def spectral_entropy_64(spark, d):
    rows = _power(spark, d).select("vec_id", F.explode("power").alias("power"))
    return coupling.spectral_entropy(rows, ["vec_id"]).select("vec_id", r6("entropy", "entropy"))


@query(f"SELECT vec_id, round(max(abs(v)), 6) AS largest, round(sum(v), 6) AS total FROM ({_POINTS}) GROUP BY vec_id")
def fft_round_trip(spark, d):
    back = signals.inverse_of_forward(A.vectors(spark, d).select("vec_id", "x"))
    return back.select("vec_id", r6(F.array_max(F.transform("y", lambda v: F.abs(v))), "largest"), r6(C.total("y"), "total"))


_W2 = "(SELECT list(0.5 - 0.5 * cos(2 * pi() * i / 63) ORDER BY i) AS w, sum((0.5 - 0.5 * cos(2 * pi() * i / 63)) ** 2) AS s2 FROM " + _N + ")"
_PSD = f"SELECT vec_id, k, (sum(v * w[i + 1] * cos(2 * pi() * k * i / 64)) ** 2 + sum(v * w[i + 1] * sin(2 * pi() * k * i / 64)) ** 2) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / (64 * any_value(s2)) AS p FROM ({_POINTS}), {_W2}, (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k"


@query(f"SELECT vec_id, round(sum((p + q) / 2), 9) AS alpha FROM (SELECT *, lead(p) OVER (PARTITION BY vec_id ORDER BY k) AS q FROM ({_PSD})) WHERE k BETWEEN 8 AND 11 GROUP BY vec_id")
def multi_band_power(spark, d):
    rows = signals.band_powers(A.vectors(spark, d).select("vec_id", "x"), 64.0, {"alpha": spectrum.BANDS["alpha"]})
    return rows.select("vec_id", F.round(F.get("powers", F.lit(0)), 9).alias("alpha"))


_FRAMES = f"(SELECT channel, f AS frame, sample_idx - f * 8 AS i, value AS v FROM {EV}, (SELECT unnest(range(64)) AS f) WHERE sample_idx >= f * 8 AND sample_idx < f * 8 + 16)"
_STFT = f"SELECT channel, frame, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 15)) * cos(2 * pi() * k * i / 16)) AS re, -sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 15)) * sin(2 * pi() * k * i / 16)) AS im FROM {_FRAMES}, (SELECT unnest(range(16)) AS k) GROUP BY channel, frame, k HAVING count(*) = 16"
_S2 = repr(float((spectrum.window("hann", 16) ** 2).sum()))


@query(f"SELECT channel, k AS bin, round(avg((re * re + im * im) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / (100 * {_S2})), 6) AS psd FROM ({_STFT}) WHERE k <= 8 GROUP BY channel, k")
def welch_psd(spark, d):
    return signals.welch(A.samples(spark, d), 100.0, 16).select("channel", "bin", r6("psd", "psd"))


@query(f"SELECT channel, frame, round(sum(re * re + im * im), 4) AS power FROM ({_STFT}) GROUP BY channel, frame")
def stft_power(spark, d):
    return signals.stft(A.samples(spark, d), 16).select("channel", "frame", F.round(C.total("power"), 4).alias("power"))


@query(f"SELECT frame, k AS bin, round(avg(re * re + im * im), 4) AS power FROM ({_STFT}) WHERE k <= 8 GROUP BY frame, k")
def ersp_power(spark, d):
    return signals.event_spectral_power(A.samples(spark, d), 16, 8).select("frame", "bin", F.round("power", 4).alias("power"))


_PAIRS = f"(SELECT a.vec_id, a.x, b.x AS y FROM {EM} a JOIN {EM} b ON b.vec_id = a.vec_id + 1)"
_XC = f"SELECT vec_id, (j - i) AS lag, sum(xv * yv) AS r, count(*) AS c FROM (SELECT vec_id, unnest(x) AS xv, generate_subscripts(x, 1) AS i, y FROM {_PAIRS}) JOIN (SELECT vec_id, unnest(y) AS yv, generate_subscripts(y, 1) AS j FROM {_PAIRS}) USING (vec_id) GROUP BY ALL"


def _neighbours(spark, d):
    rows = A.vectors(spark, d)
    return rows.select("vec_id", "x"), rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))


@query(f"SELECT vec_id, lag, round(r, 6) AS r FROM ({_XC})")
def xcorr_lags(spark, d):
    return coupling.lagged_sums(*_neighbours(spark, d), ["vec_id"]).select("vec_id", "lag", r6("r", "r"))


@query(f"SELECT vec_id, lag, round(r / c, 6) AS r FROM ({_XC})")
def xcorr_unbiased(spark, d):
    return coupling.lagged_sums(*_neighbours(spark, d), ["vec_id"], "unbiased").select("vec_id", "lag", r6("r", "r"))


@query(f"SELECT vec_id, CAST(arg_max(lag, r) AS BIGINT) AS lag, round(max(r), 6) AS r FROM ({_XC}) GROUP BY vec_id")
def xcorr_peak(spark, d):
    return coupling.peak_lag(coupling.lagged_sums(*_neighbours(spark, d), ["vec_id"]), ["vec_id"]).select("vec_id", F.col("lag").cast("long").alias("lag"), r6("r", "r"))


@query(f"WITH p AS ({_POINTS}) SELECT a.vec_id, b.i - a.i AS lag, round(sum(a.v * b.v) / any_value(e), 6) AS r FROM p a JOIN p b ON a.vec_id = b.vec_id JOIN (SELECT vec_id, sum(v * v) AS e FROM p GROUP BY vec_id) e ON e.vec_id = a.vec_id GROUP BY a.vec_id, b.i - a.i")
def autocorr_lags(spark, d):
    rows = A.vectors(spark, d)
    return coupling.lagged_sums(rows.select("vec_id", "x"), rows.select("vec_id", F.col("x").alias("y")), ["vec_id"], "coeff").select("vec_id", "lag", r6("r", "r"))


@query("SELECT k AS bin, k * 100.0::DOUBLE / 16 AS frequency, CAST(least(round(k * 100.0::DOUBLE / 16 * 16 / 100), 15) AS BIGINT) AS back FROM (SELECT unnest(range(16)) AS k)")
def stft_bins(spark, d):
    f = F.col("id") * 100.0 / 16
    return spark.range(16).select(F.col("id").alias("bin"), f.alias("frequency"), F.least(C.round_away(f * 16 / 100), F.lit(15)).cast("long").alias("back"))


@query("SELECT k AS scale_idx, round(6 / (2 * pi() * 5) * pow(5.0::DOUBLE / 40, k / 7.0::DOUBLE), 9) AS scale, round(6 / (2 * pi() * (6 / (2 * pi() * 5) * pow(5.0::DOUBLE / 40, k / 7.0::DOUBLE))), 6) AS frequency FROM (SELECT unnest(range(8)) AS k)")
def wavelet_scales(spark, d):
    s = 6 / (2 * math.pi * 5) * F.pow(F.lit(5.0 / 40), F.col("id") / 7.0)
    return spark.range(8).select(F.col("id").alias("scale_idx"), F.round(s, 9).alias("scale"), r6(6 / (2 * math.pi * s), "frequency"))


# Phase and coupling -------------------------------------------------------------------------------

_PH = f"(SELECT channel, 2 * pi() * ((t / 86400) - floor(t / 86400)) - pi() AS phase, value AS amp FROM {EV})"
_BINS = f"(SELECT c.channel, g.bin, coalesce(avg(p.amp), 0) AS a FROM (SELECT DISTINCT channel FROM {EV}) c CROSS JOIN (SELECT unnest(range(18)) AS bin) g LEFT JOIN {_PH} p ON p.channel = c.channel AND greatest(0, least(17, floor((p.phase + pi()) / (2 * pi()) * 18))) = g.bin GROUP BY c.channel, g.bin)"


def _phases(spark, d):
    day = F.col("t") / 86400
    return A.samples(spark, d).select("channel", (2 * math.pi * (day - F.floor(day)) - math.pi).alias("phase"), F.col("value").alias("amp"))


@query(f"SELECT channel, CAST(bin AS INT) AS bin, round((bin + 0.5) * 2 * pi() / 18 - pi(), 6) AS centre, round(a, 6) AS amplitude FROM {_BINS}")
def phase_amp_dist(spark, d):
    return coupling.phase_bins(_phases(spark, d), ["channel"], 18).select("channel", "bin", r6("centre", "centre"), r6("amplitude", "amplitude"))


@query(f"SELECT channel, round(least(1, greatest(0, sum(CASE WHEN s > 1e-12 THEN a / s * ln(greatest(a / s, 1e-12) * 18) ELSE 0 END) / ln(18))), 6) AS mi FROM (SELECT *, sum(a) OVER (PARTITION BY channel) AS s FROM {_BINS}) GROUP BY channel")
def mod_index(spark, d):
    return coupling.modulation_index(_phases(spark, d), ["channel"], 18).select("channel", r6("mi", "mi"))


@query(f"SELECT channel, round(least(1, sqrt(avg(amp * cos(phase)) ** 2 + avg(amp * sin(phase)) ** 2) / avg(amp)), 6) AS mvl FROM {_PH} GROUP BY channel")
def mvl(spark, d):
    return coupling.mean_vector_length(_phases(spark, d), ["channel"]).select("channel", r6("mvl", "mvl"))


@query(f"SELECT channel, round(sqrt(avg(cos(phase - amp)) ** 2 + avg(sin(phase - amp)) ** 2), 6) AS plv FROM {_PH} GROUP BY channel")
def plv(spark, d):
    return coupling.phase_locking(_phases(spark, d), ["channel"], "phase", "amp").select("channel", r6("plv", "plv"))


def _starts(m: int, drop: int) -> str:
    w = ", ".join(f"lead(value, {k}) OVER (PARTITION BY channel ORDER BY sample_idx) AS v{k}" for k in range(m))
    return f"(SELECT * FROM (SELECT channel, sample_idx AS i, count(*) OVER (PARTITION BY channel) AS n, {w} FROM {EV}) WHERE i < n - {drop})"


def _near(m: int, r: float) -> str:
    return " AND ".join(f"abs(a.v{k} - b.v{k}) < {r}" for k in range(m))


@query(
    f"WITH s AS {_starts(3, 2)}, c AS (SELECT DISTINCT channel FROM {EV}), x AS (SELECT a.channel, count(*) AS b, count(*) FILTER ({_near(3, 15)}) AS a FROM s a JOIN s b ON a.channel = b.channel AND a.i < b.i WHERE {_near(2, 15)} GROUP BY a.channel) "
    "SELECT c.channel, round(CASE WHEN coalesce(a, 0) = 0 OR coalesce(b, 0) = 0 THEN 'inf'::DOUBLE ELSE -ln(a / b) END, 6) AS sampen FROM c LEFT JOIN x ON c.channel = x.channel"
)
def sample_entropy(spark, d):
    return coupling.sample_entropy(A.samples(spark, d), ["channel"], 2, 15.0).select("channel", r6("sampen", "sampen"))


def _phi(m: int) -> str:
    s = _starts(m, m - 1)
    return f"(SELECT channel, avg(ln(c / n)) AS p FROM (SELECT a.channel, a.i, count(*) AS c, any_value(t.n) AS n FROM {s} a JOIN {s} b ON a.channel = b.channel AND {_near(m, 15)} JOIN (SELECT channel, count(*) AS n FROM {s} GROUP BY channel) t ON t.channel = a.channel GROUP BY a.channel, a.i) GROUP BY channel)"


@query(f"SELECT p.channel, round(greatest(0, p.p - q.p), 6) AS apen FROM {_phi(2)} p JOIN {_phi(3)} q ON p.channel = q.channel")
def approx_entropy(spark, d):
    return coupling.approximate_entropy(A.samples(spark, d), ["channel"], 2, 15.0).select("channel", r6("apen", "apen"))


@query(f"SELECT a.channel, round(sum(a.v * b.v), 4) AS own, round(sum(a.p1 * b.v), 4) AS lagged FROM (SELECT channel, sample_idx, value AS v, lag(value, 1, 0) OVER (PARTITION BY channel ORDER BY sample_idx) AS p1 FROM {EV}) a JOIN (SELECT channel, sample_idx, value AS v FROM {EV}) b ON b.channel = a.channel + 1 AND a.sample_idx = b.sample_idx GROUP BY a.channel")
def granger_normal_eq(spark, d):
    rows = A.samples(spark, d).select("recording_id", "channel", "sample_idx", "value")
    a = temporal.fir(rows, [0.0, 1.0], "p1").select("channel", "sample_idx", F.col("value").alias("v"), "p1")
    b = rows.select((F.col("channel") - 1).alias("channel"), "sample_idx", F.col("value").alias("w"))
    return a.join(b, ["channel", "sample_idx"]).groupBy("channel").agg(F.round(F.sum(F.col("v") * F.col("w")), 4).alias("own"), F.round(F.sum(F.col("p1") * F.col("w")), 4).alias("lagged"))


# Clocks and drift ---------------------------------------------------------------------------------

_CLOCK = f"(SELECT channel, sample_idx, (t - 1700000000) / 86400 AS t, value / 1000 AS o FROM {EV})"


def _clock(spark, d):
    return A.samples(spark, d).select("channel", "sample_idx", ((F.col("t") - 1700000000) / 86400).alias("t"), (F.col("value") / 1000).alias("o"))


_DRIFT = f"""SELECT channel, n, slope, o0 + coalesce(mo - slope * mt, 0) - slope * t0 AS intercept FROM (
  SELECT channel, count(*) AS n, any_value(t0) AS t0, any_value(o0) AS o0, avg(dt) AS mt, avg(dd) AS mo, coalesce(CASE WHEN var_pop(dt) > 1e-12 THEN regr_slope(dd, dt) END, 0) AS slope FROM (
    SELECT *, CASE WHEN sample_idx > 0 THEN t - t0 END AS dt, CASE WHEN sample_idx > 0 THEN o - o0 END AS dd FROM (
      SELECT *, first_value(t) OVER w AS t0, first_value(o) OVER w AS o0 FROM {_CLOCK} WINDOW w AS (PARTITION BY channel ORDER BY sample_idx))) GROUP BY channel)"""


@query(f"SELECT channel, n, round(slope, 9) AS slope, round(intercept, 6) AS intercept FROM ({_DRIFT})")
def linear_drift(spark, d):
    return clocks.linear_drift(_clock(spark, d), ["channel"], "t", "o", ["sample_idx"]).select("channel", "n", F.round("slope", 9).alias("slope"), r6("intercept", "intercept"))


@query(f"SELECT c.channel, sample_idx, round(t + intercept + slope * t, 6) AS corrected FROM {_CLOCK} c JOIN ({_DRIFT}) f ON c.channel = f.channel")
def clock_correction(spark, d):
    rows = _clock(spark, d)
    return clocks.corrected(rows, clocks.linear_drift(rows, ["channel"], "t", "o", ["sample_idx"]), ["channel"]).select("channel", "sample_idx", r6("corrected", "corrected"))


_NTP = "(SELECT l_orderkey, l_linenumber, l_quantity AS t1, l_quantity + l_discount + 0.01 AS t2, l_quantity + l_discount + 0.02 AS t3, l_quantity + l_tax + 0.05 AS t4 FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber, round(((t2 - t1) + (t3 - t4)) / 2, 9) AS \"offset\", round((t4 - t1) - (t3 - t2), 9) AS rtt, round(1 / ((t4 - t1) - (t3 - t2)), 6) AS quality FROM {_NTP}")
def ntp_offset(spark, d):
    q = F.col("l_quantity")
    rows = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("t1"), (q + F.col("l_discount") + 0.01).alias("t2"), (q + F.col("l_discount") + 0.02).alias("t3"), (q + F.col("l_tax") + 0.05).alias("t4"))
    return clocks.ntp_offsets(rows).select("l_orderkey", "l_linenumber", F.round("offset", 9).alias("offset"), F.round("rtt", 9).alias("rtt"), r6("quality", "quality"))


@query(f"SELECT channel, sample_idx, round(100 + sample_idx / 250.0::DOUBLE, 6) AS time, CAST(floor((100 + sample_idx / 250.0::DOUBLE + 0.001 - 100) * 250) AS BIGINT) AS sample FROM {EV}")
def sample_clock(spark, d):
    at = clocks.sample_times(A.samples(spark, d), 100.0, 250.0)
    return clocks.sample_of(at.withColumn("later", F.col("time") + 0.001), 100.0, 250.0, "later").select(*IDS, r6("time", "time"), "sample")


@query(f"SELECT channel, arg_min(value, (rtt, -n)) AS best, arg_min(value, n) AS latest, list_sort(list(value))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM (SELECT channel, value, event_id % 1000 AS rtt, row_number() OVER (PARTITION BY channel ORDER BY sample_idx DESC) AS n FROM {EV}) WHERE n <= 16 GROUP BY channel")
def offset_best(spark, d):
    rows = A.samples(spark, d).select("channel", "sample_idx", F.col("value").alias("offset"), (F.col("event_id") % 1000).alias("rtt"))
    return clocks.offset_buffer(rows, ["channel"], 16, ["sample_idx"])


_BINNED = "(SELECT {k} AS g, floor(sample / 10) AS bin, avg(y) AS y, (floor(sample / 10) + 0.5) * 10 AS c FROM (SELECT channel, sample_idx AS sample, value AS y FROM " + EV + ") GROUP BY ALL)"


def _positions(spark, d):
    return A.samples(spark, d).select("channel", F.col("sample_idx").alias("sample"), F.col("value").alias("y"))


@query(f"SELECT g AS channel, count(*) AS bins, round(CASE WHEN count(*) > 1 THEN regr_slope(y, c) END, 8) AS slope, round(CASE WHEN count(*) > 1 THEN regr_intercept(y, c) END, 6) AS intercept FROM {_BINNED.format(k='channel')} GROUP BY g")
def drift_bins(spark, d):
    return clocks.rigid_drift(_positions(spark, d), ["channel"], 10).select("channel", "bins", F.round("slope", 8).alias("slope"), r6("intercept", "intercept"))


_DEPTH = f"(SELECT g AS depth_bin, (g + 0.5) * 25 AS depth, coalesce(CASE WHEN count(*) > 1 THEN regr_slope(y, c) END, 0) AS slope FROM {_BINNED.format(k='CAST(greatest(0, least(3, floor(value_y / 25))) AS BIGINT)').replace('value AS y', 'value AS y, value AS value_y')} GROUP BY g)"


@query(f"SELECT CAST(depth_bin AS BIGINT) AS depth_bin, CAST(depth AS DOUBLE) AS depth, round(slope, 8) AS slope FROM {_DEPTH}")
def nonrigid_drift(spark, d):
    return clocks.nonrigid_drift(_positions(spark, d), 0.0, 100.0, 4, 10).select(F.col("depth_bin").cast("long").alias("depth_bin"), "depth", F.round("slope", 8).alias("slope"))


@query(
    f"WITH f AS (SELECT depth, slope, lead(depth) OVER (ORDER BY depth) AS nd, lead(slope) OVER (ORDER BY depth) AS ns, lag(depth) OVER (ORDER BY depth) AS pd FROM {_DEPTH}) "
    f"SELECT channel, sample_idx AS sample, round(sample_idx * CASE WHEN value >= depth AND value < nd THEN slope + (value - depth) / (nd - depth) * (ns - slope) ELSE slope END, 6) AS drift FROM {EV} JOIN f ON (value >= depth AND value < nd) OR (pd IS NULL AND value < depth) OR (nd IS NULL AND value >= depth)"
)
def drift_interpolated(spark, d):
    rows = _positions(spark, d)
    return clocks.drift_at(rows, clocks.nonrigid_drift(rows, 0.0, 100.0, 4, 10)).select("channel", "sample", r6("drift", "drift"))


# Epochs -------------------------------------------------------------------------------------------


@query(f"SELECT event_type, sample_idx, round(avg(value), 10) AS average, count(*) AS epochs FROM {EV} GROUP BY ALL")
def erp_average(spark, d):
    return coupling.epoch_average(A.samples(spark, d), ["event_type", "sample_idx"]).select("event_type", "sample_idx", F.round("average", 10).alias("average"), "epochs")


def _normalized(mode: str, cell: str):
    sql = f"SELECT s.channel, sample_idx, round({cell}, 6) AS normalized FROM {EV} s JOIN (SELECT channel, avg(value) AS m, stddev_pop(value) AS sd FROM {EV} WHERE sample_idx < 10 GROUP BY channel) b ON s.channel = b.channel"

    def run(spark, d):
        rows = coupling.baseline_normalized(A.samples(spark, d), ["channel"], "sample_idx", "value", 0, 10, mode)
        return rows.select(*IDS, r6("normalized", "normalized"))

    run.__name__ = f"ersp_baseline_{mode}"
    return query(sql)(run)


_normalized("db", "10 * log10(value / m)")
_normalized("zscore", "(value - m) / sd")
_normalized("percentage", "(value - m) / m * 100")
_normalized("logratio", "log10(value / m)")


@query(f"SELECT event_type, round(ln(var_pop(value) + 1e-10), 6) AS feature FROM {EV} GROUP BY event_type")
def csp_logvar(spark, d):
    return coupling.log_variance(A.samples(spark, d), ["event_type"]).select("event_type", r6("feature", "feature"))


# Probes and localisation --------------------------------------------------------------------------

_PROBE = "(SELECT CAST(i AS INT) AS channel, (i % 2 - 0.5) * 32.0::DOUBLE AS x, (i // 2) * 20.0::DOUBLE AS y FROM (SELECT unnest(range(32)) AS i))"
_DIST = f"(SELECT a.channel, b.channel AS neighbor, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM {_PROBE} a JOIN {_PROBE} b ON a.channel <> b.channel)"


def _probe(spark):
    return spatial.polytrode(spark, 16, 2, 32.0, 20.0)


@query(f"SELECT * FROM {_PROBE}")
def probe_polytrode(spark, d):
    return _probe(spark)


@query("SELECT CAST(i AS INT) AS channel, 0.0::DOUBLE AS x, i * 25.0::DOUBLE AS y FROM (SELECT unnest(range(64)) AS i)")
def probe_linear(spark, d):
    return spatial.linear_probe(spark, 64, 25.0)


@query("SELECT CAST(i AS INT) AS channel, i % 2 * 32.0::DOUBLE AS x, i // 2 * 20.0::DOUBLE AS y FROM (SELECT unnest(range(384)) AS i)")
def probe_neuropixels_1(spark, d):
    return spatial.neuropixels_1(spark)


@query("SELECT CAST(i AS INT) AS channel, i % 2 * 32.0::DOUBLE + i // 2 % 2 * 16 AS x, i // 2 * 15.0::DOUBLE AS y FROM (SELECT unnest(range(384)) AS i)")
def probe_neuropixels_2(spark, d):
    return spatial.neuropixels_2(spark)


@query("SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INT) AS channel, i % 10 * 400.0::DOUBLE AS x, i // 10 * 400.0::DOUBLE AS y FROM (SELECT unnest(range(100)) AS i) WHERE i NOT IN (0, 9, 90, 99)")
def probe_utah(spark, d):
    return spatial.utah_array(spark)


@query(f"SELECT channel, neighbor, round(distance, 6) AS distance FROM {_DIST} WHERE distance <= 45")
def probe_neighbors(spark, d):
    return spatial.neighbors_within(_probe(spark), 45.0).select("channel", "neighbor", r6("distance", "distance"))


@query(f"SELECT channel, neighbor, rank FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY distance, neighbor) AS rank FROM {_DIST}) WHERE rank <= 4")
def probe_knn(spark, d):
    return spatial.nearest_channels(_probe(spark), 4).select("channel", "neighbor", "rank")


@query(f"SELECT max(x) - min(x) AS width, max(y) - min(y) AS height, round(count(*) / ((max(x) - min(x)) * (max(y) - min(y))), 9) AS density FROM {_PROBE}")
def probe_extent(spark, d):
    return spatial.extent(_probe(spark)).select("width", "height", F.round("density", 9).alias("density"))


_LONG = "(SELECT DISTINCT CAST(user_id AS INT) AS channel, (user_id % 2 - 0.5) * 32.0::DOUBLE AS x, (user_id // 2) * 20.0::DOUBLE AS y FROM events)"
_PLACED = f"(SELECT sample_idx, abs(value) AS w, x, y FROM {EV} e JOIN {_LONG} p ON e.channel = p.channel)"


def _long_probe(spark, d):
    """The same grid with a place for every user."""
    last = A.table(spark, d, "events").agg(F.max("user_id")).first()[0]
    return spatial.polytrode(spark, (last or 0) // 2 + 1, 2, 32.0, 20.0)


@query(f"SELECT sample_idx, round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y FROM {_PLACED} GROUP BY sample_idx")
def center_of_mass(spark, d):
    return spatial.centre_of_mass(A.samples(spark, d).withColumnRenamed("value", "amplitude"), _long_probe(spark, d), ["sample_idx"]).select("sample_idx", r6("x", "x"), r6("y", "y"))


@query(f"SELECT sample_idx, round(sum(w * x) FILTER (w >= 60) / sum(w) FILTER (w >= 60), 6) AS x, round(sum(w * y) FILTER (w >= 60) / sum(w) FILTER (w >= 60), 6) AS y FROM {_PLACED} GROUP BY sample_idx")
def center_of_mass_threshold(spark, d):
    return spatial.centre_of_mass(A.samples(spark, d).withColumnRenamed("value", "amplitude"), _long_probe(spark, d), ["sample_idx"], 60.0).select("sample_idx", r6("x", "x"), r6("y", "y"))


# Quality ------------------------------------------------------------------------------------------


@query(
    f"WITH d AS (SELECT a.channel, a.event_id, a.event_type, b.event_type AS other, avg(abs(a.value - b.value)) AS d FROM {EV} a JOIN {EV} b ON a.channel = b.channel AND a.event_id <> b.event_id GROUP BY ALL), "
    "s AS (SELECT channel, event_id, event_type, max(d) FILTER (other = event_type) AS a, min(d) FILTER (other <> event_type) AS b FROM d GROUP BY ALL) "
    "SELECT channel, event_id, event_type, round(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 6) AS silhouette FROM s WHERE a IS NOT NULL AND b IS NOT NULL"
)
def silhouette(spark, d):
    rows = A.samples(spark, d).withColumn("x", F.array("value"))
    return trains.silhouette(rows, ["channel"], "event_id", "event_type").select("channel", "event_id", "event_type", r6("silhouette", "silhouette"))


@query(f"SELECT vec_id, round(list_sum([v * v FOR v IN x]), 6) AS norm_sq, round(list_inner_product(x, list_reverse(x)), 6) AS folded FROM {EM}")
def dot_norm(spark, d):
    return A.vectors(spark, d).select("vec_id", r6(C.norm_sq("x"), "norm_sq"), r6(C.dot("x", F.reverse("x")), "folded"))


@query(f"SELECT channel, sample_idx, round(sqrt(value) + abs(value - 40) + exp(-value / 50) + ln(value) + log2(value) + log10(value), 6) AS a, round(sin(value) + cos(value) + atan(value) + atan2(value, 2) + tanh(value / 100) + sinh(value / 100) + pow(value, 0.3), 6) AS b, floor(value) + ceil(value) AS c FROM {EV}")
def elementary_functions(spark, d):
    v, e = F.col("value"), C.ELEMENTARY
    a = e["sqrt"](v) + e["abs"](v - 40) + e["exp"](-v / 50) + e["log"](v) + e["log2"](v) + e["log10"](v)
    b = e["sin"](v) + e["cos"](v) + e["atan"](v) + e["atan2"](v, F.lit(2.0)) + e["tanh"](v / 100) + e["sinh"](v / 100) + e["pow"](v, F.lit(0.3))
    return A.samples(spark, d).select(*IDS, r6(a, "a"), r6(b, "b"), (e["floor"](v) + e["ceil"](v)).alias("c"))


_GREEDY = f"""WITH RECURSIVE a AS (SELECT user_id AS unit, epoch_us(ts) // 3600000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error'),
b AS (SELECT user_id AS unit, list(epoch_us(ts) // 3600000000 ORDER BY ts) AS all_s FROM events WHERE event_type = 'click' GROUP BY user_id),
m AS (SELECT b.unit, 0::BIGINT AS k, all_s AS free, 0::BIGINT AS tp FROM b
  UNION ALL SELECT m.unit, a.k, CASE WHEN hit IS NULL THEN free ELSE list_concat(free[:hit - 1], free[hit + 1:]) END, tp + CAST(hit IS NOT NULL AS BIGINT)
  FROM (SELECT m.*, a.k AS ak, a.s, list_position([f >= a.s - 48 AND f <= a.s + 48 FOR f IN free], true) AS hit FROM m JOIN a ON a.unit = m.unit AND a.k = m.k + 1) m JOIN a ON a.unit = m.unit AND a.k = m.ak)
SELECT m.unit, tp, len(all_s) - tp AS fp, m.k - tp AS fn FROM m JOIN b ON b.unit = m.unit JOIN (SELECT unit, max(k) AS k FROM m GROUP BY unit) t ON t.unit = m.unit AND t.k = m.k"""


@query(_GREEDY)
def compare_trains(spark, d):
    rows = A.table(spark, d, "events").select(F.col("user_id").alias("unit"), "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("sample"))
    pick = lambda k: rows.where(F.col("event_type") == k).select("unit", "sample")
    clicks = pick("click")
    return signals.compared(pick("error").join(clicks.select("unit").distinct(), "unit", "left_semi"), clicks, ["unit"], 48).select("unit", "tp", "fp", "fn")


# Kernels that SQL cannot express ------------------------------------------------------------------


def scan(states: dict[str, str], lets: list[tuple[str, str]], after: dict[str, str], out: str, source: str = EV) -> str:
    """SQL of a recurrence along each channel: initial states, what a step computes in order, the states after it, the result."""

    def body(rows: str) -> str:
        for name, expression in lets:
            rows = f"(SELECT *, {expression} AS {name} FROM {rows})"
        return f"SELECT channel, sample_idx, value, {', '.join(f'{after[k]} AS n_{k}' for k in states)}, {out} FROM {rows}"

    first = body(f"(SELECT channel, sample_idx, value, {', '.join(f'{v} AS {k}' for k, v in states.items())} FROM s WHERE sample_idx = 0)")
    then = body(f"(SELECT s.channel, s.sample_idx, s.value, {', '.join(f'f.n_{k} AS {k}' for k in states)} FROM f JOIN s ON s.channel = f.channel AND s.sample_idx = f.sample_idx + 1)")
    return f"WITH RECURSIVE s AS (SELECT channel, sample_idx, value FROM {source}), f AS ({first} UNION ALL {then}) SELECT * FROM f"


_ZERO = "0.0::DOUBLE"


def _sql_cascade(sections) -> str:
    states, lets, after, now = {}, [], {}, "value"
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        states |= {f"{v}{k}": _ZERO for v in ("xa", "xb", "ya", "yb")}
        lets.append((f"y{k}", f"({b0!r} * {now} + {b1!r} * xa{k} + {b2!r} * xb{k} - {a1!r} * ya{k} - {a2!r} * yb{k})"))
        after |= {f"xa{k}": now, f"xb{k}": f"xa{k}", f"ya{k}": f"y{k}", f"yb{k}": f"ya{k}"}
        now = f"y{k}"
    return f"SELECT channel, sample_idx, round(y, 6) AS filtered FROM ({scan(states, lets, after, f'{now} AS y')})"


def _rounded(df, column: str = "filtered"):
    return df.select(*IDS, r6(column, column))


_LOW, _HIGH, _BAND = design.lowpass_sections(100.0, 10.0, 2), design.highpass_sections(100.0, 5.0, 2), design.bandpass_sections(100.0, 5.0, 20.0, 2)


@query(_sql_cascade(_LOW))
def iir_lowpass(spark, d):
    return _rounded(signals.lowpass(A.samples(spark, d), 100.0, 10.0))


@query(_sql_cascade(_HIGH))
def iir_highpass(spark, d):
    return _rounded(signals.highpass(A.samples(spark, d), 100.0, 5.0))


@query(_sql_cascade(_BAND))
def iir_bandpass(spark, d):
    return _rounded(signals.bandpass(A.samples(spark, d), 100.0, 5.0, 20.0))


@query(_sql_cascade(_LOW))
def iir_in_blocks(spark, d):
    return _rounded(signals.filtered_in_blocks(A.samples(spark, d), _LOW, 16))


@query(_sql_cascade(design.notch_bank(250.0, 50.0, 3)))
def notch_bank(spark, d):
    return _rounded(signals.notch(A.samples(spark, d), 250.0, 50.0, 3))


@query(_sql_cascade([design.sorter_bandpass(100.0, 5.0, 20.0)] * 2))
def sorter_bandpass(spark, d):
    return _rounded(signals.sorter_bandpass(A.samples(spark, d), 100.0, 5.0, 20.0))


_UP, _DOWN = design.follower_coefficient(100.0, 0.01), design.follower_coefficient(100.0, 0.1)


@query("SELECT channel, sample_idx, round(level, 6) AS envelope FROM (" + scan({"l": _ZERO}, [("level", f"l + CASE WHEN abs(value) > l THEN {_UP!r} ELSE {_DOWN!r} END * (abs(value) - l)")], {"l": "level"}, "level") + ")")
def envelope_follower(spark, d):
    return _rounded(signals.envelope(A.samples(spark, d), 100.0, 0.01, 0.1), "envelope")


def _sql_lms(step: str) -> str:
    taps = ["value", "p1", "p2", "p3"]
    lets = [("y", " + ".join(f"w{k} * {t}" for k, t in enumerate(taps))), ("e", "value / 2 - y"), ("g", step)]
    after = {f"w{k}": f"w{k} + g * e * {t}" for k, t in enumerate(taps)} | {"p1": "value", "p2": "p1", "p3": "p2"}
    return "SELECT channel, sample_idx, round(y, 6) AS output, round(e, 6) AS error FROM (" + scan({k: _ZERO for k in ("w0", "w1", "w2", "w3", "p1", "p2", "p3")}, lets, after, "y, e") + ")"


def _adapted(spark, d, *options):
    rows = signals.adaptive(A.samples(spark, d).withColumn("target", F.col("value") / 2), "target", 4, *options)
    return rows.select(*IDS, r6("output", "output"), r6("error", "error"))


@query(_sql_lms("1.2345678e-5::DOUBLE"))
def lms_filter(spark, d):
    return _adapted(spark, d, 1.2345678e-5)


@query(_sql_lms("0.5::DOUBLE / (0.01 + value * value + p1 * p1 + p2 * p2 + p3 * p3)"))
def nlms_filter(spark, d):
    return _adapted(spark, d, 0.5, 0.01)


@query(f"SELECT channel, sample_idx, round(0.4 * value + 0.3 * lag(value, 1, 0) OVER w + 0.2 * lag(value, 2, 0) OVER w, 6) AS output FROM {EV} WINDOW w AS (PARTITION BY channel ORDER BY sample_idx)")
def lms_predict(spark, d):
    return _rounded(signals.predicted(A.samples(spark, d), [0.4, 0.3, 0.2]), "output")


@query("SELECT channel, sample_idx AS sample, value AS amplitude FROM (" + scan({"w": "0::BIGINT"}, [("hit", "w <= 0 AND abs(value) > 80")], {"w": "CASE WHEN w > 0 THEN w - 1 WHEN hit THEN 3 ELSE 0 END"}, "hit") + ") WHERE hit")
def threshold_detector(spark, d):
    return signals.threshold_hits(A.samples(spark, d), 80.0, 3).select("channel", "sample", "amplitude")


_RAW = EV.replace("value,", "value * 50 AS value,", 1)


@query("SELECT channel, sample_idx AS sample FROM (" + scan({"l": _ZERO, "z": _ZERO, "i": "false"}, [("x", "value / 32768"), ("level", "l + 0.002::DOUBLE * (x - l)"), ("gap", "abs(x - level)"), ("noise", "z + 0.001::DOUBLE * (gap - z)"), ("over_", "gap > 4 * greatest(noise, 1.0::DOUBLE / 32768)")], {"l": "level", "z": "noise", "i": "over_"}, "over_ AND NOT i AS hit", _RAW) + ") WHERE hit")
def firmware_detector(spark, d):
    return signals.firmware_hits(A.samples(spark, d).withColumn("value", F.col("value") * 50), 4.0).select("channel", "sample")


_GAMMA = design.oasis_gamma(30.0, 0.5)
#: A new pool swept through those before it, from the newest on: what it has become by then, and those that stay behind it.
_SWEPT = (
    "list_reduce(list_concat([struct_pack(now := struct_pack(v := greatest(value, 0), w := 1.0::DOUBLE, n := 1::BIGINT), left := []::STRUCT(v DOUBLE, w DOUBLE, n BIGINT)[])], [struct_pack(now := p, left := []::STRUCT(v DOUBLE, w DOUBLE, n BIGINT)[]) FOR p IN list_reverse(pools)]), "
    f"lambda a, e: CASE WHEN a.now.v > {_GAMMA!r} * e.now.v + {0.1 * (1 - _GAMMA)!r} THEN struct_pack(now := struct_pack(v := (e.now.w * e.now.v + {_GAMMA!r} ** e.now.n * a.now.w * a.now.v) / (e.now.w + {_GAMMA!r} ** e.now.n * a.now.w), w := e.now.w + {_GAMMA!r} ** e.now.n * a.now.w, n := e.now.n + a.now.n), left := a.left) "
    "ELSE struct_pack(now := e.now, left := list_append(a.left, a.now)) END)"
)


@query("SELECT channel, sample_idx, round(c, 6) AS calcium, round(greatest(0, c - " + repr(_GAMMA) + " * last), 6) AS spike FROM (" + scan({"pools": "[]::STRUCT(v DOUBLE, w DOUBLE, n BIGINT)[]", "last": _ZERO}, [("s", _SWEPT), ("now_", "list_reverse(list_append(s.left, s.now))"), ("c", "now_[-1].v")], {"pools": "now_", "last": "c"}, "c, last") + ")")
def oasis_deconvolution(spark, d):
    """Pools as many as there are; as many as 256 would never be held here."""
    return signals.deconvolved(A.samples(spark, d), _GAMMA, 0.1, most=None).select(*IDS, r6("calcium", "calcium"), r6("spike", "spike"))


@query()
def template_peel(spark, d):
    shape = np.array([[10.0, 60.0, 30.0, 5.0], [5.0, 20.0, 60.0, 20.0]])
    return signals.peeled(A.samples(spark, d), A.samples(spark, d).where("value > 100").withColumnRenamed("sample_idx", "sample"), shape, [0.3, 0.3], [8.0, 8.0], 1)


@query(f"SELECT vec_id, round(sum((p + q) / 2) FILTER (k BETWEEN 8 AND 11) / sum((p + q) / 2) FILTER (k < 32), 9) AS relative FROM (SELECT *, lead(p) OVER (PARTITION BY vec_id ORDER BY k) AS q FROM ({_PSD})) GROUP BY vec_id")
def relative_band_power(spark, d):
    rows = signals.relative_band_power(A.vectors(spark, d).select("vec_id", "x"), 64.0, (8.0, 12.0))
    return rows.select("vec_id", F.round("relative", 9).alias("relative"))


@query()
def comodulogram(spark, d):
    rows = A.table(spark, d, "orders").select(F.lit(0).cast("long").alias("recording_id"), (F.col("o_custkey") % 8).alias("channel"), (F.row_number().over(Window.partitionBy(F.col("o_custkey") % 8).orderBy("o_orderdate", "o_orderkey")) - 1).cast("long").alias("sample_idx"), F.col("o_totalprice").alias("value"))
    return signals.comodulogram(rows, 250.0, [6.0, 10.0], [40.0, 60.0])


def _user_pairs(spark, d):
    rows = A.samples(spark, d)
    return rows.select(F.col("channel").alias("pair_id"), F.col("sample_idx").alias("n"), F.col("value").alias("a")).join(rows.select((F.col("channel") - 1).alias("pair_id"), F.col("sample_idx").alias("n"), F.col("value").alias("b")), ["pair_id", "n"])


# Snippets across channels ---------------------------------------------------------------------------

_HITS = f"(SELECT DISTINCT sample_idx AS sample FROM {EV} WHERE value > 250)"


def _hits(spark, d):
    rows = A.samples(spark, d)
    return rows, rows.where("value > 250").select("recording_id", F.col("sample_idx").alias("sample"))


@query(f"SELECT sample, channel, round(sum(value), 6) AS total, round(arg_min(value, sample_idx), 6) AS first FROM {_HITS} h JOIN {EV} e ON e.sample_idx BETWEEN h.sample - 2 AND h.sample + 5 GROUP BY ALL HAVING count(*) = 8")
def waveform_extract_multi(spark, d):
    rows = trains.snippets_of_all(*_hits(spark, d), 2, 8)
    return rows.select("sample", "channel", r6(C.total("x"), "total"), r6(F.get("x", F.lit(0)), "first"))


@query(f"SELECT sample, round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y FROM (SELECT h.sample, e.channel, max(abs(value)) AS w FROM {_HITS} h JOIN {EV} e ON e.sample_idx BETWEEN h.sample - 2 AND h.sample + 2 GROUP BY ALL) q JOIN {_LONG} p ON p.channel = q.channel GROUP BY sample")
def spatial_features(spark, d):
    return trains.spatial_features(*_hits(spark, d), _long_probe(spark, d)).select("sample", r6("x", "x"), r6("y", "y"))


@query(f"SELECT vec_id, round((list_min(x[33:64]) - list_avg(x[1:32])) / greatest(list_min(x[33:64]), list_avg(x[1:32])), 6) AS s FROM (SELECT vec_id, [v + 2 FOR v IN x] AS x FROM {EM})")
def silhouette_scores(spark, d):
    rows = A.vectors(spark, d).withColumn("x", F.transform("x", lambda v: v + 2))
    return rows.select("vec_id", r6(C.silhouette_of(F.slice("x", 1, 32), F.slice("x", 33, 32)), "s"))


@query("SELECT k AS bin, k * 100.0::DOUBLE / 16 AS frequency FROM (SELECT unnest(range(9)) AS k)")
def welch_frequencies(spark, d):
    return spark.range(1).select(F.posexplode(C.bin_frequencies(16, 100.0)).alias("bin", "frequency"))
