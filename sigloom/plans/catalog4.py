"""Fourth part of the catalogue: kernels whose SQL is a recurrence, a sum over lists or an elimination, and fits by what must hold of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import columns as C
from sigloom.functions import spectrum
from sigloom.operators import coupling, models, signals, spatial, temporal, trains
from sigloom.plans import adapters as A
from sigloom.plans import pipeline
from sigloom.plans.catalog import EM, EV, LI, ORACLE_SQL, query, r6
from sigloom.plans.catalog2 import _LONG, _long_probe, _LOW, _near, _PSD, _sql_cascade, _starts, _user_pairs, scan
from sigloom.plans.catalog3 import _flags, _scaled, _spd
from sigloom.streaming import processors

IDS = ("channel", "sample_idx")
_SCALED = f"(SELECT l_orderkey, l_linenumber, l_returnflag, [x[1] / 50, x[2] / 50000, x[3] * 10, x[4] * 10] AS x FROM {LI})"
_ENTRIES = ", ".join(f"covar_samp(x[{i + 1}], x[{j + 1}]) AS g{i}{j}" for i in range(4) for j in range(i, 4))


# Entropy and coupling -------------------------------------------------------------------------------

_COARSE = f"(SELECT channel, sample_idx // 2 AS sample_idx, avg(value) AS value FROM {EV} GROUP BY ALL HAVING count(*) = 2)"
_COARSE_STARTS = _starts(3, 2).replace(EV, _COARSE)


@query(
    f"WITH s AS {_COARSE_STARTS}, c AS (SELECT DISTINCT channel FROM {_COARSE}), x AS (SELECT a.channel, count(*) AS b, count(*) FILTER ({_near(3, 15)}) AS a FROM s a JOIN s b ON a.channel = b.channel AND a.i < b.i WHERE {_near(2, 15)} GROUP BY a.channel) "
    "SELECT c.channel, round(CASE WHEN coalesce(a, 0) = 0 OR coalesce(b, 0) = 0 THEN 'inf'::DOUBLE ELSE -ln(a / b) END, 6) AS mse FROM c LEFT JOIN x ON c.channel = x.channel"
)
def multiscale_entropy(spark, d):
    return coupling.sample_entropy(temporal.multiscale(A.samples(spark, d).select("recording_id", "channel", "sample_idx", "value"), 2), ["channel"], 2, 15.0).select("channel", r6("sampen", "mse"))


_PAIRS = f"(SELECT x.channel AS pair_id, x.sample_idx AS n, x.value AS a, y.value AS b FROM {EV} x JOIN {EV} y ON y.channel = x.channel + 1 AND y.sample_idx = x.sample_idx)"
_HANN = "(0.5 - 0.5 * cos(2 * pi() * i / 15))"


@query(
    f"WITH p AS (SELECT *, count(*) OVER (PARTITION BY pair_id) AS size FROM {_PAIRS}), "
    "s AS (SELECT pair_id, n // 8 - back AS seg, n % 8 + 8 * back AS i, a, b FROM p, (SELECT unnest([0, 1]) AS back) WHERE n // 8 >= back AND 8 * (n // 8 - back) + 16 <= size), "
    f"f AS (SELECT pair_id, seg, k, sum(a * {_HANN} * cos(2 * pi() * k * i / 16)) AS ar, -sum(a * {_HANN} * sin(2 * pi() * k * i / 16)) AS ai, sum(b * {_HANN} * cos(2 * pi() * k * i / 16)) AS br, -sum(b * {_HANN} * sin(2 * pi() * k * i / 16)) AS bi FROM s, (SELECT unnest(range(9)) AS k) GROUP BY ALL) "
    "SELECT pair_id, CAST(k AS INT) AS bin, round(least(1, (sum(ar * br + ai * bi) ** 2 + sum(ai * br - ar * bi) ** 2) / (sum(ar * ar + ai * ai) * sum(br * br + bi * bi))), 6) AS coherence FROM f GROUP BY pair_id, k"
)
def spectral_coherence(spark, d):
    return signals.coherence(_user_pairs(spark, d), 16).select("pair_id", "bin", r6("coherence", "coherence"))


def _eliminated(n: int) -> str:
    """Columns b0, b1, ... that solve the symmetric system g00 ... = h0 ... by elimination, each from those before it."""
    out = []
    g, h = {(i, j): f"g{min(i, j)}{max(i, j)}" for i in range(n) for j in range(n)}, {i: f"h{i}" for i in range(n)}
    for k in range(n):
        for i in range(k + 1, n):
            out.append((f"f{k}_{i}", f"{g[i, k]} / {g[k, k]}"))
            for j in range(k + 1, n):
                out.append((f"e{k}_{i}_{j}", f"{g[i, j]} - f{k}_{i} * {g[k, j]}"))
            out.append((f"r{k}_{i}", f"{h[i]} - f{k}_{i} * {h[k]}"))
        g |= {(i, j): f"e{k}_{i}_{j}" for i in range(k + 1, n) for j in range(k + 1, n)}
        h |= {i: f"r{k}_{i}" for i in range(k + 1, n)}
    for k in reversed(range(n)):
        rest = "".join(f" - {g[k, j]} * b{j}" for j in range(k + 1, n))
        out.append((f"b{k}", f"({h[k]}{rest}) / {g[k, k]}"))
    return ", ".join(f"{e} AS {name}" for name, e in out)


def _sql_rss(columns: list[str]) -> str:
    """(pair_id, rss, n) of the regression of ``target`` on columns of ``lagged``, with the ridge of a share of the mean diagonal."""
    n = len(columns)
    ridge = f"1e-10 * ({' + '.join(f'sum({c} * {c})' for c in columns)}) / {n}"
    gram = ", ".join(f"sum({columns[i]} * {columns[j]}){f' + {ridge}' if i == j else ''} AS g{i}{j}" for i in range(n) for j in range(i, n))
    right = ", ".join(f"sum({c} * target) AS h{i}" for i, c in enumerate(columns))
    fit = f"(SELECT pair_id, {_eliminated(n)} FROM (SELECT pair_id, {gram}, {right} FROM lagged GROUP BY pair_id))"
    return f"(SELECT r.pair_id, sum((target - ({' + '.join(f'f.b{k} * r.{c}' for k, c in enumerate(columns))})) ** 2) AS rss, count(*) AS n FROM lagged r JOIN {fit} f ON f.pair_id = r.pair_id GROUP BY r.pair_id)"


def _sql_granger(pairs: str, own: list[str]) -> str:
    """F and both variances of two lags; pairs that are too short have nulls."""
    lags = ", ".join(f"lag({v}, {k}) OVER w AS {v}_{k}" for v in ("a", *own) for k in (1, 2))
    rest, d2 = [f"{v}_{k}" for v in own for k in (1, 2)], f"(u.n - {2 * len(own) + 2})"
    return (
        f"WITH lagged AS MATERIALIZED (SELECT * FROM (SELECT pair_id, n, b AS target, {lags}, count(*) OVER (PARTITION BY pair_id) AS size FROM {pairs} WINDOW w AS (PARTITION BY pair_id ORDER BY n)) WHERE n >= 2 AND size > {4 + 2 * len(own)}), "
        f"fits AS (SELECT r.pair_id, CASE WHEN u.rss <= 0 OR {d2} <= 0 THEN 0 ELSE greatest(0, (r.rss - u.rss) / 2 / (u.rss / {d2})) END AS f, r.rss / r.n AS v0, u.rss / u.n AS v1 FROM {_sql_rss(rest)} r JOIN {_sql_rss([*rest, 'a_1', 'a_2'])} u ON u.pair_id = r.pair_id) "
        f"SELECT i.pair_id, round(f, 4) AS f, round(v0, 4) AS restricted, round(v1, 4) AS unrestricted FROM (SELECT DISTINCT pair_id FROM {pairs}) i LEFT JOIN fits ON fits.pair_id = i.pair_id"
    )


def _variances(rows: DataFrame) -> DataFrame:
    return rows.select("pair_id", *(F.round(c, 4).alias(c) for c in ("f", "restricted", "unrestricted")))


@query(_sql_granger(_PAIRS, ["b"]))
def granger_causality(spark, d):
    return _variances(signals.granger(_user_pairs(spark, d), 2))


_THREE = f"(SELECT p.*, z.value AS c FROM {_PAIRS} p JOIN {EV} z ON z.channel = p.pair_id + 2 AND z.sample_idx = p.n)"


@query(_sql_granger(_THREE, ["b", "c"]))
def conditional_granger(spark, d):
    third = A.samples(spark, d).select((F.col("channel") - 2).alias("pair_id"), F.col("sample_idx").alias("n"), F.col("value").alias("c"))
    return _variances(signals.granger(_user_pairs(spark, d).join(third, ["pair_id", "n"]), 2, "c"))


@query()
def granger_probability(spark, d):
    """The probability is an incomplete beta function, tested against its definition."""
    return signals.granger(_user_pairs(spark, d), 2).select("pair_id", "p")


# Analytic signal and wavelets -------------------------------------------------------------------------

_LISTED = f"(SELECT vec_id, unnest(range(64)) AS i, unnest(x) AS v FROM {EM})"
_KERNEL = "(SELECT j, 2.0::DOUBLE / 64 * sum(sin(2 * pi() * k * j / 64)) AS h FROM (SELECT unnest(range(-63, 64)) AS j), (SELECT unnest(range(1, 32)) AS k) GROUP BY j)"


@query(
    f"WITH z AS (SELECT b.vec_id, b.i, any_value(b.v) AS re, sum(a.v * h) AS im FROM {_LISTED} a JOIN {_LISTED} b ON a.vec_id = b.vec_id JOIN {_KERNEL} k ON k.j = b.i - a.i GROUP BY b.vec_id, b.i), "
    "s AS (SELECT *, atan2(im, re) - lag(atan2(im, re)) OVER (PARTITION BY vec_id ORDER BY i) AS step FROM z) "
    "SELECT vec_id, CAST(i AS INT) AS i, round(im, 6) AS imaginary, round(sqrt(re * re + im * im), 6) AS amplitude, round(re / sqrt(re * re + im * im), 6) AS cosine, "
    "round((step - CASE WHEN step > pi() THEN 2 * pi() WHEN step < -pi() THEN -2 * pi() ELSE 0 END) * 64 / (2 * pi()), 4) AS frequency FROM s"
)
def hilbert(spark, d):
    got = signals.analytic(A.vectors(spark, d).select("vec_id", "x"), 64.0)
    rows = got.select("vec_id", "frequency", F.posexplode(F.arrays_zip("imaginary", "amplitude", "phase")).alias("i", "z"))
    return rows.select("vec_id", "i", r6("z.imaginary", "imaginary"), r6("z.amplitude", "amplitude"), r6(F.cos("z.phase"), "cosine"), F.round(F.get("frequency", F.col("i") - 1), 4).alias("frequency"))


_SCALES = [float(s) for s in spectrum.scales(4.0, 20.0, 6)]
_WAVES = ", ".join(f"({k}, {s!r}::DOUBLE, {spectrum.half_width(s, 64.0)})" for k, s in enumerate(_SCALES))


@query(
    f"WITH w AS (SELECT * FROM (VALUES {_WAVES}) AS t(scale_idx, s, half)), g AS (SELECT scale_idx, j, exp(-((j / (64 * s)) ** 2) / 2) * cos(6 * j / (64 * s)) / sqrt(s) AS re, exp(-((j / (64 * s)) ** 2) / 2) * sin(6 * j / (64 * s)) / sqrt(s) AS im FROM (SELECT *, unnest(range(-half, half + 1)) AS j FROM w)) "
    f"SELECT b.vec_id, CAST(g.scale_idx AS INT) AS scale_idx, CAST(b.i AS INT) AS i, round(sum(a.v * re) ** 2 + sum(a.v * im) ** 2, 6) AS power FROM {_LISTED} a JOIN {_LISTED} b ON a.vec_id = b.vec_id JOIN g ON g.j = a.i - b.i GROUP BY b.vec_id, g.scale_idx, b.i"
)
def cwt_power(spark, d):
    got = signals.wavelet_power(A.vectors(spark, d).select("vec_id", "x"), 64.0, 4.0, 20.0, 6)
    place = F.array_position(F.array(*(F.lit(s) for s in _SCALES)), F.col("scale")).cast("int") - 1
    return got.select("vec_id", place.alias("scale_idx"), F.posexplode("power").alias("i", "p")).select("vec_id", "scale_idx", "i", r6("p", "power"))


def _sql_haar(levels: int) -> str:
    """Circular Haar transform of each channel's list, soft thresholds, and back."""
    shifted = lambda x, by: f"[{x}[((k + {by}) % n + n) % n + 1] FOR k IN range(n)]"
    over = lambda a, b, e: f"[{e} FOR p IN list_zip({a}, {b})]"
    rows, now = f"SELECT channel, count(*) AS n, list(value ORDER BY sample_idx) AS x0 FROM {EV} GROUP BY channel", "x0"
    for k in range(levels):
        rows = f"SELECT *, {shifted(now, -(1 << k))} AS p{k} FROM ({rows})"
        rows = f"SELECT *, {over(f'p{k}', now, '(p[1] - p[2]) / sqrt(2)')} AS d{k}, {over(f'p{k}', now, '(p[1] + p[2]) / sqrt(2)')} AS x{k + 1} FROM ({rows})"
        now = f"x{k + 1}"
    rows = f"SELECT *, CASE WHEN n <= 1 THEN 0 ELSE list_median([abs(v) FOR v IN d0]) / 0.6745 * sqrt(2 * ln(n)) END AS z FROM ({rows})"
    for k in reversed(range(levels)):
        rows = f"SELECT *, [sign(v) * greatest(abs(v) - z, 0) FOR v IN d{k}] AS s{k} FROM ({rows})"
        rows = f"SELECT *, {over(now, f's{k}', 'p[1] + p[2]')} AS u{k} FROM ({rows})"
        rows = f"SELECT *, {shifted(f'u{k}', 1 << k)} AS t{k} FROM ({rows})"
        rows = f"SELECT *, [(p[1] - p[2] + p[3]) / (2 * sqrt(2)) FOR p IN list_zip({now}, s{k}, t{k})] AS y{k} FROM ({rows})"
        now = f"y{k}"
    return f"SELECT channel, unnest(range(n)) AS sample_idx, round(unnest({now}), 9) AS filtered FROM ({rows})"


@query(_sql_haar(3))
def haar_denoise(spark, d):
    return signals.denoised(A.samples(spark, d), 3).select(*IDS, F.round("filtered", 9).alias("filtered"))


# Detection --------------------------------------------------------------------------------------------

_SIZED = f"(SELECT e.channel, e.sample_idx, (40 - e.value) / t.noise AS value FROM {EV} e JOIN (SELECT channel, median(abs(40 - value)) / 0.6745 AS noise FROM {EV} GROUP BY channel) t ON t.channel = e.channel)"


@query(
    "WITH hits AS (SELECT channel, sample_idx FROM (" + scan({"w": "0::BIGINT"}, [("hit", "w <= 0 AND value < -1")], {"w": "CASE WHEN w > 0 THEN w - 1 WHEN hit THEN 3 ELSE 0 END"}, "hit", _SIZED) + f") WHERE hit), "
    f"near AS (SELECT h.channel, h.sample_idx AS hit, arg_min(e.sample_idx, (40 - e.value, e.sample_idx)) AS sample, min(40 - e.value) AS trough FROM hits h JOIN {EV} e ON e.channel = h.channel AND e.sample_idx BETWEEN h.sample_idx AND h.sample_idx + 3 GROUP BY ALL) "
    "SELECT channel, sample, round(abs(trough), 6) AS amplitude FROM near"
)
def negative_peaks(spark, d):
    rows = A.samples(spark, d).withColumn("value", 40 - F.col("value"))
    return signals.spikes(rows, temporal.mad_noise(rows).withColumn("threshold", F.col("noise")), 4).select("channel", "sample", r6("amplitude", "amplitude"))


_PRICES = "(SELECT o_orderkey % 16 AS recording_id, o_orderkey // 64 AS sample_idx, min(o_totalprice) AS v0, max(o_totalprice) AS v1 FROM orders GROUP BY ALL)"


@query(
    f"WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY sample_idx) AS k FROM {_PRICES}), "
    "f AS (SELECT recording_id, 0::BIGINT AS k, 0::BIGINT AS w0, 0::BIGINT AS w1, -1 AS channel FROM (SELECT DISTINCT recording_id FROM s) UNION ALL "
    "SELECT recording_id, k, CASE WHEN w0 > 0 THEN w0 - 1 WHEN v0 > 200000 THEN 2 ELSE 0 END, CASE WHEN w0 <= 0 AND v0 > 200000 THEN w1 WHEN w1 > 0 THEN w1 - 1 WHEN v1 > 200000 THEN 2 ELSE 0 END, "
    "CASE WHEN w0 <= 0 AND v0 > 200000 THEN 0 WHEN w1 <= 0 AND v1 > 200000 THEN 1 ELSE -1 END FROM (SELECT s.recording_id, s.k, f.w0, f.w1, s.v0, s.v1 FROM f JOIN s ON s.recording_id = f.recording_id AND s.k = f.k + 1)) "
    "SELECT f.recording_id, s.sample_idx AS sample, CAST(f.channel AS INT) AS channel, CASE f.channel WHEN 0 THEN v0 ELSE v1 END AS amplitude FROM f JOIN s ON s.recording_id = f.recording_id AND s.k = f.k WHERE f.channel >= 0"
)
def threshold_detector_first(spark, d):
    frames = A.table(spark, d, "orders").groupBy((F.col("o_orderkey") % 16).alias("recording_id"), F.floor(F.col("o_orderkey") / 64).alias("sample_idx")).agg(F.array(F.min("o_totalprice"), F.max("o_totalprice")).alias("x"))
    return signals.first_channel_hits(frames, 200_000.0, 2).select("recording_id", "sample", "channel", "amplitude")


def _sql_matched(shapes: list[list[float]], threshold: float, refractory: int) -> str:
    """Inner products of all channels with unit templates, the largest of each run of hits, and of hits of all close in time the best."""
    parts = []
    for k, shape in enumerate(shapes):
        norm = sum(v * v for v in shape) ** 0.5
        terms = " + ".join(f"{v!r} * lead(value, {i}) OVER (PARTITION BY channel ORDER BY sample_idx)" for i, v in enumerate(shape))
        parts.append(f"SELECT channel * {len(shapes)} + {k} AS channel, sample_idx, ({terms}) / {norm!r} AS value FROM {EV}")
    z = f"(SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL)"
    hits = scan({"w": "0::BIGINT"}, [("hit", f"w <= 0 AND value > {threshold}")], {"w": f"CASE WHEN w > 0 THEN w - 1 WHEN hit THEN {refractory - 1} ELSE 0 END"}, "hit", z)
    return (
        f"WITH RECURSIVE hits AS (SELECT channel, sample_idx FROM ({hits}) WHERE hit), near AS MATERIALIZED (SELECT h.channel, h.sample_idx AS hit, arg_min(e.sample_idx, (-e.value, e.sample_idx)) AS sample, max(e.value) AS z FROM hits h JOIN {z} e ON e.channel = h.channel AND e.sample_idx BETWEEN h.sample_idx AND h.sample_idx + {refractory - 1} GROUP BY ALL), "
        f"runs AS (SELECT min(sample) AS start FROM near UNION ALL SELECT (SELECT min(sample) FROM near WHERE sample >= runs.start + {refractory}) FROM runs WHERE start IS NOT NULL) "
        f"SELECT arg_min(sample, (-z, sample)) AS sample, CAST(arg_min(channel, (-z, sample)) AS INT) // {len(shapes)} AS channel, CAST(arg_min(channel, (-z, sample)) AS INT) % {len(shapes)} AS template_id, round(max(z), 6) AS z FROM runs JOIN near ON sample >= start AND sample < start + {refractory} GROUP BY start"
    )


_MATCHED = [[10.0, 60.0, 30.0], [20.0, 60.0, 20.0]]


@query(_sql_matched(_MATCHED, 90.0, 3))
def matched_filter(spark, d):
    """Two templates, each on all channels."""
    got = signals.matched_detections(A.samples(spark, d), {k: (None, np.array(w)) for k, w in enumerate(_MATCHED)}, 90.0, 3)
    return got.select("sample", F.col("channel").cast("int").alias("channel"), "template_id", r6("z", "z"))


def _sql_p_square(p: float) -> str:
    """Markers q, their places n and wished places d, after the fifth sample from the sorted first five."""
    q, n, w = ([f"{v}{k}" for k in range(5)] for v in "qnw")
    states = {"m": "0::BIGINT", "b": "[]::DOUBLE[]"} | {c: "0.0::DOUBLE" for c in (*q, *n, *w)}
    lets = [("started", "m >= 5")]
    lets += [("q0_", "least(q0, value)"), ("q4_", "greatest(q4, value)"), ("cell", "CASE WHEN value < q1 THEN 0 WHEN value < q2 THEN 1 WHEN value < q3 THEN 2 ELSE 3 END")]
    lets += [(f"n{k}_", f"n{k} + CASE WHEN cell < {k} THEN 1 ELSE 0 END") for k in range(5)]
    lets += [(f"w{k}_", f"w{k} + {step!r}::DOUBLE") for k, step in enumerate((0.0, p / 2, p, (1 + p) / 2, 1.0))]
    left = ("q0_", "n0_")
    for k in (1, 2, 3):
        (ql, nl), (qr, nr) = left, (f"q{k + 1}" if k < 3 else "q4_", f"n{k + 1}_")
        here, place = f"q{k}", f"n{k}_"
        lets.append((f"s{k}", f"CASE WHEN w{k}_ - {place} >= 1 AND {nr} - {place} > 1 THEN 1 WHEN w{k}_ - {place} <= -1 AND {nl} - {place} < -1 THEN -1 ELSE 0 END"))
        lets.append((f"c{k}", f"{here} + s{k} / nullif({nr} - {nl}, 0) * (({place} - {nl} + s{k}) * ({qr} - {here}) / nullif({nr} - {place}, 0) + ({nr} - {place} - s{k}) * ({here} - {ql}) / nullif({place} - {nl}, 0))"))
        lets.append((f"l{k}", f"CASE WHEN s{k} > 0 THEN {here} + ({qr} - {here}) / nullif({nr} - {place}, 0) ELSE {here} - ({ql} - {here}) / nullif({nl} - {place}, 0) END"))
        lets.append((f"z{k}", f"CASE WHEN s{k} = 0 THEN {here} WHEN c{k} > {ql} AND c{k} < {qr} THEN c{k} ELSE l{k} END"))
        lets.append((f"y{k}", f"{place} + s{k}"))
        left = (f"z{k}", f"y{k}")
    lets += [("b_", "CASE WHEN started THEN b ELSE list_append(b, value) END"), ("full_", "NOT started AND m = 4"), ("o_", "list_sort(b_)")]
    first = (1.0, 1 + 2 * p, 1 + 4 * p, 3 + 2 * p, 5.0)
    new_q, new_n = ["q0_", "z1", "z2", "z3", "q4_"], ["n0_", "y1", "y2", "y3", "n4_"]
    after = {"m": "m + 1", "b": "b_"}
    after |= {q[k]: f"CASE WHEN full_ THEN o_[{k + 1}] WHEN started THEN {new_q[k]} ELSE 0.0 END" for k in range(5)}
    after |= {n[k]: f"CASE WHEN full_ THEN {k + 1} WHEN started THEN {new_n[k]} ELSE 0.0 END" for k in range(5)}
    after |= {w[k]: f"CASE WHEN full_ THEN {first[k]!r}::DOUBLE WHEN started THEN w{k}_ ELSE 0.0 END" for k in range(5)}
    body = scan(states, lets, after, "CASE WHEN full_ THEN o_[3] WHEN started THEN z2 END AS percentile")
    return f"SELECT channel, sample_idx, round(percentile, 6) AS percentile FROM ({body})"


@query(_sql_p_square(0.9))
def p_square(spark, d):
    return signals.streaming_percentile(A.samples(spark, d), 0.9).select(*IDS, r6(F.nullif("percentile", F.lit(float("nan"))), "percentile"))


# Clusters and models ------------------------------------------------------------------------------------


@query(
    f"WITH RECURSIVE s AS MATERIALIZED (SELECT label, vec_id, x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM {EM}), "
    "f AS (SELECT label, 0::BIGINT AS k, 0::BIGINT AS vec_id, []::DOUBLE[][] AS c, []::BIGINT[] AS held, 0::BIGINT AS cell, 0.0::DOUBLE AS distance, false AS created FROM (SELECT DISTINCT label FROM s) UNION ALL "
    "SELECT label, k, vec_id, CASE WHEN fits THEN list_concat(c[:best - 1], [[p[1] + (p[2] - p[1]) / least(held[best] + 1, 1000) FOR p IN list_zip(c[best], x)]], c[best + 1:]) ELSE list_append(c, x) END, "
    "CASE WHEN fits THEN list_concat(held[:best - 1], [held[best] + 1], held[best + 1:]) ELSE list_append(held, 1) END, CASE WHEN fits THEN best - 1 ELSE len(c) END, CASE WHEN fits THEN near ELSE 0 END, NOT fits "
    "FROM (SELECT *, list_position(far, near) AS best, len(c) > 0 AND (near <= 1.2 OR len(c) >= 32) AS fits FROM (SELECT *, list_min(far) AS near FROM (SELECT s.label, s.k, s.vec_id, s.x, f.c, f.held, [list_distance(one, s.x) FOR one IN f.c] AS far FROM f JOIN s ON s.label = f.label AND s.k = f.k + 1)))) "
    "SELECT label, vec_id AS seq, CAST(cell AS INT) AS cluster, round(distance, 6) AS distance, created FROM f WHERE k > 0"
)
def online_kmeans(spark, d):
    return models.online_clusters(A.vectors(spark, d), ["label"], "vec_id", 1.2).select("label", "seq", "cluster", r6("distance", "distance"), "created")


_CLASSES = f"SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS k, x FROM {LI}"
_LDA = (
    "WITH c AS (SELECT k, count(*) AS n, " + ", ".join(f"avg(x[{i + 1}]) AS m{i}" for i in range(4)) + ", " + ", ".join(f"covar_samp(x[{i + 1}], x[{j + 1}]) * (count(*) - 1) AS s{i}{j}" for i in range(4) for j in range(i, 4)) + f" FROM ({_CLASSES}) GROUP BY k), "
    "t AS (SELECT " + ", ".join(f"sum(s{i}{j}) AS s{i}{j}" for i in range(4) for j in range(i, 4)) + ", " + ", ".join(f"sum(CASE WHEN k = 0 THEN m{i} ELSE -m{i} END) AS h{i}, sum(m{i}) / 2 AS c{i}" for i in range(4)) + ", sum(n) AS n FROM c), "
    "g AS (SELECT *, " + ", ".join(f"0.99 * s{i}{j}{' + 0.01 * (s00 + s11 + s22 + s33) / 4' if i == j else ''} AS g{i}{j}" for i in range(4) for j in range(i, 4)) + " FROM t), "
    f"b AS (SELECT *, {_eliminated(4)} FROM g), "
    "w AS (SELECT *, " + ", ".join(f"b{i} / sqrt(b0 * b0 + b1 * b1 + b2 * b2 + b3 * b3) AS w{i}" for i in range(4)) + " FROM b) "
    "SELECT l_orderkey, l_linenumber, round(w0 * (x[1] - c0) + w1 * (x[2] - c1) + w2 * (x[3] - c2) + w3 * (x[4] - c3), 4) AS decision, CASE WHEN w0 * (x[1] - c0) + w1 * (x[2] - c1) + w2 * (x[3] - c2) + w3 * (x[4] - c3) >= 0 THEN 0 ELSE 1 END AS predicted "
    f"FROM {LI}, w"
)


@query(_LDA)
def lda_fit(spark, d):
    rows = _flags(spark, d)
    return models.fit_lda(rows).predict(rows).select("l_orderkey", "l_linenumber", F.round("decision", 4).alias("decision"), "predicted")


def _unit(n: int) -> str:
    return f"SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS cov FROM (SELECT CAST(unnest(range({n})) AS INT) AS i), (SELECT CAST(unnest(range({n})) AS INT) AS j) WHERE i <= j"


def _covariances(rows: DataFrame, x: str = "x") -> DataFrame:
    """Entries of a covariance, zeros without a sign."""
    return spatial.covariance(rows, x).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (F.round("cov", 3) + 0.0).alias("cov"))


@query(_unit(4))
def whitening_matrix(spark, d):
    """Whitened frames have unit covariance."""
    rows = _scaled(spark, d)
    return _covariances(spatial.apply_matrix(rows, spatial.fit_whitening(rows)))


@query(_unit(4))
def ica_sources(spark, d):
    """Sources have unit covariance, whatever their order and sign."""
    rows = _scaled(spark, d)
    return _covariances(models.fit_ica(rows).transform(rows), "sources")


_TOTAL = "SELECT " + ", ".join(f"var_samp(x[{k + 1}]) AS v{k}" for k in range(64)) + f" FROM {EM}"


@query("SELECT 3 AS components, 0.0::DOUBLE AS shared, round(" + " + ".join(f"v{k}" for k in range(64)) + f", 6) AS total FROM ({_TOTAL})")
def pca_features(spark, d):
    """Features share no variance with each other, and all components together have that of the data."""
    rows = A.vectors(spark, d)
    three = spatial.covariance(models.fit_pca(rows, 3).transform(rows), "features")
    whole = spatial.covariance(models.fit_pca(rows, 64).transform(rows), "features").where("i = j").agg(F.round(F.sum("cov"), 6).alias("total"))
    return three.agg((F.max("j") + 1).cast("int").alias("components"), (F.round(F.max(F.when(F.col("i") != F.col("j"), F.abs("cov")).otherwise(0.0)), 6) + 0.0).alias("shared")).select("*", whole.scalar().alias("total"))


@query("SELECT CAST(unnest(range(10)) AS INT) AS i, 0.0::DOUBLE AS mean")
def tangent_space(spark, d):
    """Logarithms at the Riemannian mean cancel out."""
    spd = _spd(spark, d)
    got = models.TangentSpaceTransformer()
    got.reference = models.frechet_mean(spd)
    column = [c for c, k in got.transform(spd).dtypes if k == "array<double>" and c != "m"][0]
    return got.transform(spd).select(F.posexplode(column).alias("i", "v")).groupBy("i").agg((F.round(F.avg("v"), 3) + 0.0).alias("mean"))


# Described pipelines ------------------------------------------------------------------------------------


@query(f"SELECT channel, sample_idx // 4 AS sample_idx, filtered AS value FROM ({_sql_cascade(_LOW)}) WHERE sample_idx % 4 = 0")
def described_pipeline(spark, d):
    """A low-pass and a decimation, as described, over the events."""
    stages = [pipeline.stage_of({"type": "lowpass", "cutoff": 10.0, "order": 4}, 100.0), pipeline.stage_of({"type": "decimate", "factor": 4}, 100.0)]
    rows = A.samples(spark, d).select("recording_id", "channel", "sample_idx", "value")
    return pipeline.apply(rows, stages).select("channel", "sample_idx", r6("value", "value"))


@query(
    f"WITH c AS (SELECT label, count(*) AS n, list(m ORDER BY i) AS mean FROM (SELECT label, i, avg(v) AS m, count(*) AS k FROM (SELECT label, unnest(range(64)) AS i, unnest(x) AS v FROM {EM}) GROUP BY label, i) GROUP BY label), "
    f"z AS (SELECT label, count(*) AS members FROM {EM} GROUP BY label), "
    f"o AS (SELECT c.label, z.members, list_distance(e.x, c.mean) ** 2 AS d FROM c JOIN z ON z.label = c.label JOIN {EM} e ON e.label <> c.label) "
    "SELECT label, round(max(CASE WHEN k = members THEN d END), 6) AS isolation FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d) AS k FROM o) GROUP BY label"
)
def isolation_rank(spark, d):
    """The same measure without the covariance."""
    return trains.isolation(A.vectors(spark, d), euclidean=True).select("label", r6("isolation", "isolation"))


def _sql_isolation() -> str:
    """Of all rows outside a class, the n-th least product of what they differ by with the solution of the class's covariance."""
    moments = ", ".join([f"avg(x[{i + 1}]) AS m{i}" for i in range(4)] + [f"covar_samp(x[{i + 1}], x[{j + 1}]) AS g{i}{j}" for i in range(4) for j in range(i, 4)])
    gaps = ", ".join(f"e.x[{i + 1}] - c.m{i} AS h{i}" for i in range(4))
    return (
        f"WITH c AS MATERIALIZED (SELECT l_returnflag AS label, count(*) AS members, {moments} FROM {_SCALED} GROUP BY label), "
        f"o AS (SELECT label, members, {' + '.join(f'h{i} * b{i}' for i in range(4))} AS d FROM (SELECT *, {_eliminated(4)} FROM (SELECT c.*, {gaps} FROM c JOIN {_SCALED} e ON e.l_returnflag <> c.label))) "
        "SELECT label, members, round(max(CASE WHEN k = members THEN d END), 5) AS isolation FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d) AS k FROM o) GROUP BY ALL"
    )


@query(_sql_isolation())
def isolation_distance(spark, d):
    rows = _scaled(spark, d).withColumnRenamed("l_returnflag", "label")
    return trains.isolation(rows).select("label", "members", F.round("isolation", 5).alias("isolation"))


@query(f"SELECT vec_id, round(list_sum([p[1] * p[2] FOR p IN list_zip(x, range(1, 65))]), 6) AS weighted, round(list_sum([p[1] * (p[2] % 2 * 2 - 1) FOR p IN list_zip(x, range(1, 65))]), 6) AS alternating FROM {EM}")
def apply_filters(spark, d):
    k = np.arange(64)
    rows = spatial.apply_matrix(A.vectors(spark, d), np.stack([k + 1.0, 1.0 - 2 * (k % 2)]), "x", "y")
    return rows.select("vec_id", r6(F.get("y", F.lit(0)), "weighted"), r6(F.get("y", F.lit(1)), "alternating"))


@query(f"SELECT vec_id, CAST(i AS INT) AS i, round(CASE WHEN i < 32 THEN v ELSE 0.5 * v END, 6) AS f FROM {_LISTED}")
def combine_features(spark, d):
    rows = A.vectors(spark, d).withColumn("a", F.slice("x", 1, 32)).withColumn("b", F.slice("x", 33, 32))
    return trains.combined_features(rows, "a", "b", 0.5).select("vec_id", F.posexplode("f").alias("i", "v")).select("vec_id", "i", r6("v", "f"))


# Fits and detections by what SQL can say of them --------------------------------------------------------

_BANDS = ", ".join(f"('{name}', {int(low // 3.125)}, {min(32, int(-(-high // 3.125)))})" for name, (low, high) in spectrum.BANDS.items())


@query(f"SELECT vec_id, band, round(sum((p + q) / 2), 9) AS power FROM (SELECT *, lead(p) OVER (PARTITION BY vec_id ORDER BY k) AS q FROM ({_PSD})) JOIN (VALUES {_BANDS}) AS t(band, a, b) ON k >= a AND k < b GROUP BY vec_id, band")
def sorter_bands(spark, d):
    rows = signals.band_powers(A.vectors(spark, d).select("vec_id", "x"), 200.0)
    named = F.explode(F.arrays_zip(F.array(*(F.lit(n) for n in spectrum.BANDS)).alias("band"), F.col("powers").alias("power"))).alias("z")
    return rows.select("vec_id", named).select("vec_id", "z.band", F.round("z.power", 9).alias("power"))


@query(
    f"WITH RECURSIVE e AS MATERIALIZED (SELECT s.sample_idx AS sample, s.channel, s.value AS amplitude, p.x, p.y, row_number() OVER (ORDER BY s.sample_idx, s.channel) AS k FROM {EV} s JOIN {_LONG} p ON p.channel = s.channel WHERE s.value > 80), "
    "n AS MATERIALIZED (SELECT a.k, list(struct_pack(k := b.k, larger := b.amplitude > a.amplitude) ORDER BY b.k) AS near FROM e a JOIN e b ON b.k > a.k AND b.sample - a.sample <= 2 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 45 * 45 GROUP BY a.k), "
    "f AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS dead, true AS stays UNION ALL "
    "SELECT k, CASE WHEN NOT stays0 THEN dead WHEN first IS NULL THEN list_concat(dead, [z.k FOR z IN open]) ELSE list_concat(dead, [z.k FOR z IN open[:first - 1]]) END, stays0 AND first IS NULL "
    "FROM (SELECT *, list_position([z.larger FOR z IN open], true) AS first, NOT list_contains(dead, k) AS stays0 FROM "
    "(SELECT e.k, [z FOR z IN f.dead IF z >= e.k] AS dead, coalesce([z FOR z IN n.near IF NOT list_contains(f.dead, z.k)], []) AS open FROM f JOIN e ON e.k = f.k + 1 LEFT JOIN n ON n.k = e.k))) "
    "SELECT e.sample, CAST(e.channel AS INT) AS channel, e.amplitude FROM f JOIN e ON e.k = f.k WHERE f.stays"
)
def event_dedup(spark, d):
    rows = A.samples(spark, d).where("value > 80").select("recording_id", F.col("sample_idx").alias("sample"), F.col("channel").cast("int").alias("channel"), F.col("value").alias("amplitude"))
    return signals.deduplicated(rows, _long_probe(spark, d), 45.0, 2).select("sample", "channel", "amplitude")




@query(f"SELECT round(avg(ln(g00) + ln(e0_1_1) + ln(e1_2_2) + ln(e2_3_3)), 4) AS log_volume FROM (SELECT *, {_eliminated(4)} FROM (SELECT *, 0.0 AS h0, 0.0 AS h1, 0.0 AS h2, 0.0 AS h3 FROM (SELECT l_orderkey % 50 AS trial_id, {_ENTRIES} FROM {_SCALED} GROUP BY trial_id)))")
def frechet_mean(spark, d):
    """The Riemannian mean's volume is the geometric mean of all volumes."""
    mean = models.frechet_mean(_spd(spark, d))
    return spark.createDataFrame([(float(np.linalg.slogdet(mean)[1]),)], "v double").select(F.round("v", 4).alias("log_volume"))


def _sql_shares() -> str:
    """Trace of (A + B)^-1 A of two classes: the sum of all shares that filters can have."""
    classes = f"(SELECT l_returnflag = 'R' AS k, {_ENTRIES} FROM {_SCALED} GROUP BY k)"
    first = ", ".join(f"max(CASE WHEN NOT k THEN g{i}{j} END) AS a{i}{j}" for i in range(4) for j in range(i, 4))
    both = ", ".join(f"sum(g{i}{j}){' + 1e-6' if i == j else ''} AS g{i}{j}" for i in range(4) for j in range(i, 4))
    parts = [f"(SELECT b{c} AS share FROM (SELECT {_eliminated(4)} FROM (SELECT *, {', '.join(f'a{min(i, c)}{max(i, c)} AS h{i}' for i in range(4))} FROM m)))" for c in range(4)]
    return f"WITH m AS MATERIALIZED (SELECT {both}, {first} FROM {classes}) SELECT round(sum(share), 4) AS shares, 0.0::DOUBLE AS mixed FROM ({' UNION ALL '.join(f'SELECT * FROM {p}' for p in parts)})"


@query(_sql_shares())
def csp_fit(spark, d):
    """Filters make both classes uncorrelated, and their shares of the first class add up to the trace of its share of both."""
    rows = _scaled(spark, d).withColumn("label", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    w = models.fit_csp(rows, 4)
    (_, a, _), (_, b, _) = models.class_covariances(rows).values()
    one, both = w @ a @ w.T, w @ (a + b + 1e-6 * np.eye(4)) @ w.T
    size = np.sqrt(np.outer(np.diag(both), np.diag(both)))
    mixed = max(np.abs((m / size)[~np.eye(4, dtype=bool)]).max() for m in (one, both))
    return spark.createDataFrame([(float((np.diag(one) / np.diag(both)).sum()), float(mixed))], "s double, m double").select(F.round("s", 4).alias("shares"), (F.round("m", 4) + 0.0).alias("mixed"))


# Event-time windows, scalars, and units against units -----------------------------------------------------


def _timed(spark, d):
    return A.table(spark, d, "events").select(F.col("user_id").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), "value")


def _windows(rows: DataFrame) -> DataFrame:
    return rows.select("channel", F.unix_seconds("start").alias("start"), "n", r6("mean", "mean"), r6("std", "std"))


def _sql_windows(hours: str) -> str:
    return f"SELECT user_id AS channel, h * 3600 AS start, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM (SELECT *, unnest({hours}) AS h FROM (SELECT *, epoch_us(ts) // 3600000000 AS hour FROM events)) GROUP BY user_id, h"


@query(_sql_windows("[hour]"))
def tumbling_windows(spark, d):
    return _windows(processors.windowed(_timed(spark, d), "1 hour", "1 hour"))


@query(_sql_windows("[hour - 1, hour]"))
def sliding_windows(spark, d):
    return _windows(processors.windowed(_timed(spark, d), "2 hours", "1 hour", "1 hour"))


@query(
    "WITH s AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "r AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS run FROM s) "
    "SELECT user_id AS channel, min(t) AS start, max(t) + 21600000000 AS stop, count(*) AS n FROM r GROUP BY user_id, run"
)
def session_windows(spark, d):
    return processors.bursts(_timed(spark, d), "6 hours", "1 hour").select("channel", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("stop"), "n")


@query(f"SELECT channel, sample_idx, round(lgamma(value + 1), 6) AS lgamma, CASE WHEN value < 40 THEN -value ELSE value END AS signed, true AS finite FROM {EV}")
def special_functions(spark, d):
    pipeline.register_functions(spark)
    v = F.col("value")
    return A.samples(spark, d).select(*IDS, r6(F.call_function("signal_lgamma", v + 1), "lgamma"), C.copysign(v, v - 40).alias("signed"), C.is_finite(v).alias("finite"))


_VOLUME = "ln(g00) + ln(e0_1_1) + ln(e1_2_2) + ln(e2_3_3)"


def _sql_volumes(entries: str) -> str:
    return f"SELECT *, {_VOLUME} AS v FROM (SELECT *, {_eliminated(4)} FROM (SELECT *, 0.0 AS h0, 0.0 AS h1, 0.0 AS h2, 0.0 AS h3 FROM {entries}))"


_TRIALS = f"(SELECT l_orderkey % 50 AS trial_id, {_ENTRIES} FROM {_SCALED} GROUP BY trial_id)"
_MEAN = f"(SELECT {', '.join(f'avg(g{i}{j}) AS g{i}{j}' for i in range(4) for j in range(i, 4))} FROM {_TRIALS})"


@query(f"SELECT t.trial_id, round(t.v - m.v, 4) AS log_volume FROM ({_sql_volumes(_TRIALS)}) t, ({_sql_volumes(_MEAN)}) m")
def recentered_volumes(spark, d):
    """Trials moved so that their mean becomes the unit matrix lose its volume."""
    spd = _spd(spark, d)
    mean = models.summed(spd, lambda r: np.r_[len(r), r.sum(axis=0)], "m")
    moved = models.recentered(spd.select("trial_id", "m"), (mean[1:] / mean[0]).reshape(4, 4))
    return signals.of_arrays(moved.select("trial_id", "m2"), lambda r: np.linalg.slogdet(r.reshape(-1, 4, 4))[1][:, None], "m2", "v").select("trial_id", F.round(F.get("v", F.lit(0)), 4).alias("log_volume"))


_UNITS = "SELECT user_id % 5 AS unit, epoch_us(ts) // 3600000000 AS s, event_id FROM events WHERE event_type = "


@query(
    f"WITH RECURSIVE a AS MATERIALIZED (SELECT unit AS gt, s, row_number() OVER (PARTITION BY unit ORDER BY s, event_id) AS k FROM ({_UNITS}'error')), "
    f"b AS MATERIALIZED (SELECT unit AS st, list(s ORDER BY s) AS found FROM ({_UNITS}'click') GROUP BY unit), "
    "m AS (SELECT gt, st, 0::BIGINT AS k, found AS free, 0::BIGINT AS tp FROM (SELECT DISTINCT gt FROM a), b UNION ALL "
    "SELECT gt, st, k, CASE WHEN hit IS NULL THEN free ELSE list_concat(free[:hit - 1], free[hit + 1:]) END, tp + CAST(hit IS NOT NULL AS BIGINT) "
    "FROM (SELECT m.gt, m.st, a.k, m.free, m.tp, list_position([f >= a.s - 1 AND f <= a.s + 1 FOR f IN m.free], true) AS hit FROM m JOIN a ON a.gt = m.gt AND a.k = m.k + 1)) "
    "SELECT gt, st, tp, len(free) AS fp, k - tp AS fn, round(tp / (len(free) + k), 6) AS accuracy FROM (SELECT *, max(k) OVER (PARTITION BY gt, st) AS last FROM m) WHERE k = last AND tp > 0"
)
def sorting_coincidences(spark, d):
    rows = A.table(spark, d, "events").select((F.col("user_id") % 5).alias("unit"), "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("sample"))
    pick = lambda k: rows.where(F.col("event_type") == k).select("unit", "sample")
    return signals.coincidences(pick("error"), pick("click"), 1).where("tp > 0").select("gt", "st", "tp", "fp", "fn", r6("accuracy", "accuracy"))


@query(
    "WITH RECURSIVE q AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY accuracy DESC, gt, st) AS i FROM (" + ORACLE_SQL["sorting_coincidences"].replace("round(tp / (len(free) + k), 6)", "tp / (len(free) + k)") + ")), "
    "g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS a, []::BIGINT[] AS b, false AS taken UNION ALL "
    "SELECT i, CASE WHEN free THEN list_append(a, gt) ELSE a END, CASE WHEN free THEN list_append(b, st) ELSE b END, free FROM (SELECT q.i, g.a, g.b, q.gt, q.st, NOT list_contains(g.a, q.gt) AND NOT list_contains(g.b, q.st) AS free FROM g JOIN q ON q.i = g.i + 1)) "
    "SELECT gt, st, tp, fp, fn, round(accuracy, 6) AS accuracy FROM g JOIN q ON q.i = g.i WHERE taken"
)
def sorting_assignment(spark, d):
    """Errors against clicks of other users, one to one by accuracy."""
    rows = A.table(spark, d, "events").select((F.col("user_id") % 5).alias("unit"), "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("sample"))
    pick = lambda k: rows.where(F.col("event_type") == k).select("unit", "sample")
    return signals.sorting_pairs(pick("error"), pick("click"), 1).select("gt", "st", "tp", "fp", "fn", r6("accuracy", "accuracy"))


# Recurrences in blocks of a few samples, by the SQL of the whole channel -----------------------------------


@query(ORACLE_SQL["envelope_follower"])
def envelope_in_blocks(spark, d):
    return signals.envelope(A.samples(spark, d), 100.0, 0.01, 0.1, block=16).select(*IDS, r6("envelope", "envelope"))


def _adapted_in_blocks(spark, d, *options):
    rows = signals.adaptive(A.samples(spark, d).withColumn("target", F.col("value") / 2), "target", 4, *options, block=16)
    return rows.select(*IDS, r6("output", "output"), r6("error", "error"))


@query(ORACLE_SQL["lms_filter"])
def lms_in_blocks(spark, d):
    return _adapted_in_blocks(spark, d, 1.2345678e-5)


@query(ORACLE_SQL["nlms_filter"])
def nlms_in_blocks(spark, d):
    return _adapted_in_blocks(spark, d, 0.5, 0.01)


@query(ORACLE_SQL["firmware_detector"])
def firmware_in_blocks(spark, d):
    return signals.firmware_hits(A.samples(spark, d).withColumn("value", F.col("value") * 50), 4.0, 16).select("channel", "sample")
