"""Third part of the catalogue: models, sorting, generated recordings and described pipelines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigloom.functions import columns as C
from sigloom.operators import models, signals, sorter, spatial
from sigloom.plans import adapters as A
from sigloom.plans import pipeline
from sigloom.plans.catalog import EM, LI, query, r6
from sigloom.plans.catalog2 import scan
from sigloom.sources import packets, synthetic


def _flags(spark, d):
    """Frames of line items with two classes: returned or not."""
    return A.frames(spark, d).withColumn("label", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))


def _fixed(spark, name: str, values) -> object:
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(np.asarray(values, float).reshape(-1))], f"i int, {name} double")


@query(f"SELECT l_orderkey, l_linenumber, round(x[1] + 2 * x[3], 6) AS y0, round(x[2] / 1000 - x[4], 6) AS y1 FROM {LI}")
def spatial_filter(spark, d):
    rows = spatial.apply_matrix(A.frames(spark, d), np.array([[1, 0, 2, 0], [0, 0.001, 0, -1]]), "x", "y")
    return rows.select("l_orderkey", "l_linenumber", r6(F.get("y", F.lit(0)), "y0"), r6(F.get("y", F.lit(1)), "y1"))


@query(f"SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, round(ln(var_pop(x[1] + 0.001::DOUBLE * x[2] - 20 * x[3]) + 1e-10), 6) AS f0, round(ln(var_pop(10 * x[3] - 5 * x[4] + 0.1::DOUBLE * x[1]) + 1e-10), 6) AS f1 FROM {LI} GROUP BY ALL")
def csp_features(spark, d):
    rows = models.csp_features(_flags(spark, d), np.array([[1.0, 0.001, -20.0, 0], [0.1, 0, 10.0, -5.0]]), ["label"])
    return rows.select("label", r6(F.get("features", F.lit(0)), "f0"), r6(F.get("features", F.lit(1)), "f1"))


_CELLS = ", ".join(f"covar_samp(x[{min(i, j) + 1}], x[{max(i, j) + 1}])" for i in range(4) for j in range(4))


@query(f"SELECT l_returnflag, CAST(unnest(range(16)) AS INT) AS i, round(unnest(m), 4) AS c FROM (SELECT l_returnflag, [{_CELLS}] AS m FROM {LI} GROUP BY l_returnflag)")
def trial_covariances(spark, d):
    rows = models.trial_covariances(A.frames(spark, d), ["l_returnflag"])
    return rows.select("l_returnflag", F.posexplode("m").alias("i", "c")).withColumn("c", F.round("c", 4))


_PACKET = "event_id % 256, event_id // 256 % 256, event_id // 65536 % 256, event_id // 16777216 % 256, user_id % 256, (a + 65536) % 256, (a + 65536) // 256 % 256"


@query(f"SELECT event_id, printf('%02x%02x%02x%02x%02x00%02x%02x', {_PACKET}) AS packet FROM (SELECT *, CAST(trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, value / 1000)) * 32767.0::DOUBLE) AS BIGINT) AS a FROM events)")
def spike_packets(spark, d):
    rows = A.table(spark, d, "events").select("event_id", F.col("event_id").alias("sample"), (F.col("user_id") % 256).alias("channel"), F.lit(0).alias("cluster_id"), (F.col("value") / 1000).alias("amplitude"))
    return packets.with_packets(rows).select("event_id", F.lower(F.hex("packet")).alias("packet"))


@query("SELECT event_id, CAST(event_id % 65536 - 32768 AS INT) AS signed FROM events")
def adc_samples(spark, d):
    return A.table(spark, d, "events").select("event_id", packets.adc_signed(F.col("event_id") % 65536).alias("signed"))


_QUIET = " UNION ALL ".join(f"SELECT {4 * i + j} AS i, covar_samp(x[{i + 1}], x[{j + 1}]) AS c FROM {LI} WHERE x[1] < 40 AND x[2] < 40000 AND x[3] < 0.06 AND x[4] < 0.06" for i in range(4) for j in range(4))


@query(f"SELECT i, round(c, 4) AS c FROM ({_QUIET})")
def quiet_covariance(spark, d):
    cov = spatial.quiet_covariance(A.frames(spark, d), [20.0, 20000.0, 0.03, 0.03], 2.0, 100)
    return _fixed(spark, "c", cov).select("i", F.round("c", 4).alias("c"))


def _scaled(spark, d):
    return A.frames(spark, d).withColumn("x", F.array(F.get("x", F.lit(0)) / 50, F.get("x", F.lit(1)) / 50000, F.get("x", F.lit(2)) * 10, F.get("x", F.lit(3)) * 10))


@query()
def csp_multiclass(spark, d):
    return _fixed(spark, "w", models.fit_multiclass_csp(A.frames(spark, d).withColumnRenamed("l_returnflag", "label"), 2))


@query()
def xdawn_fit(spark, d):
    rows = _flags(spark, d).withColumn("t", F.col("l_linenumber") - 1)
    return _fixed(spark, "w", models.fit_xdawn(rows, 2))


def _spd(spark, d):
    rows = _scaled(spark, d).withColumn("trial_id", F.col("l_orderkey") % 50)
    spd = models.trial_covariances(rows, ["trial_id"])
    return spd.select("trial_id", (F.col("trial_id") % 2).cast("int").alias("label"), F.transform("m", lambda v: v + 0.0).alias("m"))


@query()
def mdm_classifier(spark, d):
    rows = _spd(spark, d)
    return models.fit_mdm(rows).predict(rows)


def _epochs(spark, d):
    """Trials of a customer's orders: two channels over time."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = F.array(F.col("o_totalprice") / 100_000, F.col("o_totalprice") % 1000 / 1000)
    return A.table(spark, d, "orders").select(F.col("o_custkey").alias("trial_id"), (F.row_number().over(order) - 1).cast("int").alias("t"), x.alias("x"))


def _sql_ssvep(fs: float, frequencies: tuple[float, float]) -> str:
    """The first canonical correlation of two channels with a sine and a cosine, from the trace and determinant of a matrix of two by two."""
    sides = {"x0": "o_totalprice / 100000", "x1": "o_totalprice % 1000 / 1000"}
    waves = {f"{w}{k}": f"{f}(2 * pi() * {v} * t / {fs})" for k, v in enumerate(frequencies) for w, f in (("s", "sin"), ("c", "cos"))}
    cov = lambda a, b: f"coalesce(covar_samp({a}, {b}), 0){' + 1e-6' if a == b else ''}"
    out = [f"{cov(a, b)} AS a{i}{j}" for i, a in enumerate(sides) for j, b in enumerate(sides) if i <= j]
    scores = []
    for k in range(2):
        y = (f"s{k}", f"c{k}")
        out += [f"{cov(a, b)} AS b{k}{i}{j}" for i, a in enumerate(y) for j, b in enumerate(y) if i <= j]
        out += [f"{cov(a, b)} AS k{k}{i}{j}" for i, a in enumerate(sides) for j, b in enumerate(y)]
        da, db = "(a00 * a11 - a01 * a01)", f"(b{k}00 * b{k}11 - b{k}01 * b{k}01)"
        m = lambda i, j, k=k: f"(k{k}{i}0 * (b{k}11 * k{k}{j}0 - b{k}01 * k{k}{j}1) + k{k}{i}1 * (b{k}00 * k{k}{j}1 - b{k}01 * k{k}{j}0))"
        trace = f"((a11 * {m(0, 0)} - 2 * a01 * {m(0, 1)} + a00 * {m(1, 1)}) / {da} / {db})"
        det = f"((k{k}00 * k{k}11 - k{k}01 * k{k}10) ** 2 / {da} / {db})"
        scores.append(f"least(1, sqrt(greatest(0, ({trace} + sqrt(greatest(0, {trace} ** 2 - 4 * {det}))) / 2))) AS r{k}")
    return (
        f"SELECT trial_id, CASE WHEN r1 > r0 THEN {frequencies[1]} ELSE {frequencies[0]} END::DOUBLE AS frequency, round(greatest(r0, r1), 5) AS correlation FROM (SELECT trial_id, {', '.join(scores)} FROM "
        f"(SELECT trial_id, {', '.join(out)} FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in waves.items())} FROM (SELECT o_custkey AS trial_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS t, {', '.join(f'{e} AS {n}' for n, e in sides.items())} FROM orders)) GROUP BY trial_id))"
    )


@query(_sql_ssvep(10.0, (1.0, 2.0)))
def ssvep_detect(spark, d):
    return models.ssvep(_epochs(spark, d), "trial_id", 10.0, [1.0, 2.0], 1).select("trial_id", "frequency", F.round("correlation", 5).alias("correlation"))


_TRACK = scan(
    {"a": "40.0::DOUBLE", "b": "0.0::DOUBLE", "p": "100.0::DOUBLE", "q": "0.0::DOUBLE", "r": "1.0::DOUBLE"},
    [("a1", "a + b"), ("p1", "p + 2 * q + r + 0.1::DOUBLE"), ("q1", "q + r"), ("r1", "r + 0.1::DOUBLE"), ("k0", "p1 / (p1 + 100)"), ("k1", "q1 / (p1 + 100)"), ("v", "value - a1"), ("s0", "a1 + k0 * v"), ("s1", "b + k1 * v")],
    {"a": "s0", "b": "s1", "p": "(1 - k0) * p1", "q": "(1 - k0) * q1", "r": "r1 - k1 * q1"},
    "s0, s1, v",
)


@query(f"SELECT channel AS track_id, sample_idx AS t, round(s0, 6) AS position, round(s1, 6) AS speed, round(v, 6) AS innovation FROM ({_TRACK})")
def kalman_track(spark, d):
    rows = A.samples(spark, d).select(F.col("channel").alias("track_id"), F.col("sample_idx").alias("t"), F.array("value").alias("z"))
    got = models.kalman(rows, "track_id", [[1, 1], [0, 1]], [[1, 0]], [[0.1, 0], [0, 0.1]], [[100.0]], [40, 0], [[100, 0], [0, 1]])
    first = lambda c, k=0: F.get(c, F.lit(k))
    return got.select("track_id", "t", r6(first("state"), "position"), r6(first("state", 1), "speed"), r6(first("innovation"), "innovation"))


@query()
def monopole_fit(spark, d):
    rows = A.samples(spark, d).withColumn("amplitude", F.col("value"))
    return models.monopoles(rows.join(spatial.polytrode(spark, 2048, 2, 32.0, 20.0), "channel"), ["sample_idx"], 10.0)


_STARTS = [[0.2, 0.3, 0.2, 0.2], [0.5, 0.8, 0.5, 0.4], [0.9, 1.2, 0.8, 0.6]]
_UPPER = [(i, j) for i in range(4) for j in range(i, 4)]


def _sql_gmm(rounds: int = 50) -> str:
    """EM as a recurrence whose state is a row for each component. Its covariance is eliminated once; a point's distance is what elimination leaves of it."""
    factors, g = [], {(i, j): f"g{min(i, j)}{max(i, j)}" for i in range(4) for j in range(4)}
    for k in range(3):
        for i in range(k + 1, 4):
            factors.append(f"{g[i, k]} / {g[k, k]} AS f{k}{i}")
            factors += [f"{g[i, j]} - f{k}{i} * {g[k, j]} AS e{k}{i}{j}" for j in range(k + 1, 4)]
        g |= {(i, j): f"e{k}{i}{j}" for i in range(k + 1, 4) for j in range(k + 1, 4)}
    pivots = [g[k, k] for k in range(4)]
    rest = [f"x{i} - m{i}" + "".join(f" - f{k}{i} * y{k}" for k in range(i)) + f" AS y{i}" for i in range(4)]
    log = f"ln(greatest(w, 1e-300)) - 0.5 * (4 * ln(2 * pi()) + {' + '.join(f'y{k} * y{k} / {p}' for k, p in enumerate(pivots))} + {' + '.join(f'ln({p})' for p in pivots)}) AS lp"
    points = "(SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_quantity / 50 AS x0, l_extendedprice / 50000 AS x1, l_discount * 10 AS x2, l_tax * 10 AS x3 FROM lineitem)"
    told = lambda state: f"(SELECT *, {log} FROM (SELECT *, {', '.join(rest)} FROM (SELECT *, {', '.join(factors)} FROM {state}), q))"
    share = f"(SELECT *, exp(lp - norm) AS r FROM (SELECT *, top + ln(sum(exp(lp - top)) OVER (PARTITION BY id)) AS norm FROM (SELECT *, max(lp) OVER (PARTITION BY id) AS top FROM {told('f WHERE NOT still AND step < ' + str(rounds))})))"
    sums = ", ".join([f"sum(r * x{i}) AS a{i}" for i in range(4)] + [f"sum(r * x{i} * x{j}) AS b{i}{j}" for i, j in _UPPER])
    new = ", ".join([f"a{i} / h AS m{i}" for i in range(4)] + [f"b{i}{j} / h - a{i} / h * (a{j} / h){' + 1e-6' if i == j else ''} AS g{i}{j}" for i, j in _UPPER])
    first = ", ".join([f"c[{i + 1}] AS m{i}" for i in range(4)] + [f"(SELECT covar_samp(x{i}, x{j}) FROM q){' + 1e-6' if i == j else ''} AS g{i}{j}" for i, j in _UPPER])
    return (
        f"WITH RECURSIVE q AS MATERIALIZED (SELECT * FROM {points}), "
        f"f AS (SELECT 0::BIGINT AS step, k, 1.0::DOUBLE / 3 AS w, {first}, '-inf'::DOUBLE AS ll, false AS still FROM (SELECT unnest([0, 1, 2]) AS k, unnest({_STARTS}::DOUBLE[][]) AS c) UNION ALL "
        f"SELECT step + 1, k, h / n, {new}, s, abs(s - ll) / n < 1e-6 FROM (SELECT step, k, ll, greatest(sum(r), 1e-12) AS h, count(*) AS n, sum(norm) AS s, {sums} FROM {share} GROUP BY step, k, ll)) "
        f"SELECT l_orderkey, l_linenumber, CAST(arg_min(k, (-lp, k)) AS INT) AS component FROM {told('(SELECT * FROM f WHERE step = (SELECT max(step) FROM f))')} GROUP BY id, l_orderkey, l_linenumber"
    )


@query(_sql_gmm())
def gmm_components(spark, d):
    rows = _scaled(spark, d)
    return models.fit_gmm(rows, np.array(_STARTS)).predict(rows).select("l_orderkey", "l_linenumber", "component")


@query()
def channel_sorter(spark, d):
    return sorter.channel_spikes(A.samples(spark, d).withColumn("value", 40 - F.col("value")), 1000.0, 1.0, 8, 3)


@query()
def spike_sorter(spark, d):
    """A generated recording of 16 channels, sorted in segments of a second."""
    frames, _ = synthetic.recording(spark, channels=16, seconds=4.0, units=4, rate=15.0)
    xy = np.c_[np.zeros(16), np.arange(16) * 25.0]
    return sorter.joined_segments(sorter.sort_segments(frames, xy, sorter.SortConfig(), 30_000, 200))


@query(f"SELECT label, 0.0::DOUBLE AS x, round(sum(w * (vec_id % 8) * 25) / sum(w), 6) AS y FROM (SELECT label, vec_id, list_max([abs(v) FOR v IN x]) AS w FROM {EM}) GROUP BY label")
def cluster_profiles(spark, d):
    rows = spatial.localize(A.vectors(spark, d).select("label", (F.col("vec_id") % 8).alias("channel"), "x"), spatial.linear_probe(spark, 8, 25.0), ["label"])
    return rows.select("label", "x", r6("y", "y"))


@query(f"SELECT vec_id, round(list_distance(x, list_reverse(x)), 6) AS distance FROM {EM}")
def template_distances(spark, d):
    return A.vectors(spark, d).select("vec_id", r6(C.euclidean("x", F.reverse("x")), "distance"))


