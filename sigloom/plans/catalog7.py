"""Seventh part of the catalogue: curation of clusters on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.operators import curation
from sigloom.plans import adapters as A
from sigloom.plans.catalog import EM, query

_FIELDS = ("n", "s1", "s2", "q11", "q12", "q22")


def _along(c: str) -> str:
    """Variance of a cluster's points along the line (gx, gy)."""
    cov = {"11": ("s1", "s1"), "12": ("s1", "s2"), "22": ("s2", "s2")}
    xx, xy, yy = (f"CASE WHEN {c}.n > 1 THEN ({c}.q{k} - {c}.{a} * {c}.{b} / {c}.n) / ({c}.n - 1) ELSE 0 END" for k, (a, b) in cov.items())
    return f"(g[1] * g[1] * ({xx}) + 2 * g[1] * g[2] * ({xy}) + g[2] * g[2] * ({yy})) / (g[1] * g[1] + g[2] * g[2])"


def _sql_merge(most: float) -> str:
    """A recording's clusters as a list that loses one in each step, while its closest pair is close enough."""
    gap = "[u.s1 / u.n - v.s1 / v.n, u.s2 / u.n - v.s2 / v.n]"
    far = "CASE WHEN {g}[1] ** 2 + {g}[2] ** 2 < 1e-24 THEN 0 ELSE sqrt({g}[1] ** 2 + {g}[2] ** 2) / sqrt((" + _along("u").replace("g[", "{g}[") + " + " + _along("v").replace("g[", "{g}[") + ") / 2) END"
    pairs = f"flatten([[struct_pack(d := {far.format(g=gap)}, a := u.c, b := v.c) FOR v IN cl IF v.c > u.c] FOR u IN cl])"
    joined = ", ".join(f"{k} := z.{k} + w.{k}" for k in _FIELDS)
    return (
        "WITH RECURSIVE s AS (SELECT vec_id % 3 AS rec, label AS c, count(*)::DOUBLE AS n, sum(x[1]) AS s1, sum(x[2]) AS s2, sum(x[1] * x[1]) AS q11, sum(x[1] * x[2]) AS q12, sum(x[2] * x[2]) AS q22 "
        f"FROM {EM} GROUP BY ALL), "
        f"f AS (SELECT rec, true AS go, list(struct_pack(c := c, ls := [c], {', '.join(f'{k} := {k}' for k in _FIELDS)}) ORDER BY c) AS cl FROM s GROUP BY rec UNION ALL "
        f"SELECT rec, near, CASE WHEN near THEN [CASE WHEN z.c = best.a THEN struct_pack(c := z.c, ls := list_concat(z.ls, w.ls), {joined}) ELSE z END FOR z IN cl IF z.c <> best.b] ELSE cl END "
        f"FROM (SELECT *, coalesce(best.d <= {most}, false) AS near, [z FOR z IN cl IF z.c = best.b][1] AS w FROM (SELECT rec, cl, list_min({pairs}) AS best FROM f WHERE go))) "
        "SELECT rec AS recording_id, unnest(z.ls) AS label, z.c AS cluster FROM (SELECT rec, unnest(cl) AS z FROM f WHERE NOT go)"
    )


@query(_sql_merge(0.25))
def curate_merge(spark, d):
    """Clusters of the vectors' first two components, the closest pair of each recording first."""
    rows = A.vectors(spark, d).select((F.col("vec_id") % 3).alias("recording_id"), "label", F.col("vec_id").alias("sample"), F.slice("x", 1, 2).alias("x"))
    return curation.merged(rows, 0.25).select("recording_id", F.col("label").cast("int").alias("label"), F.col("cluster").cast("int").alias("cluster"))


_SPIKES = "(SELECT 0 AS recording_id, user_id AS label, event_id, epoch_us(ts) // 3600000000 AS sample, value AS amplitude, value AS x, (event_id * 37 % 101)::DOUBLE AS y FROM events)"


def _spikes(spark, d):
    sample = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    x = F.array("value", (F.col("event_id") * 37 % 101).cast("double"))
    return A.table(spark, d, "events").select(F.lit(0).cast("long").alias("recording_id"), F.col("user_id").alias("label"), "event_id", sample.alias("sample"), F.col("value").alias("amplitude"), x.alias("x"))


#: Labels of the upper sides of those cuts that leave enough on both sides.
_FRESH = (
    "n AS (SELECT label, count(*) AS n, count(*) FILTER (above) AS up FROM u GROUP BY label), "
    "k AS (SELECT label, (SELECT max(label) FROM n) + row_number() OVER (ORDER BY label) AS fresh FROM n WHERE up >= {least} AND n - up >= {least}) "
    "SELECT event_id, u.label, CASE WHEN above AND fresh IS NOT NULL THEN fresh ELSE u.label END AS cluster FROM u LEFT JOIN k ON k.label = u.label"
)


def _sql_split(refractory: int, limit: float, bimodality: float, least: int) -> str:
    steps, v = [], ("1.0::DOUBLE", "1.0::DOUBLE")
    for k in range(3):
        a, b = f"(xx * {v[0]} + xy * {v[1]})", f"(xy * {v[0]} + yy * {v[1]})"
        steps.append(f"a{k} AS (SELECT *, {a} / sqrt({a} ** 2 + {b} ** 2) AS v{k}, {b} / sqrt({a} ** 2 + {b} ** 2) AS w{k} FROM {f'a{k - 1}' if k else 'm'})")
        v = (f"v{k}", f"w{k}")
    return (
        f"WITH s AS MATERIALIZED (SELECT * FROM {_SPIKES}), m AS (SELECT label, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, covar_pop(x, y) AS xy, var_pop(y) AS yy FROM s GROUP BY label), {', '.join(steps)}, "
        "p AS MATERIALIZED (SELECT s.*, (x - mx) * v2 + (y - my) * w2 AS p FROM s JOIN a2 ON a2.label = s.label), "
        "g AS (SELECT label, p, lead(p) OVER (PARTITION BY label ORDER BY p) - p AS gap, lag(sample) OVER (PARTITION BY label ORDER BY sample) AS before, sample FROM p), "
        f"c AS (SELECT label, CASE WHEN count(*) >= {2 * least} THEN CASE WHEN max(gap) > {bimodality} * stddev_pop(p) THEN arg_max(p + gap / 2, gap) WHEN avg(CASE WHEN sample - before < {refractory} THEN 1.0 WHEN before IS NOT NULL THEN 0.0 END) > {limit} THEN median(p) END END AS cut FROM g GROUP BY label), "
        f"u AS MATERIALIZED (SELECT p.label, event_id, coalesce(p > cut, false) AS above FROM p JOIN c ON c.label = p.label), {_FRESH.format(least=least)}"
    )


@query(_sql_split(6, 0.12, 0.9, 10))
def curate_split(spark, d):
    """Users cut at wide gaps of their main axis, or in halves where events follow each other within hours."""
    return curation.split(_spikes(spark, d), 6, 0.12, 0.9, 10).select("event_id", "label", "cluster")


def _sql_split_amplitude(bimodality: float, least: int) -> str:
    return (
        f"WITH s AS MATERIALIZED (SELECT *, row_number() OVER w AS k, lead(amplitude) OVER w AS next, count(*) OVER (PARTITION BY label) AS n FROM {_SPIKES} WINDOW w AS (PARTITION BY label ORDER BY amplitude)), "
        f"g AS (SELECT label, arg_max(struct_pack(k := k, low := amplitude, high := next), (next - amplitude, -k)) AS g, max(next - amplitude) AS gap FROM s WHERE k >= {least} AND k <= n - {least} GROUP BY label), "
        "o AS (SELECT s.label, k > g.g.k AS up, amplitude, median(amplitude) OVER (PARTITION BY s.label, k > g.g.k) AS middle FROM s JOIN g ON g.label = s.label), "
        "d AS (SELECT label, max(spread) AS spread FROM (SELECT label, up, median(abs(amplitude - middle)) / 0.6745 AS spread FROM o GROUP BY ALL) GROUP BY label), "
        f"u AS MATERIALIZED (SELECT s.label, event_id, coalesce(amplitude > CASE WHEN gap >= {2 * bimodality} * spread THEN (g.g.low + g.g.high) / 2 END, false) AS above FROM s LEFT JOIN g ON g.label = s.label LEFT JOIN d ON d.label = s.label), {_FRESH.format(least=1)}"
    )


@query(_sql_split_amplitude(0.25, 10))
def curate_split_amplitude(spark, d):
    return curation.split_by_amplitude(_spikes(spark, d), 0.25, 10).select("event_id", "label", "cluster")
