"""URL filter with redirect equivalence, by DataFrame operations only.

Rules block or allow a host with all of its subdomains below a path; the longest rule that fits a url decides. Pages
whose html names other addresses (canonical links, or refreshes that redirect, all of them, but for those in comments,
scripts, styles and templates) are aliases of these: connected components
over these links carry block decisions to all aliases that no rule decides. An allow rule on any address of a component
takes precedence, and a url with a rule of its own always keeps that rule's verdict.

A url's host runs from after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; its path from there
up to ``?``, ``#`` or the end. Urls that are null or have no ``://`` have neither, fit no rule and are allowed. Addresses
that differ by their fragment, by dot segments, by an empty path instead of ``/``, or by the case of host or scheme, are the
same node. Null or empty html has no links;
repeated pages are judged each; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import durable
from sigloom.llm.components import connected_components

#: (verdict, host, path) of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: What hides tags; the tags that link, their ``rel`` and target; as patterns that Java and RE2 read alike.
HIDDEN = r"""(?is)<!--.*?-->|<!--.*$|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<noscript\b.*?</noscript\s*>"""
LINK = r"""(?is)<link\s[^>]*>"""
CANONICAL = r"""(?is)\srel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"""
META = r"""(?is)<meta\s[^>]*>"""
REFRESH = r"""(?is)\shttp-equiv\s*=\s*["']?\s*refresh\b"""
HREF = r"""(?is)\shref\s*=\s*["']?\s*([^"'\s>]+)"""
TARGET = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>;]+)"""


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, *LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without its dot segments; empty paths are ``/``."""
    parts = F.split(path, "/")
    step = lambda done, part: F.when(part == ".", done).when(part == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), part))
    walked = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""), step)
    return F.when(path.rlike("/[.]{1,2}(/|$)"), F.concat(walked, F.when(path.rlike("/[.]{1,2}$"), F.lit("/")).otherwise(F.lit("")))).when(path == "", F.lit("/")).otherwise(path)


def node_of(url: Column) -> Column:
    """The address that a url leads to: scheme and host in lower case, without dot segments and fragment."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), *LOWER)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), without_dots(path_of(url)), query))


def links_of(html: Column) -> Column:
    """All targets that a page's canonical links and refreshes name, as they stand there."""
    shown = F.when(html.rlike("(?i)canonical|refresh"), F.regexp_replace(html, HIDDEN, " "))
    of = lambda tags, told, target: F.transform(F.filter(F.regexp_extract_all(shown, F.lit(tags), F.lit(0)), lambda t: t.rlike(told)), lambda t: F.regexp_extract(t, target, 1))
    return F.filter(F.concat(of(LINK, CANONICAL, HREF), of(META, REFRESH, TARGET)), lambda x: x != "")


def resolved(link: Column, url: Column) -> Column:
    """A link as an absolute address, seen from a page's url."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme, site = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(folder, link))
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; of equal lengths, allow."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """(key, host, path, rule, verdict) of every page."""
    u = F.col(url)
    host, path = host_of(u), path_of(u)
    rule, verdict = rule_of(host, path, rules)
    links = F.coalesce(F.transform(links_of(F.col(html)), lambda x: node_of(resolved(x, u))), F.array().cast("array<string>"))
    base = durable(pages.select(F.col(key), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("own"), node_of(u).alias("node"), links.alias("links")))
    links = base.where(F.size("links") > 0).select(F.col("node").alias("a"), F.explode("links").alias("b"))
    named = connected_components(links)
    told = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)[1]
    by_component = named.groupBy("component").agg(F.bool_or(told == "block").alias("blocked"), F.bool_or(told == "allow").alias("allowed"))
    spread = named.join(by_component.where("blocked and not coalesce(allowed, false)"), "component").select("node", F.lit("block").alias("passed"))
    return base.join(spread, "node", "left").select(key, "host", "path", "rule", F.coalesce("own", "passed", F.lit("allow")).alias("verdict"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def _sql_host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{LOWER[0]}', '{LOWER[1]}')"


def _sql_path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _sql_without_dots(path: str) -> str:
    walked = f"list_reduce(list_prepend('', split({path}, '/')[2:]), lambda done, part: CASE part WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || part END)"
    return f"CASE WHEN regexp_matches({path}, '/[.]{{1,2}}(/|$)') THEN {walked} || CASE WHEN regexp_matches({path}, '/[.]{{1,2}}$') THEN '/' ELSE '' END WHEN {path} = '' THEN '/' ELSE {path} END"


def _sql_node(url: str) -> str:
    return f"CASE WHEN contains({url}, '://') THEN translate(regexp_extract({url}, '(?s)^(.*?)://', 1), '{LOWER[0]}', '{LOWER[1]}') || '://' || {_sql_host(url)} || {_sql_without_dots(_sql_path(url))} || regexp_extract({url}, '(?s)^.*?://[^?#]*([^#]*)', 1) END"


def _sql_rule(host: str, path: str, verdict: bool) -> str:
    cases = " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{k if verdict else h + p}'" for k, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow")))
    return f"CASE {cases} END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_links(tags: str, told: str, target: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(shown, {_quoted(tags)}), lambda t: regexp_matches(t, {_quoted(told)})), lambda t: regexp_extract(t, {_quoted(target)}, 1))"


_ORACLE = f"""
WITH RECURSIVE seen AS (
  SELECT page_id, url, CASE WHEN regexp_matches(html, '(?i)canonical|refresh') THEN regexp_replace(html, {_quoted(HIDDEN)}, ' ', 'g') END AS shown FROM pages
), base AS (
  SELECT page_id, {_sql_host("url")} AS host, {_sql_path("url")} AS path, {_sql_node("url")} AS node, url,
    list_filter(list_concat({_sql_links(LINK, CANONICAL, HREF)}, {_sql_links(META, REFRESH, TARGET)}), lambda x: x <> '') AS found
  FROM seen
), raw AS (
  SELECT node, replace(unnest(found), '&amp;', '&') AS link, url FROM base
), absolute AS (
  SELECT node, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    ELSE rtrim(regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1), '/') || '/' || link END AS target FROM raw
), links AS (
  SELECT node AS a, {_sql_node("target")} AS b FROM absolute
), edges AS (
  SELECT a, b FROM links WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM links WHERE a IS NOT NULL AND b IS NOT NULL
), reach AS (
  SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), told AS (
  SELECT a AS node, bool_or({_sql_rule(_sql_host("b"), _sql_path("b"), True)} = 'block') AS blocked, bool_or({_sql_rule(_sql_host("b"), _sql_path("b"), True)} = 'allow') AS allowed FROM (SELECT a, b FROM reach UNION SELECT a, a FROM reach) GROUP BY a
)
SELECT page_id, host, path, {_sql_rule("host", "path", False)} AS rule,
  coalesce({_sql_rule("host", "path", True)}, CASE WHEN told.blocked AND NOT coalesce(told.allowed, false) THEN 'block' END, 'allow') AS verdict
FROM base LEFT JOIN told ON base.node = told.node
"""

QUERIES = {"op7_urls": op7_urls}
ORACLE_SQL = {"op7_urls": _ORACLE}
