"""URL filter: against its SQL, and cases worked out by hand."""

import duckdb

from sigloom.llm import urls

CANON = '<head><link href="{}" rel="canonical"></head>'
PAGES = [
    (1, "HTTP://Www.Example.COM/de/x?q#f", ""),
    (2, "http://example.net/en/a", None),
    (3, "http://example.net/fr/a", ""),
    (4, "https://a.org/fr/", ""),
    (5, "https://alias.info/1", CANON.format("http://bad.net/x")),
    (6, "https://alias.info/2#top", '<META HTTP-EQUIV=refresh CONTENT="0; url=https://alias.info/1">'),
    (7, "https://alias.info/3", CANON.format("http://bad.net/y?a=1&amp;b=2")),
    (8, "https://alias.info/4", CANON.format("https://alias.info/3") + '<meta http-equiv="refresh" content="0;url=https://x.org/fr/ok">'),
    (9, None, CANON.format("http://bad.net/x")),
    (10, "no scheme", ""),
    (11, "http://nethost", ""),
    (12, "http://bad.net", ""),
    (13, "https://alias.info/dir/p", "<link rel='canonical' href='q.html'>"),
    (14, "https://alias.info/dir/q.html", "<link rel=canonical href=//bad.net/z>"),
    (15, "https://example.com/de/x", CANON.format("https://example.net/en/")),
    (16, "https://alias.info/mail", CANON.format("mailto:a@bad.net")),
    (5, "https://alias.info/1", CANON.format("http://bad.net/x")),
    (17, "", ""),
    (18, "https://alias.info/many", CANON.format("mailto:x@y.z") + CANON.format("") + "<link href='http://bad.net/second' rel='alternate Canonical'>"),
    (19, "https://alias.info/hidden", "<!-- " + CANON.format("http://bad.net/x") + " --><script>'" + CANON.format("http://bad.net/x") + "'</script>"),
    (20, "https://alias.info/unclosed", "<!-- " + CANON.format("http://bad.net/x")),
    (21, "https://alias.info/a/b/c", CANON.format("../../dots/./x")),
    (22, "https://alias.info/dots/y/../x", CANON.format("http://bad.net/dots")),
    (23, "https://alias.info/other", "<link rel='canonical-like' href='http://bad.net/x'><meta name='refresh' content='url=http://bad.net/x'>"),
    (24, "https://root.info", CANON.format("http://bad.net/root")),
    (25, "https://alias.info/toroot", CANON.format("https://ROOT.info/#top")),
    (26, "https://alias.info/long", "<p>" + "x " * 200_000 + "</p>" + CANON.format("http://bad.net/x")),
    (27, "https://alias.info/up", CANON.format("../../../../dots/x/.")),
]


def test_judged_pages(spark):
    rows = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, node string")
    got = sorted(tuple(r) for r in urls.judge(rows).collect())
    by_id = {r[0]: r for r in got}
    assert by_id[1][1:] == ("www.example.com", "/de/x", "example.com/de/", "block")
    assert by_id[2][3:] == ("example.net/en/", "allow") and by_id[3][3:] == ("net/", "block")
    assert by_id[4][3:] == ("org/fr/", "allow")
    assert [by_id[k][4] for k in (5, 6)] == ["block", "block"]
    assert [by_id[k][4] for k in (7, 8)] == ["allow", "allow"]  # an allow rule in the same component
    assert by_id[9][1:] == ("", "", None, "allow") and by_id[10][1:] == ("", "", None, "allow")
    assert by_id[12][2:] == ("", None, "allow")  # an empty path does not start with /
    assert by_id[13][4] == "block" and by_id[15][4] == "block" and by_id[16][4] == "allow"
    assert [by_id[k][4] for k in range(18, 28)] == ["block", "allow", "allow", "block", "block", "allow", "block", "block", "block", "allow"]
    assert len(got) == len(PAGES)
    db = duckdb.connect()
    db.execute("create table pages (page_id bigint, url varchar, html varchar)")
    db.executemany("insert into pages values (?, ?, ?)", PAGES)
    cur = db.execute(urls.ORACLE_SQL["op7_urls"])
    names = [c[0] for c in cur.description]
    assert names == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(cur.fetchall()) == got


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
