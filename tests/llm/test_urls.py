"""URL filters against the standard library's url joining and plain connected components."""

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import duckdb
from pyspark.sql import functions as F

from quillmark.llm import urls

BASES = ["http://m.net/a/x", "http://m.net", "https://M.Net/a/b/c?q=1#f", "http://m.net/a/b/"]
HREFS = ["y", "y?z=1&amp;w=2", "../y", "../../../y", "./", "..", ".", "y/..", "a/./b/../c", "?id=2", "#top", "/", "/p/../q", "//h.org/x", "http://o.org/r#f", "https://O.org", "mailto:a@b", "javascript:x", "x:y", "g;x=1/../y", "y#s", "y?a/../b"]


def own(url):
    url = urldefrag(url)[0]
    front = re.match(r"(?s)(.*?://[^/?#]*)?", url).group()
    return front.lower() + url[len(front) :]


def test_links_are_resolved_like_the_standard_library(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    got = spark.createDataFrame(rows, "base string, href string").select("base", "href", urls.same_url(urls.resolved(F.replace("href", F.lit("&amp;"), F.lit("&")), F.col("base"))).alias("to")).collect()
    for r in got:
        href = r.href.replace("&amp;", "&")
        if href.split(":")[0] in ("mailto", "javascript", "x") or href == "#top":
            assert r.to is None
        else:
            assert r.to == own(urljoin(r.base, href)), (r.base, r.href)


def brute(pages):
    """page_id to verdict."""
    rules = sorted(urls.RULES, key=lambda r: -len(r.host + r.path))

    def rule(url):
        parts = urlsplit(url or "")
        host, path = parts.netloc.lower(), parts.path
        return next((r.verdict for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), None)

    group = {}

    def top(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for _, url, html in pages:
        for href in re.findall(r'href="([^"]*)"', html or "") if url else ():
            group[top(own(url))] = top(own(urljoin(url, href)))
    bad = {top(x) for x in list(group) if rule(x) == "block"}
    return {i: rule(u) or ("block" if u and own(u) in group and top(own(u)) in bad else "allow") for i, u, _ in pages}


def test_blocks_reach_aliases_over_chains_of_relative_links(spark, tmp_path):
    link = lambda href: f'<link rel="canonical" href="{href}">'
    pages = [(i, f"http://c.net/{i}/p", link(f"../{i + 1}/p")) for i in range(40)] + [(40, "http://c.net/40/p", link("HTTP://X.com/de/1#z"))]
    pages += [(100, "http://m.net/a/x", link("y")), (101, "http://M.NET/a/y", link("http://b.com/de/")), (102, "http://m.net/a/y#frag", None), (103, "http://m.net/a/Y", "")]
    pages += [(200, "http://q.net/s", link("?id=2")), (201, "http://q.net/s?id=2", link("//example.org/es/k")), (202, "http://q.net/s?id=3", ""), (203, "http://ok.com/fr/x", link("http://q.net/s")), (204, None, link("http://q.net/s"))]
    pages += [(300, "http://f.net/1", link("http://ok.org/p")), (301, "http://f.net/1", ""), (300, "http://f.net/1", link("http://ok.org/p"))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = urls.op5_url_filter(spark, str(tmp_path)).collect()
    assert len(got) == len(pages) and {r.page_id: r.verdict for r in got} == brute(pages)
    assert {r.page_id for r in got if r.verdict == "block"} >= {0, 20, 40, 100, 101, 102, 200, 201}
    database = duckdb.connect()
    database.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = database.sql(urls.OP5_SQL)
    assert sorted(want.fetchall(), key=repr) == sorted((tuple(r[c] for c in want.columns) for r in got), key=repr)


TAGS = [
    '<link data-href="http://c.net/z" rel="canonical" href="http://c.net/q">', '<!-- <link rel="canonical" href="http://c.net/no"> -->', "<link rel=alternate href=http://c.net/no2>",
    "<LINK REL='nofollow Canonical' HREF='/a?b=1&amp;amp;c=2' title=\"href=http://c.net/no3\">", "<link title='rel=\"canonical\"' href=\"http://c.net/no4\">", "<link rel=canonical href=/u?x=&#38;amp;y />",
    '<meta http-equiv="Refresh" content="0; url=http://c.net/r">', "<meta content='5;URL=&quot;/quoted&quot;' http-equiv=refresh>", '<meta name="refresh" content="0;url=/no5">', "<meta http-equiv=refresh content=30>",
    "<linkx rel=canonical href=/no6>", '<link rel="canonical">', '<link rel="canonical" href="">', '<link rel=canonical\nhref = "/lines">', '<link href="/first" href="/second" rel=canonical>', "<!-- open <link rel=canonical href=/no7>",
]


class Reader(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.found = []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        if tag == "link" and "canonical" in first.get("rel", "").lower().split():
            self.found.append(first.get("href", ""))
        if tag == "meta" and first.get("http-equiv", "").lower() == "refresh" and "=" in first.get("content", ""):
            self.found.append(first["content"].split("=", 1)[1].strip("\"'"))


def test_tags_are_read_like_the_standard_library(spark):
    pages, want = [], set()
    for i, tag in enumerate(TAGS):
        page = f"http://c.net/page{i}"
        pages += [(i, page, f"<p>{tag}</p>"), (-1 - i, None, tag), (1000 + i, "http://c.net/other", None)]
        want |= {(page, own(urljoin(page, h))) for h in Reader(f"<p>{tag}</p>").found if h}
    got = urls.alias_edges(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {tuple(r) for r in got} == want and len(want) == 7


def test_the_sql_reads_the_same_tags(spark, tmp_path):
    blocked = [t.replace("http://c.net/", "http://x.com/de/").replace("=/", "=http://x.com/de/").replace('"/', '"http://x.com/de/').replace("'/", "'http://x.com/de/").replace(";/", ";http://x.com/de/") for t in TAGS]
    pages = [(i, f"http://s{i}.net/", f"<html>{t}</html>") for i, t in enumerate([*TAGS, *blocked])]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in urls.op5_url_filter(spark, str(tmp_path)).collect()}
    database = duckdb.connect()
    database.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: r[1] for r in database.sql(f"SELECT page_id, verdict FROM ({urls.OP5_SQL})").fetchall()} == got
    for i, t in enumerate(blocked):
        assert got[len(TAGS) + i] == ("block" if any(Reader(f"<html>{t}</html>").found) else "allow"), t


def test_given_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.net/1", None), (2, "http://a.net/2", None), (3, None, None)], "page_id long, url string, html string")
    edges = spark.createDataFrame([("HTTP://A.net/1", "http://x.com/de/", 1), (None, "http://a.net/2", 2), ("http://a.net/2", None, 3)], "from_url string, to_url string, n int")
    assert {r.page_id: r.verdict for r in urls.judge_urls(pages, edges=edges).collect()} == {1: "block", 2: "allow", 3: "allow"}
