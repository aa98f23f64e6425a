"""URL filters: block decisions spread over redirects and canonical links."""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm._graph import connected_components
from quillmark.llm._store import table, written


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the registered query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def _fits(host: Column, path: Column, rule: Rule) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def by_rule(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """The text (field 'rule') or verdict of the longest rule that fits, the first of equals; null where none does."""
    ranked = sorted(rules, key=lambda r: -len(r.host + r.path))
    out = [F.when(_fits(host, path, r), F.lit(r.verdict if field == "verdict" else r.host + r.path)) for r in ranked]
    return F.coalesce(*out) if out else F.lit(None).cast("string")


#: Character references that are read in links, each once: what one gives is not read again.
REFERENCES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"))
AMPERSANDS = ("&amp;", "&#38;", "&#x26;")
#: An attribute: its name, and its value, quoted or not, if it has one.
ATTRIBUTE = r"""(?s)([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def referenced(value: Column) -> Column:
    """value with its character references read."""
    held = F.replace(value, F.lit("\0"), F.lit("�"))
    for name in AMPERSANDS:
        held = F.replace(held, F.lit(name), F.lit("\0"))
    for name, sign in REFERENCES:
        held = F.replace(held, F.lit(name), F.lit(sign))
    return F.replace(held, F.lit("\0"), F.lit("&"))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name (in any case), without quotes and with references read; empty if it has none."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), lambda n: F.lower(n))
    raw = F.get(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)), (F.array_position(names, name) - 1).cast("int"))
    bare = F.when(raw.startswith('"') | raw.startswith("'"), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.coalesce(referenced(bare), F.lit(""))


def without_dots(path: Column) -> Column:
    """path, which starts with /, without its segments . and .. and what the latter lead back from."""
    parts = F.split(F.substr(path, F.lit(2)), "/", -1)
    step = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    open_ = F.element_at(parts, -1).isin(".", "..")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(F.when(open_, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def resolved(href: Column, base: Column) -> Column:
    """The url that href means on the page base; null without one: other schemes, the page itself, or a base without ://."""
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(base), r"(?s)[^/]*\z", "")
    path, query = F.regexp_extract(href, r"(?s)^([^?#]*)", 1), F.regexp_extract(href, r"(?s)^[^?#]*(\?[^#]*)", 1)
    whole = F.when(href.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    absolute = F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
    within = F.when(path != "", F.concat(site, without_dots(whole), query)).when(query != "", F.concat(site, path_of(base), query))
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), absolute).when(site == "", None).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), href)).otherwise(within)


def same_url(url: Column) -> Column:
    """What equal urls share: the url without its fragment, its scheme and host in small letters."""
    front = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    small = F.translate(front, string.ascii_uppercase, string.ascii_lowercase)
    return F.concat(small, F.substr(F.regexp_extract(url, r"(?s)^([^#]*)", 1), F.length(front) + 1))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(from_url, to_url), by same_url, of the canonical links and refresh redirects in html, relative ones resolved.

    A link counts if canonical is one of its rel words, a meta tag if its http-equiv is refresh and its content names a
    url. Tags are read attribute by attribute, so that neither other names that end alike nor text in other values count;
    what stands in comments doesn't. Pages without url or html, and links to the page itself, give no rows; equal edges
    give one; no pages give none.
    """
    shown = pages.where("url is not null and html is not null").select("url", F.regexp_replace("html", r"(?s)<!--.*?(?:-->|\z)", "").alias("html"))
    tags = shown.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)[\s/][^>]*>"), F.lit(0))).alias("tag"))
    is_link = F.lower(F.substring("tag", 2, 4)) == "link"
    rel = F.split(F.lower(attribute(F.col("tag"), "rel")), r"\s+")
    refresh = F.lower(F.trim(attribute(F.col("tag"), "http-equiv"))) == "refresh"
    # 0; url=x, with quotes around x or without
    content = attribute(F.col("tag"), "content")
    named = F.regexp_extract(content, r"(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*(.*)$", 1)
    target = F.when(named.startswith('"') | named.startswith("'"), F.regexp_extract(named, r"""(?s)^["']([^"']*)""", 1)).otherwise(named)
    href = F.trim(F.when(is_link & F.array_contains(rel, "canonical"), attribute(F.col("tag"), "href")).when(~is_link & refresh, target))
    # always true, but not to the optimizer, which else copies all of this into filters that it pushes to the scan
    held = F.monotonically_increasing_id() >= 0
    found = tags.withColumn("href", F.when(held, F.nullif(href, F.lit("")))).where("href is not null")
    edges = found.select(same_url(F.col("url")).alias("from_url"), F.when(held, same_url(resolved(F.col("href"), F.col("url")))).alias("to_url"))
    return edges.where("to_url is not null and to_url <> from_url").distinct()


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Aliases are the connected components of edges (from_url, to_url), by default those in the pages' html; urls are
    compared as same_url has them, as strings. A page on which a rule fits takes the rule's verdict, so that an explicit
    allow wins over its aliases; any other page is blocked if a rule blocks some url of its component, and allowed else.
    A null url has an empty host and path and no aliases; repeated rows and urls are judged alike; edges with a null end
    change nothing; no pages give no rows; other columns are ignored.
    """
    pages = pages.select("page_id", "url", "html")
    given = alias_edges(pages) if edges is None else edges.select(same_url(F.col("from_url")).alias("from_url"), same_url(F.col("to_url")).alias("to_url"))
    edges = written(given.where("from_url is not null and to_url is not null"))
    urls = edges.select(F.col("from_url").alias("url")).unionByName(edges.select(F.col("to_url").alias("url"))).distinct()
    nodes = written(urls.select("url", F.monotonically_increasing_id().alias("node")))
    ends = edges.join(nodes.withColumnsRenamed({"url": "from_url", "node": "a"}), "from_url").join(nodes.withColumnsRenamed({"url": "to_url", "node": "b"}), "to_url")
    parts = connected_components(ends.select("a", "b"))
    named = nodes.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    blocked = named.where(by_rule(F.col("host"), F.col("path"), rules, "verdict") == "block").join(parts, "node").select("component").distinct()
    blocked = parts.join(blocked, "component", "left_semi").join(nodes, "node").select(F.col("url").alias("same"), F.lit(True).alias("by_alias"))
    judged = pages.select("page_id", same_url(F.col("url")).alias("same"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    judged = judged.withColumns({"rule": by_rule(host, path, rules, "rule"), "own": by_rule(host, path, rules, "verdict")}).join(blocked, "same", "left")
    verdict = F.coalesce("own", F.when(F.col("by_alias"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, by judge_urls."""
    return judge_urls(table(spark, sf_dir, "pages"))


OP5_SQL = r"""
WITH RECURSIVE shown AS (
  SELECT DISTINCT url, string_split(html, '<!--')[1] || array_to_string(list_transform(string_split(html, '<!--')[2:], lambda x: CASE WHEN contains(x, '-->') THEN substr(x, strpos(x, '-->') + 3) ELSE '' END), '') AS html FROM pages WHERE url IS NOT NULL),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)[\s/][^>]*>')) AS tag FROM shown),
pairs AS (
  SELECT url, lower(tag[2:5]) AS kind, list_transform(regexp_extract_all(tag, '(?s)([^\s"''<>/=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?', 1), lambda x: lower(x)) AS names,
    list_transform(regexp_extract_all(tag, '(?s)([^\s"''<>/=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?', 2), lambda x: CASE WHEN left(x, 1) IN ('"', chr(39)) THEN substr(x, 2, length(x) - 2) ELSE x END) AS held FROM tags),
read AS (
  SELECT url, kind, names, list_transform(held, lambda x: array_to_string(list_transform(regexp_extract_all(x, '&(?:amp|#38|#x26|quot|#34|#39|apos|lt|gt);|&|[^&]+'),
    lambda y: CASE WHEN y IN ('&amp;', '&#38;', '&#x26;') THEN '&' WHEN y IN ('&quot;', '&#34;') THEN '"' WHEN y IN ('&#39;', '&apos;') THEN chr(39) WHEN y = '&lt;' THEN '<' WHEN y = '&gt;' THEN '>' ELSE y END), '')) AS held FROM pairs),
links AS (
  SELECT url, trim(CASE WHEN kind = 'link' AND list_contains(regexp_split_to_array(lower(held[list_position(names, 'rel')]), '\s+'), 'canonical') THEN held[list_position(names, 'href')]
    WHEN kind = 'meta' AND lower(trim(held[list_position(names, 'http-equiv')])) = 'refresh'
    THEN regexp_replace(regexp_extract(held[list_position(names, 'content')], '(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*(.*)$', 1), '(?s)^["'']([^"'']*).*$', '\1') END) AS href FROM read),
hrefs AS (
  SELECT row_number() OVER () AS k, url, href,
    regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS site, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS own FROM links WHERE href <> ''),
split AS MATERIALIZED (
  SELECT *, regexp_extract(href, '(?s)^[^?#]*') AS reference, regexp_extract(href, '(?s)^[^?#]*(\?[^#]*)', 1) AS query, regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') AS schemed FROM hrefs),
walk AS (
  SELECT k, string_split(whole, '/') AS todo, CAST([] AS VARCHAR[]) AS kept FROM (
    SELECT k, substr(CASE WHEN reference LIKE '/%' THEN reference ELSE '/' || substr(regexp_extract(own, '(?s)^(.*/)'), 2) || reference END, 2) AS whole
    FROM split WHERE NOT schemed AND href NOT LIKE '//%' AND reference <> '' AND site <> '')
  UNION ALL
  SELECT k, todo[2:], CASE WHEN todo[1] = '..' THEN CASE WHEN len(todo) = 1 THEN list_append(kept[:greatest(len(kept) - 1, 0)], '') ELSE kept[:greatest(len(kept) - 1, 0)] END
    WHEN todo[1] = '.' THEN CASE WHEN len(todo) = 1 THEN list_append(kept, '') ELSE kept END ELSE list_append(kept, todo[1]) END FROM walk WHERE len(todo) > 0),
targets AS (
  SELECT url, CASE WHEN schemed THEN CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href END WHEN site = '' THEN NULL
    WHEN href LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || href WHEN reference <> '' THEN site || '/' || array_to_string(w.kept, '/') || query WHEN query <> '' THEN site || own || query END AS target
  FROM split LEFT JOIN (SELECT k, kept FROM walk WHERE len(todo) = 0) w USING (k)),
known AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT target FROM targets WHERE target IS NOT NULL),
same AS (
  SELECT url, translate(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(regexp_extract(url, '(?s)^[^#]*'), length(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1)) + 1) AS own FROM known),
edges AS (SELECT DISTINCT a.own AS a, b.own AS b FROM targets t JOIN same a ON a.url = t.url JOIN same b ON b.url = t.target),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
every AS (SELECT url FROM known UNION SELECT own FROM same),
parts AS (
  SELECT url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM every),
rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
judged AS (
  SELECT url, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY url, host, path),
alias AS (SELECT DISTINCT r.a AS own FROM reach r JOIN judged o ON o.url = r.b WHERE o.verdict = 'block')
SELECT p.page_id, coalesce(o.host, '') AS host, coalesce(o.path, '') AS path, o.rule AS rule,
  coalesce(o.verdict, CASE WHEN x.own IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN judged o ON o.url = p.url LEFT JOIN same s ON s.url = p.url LEFT JOIN alias x ON x.own = s.own
"""
