"""Selection, coverage, joins, logs, agreement and integrity over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.operators import cohort, logs, metrics
from quillmark.operators.ranks import packed
from quillmark.plans._base import query
from quillmark.sources.io import sorted_digest, table


@query("SELECT doc_id, lang, source, rank FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('20260922:' || doc_id)) AS rank FROM documents) WHERE rank <= 5")
def hash_ranked_sample(spark, sf_dir):
    """Five documents of each cell by a seeded hash: the operator is a sample."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return cohort.hash_ranked(docs, ["lang", "source"], F.col("doc_id"), 5).select("doc_id", "lang", "source", "rank")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS "at", count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, "at" FROM r WHERE n <= 20 OR list_contains(list_transform(range(20), lambda i: round_even(i * (n - 1) / 19.0, 0)::BIGINT), "at")""")
def evenly_spread_selection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return cohort.evenly_spread(docs, ["lang"], ["doc_id"], 20).select("doc_id", "lang", "at")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS "at", count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, "at" FROM r WHERE n >= 15 AND list_contains(list_transform(range(15), lambda i: floor((i + 0.5) * n / 15)::BIGINT), "at")""")
def midpoint_selection(spark, sf_dir):
    return cohort.midpoint_spread(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 15).select("doc_id", "lang", "at")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS "at", count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, CASE WHEN "at" <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN "at" <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM r GROUP BY ALL""")
def contiguous_split(spark, sf_dir):
    return cohort.split_in_order(table(spark, sf_dir, "documents"), ["lang"], ["doc_id"]).groupBy("lang", "split").agg(F.count("*").alias("n"))


_QC = "q AS (SELECT d.doc_id, lang, source, c.condition, CASE WHEN (d.doc_id + c.k) % 11 = 0 THEN 'fail' WHEN (d.doc_id + c.k) % 4 = 0 THEN 'warning' ELSE 'pass' END AS qc_status FROM documents d CROSS JOIN (VALUES ('paraphrase', 1), ('modernize', 2), ('simplify', 3)) c(condition, k) WHERE (d.doc_id * 7 + c.k) % 13 <> 0)"
CONDITIONS = ["paraphrase", "modernize", "simplify"]


def _outcomes(spark, sf_dir):
    spec = spark.createDataFrame([(c, k + 1) for k, c in enumerate(CONDITIONS)], "condition string, k int")
    n = F.col("doc_id") + F.col("k")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").crossJoin(F.broadcast(spec)).where((F.col("doc_id") * 7 + F.col("k")) % 13 != 0)
    return rows.select("doc_id", "condition", F.when(n % 11 == 0, "fail").when(n % 4 == 0, "warning").otherwise("pass").alias("qc_status"))


@query(f"""WITH {_QC}, s AS (SELECT lang, source, count(*) AS expected FROM documents GROUP BY ALL), c(condition) AS (VALUES ('paraphrase'), ('modernize'), ('simplify')),
n AS (SELECT lang, source, condition, count(*) AS accounted, count(*) FILTER (qc_status = 'pass') AS pass, count(*) FILTER (qc_status = 'warning') AS warning, count(*) FILTER (qc_status = 'fail') AS failed FROM q GROUP BY ALL)
SELECT s.lang, s.source, c.condition, expected, coalesce(accounted, 0) AS accounted, coalesce(pass, 0) AS pass, coalesce(warning, 0) AS warning, coalesce(failed, 0) AS failed FROM s CROSS JOIN c LEFT JOIN n USING (lang, source, condition)""")
def outcome_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return cohort.coverage(docs, _outcomes(spark, sf_dir), CONDITIONS, ["lang", "source"])


@query(f"WITH {_QC} SELECT doc_id FROM q GROUP BY doc_id HAVING count(*) = 3 AND count(*) FILTER (qc_status <> 'fail') = 3")
def aligned_cohort(spark, sf_dir):
    """Passages all of whose conditions have a rewrite that did not fail."""
    return cohort.aligned(table(spark, sf_dir, "documents"), _outcomes(spark, sf_dir), CONDITIONS).select("doc_id")


@query("""WITH p(panel, minimum) AS (VALUES ('all', 0), ('w200', 200), ('w1500', 1500)), t AS (SELECT lang, source, n_chars // 6 AS w FROM documents), works AS (SELECT DISTINCT lang, source FROM documents),
n AS (SELECT panel, minimum, works.lang, works.source, count(t.w) AS n FROM p CROSS JOIN works LEFT JOIN t ON t.lang = works.lang AND t.source = works.source AND t.w >= minimum GROUP BY ALL)
SELECT panel, minimum, sum(n)::BIGINT AS eligible, count(*) FILTER (n = 0) AS missing_works, CASE WHEN count(*) FILTER (n = 0) = 0 THEN 'estimable' ELSE 'not_estimable' END AS status FROM n GROUP BY ALL""")
def panel_coverage(spark, sf_dir):
    panels = spark.createDataFrame([("all", 0), ("w200", 200), ("w1500", 1500)], "panel string, minimum int")
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.floor(F.col("n_chars") / 6).alias("w"))
    return cohort.panel_coverage(docs, panels, "lang", "source", "w")


@query("SELECT lang, source, count(*) AS n, min(n_chars) AS least, max(n_chars) AS largest, round(avg(n_chars), 6) AS mean, median(n_chars)::DOUBLE AS median, round(quantile_cont(n_chars::DOUBLE, 0.25), 6) AS q1, round(quantile_cont(n_chars::DOUBLE, 0.75), 6) AS q3, count(DISTINCT text) AS texts FROM documents GROUP BY ALL")
def length_summary(spark, sf_dir):
    q = F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("largest"), F.round(F.avg("n_chars"), 6).alias("mean"), q.alias("q"), F.countDistinct(F.sha2("text", 256)).alias("texts"))
    return rows.select("lang", "source", "n", "least", "largest", "mean", F.col("q")[1].alias("median"), F.round(F.col("q")[0], 6).alias("q1"), F.round(F.col("q")[2], 6).alias("q3"), "texts")


@query("SELECT lang, string_agg(DISTINCT source, ';' ORDER BY source) AS sources FROM documents GROUP BY lang")
def joined_distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"))


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_outcome(spark, sf_dir):
    return logs.first_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_type", "user_id", "event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_revision(spark, sf_dir):
    return logs.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH w AS (SELECT *, max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM events)
SELECT user_id, count(*) AS attempts FROM w WHERE coalesce(done, 0) = 0 GROUP BY user_id""")
def attempts_until_first(spark, sf_dir):
    rows = logs.until_first(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase")
    return rows.groupBy("user_id").agg(F.count("*").alias("attempts"))


@query("SELECT user_id, count(*) AS attempts, count(*) >= 60 AS exhausted FROM events GROUP BY user_id")
def attempts_per_key(spark, sf_dir):
    return logs.attempts(table(spark, sf_dir, "events"), ["user_id"], 60)


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def pending_requests(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return logs.pending(table(spark, sf_dir, "orders").select("o_orderkey"), done, key="o_orderkey")


@query("SELECT event_id, floor((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) / 20)::BIGINT AS batch FROM events")
def fixed_batches(spark, sf_dir):
    return logs.in_batches(table(spark, sf_dir, "events"), ["ts", "event_id"], 20, ["event_type"]).select("event_id", "batch")


@query("""WITH c AS (SELECT lang, source, row_number() OVER (ORDER BY lang, source) - 1 AS c FROM (SELECT DISTINCT lang, source FROM documents))
SELECT doc_id, (c + row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1) % 4 AS block FROM documents JOIN c USING (lang, source)""")
def round_robin_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return logs.round_robin(docs, ["lang", "source"], ["doc_id"]).select("doc_id", F.col("block").cast("long").alias("block"))


@query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS charged, count(*) FILTER (user_id % 3 <> 0) AS unsettled FROM events GROUP BY ALL")
def ledger_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("settled", F.col("user_id") % 3 == 0)
    return logs.ledger(rows, "event_type", "value", "settled").withColumn("charged", F.round("charged", 4))


@query("SELECT event_id, round(CASE WHEN user_id >= 0 AND value >= 0 THEN (user_id * 0.3::DOUBLE * 1.25 + value * 2.5) / 1e6 END, 9) AS dollars FROM events")
def usage_cost(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(logs.cost(F.col("user_id"), F.col("value"), 0.3, 2.5, 1.25), 9).alias("dollars"))


@query("""WITH l AS (SELECT doc_id % 5 AS block, quality AS a, toxic AS b FROM labels), t AS (SELECT block, count(*)::DOUBLE AS n, avg((a = b)::INT) AS po, avg(a) AS pa, avg(b) AS pb FROM l GROUP BY ALL)
SELECT block, n::BIGINT AS items, round(po, 6) AS raw_agreement, CASE WHEN pa * (1 - pb) + pb * (1 - pa) > 0 THEN round(1 - (1 - po) / (pa * (1 - pb) + pb * (1 - pa)), 6) END AS kappa FROM t""")
def rater_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("block", F.col("doc_id") % 5)
    out = metrics.kappa(rows, ["block"], "quality", "toxic")
    return out.withColumns({"raw_agreement": F.round("raw_agreement", 6), "kappa": F.round("kappa", 6)})


@query("""WITH r AS (SELECT c_custkey % 4 AS block, c_nationkey % 5 + 1 AS a, (c_nationkey + c_custkey) % 5 + 1 AS b FROM customer), o AS (SELECT block, count(*) AS n, avg((a = b)::INT) AS po, sum(power(a - b, 2)) AS d FROM r GROUP BY block),
e AS (SELECT x.block, sum(power(x.a - y.b, 2) * x.n * y.n) AS d FROM (SELECT block, a, count(*) AS n FROM r GROUP BY ALL) x JOIN (SELECT block, b, count(*) AS n FROM r GROUP BY ALL) y USING (block) GROUP BY x.block)
SELECT o.block, n AS items, round(po, 6) AS raw_agreement, CASE WHEN e.d > 0 THEN round(1 - o.d * n / e.d, 6) END AS kappa FROM o JOIN e USING (block)""")
def quadratic_kappa(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).alias("block"), (F.col("c_nationkey") % 5 + 1).alias("a"), ((F.col("c_nationkey") + F.col("c_custkey")) % 5 + 1).alias("b"))
    out = metrics.kappa(rows, ["block"], "a", "b", quadratic=True)
    return out.withColumns({"raw_agreement": F.round("raw_agreement", 6), "kappa": F.round("kappa", 6)})


@query("SELECT lang, count(*) AS audited, sum((toxic = 1 OR quality = 0)::INT)::BIGINT AS risk_union, round(avg((toxic = 1 OR quality = 0)::INT), 6) AS risk_fraction FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def risk_union(spark, sf_dir):
    risk = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("audited"), F.sum(risk).alias("risk_union"), F.round(F.avg(risk), 6).alias("risk_fraction"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def exclusion_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def audited_subset(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("""WITH t AS (SELECT n_regionkey AS r, n_nationkey AS id, ((n_nationkey + 1) % 7 + 1) / 40.0::DOUBLE AS p FROM nation), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p, id) AS k FROM t)
SELECT r, id, round(p, 6) AS p, round(least(1, max((6 - k + 1) * p) OVER (PARTITION BY r ORDER BY p, id ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM k""")
def holm_correction(spark, sf_dir):
    """Families of six planned tests (five made), by region."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("id"), (((F.col("n_nationkey") + 1) % 7 + 1) / 40.0).alias("p"))
    return metrics.holm(rows, ["r"], "p", 6).select("r", "id", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


@query("""WITH s AS (SELECT l_suppkey AS k, l_orderkey AS id, l_linenumber AS line, l_partkey % 1000 AS a, l_partkey % 1000 + 5 AS b FROM lineitem), w AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b, id * 10 + line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)
SELECT k, count(*) AS overlaps FROM w WHERE a < m GROUP BY k""")
def interval_overlaps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 1000).alias("start"), (F.col("l_partkey") % 1000 + 5).alias("end"))
    return cohort.overlapping(rows, ["k"], "id").groupBy("k").agg(F.count("*").alias("overlaps"))


@query("""WITH sp AS (SELECT n_regionkey AS g, n_nationkey AS span, n_nationkey * 40 AS a, n_nationkey * 40 + 60 AS b FROM nation), pt AS (SELECT c_custkey AS id, c_nationkey % 5 AS g, c_custkey % 1000 AS "at" FROM customer),
j AS (SELECT id, "at", span, row_number() OVER (PARTITION BY id ORDER BY a, b) AS k FROM pt JOIN sp USING (g) WHERE "at" >= a AND "at" < b) SELECT id, "at", span FROM j WHERE k = 1""")
def interval_containment(spark, sf_dir):
    n = F.col("n_nationkey")
    spans = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("g"), n.alias("span"), (n * 40).alias("a"), (n * 40 + 60).alias("b"))
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).cast("long").alias("g"), (F.col("c_custkey") % 1000).alias("at"))
    return cohort.contained(points, spans, ["g"], "a", "b").select("id", "at", "span")


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_right")
def key_coverage(spark, sf_dir):
    return cohort.same_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT a.lang AS a, b.lang AS b, count(*) AS shared_sources FROM (SELECT DISTINCT lang, source FROM documents) a JOIN (SELECT DISTINCT lang, source FROM documents) b ON a.source = b.source AND a.lang < b.lang GROUP BY ALL")
def unordered_pairs(spark, sf_dir):
    cells = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    return cells.select("source", F.col("lang").alias("a")).join(cells.select("source", F.col("lang").alias("b")), "source").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared_sources"))


@query("SELECT lang, count(*) FILTER (source = 'src0') AS src0, count(*) FILTER (source = 'src1') AS src1, count(*) FILTER (source = 'src2') AS src2 FROM documents GROUP BY lang")
def pivoted_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").pivot("source", ["src0", "src1", "src2"]).count().fillna(0)


@query("SELECT coalesce(lang, 'pooled') AS scope, coalesce(source, 'all') AS source, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY GROUPING SETS ((), (lang), (lang, source))")
def grouping_sets_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))
    return rows.select(F.coalesce("lang", F.lit("pooled")).alias("scope"), F.coalesce("source", F.lit("all")).alias("source"), "n", "mean")


@query("SELECT doc_id, 'document' AS kind, n_chars AS size, NULL::BIGINT AS turn FROM documents UNION ALL SELECT conv_id, role, length(text), turn FROM conversations")
def union_by_name(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("document").alias("kind"), F.col("n_chars").alias("size"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("kind"), F.length("text").cast("long").alias("size"), "turn")
    return docs.unionByName(turns, allowMissingColumns=True)


@query("SELECT lang, source, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS k FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)) WHERE k <= 8")
def top_sources(spark, sf_dir):
    """A top-k report."""
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source"))).where("k <= 8").drop("k")


@query("SELECT sha256(string_agg(h, chr(10) ORDER BY h)) AS digest FROM (SELECT doc_id || ':' || sha256(text) AS h FROM documents)")
def contract_hash(spark, sf_dir):
    """One digest over the sorted id and text digests, as the contract prescribes."""
    line = F.concat_ws(":", "doc_id", F.sha2("text", 256))
    return sorted_digest(table(spark, sf_dir, "documents").select(line.alias("h")), "h")


@query("SELECT text_hash, copies FROM (SELECT sha256(text) AS text_hash, count(*) AS copies FROM documents GROUP BY text) WHERE copies > 1")
def duplicate_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("copies")).where("copies > 1")


@query("""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, coalesce(strlen(text), 0) AS bytes FROM documents WHERE lang IS NOT NULL),
p(lang, k, part, used) AS (SELECT lang, 1::BIGINT, 0, bytes FROM d WHERE k = 1 UNION ALL SELECT p.lang, d.k, part + (used + d.bytes > 850000)::INT, CASE WHEN used + d.bytes > 850000 THEN d.bytes ELSE used + d.bytes END FROM p JOIN d ON d.lang = p.lang AND d.k = p.k + 1)
SELECT d.doc_id, d.lang, d.bytes::BIGINT AS bytes, p.part FROM p JOIN d USING (lang, k)""")
def packed_parts(spark, sf_dir):
    """Documents of each language in order, packed into parts of at most 850,000 bytes."""
    docs = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return packed(docs, ["lang"], ["doc_id"], "bytes")


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return rows.select("event_type", F.col("window.start").alias("day"), "n")


@query("""WITH v AS (SELECT o_orderkey, count(*) AS n, sum(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT r_name, n_name, count(*) AS orders, round(sum(q), 2) AS quantity FROM v JOIN orders USING (o_orderkey) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def star_join_summary(spark, sf_dir):
    """Aggregated before the joins; the dimension tables are small enough for Spark to broadcast by its own threshold."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("q").alias("q"))
    named = rows.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    return named.join(table(spark, sf_dir, "nation"), "n_nationkey").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name", "n_name").agg(F.sum("n").alias("orders"), F.round(F.sum("q"), 2).alias("quantity"))
