"""Checks, joins that must be complete, sensitivity subsets, contrasts, and measures of candidate passages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions import spans as S
from quillmark.functions import text as T
from quillmark.operators import evidence, qc
from quillmark.plans._base import _COUNTS, query
from quillmark.plans.text_queries import SENTENCES, WORD
from quillmark.sources.io import table

_ANY = "'[.,;:!?—–\"“”‘’''…-]'"


@query("""WITH f AS (SELECT event_type, user_id % 3 AS fold, avg(value) AS score, max(value) AS best FROM events GROUP BY ALL)
SELECT event_type, fold::VARCHAR AS fold, round(score, 6) AS score, round(best, 6) AS best FROM f UNION ALL SELECT event_type, 'mean', round(avg(score), 6), round(avg(best), 6) FROM f GROUP BY event_type""")
def fold_mean_rows(spark, sf_dir):
    each = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("fold")).agg(F.avg("value").alias("score"), F.max("value").alias("best"))
    return evidence.with_mean_rows(each, ["event_type"], "fold", ["score", "best"]).withColumns({c: F.round(c, 6) for c in ("score", "best")})


def _flags():
    return qc.flags_of({"short": F.col("n_chars") < 200, "long": F.col("n_chars") > 5000, "address": F.col("text").contains("@"), "year": F.col("text").rlike("[0-9]{4}")})


@query("""WITH f AS (SELECT lang, list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN contains(text, '@') THEN 'address' END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'year' END], lambda x: x IS NOT NULL) AS flags FROM documents)
SELECT lang, flag, count(*) AS n FROM (SELECT lang, unnest(CASE WHEN len(flags) > 0 THEN flags ELSE ['none'] END) AS flag FROM f) GROUP BY ALL""")
def flag_counters(spark, sf_dir):
    return evidence.flag_counts(table(spark, sf_dir, "documents").select("lang", _flags().alias("flags")), ["lang"], "flags")


_MEASURED = f"m AS (SELECT doc_id, lang, source, text, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS words, len({SENTENCES})::BIGINT AS sentences FROM documents)"
_STATUS = """CASE WHEN words NOT BETWEEN 450 AND 650 THEN 'candidate_fail_length' WHEN sentences < 5 THEN 'candidate_fail_low_sentence_count' ELSE 'candidate_pass_length' END AS status,
  CASE WHEN words NOT BETWEEN 450 AND 650 THEN 'outside_hard_word_bounds' WHEN sentences < 5 THEN 'too_few_sentences' ELSE '' END AS reason"""


def _candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    sized = docs.withColumns({"words": F.size(T.words(F.col("text"))).cast("long"), "sentences": F.size(T.sentence_lengths(F.col("text"))).cast("long")})
    return sized.withColumn("c", S.candidate_status(F.col("words"), F.col("sentences"))).select(*sized.columns, "c.status", "c.reason")


@query(f"WITH {_MEASURED} SELECT doc_id, words, sentences, {_STATUS} FROM m")
def candidate_statuses(spark, sf_dir):
    return _candidates(spark, sf_dir).select("doc_id", "words", "sentences", "status", "reason")


@query(f"""WITH {_MEASURED}, k AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS place, {_STATUS} FROM m)
SELECT doc_id, lang, source, words, place FROM k WHERE status = 'candidate_pass_length' AND words BETWEEN 450 AND 650 AND sentences >= 5 AND place > 2 AND NOT regexp_matches(text, '(?i)\\b(?:contents|preface|chapter i)\\b')""")
def selected_candidates(spark, sf_dir):
    """Candidates within all bounds, past the first two of their source, without words of a front matter."""
    rows = _candidates(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id")).cast("long"))
    fits = (F.col("status") == "candidate_pass_length") & F.col("words").between(450, 650) & (F.col("sentences") >= 5) & (F.col("place") > 2)
    return rows.where(fits & ~F.col("text").rlike(r"(?i)\b(?:contents|preface|chapter i)\b")).select("doc_id", "lang", "source", "words", "place")


def _judged(spark, sf_dir):
    """Documents as rewrites: every third an original, with a status and flags by their number."""
    i = F.col("doc_id")
    flags = qc.flags_of({"length_hard_warning": i % 5 == 0, "low_sentence_count": i % 7 == 0})
    status = F.when(i % 11 == 0, "fail").when(F.size("flags") > 0, "warning").otherwise("pass")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", (i % 3 == 0).alias("original"), flags.alias("flags")).withColumn("status", status)


_JUDGED = "j AS (SELECT doc_id, lang, doc_id % 3 = 0 AS original, doc_id % 5 = 0 AS hard, CASE WHEN doc_id % 11 = 0 THEN 'fail' WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'warning' ELSE 'pass' END AS status FROM documents)"
SUBSETS = ("all_rows", "qc_pass_only", "pass_plus_non_hard_length_warning")


@query(f"""WITH {_JUDGED}, s(subset) AS (VALUES ('all_rows'), ('qc_pass_only'), ('pass_plus_non_hard_length_warning'))
SELECT subset, lang, count(*) AS n FROM j CROSS JOIN s WHERE original OR subset = 'all_rows' OR (subset = 'qc_pass_only' AND status = 'pass') OR (subset = 'pass_plus_non_hard_length_warning' AND status IN ('pass', 'warning') AND NOT hard) GROUP BY ALL""")
def sensitivity_subsets(spark, sf_dir):
    inside = F.array_compact(F.array(*(F.when(evidence.in_subset(F.col("status"), F.col("flags"), F.col("original"), k), F.lit(k)) for k in SUBSETS)))
    return _judged(spark, sf_dir).select("lang", F.explode(inside).alias("subset")).groupBy("subset", "lang").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, quality, toxic FROM labels WHERE quality <> toxic), k AS (SELECT doc_id, quality AS decision FROM labels WHERE doc_id % 5 <> 0),
o AS (SELECT doc_id, count(*) AS n, min(decision) AS decision FROM k GROUP BY doc_id)
SELECT coalesce(d.doc_id, o.doc_id) AS doc_id, decision, CASE WHEN o.doc_id IS NULL THEN 'undecided' WHEN d.doc_id IS NULL THEN 'undisputed' WHEN n > 1 THEN 'decided_twice' END AS problem FROM d FULL JOIN o ON d.doc_id = o.doc_id""")
def adjudication(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    decisions = rows.where("doc_id % 5 <> 0").select("doc_id", F.col("quality").alias("decision"))
    return evidence.adjudicated(rows.where("quality <> toxic"), decisions, ["doc_id"]).select("doc_id", "decision", "problem")


_SLOTS = """r AS (SELECT doc_id, 'A' AS slot, quality AS value FROM labels WHERE doc_id % 13 <> 0 UNION ALL SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'A' ELSE 'B' END, toxic FROM labels WHERE doc_id % 19 <> 0)"""


@query(f"""WITH {_SLOTS} SELECT doc_id, max(value) FILTER (slot = 'A') AS a, max(value) FILTER (slot = 'B') AS b,
CASE WHEN count(*) <> 2 OR count(DISTINCT slot) <> 2 THEN 'wrong_slots' END AS problem FROM r GROUP BY doc_id""")
def two_rater_join(spark, sf_dir):
    i, rows = F.col("doc_id"), table(spark, sf_dir, "labels")
    a = rows.where(i % 13 != 0).select("doc_id", F.lit("A").alias("slot"), F.col("quality").alias("value"))
    b = rows.where(i % 19 != 0).select("doc_id", F.when(i % 17 == 0, "A").otherwise("B").alias("slot"), F.col("toxic").alias("value"))
    return evidence.two_raters(a.unionByName(b), ["doc_id"], "slot", "value")


@query("""WITH l AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0), r AS (SELECT l_orderkey AS k FROM lineitem WHERE l_linenumber = 1 OR l_orderkey % 50 = 0)
SELECT k, sum(a) AS left_rows, sum(b) AS right_rows FROM (SELECT k, 1 AS a, 0 AS b FROM l UNION ALL SELECT k, 0, 1 FROM r) GROUP BY k HAVING sum(a) <> 1 OR sum(b) <> 1""")
def one_to_one_violations(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"))
    b = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 or l_orderkey % 50 = 0").select(F.col("l_orderkey").alias("k"))
    return evidence.one_to_one(a, b, ["k"])


_CALLS = """c AS (SELECT event_id, event_id % 700 AS request_id, ts, CASE WHEN event_type = 'error' THEN 400 ELSE 200 END AS http_status, CASE WHEN event_id % 3 = 0 THEN 'content_filter' ELSE 'other' END AS error_code FROM events),
req AS (SELECT request_id, request_id * 10 AS original_words FROM (SELECT DISTINCT event_id % 700 AS request_id FROM events) WHERE request_id % 50 <> 49), done AS (SELECT DISTINCT request_id FROM c WHERE http_status = 200 AND event_id % 97 = 0)"""


def _calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", 400).otherwise(200)
    calls = e.select("event_id", (F.col("event_id") % 700).alias("request_id"), F.col("ts").alias("timestamp"), status.alias("http_status"), F.when(F.col("event_id") % 3 == 0, "content_filter").otherwise("other").alias("error_code"))
    requests = calls.select("request_id").distinct().where("request_id % 50 <> 49").withColumn("original_words", F.col("request_id") * 10)
    return calls, requests, calls.where("http_status = 200 and event_id % 97 = 0").select("request_id").distinct()


@query(f"""WITH {_CALLS}, t AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts, event_id) AS k FROM c WHERE http_status = 400 AND error_code = 'content_filter')
SELECT t.request_id, event_id, original_words, 'fail' AS qc_status, 'provider_content_filter' AS qc_flags, '' AS rewritten_text, CASE WHEN req.request_id IS NULL THEN 'unknown_request' END AS problem
FROM t LEFT JOIN req ON req.request_id = t.request_id WHERE k = 1 AND t.request_id NOT IN (SELECT request_id FROM done)""")
def terminal_refusals(spark, sf_dir):
    """Refused requests without any recorded outcome, as rows; events of unknown requests are told apart."""
    calls, requests, done = _calls(spark, sf_dir)
    return evidence.refusals(requests, calls, done).select("request_id", "event_id", "original_words", "qc_status", "qc_flags", "rewritten_text", "problem")


@query("""WITH a AS (SELECT event_id % 700 AS request_id, event_id AS attempt, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 41 = 0 THEN 'refused' ELSE 'error' END WHEN event_id % 5 = 0 THEN 'ok' ELSE 'error' END AS outcome, CASE WHEN event_id % 8 = 0 THEN value END AS retry_after FROM events WHERE event_id % 700 < 600 AND event_id % 700 >= event_id // 700 * 20),
g AS (SELECT request_id, count(*) AS attempts, bool_or(outcome = 'ok') AS ok, bool_or(outcome = 'refused') AS refused, arg_max(coalesce(retry_after, -1), attempt) AS after FROM a GROUP BY request_id),
s AS (SELECT *, CASE WHEN ok THEN 'done' WHEN refused THEN 'refused' WHEN attempts >= 6 THEN 'exhausted' ELSE 'retry' END AS state FROM g)
SELECT request_id, attempts, state, CASE WHEN state = 'retry' THEN least(20.0, CASE WHEN after >= 0 THEN after ELSE 1.5 * power(2.0, attempts - 1) END) END AS wait FROM s""")
def retry_states(spark, sf_dir):
    i = F.col("event_id")
    outcome = F.when(F.col("event_type") == "error", F.when(i % 41 == 0, "refused").otherwise("error")).when(i % 5 == 0, "ok").otherwise("error")
    attempts = table(spark, sf_dir, "events").where("event_id % 700 < 600 and event_id % 700 >= event_id div 700 * 20").select((i % 700).alias("request_id"), i.alias("attempt"), outcome.alias("outcome"), F.when(i % 8 == 0, F.col("value")).alias("retry_after"))
    return evidence.retry_plan(attempts, 6, 1.5, 20.0)


def _leased(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id")).distinct()
    issued = docs.where("request_id % 10 = 0").select(F.concat(F.lit("w"), (F.col("request_id") % 40 / 10).cast("int").cast("string")).alias("worker"), F.concat(F.lit("b"), (F.col("request_id") % 120).cast("string")).alias("batch"), "request_id")
    released = issued.where("request_id % 120 in (0, 10, 40, 80)").select("batch").distinct()
    done = docs.where("request_id % 3 = 0 or request_id % 40 = 20")
    return docs, issued, released, done


_LEASED = """d AS (SELECT DISTINCT doc_id AS request_id FROM documents), iss AS (SELECT 'w' || (request_id % 40 // 10)::VARCHAR AS worker, 'b' || (request_id % 120)::VARCHAR AS batch, request_id FROM d WHERE request_id % 10 = 0),
rel AS (SELECT DISTINCT batch FROM iss WHERE request_id % 120 IN (0, 10, 40, 80)), done AS (SELECT request_id FROM d WHERE request_id % 3 = 0 OR request_id % 40 = 20)"""


@query(f"""WITH {_LEASED}, pend AS (SELECT worker, request_id, batch FROM iss WHERE batch NOT IN (SELECT batch FROM rel) AND request_id NOT IN (SELECT request_id FROM done)),
wk AS (SELECT DISTINCT worker FROM iss UNION SELECT 'w8' UNION SELECT 'w9'), idle AS (SELECT worker, row_number() OVER (ORDER BY worker) - 1 AS turn FROM wk WHERE worker NOT IN (SELECT worker FROM pend)),
free AS (SELECT request_id, (row_number() OVER (ORDER BY request_id) - 1) // 3 AS turn FROM d WHERE request_id NOT IN (SELECT request_id FROM iss) AND request_id NOT IN (SELECT request_id FROM done)),
new AS (SELECT worker, request_id FROM free JOIN idle USING (turn)), ids AS (SELECT worker, left(sha256(worker || ':' || string_agg(request_id::VARCHAR, ':' ORDER BY request_id)), 20) AS batch FROM new GROUP BY worker)
SELECT worker, request_id, batch, false AS fresh FROM pend UNION ALL SELECT worker, request_id, batch, true FROM new JOIN ids USING (worker)""")
def lease_issue(spark, sf_dir):
    """What every worker holds: its pending batch, or three requests that no batch reserves."""
    docs, issued, released, done = _leased(spark, sf_dir)
    workers = issued.select("worker").unionByName(spark.createDataFrame([("w8",), ("w9",)], "worker string"))
    return evidence.leases(docs, issued, released, done, workers, 3)


@query(f"""WITH {_LEASED}, o AS (SELECT 'b' || (request_id % 120)::VARCHAR AS batch, 'w' || (request_id % 50 // 10)::VARCHAR AS worker, request_id FROM d WHERE request_id % 5 = 0)
SELECT o.batch, o.worker, o.request_id, CASE WHEN o.batch IN (SELECT batch FROM rel) THEN 'released' WHEN iss.worker IS NULL THEN 'not_issued' WHEN iss.worker <> o.worker THEN 'another_worker' WHEN o.request_id IN (SELECT request_id FROM done) THEN 'recorded_before' END AS problem
FROM o LEFT JOIN iss ON iss.batch = o.batch AND iss.request_id = o.request_id""")
def lease_ingest(spark, sf_dir):
    docs, issued, released, done = _leased(spark, sf_dir)
    i = F.col("request_id")
    outputs = docs.where(i % 5 == 0).select(F.concat(F.lit("b"), (i % 120).cast("string")).alias("batch"), F.concat(F.lit("w"), (i % 50 / 10).cast("int").cast("string")).alias("worker"), "request_id")
    return evidence.ingest_problems(outputs, issued, released, done).select("batch", "worker", "request_id", "problem")


@query(f"""WITH p AS (SELECT doc_id, lang, source, text, n_chars FROM documents), c AS (SELECT count(*) FILTER (NOT coalesce(length(text) = n_chars, false)) AS size_matches, count(*) FILTER (NOT coalesce(len(regexp_extract_all(text, '{WORD}')) BETWEEN 5 AND 2000, false)) AS words_in_bounds,
count(*) FILTER (lang IS NULL OR source IS NULL) AS has_work, count(*) - count(DISTINCT doc_id) AS repeated_ids, count(*) - count(DISTINCT text) AS repeated_texts, count(DISTINCT lang) AS authors FROM p)
SELECT "check", found, wanted, found = wanted AS ok FROM (SELECT unnest([{{'check': 'size_matches', 'found': size_matches, 'wanted': 0::BIGINT}}, {{'check': 'words_in_bounds', 'found': words_in_bounds, 'wanted': 0::BIGINT}}, {{'check': 'has_work', 'found': has_work, 'wanted': 0::BIGINT}},
{{'check': 'repeated_ids', 'found': repeated_ids, 'wanted': 0::BIGINT}}, {{'check': 'repeated_texts', 'found': repeated_texts, 'wanted': 0::BIGINT}}, {{'check': 'authors', 'found': authors, 'wanted': 4::BIGINT}}], recursive := true) FROM c)""")
def corpus_invariants(spark, sf_dir):
    """The assertions a corpus must pass, each with how many rows break it."""
    docs = table(spark, sf_dir, "documents")
    checks = {"size_matches": F.length("text") == F.col("n_chars"), "words_in_bounds": F.size(T.words(F.col("text"))).between(5, 2000), "has_work": F.col("lang").isNotNull() & F.col("source").isNotNull()}
    expected = {"repeated_ids": (F.count("*") - F.countDistinct("doc_id"), 0), "repeated_texts": (F.count("*") - F.countDistinct(F.sha2("text", 256)), 0), "authors": (F.countDistinct("lang"), 4)}
    return evidence.failures(docs, checks, expected)


@query("""WITH g AS (SELECT conv_id, turn, role, lag(turn) OVER w AS before, lag(role) OVER w AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT count(*) FILTER (NOT coalesce(turn = coalesce(before + 1, 0), false)) AS turns_in_order, count(*) FILTER (NOT coalesce(role <> coalesce(last, ''), false)) AS roles_change, count(*) FILTER (NOT coalesce(role <> 'system' OR before IS NULL, false)) AS system_first, count(DISTINCT role) AS roles FROM g)
SELECT "check", found, wanted, found = wanted AS ok FROM (SELECT unnest([{'check': 'turns_in_order', 'found': turns_in_order, 'wanted': 0::BIGINT}, {'check': 'roles_change', 'found': roles_change, 'wanted': 0::BIGINT}, {'check': 'system_first', 'found': system_first, 'wanted': 0::BIGINT}, {'check': 'roles', 'found': roles, 'wanted': 3::BIGINT}], recursive := true) FROM c)""")
def grid_invariants(spark, sf_dir):
    """The assertions a grid of outcomes must pass: complete in its order, and nothing where it must not be."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("turn", "role", F.lag("turn").over(w).alias("before"), F.lag("role").over(w).alias("last"))
    checks = {"turns_in_order": F.col("turn") == F.coalesce(F.col("before") + 1, F.lit(0)), "roles_change": F.col("role") != F.coalesce("last", F.lit("")), "system_first": (F.col("role") != "system") | F.col("before").isNull()}
    return evidence.failures(rows, checks, {"roles": (F.countDistinct("role"), 3)})


@query("""WITH s AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) * 300 AS a, n_chars FROM documents), t AS (SELECT doc_id, lang, source, a, a + n_chars AS b FROM s)
SELECT doc_id, lang, source FROM (SELECT *, max(b) OVER (PARTITION BY lang, source ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t) WHERE a < reach""")
def overlapping_spans(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id")) * 300
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", place.cast("long").alias("a"), "n_chars").withColumn("b", F.col("a") + F.col("n_chars"))
    return evidence.overlapping(rows, ["lang", "source"], "a", "b").select("doc_id", "lang", "source")


@query("""WITH again AS (SELECT event_type, user_id, avg(value) AS mean, count(*) AS n FROM events GROUP BY ALL), stored AS (SELECT event_type, user_id, mean + CASE WHEN user_id % 9 = 0 THEN 1e-9 WHEN user_id % 10 = 0 THEN 1e-14 ELSE 0 END AS mean, CASE WHEN user_id % 11 = 0 THEN n + 1 ELSE n END AS n FROM again WHERE user_id % 12 <> 0
  UNION ALL SELECT 'extra', 1, 1.0, 1)
SELECT * FROM (SELECT coalesce(s.event_type, a.event_type) AS event_type, coalesce(s.user_id, a.user_id) AS user_id, CASE WHEN s.user_id IS NULL THEN 'unexpected' WHEN a.user_id IS NULL THEN 'missing' WHEN abs(s.mean - a.mean) > 1e-12 THEN 'mean' WHEN s.n <> a.n THEN 'n' END AS problem FROM stored s FULL JOIN again a ON s.event_type = a.event_type AND s.user_id = a.user_id) WHERE problem IS NOT NULL""")
def recomputed_estimates(spark, sf_dir):
    """Stored figures against their recomputation, to a tolerance of 1e-12."""
    u = F.col("user_id")
    again = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    off = F.when(u % 9 == 0, 1e-9).when(u % 10 == 0, 1e-14).otherwise(0.0)
    stored = again.where(u % 12 != 0).select("event_type", "user_id", (F.col("mean") + off).alias("mean"), F.when(u % 11 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    stored = stored.unionByName(spark.createDataFrame([("extra", 1, 1.0, 1)], "event_type string, user_id long, mean double, n long"))
    return evidence.recomputed(stored, again, ["event_type", "user_id"], ["mean", "n"], 1e-12)


@query(f"""WITH j AS (SELECT doc_id, CASE WHEN n_chars < 200 THEN 'fail' WHEN contains(text, '@') THEN 'warning' ELSE 'pass' END AS status FROM documents)
SELECT doc_id, 'status' AS problem FROM j WHERE status <> CASE WHEN doc_id % 23 = 0 THEN 'pass' ELSE status END""")
def reconciled_statuses(spark, sf_dir):
    """Stored quality statuses against those that the rules give now."""
    now = F.when(F.col("n_chars") < 200, "fail").when(F.col("text").contains("@"), "warning").otherwise("pass")
    again = table(spark, sf_dir, "documents").select("doc_id", now.alias("status"))
    return evidence.recomputed(again.withColumn("status", F.when(F.col("doc_id") % 23 == 0, "pass").otherwise(F.col("status"))), again, ["doc_id"], ["status"])


@query("""WITH f AS (SELECT page_id::VARCHAR AS name, sha256(html) AS h, strlen(html) AS n FROM pages), m AS (SELECT CASE WHEN name::BIGINT % 31 = 0 THEN 'gone' || name ELSE name END AS name, CASE WHEN name::BIGINT % 17 = 0 THEN sha256('x') ELSE h END AS h, CASE WHEN name::BIGINT % 13 = 0 THEN n + 1 ELSE n END AS n FROM f)
SELECT * FROM (SELECT coalesce(m.name, f.name) AS name, CASE WHEN m.name IS NULL THEN 'unlisted' WHEN f.name IS NULL THEN 'missing' WHEN m.n <> f.n THEN 'size' WHEN m.h <> f.h THEN 'hash' END AS problem FROM m FULL JOIN f ON m.name = f.name) WHERE problem IS NOT NULL""")
def manifest_linkage(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"))
    i = F.col("name").cast("long")
    manifest = files.select(F.when(i % 31 == 0, F.concat(F.lit("gone"), "name")).otherwise(F.col("name")).alias("name"), F.when(i % 17 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")).alias("sha256"), F.when(i % 13 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"))
    return evidence.linked(manifest, files)


@query("""WITH o AS (SELECT 'V2_' || doc_id AS id, text FROM documents), r AS (SELECT 'V2_' || doc_id AS id, CASE WHEN doc_id % 40 = 0 THEN text ELSE text || '!' END AS text, 'reviewed' AS reason FROM documents WHERE doc_id % 20 = 0 UNION ALL SELECT 'V2_none', 'x', 'reviewed')
SELECT CASE WHEN r.id IS NOT NULL THEN replace(r.id, 'V2_', 'V3_') ELSE o.id END AS id, coalesce(o.id, r.id) AS old_id, sha256(o.text) AS old_sha256, sha256(coalesce(r.text, o.text)) AS new_sha256, CASE WHEN r.id IS NOT NULL THEN 'replacement' ELSE 'unchanged' END AS disposition, coalesce(reason, 'retained') AS reason,
CASE WHEN o.id IS NULL THEN 'unknown_target' WHEN r.text = o.text THEN 'not_changed' END AS problem FROM o FULL JOIN r ON r.id = o.id""")
def corrected_lineage(spark, sf_dir):
    """A corpus with replaced texts under new names, and where each came from."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("V2_"), "doc_id").alias("id"), "doc_id", "text")
    new = rows.where("doc_id % 20 = 0").select("id", F.when(F.col("doc_id") % 40 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("text"), F.lit("reviewed").alias("reason"))
    new = new.unionByName(spark.createDataFrame([("V2_none", "x", "reviewed")], "id string, text string, reason string"))
    done = evidence.corrected(rows.drop("doc_id"), new, "id", F.replace("id", F.lit("V2_"), F.lit("V3_")))
    return done.select("id", F.col("old_key").alias("old_id"), "old_sha256", "new_sha256", "disposition", "reason", "problem")


@query("""WITH i AS (SELECT lang || '/' || source AS name, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS digest FROM documents GROUP BY lang, source), r AS (SELECT name, CASE WHEN length(name) % 2 = 0 THEN digest ELSE sha256(name) END AS made_from FROM i UNION ALL SELECT 'nowhere', 'x')
SELECT r.name, CASE WHEN i.name IS NULL THEN 'orphan' WHEN made_from = digest THEN 'current' ELSE 'stale' END AS status FROM r LEFT JOIN i USING (name)""")
def stale_results(spark, sf_dir):
    name = F.concat_ws("/", "lang", "source").alias("name")
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string")), ","), 256)
    inputs = table(spark, sf_dir, "documents").groupBy(name).agg(digest.alias("digest"))
    results = inputs.select("name", F.when(F.length("name") % 2 == 0, F.col("digest")).otherwise(F.sha2("name", 256)).alias("made_from"))
    results = results.unionByName(spark.createDataFrame([("nowhere", "x")], "name string, made_from string"))
    return evidence.stale(results, inputs).select("name", "status")


@query("""WITH e AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS estimate FROM orders GROUP BY ALL), b AS (SELECT o_orderstatus AS s, o_orderpriority AS p, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders WHERE o_orderpriority < '3' GROUP BY ALL)
SELECT s, p, CASE WHEN low IS NULL THEN estimate::VARCHAR ELSE estimate || ' [' || low || ', ' || high || ']' END AS cell FROM e LEFT JOIN b USING (s, p)""")
def assembled_table(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), "o_orderkey")
    bounds = rows.where("p < '3'").groupBy("s", "p").agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    return evidence.interval_table(rows.groupBy("s", "p").agg(F.count("*").alias("estimate")), bounds, ["s", "p"])


@query("""WITH c AS (SELECT l_returnflag AS r, l_linestatus AS s, l_linenumber AS n, year(l_shipdate)::INT AS y, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY ALL),
w AS (SELECT r, s, n::INT AS n, y::INT AS y FROM (VALUES ('A'), ('R'), ('Z')) a(r), (VALUES ('F'), ('O')) b(s), range(1, 9) c(n), range(1992, 2000) d(y))
SELECT r, s, n, y, total, total IS NOT NULL AS found FROM w LEFT JOIN c USING (r, s, n, y)""")
def report_lookup(spark, sf_dir):
    """The cells that a report names by four keys, those that were not measured too."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("r"), F.col("l_linestatus").alias("s"), F.col("l_linenumber").alias("n"), F.year("l_shipdate").alias("y"), "l_quantity")
    cells = rows.groupBy("r", "s", "n", "y").agg(F.round(F.sum("l_quantity"), 2).alias("total"))
    one = spark.range(1).select(F.array(*map(F.lit, "ARZ")).alias("r"), F.array(*map(F.lit, "FO")).alias("s"), F.sequence(F.lit(1), F.lit(8)).alias("n"), F.sequence(F.lit(1992), F.lit(1999)).alias("y"))
    lines = one
    for c in "rsny":
        lines = lines.withColumn(c, F.explode(c))
    return evidence.looked_up(lines, cells, ["r", "s", "n", "y"], "total")


@query("""WITH r AS (SELECT event_type, list_sort(list(value)) AS v, quantile_cont(value, 0.025) AS a, quantile_cont(value, 0.975) AS b FROM events GROUP BY event_type)
SELECT event_type, round(a, 6) AS linear_low, round(b, 6) AS linear_high, v[floor(len(v) * 0.025::DOUBLE)::INT + 1] AS cut_low, v[floor(len(v) * 0.975::DOUBLE)::INT] AS cut_high FROM r""")
def replicate_bounds(spark, sf_dir):
    rows = evidence.replicate_bounds(table(spark, sf_dir, "events"), ["event_type"], "value")
    return rows.withColumns({c: F.round(c, 6) for c in ("linear_low", "linear_high")})


@query(f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{WORD}') AS tok, {SENTENCES} AS s, string_split(text, '') AS ch FROM documents), f AS (SELECT *, len(tok)::DOUBLE AS n, len(s)::DOUBLE AS k FROM t)
SELECT doc_id, n::BIGINT AS word_count, k::BIGINT AS sentence_count, round(CASE WHEN k > 0 THEN list_sum(s) / k ELSE 0 END, 3) AS mean_sentence_words, round(CASE WHEN k > 0 THEN len(list_filter(s, lambda x: x >= 40)) / k ELSE 0 END, 6) AS long_sentence_ratio,
round(CASE WHEN n > 0 THEN len(regexp_extract_all(text, {_ANY})) * 1000.0 / n ELSE 0 END, 3) AS punctuation_per_1000w, round(CASE WHEN n > 0 THEN (length(text) - length(replace(text, ';', ''))) * 1000.0 / n ELSE 0 END, 3) AS semicolon_per_1000w, len(regexp_extract_all(text, '["“”‘’]'))::BIGINT AS dialogue_marker_count,
round(CASE WHEN n > 0 THEN (length(text) - length(replace(replace(text, chr(39), ''), '’', ''))) * 1000.0 / n ELSE 0 END, 3) AS apostrophe_per_1000w, round(CASE WHEN n > 0 THEN len(regexp_extract_all(text, '["“”‘’]')) * 1000.0 / n ELSE 0 END, 3) AS dialogue_marker_per_1000w,
round(CASE WHEN n > 0 THEN {_COUNTS['dash']} * 1000.0 / n ELSE 0 END, 3) AS dash_per_1000w,
len(list_filter(regexp_split_to_array(trim(text, e' \\t\\n\\r'), '\\n\\s*\\n'), lambda x: trim(x) <> ''))::BIGINT AS paragraph_count FROM f""")
def passage_measures(spark, sf_dir):
    """The eleven measures of a candidate passage."""
    t = table(spark, sf_dir, "documents").select("doc_id", "text", T.words(F.lower("text")).alias("tokens"), T.sentence_lengths(F.col("text")).alias("lens"))
    made = S.passage_metrics(F.col("text"), F.col("tokens"), F.col("lens"))
    return t.select("doc_id", *(v.alias(k) for k, v in made.items()))


@query(f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{WORD}') AS tok, {SENTENCES} AS s, string_split(text, '') AS ch FROM documents), f AS (SELECT *, len(tok)::DOUBLE AS n, len(s)::DOUBLE AS k FROM t)
SELECT doc_id, n::BIGINT AS word_count, k::BIGINT AS sentence_count, round(CASE WHEN k > 0 THEN list_sum(s) / k ELSE 0 END, 3) AS mean_sentence_words, round(CASE WHEN k > 0 THEN list_median(s) ELSE 0 END, 3) AS median_sentence_words, round(CASE WHEN k > 1 THEN list_stddev_pop(s) ELSE 0 END, 3) AS std_sentence_words,
round(CASE WHEN k > 0 THEN len(list_filter(s, lambda x: x >= 40)) / k ELSE 0 END, 6) AS long_sentence_ratio, round(CASE WHEN n > 0 THEN {_COUNTS['punctuation']} * 1000.0 / n ELSE 0 END, 3) AS punctuation_per_1000w, round(CASE WHEN n > 0 THEN {_COUNTS['semicolon']} * 1000.0 / n ELSE 0 END, 3) AS semicolon_per_1000w, round(CASE WHEN n > 0 THEN {_COUNTS['dash']} * 1000.0 / n ELSE 0 END, 3) AS dash_per_1000w, round(CASE WHEN n > 0 THEN {_COUNTS['quote_mark']} * 1000.0 / n ELSE 0 END, 3) AS quote_mark_per_1000w, round(CASE WHEN n > 0 THEN {_COUNTS['apostrophe']} * 1000.0 / n ELSE 0 END, 3) AS apostrophe_per_1000w, round(CASE WHEN n > 0 THEN {_COUNTS['ellipsis']} * 1000.0 / n ELSE 0 END, 3) AS ellipsis_per_1000w,
round(CASE WHEN k > 0 THEN len(list_filter(s, lambda x: x <= 10)) / k ELSE 0 END, 6) AS short_sentence_ratio, round(CASE WHEN n > 0 THEN (length(text) - length(replace(text, ',', ''))) * 1000.0 / n ELSE 0 END, 3) AS comma_per_1000w,
round(CASE WHEN n > 0 THEN (length(text) - length(replace(text, ':', ''))) * 1000.0 / n ELSE 0 END, 3) AS colon_per_1000w, round(CASE WHEN n > 0 THEN (length(text) - length(replace(text, '?', ''))) * 1000.0 / n ELSE 0 END, 3) AS question_per_1000w, round(CASE WHEN n > 0 THEN (length(text) - length(replace(text, '!', ''))) * 1000.0 / n ELSE 0 END, 3) AS exclamation_per_1000w,
round(CASE WHEN n > 0 THEN len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+[’''][\\p{{L}}\\p{{N}}_]+')) * 1000.0 / n ELSE 0 END, 3) AS contraction_per_1000w,
round(CASE WHEN n > 0 THEN len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^.+(tion|sion|ity|ness|ment|ance|ence)$'))) * 1000.0 / n ELSE 0 END, 3) AS abstract_suffix_per_1000w,
round(CASE WHEN n > 0 THEN len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ('thou', 'thee', 'thy', 'thine', 'hath', 'doth', 'art', 'wilt', 'shalt', 'ere', 'nay'))) * 1000.0 / n ELSE 0 END, 3) AS archaic_marker_per_1000w FROM f""")
def validation_measures(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", "text", T.words(F.lower("text")).alias("tokens"), T.sentence_lengths(F.col("text")).alias("lens"))
    made = S.validation_metrics(F.col("text"), F.col("tokens"), F.col("lens"))
    return t.select("doc_id", *(v.alias(k) for k, v in made.items()))


@query(f"""WITH a AS (SELECT doc_id, text, (length(text) // 3)::INT AS x, (length(text) // 2)::INT AS y FROM documents)
SELECT doc_id, sha256(substring(text, greatest(x - 2500, 0) + 1, x - greatest(x - 2500, 0))) AS before, sha256(substring(text, x + 1, y - x)) AS span, sha256(substring(text, y + 1, 2500)) AS after, len(regexp_extract_all(substring(text, 1, x), '{WORD}'))::BIGINT AS words_before FROM a WHERE x < y""")
def contexts(spark, sf_dir):
    """What stands within 2,500 characters of a span, and how many words begin before it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.length("text") / 3).cast("int").alias("x"), F.floor(F.length("text") / 2).cast("int").alias("y"))
    rows = rows.select("doc_id", S.context(F.col("text"), F.col("x"), F.col("y"), 2500).alias("c"), S.word_index(F.col("text"), F.col("x")).cast("long").alias("words_before"))
    return rows.where("c is not null").select("doc_id", *(F.sha2(f"c.{k}", 256).alias(k) for k in ("before", "span", "after")), "words_before")


@query("""WITH h AS (SELECT page_id, html, len(regexp_extract_all(html, '(?i)<head>')) AS a, len(regexp_extract_all(html, '(?i)<body>')) AS b, strpos(lower(html), '<head>') - 1 AS x, strpos(lower(html), '<body>') - 1 AS y FROM pages)
SELECT page_id, CASE WHEN a = 1 AND b = 1 AND y > x THEN x END::BIGINT AS begin, CASE WHEN a = 1 AND b = 1 AND y > x THEN y END::BIGINT AS stop FROM h""")
def anchored_bounds(spark, sf_dir):
    """From one anchor that stands once to another that stands once after it."""
    rows = table(spark, sf_dir, "pages").select("page_id", S.work_bounds(F.col("html"), "<head>", "<body>").alias("b"))
    return rows.select("page_id", F.col("b.begin").cast("long").alias("begin"), F.col("b.stop").cast("long").alias("stop"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' END AS reused, CASE WHEN doc_id % 6 <> 0 THEN 'new' END AS made FROM documents)
SELECT doc_id, coalesce(made, reused) AS outcome FROM r""")
def reused_or_new(spark, sf_dir):
    """The new outcome of a request, else the reused one, else none."""
    rows = table(spark, sf_dir, "documents").select("doc_id")
    old, new = rows.where("doc_id % 4 = 0").withColumn("old", F.lit("old")), rows.where("doc_id % 6 <> 0").withColumn("new", F.lit("new"))
    return rows.join(old.distinct(), "doc_id", "left").join(new.distinct(), "doc_id", "left").select("doc_id", F.coalesce("new", "old").alias("outcome"))


@query("""SELECT event_type, count(*) AS attempted, count(*) FILTER (value >= 5) AS valid, round(avg(value) FILTER (value >= 5), 6) AS mean_value, count(DISTINCT user_id) AS models, (min(ts)::DATE)::VARCHAR AS first_day, (max(ts)::DATE)::VARCHAR AS last_day FROM events GROUP BY event_type""")
def generation_summary(spark, sf_dir):
    valid = F.col("value") >= 5
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("attempted"), F.count_if(valid).alias("valid"), F.round(F.avg(F.when(valid, F.col("value"))), 6).alias("mean_value"), F.countDistinct("user_id").alias("models"), F.to_date(F.min("ts")).cast("string").alias("first_day"), F.to_date(F.max("ts")).cast("string").alias("last_day"))


@query("""WITH c AS (SELECT quality AS rating, count(*) AS n FROM labels GROUP BY 1) SELECT r::INT AS rating, coalesce(n, 0) AS n FROM range(0, 6) t(r) LEFT JOIN c ON c.rating = r""")
def rating_histogram(spark, sf_dir):
    """How often each of the possible ratings was given, those never given too."""
    counts = table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("rating")).agg(F.count("*").alias("n"))
    return spark.range(6).select(F.col("id").cast("int").alias("rating")).join(counts, "rating", "left").fillna(0, ["n"])
