"""Cleaning, tokenising, judging and cutting texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions import passages as P
from quillmark.functions import text as T
from quillmark.operators import assembly, locate, qc, style
from quillmark.plans._base import query
from quillmark.sources.io import table, text_digest

WORD = r"[\p{L}\p{N}_]+(?:[’''-]+[\p{L}\p{N}_]+)*"
ASCII = "[a-z]+(?:''[a-z]+)?|[0-9]+(?:\\.[0-9]+)?"
SENTENCES = f"list_filter(list_transform(regexp_extract_all(text, '[^.!?]+(?:[.!?]+[\"”’]*|$)'), lambda s: len(regexp_extract_all(s, '{WORD}'))), lambda n: n > 0)"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_NEG = ", ".join("'" + w.replace("'", "''") + "'" for w in T.NEGATIONS)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS words, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+(?:[’''-][\\p{{L}}\\p{{N}}_]+)?'))::BIGINT AS loose_words, len(regexp_extract_all(lower(text), '{ASCII}'))::BIGINT AS ascii_tokens FROM documents")
def token_counts(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(T.words(t)).cast("long").alias("words"), F.size(T.loose_words(t)).cast("long").alias("loose_words"), F.size(T.ascii_tokens(t)).cast("long").alias("ascii_tokens"))


@query(f"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '{ASCII}'), lambda t: length(t) > 2 AND t NOT IN ({_STOP})))::BIGINT AS content, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b[0-9]+(?:\\.[0-9]+)?\\b'))), ';') AS numbers, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '{ASCII}'), lambda t: t IN ({_NEG})))), ';') AS negations FROM documents")
def content_numbers_negations(spark, sf_dir):
    t = F.col("text")
    negations = F.array_sort(F.array_distinct(F.filter(T.ascii_tokens(t), lambda x: x.isin(T.NEGATIONS))))
    return _docs(spark, sf_dir).select("doc_id", F.size(T.content_tokens(t)).cast("long").alias("content"), F.array_join(T.numbers(t), ";").alias("numbers"), F.array_join(negations, ";").alias("negations"))


@query(f"WITH s AS (SELECT doc_id, {SENTENCES} AS n FROM documents) SELECT doc_id, len(n)::BIGINT AS sentences, coalesce(list_sum(n), 0)::BIGINT AS words, coalesce(list_max(n), 0)::BIGINT AS longest FROM s")
def sentence_lengths(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", T.sentence_lengths(F.col("text")).alias("n"))
    return rows.select("doc_id", F.size("n").cast("long").alias("sentences"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"), F.coalesce(F.array_max("n"), F.lit(0)).cast("long").alias("longest"))


@query(f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{WORD}') AS tok, {SENTENCES} AS s FROM documents),
f AS (SELECT doc_id, len(tok)::DOUBLE AS n, len(s)::DOUBLE AS k, text, tok, s FROM t)
SELECT doc_id, n AS word_count_feature, k AS sentence_count_feature, round(CASE WHEN k > 0 THEN list_sum(s) / k ELSE 0 END, 6) AS mean_sentence_words, round(CASE WHEN k > 0 THEN list_median(s) ELSE 0 END, 6) AS median_sentence_words,
  round(CASE WHEN k > 0 THEN len(list_filter(s, lambda x: x <= 10)) / k ELSE 0 END, 6) AS short_sentence_ratio, round(CASE WHEN k > 0 THEN len(list_filter(s, lambda x: x >= 40)) / k ELSE 0 END, 6) AS long_sentence_ratio,
  round(CASE WHEN n > 0 THEN (length(text) - length(replace(text, ',', ''))) * 1000.0 / n ELSE 0 END, 5) AS comma_per_1000w, round(CASE WHEN n > 0 THEN len(regexp_extract_all(text, '[.,;:!?—–"“”‘’''…-]')) * 1000.0 / n ELSE 0 END, 5) AS punctuation_per_1000w,
  round(CASE WHEN n > 0 THEN len(list_distinct(tok)) / n ELSE 0 END, 6) AS type_token_ratio, round(CASE WHEN n > 0 THEN len(list_distinct(tok)) / sqrt(n) ELSE 0 END, 6) AS root_type_token_ratio,
  round(CASE WHEN n > 0 THEN length(array_to_string(tok, '')) / n ELSE 0 END, 6) AS avg_word_length, round(CASE WHEN n > 0 THEN len(list_filter(tok, lambda x: length(x) >= 8)) / n ELSE 0 END, 6) AS long_word_ratio, round(CASE WHEN n > 0 THEN len(list_filter(tok, lambda x: length(x) <= 3)) / n ELSE 0 END, 6) AS short_word_ratio
FROM f""")
def scalar_stylometry(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "text", T.words(F.lower("text")).alias("tokens"), T.sentence_lengths(F.col("text")).alias("lens"))
    names = ["word_count_feature", "sentence_count_feature", "mean_sentence_words", "median_sentence_words", "short_sentence_ratio", "long_sentence_ratio", "comma_per_1000w", "punctuation_per_1000w", "type_token_ratio", "root_type_token_ratio", "avg_word_length", "long_word_ratio", "short_word_ratio"]
    made = T.stylometry(F.col("text"), F.col("tokens"), F.col("lens"))
    return rows.select("doc_id", *(F.round(made[k], 5 if k.endswith("1000w") else 6).alias(k) for k in names))


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS tok FROM documents), c AS (SELECT doc_id, tok, count(*) AS n FROM t GROUP BY ALL),
h AS (SELECT doc_id, count(*) FILTER (n = 1) AS once, sum(n) AS n FROM c GROUP BY ALL) SELECT doc_id, round(coalesce(once::DOUBLE / n, 0), 6) AS hapax_ratio FROM documents LEFT JOIN h USING (doc_id)""")
def hapax_ratio(spark, sf_dir):
    rows = style.hapax_ratio(_docs(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    return rows.select("doc_id", F.round("value", 6).alias("hapax_ratio"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, len(list_filter(l, lambda x: trim(x) <> '' AND regexp_matches(trim(x), '(?i)license|copyright')))::BIGINT AS removed, sha256(array_to_string(list_filter(l, lambda x: NOT (trim(x) <> '' AND regexp_matches(trim(x), '(?i)license|copyright'))), chr(10))) AS kept_sha256 FROM l""")
def artifact_lines(spark, sf_dir):
    kept, removed = T.drop_lines(F.col("text"), "license|copyright")
    return _docs(spark, sf_dir).select("doc_id", removed.cast("long").alias("removed"), F.sha2(kept, 256).alias("kept_sha256"))


@query(r"""WITH c AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
w AS (SELECT page_id, length(html) AS raw_chars, length(regexp_replace(t, '\s+', ' ', 'g')) AS cleaned_chars FROM c)
SELECT page_id, raw_chars, cleaned_chars, round((raw_chars - cleaned_chars)::DOUBLE / raw_chars, 6) AS char_loss_ratio, (raw_chars - cleaned_chars)::DOUBLE / raw_chars > 0.35 AS high_character_loss FROM w""")
def html_cleaning_loss(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)>", " "), "<[^>]*>", " ")
    rows = table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("raw_chars"), F.length(F.regexp_replace(bare, r"\s+", " ")).cast("long").alias("cleaned_chars"))
    loss = (F.col("raw_chars") - F.col("cleaned_chars")) / F.col("raw_chars")
    return rows.select("*", F.round(loss, 6).alias("char_loss_ratio"), (loss > 0.35).alias("high_character_loss"))


@query(r"""SELECT page_id, regexp_matches(html, '(?is)<article>') AS has_start, sha256(trim(regexp_extract(html, '(?is)<article>(.*?)</article>', 1), chr(10) || chr(13) || chr(9) || ' ') || chr(10)) AS body_sha256 FROM pages WHERE regexp_matches(html, '(?is)<article>.*</article>')""")
def boilerplate_strip(spark, sf_dir):
    body, start, end = qc.strip_boilerplate(F.col("html"), "<article>", "</article>")
    rows = table(spark, sf_dir, "pages").select("page_id", body.alias("body"), start.alias("start"), end.alias("end")).where("start = 'start_marker_removed' and end = 'end_marker_removed'")
    return rows.select("page_id", (F.col("start") == "start_marker_removed").alias("has_start"), F.sha2("body", 256).alias("body_sha256"))


@query("""SELECT doc_id, sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS digest FROM documents""")
def text_digests(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text_digest(F.col("text")).alias("digest"))


@query(r"""SELECT doc_id, CASE WHEN w BETWEEN 450 AND 500 THEN '450-500' WHEN w BETWEEN 501 AND 575 THEN '501-575' WHEN w BETWEEN 576 AND 650 THEN '576-650' ELSE 'outside' END AS band
FROM (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[’''-]+[\p{L}\p{N}_]+)*')) AS w FROM documents)""")
def length_bands(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.quartile_class(F.size(T.words(F.col("text")))).alias("band"))


def _turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "rewritten": F.lead("text").over(w)})
    return turns.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("original"), "rewritten")


_TURNS = """WITH t AS (SELECT conv_id, turn, role, text AS original, lead(role) OVER w AS next_role, lead(text) OVER w AS rewritten FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id, turn, original, rewritten FROM t WHERE role = 'user' AND next_role = 'assistant')"""


@query(f"""{_TURNS}, n AS (SELECT conv_id, turn, len(regexp_extract_all(original, '{WORD}'))::DOUBLE AS a, len(regexp_extract_all(rewritten, '{WORD}'))::DOUBLE AS b, trim(rewritten) = '' AS e FROM r)
SELECT conv_id, turn, round(CASE WHEN a > 0 THEN b / a ELSE 0 END, 6) AS length_ratio, CASE WHEN e THEN 'fail' WHEN a > 0 AND (b / a < 0.85 OR b / a > 1.15) THEN 'warning' ELSE 'pass' END AS qc_status FROM n""")
def rewrite_length_qc(spark, sf_dir):
    """User turns against the answers that follow them: length rules and an empty answer."""
    rows = _turns(spark, sf_dir).withColumns({"a": F.size(T.words(F.col("original"))), "b": F.size(T.words(F.col("rewritten")))})
    rows = rows.withColumn("r", T.ratio(F.col("b"), F.col("a")))
    rules = {"empty_rewritten_text": F.trim("rewritten") == ""} | {k: (F.col("a") > 0) & v for k, v in qc.length_rules(F.col("r")).items()}
    return rows.select("conv_id", "turn", F.round("r", 6).alias("length_ratio"), qc.status_of(qc.flags_of(rules), ["empty_rewritten_text"]).alias("qc_status"))


_A = f"regexp_extract_all(lower({{0}}), '{ASCII}')"
_CONTENT = f"list_distinct(list_filter({_A}, lambda t: length(t) > 2 AND t NOT IN ({_STOP})))"


@query(f"""{_TURNS}, c AS (SELECT conv_id, turn, {_CONTENT.format('original')} AS a, {_CONTENT.format('rewritten')} AS b, len({_A.format('original')})::DOUBLE AS n, len({_A.format('rewritten')})::DOUBLE AS m,
  list_sort(list_distinct(list_filter({_A.format('original')}, lambda t: t IN ({_NEG})))) <> list_sort(list_distinct(list_filter({_A.format('rewritten')}, lambda t: t IN ({_NEG})))) AS neg FROM r)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS content_jaccard, round(CASE WHEN n > 0 THEN m / n ELSE 0 END, 6) AS word_ratio, neg AS negation_changed FROM c""")
def fidelity_measures(spark, sf_dir):
    rows = qc.fidelity_screen(_turns(spark, sf_dir))
    return rows.select("conv_id", "turn", F.round("content_jaccard", 6).alias("content_jaccard"), F.round("word_ratio", 6).alias("word_ratio"), "negation_changed")


@query()
def fidelity_risk(spark, sf_dir):
    """Risk levels of all answers: rests on look-around regexes that the other engine lacks."""
    return qc.fidelity_screen(_turns(spark, sf_dir)).groupBy("risk").agg(F.count("*").alias("pairs"), F.round(F.avg("content_jaccard"), 6).alias("mean_jaccard"))


@query(r"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)<think>') THEN 'think_open' END, CASE WHEN regexp_matches(text, '(?i)</think>') THEN 'think_close' END, CASE WHEN regexp_matches(text, '(?i)\bas an ai\b') THEN 'as_an_ai' END,
  CASE WHEN regexp_matches(text, '(?i)\bi cannot\b') THEN 'i_cannot' END, CASE WHEN regexp_matches(text, '(?i)\bhere is\b') THEN 'here_is' END, CASE WHEN regexp_matches(text, '(?i)\bbelow is\b') THEN 'below_is' END, CASE WHEN regexp_matches(text, '(?i)\bthe rewritten\b') THEN 'the_rewritten' END, CASE WHEN regexp_matches(text, '(?i)\bjson\b') THEN 'json_literal' END], lambda x: x IS NOT NULL), ';') AS phrases FROM conversations""")
def contamination_scan(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(qc.contamination(F.col("text")), ";").alias("phrases"))


@query(r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') THEN 'aws_key' END, CASE WHEN regexp_matches(text, '(?i)\bbearer\s+[A-Za-z0-9._-]{20,}') THEN 'bearer' END, CASE WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'private_key' END,
  CASE WHEN regexp_matches(text, '(?i)\b(?:api[_-]?key|token|secret)\s*[=:]\s*["''][A-Za-z0-9_-]{16,}["'']') THEN 'token_assignment' END], lambda x: x IS NOT NULL), ';') AS kinds FROM documents""")
def secret_scan(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(qc.secrets(F.col("text")), ";").alias("kinds"))


@query("SELECT item_id, count(doc_id) AS documents, min(doc_id) AS first_document, min(instr(d.text, b.text))::BIGINT AS first_place FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def exact_text_location(spark, sf_dir):
    """Where each item stands verbatim, against all documents."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = locate.first_places(_docs(spark, sf_dir), items, "doc_id", "item_id")
    hits = found.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_document"), F.min("at").alias("first_place"))
    return items.select("item_id").join(hits, "item_id", "left").fillna(0, ["documents"])


@query("""SELECT item_id, min(doc_id) AS doc_id, arg_min(instr(d.text, b.text), doc_id)::BIGINT AS at, CASE WHEN min(doc_id) IS NULL OR any_value(length(b.text)) < 200 THEN 'exclude_or_review' ELSE 'eligible_body' END AS disposition,
  CASE WHEN min(doc_id) IS NULL THEN 'no_exact_match_in_archived_edition' WHEN any_value(length(b.text)) < 200 THEN 'under_200_characters' ELSE 'exact_source_match_within_verified_work_body' END AS reason FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id""")
def text_location_audit(spark, sf_dir):
    """Whether each item may be used: where it first stands, and what speaks against it."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    places = locate.first_places(_docs(spark, sf_dir), items, "doc_id", "item_id")
    return locate.audited(items, places, "item_id", "doc_id", qc.flags_of({"under_200_characters": F.length("text") < 200}))


@query()
def passage_windows(spark, sf_dir):
    """Windows of 450 to 650 words on guarded sentence ends: a scan with state, held by tests to its invariants."""
    return P.windows(_docs(spark, sf_dir), "doc_id").drop("passage")


@query()
def prose_windows(spark, sf_dir):
    """Windows of 450 to 650 cleaned words in unblocked runs of paragraphs; tests hold them to a version that cleans and counts every candidate anew."""
    return assembly.prose_windows(_docs(spark, sf_dir), "doc_id").drop("passage")


@query()
def gapped_passage_windows(spark, sf_dir):
    return P.windows(_docs(spark, sf_dir), "doc_id", 450, 650, preferred=550, gap=150).drop("passage")


@query()
def middle_crops(spark, sf_dir):
    rows = P.crop(_docs(spark, sf_dir).select("doc_id", "text"), 200, "middle")
    return rows.select("doc_id", "view_start", "view_end", F.sha2("view", 256).alias("view_sha256"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages""")
def url_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))
