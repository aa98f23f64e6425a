"""Quality rules of rewrites and ratings: flags as arrays, and the status that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T


def flags_of(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def status_of(flags: Column, failing: list[str]) -> Column:
    """fail if a failing flag is there, else warning if any is, else pass."""
    return F.when(F.arrays_overlap(flags, F.array(*(F.lit(f) for f in failing))), "fail").when(F.size(flags) > 0, "warning").otherwise("pass")


RESPONSE = "request_id string, rewritten_text string"


def rewrite_qc(responses: DataFrame) -> DataFrame:
    """Judges responses (request_id, content, finish_reason, model, requested_model, source_sha256, original_words).

    content must be a JSON object of exactly request_id and rewritten_text. Adds rewritten_text, rewrite_words,
    length_ratio, qc_flags and qc_status.
    """
    keys = F.array_sort(F.json_object_keys("content"))
    parsed = F.from_json("content", RESPONSE)
    exact = keys == F.array(F.lit("request_id"), F.lit("rewritten_text"))
    is_text = F.get_json_object("content", "$.rewritten_text").isNotNull() & ~F.col("content").rlike('"rewritten_text"\\s*:\\s*[-0-9{\\[tfn]')
    valid = F.coalesce(F.try_parse_json("content").isNotNull(), F.lit(False))
    rows = responses.withColumns({"__exact": F.coalesce(exact, F.lit(False)), "__valid": valid})
    rows = rows.withColumn("rewritten_text", F.when(F.col("__exact") & is_text, F.trim(parsed.rewritten_text)).otherwise(""))
    rows = rows.withColumn("rewrite_words", F.size(T.words(F.col("rewritten_text"))))
    rows = rows.withColumn("length_ratio", F.try_divide(F.col("rewrite_words").cast("double"), F.col("original_words")))
    off = F.abs(F.col("length_ratio") - 1)
    failing = {
        "invalid_json": ~F.col("__valid"),
        "schema_mismatch": F.col("__valid") & ~F.col("__exact"),
        "request_id_mismatch": F.col("__exact") & ~parsed.request_id.eqNullSafe(F.col("request_id")),
        "text_not_string": F.col("__exact") & ~is_text,
        "empty_text": F.col("rewritten_text") == "",
        "incomplete_generation": ~F.col("finish_reason").eqNullSafe("stop"),
        "returned_model_mismatch": ~F.col("model").eqNullSafe(F.col("requested_model")),
        "identical_to_original": F.sha2("rewritten_text", 256) == F.col("source_sha256"),
    }
    rules = failing | {"length_deviation_over_20pct": off > 0.20, "length_deviation_over_15pct": (off > 0.15) & (off <= 0.20)}
    rows = rows.withColumn("qc_flags", flags_of(rules))
    return rows.withColumn("qc_status", status_of(F.col("qc_flags"), list(failing))).drop("__exact", "__valid")


def length_rules(ratio: Column) -> dict[str, Column]:
    hard = (ratio < 0.80) | (ratio > 1.20)
    return {"length_hard_warning": hard, "length_soft_warning": ~hard & ((ratio < 0.85) | (ratio > 1.15))}


def rewrite_qc_simple(pairs: DataFrame, conditions: list[str], forbidden: str) -> DataFrame:
    """Judges pairs (original, rewritten, condition): length, sentence count, list marks and leaked phrases.

    pairs may bring original_words in place of original, counted once for all rewritings of a text.
    """
    rows = pairs if "original_words" in pairs.columns else pairs.withColumn("original_words", F.size(T.words(F.col("original"))))
    rows = rows.withColumns({"rewrite_words": F.size(T.words(F.col("rewritten"))), "sentences": T.sentence_count(F.col("rewritten"))})
    rows = rows.withColumn("length_ratio", T.ratio(F.col("rewrite_words"), F.col("original_words")))
    failing = {
        "invalid_condition": ~F.col("condition").isin(conditions),
        "empty_rewritten_text": F.trim("rewritten") == "",
        "prompt_or_source_leakage": F.col("rewritten").rlike(f"(?i){forbidden}"),
        "markdown_or_list_format": F.col("rewritten").rlike(r"(?m)^\s*(?:[-*#]|[0-9]+\.)\s"),
    }
    lengths = {k: (F.col("original_words") > 0) & v for k, v in length_rules(F.col("length_ratio")).items()}
    rows = rows.withColumn("qc_flags", flags_of(failing | lengths | {"low_sentence_count": F.col("sentences") < 3}))
    return rows.withColumn("qc_status", status_of(F.col("qc_flags"), list(failing)))


def contamination(text: Column) -> Column:
    """The names of the phrases that give a machine's answer away."""
    return flags_of({k: text.rlike(f"(?i){p}") for k, p in T.CONTAMINATION.items()})


def fidelity_screen(pairs: DataFrame) -> DataFrame:
    """Eight warnings of a changed meaning for pairs (original, rewritten), and the risk: low, medium (one or two), high."""
    o, r = F.col("original"), F.col("rewritten")
    n, m = F.size(T.ascii_tokens(o)), F.size(T.ascii_tokens(r))
    quotes = lambda t: F.regexp_count(t, F.lit("[\"'“”‘’]"))
    negations = lambda t: F.array_sort(F.array_distinct(F.filter(T.ascii_tokens(t), lambda x: x.isin(T.NEGATIONS))))
    rows = pairs.withColumns({
        "content_jaccard": T.jaccard(F.array_distinct(T.content_tokens(o)), F.array_distinct(T.content_tokens(r))),
        "word_ratio": T.ratio(m, n),
        "missing_terms": F.array_except(T.capitalised(o), T.capitalised(r)),
        "added_terms": F.array_except(T.capitalised(r), T.capitalised(o)),
        "numbers_changed": T.numbers(o) != T.numbers(r),
        "quote_change": F.abs(quotes(o) - quotes(r)),
        "negation_changed": negations(o) != negations(r),
    })
    rules = {
        "low_content_overlap": F.col("content_jaccard") < 0.34,
        "large_compression": F.col("word_ratio") < 0.70,
        "large_expansion": F.col("word_ratio") > 1.35,
        "number_change": F.col("numbers_changed"),
        "many_original_capitalized_terms_missing": F.size("missing_terms") >= 3,
        "many_new_capitalized_terms_added": F.size("added_terms") >= 3,
        "large_quote_punctuation_change": F.col("quote_change") >= 4,
        "negation_set_changed": F.col("negation_changed"),
    }
    rows = rows.withColumn("flags", flags_of(rules))
    return rows.withColumn("risk", F.when(F.size("flags") == 0, "low").when(F.size("flags") <= 2, "medium").otherwise("high"))


BINARY = ["added_facts", "omitted_facts", "order_changed", "relationships_changed"]


def risky() -> Column:
    """A rating that reports a changed fact, a meaning of 3 or less, or an unusable text."""
    facts = F.lit(False)
    for name in BINARY:
        facts = facts | (F.col(name) == 1)
    return facts | (F.col("meaning_preservation") <= 3) | (F.col("usable") == "no")


def rating_errors(ratings: DataFrame) -> DataFrame:
    """ratings with errors: fields out of their domain, and risky ratings without a note."""
    outside = {f"invalid_{n}": F.coalesce(~F.col(n).isin(0, 1), F.lit(True)) for n in BINARY}
    outside |= {"invalid_tone_drift": F.coalesce(~F.col("tone_drift").isin(0, 1, 2), F.lit(True)), "invalid_meaning_preservation": F.coalesce(~F.col("meaning_preservation").between(1, 5), F.lit(True)), "invalid_usable": F.coalesce(~F.col("usable").isin("yes", "no"), F.lit(True))}
    return ratings.withColumn("errors", flags_of(outside | {"note_required": F.coalesce(risky(), F.lit(False)) & (F.trim(F.coalesce("notes", F.lit(""))) == "")}))


def salvage_json(content: Column) -> tuple[Column, Column]:
    """(status, rewritten text) of a model's answer: parsed, cut out of prose, repaired from a loose field, or taken raw."""
    raw = F.trim(F.regexp_replace(F.trim(content), r"(?is)^\s*<think>.*?</think>\s*", ""))
    raw = F.when(raw.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(raw, r"^```(?:json)?\s*", ""), r"\s*```\z", ""))).otherwise(raw)
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    ok = lambda x: F.try_parse_json(F.nullif(x, F.lit(""))).isNotNull()
    loose = F.regexp_replace(F.regexp_replace(F.regexp_extract(raw, '(?s)"rewritten_text"\\s*:\\s*"(.*)\\z', 1), r'\s*\}\s*\z', ""), r',\s*\z', "")
    loose = F.regexp_replace(F.trim(loose), '"\\z', "")
    keyed = raw.rlike('"passage_id"\\s*:\\s*"[^"]+"') & raw.rlike('"condition"\\s*:\\s*"[^"]+"') & (loose != "")
    status = F.when(ok(raw), "json_ok").when(ok(inner), "json_extracted").when(keyed, "json_repaired_loose_rewritten_text").otherwise("json_parse_failed_used_raw_content")
    text = F.when(ok(raw), F.get_json_object(raw, "$.rewritten_text")).when(ok(inner), F.get_json_object(inner, "$.rewritten_text")).when(keyed, loose).otherwise(F.coalesce(content, F.lit("")))
    return status, F.coalesce(text, F.lit(""))


def paragraph_issue(text: Column) -> Column:
    """The first of eight reasons against a paragraph, or an empty text."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: F.length(x) < 48)) / F.greatest(F.size(lines), F.lit(1))
    letters = F.length(F.regexp_replace(flat, r"\P{L}", "")) / F.greatest(F.length(flat), F.lit(1))
    return (
        F.when(flat.rlike(r"(?i)\b(?:Illustration|Transcriber|Redactor|Footnotes|Gutenberg|Copyright|CHISWICK PRESS)\b"), "editorial_or_illustration")
        .when(text.rlike(r"(?i)^\s*(?:\[Footnote|\(\*\d+\)|\[(?:\d+|[A-Z])\]|Notes\s+(?:to|[—-])|NOTE\.—)"), "note_body")
        .when(flat.rlike(r"(?i)^(?:CHAPTER|CHAP\.|BOOK|VOLUME|CONTENTS|PREFACE|CONCLUSION)\b") | flat.rlike(r"^[_ ]*[IVXLCDM]+[._ ]*\z"), "section_heading")
        .when((F.length(flat) < 200) & flat.rlike(r"^[A-Z\s\d—.,:;'’\-]+\z") & flat.contains(" "), "uppercase_heading_or_insert")
        .when((F.size(lines) >= 2) & (F.array_max(F.transform(lines, F.length)) < 65) & (flat.rlike("^-{2,}") | flat.rlike(r"\[[A-Z]\]\z")), "quoted_verse")
        .when((F.size(lines) >= 3) & (short >= 0.8), "verse_table_or_short_line_insert")
        .when((F.length(flat) > 30) & (letters < 0.5), "nonprose_or_cipher")
        .otherwise("")
    )


def strip_boilerplate(text: Column, start: str, end: str) -> tuple[Column, Column, Column]:
    """(body, start status, end status): what stands between the first start mark and the first end mark after it."""
    body = F.regexp_replace(text, "\r\n?", "\n")
    has_start = body.rlike(f"(?is){start}")
    after = F.when(has_start, F.regexp_extract(body, f"(?is)^.*?(?:{start})(.*)\\z", 1)).otherwise(body)
    has_end = after.rlike(f"(?is){end}")
    inner = F.when(has_end, F.regexp_extract(after, f"(?is)^(.*?)(?:{end})", 1)).otherwise(after)
    said = lambda x, name: F.when(x, f"{name}_marker_removed").otherwise(f"{name}_marker_not_found")
    return F.concat(F.regexp_replace(inner, r"^\s+|\s+\z", ""), F.lit("\n")), said(has_start, "start"), said(has_end, "end")


def cleaning_report(before: Column, after: Column) -> dict[str, Column]:
    """Sizes, losses and warnings of a cleaning."""
    chars, words = F.length(before), F.size(T.words(before))
    left = F.size(T.words(after))
    char_loss, word_loss = T.ratio(chars - F.length(after), chars), T.ratio(words - left, words)
    flags = flags_of({"high_character_loss": char_loss > 0.35, "high_word_loss": word_loss > 0.35, "low_cleaned_word_count": left < 1000})
    return {"raw_chars": chars, "cleaned_chars": F.length(after), "raw_words": words, "cleaned_words": left, "char_loss_ratio": char_loss, "word_loss_ratio": word_loss, "warnings": F.array_join(flags, ";")}


SECRETS = {"aws_key": r"\bAKIA[0-9A-Z]{16}\b", "bearer": r"(?i)\bbearer\s+[A-Za-z0-9._-]{20,}", "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "token_assignment": r"(?i)\b(?:api[_-]?key|token|secret)\s*[=:]\s*[\"'][A-Za-z0-9_-]{16,}[\"']"}


def secrets(text: Column) -> Column:
    return flags_of({k: text.rlike(p) for k, p in SECRETS.items()})


def safe_path(path: Column) -> Column:
    """Whether a path is relative, without drive, backslash, empty or parent parts."""
    parts = F.split(path, "/")
    return ~path.startswith("/") & ~path.contains("\\") & ~path.rlike("^[A-Za-z]:") & ~F.exists(parts, lambda x: (x == "..") | (x == "") | (x == "."))
