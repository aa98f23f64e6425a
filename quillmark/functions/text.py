"""Cleaning, tokenising and measuring text with built-in column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, character classes and patterns that define the measures.
FUNCTION_WORDS = (
    "the and of to a in that it is was i for with as his he be not by but had you at on her which have or from this my me all so were they him she there "
    "no one their we what if would when who will more an do are than could them been"
).split()
STOP_WORDS = (
    "a an the and or but if then than that this these those to of in on for from with without by as at is are was were be been being it its into over under "
    "through after before not no nor so such very can could would should will shall may might must do did done does have has had he she they his her their him "
    "who whom whose what which when where why how i you we our us my me your"
).split()
NEGATIONS = "not no never none nothing neither nor without cannot can't won't don't didn't isn't wasn't weren't".split()
PUNCTUATION = r"[.,;:!?—–\-\"“”‘’'…]"
QUOTES = r"[\"“”‘’]"
ARCHAIC = "thou thee thy thine hath doth art wilt shalt ere nay".split()
ABSTRACT = "tion sion ity ness ment ance ence".split()
#: What a plain text lacks where blanks stand around it.
LEFT_OUT = "the of and de la le und der".split()
LEFT_OUT_PATTERN = f" ({'|'.join(LEFT_OUT)}) "
CONTAMINATION = {"think_open": "<think>", "think_close": "</think>", "as_an_ai": r"\bas an ai\b", "i_cannot": r"\bi cannot\b", "here_is": r"\bhere is\b", "below_is": r"\bbelow is\b", "the_rewritten": r"\bthe rewritten\b", "json_literal": r"\bjson\b"}
WORD = r"[\p{L}\p{N}_]+(?:[’'-]+[\p{L}\p{N}_]+)*"
SENTENCE = "[^.!?]+(?:[.!?]+[\"”’]*|\\z)"


def clean_paragraphs(text: Column) -> Column:
    """Paragraphs (parted by blank lines) without note callouts such as [3], [A] or (*12), white space as one blank, joined by blank lines."""
    kept = F.filter(F.split(F.trim(F.regexp_replace(text, "\r\n?", "\n")), r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    plain = F.transform(kept, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"\[(?:\d+|[A-Z])\]|\(\*\d+\)", ""), r"\s+", " ")))
    return F.array_join(plain, "\n\n")


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def join_hyphenated(text: Column) -> Column:
    """Words broken by a hyphen at a line's end, put together."""
    return F.regexp_replace(text, "(?<=[A-Za-z])-\n(?=[a-z])", "")


def drop_lines(text: Column, pattern: str) -> tuple[Column, Column]:
    """The text without the lines that match (case aside), and the number of those lines."""
    lines = F.split(text, "\n")
    gone = lambda x: (F.trim(x) != "") & F.trim(x).rlike(f"(?i){pattern}")
    return F.array_join(F.filter(lines, lambda x: ~gone(x)), "\n"), F.size(F.filter(lines, gone))


def squeeze_white_space(text: Column) -> Column:
    """Runs of blanks as one, no blanks at line ends, two blank lines in a row at most, one newline at the end."""
    lines = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?m)[ \t]+$", "")
    return F.concat(F.regexp_replace(F.regexp_replace(lines, r"\n{4,}", "\n\n\n"), r"^\s+|\s+\z", ""), F.lit("\n"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9_.-]+", "_"), "^_+|_+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def loose_words(text: Column) -> Column:
    """Words with at most one inner apostrophe or hyphen: counts differ from those of words()."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+(?:['’-][\p{L}\p{N}_]+)?"), F.lit(0))


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+(?:'[a-z]+)?|[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def content_tokens(text: Column) -> Column:
    return F.filter(ascii_tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS))


def capitalised(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]{2,}\b"), F.lit(0))))


def numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[0-9]+(?:\.[0-9]+)?\b"), F.lit(0))))


def sentence_lengths(text: Column) -> Column:
    """Words of each sentence that has one."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.size(words(s))), lambda n: n > 0)


def split_sentences(text: Column) -> Column:
    """The rougher split on full stops, question and exclamation marks after white space was squeezed."""
    return F.filter(F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), "[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")


def sentence_count(text: Column) -> Column:
    """How many split_sentences gives, in one scan: parts between full stops, question and exclamation marks that are not white alone."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[^.!?\s][^.!?]*"), F.lit(0)))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\n\s*\n"), lambda p: F.trim(p) != "")


def char_grams(text: Column, n: int) -> Column:
    """All substrings of n code points of the lower-cased text with white space as one blank."""
    flat = F.regexp_replace(F.lower(text), r"\s+", " ")
    characters = F.split(flat, "")  # places in an array are found at once, in a string by walking there
    parts = [characters, *(F.slice(characters, k + 1, F.greatest(F.size(characters) - k, F.lit(0))) for k in range(1, n))]
    joined = F.transform(F.arrays_zip(*(p.alias(f"c{k}") for k, p in enumerate(parts))), lambda x: F.concat(*(F.coalesce(x[f"c{k}"], F.lit("")) for k in range(n))))
    return F.when(F.length(flat) >= n, F.slice(joined, 1, F.length(flat) - (n - 1))).otherwise(F.array().cast("array<string>"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def occurrences(text: Column, needle: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)


def quartile_class(words: Column) -> Column:
    """The length band of a passage."""
    return F.when(words.between(450, 500), "450-500").when(words.between(501, 575), "501-575").when(words.between(576, 650), "576-650").otherwise("outside")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 where both are empty, 0 where one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def duration_seconds(text: Column) -> Column:
    """Seconds of texts such as 1h2m3s, 7.66s, 250ms or a bare number; null where there are none."""
    low = F.lower(F.trim(text))
    parts = F.regexp_extract_all(low, F.lit("([0-9]+(?:\\.[0-9]+)?)(ms|s|m|h)"), F.lit(0))
    unit = lambda p: F.when(p.endswith("ms"), 0.001).when(p.endswith("s"), 1.0).when(p.endswith("m"), 60.0).otherwise(3600.0)
    total = F.aggregate(parts, F.lit(0.0), lambda t, p: t + F.regexp_extract(p, r"^[0-9.]+", 0).cast("double") * unit(p))
    return F.coalesce(low.try_cast("double"), F.when(total > 0, total))


def plain_words(text: Column) -> Column:
    """Runs of letters, digits and underscores, in small letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def stylometry(text: Column, tokens: Column, lens: Column | None = None, plain: Column | None = None) -> dict[str, Column]:
    """The scalar measures of a text but for the function words; every ratio of nothing is 0.

    tokens: its lower-cased words; lens: its sentence_lengths; plain: its plain_words. All are best columns of an earlier
    projection, or each measure would compute them anew.
    """
    plain = plain_words(text) if plain is None else plain
    n = F.size(tokens)
    lens = sentence_lengths(text) if lens is None else lens
    sentences = F.size(lens)
    total = F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x)
    mean = ratio(total, sentences)
    ordered = F.array_sort(lens)
    middle = (F.get(ordered, F.floor((sentences - 1) / 2).cast("int")) + F.get(ordered, F.floor(sentences / 2).cast("int"))) / 2
    squares = F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    spread = F.sqrt((squares * sentences - total * total).cast("double")) / sentences
    quotes = F.regexp_count(text, F.lit(QUOTES))
    lone = F.when(text.contains("-"), F.regexp_count(text, F.lit(r"(?<![\p{L}\p{N}_])-(?![\p{L}\p{N}_])"))).otherwise(0)
    dashes = occurrences(text, "—") + occurrences(text, "–") + lone
    joined = F.when(text.contains("'") | text.contains("’"), F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+[’'][\p{L}\p{N}_]+"))).otherwise(0)
    abstract = F.filter(plain, lambda w: reduce(or_, (w.endswith(e) & (F.length(w) > len(e)) for e in ABSTRACT)))
    rate = lambda count: ratio(count * 1000.0, n)
    return {
        "word_count_feature": n.cast("double"),
        "sentence_count_feature": sentences.cast("double"),
        "paragraph_count_feature": F.size(paragraphs(text)).cast("double"),
        "mean_sentence_words": mean,
        "median_sentence_words": F.coalesce(middle, F.lit(0.0)),
        "std_sentence_words": F.when(sentences > 1, spread).otherwise(0.0),
        "short_sentence_ratio": ratio(F.size(F.filter(lens, lambda x: x <= 10)), sentences),
        "long_sentence_ratio": ratio(F.size(F.filter(lens, lambda x: x >= 40)), sentences),
        "punctuation_per_1000w": rate(F.regexp_count(text, F.lit(PUNCTUATION))),
        "comma_per_1000w": rate(occurrences(text, ",")),
        "semicolon_per_1000w": rate(occurrences(text, ";")),
        "colon_per_1000w": rate(occurrences(text, ":")),
        "dash_per_1000w": rate(dashes),
        "question_per_1000w": rate(occurrences(text, "?")),
        "exclamation_per_1000w": rate(occurrences(text, "!")),
        "quote_mark_per_1000w": rate(quotes),
        "apostrophe_per_1000w": rate(occurrences(text, "'") + occurrences(text, "’")),
        "ellipsis_per_1000w": rate(occurrences(text, "...") + occurrences(text, "…")),
        "type_token_ratio": ratio(F.size(F.array_distinct(tokens)), n),
        "root_type_token_ratio": ratio(F.size(F.array_distinct(tokens)), F.sqrt(n)),
        "avg_word_length": ratio(F.aggregate(tokens, F.lit(0), lambda a, t: a + F.length(t)), n),
        "long_word_ratio": ratio(F.size(F.filter(tokens, lambda t: F.length(t) >= 8)), n),
        "short_word_ratio": ratio(F.size(F.filter(tokens, lambda t: F.length(t) <= 3)), n),
        "contraction_per_1000w": rate(joined),
        "archaic_marker_per_1000w": rate(F.size(F.filter(plain, lambda w: w.isin(ARCHAIC)))),
        "abstract_suffix_per_1000w": rate(F.size(abstract)),
        "dialogue_marker_per_1000w": rate(quotes),
    }


RHYTHM = ["word_count_feature", "sentence_count_feature", "paragraph_count_feature", "mean_sentence_words", "median_sentence_words", "std_sentence_words", "short_sentence_ratio", "long_sentence_ratio"]
RICHNESS = ["type_token_ratio", "root_type_token_ratio", "hapax_ratio", "avg_word_length", "long_word_ratio", "short_word_ratio"]
MARKS = r"punctuation|(comma|semicolon|colon|dash|question|exclamation|quote|apostrophe|ellipsis).*_per_1000w$"


def family(feature: Column) -> Column:
    """The family of a feature by its name."""
    return (
        F.when(feature.startswith("fw_"), "function_word").when(feature.startswith("char3"), "char3").when(feature.isin(RHYTHM), "length_rhythm")
        .when(feature.rlike(MARKS), "punctuation").when(feature.isin(RICHNESS), "lexical_richness").otherwise("register_marker")
    )


def family_of(feature: str) -> str:
    """family of a name that is known while a plan is made."""
    if feature.startswith(("fw_", "char3")):
        return "function_word" if feature.startswith("fw_") else "char3"
    if feature in RHYTHM:
        return "length_rhythm"
    return "punctuation" if re.search(MARKS, feature) else "lexical_richness" if feature in RICHNESS else "register_marker"
