"""Places in texts: anchors, bounds of works, contexts, word places; packets of Markdown and their strict reading."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import text as T


def anchor_pattern(anchor: str) -> str:
    """A pattern of the words of anchor, in any case, with any white space between them."""
    return r"(?iU)" + r"\s+".join(re.escape(w) for w in anchor.split())


def anchored(text: Column, anchor: str) -> Column:
    """The 0-based place of anchor, which must stand exactly once; null else."""
    pattern = F.lit(anchor_pattern(anchor))
    return F.when(F.regexp_count(text, pattern) == 1, F.regexp_instr(text, pattern) - 1)


def work_bounds(text: Column, start: str, end: str) -> Column:
    """struct(begin, stop): from the start anchor to the end anchor after it; null if one is not there exactly once or nothing lies between."""
    begin = anchored(text, start)
    after = begin + len(start)
    stop = after + anchored(F.substr(text, after + 1), end)
    return F.when(stop > begin, F.struct(begin.cast("int").alias("begin"), stop.cast("int").alias("stop")))


def context(text: Column, begin: Column, stop: Column, reach: int = 2500) -> Column:
    """struct(before, span, after) of a span of code points; null where the span does not lie within the text."""
    size = F.length(text)
    low = F.greatest(begin - reach, F.lit(0))
    parts = F.struct(F.substr(text, low + 1, begin - low).alias("before"), F.substr(text, begin + 1, stop - begin).alias("span"), F.substr(text, stop + 1, F.lit(reach)).alias("after"))
    return F.when((begin >= 0) & (begin < stop) & (stop <= size), parts)


def word_index(text: Column, at: Column) -> Column:
    """How many words begin before the code point at: those of the text up to there, and the one it cuts."""
    return F.size(T.words(F.substr(text, F.lit(1), at)))


def fence(text: Column) -> Column:
    """text as a Markdown code block whose fence is longer than any run of backticks in it."""
    longest = F.aggregate(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.lit(0), lambda n, x: F.greatest(n, F.length(x)))
    mark = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat(mark, F.lit("text\n"), text, F.lit("\n"), mark, F.lit("\n"))


def packet(item: Column, texts: dict[str, Column], fields: list[str]) -> Column:
    """One item of a review packet: a heading, each text in a fence, and a line for the answer to each field."""
    blocks = [F.concat(F.lit(f"### {k}\n\n"), fence(v), F.lit("\n")) for k, v in texts.items()]
    lines = "\n".join(f"{f}: " for f in fields)
    return F.concat(F.lit("## Item "), item.cast("string"), F.lit("\n\n"), *blocks, F.lit(f"### Response\n\n{lines}\n"))


def answers(returned: Column, fields: list[str]) -> Column:
    """map of field to answer in the part after the last heading Response; null unless every field stands there once, in order, and nothing else does."""
    part = F.element_at(F.split(returned, r"(?m)^### Response$"), -1)
    lines = F.filter(F.split(part, "\n"), lambda x: F.trim(x) != "")
    names = F.transform(lines, lambda x: F.regexp_extract(x, r"^([a-z_]+):", 1))
    values = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[a-z_]+:", "")))
    wanted = F.array(*(F.lit(f) for f in fields))
    return F.when((names == wanted) & returned.rlike(r"(?m)^### Response$"), F.map_from_arrays(wanted, values))


def markdown_row(columns: list[Column]) -> Column:
    """A row of a Markdown table: null cells are empty, bars in cells escaped."""
    cells = [F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return F.concat(F.lit("| "), reduce(lambda a, b: F.concat(a, F.lit(" | "), b), cells), F.lit(" |"))


def validation_metrics(text: Column, tokens: Column, lens: Column | None = None) -> dict[str, Column]:
    """The 20 measures of a cleaned text: counts, sentence lengths to 3 places, shares to 6 and rates per 1000 words to 3."""
    measured = T.stylometry(text, tokens, lens)
    counts = {"word_count": "word_count_feature", "sentence_count": "sentence_count_feature"}
    rows = {k: measured[v].cast("long") for k, v in counts.items()}
    rows |= {k: F.round(measured[k], 3) for k in ("mean_sentence_words", "median_sentence_words", "std_sentence_words")}
    rows |= {k: F.round(measured[k], 6) for k in ("long_sentence_ratio", "short_sentence_ratio")}
    rates = ("punctuation", "comma", "semicolon", "colon", "dash", "exclamation", "question", "quote_mark", "apostrophe", "ellipsis", "contraction", "archaic_marker", "abstract_suffix")
    return rows | {f"{k}_per_1000w": F.round(measured[f"{k}_per_1000w"], 3) for k in rates}


def passage_metrics(text: Column, tokens: Column, lens: Column | None = None) -> dict[str, Column]:
    """The 11 measures of a candidate passage."""
    measured = T.stylometry(text, tokens, lens)
    rows = {k: measured[f"{k}_feature"].cast("long") for k in ("word_count", "sentence_count", "paragraph_count")}
    rows["dialogue_marker_count"] = F.regexp_count(text, F.lit(T.QUOTES)).cast("long")
    rows |= {f"{k}_per_1000w": F.round(measured[f"{k}_per_1000w"], 3) for k in ("dialogue_marker", "punctuation", "semicolon", "dash", "apostrophe")}
    return rows | {"mean_sentence_words": F.round(measured["mean_sentence_words"], 3), "long_sentence_ratio": F.round(measured["long_sentence_ratio"], 6)}


def candidate_status(words: Column, sentences: Column, low: int = 450, high: int = 650, least: int = 5) -> Column:
    """struct(status, reason) of a candidate passage."""
    wrong, few = ~words.between(low, high), sentences < least
    status = F.when(wrong, "candidate_fail_length").when(few, "candidate_fail_low_sentence_count").otherwise("candidate_pass_length")
    return F.struct(status.alias("status"), F.when(wrong, "outside_hard_word_bounds").when(few, "too_few_sentences").otherwise("").alias("reason"))
