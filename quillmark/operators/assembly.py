"""Assembling a corpus: cleaned text with its places in the raw one, blocked spans, and windows of cleaned words between them."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import passages as P
from quillmark.operators import qc

_PIECE = re.compile(r"(?P<note>\[(?:\d+|[A-Z])\]|\(\*\d+\))|(?P<blank>\s+)|[^\s\[(]+|[\[(]")
_BLANK_LINE = re.compile(r"\n\s*\n")
_EDITOR = re.compile(r"\[(?:Illustration|Transcriber|Redactor)\b", re.IGNORECASE)


class Cleaned(NamedTuple):
    """text without note callouts, white space as one blank or one blank line; and its runs: where each begins in the raw text and in this one, and how long it is."""

    text: str
    raw: list[int]
    clean: list[int]
    size: list[int]

    def to_raw(self, place: int) -> int:
        """The raw place of a cleaned one; of a blank that stands for white space, the place after the run before it."""
        k = max(bisect_right(self.clean, place) - 1, 0)
        return self.raw[k] + min(place - self.clean[k], self.size[k]) if self.raw else 0

    def from_raw(self, place: int) -> int:
        """How much of the cleaned text stands before a raw place."""
        k = bisect_right(self.raw, place) - 1
        return self.clean[k] + min(place - self.raw[k], self.size[k]) if k >= 0 else 0


def cleaned(text: str) -> Cleaned:
    """Callouts such as [3], [A] and (*12) go; blank lines part paragraphs. The map has one entry a run, not one a character."""
    parts, raw, clean, size, length, gap = [], [], [], [], 0, ""
    for m in _PIECE.finditer(text):
        if m["note"]:
            continue
        if m["blank"]:
            gap = "\n\n" if gap == "\n\n" or _BLANK_LINE.search(m["blank"]) else " "
            continue
        if gap and parts:
            parts.append(gap)
            length += len(gap)
        if raw and not gap and raw[-1] + size[-1] == m.start():
            size[-1] += len(m[0])
        else:
            raw.append(m.start())
            clean.append(length)
            size.append(len(m[0]))
        parts.append(m[0])
        length += len(m[0])
        gap = ""
    return Cleaned("".join(parts), raw, clean, size)


def editorial(text: str) -> tuple[list[tuple[int, int]], int | None]:
    """Spans of balanced brackets that open with an editor's word, over blank lines too; and where one opens that never closes, which then reaches to the end."""
    closed, open_ = {}, []
    for m in re.finditer(r"[\[\]]", text):
        if m[0] == "[":
            open_.append(m.start())
        elif open_:
            closed[open_.pop()] = m.end()
    spans = [(m.start(), closed.get(m.start(), len(text))) for m in _EDITOR.finditer(text)]
    return spans, next((a for a, _ in spans if a not in closed), None)


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    """Where paragraphs, parted by blank lines, begin and end, without white space around them."""
    edges = [0, *(x for m in _BLANK_LINE.finditer(text) for x in m.span()), len(text)]
    out = []
    for a, b in zip(edges[::2], edges[1::2]):
        own = text[a:b]
        if own.strip():
            out.append((a + len(own) - len(own.lstrip()), a + len(own.rstrip())))
    return out


def prose_spans(text: str, issues: list[str], low: int, high: int) -> list[tuple[int, int, int]]:
    """(start, end, cleaned words) of windows of whole sentences within runs of paragraphs that have no issue.

    Sentences end where white space does, so that the cleaned words of a window are those of its sentences, added up from
    one count over the cleaned text.
    """
    made = cleaned(text)
    starts = P.word_starts(made.text)
    before = lambda place: bisect_left(starts, made.from_raw(place))
    runs: list[list[tuple[int, int]]] = [[]]
    for (a, b), issue in zip(paragraph_spans(text), issues, strict=True):
        if issue:
            runs.append([])
        else:
            runs[-1] += [(a + x, a + y) for x, y in P.guarded_sentences(text[a:b])]
    return [w for spans in runs for w in P.greedy_spans(spans, [before(b) - before(a) for a, b in spans], low, high)]


def paragraphs(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """texts with paragraphs, an array of (start, stop, text, issue), and problem: a bracket that never closes, as unclosed_bracket:place.

    issue: editorial_bracket_span where a paragraph meets an editor's bracket, else what qc.paragraph_issue names, else
    empty. Texts stay in their partition; a null text has none.
    """
    kind = "array<struct<start:int,stop:int,text:string,blocked:boolean>>"

    @F.udf(f"struct<found:{kind},problem:string>", useArrow=True)
    def split(text):
        if text is None:
            return None
        spans, lost = editorial(text)
        rows = [(a, b, text[a:b], any(a < y and b > x for x, y in spans)) for a, b in paragraph_spans(text)]
        return rows, None if lost is None else f"unclosed_bracket:{lost}"

    rows = texts.withColumn("__p", split(F.col(column)))
    issue = lambda p: F.when(p.blocked, "editorial_bracket_span").otherwise(qc.paragraph_issue(p.text))
    listed = F.transform("__p.found", lambda p: F.struct(p.start.alias("start"), p.stop.alias("stop"), p.text.alias("text"), issue(p).alias("issue")))
    return rows.withColumn("paragraphs", listed).withColumn("problem", F.col("__p.problem")).drop("__p")


def prose_windows(texts: DataFrame, key: str, low: int = 450, high: int = 650, column: str = "text") -> DataFrame:
    """key, ordinal, start, end, words, passage and sha256: windows of low to high cleaned words in unblocked runs, their places in the raw text, and their cleaned text.

    A window never reaches over a paragraph with an issue. Texts with a problem, null and empty ones have none; equal keys
    are read each for themselves.
    """
    rows = paragraphs(texts.select(key, F.col(column).alias("text")), key).where("problem is null and text is not null")
    kept = rows.select(key, "text", F.transform("paragraphs", lambda p: F.coalesce(p.issue, F.lit(""))).alias("issues"))
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = [], []
            for i, (text, issues) in enumerate(zip(batch.column("text").to_pylist(), batch.column("issues").to_pylist(), strict=True)):
                for n, (a, b, words) in enumerate(prose_spans(text, issues, low, high)):
                    passage = cleaned(text[a:b]).text
                    at.append(i)
                    made.append((n, a, b, words, passage, sha256(passage.encode()).hexdigest()))
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], [key, "ordinal", "start", "end", "words", "passage", "sha256"])

    return kept.mapInArrow(run, f"{key} {kind}, ordinal int, start long, end long, words long, passage string, sha256 string")


def offsets(texts: DataFrame, column: str = "text") -> DataFrame:
    """texts with clean, and raw_starts, clean_starts and sizes: arrays with an entry for each run that the cleaned text has in one piece from the raw one; null for a null text."""

    @F.udf("struct<clean:string,raw_starts:array<int>,clean_starts:array<int>,sizes:array<int>>", useArrow=True)
    def mapped(text):
        return None if text is None else tuple(cleaned(text))

    return texts.withColumn("__o", mapped(F.col(column))).select("*", "__o.*").drop("__o")
