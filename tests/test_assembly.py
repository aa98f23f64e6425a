"""Windows of cleaned words in unblocked runs, against a version that cleans and counts every candidate anew."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmark.functions import passages as P
from quillmark.operators import assembly as A


def plain_clean(text):
    kept = [re.sub(r"\s+", " ", re.sub(r"\[(?:\d+|[A-Z])\]|\(\*\d+\)", "", p)).strip() for p in re.split(r"\n\s*\n", text.strip()) if p.strip()]
    return "\n\n".join(kept)


def story(rng):
    out = []
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.12:
            out.append("[Illustration: a [small]\n\ncaption here.]")
        elif kind < 0.2:
            out.append("CHAPTER IV")
        else:
            out.append("\n".join(" ".join(rng.choice(["The old man", "went", "home[3]", "Mr. Smith", "said (*12)", "it’s", "well-known", "never"]) for _ in range(rng.randint(3, 12))) + rng.choice([". ", "!” ", "? "]).rstrip() + rng.choice([" Then", "", " (*4)"]) for _ in range(rng.randint(1, 6))) + ".")
    return "  " + "\n\n \n".join(out) + "\n"


def plain_windows(text, issues, low, high):
    count = lambda a, b: len(P.word_starts(plain_clean(text[a:b])))
    runs, out = [[]], []
    for (a, b), issue in zip(A.paragraph_spans(text), issues):
        if issue:
            runs.append([])
        else:
            runs[-1] += [(a + x, a + y) for x, y in P.guarded_sentences(text[a:b])]
    for spans in runs:
        i = 0
        while i < len(spans):
            j = i
            while count(spans[i][0], spans[j][1]) < low and j + 1 < len(spans) and count(spans[i][0], spans[j + 1][1]) <= high:
                j += 1
            n = count(spans[i][0], spans[j][1])
            if low <= n <= high:
                out.append((spans[i][0], spans[j][1], n))
            i = j + 1 if low <= n <= high else i + 1
    return out


def test_windows_equal_the_plain_ones(spark):
    rng = random.Random(8)
    rows = [(i, story(rng)) for i in range(60)] + [(100, None), (101, ""), (102, "[Illustration never closed. " + "word " * 40), (103, "x")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("words", F.lit("clash"))
    marked = {r.id: r for r in A.paragraphs(df, "id").collect()}
    assert marked[102].problem == "unclosed_bracket:0" and marked[100].paragraphs is None and not [r for i, r in marked.items() if i < 100 and r.problem]
    got = {}
    for r in A.prose_windows(df, "id", 20, 40).collect():
        got.setdefault(r.id, []).append((r.ordinal, r.start, r.end, r.words, r.passage))
    total = 0
    for i, text in rows[:60]:
        issues = [p.issue for p in marked[i].paragraphs]
        assert "section_heading" in issues or "CHAPTER" not in text
        want = plain_windows(text, issues, 20, 40)
        total += len(want)
        assert [x[1:4] for x in sorted(got.get(i, []))] == want
        assert all(x[4] == plain_clean(text[x[1] : x[2]]) and "Illustration" not in x[4] for x in got.get(i, []))
    assert total > 40 and not {100, 101, 102, 103} & set(got)


def test_cleaning_keeps_its_places(spark):
    rng = random.Random(9)
    rows = [(i, story(rng)) for i in range(30)] + [(50, "A note[3] and a letter[A]."), (51, ""), (52, None), (53, "a [3] b\n[4]\nc (d) [Ee]")]
    for r in A.offsets(spark.createDataFrame(rows, "id long, text string")).collect():
        if r.text is None:
            assert r.clean is None and r.sizes is None
            continue
        assert r.clean == plain_clean(r.text)
        for raw, clean, size in zip(r.raw_starts, r.clean_starts, r.sizes):
            assert r.text[raw : raw + size] == r.clean[clean : clean + size]
        made = A.cleaned(r.text)
        assert all(r.text[made.to_raw(k)] == c for k, c in enumerate(made.text) if not c.isspace())
    assert A.cleaned("A note[3] and a letter[A].").text == "A note and a letter."


def test_illustrations_go_whole():
    raw = "Prose. [Illustration:\n\nCaption by illustrator\n\n[_Copyright 1894._]] Real prose."
    (span,), lost = A.editorial(raw)
    assert lost is None and raw[slice(*span)] == "[Illustration:\n\nCaption by illustrator\n\n[_Copyright 1894._]]"
    assert A.editorial("] a [Redactor b")[1] == 4 and A.editorial("no [brackets]") == ([], None)


@pytest.mark.parametrize("text", ["", "  \n\n ", "one", "a\n\nb", "\n a \n \n\n b\n"])
def test_paragraphs_have_no_white_space_around(text):
    assert [text[a:b] for a, b in A.paragraph_spans(text)] == [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
