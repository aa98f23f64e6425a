"""Texts measured under all conditions from words found once, against measures of the conditions' own texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillmark.functions import measures as M
from quillmark.functions import text as T
from quillmark.operators import inference, style
from quillmark.plans import _base

ODD = [
    "", "a", "ab", " the ", " the the ", "of the of the of x", " of the of ", "x of  the y", "The of THE and y", "a the. b of, c de\nla le", "don't", "don'-", "well-known-thou's thing", "a\n\n the \n\nb of c d", "a \n the \n of x",
    "thou thouxyz", "x - the - y-", "İ the ΑΣ of ΟΔΟΣ der", "\x00 the \x00 of b", "é de l'eau 😀 le la x" * 3, "nation ity nationxx-ity", "the " * 30, " la" * 31,
]


def _made(text):
    return [text, text[: len(text) // 2], M._LEFT_OUT.sub(" ", text)]


def test_versions_equal_their_own_texts():
    rnd = random.Random(2)
    pieces = [*"aàİΣZ’'-.,!?…\n\t—\"“x ", "  ", " the ", " of", " of the ", "nation", "-ity", "s'", " der\n", "thou "]
    texts = [*ODD, *("".join(rnd.choice(pieces) for _ in range(rnd.randrange(60))) for _ in range(600)), *("".join(rnd.choice(["the ", "of ", "la", " ", "x "]) for _ in range(rnd.randrange(40))) for _ in range(200))]
    grams = ["the", " th", "he ", "n, ", "'s "]
    place = M.places(grams)
    assert all(not len(own.texts) and not len(own.base(*[np.zeros(0, np.int64)] * 3)) for own in M.Texts([]).versions())
    for some in (texts, texts[:1], texts[1:2]):
        read = M.Texts(some)
        for k, own in enumerate(read.versions()):
            want = [_made(t)[k] for t in some]
            assert own.texts == want
            whole = np.arange(len(some)), np.zeros(len(some), np.int64), own.words
            assert own.strings(*whole) == want
            np.testing.assert_allclose(own.base(*whole), [M.base_measures(t, t.lower()) for t in want], atol=1e-9, rtol=1e-9)
            flat = [M.flat(t.lower()) for t in want]
            rates = [[1000 * sum(f[i : i + 3] == g for i in range(len(f))) / max(len(f) - 2, 1) for g in grams] for f in flat]
            np.testing.assert_allclose(own.rates(*whole, place, len(grams)), rates, atol=1e-9)


def test_conditions_are_made_where_they_are_measured(spark, sf_dir):
    """Measures under conditions equal those of written texts, and no plan makes the texts of conditions by expressions."""
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10**9))
    grams = ["the", " of", "n, "]
    keys = ["doc_id", "condition"]
    want = {tuple(r[c] for c in keys): (r.base, r.rates) for r in style.measures(_base.conditioned(docs), keys, grams).collect()}
    got = {tuple(r[c] for c in keys): (r.base, r.rates) for r in style.measures(docs, ["doc_id"], grams, versions="condition").collect()}
    assert got.keys() == want.keys() and len(got) > 3 * len(ODD)
    for k, rows in want.items():
        for a, b in zip(rows, got[k]):
            assert (a is None) == (b is None)
            if a is not None:
                np.testing.assert_allclose(b, a, atol=1e-9, rtol=1e-9)
    parts = [inference.moments_of(p, ["condition"]).collect() for p in (style.measure_sums(_base.conditioned(docs), ["condition"], grams), style.measure_sums(docs, [], grams, versions="condition"))]
    for a, b in zip(*(sorted(p) for p in parts), strict=True):
        assert (a.condition, a.n) == (b.condition, b.n)
        np.testing.assert_allclose(b["mean"], a["mean"], rtol=1e-9, atol=1e-12)
    for made in (_base.moments(spark, sf_dir).parts, _base.matrix(spark, sf_dir, True).rows):
        assert {r.condition for r in made.select("condition").distinct().collect()} == set(_base.CONDITIONS)


def test_words_are_found_once_for_all_conditions(spark, sf_dir, monkeypatch):
    """moments hands the texts themselves to the tasks, not one copy of them for each condition."""
    seen = []

    def counting(texts, *args, kept=style.measure_sums, **named):
        seen.append((texts.count(), texts.select("doc_id").distinct().count()))
        return kept(texts, *args, **named)

    monkeypatch.setattr(style, "measure_sums", counting)
    _base.moments(spark, sf_dir)
    assert seen and all(n == own for n, own in seen)
    assert T.LEFT_OUT_PATTERN == " (the|of|and|de|la|le|und|der) "
