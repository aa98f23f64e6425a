"""The kernel of all measures against the column expressions, and vocabularies by fold."""

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import models, style

TEXTS = ["", "One.", "Don’t stop—it's a well-known café… \"No!\" said he - the art of nations; a hope: thee, a-b -c d- - e?\n\n \nNext (part) of it. " * 3, "the the a\tof  ß ÄÖ x_1 12.5 ...", "   \n\n  ", "ab", "a", "tion nation ity pity 😀 é", None, "«Qui» l'eau n'est 'pas' a'b'c"]


def test_the_kernel_equals_the_expressions(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    text = F.col("text")
    read = docs.select("doc_id", "text", T.words(F.lower("text")).alias("tokens"), T.sentence_lengths(text).alias("lens"), T.plain_words(text).alias("plain"))
    made = T.stylometry(text, F.col("tokens"), F.col("lens"), F.col("plain"))
    want = {r.doc_id: r.asDict() for r in read.select("doc_id", *(v.cast("double").alias(k) for k, v in made.items()), "tokens").collect()}
    got = {r.doc_id: r for r in style.measures(docs, ["doc_id"], [" a ", "the"]).collect()}
    for i, t in enumerate(TEXTS):
        if t is None:
            assert got[i].base is None and got[i].rates is None
            continue
        own = dict(zip(style.BASE, got[i].base, strict=True))
        tokens = want[i].pop("tokens")
        for k, v in want[i].items():
            assert k == "doc_id" or own[k] == pytest.approx(v, abs=1e-9), (i, k)
        assert own["fw_the_per_1000w"] == pytest.approx(1000 * tokens.count("the") / max(len(tokens), 1))
        assert own["hapax_ratio"] == pytest.approx(sum(tokens.count(x) == 1 for x in tokens) / max(len(tokens), 1))
        low = " ".join(t.lower().split()) if t.strip() == t else None
        if low is not None and len(low) > 2:
            assert got[i].rates[1] == pytest.approx(1000 * sum(low[k : k + 3] == "the" for k in range(len(low) - 2)) / (len(low) - 2))


def test_vocabularies_leave_their_fold_out(spark):
    docs = spark.createDataFrame([(0, "aaab"), (1, "aab xyz"), (2, "b  b"), (2, None)], "fold int, text string")
    assert style.fold_vocabularies(docs, 3, 2) == [[" xy", "aab"], ["aaa", "aab"], ["aab", " xy"]]


def test_vectors_equal_long_form(spark):
    rows = [(i, "ab"[i % 2], f"w{i % 6}", i % 3, [float(i % 5), 1.0, (i * 7 % 11) / 3 + (i % 2)]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, author string, work string, fold int, values array<double>")
    folded = models.outer_folds(docs)
    z = models.standard_vectors(folded, ["outer"], F.col("train"))
    assert all(r.z[1] is None for r in z.collect())
    long = models.standardised(models.outer_folds(docs.select("doc_id", "author", "work", "fold", F.posexplode("values").alias("feature", "value"))), ["outer"])
    for kind, old in {"centroid": models.nearest_centroid, "nb_uniform": models.gaussian_nb, "lda": models.diagonal_lda, "nb_counts": lambda *a: models.gaussian_nb(*a, uniform=False)}.items():
        got = {(r.outer, r.doc_id): r.predicted for r in models.attributed(z, ["outer"], ["doc_id", "work"], kind).collect()}
        want = {(r.outer, r.doc_id): r.predicted for r in old(long, ["outer"], ["doc_id", "work"]).collect()}
        assert got == want, kind


def test_families_by_name_and_by_column(spark):
    names = [*style.BASE, "char3::the"]
    rows = spark.createDataFrame([(n,) for n in names], "f string").select("f", T.family(F.col("f")).alias("x")).collect()
    assert {r.f: r.x for r in rows} == {n: T.family_of(n) for n in names}


def test_kernels_on_small_fixtures():
    import numpy as np

    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(0, [1, 5, 0.2], (30, 3)), r.normal([2, 0, 1], [3, 1, 0.5], (20, 3))])
    y = np.array(["a"] * 30 + ["b"] * 20)
    shared = np.zeros((3, 3))
    for k in "ab":
        own = x[y == k]
        centred = (own - own.mean(axis=0)) / own.std(axis=0)
        sample = centred.T @ centred / len(own)
        mu = np.trace(sample) / 3
        spread = sum(((np.outer(row, row) - sample) ** 2).sum() for row in centred) / len(own) ** 2
        shrink = min(spread, ((sample - mu * np.eye(3)) ** 2).sum()) / ((sample - mu * np.eye(3)) ** 2).sum()
        shared += ((1 - shrink) * sample + shrink * mu * np.eye(3)) * np.outer(own.std(axis=0), own.std(axis=0)) / 2
    means = [x[y == k].mean(axis=0) for k in "ab"]
    inverse = np.linalg.inv(shared)
    new = r.normal(1, 2, (200, 3))
    scores = np.array([[row @ inverse @ m - 0.5 * m @ inverse @ m for m in means] for row in new])
    assert (models.shrinkage_lda(x, y, new) == np.array(["a", "b"])[scores.argmax(axis=1)]).all()
    line = np.array([[-2.0], [-1.0], [1.0], [2.0], [9.0], [10.0]])
    assert (models.linear_svm(line, np.array(list("aabbcc")), np.array([[-3.0], [11.0]])) == ["a", "c"]).all()
