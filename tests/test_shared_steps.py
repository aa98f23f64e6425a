"""Steps that several style queries share: one pass of sums, words by their letters, and counts without split texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import measures as M
from quillmark.functions import text as T
from quillmark.operators import inference, models, qc, style
from quillmark.plans import _base

ODD = ["", " ", "one", "One. Two! Three?", " . \t.\n! a . b.", "a..b?!c", "...", "tion nation. x-ity ity'nation thou's ’tis_thee", "ΑΣ the\tΣ ΟΔΟΣ.", "the \n\n the", "ab", "İx ß"]


def test_sentences_are_counted_as_they_are_split(spark):
    docs = spark.createDataFrame([(t,) for t in [*ODD, None]], "text string")
    rows = docs.select("text", F.size(T.split_sentences(F.col("text"))).alias("want"), T.sentence_count(F.col("text")).alias("got")).collect()
    assert [(r.text, r.got) for r in rows] == [(r.text, r.want) for r in rows]
    pairs = docs.select(F.lit("plain").alias("condition"), F.lit("one two three").alias("original"), F.col("text").alias("rewritten"))
    counted = pairs.withColumn("original_words", F.lit(3)).drop("original")
    judged = [[(r.rewritten, r.qc_flags, r.qc_status) for r in qc.rewrite_qc_simple(p, ["plain"], "ai").collect()] for p in (pairs, counted)]
    assert judged[0] == judged[1]


def test_trigrams_of_texts_are_counted_together():
    texts = [*ODD, "a \x00 b", "\x00", *ODD]
    want = sum(np.bincount(M.trigrams(M.flat(t.lower())), minlength=M.GRAMS) for t in texts)
    assert (M.gram_counts(texts) == want).all() and want.sum()
    assert not M.gram_counts([]).any() and not M.gram_counts(["", "", ""]).any()


def test_words_are_told_by_their_letters(monkeypatch):
    """Endings, function and archaic words come from code points; only words of several parts are looked at one by one."""
    looked = []

    class Plain:
        def findall(self, word):
            looked.append(word)
            return pattern.findall(word)

    M._tables(), M._listed()
    pattern = M._PLAIN
    texts = [*ODD, " ".join(f"word{k}ness thou of" for k in range(1000))]
    want = [M.base_measures(t, t.lower()) for t in texts]
    monkeypatch.setattr(M, "_PLAIN", Plain())
    read = M.Texts(texts)
    kinds, number = read.kinds
    assert all(set(w) & set("'’-") for w in looked) and len(looked) < 10
    monkeypatch.undo()
    whole = np.arange(len(texts)), np.zeros(len(texts), np.int64), read.words
    np.testing.assert_allclose(M.Texts(texts).base(*whole), want, atol=1e-9)


@pytest.mark.parametrize("most", [1, 64 << 20])
def test_moments_from_parts_equal_those_of_the_rows(spark, most):
    r = np.random.default_rng(3)
    rows = [("ab"[i % 2], i % 3, r.normal(5, 1, 4).tolist()) for i in range(60)]
    docs = spark.createDataFrame(rows, "author string, fold int, values array<double>").repartition(5)
    parts = docs.mapInArrow(lambda b: inference.added_up(b, ["author", "fold"], most), "author string, fold int, sums array<double>")
    for keys, at in ((["author", "fold"], (0, 1)), (["fold"], (1,)), ([], ())):
        for got in inference.moments_of(parts, keys).collect():
            own = np.array([x[2] for x in rows if all(x[k] == got[c] for c, k in zip(keys, at))])
            assert got.n == len(own)
            np.testing.assert_allclose(got["mean"], own.mean(axis=0), rtol=1e-12)
            np.testing.assert_allclose(got["square"], own.var(axis=0) * len(own), rtol=1e-9)


def test_work_means_and_predictions_equal_those_of_standardised_rows(spark, sf_dir):
    z, names = _base.standard(spark, sf_dir, True)
    found = _base.moments(spark, sf_dir)
    assert [sorted(a) for a in found.names] == [sorted(a) for a in names]
    by = ["condition", "work", "fold"]
    want = {tuple(r[c] for c in ("outer", *by)): dict(zip(names[r.outer], r.z)) for r in models.mean_vectors(z, ["outer", *by]).collect()}
    got = {tuple(r[c] for c in ("outer", *by)): (r.train, dict(zip(found.names[r.outer], r.z))) for r in _base.work_means(found, by).collect()}
    assert got.keys() == want.keys() and got
    for k, (train, values) in got.items():
        assert train == (k[0] != k[3])
        for f, v in want[k].items():
            assert (values[f] is None and v is None) or values[f] == pytest.approx(v, abs=1e-8), (k, f)
    keys = ["outer", "condition", "doc_id", "work", "author", "predicted"]
    old = models.attributed(z, ["outer"], ["doc_id", "work", "condition"], train=F.col("train") & (F.col("condition") == "original"), digits=9)
    new = _base.held_out(_base.folded(spark, sf_dir), True)
    assert sorted(map(tuple, new.select(keys).collect())) == sorted(map(tuple, old.select(keys).collect()))


def test_sums_of_no_texts_and_of_nulls(spark):
    docs = spark.createDataFrame([("a", None)], "author string, text string")
    assert not inference.moments_of(style.measure_sums(docs, ["author"], ["the"]), ["author"]).collect()


def test_shared_steps_deal_no_measures_and_keep_no_standardised_rows(spark, sf_dir, monkeypatch):
    """The texts and the sums of works are all that is written for work means: nothing an outer fold and passage long."""
    sizes = []

    def counting(df, block=None, kept=_base.settled):
        made = kept(df, block)
        sizes.append((made.columns, made.count()))
        return made

    monkeypatch.setattr(_base, "settled", counting)
    _base.work_means(_base.moments(spark, sf_dir), ["condition", "work", "fold"]).collect()
    assert not any({"z", "values", "rates"} & set(columns) for columns, _ in sizes)
