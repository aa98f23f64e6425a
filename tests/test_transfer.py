"""Transfer between domains, sparse support vectors, and mappings between works, against plain computations."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import passages as P
from quillmark.operators import mapping, models, sparse, transfer
from quillmark.operators.evidence import transfer_contrasts
from quillmark.operators.inference import tree_counts
from quillmark.sources.io import settled, table_digest

RNG = np.random.default_rng(11)
WORDS = {a: [f"{a}{w}" for w in ("lo", "mi", "nar", "tes", "vu", "ko")] + ["the", "and", "of"] for a in ("ba", "do", "ri")}


def text(author, size=40):
    return " ".join(RNG.choice(WORDS[author], size)) + "."


TOY = [(a * 100 + w * 10 + i, name, f"{name}{w}", w, text(name, 30 + 5 * i)) for a, name in enumerate(WORDS) for w in range(3) for i in range(3)]


def texts(spark, versions=("original", "plain"), rows=TOY):
    shown = F.array(*(F.struct(F.lit(v).alias("domain"), F.col("text").alias("text")) for v in versions))
    return spark.createDataFrame(rows, "doc_id long, author string, work string, fold int, text string").withColumn("versions", shown)


def test_views_are_cut_alike_and_whole_panels_only(spark):
    panels = (transfer.Panel("all", 0, 0, "full"), transfer.Panel("mid", 36, 36, "middle"), transfer.Panel("none", 500, 0, "full"))
    rows = [*TOY, (900, "ba", "ba0", 0, None), (901, "ba", "ba0", 0, "short")]
    views = transfer.panel_views(texts(spark, rows=rows), panels).collect()
    assert {r.words for r in views if r.panel == "mid"} == {36} and not [r for r in views if r.panel == "none" or r.doc_id == 900]
    for r in views:
        whole = next(x[4] for x in rows if x[0] == r.doc_id)
        want = whole if r.panel == "all" else whole[slice(*P.crop_span(whole, 36, "middle"))]
        assert r.text == want
    found = {r.panel: r for r in transfer.coverage(transfer.panel_views(texts(spark), panels), texts(spark), panels).collect()}
    assert [found[p].status for p in ("all", "mid", "none")] == ["estimable", "estimable", "not_estimable"]
    assert found["none"].passages == 0 and found["none"].missing_works == 9 and found["all"].missing_works == 0


def test_equal_domains_transfer_without_loss(spark, monkeypatch):
    panels = (transfer.Panel("all", 0, 0, "full"),)
    found = transfer.transfer_predictions(texts(spark), panels)
    rows = {}
    for r in found.collect():
        rows.setdefault((r.pipeline, r.doc_id), set()).add(r.predicted)
    assert found.count() == len(TOY) * 2 * 2 * 2 and all(len(v) == 1 for v in rows.values())
    scores = transfer.cell_scores(found, texts(spark).select("author").distinct()).withColumnsRenamed({"train_domain": "train", "test_domain": "test", "macro_f1": "score"})
    assert {r.difference for r in transfer_contrasts(scores, by=["panel", "pipeline"]).collect()} == {0.0}
    monkeypatch.setattr(transfer, "MODEL_BYTES", 10_000)
    assert sorted(map(tuple, transfer.transfer_predictions(texts(spark), panels).collect())) == sorted(map(tuple, found.collect()))


def test_panels_without_a_work_give_no_cells(spark):
    assert transfer.transfer_predictions(texts(spark), (transfer.Panel("none", 500, 0, "full"),)).collect() == []
    assert transfer.transfer_predictions(texts(spark, rows=TOY[:0]), (transfer.Panel("all", 0, 0, "full"),)).collect() == []


def test_contrasts_decompose(spark):
    cells = spark.createDataFrame([("p", "original", "original", 1.0), ("p", "original", "d", 0.25), ("p", "d", "d", 0.75), (None, "original", "original", 0.5), (None, "original", "d", 0.5)], "g string, train string, test string, score double")
    got = {(r.g, r.contrast): r.difference for r in transfer_contrasts(cells, by=["g"]).collect()}
    assert got == {("p", "transfer_loss"): 0.75, ("p", "adaptation_gain"): 0.5, ("p", "within_domain_gap"): 0.25, (None, "transfer_loss"): 0.0}


def grouped(spark):
    return texts(spark).withColumn("group", F.lit("original")).select("group", "fold", "author", "work", "doc_id", "text")


def test_vocabulary_sees_training_texts_only(spark):
    rows = grouped(spark).unionByName(spark.createDataFrame([("original", 0, "ba", "ba0", 999, "zzzzzz unseen"), ("original", 1, "ba", "ba1", 998, None), ("original", 1, "ba", "ba1", 997, "")], "group string, fold int, author string, work string, doc_id long, text string"))
    made = sparse.vocabularies(rows, 3, most=60)
    for k, p in enumerate(made.problems):
        own = [t or "" for f, t in rows.select("fold", "text").collect() if f != p.outer and t is not None]
        each = [sparse.char_ngrams(t) for t in own]
        total, df = sum(each, Counter()), Counter(g for c in each for g in c)
        want = sorted((g for g in total if df[g] >= 2), key=lambda g: (-total[g], g))[:60]
        idf = {g: math.log((1 + len(own)) / (1 + df[g])) + 1 for g in want}
        assert {g: v for g, v in zip(made.grams, made.idf[k]) if v} == pytest.approx(idf)
    assert not any("zzz" in g for g in made.grams)


def test_support_vectors_equal_dense_ones_under_any_partitioning(spark):
    keys = ["group", "fold", "author", "work", "doc_id"]
    rows = grouped(spark)
    noisy = rows.withColumn("author", F.when(F.col("doc_id") % 5 == 0, "ba").otherwise(F.col("author")))
    made = sparse.vocabularies(noisy, 3)
    stored = sparse.sparse_rows(noisy, keys, made)
    labels = sorted(WORDS)
    fits = [sparse.fit_svm(x, made, labels, tolerance=1e-5) for x in (stored, stored.repartition(5))]
    np.testing.assert_allclose(fits[0].weights, fits[1].weights, atol=1e-4)
    got = {r.doc_id: r.predicted for r in sparse.predict(stored, fits[0], keys).collect()}
    local = stored.orderBy("doc_id").collect()
    for k, p in enumerate(made.problems):
        dense = np.zeros((len(local), len(made.grams)))
        for i, r in enumerate(local):
            dense[i, r.places] = sparse._scaled(made.idf[k], np.array(r.places, int), np.array(r.weights))
        author, train = np.array([r.author for r in local]), np.array([r.fold for r in local]) != p.outer
        want = models.linear_svm(dense[train], author[train], dense[~train])
        assert [got[r.doc_id] for r, t in zip(local, train) if not t] == list(want)


def test_products_read_only_rows_within_a_margin(spark, monkeypatch):
    made, keys = sparse.vocabularies(grouped(spark), 3), ["group", "fold", "author", "doc_id"]
    plain, short = (sparse.sparse_rows(grouped(spark), keys, made, **own) for own in ({}, {"as_bytes": True}))
    read, summed = [], sparse._summed
    monkeypatch.setattr(sparse, "_summed", lambda rows, *others: read.append(rows.count()) or summed(rows, *others))
    fits = [sparse.fit_svm(x, made, sorted(WORDS), cost=20.0) for x in (plain, short)]
    np.testing.assert_allclose(fits[0].weights, fits[1].weights, atol=1e-4)
    assert read[0] == len(TOY) and min(read) < len(TOY)
    said = [sorted(map(tuple, sparse.predict(x, fits[0], keys).collect())) for x in (plain, short)]
    assert said[0] == said[1] and len(said[0]) == len(TOY)


def test_unsettled_support_vectors_are_an_error(spark):
    made = sparse.vocabularies(grouped(spark), 3)
    with pytest.raises(RuntimeError, match="did not settle"):
        sparse.fit_svm(sparse.sparse_rows(grouped(spark), ["group", "fold", "author"], made), made, sorted(WORDS), tolerance=1e-12, rounds=1)


def works(spark, factor=0.5):
    x = np.random.default_rng(2).normal(size=(18, 6))
    rows = [(o, "original" if c == "original" else c, f"a{w % 6}", f"a{w % 6}w{w // 6}", w // 6 != o, [*(factor * v + f if c != "original" and f < 5 else v for f, v in enumerate(x[w].tolist())), None]) for o in range(3) for c in ("original", "half") for w in range(18)]
    return spark.createDataFrame(rows, "outer int, condition string, author string, work string, train boolean, z array<double>"), x


def test_an_affine_change_is_recovered_on_unseen_works(spark):
    rows, x = works(spark)
    pairs = mapping.work_pairs(rows, {"five": (0, 5), "all": None})
    fit = {(r.outer, r.family): r for r in mapping.fitted(pairs).collect()}
    assert [fit[(o, "five")].alpha for o in range(3)] == pytest.approx([0.5] * 3) and fit[(0, "five")].shift == pytest.approx([0, 1, 2, 3, 4], abs=1e-9)
    held = mapping.held_out(pairs, mapping.fitted(pairs))
    for r in held.where("family = 'five'").collect():
        assert r.scalar_affine == pytest.approx(0, abs=1e-12) and r.features == 5
    for r in mapping.dispersion_intervals(held, 300).where("family = 'five'").collect():
        assert r.ci_low <= r.value <= r.ci_high or abs(r.value) < 1e-9
        if r.component in ("residual", "cross"):
            assert abs(r.value) < 1e-9 and abs(r.ci_high) < 1e-9


def test_intervals_equal_those_of_explicitly_drawn_works(spark):
    rows, x = works(spark)
    pairs = mapping.work_pairs(rows, {"all": None})
    held = mapping.held_out(pairs, mapping.fitted(pairs))
    local, n = held.collect(), 40
    counts = {}
    for r in local:
        names = sorted({q.work for q in local if q.author == r.author})
        counts[r.work] = dict(tree_counts(np.full(n, 3), 3, np.arange(3), 20260922, "works", r.author))[names.index(r.work)]
    drawn = np.array([sum(counts[r.work][b] * r.identity for r in local) / 18 for b in range(n)])
    got = {r.measure: r for r in mapping.error_intervals(held, n).collect()}
    assert [got["identity"].value, got["identity"].ci_low, got["identity"].ci_high] == pytest.approx([np.mean([r.identity for r in local]), *np.quantile(drawn, [0.025, 0.975])])
    spread = np.zeros((3, n))
    for r in {r.outer: r for r in local}:
        own = [q for q in local if q.outer == r]
        for b in range(n):
            chosen = np.concatenate([np.repeat([q.y], counts[q.work][b], axis=0) for q in own if counts[q.work][b]]) if any(counts[q.work][b] for q in own) else np.zeros((1, 7))
            spread[r, b] = chosen.var(axis=0).sum() / own[0].features
    found = {r.component: r for r in mapping.dispersion_intervals(held, n, block=7).collect()}
    assert [found["between_rewrite"].ci_low, found["between_rewrite"].ci_high] == pytest.approx(np.quantile(spread.mean(axis=0), [0.025, 0.975]))


def state(spark, rows, partitions):
    panels = (transfer.Panel("all", 0, 0, "full"),)
    views = transfer.panel_views(texts(spark, rows=rows).repartition(partitions), panels)
    measured = transfer.measured_views(views, panels)
    return transfer.fit_state(views, measured, transfer.fold_models(transfer.cell_moments(measured), measured))


def test_a_refit_is_the_same_and_a_changed_fit_is_named(spark):
    first, again = (settled(state(spark, TOY, n)) for n in (1, 6))
    assert transfer.changed_state(first, again).collect() == [] and {r.kind for r in first.select("kind").distinct().collect()} == {"mean", "scale", "training_text", "sample_count"}
    assert table_digest(first.where("kind = 'training_text'")).first() == table_digest(again.where("kind = 'training_text'")).first()
    other = state(spark, [(*TOY[0][:4], TOY[0][4] + " the the"), *TOY[1:]], 2)
    problems = transfer.changed_state(first, other).collect()
    assert {r.outer for r in problems} == {1, 2} and {r.problem for r in problems if r.kind == "training_text"} == {"missing", "unexpected"}
    assert ("mean", "fw_the_per_1000w") in {(r.kind, r.name) for r in problems if r.problem == "differs"}


def test_values_are_compared_in_units_of_the_last_place(spark):
    far = 1.0
    for _ in range(9):
        far = float(np.nextafter(far, 2))
    values = [("same", 1.0, 1.0), ("near", 1.0, float(np.nextafter(1.0, 2))), ("far", 1.0, far), ("zero", 0.0, -0.0), ("across", 5e-324, -5e-324), ("sign", 1.0, -1.0), ("none", None, None), ("lost", 1.0, None), ("nan", float("nan"), float("nan"))]
    a, b = (spark.createDataFrame([("p", 0, "mean", n, v[k]) for n, *v in values], "panel string, outer int, kind string, name string, value double") for k in (0, 1))
    assert {r.name: r.ulps for r in transfer.changed_state(a, b).collect()} == {"far": 9, "sign": 2 * 0x3FF0000000000000 if 2 * 0x3FF0000000000000 < 2**63 else 2**63 - 1, "lost": None}
