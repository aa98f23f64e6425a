import numpy as np
import pandas as pd
import pytest

from quillmark.operators import geometry, inference, metrics, models


def pairs(rewrite):
    rows = [(f"a{a}", f"a{a}w{w}", a * 100 + w * 10 + i, f"a{a}") for a in range(3) for w in range(3) for i in range(4)]
    return pd.DataFrame([(*r, rewrite(r)) for r in rows], columns=["author", "work", "doc_id", "original", "rewrite"])


LABELS = ["a0", "a1", "a2"]


def test_identity_loses_nothing():
    out = inference.paired_loss(pairs(lambda r: r[3]), LABELS, 50, 99, 1)
    assert (out["loss"], out["ci_low"], out["ci_high"], out["p_value"]) == (0, 0, 0, 1)


def test_always_wrong_loses_all():
    out = inference.paired_loss(pairs(lambda r: LABELS[(int(r[3][1]) + 1) % 3]), LABELS, 50, 999, 1)
    assert out["loss"] == 1 and out["ci_low"] == out["ci_high"] == 1 and 0 < out["p_value"] < 0.05


def test_missing_label_is_not_estimable(spark):
    frame = pairs(lambda r: r[3])
    both = pd.concat([frame.assign(c="all"), frame[frame.author != "a2"].assign(c="less")])
    out = {r.c: r for r in inference.paired_inference(spark.createDataFrame(both), ["c"], LABELS, 9, 20, 19).collect()}
    assert out["all"].status == "estimable" and out["all"].loss == 0
    assert out["less"].status == "not_estimable" and out["less"].loss is None


def test_weights_add_up(spark):
    frame = spark.createDataFrame(pairs(lambda r: r[3]))
    weights = inference.bootstrap_weights(frame.select("author", "work", "doc_id"), 7)
    assert {r["sum(weight)"] for r in weights.groupBy("replicate").sum("weight").collect()} == {36}
    same = frame.withColumnRenamed("rewrite", "predicted")
    scores = inference.weighted_f1(same, weights, [], 3).collect()
    assert all(0 < r.macro_f1 <= 1 for r in scores)


def test_holm(spark):
    rows = spark.createDataFrame([(0.01,), (0.02,), (0.5,)], "p double")
    assert [r.p_holm for r in metrics.holm(rows, [], "p").orderBy("p").collect()] == pytest.approx([0.03, 0.04, 0.5])
    assert metrics.holm(rows.where("p < 0.015"), [], "p", 18).first().p_holm == pytest.approx(0.18)


def test_constant_ratings_have_no_kappa(spark):
    out = metrics.kappa(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int"), [], "a", "b").first()
    assert out.raw_agreement == 1 and out.kappa is None


def test_macro_f1_keeps_absent_labels(spark):
    labels = spark.createDataFrame([(a,) for a in LABELS], "author string")
    out = metrics.scores(spark.createDataFrame([("a0", "a0"), ("a1", "a1")], "author string, predicted string"), [], labels).first()
    assert out.macro_f1 == pytest.approx(2 / 3) and out.accuracy == 1


@pytest.mark.parametrize("factor", [0.6, 1.0, 1.8])
def test_affine_mapping_is_recovered(spark, factor):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 3))
    rows = spark.createDataFrame([(1, u, f, float(x[u, f]), float(factor * x[u, f] + f)) for u in range(12) for f in range(3)], "g int, unit int, feature int, x double, y double")
    mapping = geometry.affine_mapping(rows, ["g"])
    assert [r.alpha for r in mapping.collect()] == pytest.approx([factor] * 3)
    assert abs(geometry.dispersion(rows, mapping, ["g"]).first().closure_error) < 1e-12


def test_common_translation_is_a_common_shift(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(3, 5, 2))
    rows = [("original", f"a{a}", str(f), float(z[a, i, f])) for a in range(3) for i in range(5) for f in range(2)]
    rows += [("moved", a, f, v + 3) for _, a, f, v in rows]
    out = {r.condition: r for r in geometry.decomposition(spark.createDataFrame(rows, "condition string, author string, feature string, z double")).collect()}
    assert out["moved"].common_shift_rms == pytest.approx(3) and out["moved"].differential_shift_rms == pytest.approx(0, abs=1e-9)
    assert out["moved"].between == pytest.approx(out["original"].between)


@pytest.mark.parametrize("kernel", [models.shrinkage_lda, models.linear_svm])
def test_kernels_part_what_is_apart(kernel):
    rng = np.random.default_rng(5)
    y = np.repeat(["a", "b", "c"], 20)
    x = rng.normal(size=(60, 4)) + 6 * np.eye(4)[np.repeat([0, 1, 2], 20)]
    assert (kernel(x[::2], y[::2], x[1::2]) == y[1::2]).mean() == 1


def test_ledoit_wolf_shrinks_towards_the_mean_variance():
    x = np.random.default_rng(6).normal(size=(10, 30))
    made = models.ledoit_wolf(x)
    assert np.trace(made) == pytest.approx(np.trace(np.cov(x.T, bias=True))) and np.linalg.eigvalsh(made).min() > 0
