"""Running sums, order statistics, chains and packing against plain loops; checks that must see null keys, repeats and conflicts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions.passages import packed_parts
from quillmark.operators import cohort, evidence, logs
from quillmark.operators.ranks import order_statistics, packed, running_sums


def test_running_sums(spark):
    rows = [(g, i, None if i % 7 == 0 else i % 5) for g, n in (("hot", 400), ("b", 9), (None, 3)) for i in range(n)]
    got = {(r.g, r.i): r.running for r in running_sums(spark.createDataFrame(rows, "g string, i int, v long"), "v", ["i"], ["g"]).collect()}
    assert got == {(g, i): sum(x[2] or 0 for x in rows if x[0] == g and x[1] <= i) for g, i, _ in rows}
    every = running_sums(spark.createDataFrame(rows, "g string, i int, v long").where("g = 'hot'"), "v", ["i"]).agg(F.max("running")).first()[0]
    assert every == got[("hot", 399)] and running_sums(spark.createDataFrame([], "i int, v long"), "v", ["i"]).collect() == []


@pytest.mark.parametrize("header", [0, 3])
def test_packing_equals_the_sequential_one(spark, header):
    rng, rows = random.Random(header), []
    for group, n in (("many", 300), ("one", 1), ("large", 12), ("zero", 20)):
        rows += [(group, i, {"large": 200, "zero": 0}.get(group) or (0 if group == "zero" else rng.choice([1, 4, 9, 17, 60]))) for i in range(n)]
    got = {}
    for r in packed(spark.createDataFrame(rows, "g string, i int, n int").withColumn("part", F.lit("clash")).drop("part"), ["g"], ["i"], "n", 50, header).collect():
        got.setdefault(r.g, []).append((r.i, r.part))
    for group in got:
        assert [p for _, p in sorted(got[group])] == packed_parts([n for g, _, n in rows if g == group], 50, header), group
    assert len(got) == 4 and packed(spark.createDataFrame([], "g string, i int, n int"), ["g"], ["i"], "n").collect() == []


def test_order_statistics_equal_sorting(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=500), "b": np.repeat([3.0, -1.0], 40), "c": np.array([2.5]), "d": np.concatenate([rng.lognormal(9, 9, 200), [-1e308, 1e308, 5e-324, 0.0]])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("z", None)]
    ranks = [(g, r) for g, vs in values.items() for r in (0, 1, len(vs) // 2, len(vs) - 1, len(vs), -1)] + [("z", 0), ("y", 0)]
    found = order_statistics(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", spark.createDataFrame(ranks, "g string, rank long")).collect()
    want = {(g, r): np.sort(values[g])[r] for g, r in ranks if g in values and 0 <= r < len(values[g])}
    assert {(r.g, r["rank"]): r.value for r in found} == want and len(found) == len(want)


def test_bounds_of_replicates(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=333), "b": rng.normal(size=3)}
    got = {r.g: r for r in evidence.replicate_bounds(spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double"), ["g"], "v").collect()}
    for g, vs in values.items():
        low, high = np.quantile(vs, [0.025, 0.975])
        assert (got[g].linear_low, got[g].linear_high) == pytest.approx((low, high))
    assert got["a"].cut_low == np.sort(values["a"])[8] and got["a"].cut_high == np.sort(values["a"])[323]


def test_null_keys_meet_and_equal_points_stay(spark):
    stored = spark.createDataFrame([(None, 1.0), ("a", 2.0), ("b", None)], "k string, v double")
    again = spark.createDataFrame([(None, 1.0), ("a", 2.5), ("c", 1.0)], "k string, v double")
    assert {(r.k, r.problem) for r in evidence.recomputed(stored, again, ["k"], ["v"], 1e-9).collect()} == {("a", "v"), ("b", "missing"), ("c", "unexpected")}
    points = spark.createDataFrame([("g", 5), ("g", 5), ("g", 50), (None, 5)], "g string, at int")
    spans = spark.createDataFrame([("g", 4, 9, "second"), ("g", 0, 6, "first")], "g string, a int, b int, name string")
    assert [tuple(r) for r in cohort.contained(points, spans, ["g"], "a", "b").collect()] == [("g", 5, 0, 6, "first")] * 2


def test_cells_that_are_not_unique_and_logs_that_conflict_are_errors(spark):
    lines = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    cells = spark.createDataFrame([(1, "x"), (3, None)], "k int, cell string")
    assert {tuple(r) for r in evidence.looked_up(lines, cells, ["k"], "cell").collect()} == {(1, "x", True), (2, None, False), (3, None, True)}
    with pytest.raises(Exception, match="more than one cell for 1"):
        evidence.looked_up(lines, cells.union(cells), ["k"], "cell").collect()
    log = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, logs.merged(log, log.where("k = 1"), ["k"]).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="conflict on k=1"):
        logs.merged(log, spark.createDataFrame([(1, "z")], "k int, v string"), ["k"])
