"""Bootstrap weights by binomial splits, positions by ranges, and scores from weights."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.operators import inference
from quillmark.operators.ranks import positions


def passages(spark, sizes=(5, 1, 7, 3)):
    return spark.createDataFrame([(f"a{a}", f"a{a}w{w}", a * 1000 + w * 100 + i) for a in range(3) for w, n in enumerate(sizes) for i in range(n)], "author string, work string, doc_id long")


def by_replicate(weights):
    out = {}
    for r in weights.collect():
        out.setdefault(r.replicate, {})[r.doc_id] = r.weight
    return out


def test_weights_are_the_same_however_rows_are_dealt(spark):
    rows = passages(spark)
    want = by_replicate(inference.bootstrap_weights(rows.coalesce(1), 30))
    assert by_replicate(inference.bootstrap_weights(rows.repartition(7, "doc_id"), 30)) == want
    assert by_replicate(inference.bootstrap_weights(rows, 30, seed=1)) != want


def test_an_author_draws_as_many_works_as_there_are_and_whole_works(spark):
    sizes = (5, 1, 7, 3)
    for drawn in by_replicate(inference.bootstrap_weights(passages(spark, sizes), 40)).values():
        for a in range(3):
            per_work = [sum(n for d, n in drawn.items() if d // 1000 == a and d // 100 % 10 == w) for w in range(4)]
            times = [n / size for n, size in zip(per_work, sizes)]
            assert sum(times) == 4 and all(t == int(t) for t in times)


def test_tree_counts_are_multinomial():
    total = np.full(40_000, 6)
    found = dict(inference.tree_counts(total, 3, np.arange(3), 5, "x"))
    assert (sum(found.values()) == 6).all()
    assert [v.mean() for v in found.values()] == pytest.approx([2, 2, 2], abs=0.03) and [v.var() for v in found.values()] == pytest.approx([4 / 3] * 3, abs=0.05)
    alone = dict(inference.tree_counts(total, 3, np.array([2]), 5, "x"))
    assert (alone[2] == found[2]).all() and not dict(inference.tree_counts(total, 3, np.array([], int), 5, "x"))


@pytest.mark.parametrize("by", [[], ["c"]])
def test_scores_of_placed_passages_equal_those_of_drawn_rows(spark, by):
    rows = passages(spark)
    said = rows.withColumn("predicted", F.when(F.col("doc_id") % 4 == 0, "a1").when(F.col("doc_id") % 7 == 0, F.lit("a9")).otherwise(F.col("author")))
    predictions = said.withColumn("c", F.lit("all")).unionByName(rows.withColumn("predicted", F.col("author")).withColumn("c", F.lit("right")).where(F.lit(bool(by))))
    figures = []
    for placed in (False, True):
        scored = inference.weighted_f1(predictions, inference.bootstrap_weights(rows, 25, placed=placed), by, 3)
        figures.append(sorted((*(r[c] for c in by), r.replicate, round(r.macro_f1, 9)) for r in scored.collect()))
    assert figures[0] == figures[1] and len(figures[0]) == 25 * (1 + bool(by))
    if by:
        assert {r[-1] for r in figures[1] if r[0] == "right"} == {1.0}


def test_passages_of_a_work_are_drawn_beside_one_another(spark, monkeypatch):
    rows = spark.range(3000).select(F.lit("a").alias("author"), F.concat(F.lit("w"), F.col("id") % 3).alias("work"), F.col("id").alias("doc_id"), F.lit("a").alias("predicted"))
    apart = spark.sparkContext.accumulator(0)

    def watched(batch):
        at = list(zip(batch.column("work").to_pylist(), batch.column("place").to_pylist()))
        apart.add(sum(b != (a[0], a[1] + 1) for a, b in zip(at, at[1:])))
        return iter(())

    monkeypatch.setattr(inference, "passage_weights", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert inference.weighted_confusions(rows, inference.bootstrap_weights(rows.select("author", "work", "doc_id"), 2, placed=True), []).collect() == []
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert apart.value <= 3 * (1000 // inference.NEAR + 1)


def test_positions_equal_row_number(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"), F.when(F.col("id") % 5 > 0, F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 4))).alias("g"), F.lit(1).alias("place"))
    for group in ([], ["g"]):
        got = positions(rows, ["v"], group, "place")
        want = rows.drop("place").withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("v")).cast("long"))
        assert sorted(map(tuple, got.select("v", "g", "place").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        assert "Window" not in got._jdf.queryExecution().toString() or group
    assert positions(rows.where("v < 0"), ["v"], ["g"]).collect() == [] and positions(rows.where("v < 0"), ["v"]).collect() == []
    assert [r.position for r in positions(rows, [F.desc("v")]).orderBy("position").limit(3).collect()] == [1, 2, 3]
