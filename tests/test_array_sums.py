"""Models and means from sums of arrays are those of the dense or long forms."""

import numpy as np
from pyspark.sql import functions as F

from quillmark.operators import models


def _rows(spark):
    rng = np.random.default_rng(3)
    made = [(k, k % 3, "abc"[k % 5 % 3], o, k % 3 != o, [None, 1.0, *map(float, rng.normal(k % 5 % 3, 1 + k % 2, 4))]) for k in range(120) for o in range(3)]
    return spark.createDataFrame(made, "doc_id long, fold int, author string, outer int, train boolean, z array<double>").repartition(5)


def test_the_discriminant_from_sums_equals_the_dense_one(spark):
    rows = _rows(spark)
    got = {(r.outer, r.doc_id): r.predicted for r in models.shrinkage_lda_by(rows, ["outer"]).collect()}
    frame = rows.toPandas().sort_values("doc_id")
    for o, own in frame.groupby("outer"):
        x = np.array([[0.0 if v is None else v for v in z] for z in own["z"]])
        train = own["train"].to_numpy()
        want = models.shrinkage_lda(x[train], own["author"].to_numpy()[train].astype(str), x[~train])
        assert [got.pop((o, d)) for d in own["doc_id"].to_numpy()[~train]] == want.tolist()
    assert not got


def test_means_of_arrays_equal_those_of_rows(spark):
    rows = _rows(spark)
    got = {(r.outer, r.author): r.z for r in models.mean_vectors(rows, ["outer", "author"]).collect()}
    want = rows.select("outer", "author", F.posexplode("z")).groupBy("outer", "author", "pos").agg(F.avg("col").alias("m")).collect()
    for r in want:
        own = got[(r.outer, r.author)][r.pos]
        assert own is None if r.m is None else abs(own - r.m) < 1e-12
    assert len(want) == sum(map(len, got.values()))
