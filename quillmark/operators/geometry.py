"""Distances, shifts, dispersion and restricted mappings between centroids, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_distances(centres: DataFrame, by: list[str], label: str = "author") -> DataFrame:
    """by, a, b, delta (mean absolute difference), euclid of every two labels' centroids (by, label, feature, centre)."""
    a = centres.select(*by, "feature", F.col(label).alias("a"), F.col("centre").alias("x"))
    b = centres.select(*by, "feature", F.col(label).alias("b"), F.col("centre").alias("y"))
    apart = F.col("x") - F.col("y")
    return a.join(b, [*by, "feature"]).where("a < b").groupBy(*by, "a", "b").agg(F.avg(F.abs(apart)).alias("delta"), F.sqrt(F.sum(apart * apart)).alias("euclid"))


def distance_summary(distances: DataFrame, condition: str = "condition", original: str = "original") -> DataFrame:
    """Of each condition: mean, median, least, largest and spread of delta, and its mean's ratio to the original's."""
    each = distances.groupBy(condition).agg(F.count("*").alias("pairs"), F.avg("delta").alias("mean"), F.percentile("delta", F.lit(0.5)).alias("median"), F.min("delta").alias("least"), F.max("delta").alias("largest"), F.stddev_pop("delta").alias("spread"))
    base = each.where(F.col(condition) == original).select(F.col("mean").alias("base"))
    ratio = F.when(F.col("base") > 0, F.col("mean") / F.col("base"))
    return each.crossJoin(F.broadcast(base)).withColumns({"ratio_to_original": ratio, "contraction": 1 - ratio}).drop("base")


def centroid_shift(centres: DataFrame, label: str = "author", original: str = "original") -> DataFrame:
    """condition, label, shift: the mean absolute move of a label's centroid from the original condition."""
    base = centres.where(F.col("condition") == original).select(label, "feature", F.col("centre").alias("base"))
    return centres.where(F.col("condition") != original).join(base, [label, "feature"]).groupBy("condition", label).agg(F.avg(F.abs(F.col("centre") - F.col("base"))).alias("shift"))


def decomposition(rows: DataFrame, label: str = "author", original: str = "original") -> DataFrame:
    """Of each condition: between and within mean squares, their ratio, and common and differential shift, root mean square."""
    centres = rows.groupBy("condition", label, "feature").agg(F.avg("z").alias("c"), F.var_pop("z").alias("w"))
    base = centres.where(F.col("condition") == original).select(label, "feature", F.col("c").alias("c0"))
    both = centres.join(base, [label, "feature"])
    feature = both.groupBy("condition", "feature").agg(F.var_pop("c").alias("between"), F.avg("w").alias("within"), F.avg(F.col("c") - F.col("c0")).alias("common"), F.var_pop(F.col("c") - F.col("c0")).alias("differential"))
    means = feature.groupBy("condition").agg(F.count("*").alias("features"), F.avg("between").alias("between"), F.avg("within").alias("within"), F.sqrt(F.avg(F.col("common") ** 2)).alias("common_shift_rms"), F.sqrt(F.avg("differential")).alias("differential_shift_rms"))
    return means.withColumn("between_within_ratio", F.when(F.col("within") > 0, F.col("between") / F.col("within")))


def feature_changes(centres: DataFrame, label: str = "author", original: str = "original") -> DataFrame:
    base = centres.where(F.col("condition") == original).select(label, "feature", F.col("centre").alias("original_mean"))
    joined = centres.where(F.col("condition") != original).join(base, [label, "feature"])
    return joined.select("condition", label, "feature", "original_mean", F.col("centre").alias("rewrite_mean"), (F.col("centre") - F.col("original_mean")).alias("delta"))


def affine_mapping(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, feature, alpha, shift, translation of pairs (by, unit, feature, x, y): one factor for all features by centred least squares.

    y is mapped as alpha * x + shift; the translation is the shift of a mapping whose factor is 1. alpha is null where
    the units do not differ.
    """
    means = pairs.groupBy(*by, "feature").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"))
    factor = means.groupBy(*by).agg(F.when(F.sum("xx") > 1e-15, F.sum("xy") / F.sum("xx")).alias("alpha"))
    joined = means.join(factor, by) if by else means.crossJoin(factor)
    return joined.select(*by, "feature", "alpha", (F.col("my") - F.col("alpha") * F.col("mx")).alias("shift"), (F.col("my") - F.col("mx")).alias("translation"))


def dispersion(pairs: DataFrame, mapping: DataFrame, by: list[str]) -> DataFrame:
    """The spread of y as scaled spread of x, residual spread and their cross term, with the error of closure."""
    rows = pairs.join(mapping, [*by, "feature"]).withColumn("e", F.col("y") - F.col("alpha") * F.col("x") - F.col("shift"))
    each = rows.groupBy(*by, "feature").agg(F.var_pop("x").alias("bx"), F.var_pop("y").alias("by_"), F.var_pop("e").alias("be"), F.covar_pop("x", "e").alias("xe"), F.max("alpha").alias("alpha"))
    means = each.groupBy(*by).agg(F.avg("bx").alias("between_original"), F.avg("by_").alias("between_rewrite"), F.avg(F.col("alpha") ** 2 * F.col("bx")).alias("scaled"), F.avg("be").alias("residual"), F.avg(2 * F.col("alpha") * F.col("xe")).alias("cross"))
    return means.withColumn("closure_error", F.col("between_rewrite") - F.col("scaled") - F.col("residual") - F.col("cross"))


def mapping_errors(pairs: DataFrame, mapping: DataFrame, by: list[str]) -> DataFrame:
    """Mean squared errors of identity, translation and affine mapping on (other) pairs."""
    rows = pairs.join(mapping, [*by, "feature"])
    x, y = F.col("x"), F.col("y")
    return rows.groupBy(*by).agg(F.avg((y - x) ** 2).alias("identity"), F.avg((y - x - F.col("translation")) ** 2).alias("translation"), F.avg((y - F.col("alpha") * x - F.col("shift")) ** 2).alias("scalar_affine"))
