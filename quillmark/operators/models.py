"""Classifiers fitted per fold in one plan, over arrays (fold, key, label, train, z) or over long-form features (.., feature, z)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.inference import summed_arrays
from quillmark.sources.io import settled


def outer_folds(rows: DataFrame, k: int = 3) -> DataFrame:
    """Every row once for each fold, with train: whether it belongs to another fold."""
    spec = rows.sparkSession.range(k).select(F.col("id").cast("int").alias("outer"))
    return rows.crossJoin(F.broadcast(spec)).withColumn("train", F.col("fold") != F.col("outer"))


def standardised(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with z by the training rows of each group of by; features that don't vary there are left out."""
    stats = rows.where("train").groupBy(*by, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).where("sd * sd > 1e-12")
    return rows.join(stats, [*by, "feature"]).withColumn("z", (F.col("value") - F.col("mean")) / F.col("sd")).drop("value", "mean", "sd")


def centroids(rows: DataFrame, by: list[str], label: str = "author", z: str = "z") -> DataFrame:
    return rows.groupBy(*by, label, "feature").agg(F.avg(z).alias("centre"))


def nearest_centroid(rows: DataFrame, by: list[str], keys: list[str], label: str = "author") -> DataFrame:
    """by, keys, label, predicted of the rows not in training: the label of least squared distance, ties by its name."""
    centres = centroids(rows.where("train"), by, label).withColumnRenamed(label, "candidate")
    apart = rows.where("not train").join(centres, [*by, "feature"]).groupBy(*by, *keys, label, "candidate").agg(F.sum((F.col("z") - F.col("centre")) ** 2).alias("distance"))
    return apart.groupBy(*by, *keys, label).agg(F.min(F.struct(F.round("distance", 9).alias("d"), "candidate")).alias("best")).select(*by, *keys, label, F.col("best.candidate").alias("predicted"))


def gaussian_nb(rows: DataFrame, by: list[str], keys: list[str], label: str = "author", uniform: bool = True) -> DataFrame:
    """Gaussian naive Bayes: uniform priors and variances plus 1e-9 of the largest, or (not uniform) priors from counts and variances of 1e-6 at least."""
    train = rows.where("train")
    stats = train.groupBy(*by, label, "feature").agg(F.avg("z").alias("m"), F.var_pop("z").alias("v"), F.count("*").alias("n"))
    if uniform:
        widest = train.groupBy(*by, "feature").agg(F.var_pop("z").alias("v")).groupBy(*by).agg(F.max("v").alias("widest"))
        stats = stats.join(widest, by).withColumn("v", F.col("v") + 1e-9 * F.col("widest")).withColumn("prior", F.lit(0.0))
    else:
        total = Window.partitionBy(*by, "feature")
        stats = stats.withColumns({"v": F.greatest("v", F.lit(1e-6)), "prior": F.log(F.col("n") / F.sum("n").over(total))})
    stats = stats.withColumnRenamed(label, "candidate").drop("n")
    part = -0.5 * F.log(2 * np.pi * F.col("v")) - (F.col("z") - F.col("m")) ** 2 / (2 * F.col("v"))
    scored = rows.where("not train").join(stats, [*by, "feature"]).groupBy(*by, *keys, label, "candidate").agg((F.sum(part) + F.max("prior")).alias("score"))
    return _best(scored, by, keys, label)


def diagonal_lda(rows: DataFrame, by: list[str], keys: list[str], label: str = "author") -> DataFrame:
    """A linear discriminant with one pooled variance a feature (n - 1 a class, 1e-6 at least) and priors from counts."""
    train = rows.where("train")
    stats = train.groupBy(*by, label, "feature").agg(F.avg("z").alias("m"), (F.var_pop("z") * F.count("*")).alias("ss"), F.count("*").alias("n"))
    w = Window.partitionBy(*by, "feature")
    pooled = F.greatest(F.sum("ss").over(w) / F.greatest(F.sum(F.col("n") - 1).over(w), F.lit(1)), F.lit(1e-6))
    stats = stats.withColumns({"pooled": pooled, "prior": F.log(F.col("n") / F.sum("n").over(w))}).withColumnRenamed(label, "candidate").drop("ss", "n")
    part = F.col("z") * F.col("m") / F.col("pooled") - F.col("m") ** 2 / (2 * F.col("pooled"))
    scored = rows.where("not train").join(stats, [*by, "feature"]).groupBy(*by, *keys, label, "candidate").agg((F.sum(part) + F.max("prior")).alias("score"))
    return _best(scored, by, keys, label)


def _best(scored: DataFrame, by: list[str], keys: list[str], label: str) -> DataFrame:
    best = F.min(F.struct((-F.round("score", 6)).alias("s"), "candidate")).alias("best")
    return scored.groupBy(*by, *keys, label).agg(best).select(*by, *keys, label, F.col("best.candidate").alias("predicted"))


def _moments(rows: DataFrame, by: list[str], z: str = "z") -> DataFrame:
    """by, m, v (population variances) and n of arrays, added up by each task first; a null element counts as 0."""
    whole = array_to_vector(F.transform(z, lambda x: F.coalesce(x, F.lit(0.0))))
    seen = rows.groupBy(*by).agg(Summarizer.metrics("mean", "variance", "count").summary(whole).alias("s"))
    n = F.col("s.count")
    sample = vector_to_array("s.variance")
    return seen.select(*by, vector_to_array("s.mean").alias("m"), F.transform(sample, lambda v: v * (n - 1) / n).alias("v"), n.alias("n"))


def mean_vectors(rows: DataFrame, by: list[str]) -> DataFrame:
    """by and z: the mean of the arrays z of each group, an element that is null in all of a group's rows staying null; written once."""
    known = F.transform("z", lambda v: F.when(v.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)))
    share, mean = (_moments(r, by).select(*by, F.col("m").alias(c)) for r, c in ((rows.withColumn("z", known), "share"), (rows, "mean")))
    both = settled(mean).join(settled(share), by)
    return settled(both.select(*by, F.zip_with("mean", "share", lambda m, k: F.when(k > 0, m / k)).alias("z")))


def standard_vectors(rows: DataFrame, by: list[str], fit: Column) -> DataFrame:
    """rows with z in place of the array values, by means and deviations of the rows of each group of by where fit holds; elements that don't vary there are null."""
    stats = settled(_moments(rows.where(fit), by, "values"))
    joined = rows.join(stats, by)
    z = F.transform(F.arrays_zip("values", "m", "v"), lambda x: F.when(x.v > 1e-12, (x["values"] - x.m) / F.sqrt(x.v)))
    return joined.withColumn("z", z).drop("values", "m", "v", "n")


def mean_z(moments: DataFrame, fits: list[tuple[np.ndarray, np.ndarray]], seen: list[list[int]]) -> DataFrame:
    """The columns of moments but n, mean and square, with outer and z: for each of fits (means and variances of an outer fold's training rows) the standardised mean of the elements that it has (seen), null for those that don't vary."""
    keys = [c for c in moments.columns if c not in ("n", "mean", "square")]
    kinds = ", ".join(f"`{c}` {t}" for c, t in moments.select(*keys).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = np.asarray(batch.column("mean").flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
            for outer, ((m, v), own) in enumerate(zip(fits, seen)):
                if not batch.num_rows:
                    continue
                varies = v[own] > 1e-12
                z = np.where(varies, (means[:, own] - m[own]) / np.sqrt(np.where(varies, v[own], 1)), 0)
                flat = pa.array(z.ravel(), mask=np.tile(~varies, batch.num_rows))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(own), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array([outer] * batch.num_rows, pa.int32()), listed], [*keys, "outer", "z"])

    return moments.mapInArrow(run, f"{kinds}, outer int, z array<double>")


def candidates(train: DataFrame, by: list[str], kind: str = "centroid", label: str = "author") -> DataFrame:
    """by, candidate, centre, weight, bias of every label: what is best has the largest bias - sum of weight * (z - centre)^2.

    kind: centroid (least distance), nb_uniform (Gaussian naive Bayes with variances plus 1e-9 of the largest and equal
    priors), nb_counts (variances of 1e-6 at least, priors from counts), or lda (a pooled variance of n - 1 a label, 1e-6
    at least, priors from counts).
    """
    stats = _moments(train, [*by, label]).withColumnRenamed(label, "candidate")
    prior = F.log(F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    if kind == "centroid":
        stats = stats.withColumns({"weight": F.transform("m", lambda m: F.lit(1.0)), "bias": F.lit(0.0)})
    elif kind == "lda":
        every = F.collect_list(F.struct("n", "v")).over(Window.partitionBy(*by))
        sums = F.aggregate("every", F.transform("v", lambda v: F.lit(0.0)), lambda a, x: F.zip_with(a, x.v, lambda p, q: p + q * x.n))
        spare = F.greatest(F.aggregate("every", F.lit(0).cast("long"), lambda a, x: a + x.n - 1), F.lit(1))
        pooled = F.transform(sums, lambda p: 0.5 / F.greatest(p / spare, F.lit(1e-6)))
        stats = stats.withColumn("every", every).withColumns({"weight": pooled, "bias": prior}).drop("every")
    else:
        if kind == "nb_uniform":
            widest = _moments(train, by).select(*by, (F.array_max("v") * 1e-9).alias("least"))
            stats = stats.join(widest, by).withColumn("v", F.transform("v", lambda v: v + F.col("least"))).drop("least")
            prior = F.lit(0.0)
        else:
            stats = stats.withColumn("v", F.transform("v", lambda v: F.greatest(v, F.lit(1e-6))))
        logs = F.aggregate("v", F.lit(0.0), lambda a, v: a - 0.5 * F.log(2 * np.pi * v))
        stats = stats.withColumns({"weight": F.transform("v", lambda v: 0.5 / v), "bias": logs + prior})
    return stats.select(*by, "candidate", F.col("m").alias("centre"), "weight", "bias")


def attributed(rows: DataFrame, by: list[str], keys: list[str], kind: str = "centroid", label: str = "author", train: Column | None = None, digits: int = 6) -> DataFrame:
    """by, keys, label, predicted of the rows (with z and train) that are not in training: the best candidate, ties (to so many digits) by name.

    The candidates are few rows of arrays, written once, which Spark sends to every task where their size allows.
    """
    fitted = settled(candidates(rows.where(F.col("train") if train is None else train), by, kind, label))
    score = F.col("bias") - F.aggregate(F.arrays_zip("z", "centre", "weight"), F.lit(0.0), lambda a, x: a + x.weight * F.pow(F.coalesce(x.z, F.lit(0.0)) - x.centre, F.lit(2.0)))
    scored = rows.where("not train").join(fitted, by).select(*by, *keys, label, F.struct((-F.round(score, digits)).alias("s"), "candidate").alias("b"))
    return scored.groupBy(*by, *keys, label).agg(F.min("b").alias("b")).select(*by, *keys, label, F.col("b.candidate").alias("predicted"))


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    """The shrunk covariance of the rows of x (Ledoit and Wolf 2004), shrunk towards its mean variance."""
    n = len(x)
    x = x - x.mean(axis=0)
    return shrunk(x.T @ x / n, ((x**2).sum(axis=1) ** 2).sum() / n, n)


def shrunk(sample: np.ndarray, fourth: float, n: float) -> np.ndarray:
    """ledoit_wolf from the covariance of n rows and the mean of their squared squared distances from the mean."""
    p = len(sample)
    mu = np.trace(sample) / p
    delta = ((sample - mu * np.eye(p)) ** 2).sum() / p
    beta = (fourth - (sample**2).sum()) / (n * p)
    shrink = 0.0 if delta == 0 else min(beta, delta) / delta
    return (1 - shrink) * sample + shrink * mu * np.eye(p)


def shrinkage_lda(x: np.ndarray, y: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Labels by a linear discriminant with uniform priors, whose covariance is the mean of the classes' ones, each shrunk in units of its own deviations."""
    labels = np.unique(y)
    means = np.array([x[y == k].mean(axis=0) for k in labels])
    shared = np.zeros((x.shape[1], x.shape[1]))
    for k in labels:
        own = x[y == k]
        scale = own.std(axis=0)
        scale[scale == 0] = 1
        shared += ledoit_wolf(own / scale) * np.outer(scale, scale) / len(labels)
    weights = np.linalg.lstsq(shared, means.T, rcond=None)[0]
    return labels[(new @ weights - 0.5 * np.einsum("kp,pk->k", means, weights)).argmax(axis=1)]


def linear_svm(x: np.ndarray, y: np.ndarray, new: np.ndarray, c: float = 1.0, rounds: int = 100) -> np.ndarray:
    """One-against-rest squared-hinge support vectors with an intercept, the one class weighted by all / (classes * its own rows), by Newton steps with line search."""
    labels = np.unique(y)
    full = np.hstack([x, np.ones((len(x), 1))])
    scores = []
    for k in labels:
        t = np.where(y == k, 1.0, -1.0)
        weight = np.where(t > 0, c * len(y) / (len(labels) * (t > 0).sum()), c)
        w = np.zeros(full.shape[1])

        def loss(w, t=t, weight=weight):
            return 0.5 * w @ w + (weight * np.maximum(0, 1 - t * (full @ w)) ** 2).sum()

        for _ in range(rounds):
            gap = np.maximum(0, 1 - t * (full @ w))
            gradient = w - 2 * full.T @ (weight * gap * t)
            if np.abs(gradient).max() < 1e-8:
                break
            active = full[gap > 0] * np.sqrt(2 * weight[gap > 0])[:, None]
            step = np.linalg.solve(np.eye(len(w)) + active.T @ active, gradient)
            size, now = 1.0, loss(w)
            while loss(w - size * step) > now - 1e-4 * size * (gradient @ step) and size > 1e-10:
                size /= 2
            w = w - size * step
        scores.append(np.hstack([new, np.ones((len(new), 1))]) @ w)
    return labels[np.argmax(scores, axis=0)]




def _scatters(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """by, label, n, scatter (sum of u u' over the label's rows, u being z in units of the label's mean and deviations) and fourth (sum of the squared squared lengths of u), from rows with z, m and v: tasks add up their own."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keys = [*by, label]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        types = None
        for batch in batches:
            types = [batch.schema.field(c).type for c in keys]
            named = list(zip(*(batch.column(c).to_pylist() for c in keys)))
            z, m, v = (np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in ("z", "m", "v"))
            for key in set(named):
                at = np.array([k == key for k in named])
                scale = np.sqrt(v[at])
                u = (z[at] - m[at]) / np.where(scale > 0, scale, 1)
                part = [at.sum(), u.T @ u, ((u * u).sum(axis=1) ** 2).sum()]
                sums[key] = [a + b for a, b in zip(sums[key], part)] if key in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([*(pa.array(list(k), t) for k, t in zip(zip(*sums), types)), pa.array([np.concatenate([[n, fourth], scatter.ravel()]) for n, scatter, fourth in sums.values()], pa.list_(pa.float64()))], [*keys, "sums"])

    parts = rows.select(*keys, "z", "m", "v").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", sums array<double>")
    return summed_arrays(parts, keys, "sums")


def shrinkage_lda_by(rows: DataFrame, by: list[str], key: str = "doc_id", label: str = "author") -> DataFrame:
    """by, key, label, predicted of the rows not in training, by the model of shrinkage_lda, from sums: what moves is a square matrix a label, and no task holds a group's rows.

    A group of by without training rows predicts null.
    """
    filled = rows.withColumn("z", F.transform("z", lambda x: F.coalesce(x, F.lit(0.0))))
    train = filled.where("train")
    stats = settled(_moments(train, [*by, label]))
    fitted: dict[tuple, dict] = {}
    scatters = {tuple(r[:-1]): np.asarray(r["sums"]) for r in _scatters(train.join(F.broadcast(stats), [*by, label]), by, label).collect()}
    for r in stats.collect():
        own = tuple(r[c] for c in (*by, label))
        n, fourth, scatter = scatters[own][0], scatters[own][1], scatters[own][2:]
        p = math.isqrt(len(scatter))
        sample = scatter.reshape(p, p) / n
        scale = np.sqrt(np.asarray(r["v"]))
        scale[scale == 0] = 1
        model = fitted.setdefault(own[: len(by)], {"labels": [], "means": [], "shared": 0.0})
        model["labels"].append(str(own[-1]))
        model["means"].append(np.asarray(r["m"]))
        model["shared"] = model["shared"] + shrunk(sample, fourth / n, n) * np.outer(scale, scale)
    for model in fitted.values():
        order = np.argsort(model["labels"])
        means = np.array(model["means"])[order]
        weights = np.linalg.lstsq(model["shared"] / len(order), means.T, rcond=None)[0]
        model.update(labels=np.array(model["labels"], object)[order], weights=weights, bias=-0.5 * np.einsum("kp,pk->k", means, weights))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    sent = rows.sparkSession.sparkContext.broadcast({k: (m["labels"], m["weights"], m["bias"]) for k, m in fitted.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = list(zip(*(batch.column(c).to_pylist() for c in by)))
            z = np.asarray(batch.column("z").flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
            said = np.full(batch.num_rows, None, object)
            for group in set(named) & sent.value.keys():
                at = np.array([k == group for k in named])
                labels, weights, bias = sent.value[group]
                said[at] = labels[(z[at] @ weights + bias).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*by, key, label)), pa.array(said.tolist(), pa.string())], [*by, key, label, "predicted"])

    kept = filled.where("not train").select(*by, key, label, "z")
    return kept.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*by, key, label)) + ", predicted string")
