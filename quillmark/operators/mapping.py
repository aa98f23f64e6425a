"""Restricted mappings between the centroids of works, read on unseen works, with intervals from drawn works."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.inference import summed_arrays, tree_counts
from quillmark.operators.models import _moments
from quillmark.operators.ranks import positions
from quillmark.sources.io import settled

MAPPINGS = ("identity", "translation", "scalar_affine")
COMPONENTS = ("between_original", "between_rewrite", "scaled", "residual", "cross")
#: Replicates whose sums over features meet in one array.
BLOCK = 250
GROUP = ["outer", "condition", "family"]


def work_pairs(rows: DataFrame, families: dict[str, tuple[int, int] | None], base: str = "original") -> DataFrame:
    """GROUP, author, work, train, x, y and features: the centroid of each work in the base condition and in another.

    rows have outer, train, condition, author, work and z; families name the elements of z that they see (all for None).
    Elements that are null count as 0 and not as features. A work that lacks a condition has no pair there.
    """
    keys = ["outer", "author", "work", "train"]
    kept = rows.groupBy("outer").agg(F.any_value(F.transform("z", lambda v: v.isNotNull().cast("int"))).alias("kept"))
    centres = settled(_moments(rows, [*keys, "condition"], "z").select(*keys, "condition", "m"))
    first = centres.where(F.col("condition") == base).select(*keys, F.col("m").alias("x"))
    both = centres.where(F.col("condition") != base).join(first, keys).withColumnRenamed("m", "y").join(F.broadcast(kept), "outer")
    part = lambda c, span: F.col(c) if span is None else F.slice(c, span[0] + 1, span[1] - span[0])
    seen = F.array(*(F.struct(F.lit(k).alias("family"), part("x", s).alias("x"), part("y", s).alias("y"), F.aggregate(part("kept", s), F.lit(0), lambda a, b: a + b).alias("features")) for k, s in families.items()))
    return settled(both.withColumn("f", F.explode(seen)).select("outer", "condition", "f.family", "author", "work", "train", "f.x", "f.y", "f.features"))


def _sums_of(rows: DataFrame, keys: list[str], others: list[str], make: Callable[[dict], list[tuple[tuple, np.ndarray]]], more: str = "") -> DataFrame:
    """keys (and more of them) and sums: what make gives for each row, added up by each task and then between tasks."""
    kinds = dict(rows.dtypes)
    names = [*keys, *(x.split()[0] for x in more.split(", ") if x)]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), *([more] if more else []), "sums array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def out():
            columns = [[k[i] for k in sums] for i in range(len(names))]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(list(sums.values()), pa.list_(pa.float64()))], [*names, "sums"])

        for batch in batches:
            types = [batch.schema.field(c).type for c in keys] + [pa.int64()] * (len(names) - len(keys))
            for row in batch.to_pylist():
                own = tuple(row[c] for c in keys)
                for extra, values in make(row):
                    key = (*own, *extra)
                    sums[key] = sums[key] + values if key in sums else values
            if sum(v.nbytes for v in sums.values()) > 64 << 20:
                yield out()
                sums.clear()
        if sums:
            yield out()

    return summed_arrays(rows.select(*keys, *others).mapInArrow(run, schema), names, "sums")


def fitted(pairs: DataFrame) -> DataFrame:
    """GROUP, alpha, shift and translation from the training works: y as alpha * x + shift, or as x + translation; alpha and shift are null where works don't differ."""

    def make(row):
        x, y = np.asarray(row["x"]), np.asarray(row["y"])
        return [((), np.concatenate([[1.0], x, y, x * y, x * x]))]

    rows = _sums_of(pairs.where("train"), GROUP, ["x", "y"], make)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alphas, shifts, translations = [], [], []
            for sums in batch.column("sums"):
                values = np.asarray(sums.values)
                n, (x, y, xy, xx) = values[0], values[1:].reshape(4, -1)
                spread = (xx - x * x / n).sum()
                alpha = float((xy - x * y / n).sum() / spread) if spread > 1e-15 else None
                alphas.append(alpha)
                shifts.append(None if alpha is None else (y - alpha * x) / n)
                translations.append((y - x) / n)
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in GROUP), pa.array(alphas, pa.float64()), pa.array(shifts, doubles), pa.array(translations, doubles)], [*GROUP, "alpha", "shift", "translation"])

    kinds = dict(pairs.dtypes)
    return settled(rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in GROUP) + ", alpha double, shift array<double>, translation array<double>"))


def held_out(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """The pairs of works that are not in training, with alpha, the affine mapping's residual e and the mean squared error of each mapping."""
    minus = lambda a, b: F.zip_with(a, b, lambda p, q: p - q)
    square = lambda a: F.aggregate(F.transform(a, lambda v: v * v), F.lit(0.0), lambda s, v: s + v) / F.col("features")
    rows = pairs.where("not train").join(F.broadcast(mapping), GROUP)
    moved = minus(F.col("y"), F.col("x"))
    rows = rows.withColumn("e", minus(minus(F.col("y"), F.transform("x", lambda v: v * F.col("alpha"))), F.col("shift")))
    return settled(rows.withColumns({"identity": square(moved), "translation_error": square(minus(moved, F.col("translation"))), "scalar_affine": square(F.col("e"))}).drop("shift", "translation", "train").withColumnRenamed("translation_error", "translation"))


def placed_works(held: DataFrame) -> DataFrame:
    """held with work_place and works: a work's place among its author's, by name, and how many there are."""
    works = positions(settled(held.select("author", "work").distinct()), ["work"], ["author"], "work_place")
    counts = works.groupBy("author").agg(F.count("*").alias("works"))
    return held.join(works.join(counts, "author"), ["author", "work"])


def error_intervals(held: DataFrame, replicates: int, seed: int = 20260922) -> DataFrame:
    """condition, family, measure, value, ci_low, ci_high: mean errors of the three mappings over all held-out works, and what each improves on the one before.

    In each replicate as many of every author's works are drawn as there are. A task draws its own works' counts (by
    tree_counts) and adds up weighted errors; replicates are arrays, and no passage or work is drawn as a row. Works of
    all outer folds meet, each read by the mapping of its own.
    """

    def make(row):
        counts = next(c for _, c in tree_counts(np.full(replicates, row["works"]), row["works"], np.array([row["work_place"] - 1]), seed, "works", row["author"]))
        errors = np.array([row[m] if row[m] is not None else np.nan for m in MAPPINGS])
        return [((), np.concatenate([[1.0], errors, np.outer(np.concatenate([[1.0], errors]), counts).ravel()]))]

    rows = _sums_of(placed_works(held), ["condition", "family"], ["author", "work_place", "works", *MAPPINGS], make)
    kinds = dict(held.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for condition, family, sums in zip(batch.column("condition").to_pylist(), batch.column("family").to_pylist(), batch.column("sums")):
                values = np.asarray(sums.values)
                whole, drawn = values[1:4] / values[0], values[4:].reshape(4, -1)
                means = drawn[1:] / np.maximum(drawn[0], 1)
                measures = [(m, whole[i], means[i]) for i, m in enumerate(MAPPINGS)]
                measures += [(name, whole[i] - whole[i + 1], means[i] - means[i + 1]) for i, name in enumerate(("translation_improvement", "affine_improvement"))]
                bounds = [np.quantile(v, [0.025, 0.975]) for _, _, v in measures]
                columns = [[condition] * 5, [family] * 5, [m[0] for m in measures], [m[1] for m in measures], [b[0] for b in bounds], [b[1] for b in bounds]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["condition", "family", "measure", "value", "ci_low", "ci_high"])

    return rows.mapInArrow(run, f"condition {kinds['condition']}, family string, measure string, value double, ci_low double, ci_high double")


def dispersion_of(sums: np.ndarray, features: float, alpha: float) -> np.ndarray:
    """COMPONENTS of replicates (rows) from sums: n, weighted squares of x, y and e and of x by e, and weighted x, y and e."""
    n = np.maximum(sums[:, 0], 1)
    x, y, e = np.split(sums[:, 5:], 3, axis=1)
    spread = lambda square, a, b: (square / n - (a * b).sum(axis=1) / n**2) / features
    original, rewrite, residual, cross = spread(sums[:, 1], x, x), spread(sums[:, 2], y, y), spread(sums[:, 3], e, e), spread(sums[:, 4], x, e)
    return np.stack([original, rewrite, alpha**2 * original, residual, 2 * alpha * cross], axis=1)


def dispersion_intervals(held: DataFrame, replicates: int, seed: int = 20260922, block: int = BLOCK) -> DataFrame:
    """condition, family, component, value, ci_low, ci_high: how the spread of held-out works' centroids in a condition is made up, meaned over outer folds.

    The matrix of counts (replicates by works) is multiplied into that of centroids (works by features) in blocks of
    replicates; a task multiplies its own works and passes on one array a block. The first replicate is the works
    as they are. Groups whose mapping has no alpha are left out.
    """
    blocks = -(-replicates // block)

    def make(row):
        x, y, e = (np.asarray(row[c]) for c in "xye")
        counts = next(c for _, c in tree_counts(np.full(replicates, row["works"]), row["works"], np.array([row["work_place"] - 1]), seed, "works", row["author"]))
        line = np.concatenate([[1.0, x @ x, y @ y, e @ e, x @ e], x, y, e])
        parts = [((-1,), line)]
        return parts + [((b,), np.outer(counts[b * block : (b + 1) * block], line).ravel()) for b in range(blocks)]

    rows = placed_works(held.where("alpha is not null")).withColumn("features", F.col("features").cast("long"))
    sums = _sums_of(rows, [*GROUP, "features", "alpha"], ["author", "work_place", "works", "x", "y", "e"], make, "block long")
    kinds = dict(held.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width = 5 + 3 * _width(row["sums"], row["block"], replicates, block)
                found = dispersion_of(np.asarray(row["sums"]).reshape(-1, width), row["features"], row["alpha"])
                at = np.arange(len(found)) + (row["block"] * block if row["block"] >= 0 else -1)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([row["outer"]] * n, batch.schema.field("outer").type), pa.array([row["condition"]] * n, pa.string()), pa.array([row["family"]] * n, pa.string()), pa.array(at, pa.int64()), *(pa.array(found[:, k]) for k in range(len(COMPONENTS)))], ["outer", "condition", "family", "replicate", *COMPONENTS])

    each = sums.mapInArrow(run, f"outer {kinds['outer']}, condition {kinds['condition']}, family string, replicate long, " + ", ".join(f"{c} double" for c in COMPONENTS))
    folds = each.groupBy("condition", "family", "replicate").agg(*(F.avg(c).alias(c) for c in COMPONENTS))
    long = folds.select("condition", "family", "replicate", F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("v")) for c in COMPONENTS))).alias("x")).select("condition", "family", "replicate", "x.*")
    drawn: Callable[[float], Column] = lambda q: F.percentile(F.when(F.col("replicate") >= 0, F.col("v")), F.lit(q))
    return long.groupBy("condition", "family", "component").agg(F.max(F.when(F.col("replicate") < 0, F.col("v"))).alias("value"), drawn(0.025).alias("ci_low"), drawn(0.975).alias("ci_high"))


def _width(sums: list, at: int, replicates: int, block: int) -> int:
    """Features in the sums of the block at that place."""
    rows = 1 if at < 0 else min(block, replicates - at * block)
    return (len(sums) // rows - 5) // 3
