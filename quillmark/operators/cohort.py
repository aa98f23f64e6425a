"""Passages, folds, conditions, alignment, coverage, selection and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.ranks import positions
from quillmark.sources.io import settled


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The rows with a text, of equal texts the one of least doc_id; texts meet by digest, not by content."""
    keyed = docs.where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = keyed.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return docs.join(first, "doc_id", "left_semi")


def folds_by_work(works: DataFrame, author: str, work: str, k: int = 3, seed: str = "20260922") -> DataFrame:
    """works with fold: the rank of a work among its author's by a seeded hash, modulo k."""
    order = F.row_number().over(Window.partitionBy(author).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), work), 256)))
    return works.withColumn("fold", (order - 1) % k)


def hash_ranked(df: DataFrame, cell: list[str], key: Column, most: int | None = None, seed: str = "20260922") -> DataFrame:
    """df with rank: its place by a seeded hash of key within its cell (of all rows if cell is empty), at most `most`.

    Tasks keep `most` rows of a cell before any is dealt; without a limit, places are counted over ranges.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    if most is None or not cell:
        ranked = positions(df.withColumn("__hash", order), ["__hash"], cell, "rank").drop("__hash")
    else:
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy(order)))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def _placed(df: DataFrame, cell: list[str], order: list[str]) -> DataFrame:
    """df with at, its place from 0 in its cell, and rows, how many the cell has; null cells are a cell."""
    placed = settled(positions(df, order, cell, "at"))
    counts = placed.groupBy(*cell).agg(F.max("at").alias("rows")).select(*(F.col(c).alias(f"__{c}") for c in cell), "rows")
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__{c}")), cell, F.lit(True))
    return placed.join(counts, same).drop(*(f"__{c}" for c in cell)).withColumn("at", (F.col("at") - 1).cast("int"))


def evenly_spread(df: DataFrame, cell: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each cell, at the places round(i * (rows - 1) / (n - 1)), halves to even; all of a smaller cell."""
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("rows") - 1) / (n - 1), 0).cast("int"))
    return _placed(df, cell, order).where((F.col("rows") <= n) | F.array_contains(wanted, F.col("at"))).drop("rows")


def midpoint_spread(df: DataFrame, cell: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each cell of n or more, at the places floor((i + 1/2) * rows / n)."""
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor((i + 0.5) * F.col("rows") / n).cast("int"))
    return _placed(df, cell, order).where(F.col("rows") >= n).where(F.array_contains(wanted, F.col("at"))).drop("rows")


def split_in_order(df: DataFrame, cell: list[str], order: list[str], train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """df with split: the first share of each cell is train, the next validation, the rest test."""
    at, n = F.col("at") + 1, F.col("rows")
    split = F.when(at <= F.floor(n * train), "train").when(at <= F.floor(n * (train + validation)), "validation").otherwise("test")
    return _placed(df, cell, order).withColumn("split", split).drop("at", "rows")


def aligned(originals: DataFrame, rewrites: DataFrame, conditions: list[str], key: str = "doc_id", status: str = "qc_status") -> DataFrame:
    """originals whose every condition has a rewrite that did not fail: one failure takes a passage out of all conditions."""
    ok = rewrites.groupBy(key).agg(F.count_if(F.col(status) != "fail").alias("ok"), F.count("*").alias("n"))
    return originals.join(ok.where((F.col("ok") == len(conditions)) & (F.col("n") == len(conditions))), key, "left_semi")


def coverage(originals: DataFrame, rewrites: DataFrame, conditions: list[str], cell: list[str], key: str = "doc_id") -> DataFrame:
    """cell, condition, expected, accounted, pass, warning, failed: cells without any rewrite stay, with zeros."""
    spec = originals.sparkSession.createDataFrame([(c,) for c in conditions], "condition string")
    scaffold = originals.groupBy(*cell).agg(F.count("*").alias("expected")).crossJoin(F.broadcast(spec))
    placed = rewrites.join(originals.select(key, *cell), key)
    count = lambda s: F.count_if(F.col("qc_status") == s)
    counts = placed.groupBy(*cell, "condition").agg(F.count("*").alias("accounted"), count("pass").alias("pass"), count("warning").alias("warning"), count("fail").alias("failed"))
    return scaffold.join(counts, [*cell, "condition"], "left").fillna(0, ["accounted", "pass", "warning", "failed"])


def panel_coverage(passages: DataFrame, panels: DataFrame, author: str, work: str, size: str) -> DataFrame:
    """Of each panel (panel, minimum): eligible passages, missing works, and whether it can be estimated at all."""
    works = passages.select(author, work).distinct()
    eligible = passages.crossJoin(F.broadcast(panels)).where(F.col(size) >= F.col("minimum"))
    counts = eligible.groupBy("panel", author, work).agg(F.count("*").alias("n"))
    cells = panels.crossJoin(works).join(counts, ["panel", author, work], "left").fillna(0, ["n"])
    missing = F.count_if(F.col("n") == 0)
    return cells.groupBy("panel", "minimum").agg(F.sum("n").alias("eligible"), missing.alias("missing_works"), F.when(missing == 0, "estimable").otherwise("not_estimable").alias("status"))


def crossing_groups(folds: DataFrame, group: list[str]) -> DataFrame:
    """Groups that stand on both sides of some fold: must have no rows."""
    return folds.groupBy(*group).agg(F.countDistinct("fold").alias("folds")).where("folds > 1")


def overlapping(spans: DataFrame, by: list[str], key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Neighbours in start order, within by, where a span begins before an earlier one has ended."""
    w = Window.partitionBy(*by).orderBy(start, end, key)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("reached", before).where(F.col(start) < F.col("reached"))


def contained(points: DataFrame, spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """points (at) with the first span (by start) of the same group that holds them: an equi-join with a range filter.

    Points are numbered first, so that equal points stay apart.
    """
    numbered = settled(points.withColumn("__point", F.monotonically_increasing_id()))
    joined = numbered.join(spans, by).where((F.col("at") >= F.col(start)) & (F.col("at") < F.col(end)))
    rest = [c for c in spans.columns if c not in by]
    first = joined.groupBy("__point").agg(F.min(F.struct(F.col(start).alias("__s"), F.col(end).alias("__e"), *(F.col(c) for c in rest))).alias("__first"))
    return numbered.join(first, "__point").select(*points.columns, *(F.col(f"__first.{c}").alias(c) for c in rest))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys only in a, keys only in b."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    only = lambda x, y, name: x.exceptAll(y).agg(F.count("*").alias(name))
    return only(left, right, "only_left").crossJoin(only(right, left, "only_right"))
