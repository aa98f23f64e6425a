"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillmark.llm._store import written


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that stands in an edge (a, b) to another node; component is the least node.

    Each round keeps the components and draws every node nearer to its least one; a round is a few aggregations and
    equi-joins (whose skew Spark splits) over a table no larger than the edges, written to the shared folder. Edges
    with a null end, loops and repeats change nothing; no edges give no rows. Fails after `rounds` rounds.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges, before = _noted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if not before[0]:
            break
        edges, now = _noted(_small(_large(edges)))
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _noted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    seen = Observation()
    out = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("s")))
    return out, (seen.get["n"], seen.get["s"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    rest = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(rest).distinct()
