"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm._graph import connected_components
from quillmark.llm._store import table, written

#: Vectors link from this cosine on.
COSINE = 0.98
#: The probability with which a pair at just this cosine may share no bucket in any table; nearer pairs are missed less.
MISS = 1e-4
#: Vectors compared at once; a larger bucket is cut into tiles, each of which meets each other.
TILE = 2048
SEED = 20


class Shape(NamedTuple):
    """tables of keys of so many bits."""

    tables: int
    bits: int


def shape_for(n: int, cosine: float = COSINE, miss: float = MISS) -> Shape:
    """As many bits as tell n vectors apart, and as many tables as let a pair at the cosine be missed with the probability miss at any n."""
    bits = max(1, min(62, math.ceil(math.log2(max(2, n)))))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return Shape(max(1, math.ceil(math.log(miss) / math.log1p(-together))), bits)


@cache
def _planes(size: int, shape: Shape) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, shape.tables * shape.bits))


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _sketches(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    powers = np.left_shift(np.int64(1), np.arange(shape.bits, dtype=np.int64))
    for batch in batches:
        ids, vectors, labels = batch.columns
        size = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
        flat = np.asarray(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
        at = np.concatenate([[0], np.cumsum(size)])
        tags = np.asarray(labels.cast(pa.int64()).fill_null(0))
        good = np.asarray(ids.is_valid()) & np.asarray(labels.is_valid()) & (size > 0)
        nodes, keys = np.full(len(size), None, object), np.full(len(size), None, object)
        for n in np.unique(size[good]):
            own = np.flatnonzero(good & (size == n))
            rows = flat[at[own][:, None] + np.arange(n)]
            fine = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
            own, rows = own[fine], rows[fine]
            if len(own):
                signs = (_units(rows) @ _planes(int(n), shape) > 0).reshape(len(own), shape.tables, shape.bits)
                made = signs @ powers
                for k, i in enumerate(own):
                    nodes[i] = blake2b(rows[k].tobytes(), digest_size=16, salt=int(tags[i]).to_bytes(8, "little", signed=True)).digest()
                    keys[i] = made[k]
        made = [ids, pa.array(nodes, pa.binary()), labels.cast(pa.int64()), pa.array(size, pa.int64()), vectors, pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(made, ["vec_id", "node", "label", "size", "embedding", "keys"])


def _parts(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys (long columns without nulls); only the last run of a batch waits for the next."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        here = np.stack([np.asarray(batch.column(k)) for k in keys], axis=1)
        starts = [0, *(np.flatnonzero((here[1:] != here[:-1]).any(axis=1)) + 1), len(here)]
        if rest and (np.array([rest[0].column(k)[0].as_py() for k in keys]) != here[0]).any():
            yield pa.Table.from_batches(rest)
            rest = []
        for a, b in zip(starts, starts[1:]):
            if a:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(a, b - a))
    if rest:
        yield pa.Table.from_batches(rest)


BUCKET = ["label", "size", "at", "key", "a", "b"]


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, row) that join what the symmetric matrix joins, one less than there are rows in each component."""
    left, out = linked.any(axis=1), []
    while left.any():
        root = int(left.argmax())
        seen = np.zeros(len(left), bool)
        seen[root] = True
        front = seen
        while front.any():
            front = linked[front].any(axis=0) & ~seen
            seen |= front
        out += [(int(i), root) for i in np.flatnonzero(seen) if i != root]
        left &= ~seen
    return out


def _verified(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """For each tile: (node, null, links) for those with links, and (node, other, null), a forest over the linked."""
    for rows in _parts(batches, BUCKET):
        at, a, b = (rows[k][0].as_py() for k in ("at", "a", "b"))
        part, copies = np.asarray(rows["part"]), np.asarray(rows["copies"])
        units = _units(np.asarray(rows["embedding"].combine_chunks().flatten().cast(pa.float64())).reshape(len(part), -1))
        keys = np.asarray(rows["keys"].combine_chunks().flatten()).reshape(len(part), -1)
        left, right = np.flatnonzero(part == a), np.flatnonzero(part == b)
        linked = units[left] @ units[right].T >= cosine
        if a == b:
            np.fill_diagonal(linked, False)
            linked |= linked.T
        for k in range(at if linked.any() else 0):  # a pair belongs to the first table in which it meets
            linked &= keys[left, k][:, None] != keys[right, k][None, :]
        if not linked.any():
            continue
        whole = np.zeros((len(part), len(part)), bool)
        whole[np.ix_(left, right)] = linked
        whole |= whole.T
        links = whole @ copies
        found, forest = np.flatnonzero(links), _forest(whole)
        nodes = rows["node"].combine_chunks()
        made = [
            pa.concat_arrays([nodes.take(found), nodes.take([i for i, _ in forest])]) if forest else nodes.take(found),
            pa.concat_arrays([pa.nulls(len(found), pa.binary()), nodes.take([j for _, j in forest]).cast(pa.binary())]),
            pa.array([*links[found].tolist(), *[None] * len(forest)], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays([made[0].cast(pa.binary()), *made[1:]], ["node", "other", "links"])


def near_vectors(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row (vec_id, embedding, label), copies of rows included.

    Vectors are compared if labels and sizes are equal: those that share a key of hyperplane signs in one table at least,
    by the cosine of their doubles. n_links counts linked other vectors, component_id is the least vec_id that links
    reach, kept says that this is the row's own. Pairs below the cosine never link; a pair above is missed with a
    probability of miss at most. No links have: rows without vec_id (no component, kept), label or vector, and vectors
    that are empty, zero, or hold a null or a component that is not finite. Copies of a vector (told by a 128-bit digest)
    are compared as one; equal rows count once, rows of equal vec_id and unequal vectors as vectors of their own that
    share the name. A bucket of any size is compared in tiles dealt over tasks. Other columns are left out; no rows give
    no rows.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    shape = shape_for(rows.count(), cosine, miss)
    kind = rows.schema["embedding"].dataType.simpleString()
    sketched = written(rows.mapInArrow(lambda x: _sketches(x, shape), f"vec_id long, node binary, label long, size long, embedding {kind}, keys array<long>"))
    named = sketched.where("node is not null").select("vec_id", "node")
    groups = named.distinct().groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    one = sketched.where("node is not null").groupBy("node").agg(*(F.any_value(c).alias(c) for c in ("label", "size", "embedding", "keys")))
    classes = written(one.join(groups, "node"))

    placed = classes.select("node", "label", "size", F.posexplode("keys").alias("at", "key"))
    where = ["label", "size", "at", "key"]
    shared = placed.groupBy(*where).agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / TILE).cast("int")
    met = placed.join(shared, where).withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("long"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    tiles = met.select("node", F.col("at").cast("long").alias("at"), "key", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    tiles = tiles.join(classes.select("node", "label", "size", "copies", "embedding", "keys"), "node")
    found = written(tiles.repartition(*BUCKET).sortWithinPartitions(*BUCKET).mapInArrow(lambda x: _verified(x, cosine), "node binary, other binary, links long"))

    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    members = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "member")
    named_members = members.join(classes.select(F.col("node").alias("member"), "first"), "member")
    least = named_members.groupBy("component").agg(F.min("first").alias("least"))
    reached = members.join(least, "component").select(F.col("member").alias("node"), "least")
    told = classes.select("node", "first", "copies").join(links, "node", "left").join(reached, "node", "left")
    told = told.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    linked = named.join(told, "node").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = sketched.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def keep_one_of_each(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """The rows of vectors, all columns, without those whose component has a lesser vec_id, as near_vectors finds them; rows without vec_id stay."""
    gone = near_vectors(vectors, cosine, miss).where("not kept").select(F.col("vec_id").alias("__gone")).distinct()
    return vectors.join(gone, vectors["vec_id"] == gone["__gone"], "left_anti")


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of embeddings, by near_vectors."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH RECURSIVE fine AS (
  SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, b) AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM embeddings LEFT JOIN counts c ON c.a = vec_id LEFT JOIN least l ON l.a = vec_id
"""
