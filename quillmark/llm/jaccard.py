"""N-gram Jaccard join: tiles of near sizes, whose bitmaps bound the overlap before sorted arrays are intersected."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm._graph import connected_components
from quillmark.llm._store import release, table, written
from quillmark.llm._words import SPACE, U64, mix, runs, words

#: Words of a shingle; percent of the union that the intersection of linked sets makes up at least.
SHINGLE, PERCENT = 5, 75
#: Least bits of a signature; a larger set has as many as the power of two that is not below its size.
BITS = 1024
#: Counters of the sketch of shingle frequencies (a broadcast of 8 bytes each, whatever the input).
CELLS = 1 << 20
#: Sets of a bucket that meet in one tile at most; sets, and shingles, of a component that one block of tiles holds.
TILE, BLOCK_SETS, BLOCK_SHINGLES = 2048, 512, 1_000_000


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted hashes of the distinct shingles of each row: the whole sequence if it is shorter, none without words."""
    for block in words(column, SPACE):
        shingles = runs(block.hashes, SHINGLE)
        for lo, hi in zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True):
            if hi - lo >= SHINGLE:
                yield np.unique(shingles[lo : hi - SHINGLE + 1])
            else:
                yield runs(block.hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, U64)


def least_overlap(a: int, b: int) -> int:
    """The least intersection of linked sets of these sizes: PERCENT / (100 + PERCENT) of their sum, rounded up."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_size(n: int) -> int:
    """So many shingles of a set, the first in any order that all sets share, meet every linked set's."""
    return n - -(-PERCENT * n // 100) + 1


def signature(x: np.ndarray) -> bytes:
    """Bit b tells whether an odd number of shingles fall on b; sets differ in as many shingles as bits at least."""
    bits = max(BITS, 1 << (len(x) - 1).bit_length())
    odd = np.bincount((mix(x) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Signatures:
    """The signatures of sets sorted by size, in a matrix for each width, with those of twice the width folded to it."""

    def __init__(self, size: np.ndarray, signatures: list[bytes]):
        self.size, self.width = size, np.array([len(x) for x in signatures])
        self.stop = np.searchsorted(size, size * 100 // PERCENT, "right")
        self.rows: dict[int, tuple[int, np.ndarray]] = {}
        for width in np.unique(self.width).tolist():
            lo, mid, hi = (int(np.searchsorted(self.width, w, side)) for w, side in ((width, "left"), (width, "right"), (2 * width, "right")))
            own = np.frombuffer(b"".join(signatures[lo:mid]), U64).reshape(mid - lo, -1)
            wide = np.frombuffer(b"".join(signatures[mid:hi]), U64).reshape(hi - mid, 2, own.shape[1])
            self.rows[width] = lo, np.concatenate([own, wide[:, 0] ^ wide[:, 1]])

    def near(self, i: int) -> np.ndarray:
        """The sets after i that can be linked with it: their sizes and the differing bits bound the overlap from above."""
        lo, rows = self.rows[int(self.width[i])]
        stop = int(self.stop[i])
        differ = np.bitwise_count(rows[i + 1 - lo : stop - lo] ^ rows[i - lo]).sum(axis=1, dtype=np.int64)
        both = self.size[i] + self.size[i + 1 : stop]
        return np.flatnonzero((both - differ) * (100 + PERCENT) >= 2 * PERCENT * both) + i + 1


def key_of(x: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a sorted set, as two integers."""
    digest = blake2b(x.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, check, bits) of every row, and rows with part and cells instead: a piece of the sketch of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        held: list[np.ndarray] = []

        def add() -> None:
            cells[:] += np.bincount((np.concatenate(held) & U64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            held.clear()

        for batch in batches:
            sizes, keys, checks, bits, total = [], [], [], [], 0
            for x in shingle_sets(batch.column(1)):
                held.append(x)
                total += len(x)
                sizes.append(len(x))
                key, check = key_of(x) if len(x) else (None, None)
                keys.append(key)
                checks.append(check)
                bits.append(signature(x) if len(x) else None)
            if total:
                add()
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], PROFILE)
        parts = cells.reshape(64, -1)
        rows = [k for k in range(64) if parts[k].any()]
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(rows, pa.int32()), pa.array([parts[k].astype(np.uint32).tobytes() for k in rows], pa.binary())], PROFILE)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key long, check long, bits binary, part int, cells binary")


PROFILE = ["doc_id", "n", "key", "check", "bits", "part", "cells"]


def _sketch(profiles: DataFrame) -> np.ndarray:
    """How many sets have a shingle in each cell, added up part by part on the executors."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in group.column("cells").to_pylist())
        return pa.table([group.column("part").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["part", "cells"])

    out = np.zeros((64, CELLS // 64), np.int64)
    for row in profiles.where("part is not null").select("part", "cells").groupBy("part").applyInArrow(add, "part int, cells binary").collect():
        out[row.part] = np.frombuffer(row.cells, np.int64)
    return out.ravel()


def _prefixes(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(shingle, key): the prefix of every set, its rarest shingles by the sketch; equal sets count once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = shared.value, set()
        for batch in batches:
            found, keys, sizes = [np.zeros(0, U64)], [], []
            for x in shingle_sets(batch.column(0)):
                if len(x) and (key := key_of(x)) not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(key)
                    order = np.argsort(cells[(x & U64(CELLS - 1)).astype(np.int64)], kind="stable")
                    found.append(x[order[: prefix_size(len(x))]])
                    keys.append(key[0])
                    sizes.append(len(found[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), sizes))], ["shingle", "key"])

    return docs.select("text").mapInArrow(run, "shingle long, key long")


def _buckets(prefixes: DataFrame) -> DataFrame:
    """(bucket, n, keys): the sets that share a shingle of their prefixes, where there are two; equal lists once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()

        def lists(rows: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            rows = rows[new]
            at = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) if len(rows) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([at, [len(rows)]]))
            many = size > 1
            kept, n = np.repeat(many, size), size[many]
            keys = rows[kept, 1]
            begin = np.concatenate([[0], np.cumsum(n)])
            sums = np.add.reduceat(mix(keys.view(U64)), begin[:-1]).view(np.int64) if len(n) else np.zeros(0, np.int64)
            fresh = [i for i, x in enumerate(zip(sums.tolist(), n.tolist(), strict=True)) if x not in seen and not seen.add(x)]
            taken = np.zeros(len(n), bool)
            taken[fresh] = True
            sizes = n[taken]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(sums[taken]), pa.array(sizes), pa.ListArray.from_arrays(offsets, keys[np.repeat(taken, n)])], ["bucket", "n", "keys"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            if len(seen) > 1_000_000:
                seen.clear()
            if held and held[0][0, 0] != rows[0, 0]:
                yield lists(np.concatenate(held))
                held = []
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if cut:
                yield lists(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield lists(np.concatenate(held))

    placed = prefixes.repartition("shingle").sortWithinPartitions("shingle", "key")
    found = placed.mapInArrow(run, "bucket long, n long, keys array<long>")
    return found.groupBy("bucket", "n").agg(F.first("keys").alias("keys"))


def _tiles(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, band, tile, rep, size, bits): the sets of each bucket; large buckets by bands of near sizes, then by pairs of blocks.

    A set of a large bucket stands in its own band, where it meets larger sets, and in the one below, where it meets
    smaller ones; bands are a factor 100 / PERCENT wide, so that linked sets are at most one apart.
    """
    rows = buckets.select("bucket", "n", F.explode("keys").alias("key")).join(classes.select("key", "rep", "size", "bits"), "key")
    band = F.floor(F.log("size") / F.log(F.lit(100 / PERCENT))).cast("int")
    rows = rows.withColumn("own", F.when(F.col("n") > 64, band).otherwise(0))
    rows = rows.withColumn("band", F.explode(F.when(F.col("n") > 64, F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array(F.lit(0)))))
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.least(o, mine) * blocks + F.greatest(o, mine))
    return rows.withColumn("tile", F.explode(F.when(blocks > 1, pair).otherwise(F.array(F.lit(0)))))


def _by_run(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of equal keys together, from rows sorted by keys."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        path = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        at = [0, *(np.flatnonzero((path[1:] != path[:-1]).any(axis=1)) + 1).tolist(), len(path)]
        whole = pa.Table.from_batches([batch])
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if held and lo == 0 and any(held[0].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys):
                yield pa.concat_tables(held)
                held = []
            elif lo:
                yield pa.concat_tables(held)
                held = []
            held.append(whole.slice(lo, hi - lo))
    if held:
        yield pa.concat_tables(held)


def forest(n: int, links: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Of links (i, partners) of n nodes, so many as join what they join."""
    label, out = np.arange(n), []
    for i, partners in links:
        for j in partners[label[partners] != label[i]].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _candidates(tiles: DataFrame) -> DataFrame:
    """(a, b) that join all sets whose sizes and bitmaps leave a link open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for tile in _by_run(batches, ("bucket", "band", "tile")):
            if tile.num_rows < 2:
                continue
            rep, size, own, band = (tile.column(c).to_numpy() for c in ("rep", "size", "own", "band"))
            signatures = Signatures(size, tile.column("bits").to_pylist())
            links = ((i, signatures.near(i)) for i in range(len(rep) - 1) if own[i] == band[i])
            for i, j in forest(len(rep), links):
                a.append(rep[i])
                b.append(rep[j])
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    placed = tiles.select("bucket", "band", "tile", "rep", "size", "own", "bits").repartition("bucket", "band", "tile").sortWithinPartitions("bucket", "band", "tile", "size", "rep")
    return placed.mapInArrow(run, "a long, b long").distinct()


def _exact(sets: DataFrame) -> DataFrame:
    """(a, b, links): edges that join all linked sets of each tile, and rows without b: a set's links to documents of the other sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], []
        for tile in _by_run(batches, ("group", "tile")):
            rep = tile.column("rep").to_numpy()
            tile = tile.filter(pa.array(np.concatenate([[True], rep[1:] != rep[:-1]])))  # rows of equal doc_id
            if tile.num_rows < 2:
                continue
            rep, size, members, block = (tile.column(c).to_numpy() for c in ("rep", "size", "members", "block"))
            values = [np.frombuffer(x, U64) for x in tile.column("shingles").to_pylist()]
            cross = len(np.unique(block)) > 1
            same_tile = tile.column("diagonal")[0].as_py()
            linked: dict[int, np.ndarray] = {}
            for i, partners in links_of(size, values):
                partners = partners if same_tile else partners[block[partners] != block[i]]
                if len(partners) and (same_tile or cross):
                    linked[i] = partners
            total = np.zeros(len(rep), np.int64)
            for i, partners in linked.items():
                total[i] += members[partners].sum()
                total[partners] += members[i]
            pairs = forest(len(rep), iter(linked.items()))
            counted = np.flatnonzero(total)
            a += [*rep[[i for i, _ in pairs]].tolist(), *rep[counted].tolist()] if pairs else []
            b += [*rep[[j for _, j in pairs]].tolist(), *[None] * len(counted)] if pairs else []
            n += [*[None] * len(pairs), *total[counted].tolist()] if pairs else []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "links"])

    placed = sets.repartition("group", "tile").sortWithinPartitions("group", "tile", "size", "rep")
    return placed.mapInArrow(run, "a long, b long, links long")


def links_of(size: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the later sets linked with it) of sets sorted by size: bitmaps first, then exact intersections."""
    signatures = Signatures(size, [signature(x) for x in values])
    begin = np.concatenate([[0], np.cumsum(size)])
    codes = None
    for i in range(len(values) - 1):
        open_ = signatures.near(i)
        if not len(open_):
            continue
        if len(open_) <= 4:
            both = np.array([len(np.intersect1d(values[i], values[j], assume_unique=True)) for j in open_.tolist()])
        else:
            if codes is None:
                _, codes = np.unique(np.concatenate(values), return_inverse=True)
                mark = np.zeros(int(codes.max()) + 1, bool)
            lo, hi = int(open_[0]), int(open_[-1])
            mark[codes[begin[i] : begin[i + 1]]] = True
            both = np.add.reduceat(mark[codes[begin[lo] : begin[hi + 1]]].astype(np.int64), begin[lo : hi + 1] - begin[lo])[open_ - lo]
            mark[codes[begin[i] : begin[i + 1]]] = False
        yield i, open_[100 * both >= PERCENT * (size[i] + size[open_] - both)]


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (documents linked with it) of every row of docs.

    Documents link when 100 * intersection >= PERCENT * union of their sets of shingles; component_id is the least
    doc_id that links reach. Equal sets become one class first. Classes that share a shingle of their prefixes meet in
    tiles, where sizes and bitmaps leave some links open; the components of those are dealt into tiles again, now with
    the sets themselves, and every pair of a tile that is still open is intersected. No link is lost. Null and empty
    texts have no shingles, their own component and no links; so has a row without doc_id (whose component_id is null).
    Rows of equal doc_id are one node, which links as all their texts do, and count as one document in n_links. Sets are
    told apart by 128-bit digests, shingles by 64-bit hashes. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    profiles = written(_profiles(texts))
    sketch = _sketch(profiles)
    rows = profiles.where("part is null").select("doc_id", "n", "key", "check")
    classes = profiles.where("key is not null and doc_id is not null").groupBy("key", "check").agg(F.min("doc_id").alias("rep"), F.first("n").alias("size"), F.countDistinct("doc_id").alias("members"), F.first("bits").alias("bits"))
    classes = written(classes)
    buckets = written(_buckets(_prefixes(texts.where("doc_id is not null"), sketch)))
    release(spark)
    tiles = _tiles(buckets, classes)
    groups = connected_components(_candidates(tiles)).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    found = groups.join(classes.select("key", "check", "rep", "size", "members"), "rep")
    total = found.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    found = found.join(total, "group").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0)))
            kept = pa.array([key_of(x) == k for x, k in zip(sets, zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array([x.tobytes() for x in sets], pa.binary())], [*batch.schema.names[3:], "shingles"])
            yield out.filter(kept)

    chosen = texts.join(found.withColumnRenamed("rep", "doc_id"), "doc_id").select("text", "key", "check", F.col("doc_id").alias("rep"), "size", "members", "group", "block", "blocks")
    sets = chosen.mapInArrow(make, "rep long, size long, members long, group long, block int, blocks int, shingles binary")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, "block") * F.col("blocks") + F.greatest(o, "block"))
    dealt = sets.withColumn("tile", F.explode(F.when(F.col("blocks") > 1, pair).otherwise(F.array(F.lit(0)))))
    dealt = dealt.withColumn("diagonal", F.floor(F.col("tile") / F.col("blocks")) == F.col("tile") % F.col("blocks"))
    exact = written(_exact(dealt.select("group", "tile", "diagonal", "rep", "size", "members", "block", "shingles")))
    release(spark)
    parts = connected_components(exact.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), F.col("component"))
    links = exact.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    judged = classes.select("key", "check", "rep", "members").join(parts, "rep", "left").join(links, "rep", "left")
    judged = judged.select("key", "check", F.coalesce("component", "rep").alias("part"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("others"))
    out = rows.join(judged, ["key", "check"], "left")
    known = F.col("part").isNotNull() & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.col("part")).otherwise(F.col("doc_id")).alias("component_id"), F.when(known, F.col("others")).otherwise(0).alias("n_links"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the least of its component, or null."""
    kept = similar_documents(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every document, by similar_documents."""
    return similar_documents(table(spark, sf_dir, "documents"))
