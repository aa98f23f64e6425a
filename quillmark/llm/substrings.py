"""Substring dedup by suffix subtrees, one for each frequent prefix or share of it, whose deep nodes are the repeats."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm._store import drop, release, table, written
from quillmark.llm._words import SPACE, U64, Words, codes_of, mix, runs, words

#: Words of a window, and of the prefix (its anchor) that names the subtree of a suffix.
WINDOW, SYMBOL = 50, 10
#: Suffixes that one subtree holds, a prefix with more being dealt into several; suffixes of one row at most.
GROUP, PIECE = 20_000, 1_000
_WHOLE = 1 << 62


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    size, span = len(x) - n + 1, 1
    if size <= 0:
        return x[:0]
    while 2 * span <= n:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[:size], x[n - span : n - span + size])


def windows(block: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of all rows of the block, and their anchors.

    A window's anchor is the least hash of SYMBOL words in it, so that equal windows have equal anchors, and neighbours
    mostly the same one.
    """
    anchors = _least(mix(runs(block.hashes, SYMBOL)), WINDOW - SYMBOL + 1)
    inside = np.zeros(len(anchors) + 1, np.int32)
    long = np.diff(block.first) >= WINDOW
    np.add.at(inside, block.first[:-1][long], 1)
    np.add.at(inside, block.first[1:][long] - WINDOW + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]))
    return starts, anchors[starts]


def _digest(data: bytes) -> bytes:
    """128 bits of the words of data."""
    return blake2b(b" ".join(data.split()), digest_size=16).digest()


def anchors_of(texts: DataFrame) -> DataFrame:
    """(doc_id, tag, whole, anchors, counts) of each text of WINDOW words or more: a digest of all its words, its distinct anchors, and how many windows have each.

    Null, empty and shorter texts give no row; repeated rows give one each; no texts give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, whole, own, counts = [], [], [], []
            for block in words(batch.column(2), SPACE, fold=False):
                starts, anchors = windows(block)
                first = np.searchsorted(starts, block.first)
                for row in np.flatnonzero(np.diff(first)).tolist():
                    distinct, n = np.unique(anchors[first[row] : first[row + 1]], return_counts=True)
                    place.append(block.row + row)
                    whole.append(_digest(block.data[block.start[block.first[row]] : block.end[block.first[row + 1] - 1]].tobytes()))
                    own.append(distinct.view(np.int64))
                    counts.append(n)
            if place:
                at = np.cumsum([0, *map(len, own)]).astype(np.int32)
                ids = [batch.column(c).take(pa.array(place)) for c in (0, 1)]
                lists = [pa.ListArray.from_arrays(at, x) for x in (np.concatenate(own), np.concatenate(counts).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(whole, pa.binary()), *lists], ["doc_id", "tag", "whole", "anchors", "counts"])

    return texts.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag binary, whole binary, anchors array<long>, counts array<long>")


def _gathered(run, rows: int):
    """run, with its many small batches put together."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def suffixes_of(texts: DataFrame) -> DataFrame:
    """(anchor, share, shares, doc_id, tag, start, n, words): runs of n neighbouring suffixes from word start on, that start windows with an anchor of the text's list.

    words is the text from the first suffix to the end of the last one's window. Of equal windows of one text the first
    stands for all. texts has doc_id, tag, text and anchors, a list of (anchor, shares); a run belongs to one of its
    anchor's shares. Texts with an empty list, or without windows, give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, lists = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(3)
            for block in words(batch.column(2), SPACE, fold=False):
                data = block.data.tobytes()
                starts, anchors = windows(block)
                first, same = np.searchsorted(starts, block.first), runs(block.hashes, WINDOW)
                for row in np.flatnonzero(np.diff(first)).tolist():
                    own = lists[block.row + row].values
                    listed, shares = own.field("anchor").to_numpy().view(U64), own.field("shares").to_numpy()
                    order = np.argsort(listed)
                    listed, shares = listed[order], shares[order]
                    begin, anchor = (x[first[row] : first[row + 1]] for x in (starts, anchors))
                    at = np.minimum(np.searchsorted(listed, anchor), len(listed) - 1)
                    kept = np.flatnonzero(listed[at] == anchor)
                    kept = kept[np.sort(np.unique(same[begin[kept]], return_index=True)[1])]
                    if not len(kept):
                        continue
                    begin, anchor, at = begin[kept], anchor[kept], at[kept]
                    opens = np.ones(len(kept), bool)
                    opens[1:] = (np.diff(begin) != 1) | (anchor[1:] != anchor[:-1])
                    place = np.arange(len(kept))
                    opens |= (place - np.maximum.accumulate(np.where(opens, place, 0))) % PIECE == 0
                    cuts = np.flatnonzero(opens)
                    n = np.diff(np.concatenate([cuts, [len(kept)]]))
                    begin, anchor, share = begin[cuts], anchor[cuts], shares[at[cuts]]
                    start = begin - block.first[row]
                    mine = mix(mix(np.full(len(cuts), ids[block.row + row]).view(U64)) + start.astype(U64)) % share.astype(U64)
                    text = [data[a:b] for a, b in zip(block.start[begin].tolist(), block.end[begin + n + (WINDOW - 2)].tolist(), strict=True)]
                    columns = (pa.array(anchor.view(np.int64)), pa.array(mine.astype(np.int64)), pa.array(share.astype(np.int64)), pa.array(np.full(len(cuts), ids[block.row + row])), pa.array([tags[block.row + row]] * len(cuts), pa.binary()), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(text, pa.binary()))
                    yield pa.RecordBatch.from_arrays(list(columns), SUFFIX)

    return texts.select("doc_id", "tag", "text", "anchors").mapInArrow(_gathered(run, 2000), "anchor long, share long, shares long, doc_id long, tag binary, start int, n int, words binary")


SUFFIX = ["anchor", "share", "shares", "doc_id", "tag", "start", "n", "words"]


class Subtrees:
    """The suffixes of some rows as sorted leaves, with the words that neighbours share as the depths of the inner nodes; rows of different groups share none."""

    def __init__(self, texts: pa.Array, n: np.ndarray, group: np.ndarray):
        self.block = block = next(words(texts, SPACE, fold=False, block=_WHOLE))
        code, size = codes_of(block), np.diff(block.first)
        self.row = np.repeat(np.arange(len(n)), size)
        #: words from each place to the end of its row
        self.left = block.first[1:][self.row] - np.arange(len(code))
        rank = np.unique(group[self.row] * (len(code) + 1) + code, return_inverse=True)[1] + 1
        #: for spans 1, 2, 4, ...: numbers of the sequences of so many words, in the order of those sequences
        self.ranks, span = [(1, rank)], 1
        while 2 * span <= WINDOW:
            after = np.zeros_like(rank)
            after[:-span] = rank[span:]
            after[self.left <= span] = 0
            rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1] + 1
            span *= 2
            self.ranks.append((span, rank))
        begin = np.repeat(block.first[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.leaf = begin[np.lexsort((rank[begin + WINDOW - span], rank[begin]))]

    def depths(self) -> np.ndarray:
        """The words that each leaf but the first shares with the one before it."""
        a, b = self.leaf[:-1], self.leaf[1:]
        depth, most = np.zeros(len(a), np.int64), np.minimum(self.left[a], self.left[b])
        for span, rank in reversed(self.ranks):
            inside = depth < most
            at = np.where(inside, depth, 0)
            depth += span * (inside & (rank[a + at] == rank[b + at]))
        return np.minimum(depth, most)

    def sources(self, doc: np.ndarray) -> np.ndarray:
        """For each leaf, the least doc (of the rows) below the node of WINDOW words that it stands under."""
        if not len(self.leaf):
            return doc[:0]
        own = doc[self.row[self.leaf]]
        at = np.flatnonzero(np.concatenate([[True], self.depths() < WINDOW]))
        return np.repeat(np.minimum.reduceat(own, at), np.diff(np.concatenate([at, [len(own)]])))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows in tables none of which ends within a group of equal keys, from rows sorted by keys."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        path = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        other = np.flatnonzero((path != path[-1]).any(axis=1))
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and (cut or (last != path[0]).any()):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
        last = path[-1]
    if held:
        yield pa.Table.from_batches(held)


LEAF = ["doc_id", "tag", "start", "n", "window"]


def deep_leaves(suffixes: DataFrame) -> DataFrame:
    """(doc_id, tag, start, n, window): ranges of windows of n neighbouring starts, from the subtree of each anchor's share.

    Where window is null, all those windows also start in a smaller document of the share. Else the range is one window
    that does not, of an anchor with several shares, whose digest is window: another share may have it. Words are
    compared as they are, not by hashes. No suffixes give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ("anchor", "share")):
            part = part.combine_chunks()
            anchor, share, shares, doc, start, n = (part.column(c).to_numpy() for c in ("anchor", "share", "shares", "doc_id", "start", "n"))
            change = (anchor[1:] != anchor[:-1]) | (share[1:] != share[:-1])
            tree = Subtrees(part.column("words").combine_chunks(), n, np.concatenate([[0], np.cumsum(change)]))
            row = tree.row[tree.leaf]
            gone = tree.sources(doc) < doc[row]
            first = tree.block.first
            found = np.sort(tree.leaf[gone])
            at = np.flatnonzero(np.concatenate([[True], (np.diff(found) != 1) | (np.diff(tree.row[found]) != 0)])) if len(found) else found
            rows, place = tree.row[found[at]], found[at]
            size = np.diff(np.concatenate([at, [len(found)]])).astype(np.int32)
            left = np.sort(tree.leaf[~gone & (shares[row] > 1)])
            data = tree.block.data.tobytes() if len(left) else b""
            digests = [_digest(data[a:b]) for a, b in zip(tree.block.start[left].tolist(), tree.block.end[left + WINDOW - 1].tolist(), strict=True)]
            rows, place = np.concatenate([rows, tree.row[left]]), np.concatenate([place, left])
            made = [pa.array(doc[rows]), part.column("tag").take(pa.array(rows)).combine_chunks(), pa.array((start[rows] + place - first[rows]).astype(np.int32)), pa.array(np.concatenate([size, np.ones(len(left), np.int32)]))]
            yield pa.RecordBatch.from_arrays([*made, pa.array([*[None] * len(size), *digests], pa.binary())], LEAF)

    placed = suffixes.repartition("anchor", "share").sortWithinPartitions("anchor", "share")
    return placed.mapInArrow(_gathered(run, 20_000), "doc_id long, tag binary, start int, n int, window binary")


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(doc_id, tag, ranges, copy): windows (start, n) whose words also start in a document of smaller doc_id; copy: the whole text does.

    texts has doc_id, tag and text; (doc_id, tag) names a text. Whole copies are settled by a digest of all words, and
    only the least document of each kind goes into the subtrees.
    """
    spark = texts.sparkSession
    anchors = written(anchors_of(texts))
    whole = anchors.groupBy("whole").agg(F.min("doc_id").alias("source"))
    own = anchors.join(whole, "whole")
    copies = written(own.where("doc_id > source").select("doc_id", "tag").distinct())
    alone = own.where("doc_id = source").dropDuplicates(["doc_id", "tag"]).select("doc_id", "tag", F.explode(F.arrays_zip("anchors", "counts")).alias("x")).select("doc_id", "tag", F.col("x.anchors").alias("anchor"), F.col("x.counts").alias("n"))
    shared = alone.groupBy("anchor").agg(F.count("*").alias("docs"), F.ceil(F.sum("n") / GROUP).alias("shares")).where("docs > 1")
    lists = written(alone.join(shared, "anchor").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "shares")).alias("anchors")))
    drop(anchors)
    release(spark)
    listed = texts.join(lists, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"])
    leaves = written(deep_leaves(suffixes_of(listed)))
    drop(lists)
    release(spark)
    open_ = leaves.where("window is not null")
    least = open_.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    ranges = leaves.where("window is null").drop("window").unionByName(open_.join(least, "window").where("doc_id > least").select("doc_id", "tag", "start", "n"))
    found = written(ranges.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("ranges")))
    drop(leaves)
    release(spark)
    none = F.array().cast("array<struct<start:int,n:int>>")
    return found.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "tag", none.alias("ranges"), F.lit(True).alias("copy")))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row of docs.

    A word goes if WINDOW consecutive words that hold it also start in a document of smaller doc_id; all windows are
    judged on the input. Null and empty texts have no words. Rows without doc_id neither lose nor lend windows; rows of
    equal doc_id, with equal texts or not, lend each other none, and each loses what its own text shares with smaller
    documents. No rows give none. Other columns are ignored.
    """
    texts = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("tag"))
    found = repeated_windows(texts.where("doc_id is not null and text is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, copies, rows = batch.column(2), batch.column(3).to_pylist(), []
            for block in words(batch.column(1), SPACE, fold=False):
                data = block.data.tobytes()
                for row in range(len(block.first) - 1):
                    lo, hi = int(block.first[row]), int(block.first[row + 1])
                    n, ranges = hi - lo, lists[block.row + row]
                    if copies[block.row + row]:
                        rows.append((n, n, b""))
                        continue
                    text = data[block.start[lo] : block.end[hi - 1]] if n else b""
                    if not ranges.is_valid:
                        rows.append((n, 0, b" ".join(text.split())))
                        continue
                    gone = _covered(block.hashes[lo:hi], *(ranges.values.field(c).to_numpy() for c in ("start", "n")))
                    left = np.flatnonzero(~gone) + lo
                    rows.append((n, int(gone.sum()), b" ".join(data[a:b] for a, b in zip(block.start[left].tolist(), block.end[left].tolist(), strict=True))))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), made[0], made[1], made[2].cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = texts.join(found, ["doc_id", "tag"], "left").select("doc_id", "text", "ranges", "copy")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def _marked(size: int, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each of size places lies in one of the ranges."""
    at = np.zeros(size + 1, np.int64)
    np.add.at(at, start, 1)
    np.add.at(at, start + n, -1)
    return np.cumsum(at[:-1]) > 0


def _covered(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The words under the windows of the ranges and under those of the text that equal one of them."""
    same = runs(h, WINDOW)
    found = np.flatnonzero(np.isin(same, same[_marked(len(same), start, n)]))
    return _marked(len(h), found, np.full(len(found), WINDOW))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document, by dedup_substrings."""
    done = dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
