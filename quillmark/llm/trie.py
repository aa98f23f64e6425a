"""Conversation prefix trie: a Cartesian tree over the common prefixes of sorted conversations."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm._store import partitions, table, written
from quillmark.operators.ranks import positions

#: Bytes of a turn's digest, and turns in one row: a longer conversation is cut, and each further row begins with a digest of all before.
CODE, SEGMENT = 16, 256


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0), code, chars and total of the turns of every rebuilt conversation; one without turns has a row whose at is null.

    conv_id c has the first h turns of c - c % 100 and its own turns after its first h, h = crc32(c) % 6. Turns are
    ordered by turn, nulls first, and then by digest; null role or text is empty; code is a 128-bit digest of both. Rows
    without conv_id are left out, repeated rows are turns of their own.
    """
    said = F.concat(F.length(F.coalesce("role", F.lit(""))).cast("string"), F.lit(":"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", F.substring(F.sha2(said, 256), 1, 2 * CODE).alias("code"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    turns = written(positions(turns, ["turn", "code"], ["conv_id"], "place"))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    base = F.col("conv_id") - F.col("conv_id") % 100
    bases = sizes.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("of_base"))
    convs = sizes.select("conv_id", base.alias("base"), h.alias("h"), "n").join(bases, "base", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("of_base", F.lit(0)))).withColumn("total", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv_id", "base", "h", "head", "total"))
    first = turns.where("place <= 5 and conv_id % 100 = 0").select(F.col("conv_id").alias("base"), "place", "code", "chars")
    heads = convs.join(first, "base").where("place <= h").select("conv_id", (F.col("place") - 1).alias("at"), "code", "chars", "total")
    own = turns.join(convs, "conv_id").where("place > h").select("conv_id", (F.col("head") + F.col("place") - F.col("h") - 1).alias("at"), "code", "chars", "total")
    none = convs.where("total = 0").select("conv_id", F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("code"), F.lit(0).cast("long").alias("chars"), "total")
    return heads.unionByName(own).unionByName(none)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id and segment: before each segment's codes goes the digest of the row before it."""
    conv, last = None, b""
    for batch in batches:
        keys = []
        for own, k, codes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "codes")), strict=True):
            past = sha256(last).digest()[:CODE] if own == conv and k else bytes(CODE)
            conv, last = own, past + codes
            keys.append(last)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "codes"), pa.array(keys, pa.binary())], [*(c for c in batch.schema.names if c != "codes"), "key"])


def _segments(turns: DataFrame, size: int) -> DataFrame:
    """conv_id, segment, key, chars (of its turns), ends (whether this is the last) and rest (chars of this and all later segments)."""
    rows = turns.withColumn("segment", F.floor(F.coalesce("at", F.lit(0)) / size))
    each = F.filter(F.array_sort(F.collect_list(F.struct("at", "code", "chars"))), lambda x: x.at.isNotNull())
    made = rows.groupBy("conv_id", "segment").agg(each.alias("each"), F.any_value("total").alias("total"))
    made = made.select("conv_id", "segment", F.unhex(F.array_join(F.transform("each", lambda x: x.code), "")).alias("codes"), F.transform("each", lambda x: x.chars).alias("chars"), ((F.col("segment") + 1) * size >= F.col("total")).alias("ends"))
    made = written(made.withColumn("rest", F.aggregate("chars", F.lit(0).cast("long"), lambda a, b: a + b)))
    short = made.where("ends and segment = 0").select("conv_id", "segment", "chars", "ends", "rest", F.concat(F.lit(bytes(CODE)), "codes").alias("key"))
    long = made.where("not (ends and segment = 0)").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    long = long.mapInArrow(_chained, "conv_id long, segment long, chars array<long>, ends boolean, rest long, key binary")
    later = Window.partitionBy("conv_id").orderBy(F.desc("segment"))
    return short.unionByName(long.withColumn("rest", F.sum("rest").over(later)))


def _common(a: bytes, b: bytes) -> int:
    """How many codes from the first on are the same in both."""
    size = min(len(a), len(b)) // CODE
    if a[: size * CODE] == b[: size * CODE]:
        return size
    x, y = (np.frombuffer(v, np.uint8, size * CODE).reshape(size, CODE) for v in (a, b))
    return int((x != y).any(axis=1).argmax())


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with block, place, lcp (codes shared with the row before) and next (with the row after); -1 at the block's edges."""
    from pyspark import TaskContext

    block, place, last, waiting = TaskContext.get().partitionId(), 0, None, None
    names = ["block", "place", "lcp", "next"]

    def ready(row: pa.RecordBatch, lcps: list[int], at: int, after: int) -> pa.RecordBatch:
        n = row.num_rows
        extra = [pa.array(v, pa.int64()) for v in ([block] * n, range(at, at + n), lcps, [*lcps[1:], after])]
        return pa.RecordBatch.from_arrays([*row.columns, *extra], [*row.schema.names, *names])

    for batch in batches:
        keys, lcps = batch.column("key").to_pylist(), []
        for key in keys:
            lcps.append(-1 if last is None else _common(last, key))
            last = key
        if keys:
            if waiting:
                yield ready(*waiting, lcps[0])
            waiting = (batch, lcps, place)
            place += len(keys)
    if waiting:
        yield ready(*waiting, -1)


class _Path:
    """Nodes of depths lo + 1 to hi (in codes) whose members have been the same so far; old: they began before the block."""

    def __init__(self, lo: int, hi: int, least: int | None, before: tuple, old: bool = False):
        self.lo, self.hi, self.least, self.before, self.old = lo, hi, least, before, old
        self.children, self.waiting = 0, []
        self.sums = self.key = self.end = None
        self.later = self.segment = 0


FIELDS = "kind string, block long, u long, conv_id long, parent long, ref_u long, ref_kind string, n long, children long, leaves long, rest long, owned long, base long, tail long, end_conv long, link binary, head binary, segment long"
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, FIELDS.split(", "))])
PARENT, REF_U, REF_KIND = 4, 5, 6


class _Block:
    """One block's rows, in order, and the stack of open paths; out has the nodes and parts of nodes that are done."""

    def __init__(self, block: int, size: int, out: list):
        self.block, self.size, self.out = block, size, out
        self.stack: list[_Path] = []
        self.now = (0, 0, 0, 0)

    def _row(self, kind: str, path: _Path, u: int, children: int) -> list:
        n, rest, owned, leaves = (a - b for a, b in zip(self.now, path.before))
        base = tail = end = link = head = None
        if not path.old:
            base, tail = path.sums[u - 1], path.sums[-1] - path.sums[u - 1] + path.later
            head = path.key[:CODE] if u <= 2 and path.segment else None
            if u == len(path.sums) - 1:
                end, link = path.end, sha256(path.key).digest()[:CODE] if u == self.size + 1 else None
            if kind == "N":
                rest -= n * base + tail + owned
        return [kind, self.block, u, path.least, None, None, None, n, children, leaves, rest, owned, base, tail, end, link, head, path.segment]

    def _close(self, path: _Path, down: int) -> None:
        """The nodes of path deeper than down get no further members."""
        for u in range(path.hi, down, -1):
            row = self._row("V" if path.old else "N", path, u, path.children if u == path.hi else int(not path.old))
            self._settle(path, row)
            path.waiting, path.children = [] if path.old else [row], int(not path.old)
        path.hi = down

    def _settle(self, path: _Path, row: list) -> None:
        """Names row as the parent of the nodes that wait for one, and passes them on."""
        for child in path.waiting:
            if row[0] == "N":
                child[PARENT] = row[3]
            else:
                child[REF_U], child[REF_KIND] = row[2], row[0]
            self.out.append(child)
        if row[0] == "V":
            self.out.append(row)

    def add(self, conv: int, segment: int, key: bytes, chars: list[int], ends: bool, rest: int, later: int, leaf: int, lcp: int) -> None:
        stack, units = self.stack, len(key) // CODE
        if not self.now[0] and lcp > 0:
            stack.append(_Path(0, lcp, None, self.now, True))
        while stack and stack[-1].hi > lcp:
            path = stack[-1]
            self._close(path, max(path.lo, lcp))
            if path.lo >= lcp:
                stack.pop()
                if stack and path.lo:
                    stack[-1].waiting += path.waiting
                    if path.least is not None:
                        stack[-1].least = path.least if stack[-1].least is None else min(stack[-1].least, path.least)
                else:
                    self.out += path.waiting
        if units > lcp:
            if stack and lcp:
                stack[-1].children += 1
            path = _Path(lcp, units, conv, self.now)
            path.sums, path.key, path.end, path.later, path.segment = [0, 0, *np.cumsum(chars, dtype=np.int64).tolist()], key, conv if ends else None, later, segment
            stack.append(path)
        else:
            path = None
            stack[-1].least = conv if stack[-1].least is None else min(stack[-1].least, conv)
        own = sum(chars[max(lcp - 1, 0) :]) + later
        self.now = tuple(a + b for a, b in zip(self.now, (1, rest, own, leaf)))
        if path:
            path.before = (path.before[0], path.before[1], self.now[2], path.before[3])

    def end(self) -> None:
        """Passes on the nodes that are open when the block ends."""
        least = None
        for k in range(len(self.stack) - 1, -1, -1):
            path = self.stack[k]
            least = path.least = min((x for x in (least, path.least) if x is not None), default=None)
            for u in range(path.hi, path.lo, -1):
                row = self._row("V" if path.old else "S", path, u, path.children if u == path.hi else int(not path.old))
                if not path.old and u > 1:
                    row[REF_U], row[REF_KIND] = u - 1, "V" if u - 1 == path.lo and self.stack[k - 1].old else "S"
                self._settle(path, row)
                path.waiting = []
                if not path.old:
                    self.out.append(row)
        self.stack = []


def _trie(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Nodes, or their parts, of whole blocks whose rows are sorted by block and place.

    kind N: a node that begins and ends within its block; its rest is what its subtree saves. S: the part of a node that
    is open when its block ends. V: what a block adds to a node that was open when it began. A node ends at the nearest
    row with a smaller lcp; the nodes that are open when a block begins are one path, which the successive minima of the
    block's lcps shorten, so that a block adds to a node all its rows or those before one of its minima.
    """
    out: list[list] = []
    now: _Block | None = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("block", "conv_id", "segment", "key", "chars", "ends", "rest", "later", "leaf", "lcp")]
        for block, *row in zip(*columns, strict=True):
            if now is None or now.block != block:
                if now:
                    now.end()
                now = _Block(block, size, out)
            now.add(*row)
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*out), SCHEMA)], schema=SCHEMA)
            out.clear()
    if now:
        now.end()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*out), SCHEMA)], schema=SCHEMA)


def _edges(sorted_rows: DataFrame) -> DataFrame:
    """block, first_lcp and last_next of every block with rows; the driver sees two rows of each block."""
    ends = sorted_rows.groupBy("block").agg(F.min_by("key", "place").alias("first"), F.max_by("key", "place").alias("last"))
    rows = sorted((r["block"], bytes(r["first"]), bytes(r["last"])) for r in ends.collect())
    lcps = [0, *(_common(a[2], b[1]) for a, b in zip(rows, rows[1:]))]
    made = [(r[0], a, b) for r, a, b in zip(rows, lcps, [*lcps[1:], 0])]
    return F.broadcast(sorted_rows.sparkSession.createDataFrame(made, "block long, first_lcp long, last_next long"))


def _streamed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(end_conv, ends_sha256) of each run of equal node, whose conv_ids come ascending; only the digest's state is held."""
    node = first = state = None
    made: list[tuple[int, str]] = []
    for batch in batches:
        for own, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if own == node:
                state.update(b",%d" % conv)
            else:
                if node is not None:
                    made.append((first, state.hexdigest()))
                node, first, state = own, conv, sha256(b"%d" % conv)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string())], ["end_conv", "ends_sha256"])
            made = []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["end_conv", "ends_sha256"])


def _joined_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes put together from their parts, as rows of kind N, and (block, u, kind, conv_id) of the node of each part."""
    parts = rows.where("kind <> 'N'")
    order = Window.partitionBy("u").orderBy("block", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    parts = written(parts.withColumn("node", F.sum(F.when(F.col("kind") == "S", 1).otherwise(0)).over(order)))
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "rest", "owned")]
    start = [F.max(F.when(F.col("kind") == "S", F.col(c))).alias(c) for c in ("block", "ref_u", "ref_kind", "base", "tail", "end_conv", "link", "head", "segment")]
    whole = parts.groupBy("u", "node").agg(F.min("conv_id").alias("conv_id"), *sums, *start)
    whole = whole.withColumn("rest", F.col("rest") - F.col("n") * F.col("base") - F.col("tail") - F.col("owned"))
    named = parts.select("block", "u", "kind", "node").join(whole.select("u", "node", "conv_id"), ["u", "node"])
    return whole.withColumn("parent", F.lit(None).cast("long")), named.select("block", F.col("u").alias("ref_u"), F.col("kind").alias("ref_kind"), F.col("conv_id").alias("of_ref"))


def prefix_trie(conversations: DataFrame, size: int = SEGMENT) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations, as op12_conversation_trie states it.

    Conversations, as rows of digests of `size` turns at most, are sorted in ranges; rows share lcp codes with the row
    before them, and a node ends at the next smaller lcp. Blocks of rows do this by themselves; the nodes that go over a
    block's end are put together from a row a block and depth. A conversation of more turns goes on in further rows
    below the digest of its past, so that none grows with it. Rows without conv_id are left out; without others there is
    no node. Null role and text are empty; turns of equal number are ordered by digest; columns but conv_id, turn, role
    and text are left out.
    """
    segments = _segments(rebuilt(conversations.select("conv_id", "turn", "role", "text")), size)
    by = ["key", F.expr("not ends"), "conv_id"]
    ranged = segments.repartitionByRange(partitions(conversations.sparkSession), *by).sortWithinPartitions(*by)
    fields = "conv_id long, segment long, chars array<long>, ends boolean, rest long, key binary"
    ranged = ranged.select(*(f.split()[0] for f in fields.split(", "))).mapInArrow(_neighbours, f"{fields}, block long, place long, lcp long, next long")
    ranged = written(ranged)
    near = ranged.join(_edges(ranged), "block")
    near = near.withColumn("lcp", F.when(F.col("lcp") < 0, F.col("first_lcp")).otherwise(F.col("lcp"))).withColumn("next", F.when(F.col("next") < 0, F.col("last_next")).otherwise(F.col("next")))
    leaf = (F.col("ends") & (F.col("next") * CODE < F.octet_length("key"))).cast("long")
    own = F.aggregate(F.slice("chars", F.greatest(F.col("lcp"), F.lit(1)).cast("int"), F.greatest(F.size("chars"), F.lit(1))), F.lit(0).cast("long"), lambda a, b: a + b)
    near = near.withColumns({"leaf": leaf, "own": own}).drop("next", "first_lcp", "last_next")
    one = near.where("ends and segment = 0").withColumn("later", F.lit(0).cast("long")).drop("own")
    conv = Window.partitionBy("conv_id").orderBy(F.desc("segment"))
    more = near.where("not (ends and segment = 0)").withColumn("later", F.coalesce(F.sum("own").over(conv.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    more = more.withColumn("leaf", F.max("leaf").over(conv.rowsBetween(Window.unboundedPreceding, 0))).drop("own")
    blocks = one.unionByName(more).repartition("block").sortWithinPartitions("block", "place")
    rows = written(blocks.mapInArrow(lambda x: _trie(x, size), FIELDS))

    whole, named = _joined_parts(rows)
    columns = ["u", "conv_id", "parent", "ref_u", "ref_kind", "block", "n", "children", "leaves", "rest", "end_conv", "link", "head", "segment"]
    nodes = rows.where("kind = 'N'").select(columns).unionByName(whole.select(columns))
    known = nodes.where("ref_u is null").drop("ref_u", "ref_kind", "block")
    asked = nodes.where("ref_u is not null").join(named, ["block", "ref_u", "ref_kind"]).withColumn("parent", F.col("of_ref")).drop("block", "ref_u", "ref_kind", "of_ref")
    nodes = written(known.unionByName(asked).withColumn("depth", F.col("segment") * size + F.col("u") - 1))

    # a node at which rows end for lack of room has the children of the row that goes on, and is their parent
    below = nodes.where("u = 1 and segment > 0").select(F.col("head").alias("link"), F.col("children").alias("more"))
    above = nodes.where("link is not null").select(F.col("link").alias("head"), F.col("conv_id").alias("parent"))
    kept = nodes.where("u > 1 or segment = 0")
    full = kept.where("link is not null").join(below, "link", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more")
    kept = kept.where("link is null").unionByName(full)
    nodes = kept.where("head is null").unionByName(kept.where("head is not null").drop("parent").join(above, "head"))

    last = ranged.where("ends").select(F.unhex(F.substring(F.sha2("key", 256), 1, 2 * CODE)).alias("node"), "conv_id")
    ends = last.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_streamed_ends, "end_conv long, ends_sha256 string")
    ended = nodes.where("end_conv is not null").join(ends, "end_conv")
    others = nodes.where("end_conv is null").withColumn("ends_sha256", F.lit(sha256(b"").hexdigest()))
    return ended.unionByName(others).select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("rest").alias("saved_tokens"), "ends_sha256")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node, by prefix_trie.

    A node is a distinct sequence of the first depth turns (role, text) of rebuilt conversations, its members those that
    begin with it; the root has none of them. conv_id and parent_conv_id are the least members of the node and of its
    parent; n_leaves counts the childless nodes below it and itself; saved_tokens sums over these nodes the members less
    one times the code points of the last text; ends_sha256 is the digest of the conv_ids of the members that end here.
    """
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 of decimal conv_ids, a byte and its eight bits at a time.
OP12_SQL = """
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
sums AS (SELECT conv_id, xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT),
  lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), 4294967295::BIGINT)) AS crc FROM ids),
turns AS (SELECT conv_id, turn, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(said ORDER BY turn NULLS FIRST, sha256(length(said.role)::VARCHAR || ':' || said.role || said.text)) AS said FROM turns GROUP BY conv_id),
whole AS (SELECT o.conv_id, list_concat(coalesce(b.said[: crc % 6], []), o.said[crc % 6 + 1 :]) AS said
  FROM own o JOIN sums s USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
paths AS (SELECT conv_id, len(said) AS size, d AS depth, said[:d] AS path FROM whole, unnest(range(0, len(said) + 1)) AS t(d)),
nodes AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth) AS ends FROM paths GROUP BY path),
below AS (SELECT path[: depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
tree AS (SELECT n.*, coalesce(n_children, 0) AS n_children, coalesce((n_convs - 1) * length(path[depth].text), 0) AS saved FROM nodes n LEFT JOIN below USING (path)),
above AS (SELECT path[:d] AS path, n_children = 0 AS leaf, saved FROM tree, unnest(range(0, depth + 1)) AS t(d)),
sub AS (SELECT path, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path)
SELECT t.conv_id, t.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(t.ends, '')) AS ends_sha256
FROM tree t JOIN sub USING (path) LEFT JOIN nodes p ON p.path = t.path[: t.depth - 1] AND t.depth > 0
"""
