"""Benchmark decontamination by a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm._store import table
from quillmark.llm._words import NOT_ALNUM, U64, Words, runs, words

#: Words of a window, and item words that one automaton (a broadcast of under 1 GB) may hold; more items make more automata.
WINDOW, MOST_WORDS = 10, 1_000_000
_TABLE = 1 << 22


class Automaton:
    """Recognises every substring of the items; a state also knows the items that have its window or end in it."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        items = [(name, h) for name, h in items if len(h)]
        self.least = min((min(window, len(h)) for _, h in items), default=window)
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, U64)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, np.searchsorted(self.vocabulary, h).tolist()) for name, h in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._add(last, c)
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, codes in coded:
            size = min(window, len(codes))
            for state, length in self._walk(codes):
                if length >= size:
                    state = self._shortest(state, size)
                    if size == window:
                        self.items.setdefault(state, set()).add(name)
                    else:
                        self.short.setdefault(state, []).append((size, name))
        self.near_short = [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.near_short[state] = state if state in self.short else self.near_short[self.link[state]]
        self.known = np.zeros(_TABLE, bool)
        for _, h in items:
            self.known[self._slots(h)] = True

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """Places of what must stand in a row at each place of an occurrence: pairs of words, or words if a window may be one."""
        return ((runs(h, 2) if self.least > 1 else h) & U64(_TABLE - 1)).astype(np.int64)

    def _new(self, length: int, link: int, to: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(to)
        return len(self.link) - 1

    def _add(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _shortest(self, state: int, size: int) -> int:
        """The state of the suffix of size words."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _walk(self, codes: Iterable[int]) -> Iterator[tuple[int, int]]:
        """After each word, the state of the longest match that ends there, and its length."""
        state = length = 0
        for c in codes:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            yield state, length

    def places(self, block: Words) -> Iterator[tuple[int, int]]:
        """Ranges of words, each in one row, that alone can hold occurrences."""
        near = self.known[self._slots(block.hashes)]
        span = self.least - 1 if self.least > 1 else 1
        if self.least > 1:
            ends = block.first[1:-1]
            near[ends[(ends > 0) & (ends <= len(near))] - 1] = False
        edges = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).astype(np.int8)))
        for lo, hi in edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2), axis=1)[:, 0] >= span].tolist():
            stop = hi + (self.least > 1)
            if self.least > 1:
                yield lo, stop
            else:
                for cut, end in zip(*self._cuts(block, lo, stop), strict=True):
                    yield cut, end

    @staticmethod
    def _cuts(block: Words, lo: int, hi: int) -> tuple[list[int], list[int]]:
        inner = block.first[(block.first > lo) & (block.first < hi)]
        inner = np.unique(inner).tolist()
        return [lo, *inner], [*inner, hi]

    def hits(self, block: Words) -> dict[int, tuple[list[list[int]], set[str]]]:
        """For each row of the block with a hit: merged ranges of hit words (counted within the row), and the items."""
        out: dict[int, tuple[list[list[int]], set[str]]] = {}
        for lo, hi in self.places(block):
            h = block.hashes[lo:hi]
            at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            codes = np.where(self.vocabulary[at] == h, at, -1).tolist()
            row = int(np.searchsorted(block.first, lo, "right")) - 1
            base = lo - int(block.first[row])
            for i, (state, length) in enumerate(self._walk(codes)):
                found: list[tuple[int, set[str]]] = []
                if length >= self.window:
                    found.append((self.window, self.items[self._shortest(state, self.window)]))
                short = self.near_short[state]
                while short:
                    found += [(m, {name}) for m, name in self.short[short] if m <= length]
                    short = self.near_short[self.link[short]]
                for m, names in found:
                    ranges, items = out.setdefault(row, ([], set()))
                    _mark(ranges, base + i + 1 - m, base + i + 1)
                    items |= names
        return out


def _mark(ranges: list[list[int]], start: int, end: int) -> None:
    """Adds a range that ends no earlier than those before it."""
    while ranges and ranges[-1][1] >= start:
        start = min(start, ranges.pop()[0])
    ranges.append([start, end])


def automata(items: DataFrame, window: int = WINDOW, most: int = MOST_WORDS) -> list[Broadcast]:
    """Automata of the items (item_id, text), each of at most `most` words or one item; null texts have no words."""
    sc, group, size, out = items.sparkSession.sparkContext, [], 0, []
    for row in items.selectExpr("coalesce(cast(item_id as string), '') as name", "text").where("text is not null").toLocalIterator():
        h = next(words(pa.array([row.text]), NOT_ALNUM)).hashes
        if group and size + len(h) > most:
            out.append(sc.broadcast(Automaton(group, window)))
            group, size = [], 0
        group.append((row.name, h))
        size += len(h)
    return [*out, sc.broadcast(Automaton(group, window))] if group else out


HITS = "array<struct<start:int,end:int>>"
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: int = MOST_WORDS) -> DataFrame:
    """docs with the columns n_words, hits (merged ranges of hit words) and hit_items (sorted ids as text).

    A word is hit if it lies in `window` consecutive words of an item, or in a whole shorter item. Null and empty texts
    have no words; items of equal id count as one; without items nothing is hit; rows stay as they are. A column of docs
    named like a result is replaced.
    """
    names = [c for c in docs.columns if c not in ("n_words", "hits", "hit_items")]
    out = docs.select(*names)
    for k, shared in enumerate(automata(items, window, most) or [None]):
        out = _scan(out, shared, names, k)
    return out


def _scan(docs: DataFrame, shared: Broadcast | None, names: list[str], k: int) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    return docs.mapInArrow(_scanner(shared, names, k), f"{schema}, n_words long, hits {HITS}, hit_items array<string>")


def _scanner(shared: Broadcast | None, names: list[str], k: int):
    """Adds the hits of one automaton to those of the k before it."""
    at, text = len(names), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            hits = batch.column(at + 1).to_pylist() if k else [[] for _ in n]
            found = batch.column(at + 2).to_pylist() if k else [[] for _ in n]
            for block in words(batch.column(text), NOT_ALNUM):
                n[block.row : block.row + len(block.first) - 1] = np.diff(block.first)
                for row, (ranges, items) in (shared.value.hits(block).items() if shared else ()):
                    row += block.row
                    merged: list[list[int]] = []
                    for start, end in sorted([*ranges, *([x["start"], x["end"]] for x in hits[row])], key=lambda x: x[1]):
                        _mark(merged, start, end)
                    hits[row] = [{"start": a, "end": b} for a, b in merged]
                    found[row] = sorted({*found[row], *items})
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(n), pa.array(hits, _HITS), pa.array(found, pa.list_(pa.string()))], [*names, "n_words", "hits", "hit_items"])

    return run


def cut_hits(found: DataFrame, longest: int = WINDOW, coverage: float = 0.8) -> DataFrame:
    """The columns of found but those of find_hits, with the text of every hit of at least `longest` words taken out.

    Of a text of whose words a larger share than `coverage` is hit, all hits go whatever their length (so short items
    too). The rest of the text stays as it is, and n_chars (if there is one) follows it. Null texts stay null.
    """
    names = [c for c in found.columns if c not in ("n_words", "hits", "hit_items")]
    return found.mapInArrow(_cutter(names, longest, coverage), found.select(*names).schema)


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: int = MOST_WORDS, coverage: float = 0.8) -> DataFrame:
    """cut_hits of find_hits, the last automaton's scan and the cut in one worker; all columns of docs stay, whatever their names."""
    aside = {c: f"__{c}" for c in ("n_words", "hits", "hit_items") if c in docs.columns}
    docs = docs.withColumnsRenamed(aside)
    out, names = docs, docs.columns
    *first, last = automata(items, window, most) or [None]
    for k, shared in enumerate(first):
        out = _scan(out, shared, names, k)
    scan, cut = _scanner(last, names, len(first)), _cutter(names, window, coverage)
    return out.mapInArrow(lambda batches: cut(scan(batches)), docs.schema).withColumnsRenamed({v: k for k, v in aside.items()})


def _cutter(names: list[str], longest: int, coverage: float):
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, changed = batch.column("hits").to_pylist(), {}
            for row in (i for i, x in enumerate(hits) if x):
                block = next(words(batch.column(text).slice(row, 1), NOT_ALNUM))
                whole = sum(x["end"] - x["start"] for x in hits[row]) > coverage * len(block.hashes)
                kept, at, data = [], 0, block.data.tobytes()
                for x in hits[row]:
                    if whole or x["end"] - x["start"] >= longest:
                        kept.append(data[at : block.start[x["start"]]])
                        at = int(block.end[x["end"] - 1])
                changed[row] = b"".join([*kept, data[at:]]).decode()
            columns = dict(zip(names, batch.columns, strict=False))
            if changed:
                texts = batch.column(text).to_pylist()
                for row, new in changed.items():
                    texts[row] = new
                columns["text"] = pa.array(texts, batch.column(text).type)
                if "n_chars" in columns:
                    sizes = columns["n_chars"].to_pylist()
                    for row, new in changed.items():
                        sizes[row] = len(new)
                    columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return run


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document, by find_hits."""
    found = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.selectExpr(
        "doc_id", "n_words", "coalesce(aggregate(hits, 0L, (n, x) -> n + x.end - x.start), 0L) as n_hit", "cast(size(hit_items) as long) as n_items",
        "sha2(array_join(hit_items, ','), 256) as items_sha256", "size(hits) > 0 as contaminated",
    )
