"""Many verbatim items located in all texts at once, by packed automata that workers memory-map."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.sources.io import settled, shared_top

#: Bytes of items in one automaton, and bytes of text that one lane scans.
PATTERN_BYTES, LANE = 4_000_000, 4096


def automaton(patterns: list[bytes]) -> dict[str, np.ndarray]:
    """The Aho-Corasick automaton of distinct patterns that aren't empty, as arrays, made a level at a time.

    State 0 is the root; states are numbered by depth. keys (state * 256 + byte, ascending) lead to goto; fail is the
    state of the longest proper suffix that is a state; pattern is the number of the pattern that ends at a state, or -1;
    chain is the nearest state at or above it, by fail, at which a pattern ends, or 0.
    """
    order = sorted(range(len(patterns)), key=lambda i: patterns[i])
    size = np.array([len(patterns[i]) for i in order], np.int64)
    data = np.frombuffer(b"".join(patterns[i] for i in order), np.uint8)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(order) else np.zeros(0, np.int64)
    at, alive, states = np.zeros(len(order), np.int64), np.arange(len(order)), 1
    keys, goto, parents, letters, ends = [], [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], {}
    depth, levels = 0, []
    while len(alive):
        alive = alive[size[alive] > depth]
        if not len(alive):
            break
        asked = at[alive] * 256 + data[start[alive] + depth]
        found, inverse = np.unique(asked, return_inverse=True)
        keys.append(found)
        goto.append(np.arange(states, states + len(found)))
        parents.append(found >> 8)
        letters.append(found & 255)
        at[alive] = states + inverse
        levels.append((states, states + len(found)))
        states += len(found)
        depth += 1
        for i in alive[size[alive] == depth]:
            ends[int(at[i])] = order[int(i)]
    keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    goto = np.concatenate(goto) if goto else np.zeros(0, np.int64)
    parent, letter = np.concatenate(parents), np.concatenate(letters)
    pattern = np.full(states, -1, np.int64)
    pattern[list(ends)] = list(ends.values())
    made = {"keys": keys, "goto": goto, "fail": np.zeros(states, np.int64), "pattern": pattern, "chain": np.zeros(states, np.int64), "sizes": np.array([len(p) for p in patterns], np.int64)}
    for a, b in levels:
        if a > 1:
            made["fail"][a:b] = stepped(made, made["fail"][parent[a:b]], letter[a:b])
        made["chain"][a:b] = np.where(pattern[a:b] >= 0, np.arange(a, b), made["chain"][made["fail"][a:b]])
    return made


def stepped(made: dict[str, np.ndarray], state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The states after one byte each."""
    keys, out = made["keys"], np.zeros(len(state), np.int64)
    if not len(keys):
        return out
    open_, state = np.arange(len(state)), state.copy()
    while len(open_):
        asked = state[open_] * 256 + byte[open_]
        place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = keys[place] == asked
        out[open_[hit]] = made["goto"][place[hit]]
        open_ = open_[~hit & (state[open_] > 0)]
        state[open_] = made["fail"][state[open_]]
    return out


def matches(made: dict[str, np.ndarray], data: np.ndarray, at: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pattern, byte place in data) of all occurrences within rows data[at[i]:at[i + 1]].

    Rows are cut into lanes that are scanned side by side; a lane begins so many bytes early that no occurrence which
    ends in it is missed.
    """
    longest = int(made["sizes"].max()) if len(made["sizes"]) else 0
    width = max(lane, 4 * longest)
    pieces = -(-(at[1:] - at[:-1]) // width)
    row = np.repeat(np.arange(len(pieces)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = at[row] + nth * width
    begin, end = np.maximum(first - longest + 1, at[row]), np.minimum(first + width, at[row + 1])
    order = np.argsort(begin - end, kind="stable")
    row, first, begin, end = row[order], first[order], begin[order], end[order]
    state, found = np.zeros(len(row), np.int64), []
    for t in range(int((end - begin).max()) if len(row) else 0):
        n = int(np.searchsorted(begin - end, -t, "left"))
        state = stepped(made, state[:n], data[begin[:n] + t])
        hit = np.flatnonzero(made["chain"][state])
        hit = hit[begin[hit] + t >= first[hit]]
        ends = made["chain"][state[hit]]
        while len(hit):
            which = made["pattern"][ends]
            found.append((row[hit], which, begin[hit] + t + 1 - made["sizes"][which]))
            ends = made["chain"][made["fail"][ends]]
            hit, ends = hit[ends > 0], ends[ends > 0]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def first_places(texts: DataFrame, items: DataFrame, key: str, item: str, column: str = "text", wanted: str = "text") -> DataFrame:
    """item, key and at: for each text of texts (key, column) that holds the text of an item (item, wanted) verbatim, where it first does (in code points, from 1).

    Distinct item texts are dealt into automata of some PATTERN_BYTES, each made by one task and kept as arrays in a
    mounted shared folder, from which workers map them; every batch of texts is scanned by each, so that cost grows with
    the texts and the automata, never with texts times items. Null and empty items are in no text, null texts hold
    nothing; items of equal text are found alike, repeated keys each for themselves but merged if their rows are equal.
    """
    spark = texts.sparkSession
    folder = urlparse(shared_top(spark))
    if folder.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped automata need a mounted shared folder in spark.checkpoint.dir, not {folder.geturl()}")
    folder = f"{folder.path.rstrip('/')}/automata-{uuid.uuid4().hex}"
    named = items.where(F.col(wanted).isNotNull() & (F.col(wanted) != "")).select(F.col(item).alias("__item"), F.col(wanted).alias("__wanted"))
    distinct = settled(named.select("__wanted").distinct())
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("__wanted")), F.lit(0)).alias("n")).first()["n"]
    boxes = max(1, -(-size // PATTERN_BYTES))
    dealt = distinct.withColumn("box", F.pmod(F.xxhash64("__wanted"), F.lit(boxes)).cast("int"))

    def make(group: pd.DataFrame) -> pd.DataFrame:
        made = automaton([w.encode() for w in group["__wanted"]])
        box = int(group["box"].iloc[0])
        os.makedirs(folder, exist_ok=True)
        for name, values in made.items():
            part = f"{folder}/{box}-{name}.{uuid.uuid4().hex}"
            with open(part, "wb") as out:
                np.save(out, values)
            os.replace(part, f"{folder}/{box}-{name}.npy")
        return pd.DataFrame({"box": box, "pattern": np.arange(len(group)), "__wanted": group["__wanted"].to_numpy()})

    numbered = settled(dealt.groupBy("box").applyInPandas(make, "box int, pattern long, __wanted string"))
    present = sorted(r["box"] for r in numbered.select("box").distinct().collect())
    kind = dict(texts.dtypes)[key]
    mapped: dict[int, dict[str, np.ndarray]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([t.encode() if t is not None else b"" for t in batch.column(1).to_pylist()], pa.large_binary())
            at = np.frombuffer(rows.buffers()[1], np.int64)[: len(rows) + 1] if len(rows) else np.zeros(1, np.int64)
            data = np.frombuffer(rows.buffers()[2], np.uint8) if at[-1] else np.zeros(0, np.uint8)
            for box in present:
                if box not in mapped:
                    mapped[box] = {n: np.load(f"{folder}/{box}-{n}.npy", mmap_mode="r") for n in ("keys", "goto", "fail", "pattern", "chain", "sizes")}
                row, which, place = matches(mapped[box], data, at)
                if not len(row):
                    continue
                order = np.lexsort((place, which, row))
                row, which, place = row[order], which[order], place[order]
                first = np.concatenate([[True], (row[1:] != row[:-1]) | (which[1:] != which[:-1])])
                row, which, place = row[first], which[first], place[first]
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                columns = [pa.array(np.full(len(row), box), pa.int32()), pa.array(which, pa.int64()), batch.column(0).take(pa.array(row)), pa.array(points[place] - points[at[row]] + 1, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["box", "pattern", "__key", "at"])

    found = texts.select(F.col(key).alias("__key"), F.col(column).alias("__text")).mapInArrow(run, f"box int, pattern long, __key {kind}, at long")
    held = found.join(numbered, ["box", "pattern"]).join(named, "__wanted")
    return held.select(F.col("__item").alias(item), F.col("__key").alias(key), "at").distinct()


def audited(items: DataFrame, places: DataFrame, item: str, key: str, issues: Column) -> DataFrame:
    """item, key, at, disposition and reason: where each item of items (with text) first stands, by key, and why it may be used or not.

    issues is an array of what is wrong with the item's own text. An item that stands nowhere, or has issues, is
    exclude_or_review with its reason; any other is eligible_body.
    """
    first = places.groupBy(item).agg(F.min(F.struct(key, "at")).alias("__first"))
    rows = items.join(first, item, "left")
    wrong = F.array_join(F.array_sort(F.array_distinct(F.coalesce(issues, F.array().cast("array<string>")))), ";")
    reason = F.when(F.col("__first").isNull(), "no_exact_match_in_archived_edition").when(wrong != "", wrong).otherwise("exact_source_match_within_verified_work_body")
    good = F.col("__first").isNotNull() & (wrong == "")
    return rows.select(item, F.col(f"__first.{key}").alias(key), F.col("__first.at").alias("at"), F.when(good, "eligible_body").otherwise("exclude_or_review").alias("disposition"), reason.alias("reason"))
