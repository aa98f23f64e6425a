"""An interpolated modified Kneser-Ney model of any order from 2 on: counted in Spark, kept as sorted hash arrays that workers memory-map."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm._store import local_path, partitions, release, shared_dir, table, written
from quillmark.llm._words import SPACE, U64, Words, mix, words
from quillmark.llm.langid import held_out

#: Stand before the first word and after the last.
BEGIN, END = (mix(np.array([k], U64))[0] for k in (11, 12))
#: Words of the longest n-grams; passes over the texts that count those beyond bigrams, each a share of the histories.
ORDER, PASSES = 3, 8
#: N-grams that a task holds before it passes on their counts; bytes of text scored at once.
BUFFER, BLOCK = 2_000_000, 6_000_000


def sequences(block: Words, order: int = 2) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(histories, token, starts): the words before every token of the block, nearest first and BEGIN before a text; each text ends with END and its first token is at starts."""
    docs = np.arange(len(block.first) - 1)
    ends = block.first[1:] + docs
    token = np.empty(len(block.hashes) + len(docs), U64)
    word = np.ones(len(token), bool)
    word[ends] = False
    token[ends], token[word] = END, block.hashes
    starts = block.first[:-1] + docs
    histories, last = [], token
    for _ in range(order - 1):
        history = np.empty_like(token)
        history[1:] = last[:-1]
        history[starts] = BEGIN
        histories.append(history)
        last = history
    return histories, token, starts


def keys_of(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hashes of bigrams: 24 bits of the history's, then 40 of both, so that a history's bigrams lie together."""
    return (history & ~U64((1 << 40) - 1)) | (mix(history * U64(0x9E3779B97F4A7C15) + token) >> U64(24))


def context_of(histories: list[np.ndarray]) -> np.ndarray:
    """Hashes of the words before a token, nearest first; all that share the nearest lie in its shard."""
    context = histories[0]
    for history in histories[1:]:
        context = keys_of(context, history)
    return context


def _bytes(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([x.tobytes()], pa.binary()) for x in arrays]


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts key, and where each run of equals begins."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, np.int64)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[at], np.diff(np.concatenate([at, [len(x)]])).astype(np.uint32)


def _shard_ends(sorted_keys: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(sorted_keys >> U64(64 - bits), np.arange((1 << bits) + 1).astype(U64))


def count_ngrams(docs: DataFrame, bits: int, order: int = ORDER, passes: int = 1, turn: int = 0) -> DataFrame:
    """(shard, history, run, older, token, n): each task's n-gram counts, packed by the shard of their nearest history; of the shards whose turn it is."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        *histories, token = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        key = keys_of(context_of(histories), token)
        order, at = _grouped(key)
        n = np.diff(np.concatenate([at, [len(key)]])).astype(np.uint32)
        first = order[at]
        key, token = key[first], token[first]
        history, *older = (histories.pop(0)[first] for _ in range(len(histories)))
        del order, at, first
        ends = _shard_ends(key, bits)
        for shard in np.flatnonzero(np.diff(ends)).tolist():
            part = slice(ends[shard], ends[shard + 1])
            far = np.concatenate([x[part] for x in older]) if older else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *_bytes(*_runs(history[part]), far, token[part], n[part])], ["shard", "history", "run", "older", "token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for block in words(batch.column(0), SPACE):
                histories, token, _ = sequences(block, order)
                if passes > 1:
                    own = (histories[0] >> U64(64 - bits)) % U64(passes) == turn
                    histories, token = [x[own] for x in histories], token[own]
                held.append((*histories, token))
                size += len(token)
                if size >= BUFFER:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return docs.select("text").mapInArrow(run, "shard int, history binary, run binary, older binary, token binary, n binary")


def _join(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Written aside and renamed, so that a task that runs again leaves one whole file."""
    os.makedirs(folder, exist_ok=True)
    aside = f"{folder}/{name}.{uuid.uuid4().hex}.aside"
    with open(aside, "wb") as out:
        np.save(out, array)
    os.replace(aside, f"{folder}/{name}.npy")


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max()))) if counts.size else counts


def _tops(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _stats(context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct contexts, and the sum of the counts of each one's n-grams and how many have 1, 2 and more."""
    order, at = _grouped(context)
    by = n[order]
    return context[order[at]], np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (by, by == 1, by == 2, by > 2)], axis=1)


def _older(group: pa.Table, order: int) -> list[np.ndarray]:
    """The histories beyond the nearest, each as one array over all rows of the group."""
    parts = [np.frombuffer(x, U64).reshape(order - 2, -1) for x in group.column("older").to_pylist()] if order > 2 else []
    return list(np.concatenate(parts, axis=1)) if parts else []


def _merge_ngrams(folder: str, bits: int, most: int):
    """Saves a shard's n-grams of every order from most down to 2; those shorter than most count the distinct words before them, or how often they stand if they begin a text."""

    def run(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        histories = [np.repeat(_join(group.column("history"), U64), _join(group.column("run"), np.uint32)), *_older(group, most)]
        token, raw, tops = _join(group.column("token"), U64), _join(group.column("n"), np.uint32), []
        for k in range(most, 1, -1):
            context = context_of(histories)
            key = keys_of(context, token)
            order, at = _grouped(key)
            first, kinds = order[at], np.diff(np.concatenate([at, [len(key)]]))
            raw = np.add.reduceat(raw[order].astype(np.int64), at)
            del order, at
            histories, token, context, key = [x[first] for x in histories], token[first], context[first], key[first]
            n = raw if k == most else np.where(histories[-1] == BEGIN, raw, kinds)
            tops = _tops(n) + tops
            seen, stats = _stats(context, n)
            if k == 2:
                save(folder, f"key-{shard}", key)
                save(folder, f"n-{shard}", _narrow(n))
                save(folder, f"history-{shard}", seen)
                save(folder, f"stats-{shard}", _narrow(stats))
            else:
                # most n-grams stand once, and most contexts have one of those alone; Shards knows such contexts by their own n-gram
                once, more = n == 1, stats[:, 0] > 1
                for name, array in ((f"once{k}", key[once]), (f"key{k}", key[~once]), (f"n{k}", _narrow(n[~once])), (f"history{k}", seen[more]), (f"stats{k}", _narrow(stats[more]))):
                    if len(array):
                        save(folder, f"{name}-{shard}", array)
                histories = histories[:-1]
        order, at = _grouped(token)
        before = np.diff(np.concatenate([at, [len(token)]])).astype(np.uint32)
        count, token = np.add.reduceat(raw[order], at), token[order[at]]
        ends = _shard_ends(token, bits)
        full = np.flatnonzero(np.diff(ends)).tolist()
        parts = [slice(ends[s], ends[s + 1]) for s in full]
        out = [[-1, *full], [b"", *(token[p].tobytes() for p in parts)], [b"", *(before[p].tobytes() for p in parts)], [b"", *(count[p].tobytes() for p in parts)], [tops, *([] for _ in full)]]
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["shard", "token", "before", "count", "tops"])

    return run


def _merge_tokens(folder: str, bits: int):
    def run(group: pa.Table) -> pa.Table:
        token, before, count = _join(group.column("token"), U64), _join(group.column("before"), np.uint32), _join(group.column("count"), np.int64)
        order, at = _grouped(token)
        before, count = np.add.reduceat(before[order].astype(np.int64), at), np.add.reduceat(count[order], at)
        token = token[order[at]]
        ends = _shard_ends(token, bits)
        for shard in np.flatnonzero(np.diff(ends)).tolist():
            part = slice(ends[shard], ends[shard + 1])
            save(folder, f"token-{shard}", token[part])
            save(folder, f"count-{shard}", _narrow(np.stack([count[part], before[part]], axis=1)))
        sums = [len(at), int(count.sum()), int(before.sum()), *_tops(before)]
        return pa.table([pa.array([x], pa.int64()) for x in sums], TOTALS)

    return run


TOTALS = ["v", "n", "t", "n1", "n2", "n3", "n4"]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more from the counts of counts; halves of 1 to 3 where one is 0."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


class Model(NamedTuple):
    """folder holds the shards; v distinct tokens, n tokens and t distinct bigrams; discounts of bigrams and of continuations; m: tokens by continuations 1, 2 and more; longer: discounts of trigrams and on."""

    folder: str
    bits: int
    v: int
    n: int
    t: int
    upper: tuple[float, float, float]
    lower: tuple[float, float, float]
    m: tuple[int, int, int]
    longer: tuple[tuple[float, float, float], ...] = ()


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """The model of the texts of docs, null ones being empty; every n-gram of every text counts, up to `order` words.

    N-grams are dealt by a hash of the word before their last, after every task added up its own, so that all that a
    shorter n-gram counts is in its shard. Beyond bigrams the texts are read PASSES times, each time for a share of the
    shards, since the counts of one pass must be shuffled at once. No documents give a model under which every token has
    probability 1 over a vocabulary of none.
    """
    if order < 2:
        raise ValueError(f"order must be 2 at least, not {order}")
    spark = docs.sparkSession
    # n-grams have many small shards; tokens are merged in fewer groups, since each shard sends a row to each
    bits = max(3, (partitions(spark) - 1).bit_length()) + 2 * (order > 2)
    coarse = bits - 4 * (order > 2)
    folder = local_path(shared_dir(spark))
    passes, merged = PASSES if order > 2 else 1, None
    for turn in range(passes):
        blobs = count_ngrams(docs, bits, order, passes, turn)
        part = written(blobs.groupBy("shard").applyInArrow(_merge_ngrams(folder, coarse, order), "shard int, token binary, before binary, count binary, tops array<long>"))
        merged = part if merged is None else merged.unionByName(part)
        del blobs
        release(spark)
    tops = merged.where("shard < 0").agg(*(F.coalesce(F.sum(F.get("tops", F.lit(k))), F.lit(0)).alias(f"n{k + 1}") for k in range(4 * (order - 1)))).first()
    sums = merged.where("shard >= 0").select("shard", "token", "before", "count").groupBy("shard").applyInArrow(_merge_tokens(folder, bits), ", ".join(f"{c} long" for c in TOTALS))
    total = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS)).first()
    more = total.v - total.n1 - total.n2
    upper, *longer = (discounts(*tops[k : k + 4]) for k in range(0, len(tops), 4))
    return Model(folder, bits, total.v, total.n, total.t, upper, discounts(total.n1, total.n2, total.n3, total.n4), (total.n1, total.n2, more), tuple(longer))


class Shards:
    """Lookups in the memory-mapped arrays of a model."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.open = folder, bits, {}

    def _array(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            path = f"{self.folder}/{name}.npy"
            self.open[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[name]

    def find(self, keys: str, values: str, wanted: np.ndarray, out: np.ndarray) -> np.ndarray:
        """out, with the value of every sorted wanted key that is there."""
        ends = _shard_ends(wanted, self.bits)
        for shard in np.flatnonzero(np.diff(ends)).tolist():
            if (known := self._array(f"{keys}-{shard}")) is not None:
                part = slice(ends[shard], ends[shard + 1])
                at = np.minimum(np.searchsorted(known, wanted[part]), len(known) - 1)
                there = known[at] == wanted[part]
                out[part][there] = self._array(f"{values}-{shard}")[at[there]]
        return out

    def ngrams(self, k: int, context: np.ndarray, key: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of k-grams (3 words or more) and stats of their contexts; there: whether the context stands in the corpus."""
        order = np.argsort(key)
        wanted = key[order]
        n = np.empty(len(key), np.int64)
        n[order] = self.find(f"key{k}", f"n{k}", wanted, (self.find(f"once{k}", f"once{k}", wanted, ~wanted) == wanted).astype(np.int64))
        order = np.argsort(context)
        stats = np.zeros((len(key), 4), np.float32)
        stats[there, :2] = 1
        stats[order] = self.find(f"history{k}", f"stats{k}", context[order], stats[order])
        return n, stats.astype(np.float64)


@lru_cache(1)
def _shards(folder: str, bits: int) -> Shards:
    return Shards(folder, bits)


def _cut(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)], 0)


def score_block(model: Model, shards: Shards, block: Words) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score and score of each text of the block."""
    histories, token, starts = sequences(block, 2 + len(model.longer))
    history = histories[0]
    distinct, place = np.unique(np.concatenate([token, [BEGIN]]), return_inverse=True)
    count = shards.find("token", "count", distinct, np.zeros((len(distinct), 2), np.int64))
    stats = shards.find("history", "stats", distinct, np.zeros((len(distinct), 4), np.float32)).astype(np.float64)
    t = max(model.t, 1)
    spare = sum(d * m for d, m in zip(model.lower, model.m, strict=True)) / t if model.t else 1.0
    lower = _cut(count[:, 1], model.lower) / t + spare / (model.v + 1)
    seen = np.maximum(stats[:, 0], 1)
    weight = np.where(stats[:, 0] > 0, stats[:, 1:] @ np.array(model.upper) / seen, 1.0)
    now, place_of_begin = place[:-1], place[-1]
    past = np.empty_like(now)
    past[1:] = now[:-1]
    past[starts] = place_of_begin
    key = keys_of(history, token)
    order = np.argsort(key)
    pairs = np.empty(len(key), np.int64)
    pairs[order] = shards.find("key", "n", key[order], np.zeros(len(key), np.int64))
    probability = _cut(pairs, model.upper) / seen[past] + weight[past] * lower[now]
    n = pairs
    for k, cuts in enumerate(model.longer, 3):
        context = context_of(histories[: k - 1])
        there = np.empty(len(n), bool)
        there[1:] = n[:-1] > 0
        there[starts] = model.n > 0
        n, stats = shards.ngrams(k, context, keys_of(context, token), there)
        seen = np.maximum(stats[:, 0], 1)
        probability = _cut(n, cuts) / seen + np.where(stats[:, 0] > 0, stats[:, 1:] @ np.array(cuts) / seen, 1.0) * probability
    base = np.log10((count[:, 0] + 1) / (model.n + model.v + 1))
    sizes = np.diff(np.concatenate([starts, [len(token)]]))
    add = lambda x: np.add.reduceat(x, starts)
    return sizes, add((count[:, 0] > 0)[now].astype(np.int64)), add(base[now]), add(np.log10(probability))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, n_known, base_score, score (log10 of the text's probability) and perplexity of every row.

    A null text counts as an empty one, whose only token is the end. Rows stay as they are; columns outside keep are
    ignored. Workers map the model's files from the shared folder, and read only the parts they look into.
    """
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _shards(model.folder, model.bits)
        for batch in batches:
            parts = [score_block(model, shards, block) for block in words(batch.column(at), SPACE, block=BLOCK)]
            size, known, base, own = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, k) for k in (np.int64, np.int64, float, float))
            made = [size.astype(np.int64), known, base, own, 10 ** np.minimum(-own / np.maximum(size, 1), 300)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *map(pa.array, made)], [*keep, *NAMES])

    kept = docs.select(*keep, "text")
    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:at]) + ", n_tokens long, n_known long, base_score double, score double, perplexity double")


NAMES = ["n_tokens", "n_known", "base_score", "score", "perplexity"]


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under a model fitted on those not held out, by fit and score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 7).alias("held_out"))
    model = fit(docs.where("not held_out"))
    scored = score(docs, model, ("doc_id", "held_out")).withColumn("train_tokens", F.lit(model.n).cast("long"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
