"""Language identification by n-gram filters that hold a bitmask of languages."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm._store import table
from quillmark.llm._words import U64, mix

UNDETERMINED = "und"
#: The fit reads at most so many labelled documents of each language, and keeps so many n-grams of each.
SAMPLE, GRAMS = 400, 30_000
#: Shares of a language's rows that are cut to those numbers on their own before they meet.
SHARES = 64
#: Slots of the filter, and slots that an n-gram sets.
SLOTS, HASHES = 1 << 20, 3
#: A text of which a smaller share of n-grams is known in its best language is in none of the learned ones.
LEAST_SCORE = 0.2
#: Characters handled at once.
BLOCK = 250_000


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Filter(NamedTuple):
    """Bloom filters of all languages, sliced by bit: bit b of word w of a slot belongs to language 64 * w + b."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def of(cls, grams: dict[str, np.ndarray]) -> Filter:
        languages = sorted(grams)
        slots = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), U64)
        for k, name in enumerate(languages):
            for at in _places(grams[name]):
                slots[k // 64, at] |= U64(1 << k % 64)
        full = [((slots[k // 64] >> U64(k % 64)) & U64(1)).mean() for k in range(len(languages))]
        return cls(languages, slots, np.array(full) ** HASHES)

    def counts(self, grams: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of n-grams of each document, and of those in each language, less the false ones expected."""
        n = np.bincount(doc, minlength=docs)
        out = np.zeros((docs, len(self.languages)))
        places = _places(grams)
        for w, word in enumerate(self.slots):
            mask = word[places[0]]
            for at in places[1:]:
                mask &= word[at]
            for b in range(min(64, len(self.languages) - 64 * w)):
                k, seen = 64 * w + b, (mask >> U64(b)) & U64(1)
                raw = np.bincount(doc, weights=seen.astype(np.float64), minlength=docs)
                out[:, k] = np.maximum(0, (raw - n * self.false_rate[k]) / (1 - self.false_rate[k]))
        return n, out


def _places(grams: np.ndarray) -> list[np.ndarray]:
    step = (mix(grams) | U64(1)) & U64(0xFFFFFFFF)
    return [((grams + U64(i) * step) & U64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the 3- and 4-grams of lower-cased letters within words and at their edges, the text of each, and which texts have a letter."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    doc = np.concatenate([[0], doc])
    letter = _letters()[codes]
    lettered = np.bincount(doc[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    codes, letter, doc = np.where(letter, codes, 32)[keep].astype(U64), letter[keep], doc[keep]
    hashes, owners = [], []
    for n in (3, 4):
        size = max(0, len(codes) - n + 1)
        h, inner = np.full(size, n, U64), np.ones(size, bool)
        for k in range(n):
            h = h * U64(0x100000001B3) + codes[k : k + size]
            if 0 < k < n - 1:
                inner &= letter[k : k + size]
        hashes.append(mix(h[inner]))
        owners.append(doc[1 : size + 1][inner])
    return np.concatenate(hashes), np.concatenate(owners), lettered


def fit(docs: DataFrame, column: str = "text", label: str = "lang") -> Filter:
    """The filter of the languages in label, from at most SAMPLE documents of each, chosen by a hash of doc_id.

    An n-gram belongs to a language if it is among the GRAMS most frequent in its sample and occurs there twice at
    least. Rows without label or text teach nothing; without labelled rows there are no languages.
    """
    spark = docs.sparkSession
    labelled = docs.select("doc_id", F.col(label).alias("lang"), F.col(column).alias("text"))
    known = labelled.where("lang is not null and doc_id is not null").select("lang", "doc_id")
    ids = _first(known, [F.xxhash64("doc_id"), F.col("doc_id")], "doc_id", SAMPLE)
    chosen = labelled.where("text is not null").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").where("lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            grams, doc, _ = grams_of(batch.column(1).to_pylist())
            for name in sorted(set(lang)):
                found, n = np.unique(grams[lang[doc] == name], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    top = _first(counts, [F.desc("n"), F.col("gram")], "gram", GRAMS)
    found = top.select("lang", "gram").toArrow().combine_chunks()
    names, grams = np.array(found["lang"].to_pylist(), object), found["gram"].to_numpy().view(U64)
    return Filter.of({name: grams[names == name] for name in sorted({r.lang for r in ids.select("lang").distinct().collect()})})


def _first(rows: DataFrame, order: list[Column], spread: str, n: int) -> DataFrame:
    """The first n rows of each lang: those of SHARES shares of its rows first, so that no task has all rows of a language."""
    share = F.pmod(F.xxhash64(spread, F.lit(1)), F.lit(SHARES))
    for by in (["lang", share], ["lang"]):
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("k") <= n)
    return rows


def predict(docs: DataFrame, model: Filter, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred and score: the language with the most n-grams of the whole text, and the share it has of them.

    lang_pred is `und` and score 0 where the text is null or has no letter, or nothing was learned; equal languages go
    by name. Rows stay as they are, repeated ones too; columns outside keep are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = len(keep)
    text = keep.index(column) if column in keep else at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores = [], []
            for block in _blocks([t or "" for t in batch.column(text).to_pylist()]):
                grams, doc, lettered = grams_of(block)
                n, counts = model.counts(grams, doc, len(block))
                if not model.languages:
                    lettered[:], counts = False, np.zeros((len(block), 1))
                best = counts.argmax(axis=1)
                langs += [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                scores += np.where(lettered, np.clip(counts.max(axis=1) / np.maximum(n, 1), 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    kept = docs.select(*keep, *([docs[column].alias("__text")] if text == at else []))
    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:at]) + ", lang_pred string, score double")


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > BLOCK:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def held_out(doc_id: Column, modulus: int = 4) -> Column:
    """Whether the CRC-32 of doc_id as text leaves 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == 2, F.lit(False))


def keep_identified(docs: DataFrame, column: str = "text", label: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, whose language is a learned one; fitted on those not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), column, label)
    names = docs.columns
    judged = predict(docs, model, column, tuple(names))
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*names)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by predict with a filter fitted on those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return predict(docs, fit(docs.where("not held_out")), keep=("doc_id", "held_out"))
