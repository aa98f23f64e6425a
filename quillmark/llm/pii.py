"""PII: patterns, and terms that give away a protected entity by how they co-occur with it in the corpus."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm._store import local_path, partitions, shared_dir, table, written
from quillmark.llm._words import SPACE, U64, Words, bytes_of, words
from quillmark.llm.lm import Shards, save

KINDS = ("email", "ip", "card", "phone", "term")
#: A term gives an entity (or a class of entities) away if the smoothed share of the documents with the term that have
#: the entity is so large, and if seeing the term raises the entity's probability by so many bits. SMOOTH is the weight,
#: in documents, of the entity's overall probability: at 0.5 one document proves nothing, and two that agree suffice.
SHARE, BITS, SMOOTH = 0.8, 5.0, 0.5
#: One in so many documents is counted first: terms that these alone show to be too common are not counted in the others.
FIRST = 8
#: Pairs of document and word that a task counts before it merges equal words.
BUFFER = 4_000_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_LOCAL_CHARACTERS = frozenset(string.ascii_letters + string.digits + "._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, in time linear in the text."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int(d) * 2 - 9 * (d > "4") for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches in code points, by start, then kind as listed."""
    out = [("email", *x) for x in emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c in string.digits for c in m.group()) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def entity_of(kind: str, text: str) -> str:
    """The protected entity of a match: spelling variants of a card or phone number are one, and cases of an address."""
    return kind + ":" + ("".join(c for c in text if c in string.digits) if kind in ("card", "phone") else text.translate(_FOLD))


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, entities and terms of the documents with a match: what they protect, its classes (as in email:), and the distinct hashes of their words outside the matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans = [base_spans(t) for t in texts]
            has = [i for i, (x, known) in enumerate(zip(spans, batch.column(0).is_valid().to_pylist(), strict=True)) if x and known]
            entities = [sorted({e for k, a, b in spans[i] for e in (entity_of(k, texts[i][a:b]), f"{k}:")}) for i in has]
            terms = [b"".join(np.unique(hashes).tobytes() for _, hashes, _, _ in free_words(pa.array([texts[i]], pa.string()), [spans[i]])) for i in has]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has, pa.int64())), pa.array(entities, pa.list_(pa.string())), pa.array(terms, pa.binary())], ["doc_id", "entities", "terms"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, entities array<string>, terms binary")


def free_words(column: pa.Array, spans: list[list[tuple[str, int, int]]], wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hashes, start, end) of the words that overlap no span of their row, in code points; only of rows with wanted words and those words, if given."""
    for block in words(column, SPACE):
        hit = np.flatnonzero(wanted(block.hashes)) if wanted else np.arange(len(block.hashes))
        if not len(hit):
            continue
        points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
        start, end = points[block.start[hit]], points[block.end[hit]]
        row = np.searchsorted(block.first, hit, "right") - 1
        edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
        # a row's code points begin where those of its first byte do
        first = points[_row_starts(column, block)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            r = int(row[a])
            s, e = start[a:b] - first[r], end[a:b] - first[r]
            # of the spans that begin before a word ends, none may reach beyond its start
            own = sorted((lo, hi) for _, lo, hi in spans[block.row + r])
            reach = np.maximum.accumulate(np.array([-1, *(hi for _, hi in own)]))
            free = reach[np.searchsorted(np.array([lo for lo, _ in own], np.int64), e, "left")] <= s
            yield block.row + r, block.hashes[hit[a:b]][free], s[free], e[free]


def _row_starts(column: pa.Array, block: Words) -> np.ndarray:
    _, at = bytes_of(column)
    return at[block.row : block.row + len(block.first) - 1] - at[block.row]


def term_counts(docs: DataFrame, folder: str, bits: int) -> DataFrame:
    """(term, n): the number of documents with each lower-cased word that keep_terms put into folder; every task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, done, n = 0, np.zeros(0, U64), np.zeros(0, np.int64)
        wanted = _wanted(folder, bits)
        for batch in batches:
            for block in words(batch.column(0), SPACE):
                hit = np.flatnonzero(wanted(block.hashes))
                edges = np.searchsorted(hit, block.first)
                held += [np.unique(block.hashes[hit[a:b]]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b > a]
                size += len(hit)
                if size > BUFFER:
                    done, n = _merged([done, *held], [n, *(np.ones(len(x), np.int64) for x in held)])
                    held, size = [], 0
                    if len(done) > BUFFER:
                        yield from _counted(done, n)
                        done, n = np.zeros(0, U64), np.zeros(0, np.int64)
        yield from _counted(*_merged([done, *held], [n, *(np.ones(len(x), np.int64) for x in held)]))

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(count, at) if len(at) else count


def _counted(keys: np.ndarray, counts: np.ndarray, step: int = 500_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), step):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + step].view(np.int64)), pa.array(counts[i : i + step])], ["term", "n"])


def together(scanned: DataFrame, able: DataFrame) -> DataFrame:
    """(entity, term, both): in how many documents each able entity and each term stand together; tasks add up their own first."""
    own = scanned.select("doc_id", F.explode("entities").alias("entity")).join(able.select("entity"), "entity")
    own = own.groupBy("doc_id").agg(F.collect_set("entity").alias("able"))
    rows = scanned.select("doc_id", "terms").dropDuplicates(["doc_id"]).join(own, "doc_id").select("able", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for entities, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for entity in entities:
                    held.setdefault(entity, []).append(np.frombuffer(terms, U64))
                    size += len(terms) // 8
                    if size > BUFFER:
                        yield from flush(held)
                        held, size = {}, 0
        yield from flush(held)

    def flush(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for entity, arrays in held.items():
            term, both = np.unique(np.concatenate(arrays), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([entity] * len(term), pa.string()), pa.array(term.view(np.int64)), pa.array(both.astype(np.int64))], ["entity", "term", "both"])

    return rows.mapInArrow(run, "entity string, term long, both long").groupBy("entity", "term").agg(F.sum("both").alias("both"))


def seen_terms(scanned: DataFrame) -> DataFrame:
    """(term, seen): how many of the scanned documents have each term outside their matches, at most the number of all that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for terms in batch.column(0).to_pylist():
                held.append(np.unique(np.frombuffer(terms, U64)))
                size += len(held[-1])
                if size > BUFFER:
                    yield from _counted(*_merged(held, [np.ones(len(x), np.int64) for x in held]))
                    held, size = [], 0
        yield from _counted(*_merged([np.zeros(0, U64), *held], [np.zeros(0, np.int64), *(np.ones(len(x), np.int64) for x in held)]))

    rows = scanned.select("doc_id", "terms").dropDuplicates(["doc_id"]).select("terms")
    return rows.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("seen"))


def disclosing(docs: DataFrame, share: float = SHARE, bits: float = BITS, smooth: float = SMOOTH) -> DataFrame:
    """(entity, term): every term, as its hash, that gives away an entity or a class of them; see find_pii."""
    total = docs.count()
    scanned = written(_scan(docs))
    entities = scanned.select("doc_id", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("have"))
    prior = F.col("have") / F.lit(float(max(total, 1)))
    share_of = lambda both, n: (both + smooth * prior) / (n + smooth)
    enough = lambda p: (p >= share) & (F.log2(p / prior) >= bits)
    # a term of all the entity's documents and of no other is the best there can be
    able = written(entities.where(enough(share_of(F.col("have"), F.col("have")))))
    # more documents with a term only lower its share, so that each count that is known so far can rule it out
    pairs = together(scanned, able).join(able, "entity").where(enough(share_of(F.col("both"), F.col("both"))))
    pairs = written(pairs.join(seen_terms(scanned), "term").where(enough(share_of(F.col("both"), F.greatest("seen", "both")))))
    early = F.pmod(F.xxhash64("text"), F.lit(FIRST)) == 0
    first = term_counts(docs.where(early), *keep_terms(pairs)).withColumnRenamed("n", "first")
    pairs = pairs.join(first, "term", "left").withColumn("first", F.coalesce("first", F.lit(0)))
    pairs = written(pairs.where(enough(share_of(F.col("both"), F.greatest("first", "both")))))
    rest = term_counts(docs.where(~early), *keep_terms(pairs))
    n = F.col("first") + F.coalesce("n", F.lit(0))
    return pairs.join(rest, "term", "left").where(enough(share_of(F.col("both"), F.greatest(n, F.col("both"))))).select("entity", "term")


def keep_terms(terms: DataFrame) -> tuple[str, int]:
    """Puts the distinct values of terms' column term into sorted files of a new shared folder; their folder and number of shards, in bits."""
    spark = terms.sparkSession
    bits = max(3, (partitions(spark) - 1).bit_length())
    folder = local_path(shared_dir(spark))
    dealt = terms.select("term").distinct().withColumn("shard", F.shiftrightunsigned("term", 64 - bits))
    dealt.groupBy("shard").applyInArrow(_kept(folder), "n long").write.format("noop").mode("overwrite").save()
    return folder, bits


def _wanted(folder: str, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """Which of some hashes keep_terms has in folder."""
    shards = Shards(folder, bits)

    def wanted(hashes: np.ndarray) -> np.ndarray:
        distinct, place = np.unique(hashes, return_inverse=True)
        return (shards.find("term", "term", distinct, ~distinct) == distinct)[place]

    return wanted


def _kept(folder: str):
    def run(group: pa.Table) -> pa.Table:
        save(folder, f"term-{group.column('shard')[0].as_py()}", np.sort(group.column("term").to_numpy().view(U64)))
        return pa.table({"n": pa.array([group.num_rows], pa.int64())})

    return run


def find_pii(docs: DataFrame, share: float = SHARE, bits: float = BITS, smooth: float = SMOOTH) -> DataFrame:
    """doc_id, the base counts, base (spans as text) and spans (with those of disclosing terms) of every row of docs.

    P(entity) is the share of all documents that have the entity, and P(entity | term) that of the documents with the
    term, anywhere in the text, drawn towards P(entity) by the weight of `smooth` documents; log2 of their ratio is what
    the term discloses, in bits. Entities are the protected ones and their four classes, so that one of a single
    document, where nothing can be told from chance, still has the terms that go with its class. A term beyond both
    thresholds for some entity is a span of kind term wherever it stands outside a match, in any document.
    All counts cover all documents. Null texts count as empty; rows without doc_id, or of an equal one, stay, and equal
    ids count as one document where entities are counted; other columns are ignored. The terms lie in the shared folder,
    where workers map them.
    """
    terms = keep_terms(disclosing(docs, share, bits, smooth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _wanted(*terms)
        for batch in batches:
            spans, both = _marked([t or "" for t in batch.column(1).to_pylist()], wanted)
            counts = [pa.array([sum(s[0] == k for s in x) for x in spans], pa.int64()) for k in KINDS[:4]]
            said = [pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in x) for x in xs], pa.string()) for xs in (spans, both)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *said], ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def _marked(texts: list[str], wanted: Callable[[np.ndarray], np.ndarray]) -> tuple[list[list], list[list]]:
    """The base spans of each text, and those with the spans of wanted words."""
    spans = [base_spans(t) for t in texts]
    both = list(spans)
    for row, _, start, end in free_words(pa.array(texts, pa.string()), spans, wanted):
        both[row] = sorted([*spans[row], *(("term", a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True))], key=lambda x: (x[1], KINDS.index(x[0])))
    return spans, both


def redact(docs: DataFrame, share: float = SHARE, bits: float = BITS, smooth: float = SMOOTH) -> DataFrame:
    """docs with every span of find_pii replaced in text: entities are generalised to their kind, as in [EMAIL], and terms removed, as [...].

    Of spans that overlap the first stands for both. Null texts stay null; rows stay as they are, repeated ones too, and
    keep all their columns (n_chars, if there, is not changed); no rows give none.
    """
    terms, text = keep_terms(disclosing(docs, share, bits, smooth)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _wanted(*terms)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            _, spans = _marked([t or "" for t in texts], wanted)
            columns = list(batch.columns)
            columns[text] = pa.array([None if t is None else replaced(t, x) for t, x in zip(texts, spans, strict=True)], batch.column(text).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with its spans, in the order of their starts, replaced."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], "[...]" if kind == "term" else f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and digest and all spans of every document, by find_pii."""
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
