"""Byte-level BPE by a tree of halves joined at their boundary, and decoding up a tree."""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm._store import table

#: Pieces and pairs of tokens that a worker remembers, and halves of pieces of at most SHORT bytes; twice over.
PIECES, PAIRS, PARTS, SHORT = 250_000, 125_000, 120_000, 8
#: Neighbours that a node of a tree joins where nothing has to be encoded again.
FAN = 64
#: Bytes up to which a list finds the pair of lowest rank sooner than a heap, and what is above all ranks.
FEW, NONE = 32, 1 << 40


def tree(parts: list[bytes]) -> bytes:
    """parts in a row, level by level, each node joining FAN neighbours."""
    while len(parts) > FAN:
        parts = [b"".join(parts[k : k + FAN]) for k in range(0, len(parts), FAN)]
    return b"".join(parts)


class Bpe:
    """The encoder of a rank file. joins counts the halves that were joined."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pairs = _Memory(self._pair, PAIRS)
        self.parts = _Memory(self._halves, PARTS)
        self.joins = 0

    def merge(self, data: bytes) -> list[int]:
        """The tokens of data, each step merging the leftmost pair of lowest rank: from a heap of pairs, or few pairs from a list."""
        n, ranks = len(data), self.ranks
        if n == 1:
            return [ranks[data]]
        if n <= FEW:
            return self._merge_few(data)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            gone = end[i]
            if not alive[gone]:
                continue
            alive[gone], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if before[i] >= 0 and (r := ranks.get(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def _merge_few(self, data: bytes) -> list[int]:
        rank, n = self.ranks.get, len(data)
        cuts, found = list(range(n + 1)), [rank(data[i : i + 2], NONE) for i in range(n - 1)]
        while found and (least := min(found)) != NONE:
            i = found.index(least)
            del cuts[i + 1], found[i]
            if i < len(found):
                found[i] = rank(data[cuts[i] : cuts[i + 2]], NONE)
            if i:
                found[i - 1] = rank(data[cuts[i - 1] : cuts[i + 1]], NONE)
        return [self.ranks[data[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _pair(self, key: int) -> list[int] | tuple[()]:
        a, b = key >> 32, key & 0xFFFFFFFF
        both = self.merge(self.token[a] + self.token[b])
        return () if both == [a, b] else both

    def settled(self, a: int, b: int) -> bool:
        """Whether a and b side by side stay as they are; a sequence all of whose neighbours do is the encoding."""
        return not self.pairs[a << 32 | b]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The tokens of two neighbours: the window at their boundary grows on each side until its edge has settled."""
        self.joins += 1
        pairs = self.pairs
        middle = pairs[a[-1] << 32 | b[0]]
        if not middle:
            return a + b
        i = j = 1
        while True:
            left = i >= len(a) or not pairs[a[-i - 1] << 32 | middle[0]]
            right = j >= len(b) or not pairs[middle[-1] << 32 | b[j]]
            if left and right:
                return a[: max(0, len(a) - i)] + middle + b[j:]
            i, j = (i if left else min(len(a), 2 * i)), (j if right else min(len(b), 2 * j))
            middle = self.merge(b"".join(map(self.token.__getitem__, a[-i:] + b[:j])))

    def part(self, data: bytes) -> list[int]:
        """The tokens of data, halved (at a power of two) down to single bytes and joined again."""
        return self.parts[data] if len(data) <= SHORT else self._halves(data)

    def _halves(self, data: bytes) -> list[int]:
        if len(data) == 1:
            return [self.ranks[data]]
        half = 1 << (len(data) - 1).bit_length() - 1
        if half > SHORT:
            return self.join(self._halves(data[:half]), self._halves(data[half:]))
        return self.join(self.parts[data[:half]], self.part(data[half:]))

    def piece(self, data: bytes) -> bytes:
        """The ids of a piece: its own token if it is one, as the tiktoken library has it, and else those of its halves."""
        rank = self.ranks.get(data)
        ids = [rank] if rank is not None else self.part(data)
        return struct.pack(f"<{len(ids)}I", *ids)

    @cached_property
    def encode(self) -> Callable[[str], bytes]:
        """A function from a text to its ids as little-endian unsigned 32-bit integers.

        A text is a tree of pieces, and a piece one of bytes. Tokens never go over the boundary of two pieces, so that
        nothing there has to be encoded again. What it remembers serves all tasks of a worker.
        """
        known, split = _Memory(lambda piece: self.piece(piece.encode()), PIECES).__getitem__, self.split
        return lambda text: tree(list(map(known, split(text))))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, concatenated up a tree."""
        return tree(list(map(self.token.__getitem__, ids.tolist())))


class _Memory(dict):
    """Remembers what make returned, the last size keys at least and twice that at most."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        if (made := self.older.get(key)) is None:
            made = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = made
        return made


@lru_cache(2)
def bpe_of(path: str) -> Bpe:
    return Bpe(path)


def encode_texts(docs: DataFrame, path: str, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and the binary column ids: each whole text's token ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Rows stay as they are, repeated ones too; no rows give none; columns outside keep
    are ignored. path names a rank file that every worker can open.
    """
    kept = docs.select(*keep, docs[column].alias("__text"))
    return kept.mapInArrow(lambda batches: _encoded(batches, path, keep), _schema(kept, len(keep), "ids binary"))


def _schema(df: DataFrame, n: int, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:n]), more])


def _encoded(batches: Iterator[pa.RecordBatch], path: str, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    encode, at = bpe_of(path).encode, len(keep)
    for batch in batches:
        ids = [encode(t) if t else b"" for t in batch.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(ids, pa.binary())], [*keep, "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    bpe, at = bpe_of(path), len(keep)
    for batch in batches:
        ids = batch.column(at).to_pylist()
        made = [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [bpe.decode(np.frombuffer(x, "<u4")) for x in ids]]
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], *map(pa.array, made, (pa.int64(), pa.string(), pa.binary()))], [*keep, "n_tokens", "ids_sha256", "decoded"])


def decode_ids(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, ids_sha256 and the binary column decoded of the rows of encode_texts; rows without ids have no bytes, and no rows give none."""
    kept = encoded.select(*keep, "ids")
    return kept.mapInArrow(lambda batches: _decoded(batches, path, keep), _schema(kept, len(keep), DECODED))


DECODED = "n_tokens long, ids_sha256 string, decoded binary"


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs: encode_texts and decode_ids in one worker.

    A null text counts as an empty one, which has no ids; repeated rows stay, no rows give none, other columns are ignored.
    """
    path, keep = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), ("doc_id",)
    kept = docs.select("doc_id", "text")
    done = kept.mapInArrow(lambda batches: _decoded(_encoded(batches, path, keep), path, keep), _schema(kept, 1, DECODED))
    return done.selectExpr("doc_id", "n_tokens", "ids_sha256", "sha2(decoded, 256) as decoded_sha256")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, by round_trip."""
    return round_trip(table(spark, sf_dir, "documents"))
