"""Words of Arrow string columns as 64-bit hashes, vectorised over the column's own bytes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once; a longer text is handled alone.
BLOCK = 1_000_000
#: Distinct words whose hashes a worker remembers; when full it starts anew.
REMEMBERED = 200_000
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table(delimiters: str) -> np.ndarray:
    """A flag for each byte; delimiters holds ASCII characters."""
    out = np.zeros(256, bool)
    out[list(delimiters.encode("ascii"))] = True
    return out


#: The words [^\x20\x09-\x0D]+ end at these bytes.
SPACE = byte_table(" \t\n\x0b\x0c\r")
#: The words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after A-Z became a-z) end at these.
NOT_ALNUM = byte_table("".join(chr(c) for c in range(128) if not chr(c).isalnum()))
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] = _SAME[97:123]


class Words(NamedTuple):
    """hashes, and start and end as byte offsets into data; words of row i are first[i] to first[i + 1]."""

    row: int
    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


class _Hashes(dict):
    """The first 64 bits of a word's BLAKE2b digest, in which nobody can place two words together at will."""

    def __missing__(self, word: bytes) -> int:
        made = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return made


_hashes = _Hashes()


def _hashed(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words: of up to 16 bytes from bytes and size by scrambles that cannot be run backwards, of more by digests of the distinct ones."""
    if not len(start):
        return np.zeros(0, U64)
    eights = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
    short = np.minimum(size, 8).astype(U64)
    packed = (eights[start] << (U64(64) - U64(8) * short)) + np.where(short < 8, short, U64(0))
    hashes = packed + mix(packed)
    # eight bytes that could be taken for fewer go with the longer words
    middle = np.flatnonzero((size > 8) & (size <= 16) | (size == 8) & (data[start] < 8))
    if len(middle):
        at, more = start[middle], (size[middle] - 8).astype(U64)
        first, second = eights[at], np.where(more > 0, eights[np.minimum(at + 8, len(data) - 1)] << ((U64(64) - U64(8) * more) & U64(63)), U64(0))
        inner = mix(first + (more + U64(1)) * U64(_BASE)) + second
        hashes[middle] = mix(inner) + second + (first << U64(29)) + (first >> U64(35))
    long = np.flatnonzero(size > 16)
    if len(long):
        place = np.concatenate([[0], np.cumsum(size[long])])
        at = np.arange(place[-1]) + np.repeat(start[long] - place[:-1], size[long])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(long), [None, pa.py_buffer(place), pa.py_buffer(data[at])]).dictionary_encode()
        if len(_hashes) > REMEMBERED:
            _hashes.clear()
        hashes[long] = np.fromiter(map(_hashes.__getitem__, coded.dictionary.to_pylist()), U64, len(coded.dictionary))[coded.indices.to_numpy()]
    return hashes


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and each row's first offset in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(column: pa.Array, delimiter: np.ndarray = SPACE, fold: bool = True, block: int = BLOCK) -> Iterator[Words]:
    """Blocks of whole rows (of block bytes, or one longer row) with their words; fold: A-Z count as a-z in the hashes."""
    data, at = bytes_of(column)
    row, n = 0, len(at) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + block, "right")) - 1)
        yield _block(row, data[at[row] : at[stop]], at[row : stop + 1] - at[row], delimiter, _LOWER if fold else _SAME)
        row = stop


def _block(row: int, data: np.ndarray, at: np.ndarray, delimiter: np.ndarray, letters: np.ndarray) -> Words:
    n = len(data)
    inside = ~delimiter[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = _hashed(letters[data] if letters is not _SAME else data, start, end - start)
    return Words(row, hashes, np.searchsorted(start, at), start, end, data)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a and then b, linear in neither."""
    return mix(mix(a + U64(_BASE)) + b)


def codes_of(block: Words) -> np.ndarray:
    """A number for each word of the block, the same for two of them if and only if their bytes are the same."""
    size = block.end - block.start
    place = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(place[-1]) + np.repeat(block.start - place[:-1], size)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(place), pa.py_buffer(block.data[at])]).dictionary_encode().indices.to_numpy().astype(np.int64)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values of h, put together from those of powers of two."""
    size = max(0, len(h) - n + 1)
    out, done, span, part = np.full(size, n, U64), 0, 1, h
    while size and done < n:
        if n & span:
            out = pair(out, part[done : done + size])
            done += span
        span *= 2
        if done < n:
            part = pair(part[: len(part) - span // 2], part[span // 2 :])
    return out
