"""Media columns: texts stored as PNG images, read back with checks, and hashed by low-frequency cosine transforms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm._store import table, written

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK = 1 << 16


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_encode(samples: np.ndarray) -> bytes:
    """An 8-bit greyscale PNG of a two-dimensional uint8 array; each row takes the filter (none, sub, up) of least effort."""
    height, width = samples.shape
    sub, up = samples.copy(), samples.copy()
    sub[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    tried = np.stack([samples, sub, up])
    effort = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = effort.argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = best, tried[best, np.arange(height)]
    packed = zlib.compress(rows.tobytes(), 1)
    data = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + data + _chunk(b"IEND", b"")


def png_chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each chunk, after its checksum was tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG: wrong signature")
    at, kind = 8, b""
    while kind != b"IEND":
        if at + 12 > len(png):
            raise ValueError("PNG ends within a chunk")
        size, kind = struct.unpack_from(">I4s", png, at)
        body = png[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"PNG chunk {kind!r} fails its checksum")
        yield kind, body
        at += 12 + size


def _predict(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undoes the average (3) or Paeth (4) filter, whose pixels depend on each other."""
    out, left, corner = np.empty_like(row), 0, 0
    for x, (value, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        if kind == 3:
            guess = (left + b) // 2
        else:
            p = left + b - corner
            guess = min((left, b, corner), key=lambda v: abs(p - v))
        out[x] = left = (value + guess) & 255
        corner = b
    return out


def png_decode(png: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlace; fails on any damage."""
    header, packed = None, []
    for kind, body in png_chunks(png):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit greyscale PNG without interlace is read")
    width, height = header[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(rows) != height * (width + 1):
        raise ValueError("PNG has the wrong number of samples")
    rows = rows.reshape(height, width + 1)
    out, above = np.empty((height, width), np.uint8), np.zeros(width, np.uint8)
    for y, kind in enumerate(rows[:, 0].tolist()):
        row = rows[y, 1:]
        if kind == 0:
            out[y] = row
        elif kind == 1:
            np.cumsum(row, dtype=np.uint8, out=out[y])
        elif kind == 2:
            np.add(row, above, out=out[y])
        elif kind in (3, 4):
            out[y] = _predict(kind, row, above)
        else:
            raise ValueError(f"PNG has an unknown filter {kind}")
        above = out[y]
    return out


_COSINES = np.cos(np.pi * np.outer(np.arange(8), np.arange(32) + 0.5) / 32)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine frequencies of the image, shrunk to 32 x 32, exceed their median."""
    height, width = samples.shape

    def shrink(x: np.ndarray, n: int) -> np.ndarray:
        edges = np.arange(33) * n // 32
        if n < 32:
            return x[edges[:-1]]
        return np.add.reduceat(x, edges[:-1], axis=0) / np.diff(edges)[:, None]

    small = shrink(shrink(samples.astype(np.float64), height).T, width).T
    low = np.round(_COSINES @ small @ _COSINES.T, 4).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(data: bytes) -> bytes:
    """data with bytes 255 appended up to a positive multiple of WIDTH."""
    return data + b"\xff" * (-len(data) % WIDTH if data else WIDTH)


def to_media(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, n_bytes and the binary column media: each whole text's UTF-8 bytes, padded, as a PNG of WIDTH columns.

    A null text counts as an empty one, whose image is one row of padding. Repeated rows stay; no rows give none;
    other columns are ignored. A text takes a few times its own size in memory.
    """
    return docs.select("doc_id", column).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        media = [png_encode(np.frombuffer(payload_of(t or b""), np.uint8).reshape(-1, WIDTH)) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def media_features(media: DataFrame) -> DataFrame:
    """Reads the images of to_media back: the digests of payload and image, and the cosine hash as hex and as binary.

    A null or damaged image is an error; repeated rows stay; no rows give none; other columns are ignored.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read_back, FEATURES)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for png in batch.column("media").to_pylist():
            samples = png_decode(png)
            payload, bits = samples.tobytes(), cosine_hash(samples)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), bits.hex(), bits))
        made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, KINDS, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *made], NAMES)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, feature_bits binary"


KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "feature_bits"]


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_features of every document's image, after the table of images was written and read back."""
    return media_features(written(to_media(table(spark, sf_dir, "documents"))))
