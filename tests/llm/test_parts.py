"""Parts of the operators on their own: round trips, damage, joins of encodings, automata, components."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import llm_brute as brute

from quillmark.llm import media
from quillmark.llm._graph import connected_components
from quillmark.llm.bpe import Bpe
from quillmark.llm.jaccard import Signatures, least_overlap, links_of, prefix_size, signature
from quillmark.llm.langid import Filter


@pytest.mark.parametrize("shape", [(1, 576), (7, 13), (40, 576)])
def test_png_round_trip_and_damage(shape):
    samples = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    png = media.png_encode(samples)
    assert (media.png_decode(png) == samples).all()
    broken = bytearray(png)
    broken[len(png) // 2] ^= 1
    with pytest.raises(ValueError):
        media.png_decode(bytes(broken))
    assert len(media.cosine_hash(samples)) == 8


@pytest.mark.parametrize("kind", range(5))
def test_every_png_filter_is_undone(kind):
    import struct
    import zlib

    image = np.random.default_rng(2).integers(0, 256, (6, 9)).astype(int)
    rows = b""
    for y in range(6):
        row = [kind]
        for x in range(9):
            a, b, c = image[y, x - 1] if x else 0, image[y - 1, x] if y else 0, image[y - 1, x - 1] if x and y else 0
            p = a + b - c
            row.append((image[y, x] - [0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(p - v))][kind]) % 256)
        rows += bytes(int(v) for v in row)
    png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 6, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(rows)) + media._chunk(b"IEND", b"")
    assert (media.png_decode(png) == image).all()


def test_bpe_joins_equal_the_library():
    bpe = Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(3)
    texts = ["a" * 5000, "=" * 3001, " " * 777 + "x"] + ["".join(r.choice(s) for _ in range(r.choice([1, 40, 700]))) for s in ("ab", "abcdefghijklmnopqrstuvwxyz", "the ing é日😀\n", "0123456789. ") for _ in range(40)]
    encode = bpe.encode
    want = brute.encoded([{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        ids = encode(t)
        assert (len(ids) // 4, brute.sha(ids)) == want[i][:2]
        assert bpe.decode(np.frombuffer(ids, "<u4")) == t.encode()


def test_ordinary_texts_are_encoded_up_the_tree():
    bpe = Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encode = bpe.encode
    encode("the unthinkably extraordinary word")
    assert bpe.joins > 5
    odd = ["", " ", "\n", "a\tb", "!\x1c", "!\x1c ?", "a\x1f\x1f", "x \x1c\n y", "…\n\n  z\u3000ß\t", "a  \n b\r\n\r\nc ", "it's\u00a0we'll 'S", "\t\t\t", "f\t\t", "1\x85 2\u2028 3"]
    want = brute.encoded([{"doc_id": i, "text": t} for i, t in enumerate(odd)])
    assert [(len(encode(t)) // 4, brute.sha(encode(t))) for t in odd] == [want[i][:2] for i in range(len(odd))]


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, k) for k in range(1001, 1100)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(80)] + [(5, 5), (None, 3)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent}


def test_signatures_never_lose_a_link():
    r = np.random.default_rng(5)
    pool = r.integers(1, 2**63, 5000).astype(np.uint64)
    base = [r.choice(pool, n, replace=False) for n in (3, 8, 40, 41, 900, 1030, 2500)]
    sets = [np.unique(np.concatenate([b[int(len(b) * cut) :], r.choice(pool, int(len(b) * cut) + 1)])) for b in base for cut in (0, 0.05, 0.1, 0.2, 0.3)]
    sets.sort(key=len)
    size = np.array([len(s) for s in sets])
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (size[i] + size[j] - n)}
    near = Signatures(size, [signature(s) for s in sets])
    assert want <= {(i, j) for i in range(len(sets)) for j in near.near(i).tolist()}
    assert want == {(i, j) for i, partners in links_of(size, sets) for j in partners.tolist()}
    assert all(n >= least_overlap(size[i], size[j]) for i, j in want for n in [len(np.intersect1d(sets[i], sets[j]))])
    assert prefix_size(4) == 2 and prefix_size(1) == 1


def test_filter_of_many_languages():
    grams = {f"l{k:03}": (np.arange(50) + 1000 * k + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in range(70)}
    made = Filter.of(grams)
    n, counts = made.counts(grams["l066"], np.zeros(50, np.int64), 1)
    assert n[0] == 50 and made.languages[int(counts[0].argmax())] == "l066" and counts.max() == pytest.approx(50)


def test_several_automata_equal_one(spark, edge_dir):
    from quillmark.llm._store import table
    from quillmark.llm.decontaminate import decontaminated, find_hits

    docs, items = table(spark, edge_dir, "documents"), table(spark, edge_dir, "benchmark")
    key = lambda r: (r.doc_id, r.n_words, str(r[2]), str(r.hit_items))
    one, many = (sorted(key(r) for r in find_hits(docs, items, most=m).select("doc_id", "n_words", "hits", "hit_items").collect()) for m in (10**6, 1))
    assert one == many
    assert decontaminated(docs.drop("hits"), items).columns == docs.drop("hits").columns


def test_words_of_sliced_columns():
    from quillmark.llm._words import words

    column = pa.array(["skip", None, "One  two", "", "x\x0by"]).slice(1)
    block = next(words(column))
    assert np.diff(block.first).tolist() == [0, 2, 0, 2]
    assert block.hashes[0] == next(words(pa.array(["ONE"]))).hashes[0]
