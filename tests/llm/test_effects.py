"""What the operators do to texts: cuts of benchmark passages, redaction, image features, lines of equal doc_id."""

import zlib

import llm_brute as brute
import numpy as np
import pytest

from quillmark.llm import decontaminate, jaccard, lines, media, pii

ITEM = [f"item{i}" for i in range(25)]
SHORT = ["one", "short", "item"]


def cut(spark, texts):
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, hits string")
    items = spark.createDataFrame([(1, " ".join(ITEM)), (2, " ".join(SHORT)), (3, None)], "item_id long, text string")
    done = decontaminate.decontaminated(docs, items)
    assert done.columns == docs.columns
    both_steps = decontaminate.cut_hits(decontaminate.find_hits(docs.drop("hits"), items))
    assert sorted(map(str, done.drop("hits").collect())) == sorted(map(str, both_steps.collect()))
    assert {r.hits for r in done.collect()} == {"x"}
    return {r.doc_id: (r.text, r.n_chars) for r in done.collect()}


def test_cuts_of_benchmark_passages(spark):
    passage, short = ", ".join(ITEM), " ".join(SHORT)
    texts = [
        f"Before {passage.upper()}! After it.", "Nothing here.", None, "", f"Many words stand around {short}, which stays as it is short.",
        f"{short}!", f"Ä {' '.join(ITEM[:10])} ß {' '.join(ITEM[5:15])} end", " ".join(ITEM[:9]) + " and other words", passage,
    ]
    got = cut(spark, texts)
    assert got[0] == ("Before ! After it.", len("Before ! After it."))
    assert got[1] == (texts[1], len(texts[1])) and got[2] == (None, None) and got[3] == ("", 0)
    assert got[4] == (texts[4], len(texts[4])) and got[7] == (texts[7], len(texts[7]))
    assert got[5] == ("!", 1) and got[8] == ("", 0)
    assert got[6][0] == "Ä  ß  end"


@pytest.mark.parametrize("word", ["thue", "zero"])
def test_words_that_collide_in_a_polynomial_are_not_hit(spark, word):
    if word == "thue":
        a, b = ("".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(1024)) for flip in (0, 1))
    else:
        a, b = "x", "\0x"
    docs = spark.createDataFrame([(1, f"{a} p q"), (2, f"{b} p q"), (3, a)], "doc_id long, text string")
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    if word == "thue":
        got = {r.doc_id: len(r.hits) for r in decontaminate.find_hits(docs, items).collect()}
        assert got == {1: 1, 2: 0, 3: 1}
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs.unionByName(spark.createDataFrame([(4, b)], docs.schema))).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_redaction(spark):
    texts = [f"zorro wrote from Ann@x.org and +49 30 1234 5678 card 4111 1111 1111 1111, case {i}" for i in range(6)] + ["only zorro here", None, ""] + [f"the usual words of every text {i}" for i in range(300)]
    docs = spark.createDataFrame([(i % 8, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = [r.text for r in pii.redact(docs).collect()]
    assert len(got) == len(texts) and got[6] == "only [...] here" and got[7] is None and got[8] == ""
    assert got[9:] == texts[9:]
    assert all("[EMAIL]" in t and "[PHONE]" in t and "[CARD]" in t and "zorro" not in t and "@" not in t for t in got[:6])
    assert pii.redact(docs.limit(0)).collect() == []
    assert pii.replaced("abcdefg", [("card", 1, 4), ("phone", 2, 5), ("term", 5, 6)]) == "a[CARD][...]g"


def test_features_of_images(spark):
    texts = ["", "x" * 40_000, " ".join(f"w{i}" for i in range(9000)), "ß" * 700, None, "x" * 40_000]
    rows = {r.doc_id: r for r in media.media_features(media.to_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert rows[1].feature == rows[5].feature and rows[0].media_sha256 == rows[4].media_sha256
    for i, text in enumerate(texts):
        data = (text or "").encode()
        data += b"\xff" * (-len(data) % 576 if data else 576)
        image = np.frombuffer(data, np.uint8).reshape(-1, 576).astype(float)
        height = len(image)
        edges = lambda n: [(k * n // 32, max((k + 1) * n // 32, k * n // 32 + 1)) for k in range(32)]
        small = np.array([[image[a:b, c:d].mean() for c, d in edges(576)] for a, b in edges(height)])
        low = [[sum(small[y, x] * np.cos(np.pi * v * (y + 0.5) / 32) * np.cos(np.pi * u * (x + 0.5) / 32) for y in range(32) for x in range(32)) for u in range(8)] for v in range(8)]
        low = np.round(np.array(low), 4).ravel()
        bits = low > np.median(low[1:])
        assert bytes(rows[i].feature_bits).hex() == rows[i].feature
        far = np.abs(low - np.median(low[1:])) > 1e-3
        assert (np.unpackbits(np.frombuffer(rows[i].feature_bits, np.uint8)).astype(bool) == bits)[far].all()
        png = media.png_encode(image.astype(np.uint8))
        assert rows[i].media_bytes == len(png) and rows[i].media_sha256 == brute.sha(png) and zlib.crc32(data[-32:]) == rows[i].tail_crc32


def test_lines_of_rows_with_equal_doc_id(spark):
    block = "\n".join(f"line {k}" for k in range(30))
    rows = [(1, f"own a\n{block}"), (1, "short"), (1, f"own b\nown c\n{block}"), (2, block), (2, None), (3, ""), (None, block), (1, f"own a\n{block}")]
    done = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(done) == len(rows)
    by = sorted(((r.doc_id, r.n_lines, r.n_removed) for r in done if r.doc_id is not None and r.n_lines == 31))
    assert by == [(1, 31, 0), (1, 31, 0)]
    assert [r.n_removed for r in done if r.doc_id is None] == [0]
    assert [r.n_removed > 20 for r in done if r.doc_id == 2 and r.n_lines] == [True]
