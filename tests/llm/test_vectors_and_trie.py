"""Near vectors, the conversation trie, spelling variants and positions, against brute force."""

import random

import numpy as np
import pyarrow.dataset as ds
import trie_brute
import variants_brute

from quillmark.llm import neighbours, queries, trie, variants


def rows_of(folder, name):
    return ds.dataset(f"{folder}/{name}.parquet").to_table().to_pylist()


def test_near_vectors_find_all_links_in_tiles_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((4, 16))
    made = np.concatenate([c + s * rng.standard_normal((150, 16)) for c, s in zip(centres, (0.05, 0.1, 0.2, 1))])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(made)]
    units = made / np.linalg.norm(made, axis=1, keepdims=True)
    linked = (units @ units.T >= 0.98) & (np.arange(600)[:, None] % 2 == np.arange(600)[None, :] % 2) & ~np.eye(600, dtype=bool)
    reach = linked | np.eye(600, dtype=bool)
    for _ in range(10):
        reach = reach @ reach
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = []
    for tile in (2048, 40):
        monkeypatch.setattr(neighbours, "TILE", tile)
        got = sorted(tuple(r) for r in neighbours.near_vectors(df).collect())
        found.append(got)
        links, known = sum(r[1] for r in got), linked.sum()
        assert 0.999 * known <= links <= known and links > 4000
        assert all(r[2] >= reach[r[0]].argmax() and r[3] == (r[0] == r[2]) for r in got)
    assert found[0] == found[1]
    kept = neighbours.keep_one_of_each(df.withColumnRenamed("label", "label")).collect()
    assert sorted(r.vec_id for r in kept) == [r[0] for r in found[0] if r[3]] and set(kept[0].asDict()) == {"vec_id", "embedding", "label"}


def test_tables_grow_with_the_bits(spark):
    for n in (1, 2, 500, 10**5, 10**9, 10**12):
        shape = neighbours.shape_for(n)
        assert 2 ** min(62, shape.bits) >= n and shape.tables >= 1
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** shape.bits) ** shape.tables <= neighbours.MISS * 1.0001


def test_trie_equals_brute_force_however_long_rows_are(spark, data_dir):
    talks, df = rows_of(data_dir, "conversations"), spark.read.parquet(f"{data_dir}/conversations.parquet")
    want = trie_brute.trie(talks)
    for size in (trie.SEGMENT, 2):
        got = trie.prefix_trie(df, size).collect()
        assert len(got) == len(want)
        for r in got:
            assert tuple(r)[3:] == want[(r.conv_id, r.depth)][1:] and r.parent_conv_id == want[(r.conv_id, r.depth)][0], (r, size)


def test_trie_is_the_same_over_any_blocks(spark):
    rng = random.Random(5)
    rows = [(c, k, rng.choice("ua"), rng.choice(["x", "yy"])) for c in range(150) for k in range(rng.choice([1, 2, 3, 8]))]
    df, want = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), trie_brute.trie([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("9", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = trie.prefix_trie(df, 3).collect()
            assert {(r.conv_id, r.depth): (r.parent_conv_id, *tuple(r)[3:]) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_variants_equal_brute_force(spark, data_dir):
    got = queries.QUERIES["op13_spelling_variants"](spark, data_dir).collect()
    assert {r.word: tuple(r)[1:] for r in got} == variants_brute.variants(rows_of(data_dir, "documents"))
    assert len({r.word for r in got}) == len(got)


def test_variants_follow_forms_of_forms(spark):
    words = {"abcdefgh": 300, "abcdefg": 30, "abcxefg": 2, "abcxefgé": 2, "hgfedcba": 2, "abdcefgh": 2, "ÀBCDEFGH": 40, "ccccccc": 2, "cccccccc": 2, "a" * 3000: 2, "a" * 2999 + "b": 20}
    docs = [(i, f"{w} 1{w}2 " * (n // 2)) for i, (w, n) in enumerate(words.items())] + [(50, None), (None, "abcdefg " * 5), (51, ""), (52, "short ab")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", variants.F.lit("clash")).withColumn("n", variants.F.lit(1))
    got = {r.word: r for r in variants.spelling_variants(df, garbled=1 << 40).collect()}
    assert {w: r.n for w, r in got.items()} == {variants_lower(w): n for w, n in words.items()}
    assert got["abcxefg"].form == "abcdefg" and got["abcxefg"].root == "abcdefgh" and got["abcxefg"].form_n == 30
    assert got["abcxefgé"].n_near == 1 and got["abcxefgé"].form is None and got["abcxefgé"].root == "abcxefgé"
    assert got["hgfedcba"].n_near == 0 and got["abdcefgh"].n_near == 0 and got["a" * 3000].form == "a" * 2999 + "b"
    assert got["ccccccc"].n_near == got["cccccccc"].n_near == 1


def variants_lower(word):
    return "".join(c.lower() if c.isascii() else c for c in word)
