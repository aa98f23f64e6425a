import os

import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, part string, rep long, hits string, anchors long, score string, spans string"
WORDS = [f"w{i * i % 97}x{i}" for i in range(400)]
PASSAGE = " ".join(WORDS[100:170])


def texts() -> list[str | None]:
    near = WORDS[:60]
    return [
        None, "", " \t\n\x0b\x0c\r ", "!!! ???", "one", "One two THREE", "one two three",
        " ".join(near), " ".join(near), " ".join([*near[:-1], "other"]), " ".join([*near[:-2], "changed", "end"]), "\n".join(near),
        "start " + PASSAGE + " stop", "Other " + PASSAGE + " End here", PASSAGE, " ".join(WORDS[:50]), " ".join(WORDS[:49]),
        "line a\nline b\nline c\nline d\nline e\nline f\nline g\nline h", "line a\nline b\nline c\nline d\nline e\nline f\nline g\nline h", "x\nline a\nline b\nline c\nline d\nline e\nline f\nline g\nline h\ny",
        "Das ist ein schöner Tag für über hundert Übungen", "It is a truth universally acknowledged that it is so", "日本語 テキスト 123 é ß 😀",
        "mail Me.X+1@ex-ample.co.uk now or a@b or x@y.z.. card 4111 1111 1111 1111, 4111111111111112; ip 10.0.0.255 999.1.1.1 1.2.3.4.5.6.7.8 phone +49 (30) 1234-5678 +1 2",
        "a" * 3000, "word " * 30_000, "😀" * 576, "x" * 576, ("ab cd\n" * 20_000) + "end", "it's 10 o'clock… we'll  go\n\n\n now then",
        "zeta alpha beta gamma delta eps one two three four nine ten", "alpha beta gamma", "1234567890" * 30 + " tail",
    ]


VECTORS = "vec_id long, embedding array<float>, label int, node string, key int, links long"
TALKS = "conv_id long, turn long, role string, text string, block int, segment string, n long"


def vectors():
    one = [0.5, 1.0, -2.0, 0.25]
    near = [0.5, 1.0, -2.0, 0.3]
    rows = [(3, one, 1), (1, near, 1), (2, one, 1), (2, one, 1), (4, one, 2), (5, one, None), (None, one, 1), (6, [0.0] * 4, 1), (7, [None, 1.0, 2.0, 3.0], 1), (8, [float("nan"), 1.0, 2.0, 3.0], 1), (9, [float("inf"), 1.0, 2.0, 3.0], 1)]
    rows += [(10, [], 1), (11, None, 1), (12, [2e38 * x for x in one], 1), (13, [-x for x in one], 1), (14, one[:3], 1), (-1, [1e-38 * x for x in near], 2)]
    return rows + [(100 + i, [1.0 + 0.002 * i, 0.001 * (i % 7), 1.0, 0.0], 3) for i in range(60)]


def talks():
    hot = [("u", "first"), ("a", None), ("u", "third é😀"), (None, "fourth"), ("u", ""), ("a", "sixth"), ("u", "seventh")]
    rows = [(c, None if k == 0 and c % 3 == 0 else k, *hot[k]) for c in range(120) for k in range(1 + c * 5 % 7)]
    rows += [(c, k, "u" if k % 2 else "a", f"turn {min(k, c)}") for c in (200, 201, 305, 1007) for k in range(9 + c % 3)]
    return rows + [(7, 0, "u", "again"), (7, 0, "u", "again"), (None, 1, "u", "none"), (400, None, None, None), (401, 5, "u", "x" * 5000), (-3, 0, "u", "below zero"), *((500 + c, k, "u", f"long {k}") for c in range(3) for k in range(300 + c % 2 * 300))]


def write(spark, folder, docs, items, pages, vectors=(), talks=()):
    spark.createDataFrame([(*r, "n", 1, 2) for r in vectors], VECTORS).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(*r, 1, "s", 2) for r in talks], TALKS).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    clash = {"n": F.lit(5).cast("long"), "key": F.lit("k"), "part": F.lit("p"), "rep": F.lit(1).cast("long"), "hits": F.lit("h"), "anchors": F.lit(2).cast("long"), "score": F.lit("s"), "spans": F.lit("t")}
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash)
    rows.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names clash."""
    docs = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts())]
    docs += [docs[7], (500, "null language", None, None, 13)]
    items = [(0, PASSAGE), (1, None), (2, ""), (3, "Alpha, beta gamma!"), (4, " ".join(WORDS[100:111])), (4, "word word word"), (5, "nine")]
    link = '<html><head><link rel="canonical" href="{}"></head></html>'
    pages = [
        (0, "http://A.Example.org/es/1?q", ""), (1, "https://mirror.net/x#y", link.format("http://a.example.org/es/9")), (2, "https://deep.net/", '<META http-equiv="refresh" content="0; url=https://mirror.net/x#y">'),
        (3, "http://ok.com/fr/p", link.format("https://mirror.net/x#y")), (4, "http://free.net/a", None), (5, None, link.format("http://b.com/de/")), (6, "no scheme", ""), (7, "http://org", ""), (8, "http://www.example.org/en/12", ""),
        (9, "http://x.net/p", "<link href=/q rel='canonical'>"), (10, "http://x.net/q", "<link rel=canonical href=//bad.com/de/1>"), (10, "http://x.net/q", ""), (11, "://x.org/", ""),
    ]
    return write(spark, str(tmp_path_factory.mktemp("edge")), docs, items, pages, vectors(), talks())


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("empty")), [], [], [])


@pytest.fixture(scope="session", params=["edge", "sf"])
def data_dir(request, edge_dir):
    if request.param == "edge":
        return edge_dir
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data here")
    return "/root/testdata/sf0.001"
