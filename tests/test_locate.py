"""Automata against plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import locate


@pytest.mark.parametrize("lane", [1, 7, 4096])
def test_all_occurrences_are_found(lane):
    rng = random.Random(lane)
    patterns = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 5, 9]))).encode() for _ in range(25)} | {b"abab", b"bab", "é日".encode()})
    texts = [("".join(rng.choice("abc") for _ in range(n)) + "é日é日").encode() for n in (0, 1, 5, 60, 200)] + [b"", b"abab" * 30]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, which, place = locate.matches(locate.automaton(patterns), np.frombuffer(b"".join(texts), np.uint8), at, lane)
    got = sorted(zip(row.tolist(), which.tolist(), (place - at[row]).tolist()))
    assert got == sorted((i, k, s) for i, t in enumerate(texts) for k, p in enumerate(patterns) for s in range(len(t)) if t.startswith(p, s))


def test_no_patterns_match_nothing():
    assert [len(x) for x in locate.matches(locate.automaton([]), np.frombuffer(b"abc", np.uint8), np.array([0, 3]))] == [0, 0, 0]


@pytest.mark.parametrize("bytes_", [4_000_000, 20])
def test_places_equal_a_plain_search(spark, monkeypatch, bytes_):
    monkeypatch.setattr(locate, "PATTERN_BYTES", bytes_)
    texts = [(1, "ein schöner Tag für alle, ein Tag"), (2, "Tag"), (3, None), (4, ""), (5, "日本語 " * 3000 + "Tag ein"), (1, "another ein")]
    items = [("a", "Tag"), ("b", "ein"), ("c", "ein"), ("d", None), ("e", ""), ("f", "nirgends"), ("g", "für alle"), ("g", "語 日"), ("h", "本" + "語 日本" * 50)]
    found = locate.first_places(spark.createDataFrame(texts, "doc_id long, text string").withColumn("box", F.lit("x")), spark.createDataFrame(items, "item string, text string"), "doc_id", "item").collect()
    want = {(i, k, t.index(w) + 1) for i, w in items if w for k, t in texts if t and w in t}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert locate.first_places(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item string, text string"), "doc_id", "item").collect() == []
    assert locate.first_places(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([], "item string, text string"), "doc_id", "item").collect() == []


def test_an_audit_names_its_reason(spark):
    items = spark.createDataFrame([(1, "long enough to be used"), (2, "short"), (3, "nowhere to be found")], "item int, text string")
    texts = spark.createDataFrame([(9, "x short long enough to be used"), (8, "short")], "doc_id long, text string")
    rows = locate.audited(items, locate.first_places(texts, items, "doc_id", "item"), "item", "doc_id", F.when(F.length("text") < 10, F.array(F.lit("brief"))))
    assert {r.item: tuple(r)[1:] for r in rows.collect()} == {1: (9, 9, "eligible_body", "exact_source_match_within_verified_work_body"), 2: (8, 1, "exclude_or_review", "brief"), 3: (None, None, "exclude_or_review", "no_exact_match_in_archived_edition")}
