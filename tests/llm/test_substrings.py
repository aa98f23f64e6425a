"""Substring dedup: depths of subtrees, prefixes dealt into shares, words made to collide in weaker hashes, and rows of equal doc_id."""

import random

import llm_brute as brute
import numpy as np
import pyarrow as pa
import pytest

from quillmark.llm import substrings


def judged(spark, rows, parts=3):
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted(((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept)) for r in substrings.dedup_substrings(made).collect()), key=str)


def wanted(rows):
    """The contract word for word, where rows of one doc_id may have several texts."""
    first, out = {}, []
    words = [(i, brute.SPACE_WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - 49) if i is not None else ():
            x = tuple(w[k : k + 50])
            first[x] = min(i, first.get(x, i))
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out.append((i, len(w), sum(gone), brute.sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_words_that_collide_in_a_polynomial(spark):
    a, b = ("".join("ab"[x ^ flip] for x in thue_morse(1024)) for flip in (0, 1))
    common = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*common[:30], a, *common[30:]])), (2, " ".join([*common[:30], b, *common[30:]]))]
    assert judged(spark, rows) == wanted(rows)
    assert all(x[2] == 0 for x in wanted(rows))


def test_rows_of_equal_doc_id(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(n)) for p, n in (("x", 70), ("y", 90), ("z", 55)))
    rows = [(5, a), (5, f"{b} {a}"), (5, "short"), (5, None), (5, a), (7, f"{c} {a}"), (7, b), (9, c), (3, c)]
    assert judged(spark, rows) == wanted(rows)


def corpus(n):
    r = random.Random(8)
    passages = [[f"{p}w{r.randrange(400)}" for _ in range(r.randrange(50, 130))] for p in "abc"] + [["same"] * 200, ["one", "two"] * 60]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(1, 4)):
            passage = r.choice(passages)
            cut = r.randrange(0, len(passage) // 3)
            w += [f"own{i}x{k}" for k in range(r.randrange(0, 40))] + passage[cut:]
        if r.random() < 0.4:
            w[r.randrange(len(w))] = f"changed{i}"
        rows.append((r.randrange(2 * n), " ".join(w)))
    return rows


@pytest.mark.parametrize(("group", "piece"), [(20_000, 1_000), (30, 7)])
def test_hot_prefixes_in_shares(spark, monkeypatch, group, piece):
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "PIECE", piece)
    rows = [*corpus(90), (None, " ".join(["same"] * 80)), (400, None)]
    assert judged(spark, rows, 4) == wanted(rows)


def test_depths_of_subtrees():
    r = random.Random(9)
    texts = [[r.choice("ab") for _ in range(r.randrange(50, 80))] for _ in range(12)]
    texts += [t[:55] + ["end"] for t in texts if len(t) > 56]
    n, group = np.array([len(t) - 49 for t in texts]), np.array([k % 2 for k in range(len(texts))])
    order = np.argsort(group, kind="stable")
    texts, n, group = [texts[k] for k in order], n[order], group[order]
    tree = substrings.Subtrees(pa.array([" ".join(t).encode() for t in texts], pa.binary()), n, group)
    first = tree.block.first
    suffix = [(int(tree.row[x]), texts[tree.row[x]][x - first[tree.row[x]] :]) for x in tree.leaf.tolist()]
    assert len(suffix) == n.sum()
    for (i, a), (j, b), depth in zip(suffix, suffix[1:], tree.depths().tolist()):
        shared = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) if group[i] == group[j] else 0
        assert min(shared, 63) == min(depth, 63)
