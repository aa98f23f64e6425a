"""The language model of several orders against interpolated modified Kneser-Ney in plain Python."""

import math
from collections import Counter, defaultdict

import pytest

from quillmark.llm import lm

TEXTS = ["a b a c b a c d", "b a b d d a c b", "a b", None, "c a b b a c", "d a c d a c e", "a b a c b"] * 2 + ["f g a b", "a", "e e e a c"]
NEW = ["a b a c e", "g a c d d", None, "never a b", "c a b"]


def brute(texts, new, order):
    """log10 of the probability of each new text."""
    padded = lambda t: ["<"] * (order - 1) + (t or "").split() + [">"]
    counts = {order: Counter(tuple(p[i : i + order]) for p in map(padded, texts) for i in range(len(p) - order + 1))}
    raw = counts[order]
    for k in range(order - 1, 0, -1):
        shorter, kinds = Counter(), Counter(g[1:] for g in raw)
        for g, n in raw.items():
            shorter[g[1:]] += n
        raw = shorter
        counts[k] = {g: n if k > 1 and g[0] == "<" else kinds[g] for g, n in raw.items()}
    cuts = {k: (0, *lm.discounts(*(sum(n == j for n in counts[k].values()) for j in (1, 2, 3, 4)))) for k in counts}
    after = {k: defaultdict(list) for k in counts}
    for k in counts:
        for g, n in counts[k].items():
            after[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        ns = after[k].get(g[:-1])
        if not ns:
            return p(g[1:])
        n = counts[k].get(g, 0)
        cut = lambda n: cuts[k][min(n, 3)]
        return (max(n - cut(n), 0) + sum(map(cut, ns)) * p(g[1:])) / sum(ns)

    return [sum(math.log10(p(tuple(x[i : i + order]))) for i in range(len(x) - order + 1)) for x in map(padded, new)]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_brute_force(spark, order):
    frame = lambda xs: spark.createDataFrame(list(enumerate(xs)), "doc_id long, text string")
    model = lm.fit(frame(TEXTS).repartition(3), order)
    got = [r.score for r in lm.score(frame(NEW), model).orderBy("doc_id").collect()]
    assert got == pytest.approx(brute(TEXTS, NEW, order), abs=1e-6)


def test_the_registered_order_counts_trigrams(spark):
    assert len(lm.fit(spark.createDataFrame([("a b c",)], "text string")).longer) == 1
