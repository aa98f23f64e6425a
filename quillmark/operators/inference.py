"""Paired resampling: bootstrap over works and passages, and a permutation test that swaps whole works."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.ranks import positions
from quillmark.sources.io import settled


def macro_f1(confusion: np.ndarray) -> np.ndarray:
    """Of a stack of confusion matrices: the mean F1 of all labels, 0 for one that neither occurs nor is predicted."""
    both = confusion.sum(axis=-1) + confusion.sum(axis=-2)
    return (2 * np.einsum("...kk->...k", confusion) / np.maximum(both, 1)).mean(axis=-1)


def _cells(y: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
    return np.bincount(y * k + p, minlength=k * k).reshape(k, k)


def paired_loss(rows: pd.DataFrame, labels: list[str], replicates: int, permutations: int, seed: int) -> dict[str, float | int]:
    """Loss of macro F1 from `original` to `rewrite` predictions of the same passages.

    The bootstrap draws each author's works, then each drawn work's passages, with replacement. The test swaps both
    predictions of whole works; its p-value counts losses as extreme as the observed one, and the observed one itself.
    """
    code = {a: i for i, a in enumerate(labels)}
    rows = rows.sort_values(["author", "work", "doc_id"])
    y, o, r = (rows[c].map(code).to_numpy() for c in ("author", "original", "rewrite"))
    k = len(labels)
    groups = [np.asarray(v) for _, v in sorted(rows.reset_index(drop=True).groupby(["author", "work"]).indices.items())]
    owner = np.array([y[g[0]] for g in groups])
    observed = float(macro_f1(_cells(y, o, k)) - macro_f1(_cells(y, r, k)))
    rng = np.random.default_rng(seed)
    losses = np.empty(replicates)
    for b in range(replicates):
        drawn = np.concatenate([rng.choice(groups[g], size=len(groups[g])) for a in range(k) if (own := np.flatnonzero(owner == a)).size for g in rng.choice(own, size=len(own))])
        losses[b] = macro_f1(_cells(y[drawn], o[drawn], k)) - macro_f1(_cells(y[drawn], r[drawn], k))
    per_o, per_r = (np.array([_cells(y[g], p[g], k) for g in groups]) for p in (o, r))
    extreme = 0
    for at in range(0, permutations, 1000):
        swap = rng.integers(0, 2, size=(min(1000, permutations - at), len(groups), 1, 1))
        null = macro_f1(np.where(swap, per_r, per_o).sum(axis=1)) - macro_f1(np.where(swap, per_o, per_r).sum(axis=1))
        extreme += int((np.abs(null) >= abs(observed) - 1e-12).sum())
    low, high = np.quantile(losses, [0.025, 0.975]) if replicates else (np.nan, np.nan)
    return {"passages": len(rows), "works": len(groups), "original_f1": float(macro_f1(_cells(y, o, k))), "rewrite_f1": float(macro_f1(_cells(y, r, k))), "loss": observed, "ci_low": float(low), "ci_high": float(high), "p_value": (extreme + 1) / (permutations + 1)}


FIELDS = "passages long, works long, original_f1 double, rewrite_f1 double, loss double, ci_low double, ci_high double, p_value double"


def paired_inference(pairs: DataFrame, by: list[str], labels: list[str], works: int, replicates: int = 1000, permutations: int = 999, seed: int = 20260915) -> DataFrame:
    """by, status and the fields of paired_loss for every group of pairs (author, work, doc_id, original, rewrite).

    A group that lacks a label or has fewer works than planned is not_estimable, with null figures. A group is one
    comparison, whose rows must fit into a task.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ok = set(group["author"]) == set(labels) and len(group[["author", "work"]].drop_duplicates()) == works
        found = paired_loss(group, labels, replicates, permutations, seed) if ok else dict.fromkeys(names)
        return pd.DataFrame([{**{c: group[c].iloc[0] for c in by}, "status": "estimable" if ok else "not_estimable", **found}])

    return pairs.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + f", status string, {FIELDS}")


def _generator(seed: int, *node) -> np.random.Generator:
    return np.random.default_rng([seed, int.from_bytes(blake2b(repr(node).encode(), digest_size=16).digest(), "little")])


def tree_counts(total: np.ndarray, n: int, wanted: np.ndarray, seed: int, *tag) -> Iterator[tuple[int, np.ndarray]]:
    """(place, counts) of the wanted places (ascending) when total draws, one number a replicate, fall on n places alike.

    Each node of a binary tree over the places splits its draws by binomials that its own name seeds, so that whoever
    asks for a place, and with whichever others, gets the same exact multinomial counts in a logarithmic number of steps.
    """
    stack = [(0, n, total, wanted)]
    while stack:
        low, high, count, asked = stack.pop()
        if not len(asked):
            continue
        if high - low == 1:
            yield low, count
            continue
        middle = (low + high) // 2
        left = _generator(seed, *tag, low, high).binomial(count, (middle - low) / (high - low))
        stack.append((middle, high, count - left, asked[asked >= middle]))
        stack.append((low, middle, left, asked[asked < middle]))


def passage_weights(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, weights of all replicates) of placed passages, as bootstrap_weights places them."""
    if not batch.num_rows:
        return
    replicates, seed = batch.column("replicates")[0].as_py(), batch.column("seed")[0].as_py()
    columns = {c: batch.column(c).to_pylist() for c in ("author", "work", "place", "size", "work_place", "works")}
    authors: dict = {}
    for i, (author, work) in enumerate(zip(columns["author"], columns["work"])):
        authors.setdefault(author, {}).setdefault((columns["work_place"][i] - 1, work), []).append(i)
    for author, works in authors.items():
        n = columns["works"][next(iter(works.values()))[0]]
        named = {place: (work, rows) for (place, work), rows in works.items()}
        for place, draws in tree_counts(np.full(replicates, n), n, np.array(sorted(named)), seed, "works", author):
            work, rows = named[place]
            at: dict[int, list[int]] = {}
            for i in rows:
                at.setdefault(columns["place"][i] - 1, []).append(i)
            size = columns["size"][rows[0]]
            for own, weights in tree_counts(draws * size, size, np.array(sorted(at)), seed, "passages", author, work):
                for i in at[own]:
                    yield i, weights


def bootstrap_weights(passages: DataFrame, replicates: int, seed: int = 20260922, placed: bool = False) -> DataFrame:
    """(replicate, doc_id, weight): how often each passage of (author, work, doc_id) is drawn, works first, then passages.

    Of an author's works as many are drawn as there are, and for each draw as many of its passages as it has. With placed,
    instead of a row for every draw, one a passage: its place in its work, its work's among the author's and how many
    there are, from which weighted_f1 draws the weights in the task that holds the passage. The weights depend on these
    places, replicates and seed alone, not on how rows are dealt; no row or task holds a whole work. Places go by doc_id
    and work; a doc_id that occurs twice has two places.
    """
    rows = positions(passages.select("author", "work", "doc_id"), ["doc_id"], ["author", "work"], "place")
    sizes = settled(rows.groupBy("author", "work").agg(F.count("*").alias("size")))
    counts = sizes.groupBy("author").agg(F.count("*").alias("works")).select(F.col("author").alias("__a"), "works")
    works = positions(sizes, ["work"], ["author"], "work_place").join(counts, F.col("author").eqNullSafe(F.col("__a"))).select(F.col("author").alias("__a"), F.col("work").alias("__w"), "size", "work_place", "works")
    recipe = rows.join(works, F.col("author").eqNullSafe(F.col("__a")) & F.col("work").eqNullSafe(F.col("__w"))).drop("__a", "__w").withColumns({"replicates": F.lit(replicates), "seed": F.lit(seed).cast("long")})
    if placed:
        return recipe
    kind = dict(recipe.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for i, weights in passage_weights(batch):
                drawn = np.flatnonzero(weights)
                yield pa.RecordBatch.from_arrays([pa.array(drawn, pa.int64()), ids.take(pa.array(np.full(len(drawn), i))), pa.array(weights[drawn], pa.int64())], ["replicate", "doc_id", "weight"])

    return recipe.mapInArrow(run, f"replicate long, doc_id {kind}, weight long")


def halves(values: np.ndarray) -> np.ndarray:
    """Extended doubles as the nearest doubles, and after them what these leave."""
    high = values.astype(float)
    return np.concatenate([high, (values - high).astype(float)])


def whole(values: np.ndarray) -> np.ndarray:
    """What halves took apart."""
    high, low = np.split(np.asarray(values), 2)
    return high.astype(np.longdouble) + low


def summed_arrays(parts: DataFrame, keys: list[str], column: str, extended: bool = False) -> DataFrame:
    """keys and the sums, element by element, of the arrays of column; a task holds one array a key at a time.

    extended: the arrays are halves, and so are the sums, which then hardly depend on the order of their parts.
    """
    fields = ", ".join(f"`{c}` {t}" for c, t in parts.select(*keys, column).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = total = None
        out = lambda: pa.RecordBatch.from_arrays([*(c.slice(0, 1) for c in now.columns[:-1]), pa.array([halves(total) if extended else total], now.schema.field(column).type)], schema=now.schema)
        for batch in batches:
            named = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            for i, key in enumerate(named):
                values = np.asarray(batch.column(column)[i].values)
                values = whole(values) if extended else values
                if now is not None and key == held:
                    total = total + values
                else:
                    if now is not None:
                        yield out()
                    now, total, held = batch.slice(i, 1), values, key
        if now is not None:
            yield out()

    rows = parts.select(*keys, column)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys) if keys else rows.coalesce(1)
    return dealt.mapInArrow(run, fields)


def added_up(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """keys and sums (halves of the number of rows, of their values and of their squares, as extended doubles) of batches of keys and values, arrays of one length; given out whenever they reach `most` bytes."""
    sums: dict[tuple, np.ndarray] = {}
    types: list[pa.DataType] = []
    out = lambda: pa.RecordBatch.from_arrays([*(pa.array(list(k), t) for k, t in zip(zip(*sums), types)), pa.array([halves(v) for v in sums.values()], pa.list_(pa.float64()))], [*keys, "sums"])
    held = 0
    for batch in batches:
        types = [batch.schema.field(c).type for c in keys]
        named = list(zip(*(batch.column(c).to_pylist() for c in keys)))
        values = np.asarray(batch.column("values").flatten()).reshape(len(named), -1).astype(np.longdouble) if named else ()
        for key, x in zip(named, values):
            line = np.concatenate([np.ones(1, np.longdouble), x, x * x])
            if key in sums:
                sums[key] += line
            else:
                sums[key] = line
                held += line.nbytes
        if held > most:
            yield out()
            sums.clear()
            held = 0
    if sums:
        yield out()


def moments_of(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, mean and square (sum of squared distances from the mean) from the sums of added_up, of those keys or of more."""
    kinds = "".join(f"`{c}` {t}, " for c, t in parts.select(*keys).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, mean, square = [], [], []
            for row in batch.column("sums"):
                line = whole(row.values)
                first, second = np.split(line[1:], 2)
                n.append(int(line[0]))
                mean.append((first / line[0]).astype(float))
                square.append(np.maximum(second - first * first / line[0], 0).astype(float))
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(n, pa.int64()), pa.array(mean, doubles), pa.array(square, doubles)], [*keys, "n", "mean", "square"])

    return summed_arrays(parts, keys, "sums", extended=True).mapInArrow(run, f"{kinds}n long, mean array<double>, square array<double>")


def pooled(n: np.ndarray, mean: np.ndarray, square: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """n, mean and square of groups as of one group."""
    total = n.sum()
    whole = n @ mean / total
    return total, whole, square.sum(axis=0) + n @ (mean - whole) ** 2


#: Places of a work that stay together where weights are drawn.
NEAR = 256


def weighted_confusions(predictions: DataFrame, placed: DataFrame, by: list[str]) -> DataFrame:
    """by, author, predicted and sums: in each replicate, the weights of the passages so predicted.

    A passage's weights are drawn once for all its predictions, and each task adds up its passages before anything is
    dealt: what moves is an array a replicate long for every pair of labels, never a row for a draw.
    """
    kinds = dict(predictions.dtypes)
    cells = predictions.groupBy("doc_id").agg(F.collect_list(F.struct(*by, F.col("author").alias("author"), "predicted")).alias("cells"))
    # neighbours in a work share nearly all nodes of its tree, which a batch of others would draw down to each of its passages
    near = F.floor((F.col("place") - 1) / NEAR)
    rows = placed.join(cells, "doc_id").repartition("author", "work", near).sortWithinPartitions("author", "work", "place")
    names = [*by, "author", "predicted"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sums array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def out():
            made = list(zip(*sums)) or [()] * len(names)
            arrays = [pa.array(list(v), t) for v, t in zip(made, types)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(list(sums.values()), pa.list_(pa.int64()))], [*names, "sums"])

        types = None
        for batch in batches:
            fields = batch.schema.field("cells").type.value_type
            types = [fields.field(c).type for c in names]
            listed = batch.column("cells").to_pylist()
            for i, weights in passage_weights(batch):
                for cell in listed[i]:
                    key = tuple(cell[c] for c in names)
                    sums[key] = sums[key] + weights if key in sums else weights.astype(np.int64)
            if len(sums) > 2000:
                yield out()
                sums.clear()
        if sums:
            yield out()

    return summed_arrays(rows.mapInArrow(run, schema), names, "sums")


def weighted_f1(predictions: DataFrame, weights: DataFrame, by: list[str], labels: int) -> DataFrame:
    """by, replicate, macro_f1: the replicates' scores from sums of weights, without drawing rows; weights as rows or as placed passages."""
    if "place" in weights.columns:
        return _f1_of(weighted_confusions(predictions, weights, by), by, labels)
    cells = predictions.join(weights, "doc_id").groupBy(*by, "replicate", "author", "predicted").agg(F.sum("weight").alias("n"))
    truth = cells.groupBy(*by, "replicate", F.col("author").alias("label")).agg(F.sum("n").alias("size"), F.sum(F.when(F.col("author") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    called = cells.groupBy(*by, "replicate", F.col("predicted").alias("label")).agg(F.sum("n").alias("size"), F.lit(0).cast("long").alias("tp"))
    each = truth.unionByName(called).groupBy(*by, "replicate", "label").agg((2 * F.sum("tp") / F.sum("size")).alias("f1"))
    return each.groupBy(*by, "replicate").agg((F.sum("f1") / labels).alias("macro_f1"))


def _f1_of(confusions: DataFrame, by: list[str], labels: int) -> DataFrame:
    """by, replicate, macro_f1 of weighted_confusions: a task holds one group's arrays, a pair of labels each."""
    kinds = dict(confusions.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        size: dict[str, np.ndarray] = {}
        hit: dict[str, np.ndarray] = {}
        for author, predicted, sums in zip(group["author"], group["predicted"], group["sums"], strict=True):
            for label in (author, predicted):
                size[label] = size.get(label, 0) + sums
            if author == predicted:
                hit[author] = sums
        f1 = sum(2 * hit[a] / np.maximum(size[a], 1) for a in hit) / labels if hit else np.zeros(len(group["sums"].iloc[0]))
        return pd.DataFrame({**{c: group[c].iloc[0] for c in by}, "replicate": np.arange(len(f1)), "macro_f1": f1})

    return confusions.groupBy(*by).applyInPandas(run, "".join(f"`{c}` {kinds[c]}, " for c in by) + "replicate long, macro_f1 double")


def interval(replicates: DataFrame, by: list[str], value: str) -> DataFrame:
    return replicates.groupBy(*by).agg(F.percentile(value, F.lit(0.025)).alias("ci_low"), F.percentile(value, F.lit(0.975)).alias("ci_high"))
