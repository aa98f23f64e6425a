"""Checks that leave a row for every violation, joins that must be complete, and what becomes of disputed or refused outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.ranks import order_statistics, positions
from quillmark.sources.io import settled


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, left_rows, right_rows of the keys that do not stand exactly once on both sides; no rows: a join by keys is one to one."""
    rows = a.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return rows.groupBy(*keys).agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows")).where("left_rows <> 1 or right_rows <> 1")


def adjudicated(disputes: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """The full outer join of disputes and decisions by keys, with problem: undecided, undisputed, decided_twice, or null where all is well."""
    once = decisions.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("decision").alias("decision"))
    rows = disputes.withColumn("__d", F.lit(True)).join(once, keys, "full_outer")
    problem = F.when(F.col("__n").isNull(), "undecided").when(F.col("__d").isNull(), "undisputed").when(F.col("__n") > 1, "decided_twice")
    return rows.withColumn("problem", problem).drop("__n", "__d")


def two_raters(ratings: DataFrame, item: list[str], slot: str, value: str, slots: tuple[str, str] = ("A", "B")) -> DataFrame:
    """item, a, b, problem: both raters' values of every item; problem is wrong_slots unless exactly one rating of each slot is there."""
    counts = ratings.groupBy(*item).agg(
        F.count("*").alias("__n"), F.sort_array(F.collect_set(slot)).alias("__slots"),
        F.max(F.when(F.col(slot) == slots[0], F.col(value))).alias("a"), F.max(F.when(F.col(slot) == slots[1], F.col(value))).alias("b"),
    )
    wrong = (F.col("__n") != 2) | (F.col("__slots") != F.array(*(F.lit(s) for s in sorted(slots))))
    return counts.withColumn("problem", F.when(wrong, "wrong_slots")).drop("__n", "__slots")


def refusals(requests: DataFrame, events: DataFrame, done: DataFrame) -> DataFrame:
    """The terminal rows of refused requests that no outcome was recorded for.

    An event is terminal only with status 400 and the code content_filter; the first of a request counts. The row has
    an empty text, no words and the status fail. problem is unknown_request where requests lacks the event's.
    """
    terminal = events.where("http_status = 400 and error_code = 'content_filter'")
    first = terminal.withColumn("__k", F.row_number().over(Window.partitionBy("request_id").orderBy("timestamp", "event_id"))).where("__k = 1").drop("__k")
    rows = first.join(done.select("request_id").distinct(), "request_id", "left_anti").join(requests.withColumn("__known", F.lit(True)), "request_id", "left")
    fixed = {"outcome_type": F.lit("http_content_filter"), "rewritten_text": F.lit(""), "rewrite_words": F.lit(0), "qc_status": F.lit("fail"), "qc_flags": F.lit("provider_content_filter")}
    return rows.withColumns(fixed).withColumn("problem", F.when(F.col("__known").isNull(), "unknown_request")).drop("__known")


def leases(requests: DataFrame, issued: DataFrame, released: DataFrame, done: DataFrame, workers: DataFrame, size: int) -> DataFrame:
    """worker, request_id, batch, fresh: each worker's pending batch, or else (fresh) its next `size` free requests in order of request_id.

    A request is reserved if it stands in an issued batch (batch, worker, request_id), which was released or not; it is
    pending while its batch was not released and it is not done. Workers share the free requests in the order of their
    names; places are counted over ranges of the ids, of any kind, so that no task ranks all requests.
    """
    open_ = issued.join(released.select("batch").distinct(), "batch", "left_anti").join(done.select("request_id").distinct(), "request_id", "left_anti")
    pending = open_.select("worker", "request_id", "batch").withColumn("fresh", F.lit(False))
    idle = workers.select("worker").distinct().join(pending.select("worker").distinct(), "worker", "left_anti")
    free = requests.select("request_id").distinct().join(issued.select("request_id").distinct(), "request_id", "left_anti").join(done.select("request_id").distinct(), "request_id", "left_anti")
    placed = positions(free, ["request_id"], name="at")
    ranked = positions(idle, ["worker"], name="turn").withColumn("turn", F.col("turn") - 1)
    dealt = placed.withColumn("turn", F.floor((F.col("at") - 1) / size)).join(ranked, "turn")
    ids = F.sort_array(F.collect_list(F.col("request_id")).over(Window.partitionBy("worker")))
    batch = F.substring(F.sha2(F.concat(F.col("worker"), F.lit(":"), F.array_join(F.transform(ids, lambda i: i.cast("string")), ":")), 256), 1, 20)
    return pending.unionByName(dealt.select("worker", "request_id", batch.alias("batch"), F.lit(True).alias("fresh")))


def ingest_problems(outputs: DataFrame, issued: DataFrame, released: DataFrame, done: DataFrame) -> DataFrame:
    """outputs (batch, worker, request_id) with problem: released, not_issued, another_worker, recorded_before, or null where they may be taken."""
    known = issued.select("batch", "request_id", F.col("worker").alias("__owner")).distinct()
    rows = outputs.join(known, ["batch", "request_id"], "left")
    rows = rows.join(released.select("batch").distinct().withColumn("__gone", F.lit(True)), "batch", "left")
    rows = rows.join(done.select("request_id").distinct().withColumn("__done", F.lit(True)), "request_id", "left")
    problem = F.when(F.col("__gone"), "released").when(F.col("__owner").isNull(), "not_issued").when(F.col("__owner") != F.col("worker"), "another_worker").when(F.col("__done"), "recorded_before")
    return rows.withColumn("problem", problem).drop("__owner", "__gone", "__done")


def retry_plan(attempts: DataFrame, most: int, base: float, longest: float) -> DataFrame:
    """request_id, attempts, state, wait: done, refused, exhausted after `most` attempts, or retry after base * 2^(attempts - 1) seconds, `longest` at most.

    attempts has request_id, attempt, outcome (ok, refused, error) and retry_after, which wins over the doubled wait.
    """
    last = F.max_by(F.struct("outcome", "retry_after"), "attempt")
    rows = attempts.groupBy("request_id").agg(F.count("*").alias("attempts"), F.max((F.col("outcome") == "ok").cast("int")).alias("__ok"), F.max((F.col("outcome") == "refused").cast("int")).alias("__no"), last.alias("__last"))
    state = F.when(F.col("__ok") == 1, "done").when(F.col("__no") == 1, "refused").when(F.col("attempts") >= most, "exhausted").otherwise("retry")
    wait = F.least(F.lit(longest), F.coalesce(F.col("__last.retry_after"), F.lit(base) * F.pow(F.lit(2.0), F.col("attempts") - 1)))
    return rows.select("request_id", "attempts", state.alias("state"), F.when(state == "retry", wait).alias("wait"))


def failures(rows: DataFrame, checks: dict[str, Column], expected: dict[str, tuple[Column, int]] | None = None) -> DataFrame:
    """check, found, wanted, ok: for each of checks how many rows violate it (0 wanted), and for each of expected an aggregate and the number it must be.

    All checks are one aggregation over rows; a check that is null for a row counts as violated.
    """
    made = {k: (F.count_if(~F.coalesce(v, F.lit(False))), 0) for k, v in checks.items()} | (expected or {})
    seen = rows.agg(*(v.cast("long").alias(k) for k, (v, _) in made.items()))
    listed = F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("found"), F.lit(n).cast("long").alias("wanted")) for k, (_, n) in made.items()))
    return seen.select(F.explode(listed).alias("x")).select("x.*").withColumn("ok", F.col("found") == F.col("wanted"))


def overlapping(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Rows whose span begins before the furthest end of those before it within by: none if no two spans of a group overlap."""
    order = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("__reach", F.max(end).over(order)).where(F.col(start) < F.col("__reach")).drop("__reach")


def recomputed(stored: DataFrame, again: DataFrame, keys: list[str], columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """keys, problem: missing, unexpected, or the first of columns whose stored and recomputed values differ by more than tolerance; null only equals null, in keys too."""
    a = stored.select(*keys, F.struct(*columns).alias("__a"))
    b = again.select(*(F.col(k).alias(f"__{k}") for k in keys), F.struct(*columns).alias("__b"))
    kinds = dict(stored.dtypes)

    def differs(c: str) -> Column:
        x, y = F.col(f"__a.{c}"), F.col(f"__b.{c}")
        return ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))) if tolerance and kinds[c] in ("double", "float") else ~x.eqNullSafe(y)

    problem = F.when(F.col("__a").isNull(), "unexpected").when(F.col("__b").isNull(), "missing")
    for c in columns:
        problem = problem.when(differs(c), c)
    same = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"__{k}")), keys, F.lit(True))
    named = [F.when(F.col("__a").isNull(), F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return a.join(b, same, "full_outer").select(*named, problem.alias("problem")).where("problem is not null")


def linked(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """name, problem of the files (name, sha256, bytes) of a manifest that are missing, unlisted, or of another size or hash."""
    rows = manifest.select("name", F.struct("sha256", "bytes").alias("m")).join(files.select("name", F.struct("sha256", "bytes").alias("f")), "name", "full_outer")
    problem = F.when(F.col("m").isNull(), "unlisted").when(F.col("f").isNull(), "missing").when(F.col("m.bytes") != F.col("f.bytes"), "size").when(F.col("m.sha256") != F.col("f.sha256"), "hash")
    return rows.select("name", problem.alias("problem")).where("problem is not null")


def corrected(originals: DataFrame, replacements: DataFrame, key: str, new_key: Column) -> DataFrame:
    """originals (key, text) with replaced texts, under new_key where replaced, and the lineage: old_key, old_sha256, new_sha256, disposition, problem.

    problem: unknown_target, replaced_twice or not_changed for a replacement that must not be, and null else.
    """
    once = replacements.groupBy(key).agg(F.count("*").alias("__n"), F.min(F.struct("text", "reason")).alias("__new"))
    rows = originals.withColumn("__old", F.lit(True)).join(once, key, "full_outer")
    changed = F.col("__n").isNotNull()
    old, new = F.sha2("text", 256), F.sha2(F.coalesce("__new.text", "text"), 256)
    problem = F.when(F.col("__old").isNull(), "unknown_target").when(F.col("__n") > 1, "replaced_twice").when(changed & (old == new), "not_changed")
    return rows.select(
        F.when(changed, new_key).otherwise(F.col(key)).alias(key), F.col(key).alias("old_key"), F.coalesce("__new.text", "text").alias("text"), old.alias("old_sha256"), new.alias("new_sha256"),
        F.when(changed, "replacement").otherwise("unchanged").alias("disposition"), F.coalesce("__new.reason", F.lit("retained")).alias("reason"), problem.alias("problem"),
    )


def stale(results: DataFrame, inputs: DataFrame, name: str = "name") -> DataFrame:
    """Results (name, made_from) with status: current if made_from is the digest that inputs (name, digest) has now, stale if not, orphan without input."""
    rows = results.join(inputs.select(name, F.col("digest").alias("__now")), name, "left")
    status = F.when(F.col("__now").isNull(), "orphan").when(F.col("__now") == F.col("made_from"), "current").otherwise("stale")
    return rows.withColumn("status", status).drop("__now")


def with_mean_rows(scores: DataFrame, by: list[str], fold: str, columns: list[str]) -> DataFrame:
    """scores, and for each group of by a row whose fold is mean, with the means over its folds."""
    means = scores.groupBy(*by).agg(*(F.avg(c).alias(c) for c in columns)).withColumn(fold, F.lit("mean"))
    return scores.select(*by, F.col(fold).cast("string").alias(fold), *columns).unionByName(means)


def flag_counts(rows: DataFrame, by: list[str], flags: str) -> DataFrame:
    """by, flag, n: how many rows have each flag; a row without flags counts under none."""
    each = F.explode(F.when(F.size(flags) > 0, F.array_distinct(flags)).otherwise(F.array(F.lit("none"))))
    return rows.select(*by, each.alias("flag")).groupBy(*by, "flag").agg(F.count("*").alias("n"))


def in_subset(status: Column, flags: Column, original: Column, name: str) -> Column:
    """Whether a row belongs to the sensitivity subset: originals always do."""
    rules = {
        "all_rows": F.lit(True), "qc_pass_only": status == "pass",
        "pass_plus_non_hard_length_warning": status.isin("pass", "warning") & ~F.array_contains(flags, "length_hard_warning"),
    }
    return original | rules[name]


def interval_table(estimates: DataFrame, intervals: DataFrame, keys: list[str], pattern: str = "%d [%d, %d]") -> DataFrame:
    """keys, cell: the estimate with its interval as text, and the estimate alone where it has none."""
    rows = estimates.join(intervals, keys, "left")
    bare = pattern.split(" ")[0]
    return rows.select(*keys, F.when(F.col("low").isNull(), F.format_string(bare, "estimate")).otherwise(F.format_string(pattern, "estimate", "low", "high")).alias("cell"))


def looked_up(lines: DataFrame, cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every line of a report with the value of its cell by all keys; found tells whether there is one. Cells that aren't unique by keys are an error when they are read."""
    once = cells.groupBy(*keys).agg(F.count("*").alias("__n"), F.any_value(value).alias(value))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.concat_ws(" ", F.lit("more than one cell for"), *(F.col(k).cast("string") for k in keys))).cast(dict(cells.dtypes)[value])).otherwise(F.col(value))
    return lines.join(once.select(*keys, checked.alias(value), F.lit(True).alias("found")), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def replicate_bounds(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, linear and cut bounds of 95 %: percentiles between neighbours, and the places 0.025 n and 0.975 n - 1, cut to whole numbers, of the sorted values.

    The few values that are needed are selected from counts; no group is sorted or gathered. Nulls and NaN count for
    nothing; a place before the first value is null.
    """
    counts = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count("*").alias("n"))
    n, floor = F.col("n"), lambda x: F.floor(x).cast("long")
    places = {"a": floor((n - 1) * 0.025), "b": floor((n - 1) * 0.025) + 1, "c": floor((n - 1) * 0.975), "d": floor((n - 1) * 0.975) + 1, "cut_low": floor(n * 0.025), "cut_high": floor(n * 0.975) - 1}
    listed = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("rank")) for k, v in places.items())))
    asked = settled(counts.select(*by, "n", listed.alias("x")).select(*by, "n", "x.*"))
    found = asked.join(order_statistics(rows, by, value, asked), [*by, "rank"], "left")
    wide = found.groupBy(*by, "n").agg(*(F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in places))
    between = lambda x, y, share: F.col(x) + (F.coalesce(F.col(y), F.col(x)) - F.col(x)) * ((n - 1) * share - floor((n - 1) * share))
    return wide.select(*by, between("a", "b", 0.025).alias("linear_low"), between("c", "d", 0.975).alias("linear_high"), "cut_low", "cut_high")


def paired_sensitivity(predictions: DataFrame, chosen: Column, by: list[str], labels: DataFrame, selection: str) -> DataFrame:
    """by, selection, rows, excluded, status, original_macro_f1, rewrite_macro_f1, macro_f1_loss over the chosen rows.

    predictions has author, original and rewrite. Where an author of labels has no chosen row the figures are null and
    the status not_estimable; a label that is never met nor predicted counts as 0.
    """
    marked = predictions.withColumn("__in", F.coalesce(chosen, F.lit(False)))
    sizes = marked.groupBy(*by).agg(F.count_if("__in").alias("rows"), F.count_if(~F.col("__in")).alias("excluded"))
    both = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("predicted")) for k in ("original", "rewrite")))
    long = marked.where("__in").select(*by, "author", F.explode(both).alias("x")).select(*by, "author", "x.kind", "x.predicted")
    ends = F.array(F.struct(F.col("author").alias("label"), F.lit(1).alias("own"), F.lit(0).alias("called")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("own"), F.lit(1).alias("called")))
    parts = long.select(*by, "kind", (F.col("author") == F.col("predicted")).cast("int").alias("hit"), F.explode(ends).alias("e")).select(*by, "kind", "e.*", "hit")
    each = parts.groupBy(*by, "kind", "label").agg(F.sum("own").alias("own"), F.sum("called").alias("called"), F.sum(F.col("hit") * F.col("own")).alias("tp")).join(F.broadcast(labels.select(F.col("author").alias("label"))), "label", "left_semi")
    n = labels.agg(F.count("*").alias("labels"))
    f1 = each.withColumn("f1", 2.0 * F.col("tp") / (F.col("own") + F.col("called")))
    figures = f1.groupBy(*by).agg(F.count_if((F.col("kind") == "original") & (F.col("own") > 0)).alias("present"), *(F.sum(F.when(F.col("kind") == k, F.col("f1"))).alias(k) for k in ("original", "rewrite")))
    rows = (sizes.join(figures, by, "left") if by else sizes.crossJoin(figures)).crossJoin(n)
    whole = F.coalesce(F.col("present") == F.col("labels"), F.lit(False))
    a, b = (F.when(whole, F.col(k) / F.col("labels")) for k in ("original", "rewrite"))
    return rows.select(*by, F.lit(selection).alias("selection"), "rows", "excluded", F.when(whole, "estimable").otherwise("not_estimable").alias("status"), a.alias("original_macro_f1"), b.alias("rewrite_macro_f1"), (a - b).alias("macro_f1_loss"))


def transfer_contrasts(cells: DataFrame, base: str = "original", by: list[str] | None = None) -> DataFrame:
    """by, domain, contrast, difference from cells (by, train, test, score): transfer_loss, adaptation_gain and within_domain_gap of every other domain.

    Cells are counted up within by, so that all contrasts take one aggregation and a join on by; one that lacks a cell is
    left out. Null keys are a group of their own.
    """
    by = by or []
    other = F.when(F.col("train") == base, F.col("test")).otherwise(F.col("train"))
    used = cells.where((F.col("train") == base) | (F.col("train") == F.col("test"))).withColumn("domain", other)
    of = lambda held: F.max(F.when(held, F.col("score")))
    wide = used.groupBy(*by, "domain").agg(of(F.col("train") == base).alias("moved"), of(F.col("train") == F.col("test")).alias("own"))
    home = wide.where(F.col("domain") == base).select(*(F.col(c).alias(f"__{c}") for c in by), F.col("own").alias("home"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__{c}")), by, F.lit(True))
    rows = wide.where(F.col("domain") != base).join(home, same)
    named = {"transfer_loss": F.col("home") - F.col("moved"), "adaptation_gain": F.col("own") - F.col("moved"), "within_domain_gap": F.col("home") - F.col("own")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("contrast"), v.alias("difference")) for k, v in named.items())))
    return rows.select(*by, "domain", each.alias("x")).select(*by, "domain", "x.*").where("difference is not null")
