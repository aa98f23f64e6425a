"""Positions in an order, within groups or over all rows, without a task that sees a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.sources.io import settled


def _in_ranges(df: DataFrame, order: list[str | Column], group: list[str], value: Column) -> tuple[DataFrame, DataFrame]:
    """df dealt out by ranges of group and order and written, with __at (ascending) and __task; and for each task and group the sum of value over the tasks before it.

    The driver sees one row a task, and only where there is no group.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [*(F.col(c) for c in group), *(F.col(c) if isinstance(c, str) else c for c in order)]
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = settled(dealt.withColumn("__at", F.monotonically_increasing_id())).withColumn("__task", F.shiftright("__at", 33))
    own = dealt.groupBy("__task", *group).agg(F.min("__at").alias("__least"), F.sum(value).alias("__n"))
    if group:
        before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
        return dealt, own.select("__task", *(F.col(c).alias(f"__{c}") for c in group), "__least", F.coalesce(before, F.lit(0)).alias("__before"))
    total, made = 0, []
    for r in sorted(own.collect(), key=lambda r: r["__task"]):
        made.append((r["__task"], r["__least"], total))
        total += r["__n"] or 0
    return dealt, F.broadcast(spark.createDataFrame(made, f"__task long, __least long, __before {dict(own.dtypes)['__n']}"))


def _joined(dealt: DataFrame, starts: DataFrame, group: list[str]) -> DataFrame:
    same = reduce(lambda a, c: a & dealt[c].eqNullSafe(F.col(f"__{c}")), group, dealt["__task"] == F.col("__of"))
    return dealt.join(starts.withColumnRenamed("__task", "__of"), same)


def positions(df: DataFrame, order: list[str | Column], group: list[str] = [], name: str = "position") -> DataFrame:  # noqa: B006
    """df with the column name, each row's place from 1 in its group (all rows, without one) by order; equals row_number().

    Rows are dealt out by ranges of group and order, so that a group of any size is spread over as many tasks as it fills;
    each task counts its rows of each group, and the counts of earlier tasks are added. What meets in one place is one row
    a task that has the group. Rows that tie in group and order stay in one task and get places in any order: add
    columns to the order until ties are equal rows. Nulls come first and are a group of their own; a column called like
    the result is replaced.
    """
    dealt, starts = _in_ranges(df.drop(name), order, group, F.lit(1))
    place = F.col("__at") - F.col("__least") + F.col("__before") + 1
    return _joined(dealt, starts, group).select(*(dealt[c] for c in df.columns if c != name), place.cast("long").alias(name))


def running_sums(df: DataFrame, column: str, order: list[str | Column], group: list[str] = [], name: str = "running") -> DataFrame:  # noqa: B006
    """df with the column name: the sum of column over the row and those before it in its group by order, as positions deals them out; null counts as 0."""
    value = F.coalesce(F.col(column), F.lit(0))
    dealt, starts = _in_ranges(df.drop(name), order, group, value)
    within = F.sum(value).over(Window.partitionBy("__task", *group).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    own = dealt.withColumn("__within", within)
    return _joined(own, starts, group).select(*(own[c] for c in df.columns if c != name), (F.col("__within") + F.col("__before")).alias(name))


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: DataFrame, fine: int = 256) -> DataFrame:
    """by, rank and value: for each row of ranks (by, rank from 0) the value that has so many others before it in its group.

    Selection without sorting: a pass counts each group's values in `fine` buckets between the bounds that are left, and
    only the bucket with the wanted rank goes on, until it holds one value. A pass moves counts alone, added up by each
    task first; passes grow with the digits of the values, not with the rows. Null and NaN values count for nothing, ranks
    that a group does not have give no row, and keys must not be null.
    """
    data = rows.select(*by, F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    ends = data.groupBy(*by).agg(F.min("__v").alias("low"), F.max("__v").alias("high"), F.count("*").alias("n"))
    open_ = settled(ranks.select(*by, "rank").distinct().join(ends, by).where("rank >= 0 and rank < n").select(*by, "rank", F.col("rank").alias("left"), "low", "high"))
    done = open_.where("low = high").select(*by, "rank", F.col("low").alias("value"))
    open_ = open_.where("low < high")
    for _ in range(200):
        if open_.isEmpty():
            return done
        width = F.col("high") / fine - F.col("low") / fine
        bucket = F.when(width > 0, F.least(F.floor((F.col("__v") - F.col("low")) / width), F.lit(fine - 1))).otherwise(F.when(F.col("__v") == F.col("low"), 0).otherwise(1))
        asked = open_.select(*by, "low", "high").distinct()
        counts = data.join(asked, by).where("__v between low and high").groupBy(*by, "low", "high", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "low", "high").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = open_.join(counts.withColumn("before", before), [*by, "low", "high"]).where("left >= before and left < before + n")
        open_ = settled(found.select(*by, "rank", (F.col("left") - F.col("before")).alias("left"), F.col("least").alias("low"), F.col("most").alias("high")))
        done = done.unionByName(open_.where("low = high").select(*by, "rank", F.col("low").alias("value")))
        open_ = open_.where("low < high")
    raise RuntimeError("order statistics did not settle")


def chained(df: DataFrame, group: list[str], place: str, following: str) -> DataFrame:
    """group and place of the rows that the pointer `following` (a place of the group, or null at its end) leads to from each group's place 1, that one too.

    Pointers double in each round, and what is reached follows them, so that the rounds grow with the logarithm of the
    longest chain. Each pointer must lead forward; keys must not be null.
    """
    jumps = settled(df.where(F.col(following).isNotNull()).select(*group, F.col(place).alias("from"), F.col(following).alias("to")))
    reached = df.where(F.col(place) == 1).select(*group, F.col(place).alias("from"))
    while True:
        reached = settled(reached.unionByName(reached.join(jumps, [*group, "from"]).select(*group, F.col("to").alias("from"))))
        twice = settled(jumps.join(jumps.select(*group, F.col("from").alias("to"), F.col("to").alias("further")), [*group, "to"]).select(*group, "from", F.col("further").alias("to")))
        if twice.isEmpty():
            return reached.select(*group, F.col("from").alias(place)).distinct()
        jumps = twice


def packed(blocks: DataFrame, by: list[str], order: list[str], size: str, most: int = 850_000, header: int = 0) -> DataFrame:
    """blocks with part (from 0): in order, a part takes blocks until the next would pass `most`, a header of so many counted once a part; a larger block stands alone.

    By prefix sums of the sizes, each block's pointer to where a part that begins with it ends is one place among the
    sorted sums (which a union with what it may hold, ranked, finds for all); the parts' beginnings are the chain of
    pointers from the first block, and a block's part is the number of beginnings up to it. Every step deals a group over
    many tasks. Sizes below 1 count as they are; null sizes as 0; null keys are an error.
    """
    placed = settled(running_sums(positions(blocks, order, by, "__place"), size, ["__place"], by, "__sum"))
    base = placed.select(*by, "__place", F.col("__sum").alias("__upto"), (F.col("__sum") - F.coalesce(F.col(size), F.lit(0)) + most - header).alias("__room"))
    # the sums that a part from a block on may reach come just after all sums up to that
    marks = base.select(*by, F.col("__upto").alias("__x"), F.lit(0).alias("__kind"), "__place").unionByName(base.select(*by, F.col("__room").alias("__x"), F.lit(1).alias("__kind"), "__place"))
    ranked = positions(marks, ["__x", "__kind", "__place"], by, "__rank")
    sums = running_sums(ranked.withColumn("__one", (F.col("__kind") == 0).cast("long")), "__one", ["__rank"], by, "__held")
    last = placed.groupBy(*by).agg(F.max("__place").alias("__last"))
    ends = sums.where("__kind = 1").join(last, by).withColumn("__next", F.greatest(F.col("__held"), F.col("__place")) + 1)
    starts = chained(ends.select(*by, "__place", F.when(F.col("__next") <= F.col("__last"), F.col("__next")).alias("__next")), by, "__place", "__next")
    flagged = placed.join(starts.withColumn("__start", F.lit(1).cast("long")), [*by, "__place"], "left")
    numbered = running_sums(flagged, "__start", ["__place"], by, "__part")
    return numbered.select(*blocks.columns, (F.col("__part") - 1).cast("int").alias("part"))
