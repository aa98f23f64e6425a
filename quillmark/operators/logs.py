"""Append logs: first outcomes, latest revisions, retries, conflicts, costs and nested provider bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.ranks import positions


def first_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; later ones never replace it."""
    return log.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def latest_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return log.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))).where("__k = 1").drop("__k")


def until_first(log: DataFrame, keys: list[str], order: list[str], done: Column) -> DataFrame:
    """The attempts of each key up to the first that is done, and none after."""
    before = F.max(done.cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("__d", F.coalesce(before, F.lit(0))).where("__d = 0").drop("__d")


def attempts(log: DataFrame, keys: list[str], most: int) -> DataFrame:
    return log.groupBy(*keys).agg(F.count("*").alias("attempts")).withColumn("exhausted", F.col("attempts") >= most)


def pending(requests: DataFrame, *done: DataFrame, key: str) -> DataFrame:
    """The requests that none of the tables has."""
    for table in done:
        requests = requests.join(table.select(key), key, "left_anti")
    return requests


def merge_logs(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of both, each once; keys that stand for different rows)."""
    both = a.unionByName(b, allowMissingColumns=True).distinct()
    return both, both.groupBy(*keys).agg(F.count("*").alias("versions")).where("versions > 1")


def merged(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both logs, each once; an error that names a few of them if keys stand for different rows."""
    both, conflicts = merge_logs(a, b, keys)
    if named := conflicts.orderBy(*keys).limit(5).collect():
        raise ValueError("the logs conflict on " + "; ".join(", ".join(f"{c}={r[c]}" for c in keys) for r in named))
    return both


def in_batches(rows: DataFrame, order: list[str], size: int, by: list[str] | None = None) -> DataFrame:
    return positions(rows, order, by or [], "batch").withColumn("batch", F.floor((F.col("batch") - 1) / size))


def round_robin(rows: DataFrame, cell: list[str], order: list[str], blocks: int = 4) -> DataFrame:
    """rows with block: (number of the cell + place within it) modulo blocks, so that cells spread evenly; a row with a null in its cell has none and is left out."""
    cells = positions(rows.select(*cell).distinct(), cell, name="__c")
    placed = positions(rows, order, cell, "__place").join(cells, cell)
    return placed.withColumn("block", (F.col("__c") + F.col("__place") - 2) % blocks).drop("__c", "__place")


def ledger(log: DataFrame, model: str, charge: str, settled: str) -> DataFrame:
    return log.groupBy(model).agg(F.count("*").alias("calls"), F.sum(charge).alias("charged"), F.count_if(~F.col(settled)).alias("unsettled"))


def cost(incoming: Column, outgoing: Column, in_rate: float, out_rate: float, safety: float = 1.0) -> Column:
    """Dollars at rates per million tokens; null where usage is missing or negative."""
    return F.when((incoming >= 0) & (outgoing >= 0), (incoming * in_rate * safety + outgoing * out_rate) / 1e6)


MESSAGES = "struct<status:string,model:string,id:string,output:array<struct<type:string,content:array<struct<type:string,text:string,refusal:string>>>>>"
CANDIDATES = "struct<modelVersion:string,responseId:string,candidates:array<struct<finishReason:string,content:struct<parts:array<struct<text:string,thought:boolean>>>>>>"
CHOICES = "struct<model:string,id:string,choices:array<struct<finish_reason:string,message:struct<content:string>>>>"


def response_view(api: Column, body: Column) -> Column:
    """(content, finish_reason, model, id) of a provider's JSON body in any of three shapes."""
    m, c, h = F.from_json(body, MESSAGES), F.from_json(body, CANDIDATES), F.from_json(body, CHOICES)
    texts = F.flatten(F.transform(F.filter(m.output, lambda x: x.type == "message"), lambda x: F.transform(F.filter(x.content, lambda p: p.type == "output_text"), lambda p: p.text)))
    first, choice = F.get(c.candidates, F.lit(0)), F.get(h.choices, F.lit(0))
    parts = F.transform(F.filter(first.content.parts, lambda p: ~F.coalesce(p.thought, F.lit(False))), lambda p: p.text)
    view = lambda content, finish, stop, model, ident: F.struct(F.coalesce(content, F.lit("")).alias("content"), F.when(finish == stop, "stop").otherwise(F.coalesce(finish, F.lit(""))).alias("finish_reason"), F.coalesce(model, F.lit("")).alias("model"), F.coalesce(ident, F.lit("")).alias("id"))
    return (
        F.when(api == "messages", view(F.array_join(texts, ""), m.status, "completed", m.model, m.id))
        .when(api == "candidates", view(F.array_join(parts, ""), first.finishReason, "STOP", c.modelVersion, c.responseId))
        .otherwise(view(choice.message.content, choice.finish_reason, "stop", h.model, h.id))
    )


def visible_segments(events: DataFrame, body: str = "body") -> DataFrame:
    """(kind, segment) of every text or refusal in a body of messages, beside the event's own columns."""
    parts = F.flatten(F.transform(F.filter(F.from_json(body, MESSAGES).output, lambda x: x.type == "message"), lambda x: x.content))
    kind = F.when(F.col("part.type") == "refusal", "refusal").when(F.col("part.type") == "output_text", "text")
    rows = events.withColumn("part", F.explode(parts)).withColumns({"kind": kind, "segment": F.when(F.col("part.type") == "refusal", F.col("part.refusal")).otherwise(F.col("part.text"))})
    return rows.where("kind is not null and segment is not null").drop("part")
