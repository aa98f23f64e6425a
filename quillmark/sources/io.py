"""Scans and sinks: CSV, JSON, JSON lines, whole texts and bytes, with content digests and write-once tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from hashlib import sha256
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Python workers see a few MB of its rows at a time, so that what they hold does not grow with a task's rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_top(spark: SparkSession) -> str:
    """The folder that the driver and all tasks share: spark.checkpoint.dir; where that is unset, a temporary folder if all runs in one process, and else an error."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(top)
    return top


def settled(df: DataFrame, block: int | None = None) -> DataFrame:
    """df, computed once and kept as Parquet below spark.checkpoint.dir; where that is unset, in a temporary folder if all runs in one process, and else an error.

    Plans that read it several times don't compute it again, and know its size, by which Spark broadcasts it or not.
    block is how many bytes make a row group, which is the least that one task reads: small for rows that take long.
    """
    spark = df.sparkSession
    top = shared_top(spark)
    path = f"{top.rstrip('/')}/settled-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write if block is None else df.write.option("parquet.block.size", block)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unix_newlines(text: Column) -> Column:
    """CR LF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text after newline normalisation."""
    return F.sha2(F.encode(unix_newlines(text), "UTF-8"), 256)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV with header and quoted newlines; the schema is declared, never inferred; a byte-order mark is dropped."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return df.select(*(unix_newlines(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else f.name for f in schema))


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """A header even where there are no rows; fields in the given order."""
    df.select(*(fields or df.columns)).write.mode("error").csv(path, header=True, quote='"', escape='"')


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: StructType, corrupt: str | None = None) -> DataFrame:
    """One object a line; a missing path is an empty relation. corrupt names a column that keeps lines that don't parse."""
    full = StructType([*schema.fields, StructField(corrupt, StringType())]) if corrupt else schema
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt} if corrupt else {"mode": "FAILFAST"}
    try:
        return spark.read.schema(full).options(**options).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], full)
        raise


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, null fields too, so that a reader finds every field."""
    df.write.mode("error").option("ignoreNullFields", "false").json(path)


def numbered_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """path, line (from 1), row, corrupt: every line that is not blank, with its text where it is no object of the schema; a file is one task's work."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(unix_newlines(F.col("value")), "\n")).alias("at", "text"))
    kinds = StructType([*schema.fields, StructField("__bad", StringType())])
    parsed = F.from_json("text", kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = files.where(F.trim("text") != "").select("path", (F.col("at") + 1).alias("line"), "text", parsed.alias("p"))
    bad = F.col("p").isNull() | F.col("p.__bad").isNotNull()
    row = F.struct(*(F.col("p").getField(f.name).alias(f.name) for f in schema.fields))
    return rows.select("path", "line", F.when(~bad, row).alias("row"), F.when(bad, F.col("text")).alias("corrupt"))


def read_zip(spark: SparkSession, path: str, members: list[str] | None = None, largest: int = 64 << 20) -> DataFrame:
    """path, member, content, sha256, problem of the members of zip files, one file a task at a time.

    problem: damaged (the file or the member's checksum), unsafe (an absolute or climbing name), large (over `largest`
    bytes, not read), unexpected or missing by members, the names that must be there and no others; null if all is well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(_members(data, members, largest))
                made = [pa.array([name] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.string())))]
                yield pa.RecordBatch.from_arrays(made, ["path", "member", "content", "problem"])

    read = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, content binary, problem string")
    return read.select("path", "member", "content", F.sha2("content", 256).alias("sha256"), "problem")


def _members(data: bytes, members: list[str] | None, largest: int) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    try:
        box = zipfile.ZipFile(BytesIO(data))
    except zipfile.BadZipFile:
        yield None, None, "damaged"
        return
    for entry in box.infolist():
        name = entry.filename
        if name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/"):
            yield name, None, "unsafe"
        elif entry.file_size > largest:
            yield name, None, "large"
        else:
            try:
                yield name, box.read(entry), "unexpected" if members is not None and name not in members else None
            except zipfile.BadZipFile:
                yield name, None, "damaged"
    for name in sorted(set(members or ()) - set(box.namelist())):
        yield name, None, "missing"


def append_jsonl(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.mode("append").json(path, compression=compression)


def read_texts(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """(path, text, sha256) of whole files; with a manifest (name, sha256), only files whose bytes match, and an error column else."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))
    files = files.withColumn("text", unix_newlines(F.regexp_replace("text", "^﻿", "")))
    if manifest is None:
        return files
    named = manifest.select(F.col("name"), F.col("sha256").alias("expected"))
    joined = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(named, "name", "full_outer")
    problem = F.when(F.col("expected").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("expected"), "hash_mismatch")
    return joined.withColumn("problem", problem)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same multiset of rows."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def freeze(df: DataFrame, path: str) -> DataFrame:
    """Writes a table once; a later call must bring the same rows, and fails otherwise."""
    spark = df.sparkSession
    try:
        old = spark.read.schema(df.schema).parquet(path)
        old.limit(1).collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        df.write.mode("error").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if not same_rows(old, df):
        raise ValueError(f"{path} is frozen with other rows")
    return old


def table_digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row, digest: SHA-256 over the sorted digests of all rows, which hashing first by bucket keeps off one task's memory."""
    row = F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns or df.columns)), 256)
    buckets = df.select(row.alias("h")).groupBy(F.substring("h", 1, 4).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x.h), "\n"), 256).alias("digest"))


def sorted_digest(df: DataFrame, column: str) -> DataFrame:
    """One row, digest: SHA-256 over the values of a string column (nulls left out), sorted and joined by newlines.

    Ranges of values are dealt out and sorted, each by its own task, and kept below spark.checkpoint.dir; one task then
    streams through them in order, holding the digest's state and a batch but sorting nothing, since such a digest cannot
    be put together from parts (table_digest can). Values that come out of order are an error. No rows give null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = sha256(), None
        for batch in batches:
            for value in batch.column(0).to_pylist():
                value = value.encode()
                if last is not None and value < last:
                    raise ValueError("the ranges of sorted_digest were not read in order")
                state.update(value if last is None else b"\n" + value)
                last = value
        yield pa.RecordBatch.from_arrays([pa.array([None if last is None else state.hexdigest()], pa.string())], ["digest"])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = df.select(column).where(F.col(column).isNotNull())
    top = shared_top(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(top)
    return rows.repartitionByRange(n, column).sortWithinPartitions(column).checkpoint().coalesce(1).mapInArrow(run, "digest string")
