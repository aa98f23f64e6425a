"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below a temporary folder if all runs in one process, and else an error."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/quillmark-{sc.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder; cuts the lineage."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that no plan still to run reads."""
    for done in tables:
        jvm = done.sparkSession.sparkContext._jvm
        for name in {os.path.dirname(f) for f in done.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(done.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def local_path(path: str) -> str:
    """The mounted path of a shared folder that workers memory-map."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder in spark.checkpoint.dir, not {path}")
    return url.path


def small_batches(spark: SparkSession) -> None:
    """Lets Python workers see a few MB of rows at a time, so that long texts cannot fill an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def partitions(spark: SparkSession) -> int:
    """How many groups to deal packed rows into: as many as Spark's shuffle partitions, 8 at least."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
