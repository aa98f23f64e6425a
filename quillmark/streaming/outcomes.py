"""The outcome log as a stream: the first outcome of every request, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_outcomes(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermarks need instants; times without zone count as the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def first_outcomes(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row that arrives of each key within delay of the watermark; state older than that is let go."""
    return _timed(stream, time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: list[str], length: str, delay: str) -> DataFrame:
    counts = _timed(stream, time, delay).groupBy(F.window(time, length), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), *by, "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Handles what has arrived, then stops; a later call goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
