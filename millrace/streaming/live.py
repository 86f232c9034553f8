"""Recordings as they arrive in a folder, by Structured Streaming: each new file is replayed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Columns of Spark's binary reader.
_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """(demo_id, content, arrived) of files that come into a folder; a batch takes `most_files` at most, the rest waits."""
    found = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", most_files).load(folder)
    return found.select(F.col("path").alias("demo_id"), "content", F.col("modificationTime").alias("arrived"))


def changes_by_window(deltas: DataFrame, arrived: str = "arrived", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, class_name, changes) of a stream of deltas with arrival times; windows close `late` after their end."""
    return deltas.withWatermark(arrived, late).groupBy(F.window(arrived, window), "class_name").agg(F.count(F.lit(1)).alias("changes"))


def write(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what there is to Parquet, each row once, and ends."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch to a function of (rows, batch number); an error in it ends the query."""
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
