"""Recognised lines as a stream: line by line without state, and by images in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkrow.functions import text
from inkrow.sources.tables import LINES


def lines(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """The lines in the JSON files that arrive in folder, in the schema of tables.LINES."""
    own = spark.readStream.schema(LINES)
    return (own.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else own).json(folder)


def redacted(stream: DataFrame) -> DataFrame:
    """stream with its texts redacted and its characters gone. Lines don't depend on each other, so neither state nor a watermark is needed."""
    return stream.withColumn("text", text.redact("text")).drop("chars")


def by_image(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs work, any operator on the lines of whole images, on each micro-batch, and writes what it gives to path as Parquet, a folder a batch.

    An image's lines must arrive in one file, so that they are in one batch. A batch that is run again after a failure replaces its own folder, so that every image is there once; read() reads
    the result. With once the query ends when the files that are there have been read.
    """

    def run(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def append(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes a stream without state to path as Parquet; Spark's file sink lists what is committed, so that each line is there once."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """What by_image wrote, without the number of the batch."""
    return spark.read.parquet(path).drop(F.col("batch"))
