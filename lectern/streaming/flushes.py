"""Streams written in flushes of so many records, once each, whatever fails in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


def flush_every(stream: DataFrame, path: str, checkpoint: str, records: int) -> DataStreamWriter:
    """A writer of stream's rows to Parquet under path, at most `records` in a file; start it with a trigger.

    Each micro-batch replaces the folder of its own number, so a batch that is replayed after a failure,
    before or after its files were complete, is there once. The checkpoint says which batches are done.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", records).parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def flushed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches, with their number as `batch`."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")
