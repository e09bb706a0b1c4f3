"""Windowed process logs over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windows(log: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Runs and errors by window and function; log may be a stream, whose state is dropped `late` after its window."""
    log = log.withWatermark("started", late) if log.isStreaming else log
    return log.groupBy(F.window("started", width).alias("w"), "function").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "FAILED").alias("errors")).select(F.col("w.start").alias("from"), "function", "runs", "errors")


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files as a stream, with the schema of what is there now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
