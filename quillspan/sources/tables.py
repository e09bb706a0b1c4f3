"""Inputs: Parquet tables, trees of source files, process logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, content, sha1, mtime) of a tree's scripts, pages and manifests, read whole; no other file is opened. Files of no bytes are not listed: they hold no facts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.[gG][sS],*.[hH][tT][mM],*.[hH][tT][mM][lL],appsscript.json}").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name == "appsscript.json", "manifest").when(F.lower(name).endswith(".gs"), "gs").when(F.lower(name).rlike(r"\.html?$"), "html")
    return files.select("path", kind.alias("kind"), F.decode("content", "UTF-8").alias("content"), F.sha1("content").alias("sha1"), F.col("modificationTime").alias("mtime")).where("kind is not null and path not like '%/node_modules/%' and path not like '%/.%'")


def process_log(events: DataFrame) -> DataFrame:
    """Events as a process log: function, status and start of each run."""
    return events.select(F.col("event_type").alias("function"), F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED").alias("status"), F.col("ts").cast("timestamp").alias("started"), "user_id")
