"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only if that is unset in local mode."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return found
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspan-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written once as Parquet and read back: lineage ends and its size is known."""
    at = f"{shared_folder(df.sparkSession)}/quillspan-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
