"""Events of edits and of publishing as streams: what each asks for, and the decision on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "tool_input struct<file_path:string,command:string>, cwd string"


def events(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """(payload) of a folder's lines, as a stream or as they are now."""
    reader = spark.readStream if stream else spark.read
    return reader.format("text").load(path).select(F.col("value").alias("payload"))


def relevant(file: Column) -> Column:
    """Scripts, pages and manifests."""
    return F.lower(file).rlike(r"\.(gs|html?)$") | F.element_at(F.split(file, "/"), -1).eqNullSafe("appsscript.json")


def publishes(command: Column) -> Column:
    """A command that pushes or deploys scripts."""
    return command.rlike(r"(^|[\s;&|])clasp\s+(push|deploy)\b")


def asked(events_: DataFrame) -> DataFrame:
    """(file, command, cwd, skipped) of events: why nothing is to be checked, or null. Any payload gives a row."""
    e = F.from_json("payload", EVENT)
    told = events_.select(F.try_parse_json("payload").isNull().alias("_bad"), e.alias("e")).select("_bad", F.col("e.tool_input.file_path").alias("file"), F.col("e.tool_input.command").alias("command"), F.col("e.cwd").alias("cwd"))
    skipped = F.when(F.col("_bad"), "not JSON").when(F.col("file").isNull() & F.col("command").isNull(), "neither file nor command").when(F.col("file").isNotNull() & ~relevant(F.col("file")), "no source of a project").when(F.col("file").isNull() & ~publishes(F.col("command")), "nothing is published")
    return told.select("file", "command", "cwd", skipped.alias("skipped"))


def with_project(asked_: DataFrame, projects: DataFrame) -> DataFrame:
    """Adds the project whose folder holds the file, or the folder of a publishing command; the longest one.

    Every folder above a file is looked up by equality. projects: (project, folder).
    """
    path = F.coalesce("file", F.concat("cwd", F.lit("/")))
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = asked_.withColumn("_id", F.xxhash64("file", "command", "cwd"))
    met = rows.where("skipped is null").select("_id", F.explode(above).alias("folder")).join(projects, "folder").groupBy("_id").agg(F.max_by("project", F.length("folder")).alias("project"))
    out = rows.join(met, "_id", "left").drop("_id")
    return out.withColumn("skipped", F.coalesce("skipped", F.when(F.col("project").isNull(), F.lit("outside of all projects"))))


def decisions(asked_: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(file, command, project, decision, reason): block where the project's verdict is BREAK, else pass; skipped events pass.

    verdicts: (project, verdict), of a check of the projects that the events name.
    """
    out = asked_.join(verdicts, "project", "left")
    block = F.col("skipped").isNull() & (F.col("verdict") == "BREAK")
    return out.select("file", "command", "project", F.when(block, "block").otherwise("pass").alias("decision"), F.coalesce("skipped", F.concat(F.lit("verdict "), F.coalesce("verdict", F.lit("unknown")))).alias("reason"))


def run(events_: DataFrame, decide: Callable[[DataFrame], DataFrame], to: str, checkpoint: str):
    """Runs over what a folder of events holds now, batch by batch; replays of a batch write its folder again."""

    def batch(df: DataFrame, number: int) -> None:
        decide(asked(df)).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return events_.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(requests: DataFrame) -> DataFrame:
    """(need, occurrences, last_seen): a counter for each need; over a stream, use update or complete mode."""
    return requests.groupBy("need").agg(F.count("*").alias("occurrences"), F.max("at").alias("last_seen"))
