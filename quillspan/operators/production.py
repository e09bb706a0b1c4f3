"""What runs: process logs and deployments as tables, their summaries, and what they say of the code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.findings import heat_of
from quillspan.operators.relations import log_metrics, snapshot_diff

PROCESSES = "project string, functionName string, processStatus string, startTime timestamp"
DEPLOYMENTS = "project string, deploymentId string, versionNumber int, description string, entryPoints array<struct<entryPointType:string,url:string>>, error string"


def processes(spark: SparkSession, path: str) -> DataFrame:
    """(project, function, status, started) of JSON lines as the process listing has them; broken lines and rows without a function are left out."""
    rows = spark.read.schema(PROCESSES).option("mode", "DROPMALFORMED").json(path)
    return rows.where("functionName is not null").select("project", F.col("functionName").alias("function"), F.col("processStatus").alias("status"), F.col("startTime").alias("started"))


def deployments(spark: SparkSession, path: str) -> DataFrame:
    """(project, deployment, version, description, types, error) of JSON lines; a project that could not be listed has a row with an error."""
    rows = spark.read.schema(DEPLOYMENTS).option("mode", "DROPMALFORMED").json(path)
    return rows.select("project", F.col("deploymentId").alias("deployment"), F.col("versionNumber").alias("version"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce(F.col("entryPoints.entryPointType"), F.array().cast("array<string>")).alias("types"), "error")


def metrics_of(functions: DataFrame, log: DataFrame, as_of, days: int) -> DataFrame:
    """(project, symbol, runs, errors, last_run) of all functions over the days before as_of; 0 runs without a row of the log.

    functions: (project, symbol); log: (project, function, status, started).
    """
    told = log_metrics(log.where(F.col("started") >= as_of - F.expr(f"interval {days} days")).withColumn("function", F.struct("project", "function")))
    told = told.select("function.project", F.col("function.function").alias("symbol"), "runs", "errors", "last_run")
    return functions.join(told, ["project", "symbol"], "left").select("project", "symbol", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("errors", F.lit(0)).alias("errors"), "last_run")


def trailing(log: DataFrame, keys: list[str], days: int) -> DataFrame:
    """(keys, day, runs, errors, heat) for each day of the log and each key, over the `days` days up to that day.

    The log is summed by day first, so a hot key is a row a day; days without
    a run are there with none. A window then adds up a range of days. Keys
    times days of the log are rows of the result, whatever the log's length.
    """
    failed = F.col("status").isin("FAILED", "TIMED_OUT")
    daily = log.groupBy(*keys, F.to_date("started").alias("day")).agg(F.count("*").alias("n"), F.count_if(failed).alias("e"))
    ends = daily.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    spine = daily.select(*keys).distinct().withColumn("day", F.explode(F.sequence(F.lit(ends["a"]).cast("date"), F.lit(ends["b"]).cast("date"))))
    full = spine.join(daily, [*keys, "day"], "left").withColumn("_at", F.unix_date("day"))
    back = Window.partitionBy(*keys).orderBy("_at").rangeBetween(1 - days, 0)
    told = full.select(*keys, "day", F.sum(F.coalesce("n", F.lit(0))).over(back).alias("runs"), F.sum(F.coalesce("e", F.lit(0))).over(back).alias("errors"))
    return told.withColumn("heat", heat_of(F.col("runs"), days))


def status_counts(truth: DataFrame) -> DataFrame:
    names = ("confirmed_dead", "dispatched_dynamic", "cold_exposed", "errored", "live", "unknown")
    return truth.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == n).alias(n) for n in names])


def advice(truth: DataFrame, most: int = 5) -> DataFrame:
    """(status, functions, names): how many functions have a status that asks for something, and the first of them by name."""
    asks = truth.where("status in ('confirmed_dead', 'dispatched_dynamic', 'errored', 'cold_exposed')")
    n = asks.withColumn("_n", F.row_number().over(Window.partitionBy("status").orderBy("project", "symbol"))).withColumn("_all", F.count("*").over(Window.partitionBy("status")))
    first = n.where(F.col("_n") <= most).groupBy("status").agg(F.max("_all").alias("functions"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "symbol"))), lambda x: x["symbol"]), ", ").alias("names"))
    return first.select("status", "functions", "names")


def version_drift(deployments_: DataFrame, versions: DataFrame) -> DataFrame:
    """(project, deployment, served, latest): deployments with entry points that serve a version older than the project's latest."""
    latest = versions.groupBy("project").agg(F.max("version").alias("latest"))
    return deployments_.where("size(types) > 0").join(latest, "project").where("version < latest").select("project", "deployment", F.col("version").alias("served"), "latest")


def content_drift(local: DataFrame, remote: DataFrame, deployments_: DataFrame) -> DataFrame:
    """(project, version, file, change) of each served version against the local files; the head, which has no version, is not compared.

    local: (project, file, sha1); remote: (project, version, file, sha1), a version fetched once whatever deployments serve it.
    """
    served = deployments_.where("version is not null").select("project", "version").distinct()
    key = F.struct("project", "version", "file")
    here = served.join(local, "project").select(key.alias("key"), "sha1")
    there = remote.join(served, ["project", "version"], "left_semi").select(key.alias("key"), "sha1")
    known = remote.select("project", "version").distinct()  # versions that could be fetched
    told = snapshot_diff(here.join(known, (F.col("key.project") == F.col("project")) & (F.col("key.version") == F.col("version")), "left_semi"), there, "key", "sha1")
    names = F.when(F.col("change") == "added", "only_remote").when(F.col("change") == "removed", "only_local").otherwise("modified")
    return told.select("key.project", "key.version", "key.file", names.alias("change"))


def deployment_counts(deployments_: DataFrame, projects: DataFrame) -> DataFrame:
    """One row: projects in all, with a live web app, API, add-on, unknown ones (no row or an error), and the rest, never under 0."""
    has = lambda t: F.bool_or(F.array_contains("types", t) & F.col("version").isNotNull())
    by = deployments_.groupBy("project").agg(has("WEB_APP").alias("w"), has("EXECUTION_API").alias("a"), has("ADD_ON").alias("o"), F.bool_or(F.col("error").isNotNull()).alias("e"))
    p = projects.select("project").distinct().join(by, "project", "left")
    told = p.agg(F.count("*").alias("projects"), F.count_if("w").alias("web_app"), F.count_if("a").alias("api"), F.count_if("o").alias("addon"), F.count_if(F.coalesce("e", F.lit(True))).alias("unknown"))
    return told.withColumn("head_only", F.greatest(F.lit(0), F.col("projects") - F.col("unknown") - F.greatest("web_app", "api", "addon")))
