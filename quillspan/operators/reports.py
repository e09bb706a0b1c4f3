"""Summaries of a store, of its rules and of two snapshots; logs of requests; results of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import normalised, rounded, short_hash
from quillspan.operators import facts as fs
from quillspan.operators.relations import confidence, first_by_key

REQUEST = "id string, need string, context string, at timestamp"


def store_counts(store: DataFrame) -> DataFrame:
    """One row: projects, files, functions, calls of functions, exposures, problems."""
    n = lambda kind: F.count_if(F.col("fact") == kind)
    told = store.agg(F.count_distinct("project").alias("projects"), n("file").alias("files"), n("problem").alias("problems"))
    functions = fs.functions(store)[0].agg(F.count("*").alias("functions"))
    edges = fs.called_by(store).agg(F.coalesce(F.sum("n_callers"), F.lit(0)).alias("edges"))
    exposed = fs.exposures(store).agg(F.count("*").alias("exposures"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(told).join(one(functions), "_k").join(one(edges), "_k").join(one(exposed), "_k").drop("_k")


def rule_counts(findings: DataFrame) -> DataFrame:
    """(kind, severity, findings) of any rules' findings."""
    return findings.groupBy("kind", "severity").agg(F.count("*").alias("findings"))


def diff_coverage(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: mean coverage of the functions of both snapshots, and how far a comparison of them can be trusted (90 and 70)."""
    pct = lambda s: fs.coverage_by_function(s).select("coverage_pct")
    told = pct(before).unionByName(pct(after)).agg(F.coalesce(rounded(F.avg("coverage_pct")), F.lit(100)).alias("pct"))
    return told.withColumn("confidence", confidence(F.col("pct"), 90, 70))


UNCERTAIN = ("dynamic_dispatch", "eval", "function_constructor")


def project_coverage(store: DataFrame, most: int = 20) -> DataFrame:
    """One row a project: pct (mean coverage of its functions, rounded), confidence, uncertain places in all and by kind, and how many functions
    have open returns, dynamic calls or returns that can't be sent to a page, with the first `most` of each by name.
    """
    at = ["project"]
    f = fs.coverage_by_function(store).groupBy(*at).agg(rounded(F.avg("coverage_pct")).alias("pct"))
    places = fs.view(store, "uncertain").groupBy(*at).agg(F.count("*").alias("uncertain"), *[F.count_if(F.col("what") == k).alias(k) for k in UNCERTAIN])
    known = fs.functions(store)[0].select("project", "owner")
    returns = fs.view(store, "returns").join(known, ["project", "owner"], "left_semi")
    open_ = returns.where("open_object = 'true'")
    dynamic = fs.view(store, "uncertain").where("what = 'dynamic_dispatch'").join(known, ["project", "owner"], "left_semi")
    closed = returns.where("serializable = 'false'")
    out = f.withColumn("confidence", confidence(F.col("pct"))).join(places, at, "left").na.fill(0, ["uncertain", *UNCERTAIN])
    for name, rows in (("open_returns", open_), ("dynamic", dynamic), ("not_sendable", closed)):
        out = out.join(first_by_key(rows.select("project", "owner").distinct(), at, ["owner"], most, f"_{name}", name), at, "left")
        out = out.withColumn(name, F.coalesce(name, F.lit(0))).withColumn(f"{name}_names", F.coalesce(F.col(f"_{name}.owner"), F.array().cast("array<string>"))).drop(f"_{name}")
    return out


def chain_counts(store: DataFrame, types: list[str]) -> DataFrame:
    """One row: chains of calls that are checked against a registry of types, and those left out: cut short or from an unknown root."""
    known, cut = F.col("root").isin(types), F.col("truncated")
    return fs.view(store, "chain").agg(F.count_if(known & ~cut).alias("analysed"), F.count_if(cut).alias("truncated"), F.count_if(~known & ~cut).alias("unknown_root"))


def stale_index(files: DataFrame, scanned_at) -> DataFrame:
    """(project, newest, stale): whether a source is newer than the scan of its project; files have mtime."""
    return files.groupBy("project").agg(F.max("mtime").alias("newest")).withColumn("stale", F.col("newest") > scanned_at)


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of JSON lines; broken lines and those without id or need are left out."""
    return spark.read.schema(REQUEST).option("mode", "DROPMALFORMED").json(path).where("id is not null and need is not null")


def request_counts(entries: DataFrame) -> DataFrame:
    """(key, need, occurrences, first_seen, last_seen, context): requests of one need, told in any case, accents or signs, count as one.

    key is the short id of the normalised need, of letters and digits of any script; need is its first wording, context the last that isn't empty; by falling number, then by the last time.
    """
    key = short_hash(normalised(F.col("need")))
    order = F.struct("at", "id")
    told = entries.groupBy(key.alias("key")).agg(F.min_by("need", order).alias("need"), F.count("*").alias("occurrences"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.max_by(F.nullif(F.trim("context"), F.lit("")), F.when(F.trim("context") != "", order)).alias("context"))
    return told.orderBy(F.desc("occurrences"), F.desc("last_seen"), "key")


def write_requests(counted: DataFrame, path: str) -> None:
    """Counted requests as JSON lines, the most frequent first: range-sorted over files in order, not in one task."""
    counted.orderBy(F.desc("occurrences"), F.desc("last_seen"), "key").write.mode("overwrite").json(path)


def task_results(runs: DataFrame) -> DataFrame:
    """One row from (task, verdict, expected, bytes): tasks, detected ones, their share, mean size; tasks without a verdict fail."""
    hit = F.coalesce(F.col("verdict") == F.col("expected"), F.lit(False))
    return runs.agg(F.count("*").alias("tasks"), F.count_if(hit).alias("detected"), rounded(F.coalesce(F.count_if(hit) * 100 / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))).alias("detected_pct"), rounded(F.coalesce(F.avg("bytes"), F.lit(0.0))).alias("mean_bytes"))


def doctor(checks: DataFrame) -> DataFrame:
    """One row from (check, status ok, warn or fail): counts, whether all is well, and the exit code (2 with a failure)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return checks.agg(n("ok").alias("ok"), n("warn").alias("warn"), n("fail").alias("fail")).withColumn("well", F.col("fail") == 0).withColumn("exit_code", F.when(F.col("fail") > 0, 2).otherwise(0))


def exit_code(verdicts: DataFrame, warn: bool = False) -> DataFrame:
    """(verdict, exit_code): 3 for BREAK, 4 for WARN where warnings are to be told, else 0."""
    return verdicts.select("verdict", F.when(F.col("verdict") == "BREAK", 3).when((F.col("verdict") == "WARN") & F.lit(warn), 4).otherwise(0).alias("exit_code"))
