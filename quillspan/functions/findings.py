"""Findings: one schema for every rule, ranks of severities, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities from the worst.
SEVERITIES = ("break", "warn", "info")


def finding(rule: str, severity: str, symbol: Column, reason: Column) -> list[Column]:
    return [F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), symbol.cast("string").alias("symbol"), reason.alias("reason")]


def rank(severity: str = "severity") -> Column:
    """0 for break, 1 for warn, 2 for info; null for others."""
    return reduce(lambda c, i: c.when(F.col(severity) == SEVERITIES[i], i), range(1, 3), F.when(F.col(severity) == SEVERITIES[0], 0))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(rank() <= SEVERITIES.index(severity))


def union(*findings: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), findings)


def verdict(findings: DataFrame, *by: str) -> DataFrame:
    """Counts by severity and the verdict of each group: BREAK over WARN over CLEAN. Partial aggregates, one row a group."""
    n = lambda s: F.count_if(F.col("severity") == s)
    told = findings.groupBy(*by).agg(n("break").alias("breaks"), n("warn").alias("warns"), n("info").alias("infos"))
    return told.withColumn("verdict", F.when(F.col("breaks") > 0, "BREAK").when(F.col("warns") > 0, "WARN").otherwise("CLEAN"))


#: Runs a day from which a function is hot.
HOT_A_DAY = 1


def heat_of(runs: Column, days: int) -> Column:
    """unknown without a number, cold without a run, hot from HOT_A_DAY runs a day, else warm."""
    return F.when(runs.isNull(), "unknown").when(runs == 0, "cold").when(runs / max(1, days) >= HOT_A_DAY, "hot").otherwise("warm")
