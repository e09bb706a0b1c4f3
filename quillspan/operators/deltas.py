"""Counts kept up to date by signed rows: what came counts +1, what went -1, and only keys that either names are counted anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signed(gone: DataFrame, come: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, d): the change in the number of equal rows, from rows that went and rows that came; rows that did both don't show."""
    d = gone.select(*keys, F.lit(-1).cast("long").alias("d")).unionByName(come.select(*keys, F.lit(1).cast("long").alias("d")))
    return d.groupBy(*keys).agg(F.sum("d").alias("d")).where("d <> 0")


def edge_counts(rows: DataFrame, key: list[str], member: list[str]) -> DataFrame:
    """(key, member, n): how many rows link a key to a member."""
    return rows.groupBy(*key, *member).agg(F.count("*").alias("n"))


def members(edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, members, links): different members of a key, and rows that link them."""
    return edges.groupBy(*key).agg(F.count("*").alias("members"), F.sum("n").alias("links"))


def _touched(df: DataFrame, delta: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Rows of df whose keys the delta names, or doesn't; keys are told apart with null as a value."""
    named = delta.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(named, on, how)


def maintained_edges(edges: DataFrame, delta: DataFrame, key: list[str], member: list[str]) -> DataFrame:
    """(key, member, n) of the keys that the delta names, after it; members that nothing links any more are gone.

    edges (key, member, n), written; delta as of signed() with key and member.
    A changed key's edges are its old ones and the delta, added up; edges of
    other keys are neither moved nor summed: the small delta is broadcast to
    the scan where Spark knows it to be small.
    """
    before = _touched(edges, delta, key, "left_semi").select(*key, *member, F.col("n").alias("d"))
    return before.unionByName(delta.select(*key, *member, "d")).groupBy(*key, *member).agg(F.sum("d").alias("n")).where("n > 0")


def maintained_members(counts: DataFrame, edges: DataFrame, delta: DataFrame, key: list[str], member: list[str]) -> DataFrame:
    """members() after a delta, from members() and edges before it: counts of keys that it doesn't name are taken over as they are."""
    fresh = members(maintained_edges(edges, delta, key, member), key)
    return _touched(counts, delta, key, "left_anti").select(*key, "members", "links").unionByName(fresh)
