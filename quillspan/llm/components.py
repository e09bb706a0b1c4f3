"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, component): for each end of an edge (u, v), the least id it reaches.

    Self-links, repeated and reversed edges are allowed; nulls are not.
    An empty input gives an empty result. `rows`, if given, is about how many
    edges differ; only the number of files depends on it. A round makes two tables: for each
    node the least of its neighbours and how many of them are smaller and
    larger, and the edges that large-star and then small-star leave. Rounds
    end when the first of them shows that the edges are stars already: no
    node has two smaller neighbours, or smaller and larger ones.

    Leasts are partial aggregates joined back, never gathered lists: the skew
    join can split a hub with millions of neighbours, and a table of leasts
    is broadcast only if its files are under Spark's broadcast threshold.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows)
    rows = edges.count()
    while True:  # every round brings each node nearer to its least; it ends with stars
        links = _both_ways(edges)
        near = stored(links.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("least"), F.count_if(F.col("v") < F.col("u")).alias("down"), F.count_if(F.col("v") > F.col("u")).alias("up")), 2 * rows)
        if near.where("down > 1 or (down > 0 and up > 0)").isEmpty():
            break
        # large-star: larger neighbours of c go to the least of c and its neighbours
        large = links.join(near.select("c", F.least("c", "least").alias("m")), F.col("u") == F.col("c")).where("v > c").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: edges go from the larger end u to the smaller v; u and its smaller neighbours get the least of them
        low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        edges = stored(small.distinct(), rows)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def id_ties(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Edges (u, v) that make the classes of one id's rows one component.

    rows (id, key) may repeat ids; classes has a node for each key. Only rows of repeated ids are joined.
    """
    again = rows.groupBy(F.col("id").alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1")
    nodes = rows.join(again, F.col("id") == F.col("_again"), "left_semi").select("id", F.col(key).alias("_key")).distinct().join(classes.select(F.col(key).alias("_key2"), "node"), F.col("_key") == F.col("_key2")).select("id", "node")
    least = nodes.groupBy(F.col("id").alias("_id")).agg(F.min("node").alias("v"), F.max("node").alias("_most")).where("v < _most")
    return nodes.join(least, F.col("id") == F.col("_id")).where("node <> v").select(F.col("node").alias("u"), "v")


def least_ids(classes: DataFrame, edges: DataFrame, rows: int | None = None) -> DataFrame:
    """classes (node, rep, ...) with component, a node of the node's component, and c, the least rep in it."""
    linked = stored(components(edges, rows), rows)
    least = linked.join(classes.select("node", "rep"), F.col("id") == F.col("node")).groupBy(F.col("component").alias("_c")).agg(F.min("rep").alias("_least"))
    found = linked.join(least, F.col("component") == F.col("_c")).select(F.col("id").alias("_id"), "_c", "_least")
    return classes.join(found, F.col("node") == F.col("_id"), "left").withColumn("component", F.coalesce("_c", "node")).withColumn("c", F.coalesce("_least", "rep")).drop("_id", "_c", "_least")
