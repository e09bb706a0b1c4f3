"""Chains of steps walked through a table of transitions, of any length and any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.sources.shared import stored

#: Steps that are put together at once.
BLOCK = 64
_END = "struct<to:string,done:bigint,stopped:boolean>"


def _then(state: Column, unit: Column) -> Column:
    """What a unit (its ends by the type it starts from) makes of a state; the first unit that doesn't know the type stops it."""
    end = F.try_element_at(unit, state["to"])
    on = F.struct(end["to"].alias("to"), (state["done"] + end["done"]).alias("done"), end["stopped"].alias("stopped"))
    return F.when(state["stopped"], state).when(end.isNull(), F.struct(state["to"].alias("to"), state["done"].alias("done"), F.lit(True).alias("stopped"))).otherwise(on)


def walk(steps: DataFrame, roots: DataFrame, registry: DataFrame, chain: str = "chain") -> DataFrame:
    """(chain, type, done, stopped) of each root (chain, type): the type that its chain's steps lead to, how many were taken, and whether an unknown one stopped it.

    steps (chain, pos, step), pos from 0 without a gap; registry (type, step,
    returns), one row for a type and step. Both may be of any size. Each step meets
    the registry once: it becomes its ends by the type it may start from. Then
    runs of BLOCK steps are put together to one unit, from each type that its
    first step knows, and runs of BLOCK units again, until a chain is one
    unit: a chain of n steps takes log n rounds to the base BLOCK, and no task
    holds more than BLOCK units of one. A step that the registry hasn't ends
    the chain for every type. Chains without steps stay at their root. Null
    steps are unknown.
    """
    ends = registry.where("type is not null and step is not null").groupBy(F.col("step").alias("_step")).agg(F.map_from_entries(F.collect_list(F.struct("type", F.struct(F.col("returns").alias("to"), F.lit(1).cast("long").alias("done"), F.lit(False).alias("stopped"))))).alias("_ends"))
    unit = F.coalesce("_ends", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{_END}>")))
    units = stored(steps.join(ends, F.col("step") == F.col("_step"), "left").select(F.col(chain).alias("chain"), "pos", unit.alias("unit")))
    longest = (units.agg(F.max("pos")).first()[0] or 0) + 1
    while longest > 1:
        run = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.map_entries("unit").alias("e")))), lambda x: F.map_from_entries(x["e"]))
        together = units.withColumn("e", F.floor(F.col("pos") / BLOCK)).groupBy("chain", F.col("e").alias("pos")).agg(run.alias("run"))
        whole = F.transform(F.map_entries(F.element_at("run", 1)), lambda x: F.struct(x["key"].alias("key"), F.aggregate(F.slice("run", F.lit(2), F.size("run")), x["value"], _then).alias("value")))
        units = stored(together.select("chain", "pos", F.map_from_entries(whole).alias("unit")))
        longest = -(-longest // BLOCK)
    start = F.struct(F.col("type").alias("to"), F.lit(0).cast("long").alias("done"), F.lit(False).alias("stopped"))
    met = roots.select(F.col(chain).alias("_chain"), "type").join(units.select("chain", "unit"), F.col("_chain") == F.col("chain"), "left")
    end = F.when(F.col("unit").isNull(), start).otherwise(_then(start, F.col("unit")))
    return met.select("_chain", end.alias("e")).select(F.col("_chain").alias(chain), F.col("e.to").alias("type"), "e.done", "e.stopped")
