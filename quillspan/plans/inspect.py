"""One function at a time: definition, callers, callees, contract, patterns, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import facts as fs
from quillspan.operators.relations import confidence, coverage, first_by_key
from quillspan.operators.similarity import similar_names

#: Parts of each level of detail; a list of parts given by name wins over the level.
LEVELS = {
    "summary": ["exposures"],
    "standard": ["definition", "callers", "callees", "exposures"],
    "full": ["definition", "callers", "callees", "exposures", "contract", "patterns", "coverage"],
    "graph": ["callers", "callees"],
}
PATTERN_FACTS = ["array2d", "destructuring", "lock", "loop_call", "property", "template", "uncertain"]


def signature(store: DataFrame) -> DataFrame:
    """(project, owner, signature): name(param: type, ...) -> type, with the types that the documentation gives."""
    at = ["project", "owner"]
    types = fs.view(store, "doc_param").groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct("param", "type"))).alias("_types"))
    returns = fs.view(store, "doc").select(*at, "returns_type")
    f = fs.functions(store)[0].join(types, at, "left").join(returns, at, "left")
    typed = F.transform("params", lambda p: F.concat(p, F.coalesce(F.concat(F.lit(": "), F.try_element_at("_types", p)), F.lit(""))))
    return f.select(*at, F.concat("owner", F.lit("("), F.array_join(typed, ", "), F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), "returns_type"), F.lit(""))).alias("signature"))


def inspect(store: DataFrame, name: str, project: str | None = None, level: str = "standard", parts: list[str] | None = None, most: int = 100) -> DataFrame:
    """A row for each project that defines the function: project, symbol, signature and the parts asked for.

    Filters by name go to the store's scan. `most` limits the callers shown; how many there are in all is told beside them.
    """
    wanted = set(LEVELS["full"]) if parts and "all" in parts else set(parts or LEVELS[level])
    at = ["project", "symbol"]
    store = store if project is None else store.where(F.col("project") == project)
    mine = F.col("owner") == name
    own = store.where(mine)
    f = fs.functions(own)[0]
    out = f.select("project", F.col("owner").alias("symbol")).join(signature(own).withColumnRenamed("owner", "symbol"), at)
    add = lambda df: out.join(df, at, "left")
    if "definition" in wanted:
        out = add(f.select("project", F.col("owner").alias("symbol"), "file", "line", "end_line", "visibility", "params"))
    if "callers" in wanted:
        found = fs.consumers(store).where(F.col("symbol") == name).select(*at, "kind", "file", "line", "owner")
        out = add(first_by_key(found, at, ["kind", "file", "line", "owner"], most, "callers", "callers_total")).withColumn("callers_total", F.coalesce("callers_total", F.lit(0)))
        out = out.withColumn("callers_shown", F.coalesce(F.size("callers"), F.lit(0)))
    if "callees" in wanted:
        out = add(fs.view(own, "call").groupBy("project", F.col("owner").alias("symbol")).agg(F.array_sort(F.collect_set("callee")).alias("callees")))
    if "exposures" in wanted:
        found = fs.exposures(store.where(mine | F.col("fact").isin("client_call", "scriptlet_call", "trigger"))).where(F.col("symbol") == name)
        out = add(found.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("type", "n_sites"))).alias("exposures")))
    if "contract" in wanted:
        told = fs.view(own, "doc").select("project", F.col("owner").alias("symbol"), "returns_type", "returns_fields")
        typed = fs.view(own, "doc_param").groupBy("project", F.col("owner").alias("symbol")).agg(F.bool_or(F.col("type").isNotNull()).alias("_typed"))
        read = fs.field_reads(store.where(mine | F.col("fact").isin("client_call", "handler_read"))).where(F.col("symbol") == name).groupBy(*at).agg(F.array_sort(F.collect_set("field")).alias("fields_read"))
        shape = fs.view(own, "returns").select("project", F.col("owner").alias("symbol"), "serializable", "nullable", F.col("fields").alias("fields_made"))
        out = add(told)
        out = add(typed)
        out = add(read)
        out = add(shape)
        doc, use = F.col("returns_type").isNotNull() | F.coalesce("_typed", F.lit(False)), F.size(F.coalesce("fields_read", F.array().cast("array<string>"))) > 0
        out = out.withColumn("contract_source", F.when(doc & use, "mixed").when(use, "inferred_from_usage").when(doc, "from_documentation").otherwise("unknown")).drop("_typed")
    if "patterns" in wanted:
        out = add(own.where(F.col("fact").isin(PATTERN_FACTS)).groupBy("project", F.col("owner").alias("symbol")).agg(F.array_sort(F.collect_list(F.struct("fact", "line"))).alias("patterns")))
    if "coverage" in wanted:
        n = fs.view(own, "uncertain").groupBy("project", F.col("owner").alias("symbol")).agg(F.count("*").alias("uncertain"))
        out = add(n).withColumn("uncertain", F.coalesce("uncertain", F.lit(0))).withColumn("coverage_pct", coverage(F.col("uncertain"))).withColumn("confidence", confidence(F.col("coverage_pct")))
    return out


def suggestions(store: DataFrame, name: str, most: int = 5) -> DataFrame:
    """(other, distance, place): functions whose names are near one that isn't there."""
    asked = store.sparkSession.createDataFrame([(name,)], "owner string")
    return similar_names(asked, fs.functions(store)[0].select("owner"), "owner", most)
