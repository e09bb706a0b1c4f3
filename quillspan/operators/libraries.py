"""Libraries that projects declare: where their code comes from, and code fetched earlier as projects of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators import facts as fs

#: A fetched library: what was got for an id and version ("HEAD" without one): files, an error, or neither.
FETCHED = "script_id string, version string, files array<struct<name:string,type:string,source:string>>, error string"


def statuses(store: DataFrame, manifest: DataFrame, fetched: DataFrame) -> DataFrame:
    """(project, user_symbol, library_id, version, status, n_calls) of each declared library.

    local: another project has that name, in any case. declared_unused: nothing calls it. Else by what was fetched:
    external_resolved with files, external_unresolvable with an error, external_unfetched without a row.
    """
    declared = manifest.select("project", F.explode("libraries").alias("l")).select("project", F.col("l.userSymbol").alias("user_symbol"), F.col("l.libraryId").alias("library_id"), F.coalesce(F.nullif(F.col("l.version"), F.lit("")), F.lit("HEAD")).alias("version"))
    calls = fs.view(store, "call").select("project", fs.root_name("receiver").alias("user_symbol")).where("user_symbol is not null").groupBy("project", "user_symbol").agg(F.count("*").alias("n_calls"))
    # how many projects have the name; one's own is taken off
    named = store.select("project").distinct().groupBy(F.lower("project").alias("_name")).agg(F.count("*").alias("_n"))
    got = fetched.groupBy(F.col("script_id").alias("_id"), F.col("version").alias("_v")).agg(F.bool_or(F.col("files").isNotNull()).alias("_files"), F.bool_or(F.col("error").isNotNull()).alias("_error"))
    out = declared.join(calls, ["project", "user_symbol"], "left").join(named, F.lower("user_symbol") == F.col("_name"), "left").join(got, (F.col("library_id") == F.col("_id")) & (F.col("version") == F.col("_v")), "left")
    others = F.coalesce("_n", F.lit(0)) - F.when(F.lower("user_symbol") == F.lower("project"), 1).otherwise(0)
    status = F.when(others > 0, "local").when(F.col("n_calls").isNull(), "declared_unused").when(F.col("_files"), "external_resolved").when(F.col("_error"), "external_unresolvable").otherwise("external_unfetched")
    return out.select("project", "user_symbol", "library_id", "version", status.alias("status"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"))


def status_counts(statuses_: DataFrame) -> DataFrame:
    names = ("local", "declared_unused", "external_resolved", "external_unresolvable", "external_unfetched")
    return statuses_.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == n).alias(n) for n in names])


def as_files(fetched: DataFrame) -> DataFrame:
    """(project, file, kind, content) of fetched libraries' files, projects named lib:id@version; scripts and pages only."""
    kind = F.when(F.upper("f.type") == "SERVER_JS", "gs").when(F.upper("f.type") == "HTML", "html").when(F.upper("f.type") == "JSON", "manifest")
    rows = fetched.where("files is not null").select(F.concat(F.lit("lib:"), "script_id", F.lit("@"), "version").alias("project"), F.explode("files").alias("f"))
    return rows.select("project", F.concat("f.name", F.when(kind == "gs", ".gs").when(kind == "html", ".html").otherwise(".json")).alias("file"), kind.alias("kind"), F.col("f.source").alias("content")).where("kind is not null")


def enriched(store: DataFrame, statuses_: DataFrame, fetched: DataFrame) -> DataFrame:
    """The store with the resolved libraries as projects named by the symbol that calls them; a name that is there already stays as it is, and of two libraries of one name the first by id wins.

    Calls of a library then meet it by its name, as those of any project do.
    """
    first = Window.partitionBy(F.lower("user_symbol")).orderBy("library_id", "version")
    wanted = statuses_.where("status = 'external_resolved'").select("user_symbol", "library_id", "version").distinct().withColumn("_n", F.row_number().over(first)).where("_n = 1")
    known = store.select(F.lower("project").alias("_known")).distinct()
    wanted = wanted.join(known, F.lower("user_symbol") == F.col("_known"), "left_anti")
    named = wanted.select("user_symbol", F.concat(F.lit("lib:"), "library_id", F.lit("@"), "version").alias("project"))
    new = as_files(fetched).join(named, "project").select(F.col("user_symbol").alias("project"), "file", "kind", "content")
    return store.unionByName(fs.facts(new))


def to_fetch(statuses_: DataFrame, cache: DataFrame, refresh: bool = False) -> DataFrame:
    """(script_id, version) of libraries in use that the cache hasn't; with refresh, of all in use."""
    use = statuses_.where("status like 'external_%'").select(F.col("library_id").alias("script_id"), "version").distinct()
    return use if refresh else use.join(cache.select("script_id", "version"), ["script_id", "version"], "left_anti")


def cached(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh rows in place of those of the same id and version."""
    return cache.join(fresh.select("script_id", "version").distinct(), ["script_id", "version"], "left_anti").unionByName(fresh.select(*cache.columns))


def script_ids(projects: DataFrame, clasp: DataFrame, overrides: DataFrame) -> DataFrame:
    """(project, script_id): an override before what the project's own settings file says."""
    a, b = clasp.select("project", F.col("script_id").alias("_own")), overrides.select("project", F.col("script_id").alias("_over"))
    return projects.join(a, "project", "left").join(b, "project", "left").select("project", F.coalesce("_over", "_own").alias("script_id"))


def id_conflicts(clasp: DataFrame, targets: DataFrame) -> DataFrame:
    """(project, env, declared, own): projects whose own script id is not the one that the workspace declares."""
    declared = targets.where("script_id is not null").select("project", "env", F.col("script_id").alias("declared"))
    return declared.join(clasp.select("project", F.col("script_id").alias("own")), "project").where("declared <> own").select("project", "env", "declared", "own")
