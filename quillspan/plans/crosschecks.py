"""The store against what is outside one project: other projects' libraries, execution logs, deployments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.findings import heat_of
from quillspan.operators import facts as fs
from quillspan.operators.relations import fallback_join

#: The rate of errors from which a function counts as failing.
ERRORED = 0.05


def library_calls(store: DataFrame, manifest: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """Calls `Prefix.f()` of declared libraries with the project that provides them; null where none does.

    providers: (prefix, env, provider). A project named as the prefix comes first, then the caller's own environment (the last
    part of its name), dev, prod, any. Each key has one provider, the least by name, so no join multiplies rows.
    """
    if providers is None:
        providers = store.select(F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("env"), F.lit(None).cast("string").alias("provider")).where("false")
    declared = manifest.select("project", F.explode("libraries.userSymbol").alias("receiver")).distinct()
    calls = fs.view(store, "call").join(declared, ["project", "receiver"]).select("project", "file", "line", F.col("owner").alias("caller"), F.col("receiver").alias("prefix"), F.col("final_name").alias("function"), F.size("args").alias("n_args"))
    key = lambda env: F.concat_ws("|", "prefix", env)
    calls = calls.withColumn("_own", key(F.element_at(F.split("project", "/"), -1))).withColumn("_dev", key(F.lit("dev"))).withColumn("_prod", key(F.lit("prod")))
    named = store.select(F.col("project").alias("k"), F.col("project").alias("v")).distinct()
    by_env = providers.groupBy(key(F.col("env")).alias("k")).agg(F.min("provider").alias("v"))
    by_any = providers.groupBy(F.col("prefix").alias("k")).agg(F.min("provider").alias("v"))
    met = fallback_join(calls, [(named, "k", "prefix", "v"), (by_env, "k", "_own", "v"), (by_env, "k", "_dev", "v"), (by_env, "k", "_prod", "v"), (by_any, "k", "prefix", "v")], "provider")
    return met.select("project", "file", "line", "caller", "prefix", "provider", "function", "n_args")


def library_edges(store: DataFrame, manifest: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """Library calls that meet a public function of their provider; calls without one are left out."""
    met = library_calls(store, manifest, providers)
    public = fs.functions(store)[0].where("visibility = 'public'").select(F.col("project").alias("provider"), F.col("owner").alias("function"))
    return met.join(public, ["provider", "function"], "left_semi").select("project", "file", "line", "caller", "prefix", "provider", "function", "n_args")


def status_of(heat: Column, runs: Column, errors: Column, seen: Column) -> Column:
    """The first of: unknown, errored, confirmed_dead, dispatched_dynamic, cold_exposed, live; seen: whether code or pages reach it."""
    failing = (runs > 0) & (errors / F.nullif(runs, F.lit(0)) >= ERRORED)
    return F.when(heat == "unknown", "unknown").when(failing, "errored").when(~seen & (heat == "cold"), "confirmed_dead").when(~seen, "dispatched_dynamic").when(heat == "cold", "cold_exposed").otherwise("live")


def prod_truth(store: DataFrame, metrics: DataFrame, days: int) -> DataFrame:
    """Functions with heat and status by their log; metrics: (project, symbol, runs, errors) over so many days.

    A function without a row, or with null runs, is unknown. Statuses are told in order: unknown, errored, confirmed_dead,
    dispatched_dynamic, cold_exposed, live.
    """
    at = ["project", "symbol"]
    f = fs.functions(store)[0].select("project", F.col("owner").alias("symbol"))
    seen = fs.exposures(store).select(*at).unionByName(fs.called_by(store).select(*at)).distinct().withColumn("_seen", F.lit(True))
    out = f.join(metrics, at, "left").join(seen, at, "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    out = out.withColumn("heat", heat_of(F.col("runs"), days))
    return out.select(*at, "runs", "errors", "heat", status_of(F.col("heat"), F.col("runs"), F.col("errors"), F.col("_seen")).alias("status"))


def deployment_status(store: DataFrame, deployments: DataFrame) -> DataFrame:
    """Functions with what serves them: live_web_app, live_addon, live_api (public only), else head_only; unknown without a row.

    deployments: (project, type, version), type WEB_APP, ADD_ON, EXECUTION_API or null; a null version is the head, which serves nobody.
    """
    live = lambda kind: F.count_if((F.col("type") == kind) & F.col("version").isNotNull()) > 0
    by = deployments.groupBy("project").agg(live("WEB_APP").alias("_web"), live("ADD_ON").alias("_addon"), live("EXECUTION_API").alias("_api"))
    out = fs.functions(store)[0].join(by, "project", "left")
    status = (
        F.when(F.col("_web").isNull(), "unknown").when(F.col("owner").isin(fs.WEB_ENTRIES) & F.col("_web"), "live_web_app").when(F.col("owner").isin(fs.SIMPLE_TRIGGERS) & F.col("_addon"), "live_addon")
        .when((F.col("visibility") == "public") & F.col("_api"), "live_api").otherwise("head_only")
    )
    return out.select("project", F.col("owner").alias("symbol"), status.alias("status"))
