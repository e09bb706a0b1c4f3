"""Workspaces: a manifest of apps, environments and one shared library, over the projects of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import rounded
from quillspan.operators import facts as fs

_REF = "struct<script_id:string,clasp_path:string,deployment_id:string,gcp_project_id:string,exec_url:string,dev_url:string,container_id:string>"
#: What a workspace manifest may say; other keys are ignored.
WORKSPACE = f"version int, name string, apps array<struct<name:string,library_prefix:string,description:string,site_embeds:array<string>,projects:struct<dev:{_REF},prod:{_REF}>>>, library struct<name:string,user_symbol:string,script_id:string,prod_version:int>, environments map<string,struct<resources:map<string,string>>>"


def workspaces(files: DataFrame) -> DataFrame:
    """(path, errors, version, name, apps, library, environments) of (path, content).

    What can't be read or breaks a rule has errors, in order, and no other value: apps need names, ids that are given must not
    be empty, the library needs an id and a pinned version above 0.
    """
    ok = F.coalesce(F.try_parse_json("content").cast("string").startswith("{"), F.lit(False))
    m = files.select("path", ok.alias("_ok"), F.from_json("content", WORKSPACE).alias("m"))
    empty = lambda c: F.coalesce(F.length(c) == 0, F.lit(False))
    when = lambda bad, text: F.when(bad, text)
    at = lambda i, rest: F.concat(F.lit("apps."), i.cast("string"), F.lit(rest))
    of_app = lambda a, i: F.array(
        when(a["name"].isNull() | empty(a["name"]), at(i, ".name: needed")),
        when(empty(a["projects"]["dev"]["script_id"]), at(i, ".projects.dev.script_id: empty")),
        when(empty(a["projects"]["prod"]["script_id"]), at(i, ".projects.prod.script_id: empty")),
    )
    lib = F.col("m.library")
    errors = F.concat(
        F.array(when(F.coalesce(F.col("m.version") < 1, F.lit(False)), F.lit("version: must be above 0"))),
        F.flatten(F.transform(F.coalesce(F.col("m.apps"), F.array().cast(m.schema["m"].dataType["apps"].dataType)), of_app)),
        F.array(when(lib.isNotNull() & (lib["script_id"].isNull() | empty(lib["script_id"])), F.lit("library.script_id: needed")), when(lib.isNotNull() & (lib["prod_version"].isNull() | (lib["prod_version"] < 1)), F.lit("library.prod_version: must be above 0"))),
    )
    told = m.withColumn("errors", F.when(F.col("_ok"), F.array_compact(errors)).otherwise(F.array(F.lit("not a JSON object"))))
    good = F.size("errors") == 0
    return told.select("path", "errors", F.when(good, F.coalesce("m.version", F.lit(1))).alias("version"), *[F.when(good, F.col(f"m.{c}")).alias(c) for c in ("name", "apps", "library", "environments")])


def targets(workspace: DataFrame) -> DataFrame:
    """(app, env, project, script_id, library_prefix, embedded): the projects that apps declare, by their folder."""
    app = workspace.where("apps is not null").select(F.explode("apps").alias("a"))
    rows = app.select("a", F.explode(F.array(*[F.struct(F.lit(e).alias("env"), F.col("a.projects")[e].alias("ref")) for e in ("dev", "prod")])).alias("t")).where("t.ref is not null")
    return rows.select(F.col("a.name").alias("app"), "t.env", F.col("t.ref.clasp_path").alias("project"), F.col("t.ref.script_id").alias("script_id"), "a.library_prefix", (F.size(F.coalesce("a.site_embeds", F.array().cast("array<string>"))) > 0).alias("embedded"))


def library(workspace: DataFrame) -> DataFrame:
    return workspace.where("library is not null").select("library.user_symbol", "library.script_id", "library.prod_version")


def resources(workspace: DataFrame) -> DataFrame:
    """(env, name, id) of the resources of each environment; without an id they don't count."""
    env = workspace.where("environments is not null").select(F.explode("environments").alias("env", "e")).select("env", F.explode("e.resources").alias("name", "id"))
    return env.where("id <> ''")


def owners(resources_: DataFrame) -> DataFrame:
    """(id, owners): environments and names that a resource id belongs to; a shared one has several."""
    return resources_.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("env", "name"))).alias("owners"))


def pick(frame: DataFrame, wanted: str, by: str = "project") -> DataFrame:
    """Rows of the project of that name, else of all whose name ends with `/wanted`; whether there is one is looked up first."""
    exact = frame.where(F.col(by) == wanted)
    return frame.where(F.col(by).endswith("/" + wanted)) if exact.isEmpty() else exact


def projects_of(store: DataFrame, name: str) -> DataFrame:
    """(symbol, projects, choice): the projects that define a function; one is the choice, none or many leave it open."""
    own = fs.functions(store)[0].where(F.col("owner") == name)
    told = own.groupBy(F.col("owner").alias("symbol")).agg(F.array_sort(F.collect_set("project")).alias("projects"))
    return told.withColumn("choice", F.when(F.size("projects") == 1, F.col("projects")[0]))


def merged_settings(existing: DataFrame, generated: DataFrame, key: str, lists: list[str], scalars: list[str]) -> DataFrame:
    """Settings by key after generated ones came to existing ones: lists keep what they have, in order, and get what is new to them at their end, each once; scalars are filled only where there is none.

    A key that one side has is taken as it is; a null list is an empty one.
    """
    columns = [*lists, *scalars]
    a, b = existing.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns]), generated.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    out = a.join(b, F.col(key) == F.col("_key"), "full_outer")
    empty = lambda c, x: F.coalesce(F.col(c), F.array().cast(existing.schema[x].dataType))
    own = lambda c: F.concat(empty(f"_a_{c}", c), F.array_distinct(F.array_except(empty(f"_b_{c}", c), empty(f"_a_{c}", c))))
    return out.select(F.coalesce(key, "_key").alias(key), *[own(c).alias(c) for c in lists], *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in scalars])


def rekeyed(store: DataFrame, project: str, new: str) -> DataFrame:
    """The store with a project under another name."""
    return store.withColumn("project", F.when(F.col("project") == project, F.lit(new)).otherwise(F.col("project")))


def attributed(findings: DataFrame) -> DataFrame:
    """Findings with app and env, read from symbols `app::env::name`; null for those of the manifest as a whole."""
    p = F.split("symbol", "::")
    told = (F.size(p) == 3) & (F.get(p, F.lit(1)) == "env") & (F.get(p, F.lit(0)) != "") & (F.get(p, F.lit(2)) != "")
    return findings.withColumn("app", F.when(told, F.get(p, F.lit(0)))).withColumn("env", F.when(told, F.get(p, F.lit(2))))


def on_head(version: Column, development: Column) -> Column:
    return F.coalesce(development, F.lit(False)) | F.upper(F.coalesce(version, F.lit(""))).isin("", "0", "HEAD")


def consumed(manifest: DataFrame, library_: DataFrame) -> DataFrame:
    """(project, version, head, script_id): the first entry of a manifest that is the shared library, by symbol or by id."""
    used = manifest.select("project", F.posexplode("libraries").alias("at", "l"))
    same = ["project", "at", F.struct("l", "script_id").alias("l")]
    by_symbol = used.join(library_, F.col("l.userSymbol") == F.col("user_symbol")).select(*same)
    by_id = used.where("l.libraryId <> ''").join(library_, F.col("l.libraryId") == F.col("script_id")).select(*same)
    first = by_symbol.unionByName(by_id).groupBy("project").agg(F.min_by("l", "at").alias("l"))
    head = on_head(F.col("l.l.version"), F.col("l.l.developmentMode"))
    return first.select("project", F.when(head, "HEAD").otherwise(F.col("l.l.version")).alias("version"), head.alias("head"), "l.script_id")


def overview(targets_: DataFrame, store: DataFrame, manifest: DataFrame, library_: DataFrame, findings: DataFrame) -> DataFrame:
    """One row an app and environment: whether its project is there, the library's version and mode, functions, documented share of public ones, verdict.

    findings: those of environment rules, whose symbols name app and environment.
    """
    f = fs.functions(store)[0]
    summed = fs.view(store, "doc").where("length(summary) > 0").select("project", "owner", F.lit(1).alias("_d"))
    public = F.col("visibility") == "public"
    counts = f.join(summed, ["project", "owner"], "left").groupBy("project").agg(F.count("*").alias("functions"), F.count_if(public).alias("_public"), F.count_if(public & F.col("_d").isNotNull()).alias("_told"))
    there = manifest.select("project", F.lit(True).alias("present")).distinct()
    own = attributed(findings).where("app is not null").groupBy("app", "env").agg(F.bool_or(F.col("severity") == "break").alias("_b"), F.bool_or(F.col("severity") == "warn").alias("_w"))
    out = targets_.join(there, "project", "left").join(consumed(manifest, library_), "project", "left").join(counts, "project", "left").join(own, ["app", "env"], "left")
    present = F.coalesce("present", F.lit(False))
    mode = F.when(F.col("head").isNull(), "none").when(F.col("head"), "HEAD").otherwise("pinned")
    verdict = F.when(F.coalesce("_b", F.lit(False)), "BREAK").when(F.coalesce("_w", F.lit(False)), "WARN").otherwise("CLEAN")
    doc = F.when(F.col("_public") > 0, rounded(F.col("_told") * 100 / F.col("_public")))
    return out.select("app", "env", present.alias("present"), F.col("version").alias("lib_version"), mode.alias("lib_mode"), F.when(present, F.coalesce("functions", F.lit(0))).alias("functions"), doc.alias("doc_pct"), verdict.alias("verdict"))


def library_scopes(store: DataFrame, manifest: DataFrame, targets_: DataFrame, library_: DataFrame, scopes: dict[str, list[str]]) -> DataFrame:
    """(project, app, env, missing): consumers with explicit scopes that lack some the library needs.

    The library is the app that has its symbol as prefix or its id as a project's. It needs the scopes its manifest declares, and for each service it uses
    any of the scopes that the service accepts; of those the first is told as missing.
    """
    by_prefix = targets_.drop("script_id").join(library_.select(F.col("user_symbol").alias("library_prefix"), "script_id"), "library_prefix").select("project", "app", "script_id")
    provider = targets_.join(library_.select("script_id"), "script_id").select("project", "app", "script_id").unionByName(by_prefix).distinct()
    told = manifest.join(provider, "project").select("app", "script_id", F.explode("scopes").alias("scope"))
    needed = told.select("app", "script_id", F.array("scope").alias("any"), "scope")
    roots = fs.view(store, "call").select("project", fs.root_name("receiver").alias("root")).distinct().join(provider, "project")
    accept = F.create_map(*[x for k, v in scopes.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    services = roots.select("app", "script_id", F.try_element_at(accept, F.col("root")).alias("any")).where("any is not null").select("app", "script_id", "any", F.col("any")[0].alias("scope"))
    need = needed.unionByName(services).distinct().groupBy(F.col("app").alias("_provider"), "script_id").agg(F.collect_list(F.struct("any", "scope")).alias("need"))
    use = targets_.select("project", "app", "env").join(consumed(manifest, library_).select("project", "script_id"), "project").join(manifest.where("size(scopes) > 0").select("project", "scopes"), "project")
    lack = F.array_sort(F.array_distinct(F.transform(F.filter("need", lambda n: ~F.arrays_overlap(n["any"], F.col("scopes"))), lambda n: n["scope"])))
    # by the library that is consumed; it doesn't need anything of itself
    return use.join(need, "script_id").where("app <> _provider").withColumn("missing", lack).where("size(missing) > 0").select("project", "app", "env", "missing")
