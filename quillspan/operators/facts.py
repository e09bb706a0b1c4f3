"""The fact store: files to facts, parsed once in Arrow batches, and what is derived from facts by joins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.extract import VIEWS
from quillspan.functions.shapes import Shapes
from quillspan.operators.relations import first_by_key, first_wins
from quillspan.sources.shared import stored

SCHEMA = "project string, file string, fact string, owner string, line int, col int, a string, b string, c string, d string, n int, flag boolean, items array<string>"
#: Rows of facts that a task hands back at once.
BATCH = 20_000

# Names of the script host.
SERVICES = "SpreadsheetApp DocumentApp FormApp SlidesApp CalendarApp GmailApp MailApp DriveApp ContactsApp ContentService HtmlService XmlService UrlFetchApp Utilities Session ScriptApp PropertiesService ScriptProperties UserProperties CacheService LockService Logger console Browser Charts LinearOptimizationService LanguageApp Maps Jdbc BigQuery".split()
GLOBALS = "parseInt parseFloat isNaN isFinite String Number Boolean Object Array Date Math JSON RegExp Error TypeError RangeError Promise Symbol Map Set WeakMap WeakSet encodeURIComponent decodeURIComponent encodeURI decodeURI".split()
WEB_ENTRIES = ["doGet", "doPost"]
SIMPLE_TRIGGERS = ["onOpen", "onEdit", "onSelectionChange", "onInstall"]

MANIFEST = "dependencies struct<libraries:array<struct<userSymbol:string,libraryId:string,version:string,developmentMode:boolean>>,enabledAdvancedServices:array<struct<userSymbol:string,serviceId:string,version:string>>>, oauthScopes array<string>, urlFetchWhitelist array<string>, timeZone string, runtimeVersion string"


def with_projects(files: DataFrame, root: str) -> DataFrame:
    """Adds project and file (both relative to root) to (path, kind, ...).

    A project is a folder that holds a manifest and is below no other such folder; files elsewhere belong to project ''.
    Each file's folders are joined to the projects by equality.
    """
    at = F.regexp_replace("path", "^[a-z]+:/*", "/")
    base = root.rstrip("/") + "/"
    files = files.withColumn("_r", F.substr(at, F.locate(base, at) + len(base)))
    parts = F.split("_r", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    homes = files.where("kind = 'manifest'").select(F.regexp_replace("_r", "/?[^/]*$", "").alias("_home"), F.lit(1).alias("_m")).distinct()
    found = files.select("path", "_r", F.explode(above).alias("_d")).join(homes, F.col("_d") == F.col("_home")).groupBy("path").agg(F.min_by("_home", F.length("_home")).alias("_project"))
    out = files.join(found.withColumnRenamed("path", "_p"), F.col("path") == F.col("_p"), "left")
    project = F.coalesce("_project", F.lit(""))
    return out.select(project.alias("project"), F.when(project == "", F.col("_r")).otherwise(F.substr("_r", F.length(project) + 2)).alias("file"), *[c for c in files.columns if c != "_r"])


def facts(files: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """All facts of (project, file, kind, content). One pass, no shuffle; a file that is no script gives `problem` rows, and files of one shape are parsed once in a task.

    only: the facts that are wanted; others are not made into rows. An incremental scan needs "file" among them.
    """
    wanted = None if only is None else frozenset(only)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, columns = Shapes(wanted), [[] for _ in _COLUMNS]
        for batch in batches:
            for project, file, kind, content in zip(*(batch.column(c).to_pylist() for c in ("project", "file", "kind", "content"))):
                n = shapes.add(kind, content, columns[2:])
                columns[0] += [project] * n
                columns[1] += [file] * n
                if len(columns[0]) >= BATCH:
                    yield from tables_of(columns)
                    columns = [[] for _ in _COLUMNS]
        yield from tables_of(columns)

    return files.select("project", "file", "kind", "content").where("kind in ('gs', 'html')").mapInArrow(extract, SCHEMA)


_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_COLUMNS = [c.split() for c in SCHEMA.split(", ")]


def tables_of(columns: list[list]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(values[at : at + BATCH], _TYPES[kind]) for values, (_, kind) in zip(columns, _COLUMNS)], [name for name, _ in _COLUMNS])


def written(store: DataFrame) -> DataFrame:
    """The store as a table in the shared folder, partitioned by fact: sources are parsed once, and a view reads its own files only.

    Rows are clustered by fact on their way: Spark splits a frequent fact and puts rare ones together at run time, so files are
    of its advisory size and not one for each fact and task.
    """
    return stored(store.hint("rebalance", F.col("fact")), "fact")


def view(store: DataFrame, fact: str) -> DataFrame:
    """Rows of one fact with the columns' own names."""
    return store.where(F.col("fact") == fact).select("project", "file", "owner", "line", "col", *[F.col(k).alias(v) for k, v in VIEWS[fact].items()])


def functions(store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions by (project, owner), the first by file and line; and the later ones, which collide with them."""
    return first_wins(view(store, "function"), ["project", "owner"], ["file", "line", "col"])


def manifests(files: DataFrame) -> DataFrame:
    """(project, libraries, services, scopes, whitelist, present); what can't be read is empty and not present."""
    m = F.from_json("content", MANIFEST)
    empty = lambda c, of: F.coalesce(c, F.array().cast(of))
    libraries = "array<struct<userSymbol:string,libraryId:string,version:string,developmentMode:boolean>>"
    services = "array<struct<userSymbol:string,serviceId:string,version:string>>"
    named = lambda c: F.filter(c, lambda x: F.coalesce(x["userSymbol"], F.lit("")) != "")
    return (
        files.where("kind = 'manifest'").withColumn("_m", m)
        .select("project", named(empty(F.col("_m.dependencies.libraries"), libraries)).alias("libraries"), named(empty(F.col("_m.dependencies.enabledAdvancedServices"), services)).alias("services"),
                empty(F.col("_m.oauthScopes"), "array<string>").alias("scopes"), empty(F.col("_m.urlFetchWhitelist"), "array<string>").alias("whitelist"), F.coalesce(F.try_parse_json("content").cast("string").startswith("{"), F.lit(False)).alias("present"))
    )


def root_name(receiver: Column) -> Column:
    """The capitalised name that a receiver starts with, else null."""
    name = F.regexp_extract(receiver, r"^[A-Za-z_$][A-Za-z0-9_$]*", 0)
    return F.when(name.rlike("^[A-Z]"), name)


def resolved_calls(store: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each call with `resolution`: function, builtin, unresolved (bare calls); service, library, other (member calls)."""
    f = functions(store)[0].select(F.col("project").alias("_p"), F.col("owner").alias("_f"))
    libraries = manifest.select(F.col("project").alias("_lp"), F.explode("libraries.userSymbol").alias("_ls")).distinct()
    calls = view(store, "call").withColumn("root", root_name("receiver"))
    found = calls.join(f, (F.col("project") == F.col("_p")) & F.col("receiver").isNull() & (F.col("final_name") == F.col("_f")), "left")
    found = found.join(libraries, (F.col("project") == F.col("_lp")) & (F.col("root") == F.col("_ls")), "left")
    bare = F.when(F.col("_f").isNotNull(), "function").when(F.col("final_name").isin(GLOBALS), "builtin").otherwise("unresolved")
    kind = F.when(F.col("receiver").isNull(), bare).when(F.col("root").isin(SERVICES), "service").when(F.col("_ls").isNotNull(), "library").otherwise("other")
    return found.withColumn("resolution", kind).drop("_p", "_f", "_lp", "_ls")


def consumers(store: DataFrame) -> DataFrame:
    """Places that name a function: (project, symbol, kind, file, line, owner, n_args, used_as)."""
    none = F.lit(None).cast("string")
    cut = lambda v, symbol, kind, n, used=none: v.where(F.col(symbol).isNotNull()).select("project", F.col(symbol).alias("symbol"), F.lit(kind).alias("kind"), "file", "line", "owner", n.cast("int").alias("n_args"), used.alias("used_as"))
    out = cut(view(store, "call").where("receiver is null"), "final_name", "internal_caller", F.size("args"), F.col("used_as"))
    out = out.unionByName(cut(view(store, "client_call"), "server", "client_call.invocation", F.size("args")))
    out = out.unionByName(cut(view(store, "scriptlet_call"), "callee", "scriptlet", F.lit(None)))
    return out.unionByName(cut(view(store, "trigger"), "function", "installable_trigger", F.lit(None)))


def unresolved(store: DataFrame) -> DataFrame:
    """Places that name no function of their project (bare calls of built-ins aside), with the same columns as consumers()."""
    known = functions(store)[0].select("project", F.col("owner").alias("symbol"))
    return consumers(store).where(~((F.col("kind") == "internal_caller") & F.col("symbol").isin(GLOBALS))).join(known, ["project", "symbol"], "left_anti")


def called_by(store: DataFrame, most: int = 100) -> DataFrame:
    """(project, symbol, callers, n_callers): the call graph turned round: how many places name a function, and the first `most` of them."""
    known = functions(store)[0].select("project", F.col("owner").alias("symbol"))
    met = consumers(store).join(known, ["project", "symbol"], "left_semi").select("project", "symbol", "kind", "file", "line", "owner")
    return first_by_key(met, ["project", "symbol"], ["kind", "file", "line", "owner"], most, "callers", "n_callers")


def exposures(store: DataFrame) -> DataFrame:
    """How the outside reaches functions: (project, symbol, type, n_sites)."""
    f = functions(store)[0].select("project", F.col("owner").alias("symbol"), "visibility")
    named = f.select("project", "symbol", F.when(F.col("symbol").isin(WEB_ENTRIES), "entry_point_web").when(F.col("symbol").isin(SIMPLE_TRIGGERS), "simple_trigger").alias("type")).where("type is not null").withColumn("n_sites", F.lit(1).cast("long"))
    kinds = F.when(F.col("kind") == "client_call.invocation", "client_call").otherwise(F.col("kind"))
    used = consumers(store).where("kind <> 'internal_caller'").groupBy("project", "symbol", kinds.alias("type")).agg(F.count("*").alias("n_sites"))
    return named.unionByName(used.join(f.select("project", "symbol"), ["project", "symbol"], "left_semi").select("project", "symbol", "type", "n_sites"))


def field_reads(store: DataFrame) -> DataFrame:
    """Fields that success handlers read of a function's value: (project, symbol, field, file, line).

    Of handlers of one name in a page the first is the one that counts: reads
    from the second definition on are of handlers that no call means.
    """
    named = view(store, "handler").select("project", "file", F.col("owner").alias("success"), F.struct("line", "col").alias("_d"))
    second = named.groupBy("project", "file", "success").agg(F.min("_d").alias("_first"), F.collect_set("_d").alias("_all")).select("project", "file", "success", F.array_min(F.filter("_all", lambda d: d != F.col("_first"))).alias("_second"))
    h = view(store, "handler_read").select("project", "file", F.col("owner").alias("success"), "field", F.col("line").alias("_l"), F.struct("line", "col").alias("_at"))
    h = h.join(second, ["project", "file", "success"], "left").where("_second is null or _at < _second").drop("_at", "_second")
    c = view(store, "client_call").where("success is not null").select("project", "file", F.col("server").alias("symbol"), "success").distinct()
    return c.join(h, ["project", "file", "success"]).select("project", "symbol", "field", "file", F.col("_l").alias("line")).distinct()


def template_gaps(store: DataFrame) -> DataFrame:
    """(project, template, set_fields, read_fields, unread, unset): a template's fields set by scripts against those its page reads."""
    s = view(store, "template").groupBy("project", "template").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("set_fields"))
    r = view(store, "scriptlet_read").groupBy("project", F.regexp_replace("file", r"\.html?$", "").alias("template")).agg(F.array_sort(F.collect_set("field")).alias("_r"))
    read = F.coalesce("_r", F.array().cast("array<string>"))
    return s.join(r, ["project", "template"], "left").select("project", "template", "set_fields", read.alias("read_fields"), F.array_except("set_fields", read).alias("unread"), F.array_except(read, "set_fields").alias("unset"))


def coverage_by_function(store: DataFrame) -> DataFrame:
    """(project, owner, uncertain, coverage_pct): 100 less 5 for each uncertain place, 40 at the most."""
    from quillspan.operators.relations import coverage

    n = view(store, "uncertain").groupBy("project", "owner").agg(F.count("*").alias("_n"))
    return functions(store)[0].select("project", "owner").join(n, ["project", "owner"], "left").select("project", "owner", F.coalesce("_n", F.lit(0)).alias("uncertain"), coverage(F.coalesce("_n", F.lit(0))).alias("coverage_pct"))
