"""Queries over small projects: what the parser, the store and each rule give, against rows that were read through by hand.

They take no table of the driver: its tables hold no scripts. Every query runs
the operators of the store and of the rules as they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import fixtures as fx
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import codegen
from quillspan.functions import findings as fd
from quillspan.operators import facts as fs
from quillspan.operators import incremental, libraries, production, reports, secrets
from quillspan.operators import workspace as ws
from quillspan.plans import crosschecks, rules
from quillspan.plans import inspect as ins
from quillspan.streaming import hooks

FIXTURE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FIXTURE_SQL: dict[str, str] = {}


def query(columns: str, *expected: tuple):
    """Registers a query and its rows; columns are `name type, ...` as SQL has them."""
    names, types = [c.split()[0] for c in columns.split(", ")], [c.split()[1] for c in columns.split(", ")]

    def literal(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types))
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in expected)

    def add(f):
        FIXTURE_QUERIES[f.__name__] = f
        FIXTURE_SQL[f.__name__] = f"SELECT {cast} FROM (VALUES {values}) t({', '.join(names)})"
        return f

    return add


def joined(c: str):
    return F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)


def shop(spark: SparkSession, *more: list[tuple]) -> tuple[DataFrame, DataFrame]:
    f = fx.files(spark, fx.rows("shop", fx.SHOP, fx.SHOP_PAGE, fx.MANIFEST), *more)
    return fs.facts(f), fs.manifests(f)


@query(
    "symbol VARCHAR, line INTEGER, end_line INTEGER, visibility VARCHAR, kind VARCHAR, params VARCHAR",
    ("clean_", 25, 25, "private", "declaration", ""),
    ("doGet", 20, 24, "public", "declaration", ""),
    ("getOrder", 7, 12, "public", "declaration", "id,rate"),
    ("half", 14, 14, "public", "arrow", "n"),
    ("onEdit", 26, 26, "public", "declaration", "e"),
    ("split", 13, 13, "public", "declaration", "x"),
    ("weekly", 15, 19, "public", "declaration", ""),
)
def fx_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions at the top of a script: declarations and functions kept in constants; a trailing underscore makes them private."""
    return fs.view(shop(spark)[0], "function").select(F.col("owner").alias("symbol"), "line", "end_line", "visibility", "kind", joined("params"))


@query(
    "symbol VARCHAR, summary VARCHAR, returns_fields VARCHAR, returns_text VARCHAR, params VARCHAR, refs VARCHAR",
    ("add", "Adds. @see missing", None, "has `sum` and `Type` and `lost`", "q:number", "gone"),
    ("getOrder", "Totals of one order.", "total,tax", "gives `total` and `tax`", "id:string,rate:number", ""),
    ("linked", "Links {@link add} and {@link JSON}.", None, None, "", "add,JSON"),
)
def fx_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documentation comments: summary, documented parameters, returned fields, references."""
    store = fs.facts(fx.files(spark, fx.rows("shop", fx.SHOP + fx.DOCS)))
    params = fs.view(store, "doc_param").groupBy("owner").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "param", "type"))), ",").alias("params"))
    return fs.view(store, "doc").join(params, "owner", "left").select(F.col("owner").alias("symbol"), "summary", "returns_fields", "returns_text", F.coalesce("params", F.lit("")).alias("params"), joined("refs"))


@query(
    "symbol VARCHAR, serializable VARCHAR, nullable BOOLEAN, sure VARCHAR, is_open VARCHAR, fields VARCHAR",
    ("arrow", "unknown", False, "true", "false", "p,q"),
    ("date", "true", False, "false", "false", ""),
    ("either", "true", True, "true", "false", "x"),
    ("list", "true", True, "false", "false", ""),
    ("nested", "false", False, "false", "false", "f"),
    ("none", "unknown", False, "false", "false", ""),
    ("nothing", "unknown", True, "false", "false", ""),
    ("open", "true", False, "false", "false", "a"),
    ("order", "false", False, "false", "false", ""),
)
def fx_returns(spark: SparkSession, d: str) -> DataFrame:
    """What functions return: whether it can be sent to a page, may be null, has a sure shape."""
    store = fs.facts(fx.files(spark, fx.rows("r", fx.RETURNS)))
    return fs.view(store, "returns").select(F.col("owner").alias("symbol"), "serializable", "nullable", F.col("confident_shape").alias("sure"), F.col("open_object").alias("is_open"), joined("fields"))


@query(
    "line INTEGER, callee VARCHAR, resolution VARCHAR, used_as VARCHAR, n_args INTEGER",
    (1, "Core.load", "library", None, 2),
    (10, "split", "function", "assigned:[a, b]", 1),
    (14, "split", "function", None, 1),
    (16, "getOrder", "function", "assigned:o", 2),
    (21, "HtmlService.createTemplateFromFile", "service", "assigned:t", 1),
    (23, "t.evaluate", "other", "returned", 0),
    (25, "lost", "unresolved", None, 1),
    (25, "parseInt", "builtin", None, 1),
    (26, "weekly", "function", "returned", 0),
)
def fx_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls and what they are resolved to: functions, built-ins, services, libraries, nothing."""
    store, manifest = shop(spark)
    more = fs.facts(fx.files(spark, fx.rows("shop", "function core() { Core.load(1, 2); }")))
    calls = fs.resolved_calls(store.unionByName(more), manifest).where("receiver is null or owner in ('core', 'doGet')")
    return calls.select("line", "callee", "resolution", "used_as", F.size("args").alias("n_args"))


@query(
    "fact VARCHAR, owner VARCHAR, line INTEGER, a VARCHAR, b VARCHAR, c VARCHAR, n INTEGER, flag BOOLEAN, items VARCHAR",
    ("array2d", "first", 3, "data", None, None, 7, None, "0,7"),
    ("current_doc_only", None, 1, None, None, None, None, None, ""),
    ("delete_trigger", "second", 17, None, None, None, None, None, ""),
    ("destructuring", "first", 5, "pair", None, None, 3, None, ""),
    ("lock", "first", 7, "waitLock", None, None, None, False, ""),
    ("lock", "second", 13, "tryLock", None, None, None, True, ""),
    ("loop_call", "second", 14, "setValue", "cell", "for_in", None, None, ""),
    ("loop_call", "second", 15, "fetch", "fetch", "while", None, None, ""),
    ("loop_call", "second", 16, "fetch", "fetch", "array.map", None, None, ""),
    ("resource_open", None, 21, "openById", "abcdefghijklmnopqrstuvwx", None, None, None, ""),
    ("uncertain", "first", 8, "eval", None, None, None, None, ""),
    ("uncertain", "first", 9, "dynamic_dispatch", None, None, None, None, ""),
    ("uncertain", "make", 20, "function_constructor", None, None, None, None, ""),
    ("webapp_html", "third", 19, "ALLOWALL", None, None, None, True, ""),
)
def fx_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns in bodies: columns read, destructuring, locks, loops, triggers, what can't be told, frames, ids."""
    kinds = ["array2d", "destructuring", "lock", "loop_call", "delete_trigger", "uncertain", "webapp_html", "current_doc_only", "resource_open"]
    store = fs.facts(fx.files(spark, fx.rows("p", fx.PATTERNS)))
    return store.where(F.col("fact").isin(kinds)).select("fact", "owner", "line", "a", "b", "c", "n", "flag", joined("items"))


@query(
    "root VARCHAR, steps VARCHAR, truncated BOOLEAN",
    ("SpreadsheetApp", "getActive/0,getSheetByName/0", False),
    ("SpreadsheetApp", "getActive/0,getSheetByName/1,getRange/1,setValue/1", False),
    ("SpreadsheetApp", "getActive/0,getSheetByName/1,getRnge/1", False),
    ("Unknown", "call/0,more/0", False),
    ("UserProperties", "getProperty/1,trim/0", False),
)
def fx_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains of member calls with their numbers of arguments, the longest of each expression."""
    return fs.view(fs.facts(fx.files(spark, fx.rows("c", fx.CHAINS))), "chain").select("root", joined("steps"), "truncated")


@query(
    "fact VARCHAR, owner VARCHAR, line INTEGER, a VARCHAR, b VARCHAR, c VARCHAR, flag BOOLEAN, items VARCHAR",
    ('client_call', None, 5, 'load', '@5:37', 'oops', None, "1,'b'"),
    ("client_call", None, 6, "save", None, None, None, "values"),
    ("handler", "@5:37", 5, "r", None, None, None, ""),
    ("handler_read", "@5:37", 5, "name", None, None, None, ""),
    ("handler_read", "@5:37", 5, "size", None, None, None, ""),
    ("html_fetch", None, 4, "http://c.example/data", None, None, None, ""),
    ("html_form", None, 2, None, None, None, False, ""),
    ("html_form", None, 2, None, None, None, True, ""),
    ("html_link", None, 1, "/in", None, None, None, ""),
    ("html_resource", None, 1, "img", "http://a.example/x.png", None, None, ""),
    ("scriptlet_call", None, 8, "rows", None, None, None, ""),
    ("scriptlet_read", None, 8, "label", None, None, None, ""),
)
def fx_pages(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a page: resources, links, forms, fetches, calls of the server with handlers, scriptlets."""
    store = fs.facts(fx.files(spark, fx.rows("p", None, fx.PAGE)))
    return store.where("fact not in ('file', 'chunk')").select("fact", "owner", "line", "a", "b", "c", "flag", joined("items"))


@query(
    "symbol VARCHAR, n_callers BIGINT, callers VARCHAR",
    ("getOrder", 2, "client_call.invocation page.html -, internal_caller main.gs weekly"),
    ("half", 1, "scriptlet page.html -"),
    ("split", 2, "internal_caller main.gs getOrder, internal_caller main.gs half"),
    ("weekly", 3, "client_call.invocation page.html -, installable_trigger main.gs -, internal_caller main.gs onEdit"),
)
def fx_called_by(spark: SparkSession, d: str) -> DataFrame:
    """The call graph turned round: scripts, pages, scriptlets, triggers (one stands outside of all functions)."""
    said = F.array_join(F.transform("callers", lambda x: F.concat_ws(" ", x["kind"], x["file"], F.coalesce(x["owner"], F.lit("-")))), ", ")
    return fs.called_by(shop(spark)[0]).select("symbol", "n_callers", said.alias("callers"))


@query(
    "symbol VARCHAR, type VARCHAR, n_sites BIGINT",
    ("doGet", "entry_point_web", 1),
    ("getOrder", "client_call", 1),
    ("half", "scriptlet", 1),
    ("onEdit", "simple_trigger", 1),
    ("weekly", "client_call", 1),
    ("weekly", "installable_trigger", 1),
)
def fx_exposures(spark: SparkSession, d: str) -> DataFrame:
    """How the outside reaches functions."""
    return fs.exposures(shop(spark)[0]).select("symbol", "type", "n_sites")


@query(
    "kind VARCHAR, symbol VARCHAR, line INTEGER",
    ("client_call.invocation", "lost", 1),
    ("installable_trigger", "gone", 3),
    ("internal_caller", "b", 1),
    ("scriptlet", "nil", 1),
)
def fx_unresolved(spark: SparkSession, d: str) -> DataFrame:
    """Places that name no function of their project."""
    code = "function a() { b(); c(); parseInt(1); }\nfunction c() {}\nScriptApp.newTrigger('gone').create();"
    store = fs.facts(fx.files(spark, fx.rows("u", code, "<script>google.script.run.lost(); google.script.run.c();</script><?= nil() ?>")))
    return fs.unresolved(store).select("kind", "symbol", "line")


@query(
    "symbol VARCHAR, field VARCHAR, line INTEGER",
    ("getOrder", "tax", 3),
    ("getOrder", "total", 3),
    ("weekly", "length", 5),
)
def fx_contract(spark: SparkSession, d: str) -> DataFrame:
    """Fields that success handlers read of a function's value; named handlers and handlers in place."""
    return fs.field_reads(shop(spark)[0]).select("symbol", "field", "line")


@query(
    "template VARCHAR, set_fields VARCHAR, read_fields VARCHAR, unread VARCHAR, unset VARCHAR",
    ("page", "title,user", "extra,title,user", "", "extra"),
)
def fx_templates(spark: SparkSession, d: str) -> DataFrame:
    """Fields that scripts set for a template against those that its page reads."""
    return fs.template_gaps(shop(spark)[0]).select("template", *map(joined, ("set_fields", "read_fields", "unread", "unset")))


@query(
    "store VARCHAR, key VARCHAR, reads BIGINT, writes BIGINT, deletes BIGINT, status VARCHAR",
    ("cache_user", "TMP", 0, 0, 1, "ok"),
    ("script", "LAST", 1, 1, 0, "ok"),
    ("user", "R", 1, 0, 0, "read_only"),
    ("user", "W", 0, 1, 0, "write_only"),
)
def fx_property_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of property and cache stores; a key that is only deleted is ok."""
    code = "function f() { const p = 1; PropertiesService.getUserProperties().setProperty('W', 1); PropertiesService.getUserProperties().getProperty('R'); PropertiesService.getUserProperties().getProperty(p); }"
    return rules.property_keys(shop(spark, fx.rows("more", code))[0]).select("store", "key", "reads", "writes", "deletes", "status")


@query(
    "symbol VARCHAR, uncertain BIGINT, coverage_pct BIGINT",
    ("first", 2, 90),
    ("make", 1, 95),
    ("second", 0, 100),
    ("third", 0, 100),
)
def fx_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Five points off for each place that can't be told."""
    return fs.coverage_by_function(fs.facts(fx.files(spark, fx.rows("p", fx.PATTERNS)))).select(F.col("owner").alias("symbol"), "uncertain", "coverage_pct")


def _edits(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    before = fx.files(spark, *[fx.rows(n, fx.SHOP, fx.SHOP_PAGE, fx.MANIFEST) for n in fx.EDITS])
    after = fx.files(spark, *[fx.edited(n) for n in fx.EDITS])
    return fs.written(fs.facts(before)), fs.written(fs.facts(after))


@query(
    "edit VARCHAR, change VARCHAR, symbol VARCHAR, detail VARCHAR",
    ("class instance", "serializable.broke", "getOrder", None),
    ("come", "function_added", "fresh", None),
    ("gone", "function_removed", "onEdit", None),
    ("lost field", "return.field_removed", "getOrder", "tax"),
    ("lost parameter", "param.removed", "getOrder", "rate"),
    ("lost template field", "template.binding_field_removed", "page", "title"),
    ("more fields", "return.field_added", "getOrder", "net"),
    ("more parameters", "param.added", "split", "y"),
    ("more template fields", "template.binding_field_added", "page", "sub"),
    ("narrower", "array.column_indices_changed", "getOrder", "rows"),
    ("null", "return.nullability_changed", "getOrder", None),
    ("other order", "param.reordered", "getOrder", "rate,id"),
    ("rename", "function_renamed", "split", "cut"),
    ("unread key", "property_key.write_only", "LAST", "script"),
    ("unwritten key", "property_key.read_only", "LAST", "script"),
    ("wider", "array.column_indices_changed", "getOrder", "rows"),
    ("wider", "array.max_index_grew", "getOrder", "rows"),
)
def fx_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of change between two snapshots, harmful or not; each edit is a project."""
    return rules.changes(*_edits(spark)).select(F.col("project").alias("edit"), "change", "symbol", "detail")


@query(
    "edit VARCHAR, kind VARCHAR, severity VARCHAR, symbol VARCHAR, file VARCHAR, line INTEGER",
    ("class instance", "client_call.invocation", "break", "getOrder", "page.html", 4),
    ("class instance", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("come", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("gone", "internal_caller", "warn", "onEdit", "main.gs", 26),
    ("gone", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("lost field", "client_call.success_handler", "break", "getOrder", "page.html", 3),
    ("lost field", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("lost parameter", "client_call.invocation", "break", "getOrder", "page.html", 4),
    ("lost parameter", "internal_caller", "break", "getOrder", "main.gs", 16),
    ("lost parameter", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("lost template field", "template_scriptlet_reader", "break", "page", "page.html", 1),
    ("lost template field", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("lost template field", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("more fields", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("more parameters", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("more template fields", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("narrower", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("null", "client_call.success_handler", "warn", "getOrder", "page.html", 3),
    ("null", "client_call.success_handler", "warn", "getOrder", "page.html", 3),
    ("null", "internal_caller", "warn", "getOrder", "main.gs", 16),
    ("null", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("other order", "internal_caller", "break", "getOrder", "main.gs", 16),
    ("other order", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("rename", "internal_caller", "break", "split", "main.gs", 10),
    ("rename", "internal_caller", "break", "split", "main.gs", 14),
    ("rename", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("same", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("unread key", "property_key_writer", "warn", "LAST", "main.gs", 17),
    ("unread key", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("unwritten key", "property_key_reader", "warn", "LAST", "main.gs", 18),
    ("unwritten key", "template_scriptlet_reader", "warn", "page", "page.html", 1),
    ("wider", "array2d_consumer", "break", "getOrder", "main.gs", 8),
    ("wider", "template_scriptlet_reader", "warn", "page", "page.html", 1),
)
def fx_diff(spark: SparkSession, d: str) -> DataFrame:
    """What each change breaks."""
    return rules.diff(*_edits(spark)).select(F.col("project").alias("edit"), "kind", "severity", "symbol", "file", "line")


@query(
    "change VARCHAR, kind VARCHAR, severity VARCHAR, symbol VARCHAR, project VARCHAR, line INTEGER",
    ("doGet rename:x", "entry_point_web", "break", "doGet", "shop", 20),
    ("getOrder change-return-shape:-tax,+net", "client_call.success_handler", "break", "getOrder", "shop", 3),
    ("getOrder remove-param:none", "internal_caller", "warn", "getOrder", "shop", 7),
    ("getOrder remove-param:rate", "client_call.invocation", "break", "getOrder", "shop", 4),
    ("getOrder remove-param:rate", "internal_caller", "break", "getOrder", "shop", 16),
    ("getOrder rename-param:id=key", "internal_caller", "warn", "getOrder", "shop", 7),
    ("half rename:x", "scriptlet", "break", "half", "shop", 1),
    ("load remove-param:id", "cross_project_caller", "break", "load", "app/dev", 1),
    ("load rename:read", "cross_project_caller", "break", "load", "app/dev", 1),
    ("onEdit rename:x", "simple_trigger", "break", "onEdit", "shop", 26),
    ("weekly rename:daily", "client_call.invocation", "break", "weekly", "shop", 5),
    ("weekly rename:daily", "installable_trigger", "break", "weekly", "shop", 27),
    ("weekly rename:daily", "internal_caller", "break", "weekly", "shop", 26),
)
def fx_impact(spark: SparkSession, d: str) -> DataFrame:
    """What-if changes of one function, with callers in other projects."""
    shop_, manifest = shop(spark, fx.rows("Core", fx.LIBRARY), fx.rows("app/dev", fx.CONSUMER, None, fx.MANIFEST))
    asked = [("shop", "getOrder", "remove-param:rate"), ("shop", "getOrder", "remove-param:none"), ("shop", "getOrder", "change-return-shape:-tax,+net"), ("shop", "weekly", "rename:daily"), ("shop", "doGet", "rename:x"), ("shop", "onEdit", "rename:x"), ("shop", "getOrder", "rename-param:id=key"), ("shop", "half", "rename:x"), ("Core", "load", "rename:read"), ("Core", "load", "remove-param:id")]
    found = [rules.impact(shop_, p, f, c, manifest).withColumn("change", F.lit(f"{f} {c}")) for p, f, c in asked]
    return rules.both(*found).select("change", "kind", "severity", "symbol", "project", "line")


@query(
    "field VARCHAR, reason VARCHAR",
    ("net", "a field more breaks nobody"),
    ("rate", "nobody reads it"),
)
def fx_impact_safe(spark: SparkSession, d: str) -> DataFrame:
    """What a change of shape leaves safe."""
    return rules.impact_safe(shop(spark)[0], "shop", "getOrder", "change-return-shape:-tax,-rate,+net").select("field", "reason")


def _ruled(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    f = fx.files(spark, fx.rows("r", fx.RULES, fx.RULES_PAGE, fx.RULES_MANIFEST))
    return fs.facts(f), fs.manifests(f)


@query(
    "kind VARCHAR, severity VARCHAR, symbol VARCHAR, file VARCHAR, line INTEGER",
    ("manifest.advanced_service", "break", "Sheets", "main.gs", 1),
    ("manifest.advanced_service", "info", "Drive", "appsscript.json", 1),
    ("manifest.library", "break", "Foo", "main.gs", 1),
    ("manifest.library", "info", "Core", "appsscript.json", 1),
    ("manifest.scope", "info", "https://www.googleapis.com/auth/documents", "appsscript.json", 1),
    ("manifest.scope", "info", "https://www.googleapis.com/auth/spreadsheets", "appsscript.json", 1),
    ("manifest.scope", "warn", "UrlFetchApp", "main.gs", 1),
    ("manifest.urlfetch_whitelist", "warn", "http://other/", "main.gs", 1),
)
def fx_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Libraries, services, scopes and addresses against the manifest."""
    return rules.manifest_rules(*_ruled(spark)).select("kind", "severity", "symbol", "file", "line")


@query(
    "project VARCHAR, present BOOLEAN, libraries VARCHAR, services VARCHAR, scopes BIGINT, whitelist BIGINT",
    ("bad", False, "", "", 0, 0),
    ("empty", True, "", "", 0, 0),
    ("good", True, "Core", "Drive", 4, 1),
    ("none", False, "", "", 0, 0),
    ("odd", True, "B", "", 1, 0),
)
def fx_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests as they are read: broken ones are empty and not present, nameless libraries are dropped."""
    odd = {"dependencies": {"libraries": [{"userSymbol": ""}, {"userSymbol": "B", "version": "3"}], "enabledAdvancedServices": "no"}, "oauthScopes": ["s"]}
    f = fx.files(spark, fx.rows("good", None, None, fx.RULES_MANIFEST), fx.rows("bad", None, None, "{oops"), fx.rows("none", None, None, "[1]"), fx.rows("empty", None, None, "{}"), fx.rows("odd", None, None, odd))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["userSymbol"]), ",").alias(c)
    return fs.manifests(f).select("project", "present", names("libraries"), names("services"), F.size("scopes").cast("long").alias("scopes"), F.size("whitelist").cast("long").alias("whitelist"))


@query(
    "severity VARCHAR, symbol VARCHAR, reason VARCHAR",
    ("info", "https://mail.google.com/", "sending mail alone would do"),
    ('info', 'https://www.googleapis.com/auth/spreadsheets', "the current document's scope would do"),
)
def fx_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Scopes that are broader than needed: the whole of what the current document would do for, all of mail to send some."""
    code = "/** @OnlyCurrentDoc */\nfunction a() { SpreadsheetApp.getActive(); MailApp.sendEmail('x'); }"
    f = fx.files(spark, fx.rows("s", code, None, {"oauthScopes": [fx.AUTH + "spreadsheets", "https://mail.google.com/"]}))
    return rules.manifest_rules(fs.facts(f), fs.manifests(f)).select("severity", "symbol", "reason")


@query(
    "kind VARCHAR, severity VARCHAR, symbol VARCHAR, line INTEGER, reason VARCHAR",
    ("api.deprecated", "warn", "UserProperties.getProperty", 4, "deprecated in UserProperties"),
    ("api.unknown_method", "break", "Sheet.getRnge", 2, "Sheet has no such method; near: getRange, getRangeList"),
    ("api.wrong_arity", "break", "Spreadsheet.getSheetByName", 3, "too few arguments"),
)
def fx_api(spark: SparkSession, d: str) -> DataFrame:
    """Chains of calls against a registry of types."""
    registry = [("SpreadsheetApp", "getActive", "Spreadsheet", 0, None), ("Spreadsheet", "getSheetByName", "Sheet", 1, None), ("Sheet", "getRange", "Range", 1, None), ("Sheet", "getRangeList", "RangeList", 1, None), ("Range", "setValue", "Range", 1, None), ("UserProperties", "getProperty", "string", 1, None), ("UserProperties", "*", None, 0, "PropertiesService")]
    return rules.api_rules(fs.facts(fx.files(spark, fx.rows("c", fx.CHAINS))), registry).select("kind", "severity", "symbol", "line", "reason")


@query(
    "kind VARCHAR, severity VARCHAR, symbol VARCHAR, file VARCHAR, line INTEGER",
    ("lint.library_chatty_ui", "info", "<project>", "page.html", 1),
    ("lint.lock_no_finally", "warn", "h", "main.gs", 3),
    ("lint.quota_in_loop", "warn", "g", "main.gs", 2),
    ("lint.trigger_orphan", "info", "h", "main.gs", 3),
    ("lint.urlfetch_in_loop", "warn", "g", "main.gs", 2),
)
def fx_runtime(spark: SparkSession, d: str) -> DataFrame:
    """Quotas in loops, locks, triggers, chatty pages."""
    return rules.runtime_rules(*_ruled(spark)).select("kind", "severity", "symbol", "file", "line")


@query(
    "embedded BOOLEAN, kind VARCHAR, severity VARCHAR, symbol VARCHAR, line INTEGER",
    (False, "webapp.form_submit", "warn", "form", 1),
    (False, "webapp.link_target", "warn", "x", 1),
    (False, "webapp.mixed_content", "warn", "http://w/", 1),
    (False, "webapp.mixed_content", "warn", "http://z/q", 1),
    (False, "webapp.xframe_missing", "info", "doGet", 5),
    (True, "webapp.form_submit", "warn", "form", 1),
    (True, "webapp.link_target", "warn", "x", 1),
    (True, "webapp.mixed_content", "warn", "http://w/", 1),
    (True, "webapp.mixed_content", "warn", "http://z/q", 1),
    (True, "webapp.xframe_missing", "warn", "doGet", 5),
)
def fx_webapp(spark: SparkSession, d: str) -> DataFrame:
    """Pages; a frame that is refused is worse where the app is embedded in a site."""
    store = fs.written(_ruled(spark)[0])
    return rules.both(*[rules.webapp_rules(store, e).withColumn("embedded", F.lit(e)) for e in (False, True)]).select("embedded", "kind", "severity", "symbol", "line")


@query(
    "kind VARCHAR, severity VARCHAR, symbol VARCHAR, line INTEGER, reason VARCHAR",
    ("doc.param_drift", "warn", "add", 5, "documents no such parameter: q"),
    ("doc.return_drift", "warn", "add", 5, "documents a field that is not returned: lost"),
    ("doc.stale_ref", "info", "add", 5, "refers to nothing known: gone"),
    ("doc.undocumented", "info", "bare", 6, "no summary"),
)
def fx_doc(spark: SparkSession, d: str) -> DataFrame:
    """Documentation against the code."""
    return rules.doc_rules(fs.facts(fx.files(spark, fx.rows("d", fx.DOCS)))).select("kind", "severity", "symbol", "line", "reason")


@query(
    "project VARCHAR, kind VARCHAR, severity VARCHAR, symbol VARCHAR, reason VARCHAR",
    ("", "env.undeclared_resource", "warn", "env::prod", "not declared: log"),
    ("a/dev", "env.library_version_mismatch", "warn", "a::env::dev", "development should follow the head"),
    ("a/prod", "env.cross_env_leak", "break", "a::env::prod", "id of dev in prod: DDDDDDDDDDDDDDDDDDDDDDDD"),
    ("a/prod", "env.hardcoded_resource", "warn", "a::env::prod", "declared id written out: PPPPPPPPPPPPPPPPPPPPPPPP"),
    ("a/prod", "env.hardcoded_resource", "warn", "a::env::prod", "undeclared id written out: ZZZZZZZZZZZZZZZZZZZZZZZZ"),
    ("a/prod", "env.library_version_mismatch", "break", "a::env::prod", "production must use version 11"),
    ("b/prod", "env.library_version_mismatch", "break", "b::env::prod", "production must use version 11"),
    ("c/prod", "env.library_version_mismatch", "break", "c::env::prod", "production must use version 11"),
)
def fx_env(spark: SparkSession, d: str) -> DataFrame:
    """Projects of environments against a workspace: pinned versions, ids of other environments, ids written out, resources not declared."""
    prod, dev, other = "P" * 24, "D" * 24, "Z" * 24
    head = {"dependencies": {"libraries": [{"userSymbol": "Core", "libraryId": "L1", "version": "0", "developmentMode": True}]}}
    by_id = {"dependencies": {"libraries": [{"userSymbol": "Kern", "libraryId": "L1", "version": "10"}]}}
    code = f"const A = '{dev}', B = '{prod}';\nfunction f() {{ DriveApp.getFileById('{other}'); }}"
    f = fx.files(spark, fx.rows("a/prod", code, None, fx.MANIFEST), fx.rows("b/prod", "1", None, head), fx.rows("c/prod", "1", None, by_id), fx.rows("a/dev", "1", None, fx.MANIFEST), fx.rows("b/dev", "1", None, head))
    targets = spark.createDataFrame([(p, p[0], p[2:]) for p in ("a/prod", "b/prod", "c/prod", "a/dev", "b/dev")], "project string, app string, env string")
    library = spark.createDataFrame([("Core", "L1", 11)], "user_symbol string, script_id string, prod_version int")
    resources = spark.createDataFrame([("prod", "sheet", prod), ("dev", "sheet", dev), ("dev", "log", dev)], "env string, name string, id string")
    return rules.environment_rules(fs.facts(f), fs.manifests(f), targets, library, resources, f).select("project", "kind", "severity", "symbol", "reason")


@query(
    "project VARCHAR, caller VARCHAR, provider VARCHAR, symbol VARCHAR",
    ("app/prod", "run", "Core", "load"),
    ("app/prod", "run", "util/prod", "load"),
    ("app/test", "run", "Core", "load"),
    ("app/test", "run", "util/dev", "load"),
)
def fx_cross_project(spark: SparkSession, d: str) -> DataFrame:
    """Calls of libraries and the projects that provide them: by name, by the caller's environment, by any."""
    more = {"dependencies": {"libraries": [{"userSymbol": "Util", "libraryId": "U"}, {"userSymbol": "Core", "libraryId": "L1"}]}}
    use = "function run() { Util.load(1); Core.load(2); Core.hidden_(); Core.gone(); Other.load(); }"
    f = fx.files(spark, fx.rows("Core", fx.LIBRARY), fx.rows("util/dev", fx.LIBRARY), fx.rows("util/prod", fx.LIBRARY), fx.rows("app/prod", use, None, more), fx.rows("app/test", use, None, more))
    providers = spark.createDataFrame([("Util", "dev", "util/dev"), ("Util", "prod", "util/prod")], "prefix string, env string, provider string")
    return crosschecks.library_edges(fs.facts(f), fs.manifests(f), providers).select("project", "caller", "provider", F.col("function").alias("symbol"))


@query(
    "symbol VARCHAR, heat VARCHAR, status VARCHAR",
    ("clean_", "cold", "confirmed_dead"),
    ("doGet", "cold", "cold_exposed"),
    ("getOrder", "warm", "live"),
    ("half", "hot", "errored"),
    ("idle", "warm", "dispatched_dynamic"),
    ("onEdit", "unknown", "unknown"),
    ("split", "cold", "cold_exposed"),
    ("weekly", "hot", "live"),
)
def fx_prod(spark: SparkSession, d: str) -> DataFrame:
    """Functions by their log: heat, and whether what runs is what the code exposes."""
    runs = [("getOrder", 3, 0), ("split", 0, 0), ("half", 60, 30), ("weekly", 60, 1), ("clean_", 0, 0), ("doGet", 0, 0)]
    metrics = spark.createDataFrame([("shop", *r) for r in runs], "project string, symbol string, runs long, errors long")
    return crosschecks.prod_truth(shop(spark, fx.rows("shop2", "function idle() {}"))[0], metrics.unionByName(spark.createDataFrame([("shop2", "idle", 5, 0)], metrics.schema)), 30).select("symbol", "heat", "status")


@query(
    "project VARCHAR, symbol VARCHAR, status VARCHAR",
    ("all", "api", "live_api"),
    ("all", "doGet", "live_web_app"),
    ("all", "onOpen", "live_addon"),
    ("all", "own_", "head_only"),
    ("head", "api", "head_only"),
    ("head", "doGet", "head_only"),
    ("head", "onOpen", "head_only"),
    ("head", "own_", "head_only"),
    ("none", "api", "unknown"),
    ("none", "doGet", "unknown"),
    ("none", "onOpen", "unknown"),
    ("none", "own_", "unknown"),
)
def fx_deploy(spark: SparkSession, d: str) -> DataFrame:
    """Functions by what serves them: web app before add-on before API (public ones), else the head only."""
    code = "function doGet() {}\nfunction onOpen() {}\nfunction api() {}\nfunction own_() {}"
    f = fx.files(spark, *[fx.rows(p, code) for p in ("all", "head", "none")])
    rows = [("all", "WEB_APP", 3), ("all", "ADD_ON", 1), ("all", "EXECUTION_API", 2), ("head", "WEB_APP", None)]
    return crosschecks.deployment_status(fs.facts(f), spark.createDataFrame(rows, "project string, type string, version int")).select("project", "symbol", "status")


@query(
    "project VARCHAR, functions BIGINT, private BIGINT, web_entries BIGINT, simple_triggers BIGINT, installable_triggers BIGINT, client_functions BIGINT, scriptlet_functions BIGINT, client_sites BIGINT, template_gaps BIGINT, libraries BIGINT",
    ("Core", 2, 1, 0, 0, 0, 0, 0, 0, 0, 0),
    ("shop", 7, 1, 1, 1, 1, 2, 1, 2, 1, 1),
)
def fx_map(spark: SparkSession, d: str) -> DataFrame:
    """One row a project."""
    return rules.project_map(*shop(spark, fx.rows("Core", fx.LIBRARY, None, {})))


@query(
    "verdict VARCHAR, breaks BIGINT, warns BIGINT, infos BIGINT",
    ("BREAK", 3, 9, 0),
)
def fx_check(spark: SparkSession, d: str) -> DataFrame:
    """All rules together on two snapshots, folded to a verdict."""
    before = fx.files(spark, fx.rows("r", fx.RULES, fx.RULES_PAGE, fx.RULES_MANIFEST))
    after = fx.files(spark, fx.rows("r", fx.RULES.replace("function g(list)", "function k(list)"), fx.RULES_PAGE, fx.RULES_MANIFEST))
    return fd.verdict(rules.check(fs.written(fs.facts(before)), fs.written(fs.facts(after)), fs.manifests(after))).select("verdict", "breaks", "warns", "infos")


@query(
    "project VARCHAR, file VARCHAR, kind VARCHAR",
    ("", "ab/z.gs", "gs"),
    ("", "z.gs", "gs"),
    ("a", "appsscript.json", "manifest"),
    ("a", "sub/appsscript.json", "manifest"),
    ("a", "sub/y.gs", "gs"),
    ("a", "x.gs", "gs"),
    ("c/d", "appsscript.json", "manifest"),
    ("c/d", "e/p.html", "html"),
)
def fx_projects(spark: SparkSession, d: str) -> DataFrame:
    """Folders with a manifest are projects, the outermost ones; other files belong to none."""
    paths = ["a/appsscript.json", "a/x.gs", "a/sub/appsscript.json", "a/sub/y.gs", "ab/z.gs", "z.gs", "c/d/appsscript.json", "c/d/e/p.html"]
    f = spark.createDataFrame([(f"file:/tmp/root/{p}", {"json": "manifest", "gs": "gs", "html": "html"}[p.split(".")[1]]) for p in paths], "path string, kind string")
    return fs.with_projects(f, "/tmp/root/").select("project", "file", "kind")


@query(
    "file VARCHAR, line BIGINT, pattern VARCHAR",
    (".env", None, "file"),
    ("b.json", 1, "SERVICE_ACCOUNT_PRIVATE_KEY"),
    ("cfg/.env.local", None, "file"),
    ("e.md", 3, "GOOGLE_API_KEY"),
    ("e.md", 3, "OAUTH_ACCESS_TOKEN"),
    ("src/a.gs", 2, "GOOGLE_API_KEY"),
)
def fx_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Lines with secrets (keys are made up here, so that no file holds one) and files known to hold some."""
    key, token = "AI" + "za" + "x" * 35, "ya" + "29." + "abc"
    held = [("src/a.gs", f"let a = 1;\nlet k = '{key}';"), ("b.json", '{"private_key": "-----BEG' + 'IN PRIVATE KEY"}'), ("node_modules/c.js", key), ("d.png", token), ("e.md", f"x\r\n\r\n{token} {key}"), (".env", ""), (".git/.env", ""), ("cfg/.env.local", "")]
    f = spark.createDataFrame(held, "file string, content string")
    return secrets.secret_lines(f).unionByName(secrets.secret_files(f).select("file", F.lit(None).cast("long").alias("line"), F.lit("file").alias("pattern")))


@query(
    "project VARCHAR, file VARCHAR, change VARCHAR",
    ("p", "b.gs", "changed"),
    ("p", "c.html", "removed"),
    ("q", "n.gs", "added"),
)
def fx_changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files added, removed or changed since a scan, by digest."""
    before = [("p", "a.gs", "gs", "function a() {}"), ("p", "b.gs", "gs", "function b() {}"), ("p", "c.html", "html", ""), ("q", "a.gs", "gs", "1")]
    after = [("p", "a.gs", "gs", "function a() {}"), ("p", "b.gs", "gs", "function b() { }"), ("q", "a.gs", "gs", "1"), ("q", "n.gs", "gs", "2"), ("q", "none.gs", "gs", None)]
    return incremental.changed_files(fs.facts(fx.files(spark, before)), fx.files(spark, after))


@query(
    "same BOOLEAN, projects BIGINT",
    (True, 17),
)
def fx_incremental(spark: SparkSession, d: str) -> DataFrame:
    """After each edit, the incremental scan's store against that of a whole scan: no row in one only."""
    before, after = fx.files(spark, *[fx.rows(n, fx.SHOP, fx.SHOP_PAGE, fx.MANIFEST) for n in fx.EDITS]), fx.files(spark, *[fx.edited(n) for n in fx.EDITS])
    store = incremental.scan_incremental(fs.written(fs.facts(before)), after)
    counted = store.withColumn("_w", F.lit(1)).unionByName(fs.facts(after).withColumn("_w", F.lit(-1))).groupBy(*store.columns).agg(F.sum("_w").alias("w"), F.count_if(F.col("_w") > 0).alias("n"))
    return counted.agg((F.max(F.abs("w")) == 0).alias("same"), F.countDistinct("project").alias("projects"))


WORKSPACE = {
    "apps": [
        {"name": "shop", "site_embeds": ["home"], "projects": {"dev": {"clasp_path": "shop/dev", "script_id": "s1"}, "prod": {"clasp_path": "shop/prod", "script_id": "s2"}}},
        {"name": "core", "library_prefix": "Core", "projects": {"prod": {"clasp_path": "Core", "script_id": "L1"}}},
        {"name": "later", "projects": {"dev": {}}},
    ],
    "library": {"user_symbol": "Core", "script_id": "L1", "prod_version": 11},
    "environments": {"dev": {"resources": {"sheet": "D" * 24, "both": "B" * 24, "none": ""}}, "prod": {"resources": {"sheet": "P" * 24, "both": "B" * 24}}},
}


def _workspace(spark: SparkSession, *texts: str) -> DataFrame:
    return ws.workspaces(spark.createDataFrame([(f"w{i}.json", t) for i, t in enumerate(texts or [json.dumps(WORKSPACE)])], "path string, content string"))


@query(
    "path VARCHAR, errors VARCHAR, version INTEGER, apps INTEGER",
    ("w0.json", "", 1, 3),
    ("w1.json", "not a JSON object", None, None),
    ("w2.json", "not a JSON object", None, None),
    ("w3.json", "version: must be above 0,apps.0.name: needed,apps.1.projects.prod.script_id: empty,library.prod_version: must be above 0", None, None),
    ("w4.json", "", 1, None),
)
def fx_workspace_errors(spark: SparkSession, d: str) -> DataFrame:
    """Workspace manifests with what is wrong in them."""
    bad = {"version": 0, "apps": [{"name": ""}, {"name": "a", "projects": {"prod": {"script_id": ""}}}], "library": {"script_id": "x"}}
    found = _workspace(spark, json.dumps(WORKSPACE), "{oops", "[]", json.dumps(bad), "{}")
    return found.select("path", joined("errors"), "version", F.when(F.col("apps").isNotNull(), F.size("apps")).alias("apps"))


@query(
    "app VARCHAR, env VARCHAR, project VARCHAR, script_id VARCHAR, embedded BOOLEAN",
    ("core", "prod", "Core", "L1", False),
    ("later", "dev", None, None, False),
    ("shop", "dev", "shop/dev", "s1", True),
    ("shop", "prod", "shop/prod", "s2", True),
)
def fx_targets(spark: SparkSession, d: str) -> DataFrame:
    """Projects that the apps of a workspace declare."""
    return ws.targets(_workspace(spark)).drop("library_prefix")


@query(
    "id VARCHAR, owners VARCHAR",
    ("BBBBBBBBBBBBBBBBBBBBBBBB", "dev.both,prod.both"),
    ("DDDDDDDDDDDDDDDDDDDDDDDD", "dev.sheet"),
    ("PPPPPPPPPPPPPPPPPPPPPPPP", "prod.sheet"),
)
def fx_owners(spark: SparkSession, d: str) -> DataFrame:
    """Which environments own a resource id."""
    return ws.owners(ws.resources(_workspace(spark))).select("id", F.array_join(F.transform("owners", lambda o: F.concat_ws(".", o["env"], o["name"])), ",").alias("owners"))


def _park(spark: SparkSession):
    head = {"dependencies": {"libraries": [{"userSymbol": "Core", "libraryId": "L1", "developmentMode": True}]}, "oauthScopes": [fx.AUTH + "documents"]}
    core = fx.LIBRARY + "function send() { MailApp.sendEmail('x'); }"
    f = fx.files(spark, fx.rows("shop/dev", fx.SHOP + f"const ID = '{'P' * 24}';", fx.SHOP_PAGE, head), fx.rows("shop/prod", fx.SHOP, None, fx.MANIFEST), fx.rows("Core", core, None, {"oauthScopes": [fx.AUTH + "documents", fx.AUTH + "drive"]}))
    return fs.written(fs.facts(f)), fs.manifests(f), _workspace(spark), f


@query(
    "app VARCHAR, env VARCHAR, present BOOLEAN, lib_version VARCHAR, lib_mode VARCHAR, functions BIGINT, doc_pct BIGINT, verdict VARCHAR",
    ("core", "prod", True, None, "none", 3, 0, "CLEAN"),
    ("later", "dev", False, None, "none", None, None, "CLEAN"),
    ("shop", "dev", True, "HEAD", "HEAD", 7, 17, "BREAK"),
    ("shop", "prod", True, "12", "pinned", 7, 17, "BREAK"),
)
def fx_park(spark: SparkSession, d: str) -> DataFrame:
    """Apps by environment: what is there, which version of the library it uses, how much is documented, what is wrong."""
    store, manifest, w, files = _park(spark)
    t, lib = ws.targets(w), ws.library(w)
    found = rules.environment_rules(store, manifest, t.where("project is not null").select("project", "app", "env"), lib, ws.resources(w), files)
    return ws.overview(t, store, manifest, lib, found)


@query(
    "app VARCHAR, env VARCHAR, severity VARCHAR, symbol VARCHAR",
    ("a", "prod", "break", "a::env::prod"),
    (None, None, "info", "name"),
    (None, None, "warn", "::env::x"),
    (None, None, "warn", "a::b"),
)
def fx_attributed(spark: SparkSession, d: str) -> DataFrame:
    """Findings with the app and environment that their symbols name."""
    f = spark.createDataFrame([("a::env::prod", "break"), ("a::b", "warn"), ("::env::x", "warn"), ("name", "info")], "symbol string, severity string")
    return ws.attributed(f).select("app", "env", "severity", "symbol")


@query(
    "project VARCHAR, app VARCHAR, env VARCHAR, missing VARCHAR",
    ("shop/dev", "shop", "dev", "https://www.googleapis.com/auth/drive,https://www.googleapis.com/auth/script.send_mail"),
)
def fx_library_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Scopes that a library needs and its users do not declare."""
    store, manifest, w, files = _park(spark)
    return ws.library_scopes(store, manifest, ws.targets(w), ws.library(w), rules.SCOPES).select("project", "app", "env", joined("missing"))


@query(
    "wanted VARCHAR, project VARCHAR",
    ("b", "b"),
    ("b/prod", "b/prod"),
    ("prod", "a/prod"),
    ("prod", "b/prod"),
)
def fx_pick(spark: SparkSession, d: str) -> DataFrame:
    """Projects by exact name, else by the end of their names."""
    p = spark.createDataFrame([("a/prod",), ("b/prod",), ("prod2",), ("b",)], "project string")
    return rules.both(*[ws.pick(p, w).select(F.lit(w).alias("wanted"), "project") for w in ("prod", "b", "b/prod", "zzz")])


@query(
    "symbol VARCHAR, projects VARCHAR, choice VARCHAR",
    ("send", "Core", "Core"),
    ("split", "shop/dev,shop/prod", None),
)
def fx_projects_of(spark: SparkSession, d: str) -> DataFrame:
    """Which projects define a function; one is the choice."""
    store = _park(spark)[0]
    return rules.both(*[ws.projects_of(store, n) for n in ("split", "send", "gone")]).select("symbol", joined("projects"), "choice")


_FETCHED = [("X", "3", [("Code", "SERVER_JS", "function go(a) { return a; }"), ("appsscript", "JSON", "{}")], None), ("Y", "HEAD", None, "no access")]


def _libraries(spark: SparkSession):
    use = {"dependencies": {"libraries": [{"userSymbol": "Core", "libraryId": "L1", "version": "1"}, {"userSymbol": "Ext", "libraryId": "X", "version": "3"}, {"userSymbol": "Deny", "libraryId": "Y"}, {"userSymbol": "Miss", "libraryId": "Z"}, {"userSymbol": "Idle", "libraryId": "I"}]}}
    f = fx.files(spark, fx.rows("core", fx.LIBRARY), fx.rows("app", "function a() { Core.load(1); Ext.go(1); Ext.go(2); Deny.x(); Miss.y(); }", None, use))
    return fs.written(fs.facts(f)), fs.manifests(f), spark.createDataFrame(_FETCHED, libraries.FETCHED)


@query(
    "user_symbol VARCHAR, status VARCHAR, n_calls BIGINT",
    ("Core", "local", 1),
    ("Deny", "external_unresolvable", 1),
    ("Ext", "external_resolved", 2),
    ("Idle", "declared_unused", 0),
    ("Miss", "external_unfetched", 1),
)
def fx_library_status(spark: SparkSession, d: str) -> DataFrame:
    """Where the code of declared libraries is."""
    return libraries.statuses(*_libraries(spark)).select("user_symbol", "status", "n_calls")


@query(
    "total BIGINT, local BIGINT, declared_unused BIGINT, external_resolved BIGINT, external_unresolvable BIGINT, external_unfetched BIGINT",
    (5, 1, 1, 1, 1, 1),
)
def fx_library_counts(spark: SparkSession, d: str) -> DataFrame:
    return libraries.status_counts(libraries.statuses(*_libraries(spark)))


@query(
    "caller VARCHAR, provider VARCHAR, symbol VARCHAR, line INTEGER",
    ("a", "Ext", "go", 1),
    ("a", "Ext", "go", 1),
)
def fx_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Calls of libraries after fetched ones became projects of the store."""
    store, manifest, fetched = _libraries(spark)
    return crosschecks.library_edges(libraries.enriched(store, libraries.statuses(store, manifest, fetched), fetched), manifest).select("caller", "provider", F.col("function").alias("symbol"), "line")


@query(
    "what VARCHAR, script_id VARCHAR, version VARCHAR",
    ("cache", "X", "3"),
    ("cache", "Y", "HEAD"),
    ("fetch", "Y", "HEAD"),
    ("fetch", "Z", "HEAD"),
    ("refresh", "X", "3"),
    ("refresh", "Y", "HEAD"),
    ("refresh", "Z", "HEAD"),
)
def fx_library_cache(spark: SparkSession, d: str) -> DataFrame:
    """What is to be fetched beside a cache, and the cache after it."""
    store, manifest, fetched = _libraries(spark)
    status, cache = libraries.statuses(store, manifest, fetched), fetched.where("script_id = 'X'")
    key = lambda df, what: df.select(F.lit(what).alias("what"), "script_id", "version")
    return rules.both(key(libraries.to_fetch(status, cache), "fetch"), key(libraries.to_fetch(status, cache, True), "refresh"), key(libraries.cached(cache, fetched), "cache"))


@query(
    "what VARCHAR, project VARCHAR, script_id VARCHAR",
    ("conflict", "shop/prod", "other"),
    ("id", "Core", "L2"),
    ("id", "none", None),
    ("id", "shop/dev", "s1"),
    ("id", "x", "y"),
)
def fx_script_ids(spark: SparkSession, d: str) -> DataFrame:
    """Script ids of projects, overrides first, and those that differ from the workspace."""
    clasp = spark.createDataFrame([("shop/dev", "s1"), ("shop/prod", "other"), ("Core", "L1")], "project string, script_id string")
    over = spark.createDataFrame([("Core", "L2"), ("x", "y")], "project string, script_id string")
    projects = spark.createDataFrame([("shop/dev",), ("Core",), ("x",), ("none",)], "project string")
    ids = libraries.script_ids(projects, clasp, over).select(F.lit("id").alias("what"), "project", "script_id")
    return ids.unionByName(libraries.id_conflicts(clasp, ws.targets(_workspace(spark))).select(F.lit("conflict").alias("what"), "project", F.col("own").alias("script_id")))


@query(
    "symbol VARCHAR, runs BIGINT, errors BIGINT",
    ("clean_", 0, 0),
    ("doGet", 0, 0),
    ("getOrder", 0, 0),
    ("half", 0, 0),
    ("onEdit", 0, 0),
    ("split", 0, 0),
    ("weekly", 2, 1),
)
def fx_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Runs of all functions in the days before a time; 0 without any."""
    log = [("shop", "weekly", "COMPLETED", "2024-01-30"), ("shop", "weekly", "FAILED", "2024-01-29"), ("shop", "weekly", "TIMED_OUT", "2023-11-01"), ("shop", "lost", "COMPLETED", "2024-01-30"), ("other", "split", "FAILED", "2024-01-30")]
    runs = spark.createDataFrame(log, "project string, function string, status string, d string").select("project", "function", "status", F.col("d").cast("timestamp").alias("started"))
    functions = fs.functions(shop(spark)[0])[0].select("project", F.col("owner").alias("symbol"))
    return production.metrics_of(functions, runs, F.lit("2024-01-31").cast("timestamp"), 30).select("symbol", "runs", "errors")


_TRUTH = [("p", f"f{i}", s) for i, s in enumerate(["confirmed_dead"] * 7 + ["errored", "live", "unknown", "cold_exposed", "dispatched_dynamic"])]


@query(
    "total BIGINT, confirmed_dead BIGINT, dispatched_dynamic BIGINT, cold_exposed BIGINT, errored BIGINT, live BIGINT, unknown BIGINT",
    (12, 7, 1, 1, 1, 1, 1),
)
def fx_prod_counts(spark: SparkSession, d: str) -> DataFrame:
    return production.status_counts(spark.createDataFrame(_TRUTH, "project string, symbol string, status string"))


@query(
    "status VARCHAR, functions BIGINT, names VARCHAR",
    ("cold_exposed", 1, "f10"),
    ("confirmed_dead", 7, "f0, f1, f2, f3, f4"),
    ("dispatched_dynamic", 1, "f11"),
    ("errored", 1, "f7"),
)
def fx_prod_advice(spark: SparkSession, d: str) -> DataFrame:
    """The first five names of each status that asks for something."""
    return production.advice(spark.createDataFrame(_TRUTH, "project string, symbol string, status string"))


def _deployments(spark: SparkSession) -> DataFrame:
    rows = [("a", "d1", 3, ["WEB_APP"], None), ("a", "d2", 5, ["EXECUTION_API"], None), ("a", "d3", None, ["WEB_APP"], None), ("a", "d4", 2, [], None), ("b", "d5", 1, ["ADD_ON"], None), ("c", None, None, [], "no access"), ("e", "d6", None, [], None)]
    return spark.createDataFrame(rows, "project string, deployment string, version int, types array<string>, error string")


@query(
    "project VARCHAR, deployment VARCHAR, served INTEGER, latest INTEGER",
    ("a", "d1", 3, 5),
)
def fx_version_drift(spark: SparkSession, d: str) -> DataFrame:
    """Deployments that serve an old version; the head and those without entry points don't count."""
    return production.version_drift(_deployments(spark), spark.createDataFrame([("a", 1), ("a", 5), ("b", 1)], "project string, version int"))


@query(
    "projects BIGINT, web_app BIGINT, api BIGINT, addon BIGINT, unknown BIGINT, head_only BIGINT",
    (6, 1, 1, 1, 3, 2),
)
def fx_deployment_counts(spark: SparkSession, d: str) -> DataFrame:
    return production.deployment_counts(_deployments(spark), spark.createDataFrame([(x,) for x in "abcdef"], "project string"))


@query(
    "version INTEGER, file VARCHAR, change VARCHAR",
    (3, "y.gs", "modified"),
    (5, "w.gs", "only_remote"),
    (5, "y.gs", "only_local"),
)
def fx_content_drift(spark: SparkSession, d: str) -> DataFrame:
    """Served versions against the local files; a version that was not fetched is not compared."""
    local = spark.createDataFrame([("a", "x.gs", "1"), ("a", "y.gs", "2"), ("b", "z.gs", "3")], "project string, file string, sha1 string")
    remote = spark.createDataFrame([("a", 3, "x.gs", "1"), ("a", 3, "y.gs", "9"), ("a", 5, "x.gs", "1"), ("a", 5, "w.gs", "4")], "project string, version int, file string, sha1 string")
    return production.content_drift(local, remote, _deployments(spark)).select("version", "file", "change")


@query(
    "symbol VARCHAR, signature VARCHAR, callers_total BIGINT, callers_shown INTEGER, callers VARCHAR, callees VARCHAR, exposures VARCHAR, contract_source VARCHAR, fields_read VARCHAR, patterns VARCHAR, coverage_pct BIGINT, confidence VARCHAR",
    ('getOrder', 'getOrder(id: string, rate: number) -> {total: number, tax: number}', 2, 1, 'client_call.invocation', "SpreadsheetApp.getActive,SpreadsheetApp.getActive().getSheetByName,SpreadsheetApp.getActive().getSheetByName('orders').getValues,rows.filter,split", 'client_call:1', 'mixed', 'tax,total', 'array2d:8,destructuring:10', 100, 'high'),
    ("half", "half(n)", 1, 1, "scriptlet", "split", "scriptlet:1", "unknown", "", "", 100, "high"),
    ("weekly", "weekly()", 3, 1, "client_call.invocation", "PropertiesService.getScriptProperties,PropertiesService.getScriptProperties().getProperty,PropertiesService.getScriptProperties().setProperty,getOrder", "client_call:1,installable_trigger:1", "inferred_from_usage", "length", "property:17,property:18", 100, "high"),
)
def fx_inspect(spark: SparkSession, d: str) -> DataFrame:
    """All that is known of a function; the callers shown are limited."""
    store = fs.written(shop(spark)[0])
    told = rules.both(*[ins.inspect(store, n, parts=["all"], most=1) for n in ("getOrder", "weekly", "half", "gone")])
    said = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[k].cast("string") for k in f])), ","), F.lit("")).alias(c)
    return told.select("symbol", "signature", "callers_total", "callers_shown", said("callers", ["kind", "owner"]), joined("callees"), said("exposures", ["type", "n_sites"]), "contract_source", joined("fields_read"), said("patterns", ["fact", "line"]), "coverage_pct", "confidence")


@query(
    "level VARCHAR, columns VARCHAR",
    ("full ['callees']", 'project,symbol,signature,callees'),
    ("full", "project,symbol,signature,file,line,end_line,visibility,params,callers,callers_total,callers_shown,callees,exposures,returns_type,returns_fields,fields_read,serializable,nullable,fields_made,contract_source,patterns,uncertain,coverage_pct,confidence"),
    ("graph", "project,symbol,signature,callers,callers_total,callers_shown,callees"),
    ("standard", "project,symbol,signature,file,line,end_line,visibility,params,callers,callers_total,callers_shown,callees,exposures"),
    ("summary", "project,symbol,signature,exposures"),
)
def fx_inspect_levels(spark: SparkSession, d: str) -> DataFrame:
    """Which parts each level of detail has; parts asked for by name win."""
    store = shop(spark)[0]
    asked = [(lv, None) for lv in ins.LEVELS] + [("full", ["callees"])]
    return spark.createDataFrame([(f"{lv} {p or ''}".strip(), ",".join(ins.inspect(store, "split", level=lv, parts=p).columns)) for lv, p in asked], "level string, columns string")


@query(
    "asked VARCHAR, other VARCHAR, distance INTEGER, place INTEGER",
    ("getorder", "getOrder", 0, 1),
    ("week", "weekly", 2, 1),
)
def fx_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Names near one that is not there."""
    store = shop(spark)[0]
    return rules.both(*[ins.suggestions(store, n).withColumn("asked", F.lit(n)) for n in ("getorder", "week", "zzzz")]).select("asked", "other", "distance", "place")


@query(
    "projects BIGINT, files BIGINT, problems BIGINT, functions BIGINT, edges BIGINT, exposures BIGINT",
    (2, 3, 1, 9, 8, 6),
)
def fx_store_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.store_counts(shop(spark, fx.rows("Core", fx.LIBRARY + "let = ;"))[0])


@query(
    "kind VARCHAR, severity VARCHAR, findings BIGINT",
    ("doc.param_drift", "warn", 1),
    ("doc.return_drift", "warn", 1),
    ("doc.stale_ref", "info", 1),
    ("doc.undocumented", "info", 1),
    ("lint.library_chatty_ui", "info", 1),
    ("lint.lock_no_finally", "warn", 1),
    ("lint.quota_in_loop", "warn", 1),
    ("lint.trigger_orphan", "info", 1),
    ("lint.urlfetch_in_loop", "warn", 1),
)
def fx_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings by rule: run time and documentation."""
    store, manifest = _ruled(spark)
    return reports.rule_counts(rules.runtime_rules(store, manifest).unionByName(rules.doc_rules(fs.facts(fx.files(spark, fx.rows("d", fx.DOCS))))))


@query(
    "pct BIGINT, confidence VARCHAR",
    (92, "high"),
)
def fx_diff_coverage(spark: SparkSession, d: str) -> DataFrame:
    a, b = (fs.facts(fx.files(spark, fx.rows("p", c))) for c in (fx.PATTERNS, fx.PATTERNS + "function bad() { eval('1'); eval('2'); eval('3'); eval('4'); eval('5'); eval('6'); eval('7'); eval('8'); eval('9'); }"))
    return reports.diff_coverage(a, b)


@query(
    "analysed BIGINT, truncated BIGINT, unknown_root BIGINT",
    (4, 1, 1),
)
def fx_chain_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.chain_counts(fs.facts(fx.files(spark, fx.rows("c", fx.CHAINS + "function g() { a.b.c().d(); }"))), ["SpreadsheetApp", "UserProperties"])


@query(
    "need VARCHAR, occurrences BIGINT, context VARCHAR",
    ("Other", 1, None),
    ("Éviter les boucles !", 3, "b"),
)
def fx_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests that say the same, whatever their accents, case and signs, count as one; the last context that is not empty stays."""
    rows = [("1", "Éviter les boucles !", "a", "2024-01-01"), ("2", "eviter  LES boucles", "", "2024-01-03"), ("3", "éviter, les boucles", "b", "2024-01-02"), ("4", "Other", None, "2024-01-01")]
    e = spark.createDataFrame(rows, "id string, need string, context string, d string").select("id", "need", "context", F.col("d").cast("timestamp").alias("at"))
    return reports.request_counts(e).select("need", "occurrences", "context")


@query(
    "tasks BIGINT, detected BIGINT, detected_pct BIGINT, mean_bytes BIGINT",
    (3, 1, 33, 75),
)
def fx_task_results(spark: SparkSession, d: str) -> DataFrame:
    return reports.task_results(spark.createDataFrame([("a", "BREAK", "BREAK", 100), ("b", "CLEAN", "BREAK", 50), ("c", None, "WARN", None)], "task string, verdict string, expected string, bytes int"))


@query(
    "ok BIGINT, warn BIGINT, fail BIGINT, well BOOLEAN, exit_code INTEGER",
    (2, 1, 1, False, 2),
)
def fx_doctor(spark: SparkSession, d: str) -> DataFrame:
    return reports.doctor(spark.createDataFrame([("a", "ok"), ("b", "warn"), ("c", "fail"), ("d", "ok")], "check string, status string"))


@query(
    "verdict VARCHAR, warn BOOLEAN, exit_code INTEGER",
    ("BREAK", False, 3),
    ("BREAK", True, 3),
    ("CLEAN", False, 0),
    ("CLEAN", True, 0),
    ("WARN", False, 0),
    ("WARN", True, 4),
)
def fx_exit_codes(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame([("BREAK",), ("WARN",), ("CLEAN",)], "verdict string")
    return rules.both(*[reports.exit_code(v, w).withColumn("warn", F.lit(w)) for w in (False, True)]).select("verdict", "warn", "exit_code")


@query(
    "project VARCHAR, stale BOOLEAN",
    ("a", True),
    ("b", False),
)
def fx_stale(spark: SparkSession, d: str) -> DataFrame:
    """Projects with a source newer than their scan."""
    f = spark.createDataFrame([("a", "2024-01-02"), ("a", "2024-01-04"), ("b", "2024-01-01")], "project string, d string").select("project", F.col("d").cast("timestamp").alias("mtime"))
    return reports.stale_index(f, F.lit("2024-01-03").cast("timestamp")).select("project", "stale")


_EVENTS = ['{"tool_input": {"file_path": "/w/shop/main.gs"}}', '{"tool_input": {"file_path": "/w/shop/notes.md"}}', '{"tool_input": {"command": "cd x && clasp push"}, "cwd": "/w/core"}', '{"tool_input": {"command": "ls"}, "cwd": "/w"}', "{oops", "{}", '{"tool_input": {"file_path": "/else/a.html"}}', '{"tool_input": {"file_path": "/w/shop/sub/appsscript.json"}}']


@query(
    "file VARCHAR, command VARCHAR, project VARCHAR, decision VARCHAR, reason VARCHAR",
    ("/else/a.html", None, None, "pass", "outside of all projects"),
    ("/w/shop/main.gs", None, "shop", "block", "verdict BREAK"),
    ("/w/shop/notes.md", None, None, "pass", "no source of a project"),
    ("/w/shop/sub/appsscript.json", None, "sub", "pass", "verdict unknown"),
    (None, "cd x && clasp push", "core", "pass", "verdict WARN"),
    (None, "ls", None, "pass", "nothing is published"),
    (None, None, None, "pass", "neither file nor command"),
    (None, None, None, "pass", "not JSON"),
)
def fx_hooks(spark: SparkSession, d: str) -> DataFrame:
    """Events of edits and of publishing, the project each is of, and the decision by its verdict."""
    projects = spark.createDataFrame([("shop", "/w/shop"), ("core", "/w/core"), ("sub", "/w/shop/sub")], "project string, folder string")
    verdicts = spark.createDataFrame([("shop", "BREAK"), ("core", "WARN")], "project string, verdict string")
    events = spark.createDataFrame([(e,) for e in _EVENTS], "payload string")
    return hooks.decisions(hooks.with_project(hooks.asked(events), projects), verdicts)


@query(
    "symbol VARCHAR, line VARCHAR",
    ("load", "load(a: ?string, b: number|string[], c: object, d: unknown): Promise<{ id: string; at?: Date; all: number[] }>;"),
)
def fx_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Declarations of the functions that pages call, with documented types."""
    code = "/** A.\n * @param {?string} a\n * @param {Array<number|string>} b\n * @param {Object} c\n * @returns {{id: string, at?: Date, all: number[]}} it */\nfunction load(a, b, c, d) {}\nfunction idle() {}"
    return codegen.declarations(fs.facts(fx.files(spark, fx.rows("p", code, "<script>google.script.run.load(1)</script>")))).select("symbol", "line")


@query(
    "project VARCHAR, text VARCHAR",
    ("shop", "interface Server {\n  getOrder(id: string, rate: number): Promise<{ total: number; tax: number }>;\n  weekly(): Promise<unknown>;\n}\n"),
)
def fx_declaration_file(spark: SparkSession, d: str) -> DataFrame:
    return codegen.declaration_files(shop(spark)[0])


@query(
    "symbol VARCHAR, field VARCHAR",
    ("getOrder", "tax"),
    ("getOrder", "total"),
    ("weekly", "length"),
)
def fx_contract_tests(spark: SparkSession, d: str) -> DataFrame:
    return codegen.contract_tests(shop(spark)[0]).select("symbol", "field")
