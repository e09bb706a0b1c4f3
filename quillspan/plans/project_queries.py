"""Rules and summaries over whole tables: each customer is a script project whose code, page and manifest follow from its row.

A project's parts are (condition, text) pairs; a condition is SQL over k
(c_custkey), n (c_nationkey) and seg (c_mktsegment). The query renders,
parses and runs the rules; its SQL says what must come out of the same
conditions, without any code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import codegen
from quillspan.operators import facts as fs
from quillspan.operators import incremental, libraries, production, reports
from quillspan.operators import workspace as ws
from quillspan.plans import crosschecks, inspect, rules
from quillspan.plans.catalog import query
from quillspan.sources.shared import stored
from quillspan.sources.tables import table

AUTH, MAIL = rules.AUTH, rules.MAIL
Parts = list[tuple[str, str]]
#: The customers as the SQL has them; p is the project.
_C = "WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS seg, CAST(c_custkey AS VARCHAR) AS p FROM customer)"


def customers(spark: SparkSession, d: str) -> DataFrame:
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # parsing is costly and the table may be one row group
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("seg")).repartition(n, "k")


def rendered(parts: Parts, glue: str = "\n") -> Column:
    """The texts whose conditions hold, a line each; a line whose condition doesn't hold is empty."""
    return F.concat_ws(glue, *[F.when(F.expr(c), F.lit(t)).otherwise("") for c, t in parts])


def file(df: DataFrame, name: str, kind: str, content: Column) -> DataFrame:
    return df.select(F.col("k").cast("string").alias("project"), F.lit(name).alias("file"), F.lit(kind).alias("kind"), content.alias("content"))


def manifest_of(libraries: Parts = (), services: Parts = (), scopes: Parts = (), whitelist: Parts = ()) -> Column:
    """A manifest as JSON; entries whose conditions don't hold are left out."""
    listed = lambda parts, quote: F.concat(F.lit("["), F.array_join(F.filter(F.array(F.lit(None).cast("string"), *[F.when(F.expr(c), F.lit(f'"{t}"' if quote else t)) for c, t in parts]), lambda x: x.isNotNull()), ","), F.lit("]"))
    return F.concat(F.lit('{"dependencies":{"libraries":'), listed(libraries, False), F.lit(',"enabledAdvancedServices":'), listed(services, False), F.lit('},"oauthScopes":'), listed(scopes, True), F.lit(',"urlFetchWhitelist":'), listed(whitelist, True), F.lit("}"))


def told(findings: DataFrame, *more: str) -> DataFrame:
    return findings.select("project", "kind", "severity", "symbol", "line", *more)


def expected(*cases: tuple[str, str, str, str, int], first: str = _C) -> str:
    """SQL of findings: (condition, kind, severity, symbol, line)."""
    return first + " " + " UNION ALL ".join(f"SELECT p AS project, '{kind}' AS kind, '{severity}' AS severity, '{symbol}' AS symbol, CAST({line} AS INTEGER) AS line FROM c WHERE {cond}" for cond, kind, severity, symbol, line in cases)


# ---- manifest


@query(expected(
    ("k % 3 = 0 AND seg <> 'BUILDING'", "manifest.library", "break", "Lib", 1),
    ("k % 7 = 0 AND seg <> 'MACHINERY'", "manifest.advanced_service", "break", "Drive", 4),
    ("k % 3 <> 0 AND seg = 'BUILDING'", "manifest.library", "info", "Lib", 1),
    ("k % 7 <> 0 AND seg = 'MACHINERY'", "manifest.advanced_service", "info", "Drive", 1),
    ("k % 4 = 0 AND n % 4 IN (1, 3)", "manifest.scope", "warn", "MailApp", 2),
    ("k % 5 = 0 AND n % 4 <> 0", "manifest.scope", "warn", "UrlFetchApp", 3),
    ("k % 2 = 0 AND n % 4 IN (1, 2)", "manifest.scope", "warn", "SpreadsheetApp", 5),
    ("n % 4 = 1", "manifest.scope", "info", AUTH + "documents", 1),
    ("n % 4 = 2 AND k % 4 <> 0", "manifest.scope", "info", MAIL, 1),
    ("n % 4 = 3 AND k % 2 <> 0", "manifest.scope", "info", AUTH + "spreadsheets", 1),
    ("n % 4 = 3 AND k % 6 = 0", "manifest.scope", "info", AUTH + "spreadsheets", 1),
    ("n % 4 = 2 AND k % 4 = 0", "manifest.scope", "info", MAIL, 1),
    ("n % 5 = 0 AND k % 5 = 0", "manifest.urlfetch_whitelist", "warn", "https://b.example/x", 3),
))
def manifest_checks(spark: SparkSession, d: str) -> DataFrame:
    """Libraries, services, scopes and addresses that code uses against what manifests declare."""
    c = customers(spark, d)
    code = rendered([
        ("k % 3 = 0", "function a() { Lib.go(1); }"), ("k % 4 = 0", "function b() { MailApp.sendEmail('x'); }"), ("k % 5 = 0", "function f() { UrlFetchApp.fetch('https://b.example/x'); }"),
        ("k % 7 = 0", "function e() { Drive.Files.list(); }"), ("k % 2 = 0", "function g() { SpreadsheetApp.getActive(); }"), ("k % 6 = 0", "/** @OnlyCurrentDoc */"), ("true", "function z() { return 1; }"),
    ])
    manifest = manifest_of(
        [("seg = 'BUILDING'", '{"userSymbol":"Lib","libraryId":"L1","version":"3"}')], [("seg = 'MACHINERY'", '{"userSymbol":"Drive","serviceId":"drive","version":"v2"}')],
        [("n % 4 = 1", AUTH + "documents"), ("n % 4 = 2", MAIL), ("n % 4 = 3", AUTH + "spreadsheets")], [("n % 5 = 0", "https://a.example/")],
    )
    files = file(c, "main.gs", "gs", code).unionByName(file(c, "appsscript.json", "manifest", manifest))
    return told(rules.manifest_rules(fs.written(fs.facts(files)), stored(fs.manifests(files))))


# ---- run time, documentation, API


@query(expected(
    ("k % 2 = 0", "lint.quota_in_loop", "warn", "a", 1),
    ("k % 3 = 0", "lint.urlfetch_in_loop", "warn", "b", 2),
    ("k % 5 = 0", "lint.lock_no_finally", "warn", "f", 3),
    ("k % 7 = 0 AND k % 11 <> 0", "lint.trigger_orphan", "info", "g", 5),
    ("k % 4 = 0 AND seg = 'BUILDING'", "lint.library_chatty_ui", "info", "<project>", 1),
))
def runtime_checks(spark: SparkSession, d: str) -> DataFrame:
    """Cells and fetches in loops, locks that are not released, triggers that nothing deletes, pages that call a library's server often."""
    c = customers(spark, d)
    code = rendered([
        ("k % 2 = 0", "function a(list) { for (const x of list) { sheet.getRange(1, 1).setValue(x); } }"), ("k % 3 = 0", "function b(list) { list.forEach(u => UrlFetchApp.fetch(u)); }"),
        ("k % 5 = 0", "function f() { const l = LockService.getScriptLock(); l.waitLock(10); }"), ("k % 6 = 0", "function e() { const l = LockService.getScriptLock(); try { l.tryLock(10); } finally { l.releaseLock(); } }"),
        ("k % 7 = 0", "function g() { ScriptApp.newTrigger('a').timeBased().create(); }"), ("k % 11 = 0", "function h() { for (const t of ScriptApp.getProjectTriggers()) ScriptApp.deleteTrigger(t); }"),
    ])
    page = rendered([("true", "<script>"), ("k % 2 = 0", "google.script.run.a(1); google.script.run.b(2);"), ("k % 4 = 0", "google.script.run.f();"), ("true", "</script>")], "")
    manifest = manifest_of([("seg = 'BUILDING'", '{"userSymbol":"Lib","libraryId":"L1","version":"3"}')])
    files = file(c, "main.gs", "gs", code).unionByName(file(c, "page.html", "html", page)).unionByName(file(c, "appsscript.json", "manifest", manifest))
    return told(rules.runtime_rules(fs.written(fs.facts(files)), stored(fs.manifests(files))))


@query(expected(
    ("k % 2 = 1", "doc.undocumented", "info", "a", 4), ("true", "doc.undocumented", "info", "z", 10),
    ("k % 3 = 0 AND k % 2 = 0", "doc.param_drift", "warn", "a", 4),
    ("k % 5 = 0", "doc.return_drift", "warn", "b", 8),
    ("k % 7 = 0", "doc.stale_ref", "info", "b", 8),
))
def doc_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documentation comments against parameters, returned fields and names."""
    return told(rules.doc_rules(fs.written(fs.facts(file(customers(spark, d), "main.gs", "gs", _doc_code())))))


def _doc_code() -> Column:
    head = F.when(F.expr("k % 2 = 1"), "\n\n").otherwise(F.concat(F.lit("/** Adds.\n * @param {number} "), F.when(F.expr("k % 3 = 0"), "q").otherwise("x"), F.lit("\n */")))
    over = F.concat(F.lit("/** Gives. "), F.when(F.expr("k % 7 = 0"), "{@link gone} ").otherwise("{@link a} "), F.lit("\n * @returns {object} has `sum`"), F.when(F.expr("k % 5 = 0"), " and `lost`").otherwise(""), F.lit("\n */"))
    return F.concat_ws("\n", head, F.lit("function a(x) { return x; }"), over, F.lit("function b(y) { return {sum: y}; }"), F.lit(""), F.lit("function z() {}"))


_REGISTRY = [("SpreadsheetApp", "getActive", "Spreadsheet", 0, None), ("Spreadsheet", "getSheetByName", "Sheet", 1, None), ("Sheet", "getRange", "Range", 1, None), ("Sheet", "getRangeList", "RangeList", 1, None), ("Range", "setValue", "Range", 1, None), ("UserProperties", "getProperty", "String", 1, None), ("UserProperties", "*", None, 0, "PropertiesService")]


@query(_C + """ SELECT p AS project, 'api.unknown_method' AS kind, 'break' AS severity, 'Sheet.getRnge' AS symbol, CAST(1 AS INTEGER) AS line, 'Sheet has no such method; near: getRange, getRangeList' AS reason FROM c WHERE k % 2 = 0
UNION ALL SELECT p, 'api.wrong_arity', 'break', 'Spreadsheet.getSheetByName', CAST(2 AS INTEGER), 'too few arguments' FROM c WHERE k % 3 = 0
UNION ALL SELECT p, 'api.deprecated', 'warn', 'UserProperties.getProperty', CAST(3 AS INTEGER), 'deprecated in UserProperties' FROM c WHERE k % 5 = 0""")
def api_checks(spark: SparkSession, d: str) -> DataFrame:
    """Chains of calls against a registry of types: methods it hasn't, with near ones, missing arguments, deprecated ones."""
    return told(rules.api_rules(fs.written(fs.facts(file(customers(spark, d), "main.gs", "gs", _api_code()))), _REGISTRY), "reason")


def _api_code() -> Column:
    return rendered([
        ("k % 2 = 0", "function a() { SpreadsheetApp.getActive().getSheetByName('a').getRnge(1).setValue(); }"), ("k % 3 = 0", "function b() { SpreadsheetApp.getActive().getSheetByName(); }"),
        ("k % 5 = 0", "function f() { UserProperties.getProperty('a').trim(); }"), ("true", "function g() { SpreadsheetApp.getActive().getSheetByName('a').getRange(1).setValue(2); Other.x().y(); }"),
    ])


@query(_C + """ SELECT CAST(count(*) + count(*) FILTER (k % 2 = 0) + count(*) FILTER (k % 3 = 0) + count(*) FILTER (k % 5 = 0) + count(*) AS BIGINT) AS chains, CAST(0 AS BIGINT) AS truncated, count(*) AS unknown_root, count(*) FILTER (k % 5 = 0) AS unknown_type,
CAST(count(*) FILTER (k % 2 = 0) + count(*) FILTER (k % 3 = 0) + count(*) FILTER (k % 5 = 0) AS BIGINT) AS findings FROM c""")
def api_totals(spark: SparkSession, d: str) -> DataFrame:
    """Chains of calls in all, those of unknown roots, those that came to an unknown type, and findings."""
    return rules.api_counts(fs.written(fs.facts(file(customers(spark, d), "main.gs", "gs", _api_code()))), _REGISTRY)


@query(expected(("true", "doc.undocumented", "info", "z", 10), ("k % 2 = 1", "doc.undocumented", "info", "a", 4)))
def doc_selected(spark: SparkSession, d: str) -> DataFrame:
    """One of the checks of documentation, of public functions only."""
    return told(rules.doc_rules(fs.written(fs.facts(file(customers(spark, d), "main.gs", "gs", F.concat(_doc_code(), F.lit("\nfunction own_() {}"))))), ["undocumented"], public_only=True))


@query(r"""WITH t AS (SELECT CAST(page_id AS VARCHAR) AS file, unnest(regexp_extract_all(html, '<a\b[^>]*>')) AS tag FROM pages), l AS (SELECT file, regexp_extract(tag, 'href="([^"]*)"', 1) AS symbol FROM t WHERE NOT regexp_matches(tag, '\btarget=')),
f AS (SELECT CAST(page_id AS VARCHAR) AS file, len(regexp_extract_all(html, '<form\b')) AS n FROM pages),
r AS (SELECT CAST(page_id AS VARCHAR) AS file, unnest(regexp_extract_all(html, '<(?:script|img|iframe|audio|video|source|embed)\b[^>]*\bsrc="(http://[^"]*)"', 1)) AS symbol FROM pages)
SELECT file, 'webapp.link_target' AS kind, 'warn' AS severity, symbol FROM l WHERE symbol <> '' AND symbol NOT LIKE '#%' UNION ALL SELECT file, 'webapp.mixed_content', 'warn', symbol FROM r UNION ALL SELECT file, 'webapp.form_submit', 'warn', 'form' FROM (SELECT file, unnest(range(n)) FROM f)""")
def page_checks(spark: SparkSession, d: str) -> DataFrame:
    """Links without a target, resources without encryption and forms of whole pages."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = table(spark, d, "pages").repartition(n, "page_id").select(F.lit("site").alias("project"), F.col("page_id").cast("string").alias("file"), F.lit("html").alias("kind"), F.col("html").alias("content"))
    return rules.webapp_rules(fs.written(fs.facts(pages))).select("file", "kind", "severity", "symbol")


# ---- environments


_ENVS = _C + """, e AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'prod' ELSE 'dev' END AS env, 'app' || n AS app, p AS proj FROM c), s AS (SELECT *, app || '::env::' || env AS symbol FROM e)"""


def _case(cond: str, kind: str, severity: str, line: int = 1) -> str:
    return f"SELECT proj AS project, '{kind}' AS kind, '{severity}' AS severity, symbol, CAST({line} AS INTEGER) AS line FROM s WHERE {cond}"


@query(_ENVS + " " + " UNION ALL ".join([
    _case("env = 'prod' AND seg = 'BUILDING'", "env.library_version_mismatch", "break"), _case("env = 'prod' AND seg = 'MACHINERY'", "env.library_version_mismatch", "break"),
    _case("env = 'dev' AND seg IN ('AUTOMOBILE', 'MACHINERY')", "env.library_version_mismatch", "warn"),
    _case("env = 'prod' AND k % 3 = 0", "env.cross_env_leak", "break"), _case("env = 'dev' AND k % 3 = 0", "env.hardcoded_resource", "warn"),
    _case("env = 'dev' AND k % 5 = 0", "env.cross_env_leak", "break", line=2), _case("env = 'prod' AND k % 5 = 0", "env.hardcoded_resource", "warn", line=2),
    _case("k % 7 = 0", "env.hardcoded_resource", "warn", line=3),
]) + " UNION ALL SELECT '', 'env.undeclared_resource', 'warn', 'env::prod', CAST(1 AS INTEGER)")
def env_checks(spark: SparkSession, d: str) -> DataFrame:
    """Projects of two environments: pinned libraries, ids of resources as parts of words and lines, short and long, resources that one environment hasn't."""
    c = customers(spark, d)
    code = rendered([("k % 3 = 0", "const A = 'xdev-sheet-7y';"), ("k % 5 = 0", "const B = 'see https://docs.example/d/" + "P" * 44 + "/edit';"), ("k % 7 = 0", "function f() { DriveApp.getFileById('" + "Z" * 24 + "'); }"), ("true", "function z() { return 1; }")])
    library = lambda v: '{"userSymbol":"Core","libraryId":"L1","version":"' + v + '"}'
    manifest = manifest_of([("seg = 'BUILDING'", library("HEAD")), ("seg = 'AUTOMOBILE'", library("11")), ("seg = 'MACHINERY'", library("10"))])
    files = file(c, "main.gs", "gs", code).unionByName(file(c, "appsscript.json", "manifest", manifest))
    targets = c.select(F.col("k").cast("string").alias("project"), F.concat(F.lit("app"), "n").alias("app"), F.when(F.col("k") % 2 == 0, "prod").otherwise("dev").alias("env"))
    declared = spark.createDataFrame([("Core", "L1", 11)], "user_symbol string, script_id string, prod_version int")
    resources = spark.createDataFrame([("dev", "sheet", "dev-sheet-7"), ("prod", "sheet", "P" * 44), ("dev", "log", "dev-log")], "env string, name string, id string")
    return told(rules.environment_rules(fs.written(fs.facts(files)), stored(fs.manifests(files)), targets, declared, resources, files))


# ---- two snapshots


_BEFORE = [
    "/** @returns {{total: number, tax: number}} */",
    "function getOrder(id, rate) { const rows = SpreadsheetApp.getActive().getSheetByName('o').getValues(); const found = rows.filter(r => r[0] === id && r[3] > 0); return {total: found, tax: rate}; }",
    "function split(x) { return [x.length, 1]; }",
    "function weekly() { const o = getOrder('x', 2); PropertiesService.getScriptProperties().setProperty('LAST', o.total); return PropertiesService.getScriptProperties().getProperty('LAST'); }",
    "function half(n) { return split(n)[0] / 2; }",
    "function doGet() { const t = HtmlService.createTemplateFromFile('page'); t.data = {title: 'x', user: 'y'}; return t.evaluate(); }",
]
#: One edit for each remainder of k by 12; the others change nothing.
_EDITS = {
    0: (0, "{total: number, tax: number}", "{total: number}"), 1: (2, "function split(", "function cut("), 2: (1, "getOrder(id, rate)", "getOrder(id)"), 3: (1, "getOrder(id, rate)", "getOrder(rate, id)"),
    4: (5, "title: 'x', user", "user"), 5: (1, "return {total", "if (id) return new Order(); return {total"), 6: (1, "return {total", "if (!id) return null; return {total"), 7: (1, "r[3] > 0", "r[5] > 0"),
    8: (3, "getProperty('LAST')", "getProperty(k)"), 9: (2, "split(x)", "split(x, y)"),
}
_PAGE = "<p><?= data.title ?><?= data.user ?></p>\n<script>\nfunction show(o) { alert(o.total + o.tax); }\nfunction show(p) { alert(p.never); }\ngoogle.script.run.withSuccessHandler(show).getOrder('1', 3);\n</script>"


def _snapshots(spark: SparkSession, d: str, only: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The stores of all projects before and after, of the facts that are asked for."""
    c = customers(spark, d)
    after = [F.lit(x) for x in _BEFORE]
    for k, (line, old, new) in _EDITS.items():
        after[line] = F.when(F.expr(f"k % 12 = {k}"), F.lit(_BEFORE[line].replace(old, new))).otherwise(after[line])
    page = file(c, "page.html", "html", F.lit(_PAGE))
    store = lambda code: fs.written(fs.facts(file(c, "main.gs", "gs", code).unionByName(page), only))
    return store(F.lit("\n".join(_BEFORE))), store(F.concat_ws("\n", *after))


def _changes_sql(*cases: tuple[int, str, str, str | None]) -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    return _C + " " + " UNION ALL ".join(f"SELECT p AS project, '{change}' AS change, '{symbol}' AS symbol, CAST({text(detail)} AS VARCHAR) AS detail FROM c WHERE k % 12 = {k}" for k, change, symbol, detail in cases)


@query(_changes_sql(
    (0, "return.field_removed", "getOrder", "tax"), (1, "function_renamed", "split", "cut"), (2, "param.removed", "getOrder", "rate"), (3, "param.reordered", "getOrder", "rate,id"),
    (4, "template.binding_field_removed", "page", "title"), (5, "serializable.broke", "getOrder", None), (6, "return.nullability_changed", "getOrder", None),
    (7, "array.column_indices_changed", "getOrder", "rows"), (7, "array.max_index_grew", "getOrder", "rows"), (8, "property_key.write_only", "LAST", "script"), (9, "param.added", "split", "y"),
))
def code_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changed between two snapshots of all projects: fields, names, parameters, templates, shapes, columns, keys."""
    return rules.changes(*_snapshots(spark, d, rules.CHANGED))


@query(expected(
    ("k % 12 = 0", "client_call.success_handler", "break", "getOrder", 3),
    ("k % 12 = 1", "internal_caller", "break", "split", 5),
    ("k % 12 = 2", "internal_caller", "break", "getOrder", 4), ("k % 12 = 2", "client_call.invocation", "break", "getOrder", 5),
    ("k % 12 = 3", "internal_caller", "break", "getOrder", 4),
    ("k % 12 = 4", "template_scriptlet_reader", "break", "page", 1), ("k % 12 = 4", "template_scriptlet_reader", "warn", "page", 1),
    ("k % 12 = 5", "client_call.invocation", "break", "getOrder", 5),
    ("k % 12 = 6", "client_call.success_handler", "warn", "getOrder", 3), ("k % 12 = 6", "client_call.success_handler", "warn", "getOrder", 3), ("k % 12 = 6", "internal_caller", "warn", "getOrder", 4),
    ("k % 12 = 7", "array2d_consumer", "break", "getOrder", 2),
    ("k % 12 = 8", "property_key_writer", "warn", "LAST", 4),
))
def code_breaks(spark: SparkSession, d: str) -> DataFrame:
    """What those changes break, in scripts and pages; of two handlers of one name the first counts."""
    return told(rules.diff(*_snapshots(spark, d, rules.DIFFED)))


# ---- what reaches what, and what runs


_GRAPH = [("true", "function a() { b(); gone(); parseInt('1'); }"), ("true", "function b() { return 1; }"), ("k % 2 = 0", "function doGet() { return 1; }"), ("k % 3 = 0", "function onEdit(e) { return a(); }"), ("k % 5 = 0", "ScriptApp.newTrigger('b').timeBased().create();"), ("true", "function idle_() { eval('1'); }")]


def _graph(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d)
    page = rendered([("true", "<p><?= b() ?></p><script>"), ("k % 7 = 0", "google.script.run.a();"), ("k % 11 = 0", "google.script.run.lost();"), ("true", "</script>")], "")
    return fs.written(fs.facts(file(c, "main.gs", "gs", rendered(_GRAPH)).unionByName(file(c, "page.html", "html", page))))


@query(_C + """ SELECT p AS project, 'b' AS symbol, 'scriptlet' AS type, CAST(1 AS BIGINT) AS n_sites FROM c UNION ALL SELECT p, 'b', 'installable_trigger', 1 FROM c WHERE k % 5 = 0
UNION ALL SELECT p, 'a', 'client_call', 1 FROM c WHERE k % 7 = 0 UNION ALL SELECT p, 'doGet', 'entry_point_web', 1 FROM c WHERE k % 2 = 0 UNION ALL SELECT p, 'onEdit', 'simple_trigger', 1 FROM c WHERE k % 3 = 0""")
def code_exposures(spark: SparkSession, d: str) -> DataFrame:
    """How the outside reaches functions: web entries, triggers, pages, scriptlets."""
    return fs.exposures(_graph(spark, d))


@query(_C + """ SELECT p AS project, 'b' AS symbol, CAST(2 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_callers, CASE WHEN k % 5 = 0 THEN 'installable_trigger,internal_caller' ELSE 'internal_caller,scriptlet' END AS first FROM c
UNION ALL SELECT p, 'a', CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END, CASE WHEN k % 21 = 0 THEN 'client_call.invocation,internal_caller' WHEN k % 7 = 0 THEN 'client_call.invocation' ELSE 'internal_caller' END FROM c WHERE k % 3 = 0 OR k % 7 = 0""")
def code_callers(spark: SparkSession, d: str) -> DataFrame:
    """The call graph turned round: how many places name a function, and the first two."""
    return fs.called_by(_graph(spark, d), most=2).select("project", "symbol", "n_callers", F.array_join("callers.kind", ",").alias("first"))


@query(_C + """ SELECT p AS project, 'internal_caller' AS kind, 'gone' AS symbol, CAST(1 AS INTEGER) AS line FROM c UNION ALL SELECT p, 'internal_caller', 'eval', 6 FROM c UNION ALL SELECT p, 'client_call.invocation', 'lost', 1 FROM c WHERE k % 11 = 0""")
def code_unresolved(spark: SparkSession, d: str) -> DataFrame:
    """Places that name no function of their project."""
    return fs.unresolved(_graph(spark, d)).select("project", "kind", "symbol", "line")


@query(_C + """ SELECT p AS project, 'a' AS callee, '-' AS receiver, 'function' AS resolution FROM c WHERE k % 3 = 0 UNION ALL SELECT p, 'b', '-', 'function' FROM c UNION ALL SELECT p, 'gone', '-', 'unresolved' FROM c UNION ALL SELECT p, 'parseInt', '-', 'builtin' FROM c UNION ALL SELECT p, 'eval', '-', 'unresolved' FROM c""")
def code_calls(spark: SparkSession, d: str) -> DataFrame:
    """What every call in a function is resolved to: a function of the project, a built-in, nothing."""
    store = _graph(spark, d)
    none = stored(fs.manifests(file(customers(spark, d), "appsscript.json", "manifest", manifest_of())))
    return fs.resolved_calls(store, none).select("project", "callee", F.when(F.col("receiver").isNull(), "-").otherwise("+").alias("receiver"), "resolution")


_LOG = _C + """, m AS (SELECT user_id, count(*) AS runs, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1),
f AS (SELECT p, k, unnest(['a', 'b', 'idle_']) AS symbol FROM c UNION ALL SELECT p, k, 'doGet' FROM c WHERE k % 2 = 0 UNION ALL SELECT p, k, 'onEdit' FROM c WHERE k % 3 = 0),
t AS (SELECT p, symbol, CASE WHEN symbol = 'a' THEN coalesce(runs, 0) ELSE 0 END AS runs, CASE WHEN symbol = 'a' THEN coalesce(errors, 0) ELSE 0 END AS errors,
  symbol IN ('b', 'doGet', 'onEdit') OR (symbol = 'a' AND (k % 3 = 0 OR k % 7 = 0)) AS seen FROM f LEFT JOIN m ON user_id = k),
s AS (SELECT *, CASE WHEN runs = 0 THEN 'cold' WHEN runs / 30.0 >= 1 THEN 'hot' ELSE 'warm' END AS heat FROM t),
v AS (SELECT p AS project, symbol, runs, errors, heat, CASE WHEN runs > 0 AND errors * 100 >= runs * 5 THEN 'errored' WHEN NOT seen AND heat = 'cold' THEN 'confirmed_dead' WHEN NOT seen THEN 'dispatched_dynamic' WHEN heat = 'cold' THEN 'cold_exposed' ELSE 'live' END AS status FROM s)"""


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """Functions of all projects with the events of the user of a project's number as the log of its function a, over all days that there are."""
    store = _graph(spark, d)
    log = table(spark, d, "events").where("user_id is not null").select(F.col("user_id").cast("string").alias("project"), F.lit("a").alias("function"), F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED").alias("status"), F.col("ts").cast("timestamp").alias("started"))
    f = fs.functions(store)[0].select("project", F.col("owner").alias("symbol"))
    metrics = production.metrics_of(f, log, F.lit("2100-01-01").cast("timestamp"), 365 * 200)
    return crosschecks.prod_truth(store, metrics.drop("last_run"), 30)


@query(_LOG + " SELECT project, symbol, CAST(runs AS BIGINT) AS runs, CAST(errors AS BIGINT) AS errors, heat, status FROM v")
def code_truth(spark: SparkSession, d: str) -> DataFrame:
    """Functions by their log: heat, and whether what runs is what the code exposes; a function without a run has none."""
    return _truth(spark, d)


@query(_LOG + " SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("confirmed_dead", "dispatched_dynamic", "cold_exposed", "errored", "live", "unknown")) + " FROM v")
def code_truth_counts(spark: SparkSession, d: str) -> DataFrame:
    return production.status_counts(_truth(spark, d))


@query(_C + """, o AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS web, bool_or(o_orderstatus = 'O') AS addon, bool_or(o_orderstatus = 'P') AS api FROM orders GROUP BY 1),
f AS (SELECT p, k, unnest(['a', 'b', 'idle_']) AS symbol FROM c UNION ALL SELECT p, k, 'doGet' FROM c WHERE k % 2 = 0 UNION ALL SELECT p, k, 'onEdit' FROM c WHERE k % 3 = 0)
SELECT p AS project, symbol, CASE WHEN web IS NULL THEN 'unknown' WHEN symbol = 'doGet' AND web THEN 'live_web_app' WHEN symbol = 'onEdit' AND addon THEN 'live_addon' WHEN symbol <> 'idle_' AND api THEN 'live_api' ELSE 'head_only' END AS status FROM f LEFT JOIN o ON o_custkey = k""")
def code_deployments(spark: SparkSession, d: str) -> DataFrame:
    """Functions by what serves them; orders are deployments, filled ones of a web app, open ones of an add-on, pending ones of an API."""
    kind = F.when(F.col("o_orderstatus") == "F", "WEB_APP").when(F.col("o_orderstatus") == "O", "ADD_ON").when(F.col("o_orderstatus") == "P", "EXECUTION_API")
    deployments = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("project"), kind.alias("type"), F.lit(1).alias("version"))
    return crosschecks.deployment_status(_graph(spark, d), deployments)


@query("""WITH m AS (SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY 1) SELECT o_orderkey AS deployment, o_orderdate < latest AS old FROM orders JOIN m USING (o_custkey) WHERE o_orderdate < latest AND o_orderstatus = 'O'""")
def served_versions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as deployments, their dates as versions: open ones have entry points, and those older than their customer's latest are told."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("deployment"), F.col("o_orderdate").alias("version"), F.when(F.col("o_orderstatus") == "O", F.array(F.lit("ADD_ON"))).otherwise(F.array().cast("array<string>")).alias("types"))
    return production.version_drift(o, o.select("project", "version")).select("deployment", (F.col("served") < F.col("latest")).alias("old"))


@query(_C + """ SELECT p AS project, CAST(3 + (CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS functions, CAST(1 AS BIGINT) AS private, CAST(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS web_entries, CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS simple_triggers,
CAST(CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS installable_triggers, CAST(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS client_functions, CAST(1 AS BIGINT) AS scriptlet_functions, CAST((CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS client_sites,
CAST(0 AS BIGINT) AS template_gaps, CAST(CASE WHEN seg = 'BUILDING' THEN 1 ELSE 0 END AS BIGINT) AS libraries FROM c""")
def code_map(spark: SparkSession, d: str) -> DataFrame:
    """One row a project: functions by visibility, entry points, triggers, client calls, libraries."""
    manifest = stored(fs.manifests(file(customers(spark, d), "appsscript.json", "manifest", manifest_of([("seg = 'BUILDING'", '{"userSymbol":"Lib","libraryId":"L1","version":"3"}')]))))
    out = rules.project_map(_graph(spark, d), manifest)
    return out.select("project", *[F.col(c).cast("long").alias(c) for c in out.columns if c != "project"])


@query(_C + """ SELECT p AS project, unnest(['a', 'b']) AS owner, CAST(0 AS BIGINT) AS uncertain, CAST(100 AS BIGINT) AS coverage_pct FROM c UNION ALL SELECT p, 'idle_', 1, 95 FROM c UNION ALL SELECT p, 'doGet', 0, 100 FROM c WHERE k % 2 = 0 UNION ALL SELECT p, 'onEdit', 0, 100 FROM c WHERE k % 3 = 0""")
def code_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Five points off a function for each place that can't be told."""
    return fs.coverage_by_function(_graph(spark, d)).select("project", "owner", "uncertain", "coverage_pct")


@query(_C + """ SELECT count(*) AS projects, 2 * count(*) AS files, CAST(0 AS BIGINT) AS problems, CAST(sum(3 + (k % 2 = 0)::INT + (k % 3 = 0)::INT) AS BIGINT) AS functions, CAST(sum(2 + (k % 5 = 0)::INT + (k % 3 = 0)::INT + (k % 7 = 0)::INT) AS BIGINT) AS edges,
CAST(sum(1 + (k % 5 = 0)::INT + (k % 7 = 0)::INT + (k % 2 = 0)::INT + (k % 3 = 0)::INT) AS BIGINT) AS exposures FROM c""")
def code_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row: projects, files, functions, calls of functions, exposures, problems."""
    return reports.store_counts(_graph(spark, d))


@query(_C + """ SELECT p AS project, 'C' || n AS provider, 'load' AS function, CAST(1 AS INTEGER) AS line FROM c WHERE seg = 'BUILDING' UNION ALL SELECT p, 'Core', 'load', 1 FROM c WHERE seg = 'MACHINERY'""")
def code_libraries(spark: SparkSession, d: str) -> DataFrame:
    """Calls of libraries that meet a public function of the project that provides them: one of the declared name, else one for the prefix."""
    c = customers(spark, d)
    code = F.when(F.expr("seg = 'BUILDING'"), F.concat(F.lit("function run() { C"), "n", F.lit(".load(1); C"), "n", F.lit(".hidden_(); C"), "n", F.lit(".gone(); }"))).when(F.expr("seg = 'MACHINERY'"), "function run() { Kern.load(1); Other.load(); }").otherwise("function run() { return 1; }")
    symbol = F.when(F.expr("seg = 'BUILDING'"), F.concat(F.lit("C"), "n")).when(F.expr("seg = 'MACHINERY'"), "Kern")
    manifest = F.concat(F.lit('{"dependencies":{"libraries":['), F.coalesce(F.concat(F.lit('{"userSymbol":"'), symbol, F.lit('","libraryId":"L","version":"1"}')), F.lit("")), F.lit("]}}"))
    own = table(spark, d, "nation").select(F.concat(F.lit("C"), "n_nationkey").alias("project")).unionByName(spark.createDataFrame([("Core",)], "project string"))
    library = own.select("project", F.lit("lib.gs").alias("file"), F.lit("gs").alias("kind"), F.lit("function load(id) { return id; }\nfunction hidden_() { return 1; }").alias("content"))
    files = file(c, "main.gs", "gs", code).unionByName(file(c, "appsscript.json", "manifest", manifest))
    store = fs.written(fs.facts(files.unionByName(library)))
    providers = spark.createDataFrame([("Kern", "prod", "Core")], "prefix string, env string, provider string")
    return crosschecks.library_edges(store, stored(fs.manifests(files)), providers).select("project", "provider", "function", "line")


@query(_C + """ SELECT 'app' || n AS app, 'e' || p AS env, true AS present, CASE WHEN seg = 'BUILDING' THEN 'HEAD' WHEN seg = 'AUTOMOBILE' THEN '11' END AS lib_version, CASE WHEN seg = 'BUILDING' THEN 'HEAD' WHEN seg = 'AUTOMOBILE' THEN 'pinned' ELSE 'none' END AS lib_mode,
CAST(3 + (k % 2 = 0)::INT + (k % 3 = 0)::INT AS BIGINT) AS functions, CAST(0 AS BIGINT) AS doc_pct, CASE WHEN k % 5 = 0 THEN 'BREAK' WHEN k % 7 = 0 THEN 'WARN' ELSE 'CLEAN' END AS verdict FROM c UNION ALL SELECT 'app' || n, 'later', false, NULL, 'none', NULL, NULL, 'CLEAN' FROM (SELECT DISTINCT n FROM c)""")
def park_overview(spark: SparkSession, d: str) -> DataFrame:
    """Nations as apps, customers as their environments: what is there, the library's version and mode, functions, documented ones, verdict."""
    c = customers(spark, d)
    manifest = stored(fs.manifests(file(c, "appsscript.json", "manifest", manifest_of([("seg = 'BUILDING'", '{"userSymbol":"Core","libraryId":"L1","version":"0"}'), ("seg = 'AUTOMOBILE'", '{"userSymbol":"Kern","libraryId":"L1","version":"11"}')]))))
    app = F.concat(F.lit("app"), "n")
    there = c.select(app.alias("app"), F.concat(F.lit("e"), "k").alias("env"), F.col("k").cast("string").alias("project"))
    targets = there.unionByName(c.select(app.alias("app")).distinct().select("app", F.lit("later").alias("env"), F.lit(None).cast("string").alias("project")))
    library = spark.createDataFrame([("Core", "L1", 11)], "user_symbol string, script_id string, prod_version int")
    at = F.concat_ws("::", app, F.lit("env"), F.concat(F.lit("e"), "k"))
    findings = c.where("k % 5 = 0").select(at.alias("symbol"), F.lit("break").alias("severity")).unionByName(c.where("k % 7 = 0").select(at.alias("symbol"), F.lit("warn").alias("severity")))
    return ws.overview(targets, _graph(spark, d), manifest, library, findings)


@query(_C + """, f AS (SELECT p, k, 3 + (k % 2 = 0)::INT + (k % 3 = 0)::INT AS n FROM c)
SELECT p AS project, CAST(floor((100 * n - 5) / n + 0.5) AS BIGINT) AS pct, 'high' AS confidence, CAST(1 AS BIGINT) AS uncertain, CAST(1 AS BIGINT) AS evals, CAST(0 AS BIGINT) AS not_sendable, '' AS names FROM f""")
def code_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Mean coverage of a project's functions, what can't be told in them, and the functions that return what no page can get."""
    out = reports.project_coverage(_graph(spark, d))
    return out.select("project", "pct", "confidence", "uncertain", F.col("eval").alias("evals"), "not_sendable", F.array_join("not_sendable_names", ",").alias("names"))


@query("""WITH a AS (SELECT o_custkey AS k, list_sort(list_distinct(list(o_orderpriority))) AS allow, min(o_orderstatus) AS mode FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, list_sort(list_distinct(list(o_orderpriority))) AS allow, min(o_orderstatus) AS mode FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, array_to_string(list_concat(coalesce(a.allow, []), list_filter(coalesce(b.allow, []), lambda x: NOT list_contains(coalesce(a.allow, []), x))), ',') AS allow, coalesce(a.mode, b.mode) AS mode FROM a FULL JOIN b ON a.k = b.k""")
def merged_lists(spark: SparkSession, d: str) -> DataFrame:
    """Priorities of a customer's filled orders as a list that exists, of the others as one that is generated: what is new comes after what is there."""
    o = table(spark, d, "orders")
    lists = lambda cond: o.where(cond).groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("allow"), F.min("o_orderstatus").alias("mode"))
    out = ws.merged_settings(lists("o_orderstatus = 'F'"), lists("o_orderstatus <> 'F'"), "k", ["allow"], ["mode"])
    return out.select("k", F.array_join("allow", ",").alias("allow"), "mode")


# ---- shapes, patterns, templates, keys, contracts


@query(_C + """ SELECT p AS project, 'r' AS owner, 'true' AS serializable, k % 2 = 1 AS nullable, 'x' AS fields FROM c UNION ALL SELECT p, 'o', CASE WHEN k % 3 = 0 THEN 'false' ELSE 'true' END, k % 3 = 1, '' FROM c UNION ALL SELECT p, 'w', 'true', false, 'a' FROM c""")
def code_returns(spark: SparkSession, d: str) -> DataFrame:
    """What functions return: whether a page can get it, whether it may be null, its fields."""
    own = F.when(F.expr("k % 3 = 0"), "function o() { return new Order(); }").when(F.expr("k % 3 = 1"), "function o() { return [1, undefined]; }").otherwise("function o() { return new Date(); }")
    code = F.concat_ws("\n", F.when(F.expr("k % 2 = 0"), "function r() { return {x: 1}; }").otherwise("function r(a) { return a ? {x: 1} : null; }"), own, F.lit("function w(k) { return {a: 1, ...k}; }"))
    return fs.view(fs.written(fs.facts(file(customers(spark, d), "main.gs", "gs", code))), "returns").select("project", "owner", "serializable", "nullable", F.array_join("fields", ",").alias("fields"))


@query(_C + """ SELECT p AS project, 'destructuring' AS fact, 'first' AS owner, CAST(2 AS INTEGER) AS line, 'pair' AS a, CAST(3 AS INTEGER) AS n FROM c WHERE k % 2 = 0 UNION ALL SELECT p, 'array2d', 'first', 3, 'data', 7 FROM c WHERE k % 3 = 0
UNION ALL SELECT p, 'uncertain', 'first', 4, 'dynamic_dispatch', NULL FROM c WHERE k % 5 = 0 UNION ALL SELECT p, 'webapp_html', 'third', 6, 'ALLOWALL', NULL FROM c WHERE k % 7 = 0 UNION ALL SELECT p, 'resource_open', NULL, 7, 'openById', NULL FROM c WHERE k % 11 = 0""")
def code_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns in bodies: destructuring, columns read, calls that can't be told, frames, resources that are opened."""
    code = rendered([
        ("true", "function first(x) {"), ("k % 2 = 0", "const [a, , y] = pair();"), ("k % 3 = 0", "const data = sheet.getRange(1, 1).getValues(); data.forEach(r => { log(r[0], r[7]); });"), ("k % 5 = 0", "handlers[name](x);"), ("true", "}"),
        ("k % 7 = 0", "function third() { return HtmlService.createHtmlOutput('a').setXFrameOptionsMode(HtmlService.XFrameOptionsMode.ALLOWALL); }"), ("k % 11 = 0", "SpreadsheetApp.openById('abcdefghijklmnopqrstuvwx');"),
    ])
    store = fs.written(fs.facts(file(customers(spark, d), "main.gs", "gs", code)))
    return store.where("fact in ('destructuring', 'array2d', 'uncertain', 'webapp_html', 'resource_open')").select("project", "fact", "owner", "line", "a", "n")


@query(_C + """ SELECT p AS project, 'page' AS template, CASE WHEN k % 2 = 0 THEN 'title,user' ELSE 'title' END AS set_fields, CASE WHEN k % 3 = 0 THEN 'extra,title' ELSE 'title' END AS read_fields, CASE WHEN k % 2 = 0 THEN 'user' ELSE '' END AS unread, CASE WHEN k % 3 = 0 THEN 'extra' ELSE '' END AS unset FROM c""")
def code_templates(spark: SparkSession, d: str) -> DataFrame:
    """Fields that scripts set for a template against those that its page reads."""
    c = customers(spark, d)
    code = F.concat(F.lit("function doGet() { const t = HtmlService.createTemplateFromFile('page'); t.data = {title: 'x'"), F.when(F.expr("k % 2 = 0"), ", user: 'y'").otherwise(""), F.lit("}; return t.evaluate(); }"))
    page = F.concat(F.lit("<p><?= data.title ?></p>"), F.when(F.expr("k % 3 = 0"), "<?= data.extra ?>").otherwise(""))
    told = fs.template_gaps(fs.written(fs.facts(file(c, "main.gs", "gs", code).unionByName(file(c, "page.html", "html", page)))))
    return told.select("project", "template", *[F.array_join(x, ",").alias(x) for x in ("set_fields", "read_fields", "unread", "unset")])


@query(_C + """ SELECT p AS project, 'script' AS store, 'LAST' AS key, CAST((k % 3 = 0)::INT AS BIGINT) AS reads, CAST((k % 2 = 0)::INT AS BIGINT) AS writes, CAST((k % 5 = 0)::INT AS BIGINT) AS deletes, CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN 'write_only' WHEN k % 3 = 0 AND k % 2 <> 0 THEN 'read_only' ELSE 'ok' END AS status FROM c WHERE k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0""")
def code_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of property stores that code reads, writes and deletes; keys that are no literals don't count."""
    at = "PropertiesService.getScriptProperties()"
    code = rendered([("k % 2 = 0", f"function a() {{ {at}.setProperty('LAST', 1); }}"), ("k % 3 = 0", f"function b() {{ return {at}.getProperty('LAST'); }}"), ("k % 5 = 0", f"function e() {{ {at}.deleteProperty('LAST'); }}"), ("true", f"function z(k) {{ return {at}.getProperty(k); }}")])
    return rules.property_keys(fs.written(fs.facts(file(customers(spark, d), "main.gs", "gs", code))))


_CONTRACT = [("k % 2 = 0", "/** A.\n * @param {Object} a\n * @param {Array<Order>} b\n * @returns {{id: string, at: Date}} it */"), ("true", "function load(a, b) { return a; }"), ("true", "function idle() {}")]


def _contract(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d)
    page = rendered([("true", "<script>"), ("k % 3 = 0", "google.script.run.withSuccessHandler(x => use(x.id, x.at)).load(1, 2);"), ("k % 3 = 1", "google.script.run.load(1, 2);"), ("true", "</script>")], "")
    return fs.written(fs.facts(file(c, "main.gs", "gs", rendered(_CONTRACT)).unionByName(file(c, "page.html", "html", page))))


@query(_C + """ SELECT p AS project, 'load' AS symbol, CASE WHEN k % 2 = 0 THEN 'load(a: object, b: Order[]): Promise<{ id: string; at: Date }>;' ELSE 'load(a: unknown, b: unknown): Promise<unknown>;' END AS line FROM c WHERE k % 3 < 2""")
def code_declarations(spark: SparkSession, d: str) -> DataFrame:
    """A declaration for each function that pages call, with documented types; names of own types stay."""
    return codegen.declarations(_contract(spark, d))


@query(_C + """ SELECT p AS project, 'load' AS symbol, unnest(['id', 'at']) AS field FROM c WHERE k % 3 = 0""")
def code_contracts(spark: SparkSession, d: str) -> DataFrame:
    """What a test of each contract asks for: fields that handlers read."""
    return codegen.contract_tests(_contract(spark, d))


@query(_C + """ SELECT p AS project, 'load' AS symbol, CASE WHEN k % 2 = 0 THEN 'load(a: Object, b: Array<Order>) -> {id: string, at: Date}' ELSE 'load(a, b)' END AS signature, CAST((k % 3 < 2)::INT AS BIGINT) AS callers_total, CASE WHEN k % 3 < 2 THEN 'client_call:1' ELSE '' END AS exposures,
CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'mixed' WHEN k % 3 = 0 THEN 'inferred_from_usage' WHEN k % 2 = 0 THEN 'from_documentation' ELSE 'unknown' END AS contract_source FROM c""")
def code_inspected(spark: SparkSession, d: str) -> DataFrame:
    """All that is known of one function, in each project that defines it."""
    told = inspect.inspect(_contract(spark, d), "load", parts=["all"])
    return told.select("project", "symbol", "signature", "callers_total", F.coalesce(F.array_join(F.transform("exposures", lambda x: F.concat_ws(":", x["type"], x["n_sites"])), ","), F.lit("")).alias("exposures"), "contract_source")


@query(_C + """ SELECT p AS project, 'main.gs' AS file, CASE WHEN k % 3 = 0 THEN 'changed' ELSE 'removed' END AS change FROM c WHERE k % 3 < 2 UNION ALL SELECT p, 'new.gs', 'added' FROM c WHERE k % 5 = 0""")
def code_changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files added, removed or changed since a scan, by digest; those with the same text are not told."""
    c = customers(spark, d)
    before = file(c, "main.gs", "gs", F.lit("function a() {}"))
    after = file(c.where("k % 3 <> 1"), "main.gs", "gs", F.when(F.expr("k % 3 = 0"), "function a() { b(); }").otherwise("function a() {}")).unionByName(file(c.where("k % 5 = 0"), "new.gs", "gs", F.lit("1")))
    return incremental.changed_files(fs.written(fs.facts(before)), after)


_LIBRARIES = _C + """, l AS (SELECT p, k, unnest(['L1', 'L2', 'L3']) AS symbol FROM c), n AS (SELECT p, symbol, CASE WHEN symbol = 'L1' AND k % 2 = 0 THEN 2 WHEN symbol = 'L2' AND k % 3 = 0 THEN 1 WHEN symbol = 'L3' THEN 1 ELSE 0 END AS n FROM l),
v AS (SELECT p AS project, symbol AS user_symbol, CASE WHEN n = 0 THEN 'declared_unused' WHEN symbol = 'L1' THEN 'external_resolved' WHEN symbol = 'L2' THEN 'external_unresolvable' ELSE 'external_unfetched' END AS status, CAST(n AS BIGINT) AS n_calls FROM n)"""


def _library_statuses(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d)
    code = rendered([("k % 2 = 0", "function a() { L1.go(1); L1.go(2); }"), ("k % 3 = 0", "function b() { L2.x(); }"), ("true", "function e() { L3.y(); }")])
    manifest = manifest_of([("true", f'{{"userSymbol":"L{i}","libraryId":"I{i}","version":"{i}"}}') for i in (1, 2, 3)])
    fetched = spark.createDataFrame([("I1", "1", [("m", "SERVER_JS", "function go() {}")], None), ("I2", "2", None, "no access"), ("I3", "9", [], None)], libraries.FETCHED)
    files = file(c, "main.gs", "gs", code).unionByName(file(c, "appsscript.json", "manifest", manifest))
    return libraries.statuses(fs.written(fs.facts(files)), stored(fs.manifests(files)), fetched)


@query(_LIBRARIES + " SELECT * FROM v")
def library_states(spark: SparkSession, d: str) -> DataFrame:
    """Where the code of each project's declared libraries is, and how often it is called."""
    return _library_statuses(spark, d).select("project", "user_symbol", "status", "n_calls")


@query(_LIBRARIES + " SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("local", "declared_unused", "external_resolved", "external_unresolvable", "external_unfetched")) + " FROM v")
def library_state_counts(spark: SparkSession, d: str) -> DataFrame:
    return libraries.status_counts(_library_statuses(spark, d))


@query("""WITH s AS (SELECT source AS project, doc_id % 3 AS version, doc_id, sha1(coalesce(text, '')) AS h FROM documents), v AS (SELECT DISTINCT project, version FROM s WHERE version > 0),
l AS (SELECT v.project, v.version, s.doc_id, s.h FROM v JOIN s ON s.project = v.project WHERE s.version = 0 OR s.version = v.version), r AS (SELECT project, version, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE h END AS h FROM s WHERE version > 0)
SELECT coalesce(l.project, r.project) AS project, CAST(coalesce(l.version, r.version) AS BIGINT) AS version, CAST(coalesce(l.doc_id, r.doc_id) AS VARCHAR) AS file, CASE WHEN r.doc_id IS NULL THEN 'only_local' ELSE 'modified' END AS change
FROM l FULL JOIN r ON l.project = r.project AND l.version = r.version AND l.doc_id = r.doc_id WHERE r.doc_id IS NULL OR l.h <> r.h""")
def served_content(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of the projects that are their sources; a third of them is in no served version, and a fifth of the served ones differs."""
    s = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("project"), (F.col("doc_id") % 3).alias("version"), F.col("doc_id").cast("string").alias("file"), F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("sha1"), "doc_id")
    versions = s.where("version > 0").select("project", "version").distinct()
    remote = s.where("version > 0").select("project", "version", "file", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("sha1")).alias("sha1"))
    out = []
    for v in (1, 2):  # local files of a version: those that are in none, and its own
        local = s.where(f"version in (0, {v})").select("project", "file", "sha1")
        out.append(production.content_drift(local, remote, versions.where(f"version = {v}")))
    return out[0].unionByName(out[1])
