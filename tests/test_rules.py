"""The fact store and its rules on two small projects, before and after edits."""

import json

import pytest

from quillspan.functions.extract import facts_of, type_fields
from quillspan.functions.script import parse
from quillspan.operators import facts as fs
from quillspan.plans import rules

CODE = """/**
 * Totals of one order.
 * @param {string} id the order
 * @param {number} rate
 * @returns {{total: number, tax: number}} gives `total` and `tax`
 */
function getOrder(id, rate) {
  const rows = SpreadsheetApp.getActive().getSheetByName('orders').getValues();
  const found = rows.filter(r => r[0] === id && r[3] > 0);
  const [a, b] = split(found);
  return {total: a, tax: b * rate};
}
function split(x) { return [x.length, 1]; }
function weekly() {
  const o = getOrder('x', 2);
  PropertiesService.getScriptProperties().setProperty('LAST', o.total);
  return PropertiesService.getScriptProperties().getProperty('LAST');
}
function doGet() {
  const t = HtmlService.createTemplateFromFile('page');
  t.data = {title: 'x', user: 'y'};
  return t.evaluate();
}
function setup() { ScriptApp.newTrigger('weekly').timeBased().everyDays(1).create(); }
"""
PAGE = """<base target="_top"><h1><?= data.title ?></h1><p><?= data.user ?></p>
<script>
function show(o) { alert(o.total + o.tax); }
google.script.run.withSuccessHandler(show).withFailureHandler(fail).getOrder('1', 3);
</script>"""
MANIFEST = {"dependencies": {"libraries": [{"userSymbol": "Core", "libraryId": "L1", "version": "12"}]}, "oauthScopes": [rules.AUTH + "spreadsheets", rules.AUTH + "script.scriptapp"], "urlFetchWhitelist": ["https://api.example.com/"]}


def files(spark, code=CODE, page=PAGE, manifest=MANIFEST, project="shop"):
    rows = [(project, "main.gs", "gs", code), (project, "page.html", "html", page), (project, "appsscript.json", "manifest", json.dumps(manifest)), (project, "none.gs", "gs", None)]
    return spark.createDataFrame(rows, "project string, file string, kind string, content string")


@pytest.fixture(scope="module")
def base(spark):
    store = fs.facts(files(spark)).cache()
    store.count()
    return store


def kinds(df):
    return sorted((r.kind, r.severity, r.symbol) for r in df.collect())


EDITS = [
    ("lost field", [("@returns {{total: number, tax: number}}", "@returns {{total: number}}")], None, ("client_call.success_handler", "break", "getOrder")),
    ("rename", [("function split(", "function cut(")], None, ("internal_caller", "break", "split")),
    ("lost parameter", [("getOrder(id, rate)", "getOrder(id)")], None, ("client_call.invocation", "break", "getOrder")),
    ("other order", [("getOrder(id, rate)", "getOrder(rate, id)")], None, ("internal_caller", "break", "getOrder")),
    ("lost template field", [("title: 'x', user", "user")], None, ("template_scriptlet_reader", "break", "page")),
    ("class instance", [("return {total", "if (a) return new Order(); return {total")], None, ("client_call.invocation", "break", "getOrder")),
    ("null", [("return {total", "if (!a) return null; return {total")], None, ("internal_caller", "warn", "getOrder")),
    ("wider", [("r[3] > 0", "r[5] > 0")], None, ("array2d_consumer", "break", "getOrder")),
    ("unread key", [("getProperty('LAST')", "getProperty(k)")], None, ("property_key_writer", "warn", "LAST")),
    ("gone", [("function setup() { ScriptApp.newTrigger('weekly').timeBased().everyDays(1).create(); }\n", "")], None, ("internal_caller", "warn", "setup")),
    ("unset field", [], ("data.user", "data.extra"), ("template_scriptlet_reader", "warn", "page")),
]


@pytest.fixture(scope="module")
def edited(spark):
    """Findings by edit: every edit is a project of its own, all compared in one job."""
    from functools import reduce

    union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
    before, after = [], []
    for name, edits, page, _ in EDITS:
        code = CODE
        for old, new in edits:
            assert old in code
            code = code.replace(old, new)
        before.append(files(spark, project=name))
        after.append(files(spark, code, PAGE.replace(*page) if page else PAGE, project=name))
    found = {}
    for r in rules.diff(fs.facts(union(before).coalesce(2)), fs.facts(union(after).coalesce(2)), fs.manifests(union(after))).collect():
        found.setdefault(r.project, set()).add((r.kind, r.severity, r.symbol))
    return found


@pytest.mark.parametrize("name,want", [(e[0], e[3]) for e in EDITS], ids=[e[0] for e in EDITS])
def test_diff_finds_the_edit(edited, name, want):
    assert want in edited[name]


def test_nothing_changed_and_an_added_helper_are_clean(spark, base):
    assert kinds(rules.diff(base, base, fs.manifests(files(spark)))) == []
    assert kinds(rules.diff(base, fs.facts(files(spark, CODE + "\nfunction helper() {}")), fs.manifests(files(spark)))) == []


def test_changes_and_calls(spark, base):
    after = fs.facts(files(spark, CODE.replace("function split(", "function cut(") + "function more() {}"))
    got = {(r.change, r.symbol, r.detail) for r in rules.changes(base, after).collect()}
    assert got == {("function_renamed", "split", "cut"), ("function_added", "more", None)}
    callers = {r.symbol: r.n_callers for r in fs.called_by(base).collect()}
    assert callers == {"getOrder": 2, "split": 1, "weekly": 1}
    assert {(r.symbol, r.type) for r in fs.exposures(base).collect()} == {("doGet", "entry_point_web"), ("getOrder", "client_call"), ("weekly", "installable_trigger")}
    assert {r.resolution for r in fs.resolved_calls(base, fs.manifests(files(spark))).where("receiver is null").collect()} == {"function"}


def test_impact(base):
    assert kinds(rules.impact(base, "shop", "getOrder", "remove-param:rate")) == [("client_call.invocation", "break", "getOrder"), ("internal_caller", "break", "getOrder")]
    assert kinds(rules.impact(base, "shop", "getOrder", "change-return-shape:-tax,+net")) == [("client_call.success_handler", "break", "getOrder")]
    assert kinds(rules.impact(base, "shop", "weekly", "rename:daily")) == [("installable_trigger", "break", "weekly")]
    assert kinds(rules.impact(base, "shop", "doGet", "rename:x")) == [("entry_point_web", "break", "doGet")]
    assert kinds(rules.impact(base, "shop", "getOrder", "rename-param:id=key")) == [("internal_caller", "warn", "getOrder")]
    with pytest.raises(ValueError):
        rules.parse_change("rename-param:a")


def test_manifest_runtime_webapp_rules(spark):
    code = """function f() { Foo.bar(); Sheets.get(); UrlFetchApp.fetch('http://other/'); GmailApp.sendEmail('a'); MathX.a(); Math.max(1); }
function g(list) { for (const x of list) { sheet.getRange(1, 1).setValue(x); } list.forEach(u => UrlFetchApp.fetch(u)); }
function h() { const l = LockService.getScriptLock(); l.waitLock(10); ScriptApp.newTrigger('f').timeBased().create(); }
function i() { const l = LockService.getScriptLock(); try { l.tryLock(10); } finally { l.releaseLock(); } }
function doGet() { return HtmlService.createHtmlOutput('x'); }"""
    page = '<a href="x">y</a><img src="http://z/q"><form></form><script>fetch("http://w/");google.script.run.f();google.script.run.f();google.script.run.g(1)</script>'
    f = files(spark, code, page)
    store, m = fs.facts(f), fs.manifests(f)
    got = {(k, s, x) for k, s, x in kinds(rules.manifest_rules(store, m))}
    assert {("manifest.library", "break", "Foo"), ("manifest.library", "break", "MathX"), ("manifest.advanced_service", "break", "Sheets"), ("manifest.library", "info", "Core"), ("manifest.scope", "warn", "GmailApp"), ("manifest.scope", "warn", "UrlFetchApp"), ("manifest.scope", "info", rules.AUTH + "spreadsheets"), ("manifest.urlfetch_whitelist", "warn", "http://other/")} == got
    assert kinds(rules.runtime_rules(store, m)) == [("lint.library_chatty_ui", "info", "<project>"), ("lint.lock_no_finally", "warn", "h"), ("lint.quota_in_loop", "warn", "g"), ("lint.trigger_orphan", "info", "h"), ("lint.urlfetch_in_loop", "warn", "g")]
    assert [k for k, _, _ in kinds(rules.webapp_rules(store))] == ["webapp.form_submit", "webapp.link_target", "webapp.mixed_content", "webapp.mixed_content", "webapp.xframe_missing"]
    assert {r.severity for r in rules.webapp_rules(store, True).where("kind = 'webapp.xframe_missing'").collect()} == {"warn"}
    row = rules.project_map(store, m).collect()[0]
    assert (row.functions, row.private, row.web_entries, row.client_functions, row.client_sites, row.libraries) == (5, 0, 1, 2, 3, 1)


def test_doc_rules(spark):
    code = "/** Adds. @see missing\n * @param {number} q\n * @see gone\n * @returns {object} has `sum` and `Type` and `lost` */\nfunction add(a) { return {sum: a}; }\nfunction bare() {}"
    assert kinds(rules.doc_rules(fs.facts(files(spark, code, "")))) == [("doc.param_drift", "warn", "add"), ("doc.return_drift", "warn", "add"), ("doc.stale_ref", "info", "add"), ("doc.undocumented", "info", "bare")]


def test_api_rules(spark):
    registry = [("SpreadsheetApp", "getActive", "Spreadsheet", 0, None), ("Spreadsheet", "getSheetByName", "Sheet", 1, None), ("Sheet", "getRange", "Range", 1, None), ("Sheet", "getRangeList", "RangeList", 1, None), ("Range", "setValue", "Range", 1, None), ("UserProperties", "getProperty", "String", 1, None), ("UserProperties", "*", None, 0, "use PropertiesService")]
    code = "function f() { SpreadsheetApp.getActive().getSheetByName('a').getRnge(1); SpreadsheetApp.getActive().getSheetByName(); UserProperties.getProperty('a').trim(); SpreadsheetApp.getActive().getSheetByName('a').getRange(1).setValue(2); other.x(); }"
    rows = rules.api_rules(fs.facts(files(spark, code, "")), registry).collect()
    assert sorted((r.kind, r.severity, r.symbol) for r in rows) == [("api.deprecated", "warn", "UserProperties.getProperty"), ("api.unknown_method", "break", "Sheet.getRnge"), ("api.wrong_arity", "break", "Spreadsheet.getSheetByName")]
    assert next(r.reason for r in rows if r.kind == "api.unknown_method").endswith("near: getRange, getRangeList")


def test_api_suggestions_in_lower_case_and_by_prefix(spark):
    registry = [("SpreadsheetApp", m, "Spreadsheet", 0, None) for m in ("GETACTIVEXYZ", "getActiveSpreadsheetOfTheWholeProject", "myGETACTIVExyzs", "openById", "create")]
    store = fs.facts(files(spark, "function f() { SpreadsheetApp.getactivexyz(); SpreadsheetApp.open2(); SpreadsheetApp.q(); }", ""))
    near = {r.symbol.split(".")[-1]: r.reason.split("near: ")[-1].strip() for r in rules.api_rules(store, registry).collect()}
    assert near == {"getactivexyz": "GETACTIVEXYZ, myGETACTIVExyzs, getActiveSpreadsheetOfTheWholeProject", "open2": "openById", "q": ""}


def test_environment_rules(spark):
    prod, dev, other = "P" * 24, "D" * 24, "Z" * 24
    f = files(spark, f"const A = '{dev}', B = '{prod}';\nfunction f() {{ DriveApp.getFileById('{other}'); }}", "", MANIFEST, "core/prod")
    targets = spark.createDataFrame([("core/prod", "core", "prod")], "project string, app string, env string")
    library = spark.createDataFrame([("Core", "L1", 11)], "user_symbol string, script_id string, prod_version int")
    resources = spark.createDataFrame([("prod", "sheet", prod), ("dev", "sheet", dev), ("dev", "log", dev)], "env string, name string, id string")
    found = rules.environment_rules(fs.facts(f), fs.manifests(f), targets, library, resources, f).collect()
    at = "core::env::prod"  # findings of a project are told under its app and environment, so that they can be attributed
    told = sorted((r.kind, r.severity, r.symbol, r.reason.split(": ")[-1]) for r in found if r.kind != "env.library_version_mismatch")
    assert told == [("env.cross_env_leak", "break", at, dev), ("env.hardcoded_resource", "warn", at, prod), ("env.hardcoded_resource", "warn", at, other), ("env.undeclared_resource", "warn", "env::prod", "log")]
    assert [(r.severity, r.symbol) for r in found if r.kind == "env.library_version_mismatch"] == [("break", at)]


def test_projects_of_a_tree(spark, tmp_path):
    from quillspan.sources.tables import source_files

    for path, text in [("a/appsscript.json", "{}"), ("a/x.gs", "function x() {}"), ("a/sub/appsscript.json", "{bad"), ("a/sub/y.gs", "1"), ("z.gs", "1"), ("a/node_modules/q.gs", "")]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = fs.with_projects(source_files(spark, str(tmp_path)), str(tmp_path))
    assert {(r.project, r.file) for r in got.collect()} == {("a", "appsscript.json"), ("a", "x.gs"), ("a", "sub/appsscript.json"), ("a", "sub/y.gs"), ("", "z.gs")}
    assert {(r.project, r.present) for r in fs.manifests(got).select("project", "present").collect()} == {("a", True), ("a", False)}


def test_parser_recovers_and_handles_odd_inputs():
    tree, errors = parse("let x = = 1;\nfunction ok() { return a / b / c; }\nvar r = /[/]'/g.test(s) ? `${`a${1}`}` : (a, b) => ({c: 1})\n")
    assert len(errors) == 1 and [n.kind for n in tree.body] == ["function", "declaration"]
    assert parse("")[0].body == [] and list(facts_of("gs", None)) == [] and list(facts_of(None, "x")) == []
    assert parse("(" * 5000)[1]
    assert type_fields("{a: {b: T, c: T}, d?: U}") == ["a", "d"] and type_fields("Object") is None


def test_empty_store(spark):
    f = files(spark).limit(0)
    assert rules.check(fs.facts(f), fs.facts(f), fs.manifests(f)).count() == 0


def test_snapshots_need_only_their_facts(spark):
    """Stores of the facts that changes() and diff() name give what whole stores give; a colliding definition doesn't count for the first."""
    before = files(spark, CODE + "\nfunction split(x) { return 2; }")
    after = files(spark, CODE.replace("function split(", "function cut(").replace("getOrder(id, rate)", "getOrder(id)") + "\nfunction cut(x, y) { return 2; }")
    for rule, only in ((rules.changes, rules.CHANGED), (rules.diff, rules.DIFFED)):
        whole, some = ([sorted(map(str, rule(fs.facts(before, names), fs.facts(after, names)).collect()))][0] for names in (None, only))
        assert whole == some != []
    assert {r.fact for r in fs.facts(before, rules.CHANGED).select("fact").distinct().collect()} <= set(rules.CHANGED)


def joins(df):
    return sum(line.lstrip(" :+-").startswith("Join ") for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_changes_join_only_renames(spark, base):
    """Snapshots are compared in groupings: only functions that went or came are joined, with renames; a join for each kind of change broadcast or sorted each side."""
    assert joins(rules.changes(base, base)) <= 2


def test_diff_joins_places_once(spark, base):
    """Places that name functions, fields that handlers read and fields that pages read meet what changed in a join each, besides renames and the joins that make the reads of handlers."""
    assert joins(rules.diff(base, base)) <= 4 + joins(fs.field_reads(base))
