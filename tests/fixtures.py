"""Small projects that show what the parser and the rules find; the driver's tables hold no scripts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

FILES = "project string, file string, kind string, content string"

SHOP = """/**
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
const half = (n) => split(n)[0] / 2;
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
function clean_() { CacheService.getUserCache().remove('TMP'); lost(1); parseInt('1'); }
function onEdit(e) { return weekly(); }
ScriptApp.newTrigger('weekly').timeBased().everyDays(1).create();
"""

SHOP_PAGE = """<base target="_top"><h1><?= data.title ?></h1><p><?= data.user ?><?= data.extra ?></p><?!= half(3) ?>
<script>
function show(o) { alert(o.total + o.tax); }
google.script.run.withSuccessHandler(show).withFailureHandler(fail).getOrder('1', 3);
google.script.run.withSuccessHandler(x => x.length).weekly();
</script>"""

MANIFEST = {"timeZone": "UTC", "dependencies": {"libraries": [{"userSymbol": "Core", "libraryId": "L1", "version": "12"}]}}

#: Edits of SHOP by name: (old, new) in the script, (old, new) in the page or None.
EDITS = {
    "lost field": ([("@returns {{total: number, tax: number}}", "@returns {{total: number}}")], None),
    "more fields": ([("@returns {{total: number, tax: number}}", "@returns {{total: number, tax: number, net: number}}")], None),
    "rename": ([("function split(", "function cut(")], None),
    "lost parameter": ([("getOrder(id, rate)", "getOrder(id)")], None),
    "more parameters": ([("function split(x)", "function split(x, y)")], None),
    "other order": ([("getOrder(id, rate)", "getOrder(rate, id)")], None),
    "lost template field": ([("title: 'x', user", "user")], None),
    "more template fields": ([("title: 'x', user", "title: 'x', sub: 1, user")], None),
    "class instance": ([("return {total", "if (a) return new Order(); return {total")], None),
    "null": ([("return {total", "if (!a) return null; return {total")], None),
    "wider": ([("r[3] > 0", "r[5] > 0")], None),
    "narrower": ([("r[3] > 0", "r[1] > 0")], None),
    "unread key": ([("getProperty('LAST')", "getProperty(k)")], None),
    "unwritten key": ([("setProperty('LAST', o.total)", "setProperty(k, o.total)")], None),
    "gone": ([("function onEdit(e) { return weekly(); }\n", "")], None),
    "come": ([("function split(", "function fresh(q) { return q; }\nfunction split(")], None),
    "same": ([], None),
}

PATTERNS = """/** @OnlyCurrentDoc */
function first() {
  const data = sheet.getRange(1, 1).getValues();
  data.forEach(r => { log(r[0], r[7]); });
  const [x, , y] = pair();
  const lock = LockService.getScriptLock();
  lock.waitLock(100);
  eval('1');
  handlers[name](x);
}
function second(list) {
  const lock = LockService.getScriptLock();
  try { lock.tryLock(10); } finally { lock.releaseLock(); }
  for (const item of list) { sheet.getRange(1, 1).setValue(item); }
  while (more()) UrlFetchApp.fetch(next());
  list.map(u => UrlFetchApp.fetch(u));
  for (const t of ScriptApp.getProjectTriggers()) ScriptApp.deleteTrigger(t);
}
function third() { return HtmlService.createHtmlOutput('a').setXFrameOptionsMode(HtmlService.XFrameOptionsMode.ALLOWALL); }
const make = function (n) { return new Function('return ' + n); };
SpreadsheetApp.openById('abcdefghijklmnopqrstuvwx');
"""

RETURNS = """function none() { log(1); }
function nothing() { return; }
function date() { return new Date(); }
function order() { return new Order(); }
function either(a) { return a ? {x: 1} : null; }
const arrow = () => ({p: 1, q: [1, 2]});
function nested() { return {f: function () { return 1; }}; }
function open(k) { return {a: 1, ...k}; }
function list() { return [1, undefined]; }
"""

PAGE = """<img src="http://a.example/x.png"><script src="https://b.example/y.js"></script><a href="/in">in</a><a href="#top">top</a><a href="/out" target="_blank">out</a>
<form onsubmit="return false"></form><form id="f"></form>
<script>
fetch('http://c.example/data');
google.script.run.withSuccessHandler(function (r) { use(r.name, r.size); }).withFailureHandler(oops).load(1, 'b');
google.script.run.save(values);
</script>
<? for (var i = 0; i < rows(); i++) { ?><?= data.label ?><? } ?>"""

RULES = """function f() { Foo.bar(); Sheets.get(); UrlFetchApp.fetch('http://other/'); UrlFetchApp.fetch('https://api.example.com/v1'); GmailApp.sendEmail('a'); Math.max(1); }
function g(list) { for (const x of list) { sheet.getRange(1, 1).setValue(x); } list.forEach(u => UrlFetchApp.fetch(u)); }
function h() { const l = LockService.getScriptLock(); l.waitLock(10); ScriptApp.newTrigger('f').timeBased().create(); }
function i() { const l = LockService.getScriptLock(); try { l.tryLock(10); } finally { l.releaseLock(); } MailApp.sendEmail('b'); }
function doGet() { return HtmlService.createHtmlOutput('x'); }
/** @OnlyCurrentDoc */
"""
RULES_PAGE = '<a href="x">y</a><img src="http://z/q"><form></form><script>fetch("http://w/");google.script.run.f();google.script.run.f();google.script.run.g(1)</script>'
AUTH = "https://www.googleapis.com/auth/"
RULES_MANIFEST = {
    "dependencies": {"libraries": [{"userSymbol": "Core", "libraryId": "L1", "version": "12"}], "enabledAdvancedServices": [{"userSymbol": "Drive", "serviceId": "drive", "version": "v2"}]},
    "oauthScopes": [AUTH + "spreadsheets", AUTH + "script.scriptapp", AUTH + "documents", "https://mail.google.com/"],
    "urlFetchWhitelist": ["https://api.example.com/"],
}

DOCS = """/** Adds. @see missing
 * @param {number} q
 * @see gone
 * @returns {object} has `sum` and `Type` and `lost` */
function add(a) { return {sum: a}; }
function bare() {}
/** Links {@link add} and {@link JSON}. */
function linked() {}
"""

CHAINS = """function f() {
  SpreadsheetApp.getActive().getSheetByName('a').getRnge(1);
  SpreadsheetApp.getActive().getSheetByName();
  UserProperties.getProperty('a').trim();
  SpreadsheetApp.getActive().getSheetByName('a').getRange(1).setValue(2);
  Unknown.call().more();
}
"""

LIBRARY = "function load(id) { return id; }\nfunction hidden_() { return 1; }\n"
CONSUMER = "function run() { Core.load(1); Core.hidden_(); Core.gone(); Other.load(); }\n"


def rows(project: str, code: str | None = None, page: str | None = None, manifest: dict | str | None = None) -> list[tuple]:
    text = manifest if isinstance(manifest, str) else json.dumps(manifest)
    return [(project, f, k, c) for f, k, c in (("main.gs", "gs", code), ("page.html", "html", page), ("appsscript.json", "manifest", None if manifest is None else text)) if c is not None]


def files(spark: SparkSession, *projects: list[tuple]) -> DataFrame:
    return spark.createDataFrame([r for p in projects for r in p], FILES).coalesce(1)


def edited(name: str) -> list[tuple]:
    code, page = SHOP, SHOP_PAGE
    script, html = EDITS[name]
    for old, new in script:
        code = code.replace(old, new)
    return rows(name, code, page.replace(*html) if html else page, MANIFEST)
