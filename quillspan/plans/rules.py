"""Rules over the fact store. Each gives findings: (project, kind, severity, file, line, symbol, reason)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators import facts as fs
from quillspan.operators.patterns import by_owner, containing
from quillspan.operators.relations import key_state, key_status, pair_one_to_one
from quillspan.plans.crosschecks import library_calls, library_edges
from quillspan.sources.shared import stored

# What the script host's manifest knows.
ADVANCED = """AdminDirectory AdminGroupsMigration AdminGroupsSettings AdminLicenseManager AdminReports AdminReseller Analytics AnalyticsReporting AppsActivity
BigQuery Calendar Classroom Civicinfo Docs Drive DriveActivity DoubleClickBid DoubleClickCampaigns Fitness Forms Gmail GroupsSettings Indexing Mirror People
PeopleAPI PlayDeveloperReporting ReCaptcha Search Sheets Slides StackdriverErrorReporting TagManager Tasks YouTube YouTubeAnalytics YouTubeContentID""".split()
NOT_LIBRARIES = "Object Array String Number Boolean Date Math JSON RegExp Error TypeError RangeError Promise Symbol Map Set WeakMap WeakSet Reflect Proxy".split()
AUTH = "https://www.googleapis.com/auth/"
MAIL = "https://mail.google.com/"
BROAD_MAIL = [MAIL, *(f"{AUTH}gmail.{x}" for x in ("modify", "compose", "send", "readonly"))]
#: Scopes that each service accepts, the usual one first.
SCOPES = {
    "GmailApp": BROAD_MAIL,
    "MailApp": [f"{AUTH}script.send_mail", MAIL],
    "DriveApp": [f"{AUTH}drive", f"{AUTH}drive.file", f"{AUTH}drive.readonly"],
    "SpreadsheetApp": [f"{AUTH}spreadsheets", f"{AUTH}spreadsheets.currentonly"],
    "DocumentApp": [f"{AUTH}documents", f"{AUTH}documents.currentonly"],
    "FormApp": [f"{AUTH}forms", f"{AUTH}forms.currentonly"],
    "SlidesApp": [f"{AUTH}presentations", f"{AUTH}presentations.currentonly"],
    "CalendarApp": [f"{AUTH}calendar", f"{AUTH}calendar.readonly"],
    "ContactsApp": [f"{AUTH}contacts", f"{AUTH}contacts.readonly"],
    "UrlFetchApp": [f"{AUTH}script.external_request"],
    "ScriptApp": [f"{AUTH}script.scriptapp"],
    "Session": [f"{AUTH}userinfo.email", f"{AUTH}userinfo.profile"],
}
CURRENT_ONLY = {"SpreadsheetApp": "spreadsheets", "DocumentApp": "documents", "FormApp": "forms", "SlidesApp": "presentations"}
#: Words in back quotes that are no field names: an own choice, values and types.
DOC_WORDS = "null undefined true false void this self it string number boolean object array value result".split()
# Globals of scripts.
DOC_GLOBALS = "Math JSON Object Array String Number Boolean Date Promise RegExp Error Map Set WeakMap WeakSet Symbol console parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent google".split()
CHATTY_SITES = 3


def found(df: DataFrame, kind: str | Column, severity: str | Column, symbol, reason: Column) -> DataFrame:
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return df.select("project", lit(kind).alias("kind"), lit(severity).alias("severity"), "file", F.col("line").cast("int").alias("line"), F.col(symbol).alias("symbol") if isinstance(symbol, str) else symbol.alias("symbol"), reason.alias("reason"))


def both(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def say(*parts) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("?")) if isinstance(p, Column) else F.lit(p) for p in parts])


# ---- two snapshots


def met(before: DataFrame, after: DataFrame, fact: str, keys: list[str], *columns: str) -> DataFrame:
    """(keys, x, y) of a fact in two snapshots: the first row of a key by place, before and after, null where there is none.

    Both snapshots are read into one grouping, so no join has to hold either side, on a task or, broadcast, on the driver.
    """
    side = lambda store, later: fs.view(store, fact).select(*keys, F.lit(later).alias("_later"), F.struct("file", "line", "col", *columns).alias("_v"))
    first = lambda later: F.min(F.when(F.col("_later") == later, F.col("_v")))
    return side(before, False).unionByName(side(after, True)).repartition(*keys).groupBy(*keys).agg(first(False).alias("x"), first(True).alias("y"))


def renames(functions: DataFrame) -> DataFrame:
    """(project, old, new) of two snapshots' functions as of met(): those gone and come with the same body, paired one to one within a project."""
    side = lambda gone, v: functions.where(f"{gone} is null").select(F.concat_ws("::", "project", f"{v}.fingerprint").alias("_k"), "owner")
    pairs = pair_one_to_one(side("y", "x"), side("x", "y"), "_k", "owner")
    return pairs.select(F.expr("substr(_k, 1, length(_k) - 18)").alias("project"), "old", "new")


def _functions(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions that went, came or have other parameters, as of met(), and renames; each is read by several branches, so it is made once."""
    f = stored(met(before, after, "function", ["project", "owner"], "params", "fingerprint").where("x is null or y is null or x.params <> y.params"))
    return f, stored(renames(f))


#: The facts that changes() reads, and diff(); "file" is for incremental scans.
CHANGED = ("file", "function", "doc", "returns", "template", "scriptlet_read", "property", "array2d")
DIFFED = (*CHANGED, "call", "client_call", "scriptlet_call", "trigger", "handler", "handler_read")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project, change, symbol, detail): every change between two snapshots, harmful or not."""
    at = ["project", "owner"]
    f, r = _functions(before, after)
    row = lambda df, change, detail: df.select("project", F.lit(change).alias("change"), F.col("owner").alias("symbol"), detail.cast("string").alias("detail"))
    gone = f.where("y is null").join(r.select("project", F.col("old").alias("owner")), at, "left_anti")
    come = f.where("x is null").join(r.select("project", F.col("new").alias("owner")), at, "left_anti")
    p, d = _params(f), _shapes(before, after)
    t, k, c = _templates(before, after).withColumn("owner", F.col("template")), _keys(before, after), _columns(before, after)
    # several changes of a row are told in one pass over it
    case = lambda change, detail: F.struct(F.lit(change).alias("change"), detail.cast("string").alias("detail"))
    told = lambda df, cases: df.withColumn("_c", F.explode(cases)).select("project", "_c.change", F.col("owner").alias("symbol"), "_c.detail")
    some = lambda df, *cases: told(df, F.array_compact(F.array(*[F.when(F.expr(cond), case(change, detail)) for cond, change, detail in cases])))
    less = lambda x, y, change: F.transform(F.array_except(x, y), lambda v: case(change, v))
    each = lambda df, of, change: told(df, F.concat(less(f"x_{of}", f"y_{of}", f"{change}removed"), less(f"y_{of}", f"x_{of}", f"{change}added")))
    null = F.lit(None)
    return both(
        row(gone, "function_removed", null), row(come, "function_added", null), r.select("project", F.lit("function_renamed").alias("change"), F.col("old").alias("symbol"), F.col("new").alias("detail")),
        each(d, "fields", "return.field_"), each(p, "params", "param."), row(p.where(REORDERED), "param.reordered", F.array_join("y_params", ",")),
        some(c, ("size(array_except(x_indices, y_indices)) + size(array_except(y_indices, x_indices)) > 0", "array.column_indices_changed", F.col("variable")), ("y_max_index > x_max_index", "array.max_index_grew", F.col("variable"))),
        each(t, "set", "template.binding_field_"),
        some(_returns(before, after), (BROKE, "serializable.broke", null), (NULL_NOW, "return.nullability_changed", null)),
        k.select("project", F.concat(F.lit("property_key."), F.col("status")).alias("change"), F.col("key").alias("symbol"), F.col("store").alias("detail")),
    )


REORDERED = "x_params <> y_params and array_sort(x_params) = array_sort(y_params)"
BROKE = "x_serializable = 'true' and y_serializable = 'false'"
NULL_NOW = "not x_nullable and y_nullable"


def _params(f):
    return f.where("x is not null and y is not null").select("project", "owner", F.col("x.params").alias("x_params"), F.col("y.params").alias("y_params"))


def _changed(before, after, fact, keys, where, *columns):
    """Rows of a fact that both snapshots have by key and for which `where` holds, with columns as x_ (before) and y_ (after), and the later place."""
    m = met(before, after, fact, keys, *columns).where("x is not null and y is not null")
    for k in keys:
        m = m.where(F.col(k).isNotNull())
    return m.select(*keys, "y.file", "y.line", *[F.col(f"{v}.{c}").alias(f"{v}_{c}") for c in columns for v in "xy"]).where(where)


def _shapes(before, after):
    fields = lambda v: F.split(f"{v}_returns_fields", ",").alias(f"{v}_fields")
    return _changed(before, after, "doc", ["project", "owner"], "x_returns_fields <> y_returns_fields", "returns_fields").select("project", "owner", fields("x"), fields("y"))


def _returns(before, after):
    return _changed(before, after, "returns", ["project", "owner"], f"{BROKE} or {NULL_NOW}", "serializable", "nullable")


def _templates(before, after):
    """(project, template, x_set, y_set, unset): fields that scripts set before and after, and those that the later page reads and nothing sets."""
    s = lambda store, kind: fs.view(store, "template").select("project", "template", F.lit(kind).alias("_kind"), "fields")
    reads = fs.view(after, "scriptlet_read").select("project", F.regexp_replace("file", r"\.html?$", "").alias("template"), F.lit("read").alias("_kind"), F.array("field").alias("fields"))
    fields = lambda kind: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("_kind") == kind, F.col("fields"))))))
    some = lambda kind: F.bool_or(F.col("_kind") == kind)
    told = both(s(before, "x"), s(after, "y"), reads).where("template is not null").groupBy("project", "template").agg(fields("x").alias("x_set"), fields("y").alias("y_set"), fields("read").alias("_read"), some("x").alias("_x"), some("y").alias("_y"))
    return told.where("_x and _y").select("project", "template", "x_set", "y_set", F.array_except("_read", "y_set").alias("unset"))


def property_keys(store: DataFrame) -> DataFrame:
    return key_status(fs.view(store, "property"), ["project", "store", "key"], "op", "read", "write", "delete")


def _keys(before, after):
    """Keys that were read and written, and now are one of the two only, at the first such place."""
    side = lambda store, later: fs.view(store, "property").select("project", "store", "key", "op", "file", "line", F.lit(later).alias("_later"))
    n = lambda later, *ops: F.count_if((F.col("_later") == later) & F.col("op").isin(*ops))
    told = side(before, False).unionByName(side(after, True)).where("key is not null and store is not null and op in ('read', 'write', 'delete')").groupBy("project", "store", "key").agg(
        n(False, "read", "write", "delete").alias("_x"), n(False, "read").alias("_xr"), n(False, "write").alias("_xw"), n(True, "read").alias("_r"), n(True, "write").alias("_w"),
        F.min(F.when(F.col("_later") & F.col("op").isin("read", "write"), F.struct("file", "line"))).alias("_at"),
    )
    was, now = key_state(F.col("_xr"), F.col("_xw")), key_state(F.col("_r"), F.col("_w"))
    return told.where((F.col("_x") > 0) & (was == "ok") & (now != "ok")).select("project", "store", "key", now.alias("status"), "_at.file", "_at.line")


def _columns(before, after):
    return _changed(before, after, "array2d", ["project", "owner", "variable"], "x_indices <> y_indices or x_max_index <> y_max_index", "indices", "max_index")


def diff(before: DataFrame, after: DataFrame, manifest: DataFrame | None = None, providers: DataFrame | None = None) -> DataFrame:
    """Findings between two snapshots. Joins are on (project, symbol); positions are residuals.

    What changed about functions is one table, and the places that name functions meet it in one join.
    With the manifests, calls by the old name from projects that use this one as a library count too.
    """
    at = ["project", "symbol"]
    f, r = _functions(before, after)
    lost = f.where("y is null").join(r.select("project", F.col("old").alias("owner")), ["project", "owner"], "left_anti").select("project", "owner", "x.file", "x.line")
    d, p, t = _shapes(before, after), _params(f), _templates(before, after)
    held = stored(_returns(before, after))
    none = F.lit(None).cast("string")
    mark = lambda df, what, detail=none, pos=F.lit(None): df.select("project", F.col("owner").alias("symbol"), F.lit(what).alias("_what"), detail.alias("_detail"), pos.cast("int").alias("_pos"))
    cut = p.select("project", "owner", "y_params", F.posexplode("x_params").alias("_at", "_param")).where("not array_contains(y_params, _param)")
    null_now, broke = mark(held.where(NULL_NOW), "null"), mark(held.where(BROKE), "broke")
    marks = both(mark(r.withColumnRenamed("old", "owner"), "renamed", F.col("new")), mark(cut, "cut", F.col("_param"), F.col("_at")), mark(p.where(REORDERED), "reordered"), broke, null_now)
    named = fs.consumers(after).join(marks, at).where("""CASE _what WHEN 'renamed' THEN true WHEN 'cut' THEN n_args > _pos WHEN 'reordered' THEN n_args is not null and kind = 'internal_caller'
        WHEN 'broke' THEN kind = 'client_call.invocation' ELSE used_as like 'assigned:%' END""")
    what = F.col("_what")
    reason = (
        F.when(what == "renamed", say("still names a function that is now ", F.col("_detail"))).when(what == "cut", say("passes removed parameter ", F.col("_detail"))).when(what == "reordered", say("parameters are in another order"))
        .when(what == "broke", say("value can no longer be sent to a page")).otherwise(say("value may now be null; kept as ", F.col("used_as")))
    )
    fields = both(mark(d.withColumn("_field", F.explode(F.array_except("x_fields", "y_fields"))), "removed", F.col("_field")), null_now)
    read = fs.field_reads(after).join(fields, at).where("_what = 'null' or field = _detail")
    handled = F.when(what == "null", say("value may now be null; handler reads ", F.col("field"))).otherwise(say("handler reads removed field ", F.col("field")))
    pages = fs.view(after, "scriptlet_read").select("project", F.regexp_replace("file", r"\.html?$", "").alias("template"), "field", "file", "line")
    lacking = lambda fields, what: F.transform(fields, lambda v: F.struct(F.lit(what).alias("_what"), v.alias("field")))
    lacks = pages.join(t.select("project", "template", F.inline(F.concat(lacking(F.array_except("x_set", "y_set"), "dropped"), lacking(F.col("unset"), "unset")))), ["project", "template", "field"])
    outside = []
    if manifest is not None:
        calls = library_calls(after, manifest, providers).join(r.select(F.col("project").alias("provider"), F.col("old").alias("function"), "new"), ["provider", "function"])
        outside = [found(calls, "cross_project_caller", "break", "function", say("still names a function of ", F.col("provider"), " that is now ", F.col("new")))]
    return both(
        *outside,
        found(named, F.col("kind"), F.when(what == "null", "warn").otherwise("break"), "symbol", reason),
        found(lost, "internal_caller", "warn", "owner", say("function removed")),
        found(read, "client_call.success_handler", F.when(what == "null", "warn").otherwise("break"), "symbol", handled),
        found(_columns(before, after).where("y_max_index > x_max_index"), "array2d_consumer", "break", "owner", say("reads column ", F.col("y_max_index"), " of ", F.col("variable"))),
        found(lacks, "template_scriptlet_reader", F.when(what == "unset", "warn").otherwise("break"), "template", F.when(what == "unset", say("page reads field that is not set: ", F.col("field"))).otherwise(say("page reads field no longer set: ", F.col("field")))),
        found(_keys(before, after), F.when(F.col("status") == "write_only", "property_key_writer").otherwise("property_key_reader"), "warn", "key", say("nothing ", F.when(F.col("status") == "write_only", "reads").otherwise("writes"), " this key of ", F.col("store"), " any more")),
    ).dropDuplicates()


# ---- what if


def parse_change(text: str) -> tuple[str, object]:
    """change-return-shape:-a,+b | remove-param:p | rename-param:a=b | rename:n"""
    kind, _, rest = text.partition(":")
    rest = rest.strip()
    if kind == "change-return-shape" and rest and all(x.strip()[:1] in ("+", "-") and x.strip()[1:] for x in rest.split(",")):
        return kind, [(x.strip()[0], x.strip()[1:]) for x in rest.split(",")]
    if kind == "rename-param" and rest.count("=") == 1 and all(rest.split("=")):
        return kind, tuple(rest.split("="))
    if kind in ("remove-param", "rename") and rest:
        return kind, rest
    raise ValueError(f"no change: {text}")


def impact(store: DataFrame, project: str, name: str, change: str, manifest: DataFrame | None = None, providers: DataFrame | None = None) -> DataFrame:
    """Findings of a change to one function, before it is made; the store is filtered to the project first.

    With the manifests, calls from projects that use this one as a library count too.
    """
    kind, what = parse_change(change)
    outside = None if manifest is None else library_edges(store, manifest, providers).where((F.col("provider") == project) & (F.col("function") == name)).withColumn("symbol", F.col("function"))
    store = store.where(F.col("project") == project)
    use = fs.consumers(store).where(F.col("symbol") == name)
    own = fs.functions(store)[0].where(F.col("owner") == name)
    if kind == "change-return-shape":
        gone = [f for sign, f in what if sign == "-"]
        reads = fs.field_reads(store).where((F.col("symbol") == name) & F.col("field").isin(gone))
        return found(reads, "client_call.success_handler", "break", "symbol", say("handler reads removed field ", F.col("field")))
    if kind == "remove-param":
        at = own.select("project", F.array_position("params", what).alias("_pos"))
        unknown = found(own.where(~F.array_contains("params", what)), "internal_caller", "warn", "owner", say(f"no parameter {what}"))
        hit = use.where("n_args is not null").join(at.where("_pos > 0"), "project").where("n_args >= _pos")
        out = unknown.unionByName(found(hit, F.col("kind"), "break", "symbol", say(f"passes removed parameter {what}")))
        if outside is not None:
            far = outside.join(at.where("_pos > 0").select(F.col("project").alias("provider"), "_pos"), "provider").where("n_args >= _pos")
            out = out.unionByName(found(far, "cross_project_caller", "break", "symbol", say(f"passes removed parameter {what}")))
        return out
    if kind == "rename-param":
        known = F.array_contains("params", what[0])
        return found(own, "internal_caller", "warn", "owner", F.when(known, say(f"{what[0]} becomes {what[1]}: check the body and its documentation")).otherwise(say(f"no parameter {what[0]}")))
    roles = F.when(F.col("owner").isin(fs.WEB_ENTRIES), "entry_point_web").when(F.col("owner").isin(fs.SIMPLE_TRIGGERS), "simple_trigger")
    out = found(use, F.col("kind"), "break", "symbol", say(f"names {name}")).unionByName(found(own.where(roles.isNotNull()), roles, "break", "owner", say("the script host calls this name")))
    return out if outside is None else out.unionByName(found(outside, "cross_project_caller", "break", "symbol", say(f"names {name}")))


def impact_safe(store: DataFrame, project: str, name: str, change: str) -> DataFrame:
    """(project, symbol, field, reason): what a change of the returned shape leaves safe, fields that nobody reads and fields that come."""
    kind, what = parse_change(change)
    if kind != "change-return-shape":
        raise ValueError("only a change of the returned shape has fields")
    store = store.where(F.col("project") == project)
    asked = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(s).alias("sign")) for s, f in what])
    own = fs.functions(store)[0].where(F.col("owner") == name).select("project", F.col("owner").alias("symbol"), F.inline(asked))
    read = fs.field_reads(store).where(F.col("symbol") == name).select("project", "field").distinct()
    gone = own.where("sign = '-'").join(read, ["project", "field"], "left_anti").withColumn("reason", F.lit("nobody reads it"))
    return gone.unionByName(own.where("sign = '+'").withColumn("reason", F.lit("a field more breaks nobody"))).select("project", "symbol", "field", "reason")


# ---- manifest


def manifest_rules(store: DataFrame, manifest: DataFrame) -> DataFrame:
    m = manifest.withColumnRenamed("project", "_p")
    same = F.col("project") == F.col("_p")
    calls = fs.view(store, "call").withColumn("root", fs.root_name("receiver")).where("root is not null")
    used = calls.groupBy("project", "root").agg(F.min(F.struct("file", "line")).alias("_w"), F.count("*").alias("n")).select("project", "root", "n", "_w.file", "_w.line")
    known = used.join(m, same)
    symbols = lambda c: F.transform(c, lambda x: x["userSymbol"])
    told = F.array_union(symbols("libraries"), symbols("services"))
    foreign = known.where(~F.array_contains(told, F.col("root")) & ~F.col("root").isin(fs.SERVICES + NOT_LIBRARIES))
    there = used.groupBy(F.col("project").alias("_q")).agg(F.collect_set("root").alias("_roots"))
    all_m = manifest.join(there, F.col("project") == F.col("_q"), "left").withColumn("_roots", F.coalesce("_roots", F.array().cast("array<string>"))).withColumn("file", F.lit("appsscript.json")).withColumn("line", F.lit(1))
    unused = lambda c: all_m.withColumn("symbol", F.explode(F.array_except(symbols(c), F.col("_roots"))))
    asked = known.where("size(scopes) > 0").withColumn("_ok", accepted(F.col("root")))
    missing = asked.where("_ok is not null and not arrays_overlap(_ok, scopes)")
    s = all_m.withColumn("symbol", F.explode("scopes"))
    idle = s.withColumn("_by", justifying(F.col("symbol"))).where("_by is not null and not arrays_overlap(_by, _roots)")
    current = fs.view(store, "current_doc_only").select("project").distinct()
    wide = s.join(current, "project", "left_semi").where(reduce(lambda a, b: a | b, [(F.col("symbol") == AUTH + x) & F.array_contains("_roots", v) & ~F.array_contains("scopes", f"{AUTH}{x}.currentonly") for v, x in CURRENT_ONLY.items()]))
    mail = F.array_intersect("scopes", F.array(*map(F.lit, BROAD_MAIL)))
    broad = all_m.where((F.size(mail) > 0) & F.array_contains("_roots", "MailApp") & ~F.array_contains("_roots", "GmailApp") & ~F.array_contains("scopes", f"{AUTH}script.send_mail")).withColumn("symbol", mail[0])
    url = F.regexp_extract(F.col("args")[0], r"^(['\"`])([^$]*)\1$", 2)
    fetched = fs.view(store, "call").where("callee = 'UrlFetchApp.fetch' and size(args) > 0").withColumn("url", url).where("url <> ''").groupBy("project", "url").agg(F.min(F.struct("file", "line")).alias("_w")).select("project", "url", "_w.file", "_w.line")
    outside = fetched.join(m, same).where("size(whitelist) > 0 and not exists(whitelist, w -> startswith(url, w))")
    return both(
        found(foreign.where(~F.col("root").isin(ADVANCED)), "manifest.library", "break", "root", say("library used but not declared; calls: ", F.col("n"))),
        found(foreign.where(F.col("root").isin(ADVANCED)), "manifest.advanced_service", "break", "root", say("advanced service used but not enabled; calls: ", F.col("n"))),
        found(unused("libraries"), "manifest.library", "info", "symbol", say("library declared but not used")),
        found(unused("services"), "manifest.advanced_service", "info", "symbol", say("advanced service enabled but not used")),
        found(missing, "manifest.scope", "warn", "root", say("no declared scope lets this service run")),
        found(idle, "manifest.scope", "info", "symbol", say("no service used here asks for this scope")),
        found(wide, "manifest.scope", "info", "symbol", say("the current document's scope would do")),
        found(broad, "manifest.scope", "info", "symbol", say("sending mail alone would do")),
        found(outside, "manifest.urlfetch_whitelist", "warn", "url", say("address starts with no listed prefix")),
    )


def accepted(service: Column) -> Column:
    return reduce(lambda c, k: c.when(service == k, F.array(*map(F.lit, SCOPES[k]))), SCOPES, F.when(F.lit(False), F.array(F.lit(""))))


def justifying(scope: Column) -> Column:
    """Services that a scope serves; null where none is known."""
    by = {x: [k for k, v in SCOPES.items() if x in v] for v in SCOPES.values() for x in v}
    return reduce(lambda c, x: c.when(scope == x, F.array(*map(F.lit, by[x]))), by, F.when(F.lit(False), F.array(F.lit(""))))


# ---- run time, web pages, documentation


def runtime_rules(store: DataFrame, manifest: DataFrame) -> DataFrame:
    loops, locks = fs.view(store, "loop_call"), fs.view(store, "lock")
    made = fs.view(store, "trigger").where("created").join(fs.view(store, "delete_trigger").select("project").distinct(), "project", "left_anti")
    chatty = fs.view(store, "client_call").groupBy("project").agg(F.count("*").alias("n"), F.min(F.struct("file", "line")).alias("_w")).where(F.col("n") >= CHATTY_SITES).join(manifest.where("size(libraries) > 0").select("project"), "project", "left_semi").select("project", "n", "_w.file", "_w.line")
    return both(
        found(loops.where("kind = 'cell'"), "lint.quota_in_loop", "warn", "owner", say(F.col("method"), " on single cells in a loop: ", F.col("loop"))),
        found(loops.where("kind = 'fetch'"), "lint.urlfetch_in_loop", "warn", "owner", say("fetch in a loop: ", F.col("loop"))),
        found(locks.where("not released"), "lint.lock_no_finally", "warn", "owner", say(F.col("method"), " without a release in finally")),
        found(made, "lint.trigger_orphan", "info", "owner", say("trigger made; the project deletes none")),
        found(chatty, "lint.library_chatty_ui", "info", F.lit("<project>"), say("pages call the server at ", F.col("n"), " places through a library")),
    )


def webapp_rules(store: DataFrame, embedded: bool = False) -> DataFrame:
    links = fs.view(store, "html_link").join(fs.view(store, "html_base").select("project", "file").distinct(), ["project", "file"], "left_anti")
    plain = both(fs.view(store, "html_resource").select("project", "file", "line", "url"), fs.view(store, "html_fetch").select("project", "file", "line", "url"))
    frames = fs.view(store, "webapp_html").where(F.col("returns_html") & F.col("owner").isin(fs.WEB_ENTRIES) & (F.coalesce("xframe", F.lit("")) != "ALLOWALL"))
    return both(
        found(plain, "webapp.mixed_content", "warn", "url", say("address without encryption in a page")),
        found(links, "webapp.link_target", "warn", "href", say("link stays in the frame: no target")),
        found(fs.view(store, "html_form").where("not handled"), "webapp.form_submit", "warn", F.lit("form"), say("form submits by default")),
        found(frames, "webapp.xframe_missing", "warn" if embedded else "info", "owner", say("page can't be framed; mode: ", F.coalesce("xframe", F.lit("none")))),
    )


DOC_CHECKS = {"undocumented": "doc.undocumented", "drift": "doc.param_drift", "return_drift": "doc.return_drift", "stale_ref": "doc.stale_ref"}


def doc_rules(store: DataFrame, checks: Sequence[str] = (), public_only: bool = False) -> DataFrame:
    """Documentation comments against the code; checks names some of DOC_CHECKS, all if it is empty; public_only leaves private functions out.

    A reference may name a private function either way.
    """
    if unknown := set(checks) - set(DOC_CHECKS):
        raise ValueError(f"no such checks: {sorted(unknown)}")
    known, at = fs.functions(store)[0], ["project", "owner"]
    f = known.where("visibility = 'public'") if public_only else known
    doc = fs.view(store, "doc").drop("file", "line", "col")
    with_doc = f.join(doc, at)
    bare = f.join(doc.where("summary is not null").select(*at), at, "left_anti")
    tags = f.join(fs.view(store, "doc_param").select(*at, "param"), at).where("not array_contains(params, param)")
    shape = fs.view(store, "returns").where("confident_shape = 'true'").select(*at, "fields")
    told = F.array_distinct(F.filter(F.regexp_extract_all("returns_text", F.lit(r"`([A-Za-z_$][\w$]*)`"), F.lit(1)), lambda x: x.rlike("^[a-z_$]") & ~x.isin(DOC_WORDS)))
    drift = with_doc.where("returns_text is not null").join(shape, at).withColumn("field", F.explode(F.array_except(told, "fields")))
    refs = with_doc.withColumn("ref", F.explode("refs")).withColumn("head", F.regexp_extract("ref", r"^[\w$]+", 0)).where("head <> '' and not ref like 'http%'")
    lost = refs.join(known.select("project", F.col("owner").alias("head")), ["project", "head"], "left_anti").where(~F.col("head").isin(fs.SERVICES + DOC_GLOBALS))
    told = {
        "undocumented": lambda kind: found(bare, kind, "info", "owner", say("no summary")),
        "drift": lambda kind: found(tags, kind, "warn", "owner", say("documents no such parameter: ", F.col("param"))),
        "return_drift": lambda kind: found(drift, kind, "warn", "owner", say("documents a field that is not returned: ", F.col("field"))),
        "stale_ref": lambda kind: found(lost, kind, "info", "owner", say("refers to nothing known: ", F.col("ref"))),
    }
    return both(*[make(DOC_CHECKS[name]) for name, make in told.items() if not checks or name in checks])


# ---- API


def _folded(store: DataFrame, registry: Sequence[tuple]) -> DataFrame:
    """Chains whose root the registry has, with _f: out, what was met along them, and verdict, why they ended: stop, unknown (a type that the registry hasn't) or nothing.

    The registry, a few hundred rows whatever the input, is one constant map; each chain is folded through it in a
    projection, without a join. Method '*' stands for a type.
    """
    entries = {f"{t}.{m}": {"returns": r, "arity_min": n, "deprecated": d} for t, m, r, n, d in registry}
    methods: dict[str, list[str]] = {}
    for t, m, *_ in registry:
        methods.setdefault(t, []).extend([m] if m != "*" else [])
    c = fs.view(store, "chain").where(~F.col("truncated") & F.col("root").isin(list(methods)))
    c = c.withColumn("_r", F.from_json(F.lit(json.dumps(entries)), "map<string,struct<returns:string,arity_min:int,deprecated:string>>")).withColumn("_all", F.from_json(F.lit(json.dumps(methods)), "map<string,array<string>>"))
    start = F.struct(F.col("root").alias("type"), F.lit("").alias("verdict"), F.array().cast("array<struct<kind:string,method:string,type:string>>").alias("out"))

    def step(s, x):
        name, n = F.split_part(x, F.lit("/"), F.lit(1)), F.split_part(x, F.lit("/"), F.lit(2)).cast("int")
        hit = F.try_element_at("_r", F.concat(s["type"], F.lit("."), name))
        note = lambda k: F.array(F.struct(F.lit(k).alias("kind"), name.alias("method"), s["type"].alias("type")))
        old = F.coalesce(hit["deprecated"], F.try_element_at("_r", F.concat(s["type"], F.lit(".*")))["deprecated"])
        make = lambda t, v, o: F.struct(t.alias("type"), F.lit(v).alias("verdict"), o.alias("out"))
        return (
            F.when(s["verdict"] != "", s)
            .when(~F.map_contains_key("_all", F.coalesce(s["type"], F.lit(""))), make(s["type"], "unknown", s["out"]))
            .when(hit.isNull(), make(s["type"], "stop", F.concat(s["out"], note("api.unknown_method"))))
            .when(n < F.coalesce(hit["arity_min"], F.lit(0)), make(s["type"], "stop", F.concat(s["out"], note("api.wrong_arity"))))
            .otherwise(make(hit["returns"], "", F.when(old.isNotNull(), F.concat(s["out"], note("api.deprecated"))).otherwise(s["out"])))
        )

    return c.withColumn("_f", F.aggregate("steps", start, step))


def api_counts(store: DataFrame, registry: Sequence[tuple]) -> DataFrame:
    """One row: chains in all, those cut short at their root, those of a root that the registry hasn't, those that came to a type it hasn't, and findings."""
    types = sorted({t for t, *_ in registry})
    roots = fs.view(store, "chain").agg(F.count("*").alias("chains"), F.count_if("truncated").alias("truncated"), F.count_if(~F.col("truncated") & ~F.col("root").isin(types)).alias("unknown_root"))
    walked = _folded(store, registry).agg(F.count_if(F.col("_f.verdict") == "unknown").alias("unknown_type"), F.coalesce(F.sum(F.size("_f.out")), F.lit(0)).cast("long").alias("findings"))
    return roots.withColumn("_k", F.lit(1)).join(walked.withColumn("_k", F.lit(1)), "_k").drop("_k")


def api_rules(store: DataFrame, registry: Sequence[tuple]) -> DataFrame:
    """Chains of calls against registry rows (type, method, returns, least arguments, deprecated or None).

    A step of a type that the registry hasn't ends the chain quietly. Near methods are compared in lower case: within max(3, half the length), containing the one asked for, or starting like it,
    by min(4, half the length) characters.
    """
    c = _folded(store, registry)
    c = c.withColumn("_o", F.explode("_f.out"))
    asked = F.lower("_o.method")
    half = F.floor(F.length("_o.method") / 2)
    start_of = F.substring(asked, F.lit(1), F.least(F.lit(4), half).cast("int"))
    far = lambda x: F.levenshtein(F.lower(x), asked)
    close = F.filter(F.element_at("_all", F.col("_o.type")), lambda x: (far(x) <= F.greatest(F.lit(3), half)) | F.lower(x).contains(asked) | ((start_of != "") & F.lower(x).startswith(start_of)))
    near = F.array_sort(F.transform(close, lambda x: F.struct(far(x).alias("d"), x.alias("m"))))
    names = F.array_join(F.transform(F.slice(near, 1, 3), lambda x: x["m"]), ", ")
    kind = F.col("_o.kind")
    reason = F.when(kind == "api.unknown_method", say(F.col("_o.type"), " has no such method; near: ", names)).when(kind == "api.wrong_arity", say("too few arguments")).otherwise(say("deprecated in ", F.col("_o.type")))
    return found(c, kind, F.when(kind == "api.deprecated", "warn").otherwise("break"), F.concat_ws(".", "_o.type", "_o.method"), reason)


# ---- environments


def environment_rules(store: DataFrame, manifest: DataFrame, targets: DataFrame, library: DataFrame, resources: DataFrame, files: DataFrame) -> DataFrame:
    """Projects against a workspace manifest.

    targets (project, app, env); library (user_symbol, script_id, prod_version), one row or none; resources (env, name, id);
    files (project, file, content). A declared id counts wherever a line of a file contains it, however short it is and
    also inside of a longer word; lines and ids meet by anchors (patterns.containing), so there may be any number of both.
    """
    head = (F.coalesce(F.col("_l.developmentMode"), F.lit(False))) | F.upper(F.coalesce("_l.version", F.lit(""))).isin("", "0", "HEAD")
    used = manifest.select("project", F.explode("libraries").alias("_l")).join(targets, "project")
    # by symbol or by id: two joins of equality; what the first has found is left out of the second
    by_symbol = used.join(library, F.col("_l.userSymbol") == F.col("user_symbol"))
    by_id = used.join(library, (F.col("_l.libraryId") == F.col("script_id")) & ~F.col("_l.userSymbol").eqNullSafe(F.col("user_symbol")))
    own = by_symbol.unionByName(by_id)
    own = own.withColumn("file", F.lit("appsscript.json")).withColumn("line", F.lit(1))
    at = F.concat_ws("::", "app", F.lit("env"), "env")  # what findings of one project are told under
    lines = files.where("content is not null").join(targets, "project", "left_semi").select("project", "file", F.posexplode(F.split("content", "\n")).alias("_at", "_text")).select("project", "file", (F.col("_at") + 1).alias("line"), "_text")
    met = containing(lines, "_text", resources, "id").join(targets, "project")
    hit = by_owner(met, resources, "id", "env")
    opened = fs.view(store, "resource_open").select("project", "file", "line", "id").join(targets, "project").join(resources, "id", "left_anti")
    declared = resources.agg(F.collect_set("env").alias("_e"), F.collect_set("name").alias("_n"), F.collect_set(F.struct("env", "name")).alias("_p")).withColumn("env", F.explode("_e"))
    has = F.transform(F.filter("_p", lambda x: x["env"] == F.col("env")), lambda x: x["name"])
    absent = declared.select("env", F.explode(F.array_except("_n", has)).alias("name"), F.lit("").alias("project"), F.lit("workspace").alias("file"), F.lit(1).alias("line"))
    return both(
        found(own.where((F.col("env") == "prod") & (head | (F.col("_l.version") != F.col("prod_version").cast("string")))), "env.library_version_mismatch", "break", at, say("production must use version ", F.col("prod_version"))),
        found(own.where((F.col("env") == "dev") & ~head), "env.library_version_mismatch", "warn", at, say("development should follow the head")),
        found(hit.where("not own"), "env.cross_env_leak", "break", at, say("id of ", F.array_join("owners", ","), " in ", F.col("env"), ": ", F.col("id"))),
        found(hit.where("own"), "env.hardcoded_resource", "warn", at, say("declared id written out: ", F.col("id"))),
        found(opened, "env.hardcoded_resource", "warn", at, say("undeclared id written out: ", F.col("id"))),
        found(absent, "env.undeclared_resource", "warn", F.concat(F.lit("env::"), "env"), say("not declared: ", F.col("name"))),
    )


# ---- all together


def check(before: DataFrame, after: DataFrame, manifest: DataFrame, embedded: bool = False, registry: Sequence[tuple] | None = None, providers: DataFrame | None = None, environment: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """What a change breaks, with the findings of the manifest, run time, pages and documentation, and where they are given of
    the API registry and the environment (targets, library, resources, files): all but information.

    Both stores should be written: each rule reads its own views of them.
    """
    parts = [diff(before, after, manifest, providers), manifest_rules(after, manifest), runtime_rules(after, manifest), webapp_rules(after, embedded), doc_rules(after)]
    if registry is not None:
        parts.append(api_rules(after, registry))
    if environment is not None:
        parts.append(environment_rules(after, manifest, *environment))
    return both(*parts).where("severity <> 'info'")


def project_map(store: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row a project: functions by visibility, entry points, triggers, client calls, template gaps, libraries."""
    f, e = fs.functions(store)[0], fs.exposures(store)
    n = lambda kind: F.count_if(F.col("type") == kind)
    out = f.groupBy("project").agg(F.count("*").alias("functions"), F.count_if(F.col("visibility") == "private").alias("private"))
    out = out.join(e.groupBy("project").agg(n("entry_point_web").alias("web_entries"), n("simple_trigger").alias("simple_triggers"), n("installable_trigger").alias("installable_triggers"), n("client_call").alias("client_functions"), n("scriptlet").alias("scriptlet_functions")), "project", "left")
    out = out.join(fs.view(store, "client_call").groupBy("project").agg(F.count("*").alias("client_sites")), "project", "left")
    out = out.join(fs.template_gaps(store).groupBy("project").agg(F.count_if(F.size("unset") > 0).alias("template_gaps")), "project", "left")
    return out.join(manifest.select("project", F.size("libraries").cast("long").alias("libraries")), "project", "left").na.fill(0)
