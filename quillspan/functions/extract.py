"""Facts of one source file. A fact is a row: (fact, owner, line, col, a, b, c, d, n, flag, items); VIEWS names the columns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from quillspan.functions.script import Node, Source, Tokens, parse, walk

#: What the general columns of each fact mean; `owner` is the function, or the handler in a page.
VIEWS = {
    "file": {"a": "sha1", "b": "kind"},
    "function": {"a": "visibility", "b": "fingerprint", "c": "kind", "n": "end_line", "items": "params"},
    "doc": {"a": "summary", "b": "returns_type", "c": "returns_text", "d": "returns_fields", "items": "refs"},
    "doc_param": {"a": "param", "b": "type"},
    "returns": {"a": "serializable", "b": "confident_shape", "flag": "nullable", "c": "open_object", "items": "fields"},
    "call": {"a": "callee", "b": "receiver", "c": "final_name", "d": "used_as", "items": "args"},
    "chain": {"a": "root", "flag": "truncated", "items": "steps"},
    "client_call": {"a": "server", "b": "success", "c": "failure", "items": "args"},
    "chunk": {"a": "ordinal", "n": "length"},
    "handler": {"a": "param"},
    "handler_read": {"a": "field"},
    "scriptlet_call": {"a": "callee"},
    "scriptlet_read": {"a": "field"},
    "destructuring": {"a": "bound_to", "n": "arity"},
    "property": {"a": "op", "b": "store", "c": "key"},
    "array2d": {"a": "variable", "n": "max_index", "items": "indices"},
    "template": {"a": "template", "items": "fields"},
    "uncertain": {"a": "what"},
    "loop_call": {"a": "method", "b": "kind", "c": "loop"},
    "lock": {"a": "method", "flag": "released"},
    "trigger": {"a": "function", "flag": "created"},
    "delete_trigger": {},
    "webapp_html": {"a": "xframe", "flag": "returns_html"},
    "current_doc_only": {},
    "html_resource": {"a": "tag", "b": "url"},
    "html_link": {"a": "href"},
    "html_form": {"flag": "handled"},
    "html_fetch": {"a": "url"},
    "html_base": {"a": "target"},
    "resource_open": {"a": "api", "b": "id"},
    "problem": {"a": "message"},
}

# Names that the script host gives a meaning.
CELL_METHODS = frozenset("getValue setValue getDisplayValue setFormula setFormulaR1C1 appendRow setBackground setFontColor setNumberFormat setNote setHorizontalAlignment setVerticalAlignment".split())
EACH_METHODS = frozenset("forEach map filter reduce every some".split())
STORES = {
    "PropertiesService": ({"getScriptProperties": "script", "getUserProperties": "user", "getDocumentProperties": "document"}, {"getProperty": "read", "setProperty": "write", "deleteProperty": "delete"}),
    "CacheService": ({"getScriptCache": "cache_script", "getUserCache": "cache_user", "getDocumentCache": "cache_document"}, {"get": "read", "put": "write", "remove": "delete"}),
}
HTML_MAKERS = frozenset("createHtmlOutput createHtmlOutputFromFile createTemplate createTemplateFromFile".split())
RESOURCE_ATTRIBUTES = {"script": "src", "link": "href", "img": "src", "iframe": "src", "audio": "src", "video": "src", "source": "src", "embed": "src"}

FUNCTIONS = ("function", "arrow")
#: Fixed value: white space as scripts define it.
SCRIPT_SPACE = re.compile(r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
DOC = re.compile(r"/\*\*(?!/)(.*?)\*/", re.S)


#: Columns of a fact, and the slice that stands for a file's digest until it is made.
WIDTH, WHOLE = 11, slice(None)


def row(fact, owner, at, a=None, b=None, c=None, d=None, n=None, flag=None, items=None):
    return (fact, owner, at[0], at[1], a, b, c, d, n, flag, items)


def literal(node: Node | None) -> str | None:
    return node.value if node is not None and node.kind in ("str", "tmpl") else None


def bare(node: Node) -> Node:
    while node.kind == "paren":
        node = node.value
    return node


# ---- documentation


def braced(text: str) -> tuple[str | None, str]:
    """The type in balanced braces that the text starts with, and what follows."""
    if not text.startswith("{"):
        return None, text
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if depth == 0:
            return text[1:i].strip(), text[i + 1 :].strip()
    return None, text


def type_fields(kind: str | None) -> list[str] | None:
    """Field names of an object type `{a: T, b: T}` at its outer level; null for other types."""
    if not kind or not (kind := kind.strip()).startswith("{") or not kind.endswith("}"):
        return None
    out, depth, word = [], 0, ""
    for c in kind[1:-1] + ",":
        depth += (c in "{[(<") - (c in "}])>")
        if c == "," and depth == 0:
            if name := word.split(":")[0].strip().rstrip("?"):
                out.append(name)
            word = ""
        else:
            word += c
    return out


def doc_facts(owner: str, at, comment: str) -> Iterator[tuple]:
    lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in comment.split("\n")]
    parts = re.split(r"(?:^|\n)\s*(?=@)", "\n".join(lines).strip())
    summary = None if parts[0].startswith("@") else " ".join(parts[0].split()) or None
    refs = re.findall(r"\{@link\s+([^\s}|]+)", comment)
    kind = told = None
    for tag in (p for p in parts if p.startswith("@")):
        word, _, rest = tag[1:].partition(" ")
        rest = " ".join(rest.split())
        if word == "param":
            t, rest = braced(rest)
            if m := re.match(r"\[?\s*([\w$]+)(\.)?", rest):
                if not m.group(2):
                    yield row("doc_param", owner, at, m.group(1), t)
        elif word in ("return", "returns"):
            kind, told = braced(rest)
        elif word == "see" and not rest.startswith("{@link"):
            refs += rest.split()[:1]
    fields = type_fields(kind)
    yield row("doc", owner, at, summary, kind, told or None, None if fields is None else ",".join(fields), items=refs)


# ---- functions


def definitions(tree: Node) -> Iterator[tuple[str, Node, Node, str]]:
    """(name, function, statement, kind) of functions at the top of a script."""
    for s in tree.body:
        if s.kind == "function" and s.name:
            yield s.name.text, s, s, "declaration"
        elif s.kind == "declaration":
            yield from ((m.target.text, m.value, s, m.value.kind) for m in s.made if m.target.kind == "name" and m.value is not None and m.value.kind in FUNCTIONS)


def produced(value: Node, state: dict) -> None:
    value = bare(value)
    if value.kind == "choice":
        produced(value.then, state), produced(value.other, state)
    elif value.kind == "object":
        state["literal"] = True
        for m in value.items:
            if m.kind == "spread" or m.key is None:
                state["opaque"] = True
            else:
                state["fields"].add(m.key)
    elif not nothing(value):
        state["opaque"] = True


def nothing(value: Node) -> bool:
    return value.kind == "name" and value.text in ("null", "undefined")


def classify(value: Node, state: dict) -> None:
    value = bare(value)
    if nothing(value):
        state["nullable"] = True
    elif value.kind == "choice":
        classify(value.then, state), classify(value.other, state)
    elif value.kind == "new":
        state["bad"] |= not (value.of.kind == "name" and value.of.text == "Date")
    elif value.kind in FUNCTIONS or value.kind == "method":
        state["bad"] = True
    elif value.kind == "array":
        for v in value.items:
            classify(v, state)
    elif value.kind == "object":
        for m in value.items:
            if m.kind == "pair":
                state["open"] |= m.key is None
                classify(m.value, state)
            elif m.kind == "method":
                state["bad"] = True


def return_fact(owner: str, at, f: Node) -> tuple:
    """Returns of closures inside count too. Serializable is unknown where nothing is returned."""
    state = {"fields": set(), "literal": False, "opaque": False, "nullable": False, "bad": False, "open": False}
    returns, known = [n for n in walk(f.body) if n.kind == "return"], False
    if not returns and f.body.kind != "block":
        produced(f.body, state)
    elif f.body.kind != "block":
        classify(f.body, state), produced(f.body, state)
        known = True
    else:
        for r in returns:
            if r.value is None:
                state["nullable"] = True
            else:
                known = True
                classify(r.value, state), produced(r.value, state)
    return row("returns", owner, at, "false" if state["bad"] else "true" if known else "unknown", str(state["literal"] and not state["opaque"]).lower(), str(state["open"]).lower(), flag=state["nullable"], items=sorted(state["fields"]))


def steps_of(call: Node) -> tuple[Node, list[Node]] | None:
    """The root of a chain of member calls and its calls from the first; null where a callee is no member."""
    calls = []
    while call.kind == "call":
        if call.of.kind != "member":
            return None
        calls.append(call)
        call = call.of.of
    return call, calls[::-1]


def body_facts(owner: str, f: Node, src: Source) -> Iterator[tuple]:
    text = src.text
    cut = lambda n: text[n.start : n.end]
    nodes, parent = list(walk(f)), {}
    for n in nodes:
        for c in n.children():
            parent[id(c)] = n
    up = lambda n: parent.get(id(n))
    released = any(m.kind == "member" and m.prop.text == "releaseLock" for n in nodes if n.kind == "try" and n.last for m in walk(n.last))
    tables, templates = {}, {}
    xframe, html = None, False
    for n in nodes:
        at = src.at(n.start)
        value = n.value if n.kind in ("declarator", "assign") else None
        if value is not None and (call := bare(value)).kind == "call":
            if n.target.kind == "name" and call.of.kind == "member":
                if call.of.prop.text == "getValues":
                    tables.setdefault(n.target.text, (at, set()))
                elif call.of.prop.text == "createTemplateFromFile" and call.args and literal(call.args[0]) is not None:
                    templates[n.target.text] = literal(call.args[0])
            if n.target.kind == "array":
                yield row("destructuring", owner, at, call.of.text if call.of.kind == "name" else None, n=len(n.target.items) + n.target.holes)
        if n.kind == "assign" and n.target.kind == "member" and n.target.prop.text == "data" and n.target.of.kind == "name" and n.target.of.text in templates and bare(n.value).kind == "object":
            yield row("template", owner, at, templates[n.target.of.text], items=sorted({m.key for m in bare(n.value).items if m.kind != "spread" and m.key}))
        if n.kind == "for_in" and n.over.kind == "name" and n.over.text in tables:
            first = n.first.made[0].target if n.first.kind == "declaration" else n.first
            if first.kind == "name":
                tables[n.over.text][1].update(columns(n.body, first.text, text))
        if n.kind == "new" and n.of.kind == "name" and n.of.text == "Function":
            yield row("uncertain", owner, at, "function_constructor")
        if n.kind != "call":
            continue
        of = n.of
        if of.kind == "index" and of.index.kind not in ("num", "str"):
            yield row("uncertain", owner, at, "dynamic_dispatch")
        if of.kind == "name" and of.text in ("eval", "Function"):
            yield row("uncertain", owner, at, "eval" if of.text == "eval" else "function_constructor")
        if of.kind not in ("name", "member"):
            continue
        above, final = up(n), of.text if of.kind == "name" else of.prop.text
        used = None
        if above is not None:
            if above.kind == "return" or above.kind == "arrow" and above.body is n:
                used = "returned"
            elif above.kind in ("declarator", "assign") and above.value is n:
                used = f"assigned:{cut(above.target)}"
        yield row("call", owner, at, cut(of), None if of.kind == "name" else cut(of.of), final, used, items=[cut(a) for a in n.args])
        if final == "deleteTrigger":
            yield row("delete_trigger", owner, at)
        if of.kind == "name":
            continue
        if final in ("waitLock", "tryLock"):
            yield row("lock", owner, at, final, flag=released)
        if final in HTML_MAKERS and cut(of.of) == "HtmlService":
            html = True
        if final == "setXFrameOptionsMode":
            mode = next((m for m in ("ALLOWALL", "DENY", "DEFAULT") if n.args and re.search(rf"\b{m}\b", cut(n.args[0]))), None)
            xframe = mode if mode == "ALLOWALL" or xframe is None else xframe
        if of.of.kind == "name" and of.of.text in tables and n.args and n.args[0].kind in FUNCTIONS and n.args[0].params and n.args[0].params[0].target.kind == "name":
            tables[of.of.text][1].update(columns(n.args[0].body, n.args[0].params[0].target.text, text))
        if of.of.kind == "call" and of.of.of.kind == "member" and of.of.of.of.kind == "name" and (store := STORES.get(of.of.of.of.text)) and n.args:
            if final in store[1] and of.of.of.prop.text in store[0]:
                yield row("property", owner, at, store[1][final], store[0][of.of.of.prop.text], literal(n.args[0]))
        if above is not None and above.kind == "member" and up(above) is not None and up(above).kind == "call" and up(above).of is above:
            continue
        if found := steps_of(n):
            root, calls = found
            names = [c.of.prop.text for c in calls]
            base, deep = root, False
            while base.kind == "member":
                base, deep = base.of, True
            if base.kind == "name":
                yield row("chain", owner, src.at(n.start), base.text, flag=deep, items=[f"{m}/{len(c.args)}" for m, c in zip(names, calls, strict=True)])
                if base.text == "ScriptApp" and "newTrigger" in names:
                    yield trigger_fact(owner, at, names, calls)
    for name, (at, found) in tables.items():
        if found:
            yield row("array2d", owner, at, name, n=max(found), items=[str(i) for i in sorted(found)])
    if html or xframe:
        yield row("webapp_html", owner, src.at(f.start), xframe, flag=html)
    yield from loop_facts(owner, f.body, src)


def trigger_fact(owner: str | None, at, names: list[str], calls: list[Node]) -> tuple:
    args = calls[names.index("newTrigger")].args
    return row("trigger", owner, at, literal(args[0]) if args else None, flag=names[-1] == "create")


def outer_facts(tree: Node, inner: set[int], src: Source) -> Iterator[tuple]:
    """Triggers made and deleted outside of the functions at the top; they have no owner."""
    todo, taken = [tree], set()
    while todo:
        n = todo.pop()
        if id(n) in inner:
            continue
        if n.kind == "call" and n.of.kind == "member":
            if n.of.prop.text == "deleteTrigger":
                yield row("delete_trigger", None, src.at(n.start))
            found = None if id(n) in taken else steps_of(n)
            if found:
                root, calls = found
                taken.update(id(c) for c in calls)
                names = [c.of.prop.text for c in calls]
                if root.kind == "name" and root.text == "ScriptApp" and "newTrigger" in names:
                    yield trigger_fact(None, src.at(n.start), names, calls)
        todo.extend(reversed(n.children()))


def columns(body: Node, name: str, text: str) -> set[int]:
    return {int(text[n.index.start : n.index.end]) for n in walk(body) if n.kind == "index" and n.of.kind == "name" and n.of.text == name and n.index.kind == "num" and text[n.index.start : n.index.end].isdigit()}


def loop_facts(owner: str, body: Node, src: Source) -> Iterator[tuple]:
    """Calls on single cells, and fetches, with the innermost loop around them."""
    todo = [(body, None)]
    while todo:
        n, loop = todo.pop()
        if n.kind == "call" and n.of.kind == "member" and loop:
            name = n.of.prop.text
            if name in CELL_METHODS:
                yield row("loop_call", owner, src.at(n.start), name, "cell", loop)
            elif name == "fetch" and src.text[n.of.of.start : n.of.of.end] == "UrlFetchApp":
                yield row("loop_call", owner, src.at(n.start), name, "fetch", loop)
        inner = {}
        if n.kind in ("for", "for_in", "while", "do_while"):
            inner[id(n.body)] = n.kind
        elif n.kind == "call" and n.of.kind == "member" and n.of.prop.text in EACH_METHODS and n.args and n.args[0].kind in FUNCTIONS:
            inner[id(n.args[0])] = f"array.{n.of.prop.text}"
        todo.extend((c, inner.get(id(c), loop)) for c in reversed(n.children()))


def script_facts(text: str) -> Iterator[tuple]:
    """Facts of a script, undigested. Functions are those at its top; what stands outside them has no owner and only its triggers count."""
    src = Source(text)
    tree, errors = parse(text)
    comments = [(m.end(), m.group(1)) for m in DOC.finditer(text)]
    inner = set()
    for name, f, s, kind in definitions(tree):
        inner.add(id(f))
        at = src.at(s.start)
        params = [text[p.target.start : p.target.end] for p in f.params]
        yield row("function", name, at, "private" if name.endswith("_") else "public", slice(f.body.start, f.body.end), kind, n=src.at(s.end)[0], items=params)
        near = [(e, c) for e, c in comments if e <= s.start and not text[e : s.start].strip() and text.count("\n", e, s.start) <= 2]
        if near:
            yield from doc_facts(name, at, near[-1][1])
        yield return_fact(name, at, f)
        yield from body_facts(name, f, src)
    yield from outer_facts(tree, inner, src)
    if any("@OnlyCurrentDoc" in c for _, c in comments):
        yield row("current_doc_only", None, (1, 0))
    for offset, message in errors:
        yield row("problem", None, src.at(offset), message)


# ---- pages

SCRIPTLET = re.compile(r"<\?(!?=)?(.*?)\?>", re.S)
SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.S | re.I)
NOT_CALLS = frozenset("if for while switch catch function return typeof new".split())


def blank(m: re.Match) -> str:
    """A scriptlet as a number of the same length, so that the script around it parses."""
    return ("0" if m.group(1) else " ") + re.sub(r"[^\n]", " ", m.group())[1:]


def page_facts(html: str) -> Iterator[tuple]:
    src = Source(html)
    for m in SCRIPTLET.finditer(html):
        t = Tokens(html, m.start(2), m.end(2))
        for i, word in enumerate(t.text):
            before = t.text[i - 1] if i else ""
            if t.kind[i] != "name" or before in (".", "?."):
                continue
            if t.text[i + 1] == "(" and word not in NOT_CALLS and before not in ("function", "new"):
                yield row("scriptlet_call", None, src.at(t.start[i]), word)
            elif word == "data" and t.text[i + 1] == "." and t.kind[min(i + 2, len(t.kind) - 1)] == "name":
                yield row("scriptlet_read", None, src.at(t.start[i]), t.text[i + 2])
    plain = SCRIPTLET.sub(blank, html)
    inline = [m for m in SCRIPT.finditer(plain) if not re.search(r"\bsrc\s*=", m.group(1), re.I)]
    for ordinal, m in enumerate(inline):
        yield row("chunk", None, src.at(m.start(2)), str(ordinal), n=len(m.group(2)))
        tree, errors = parse(plain, m.start(2), m.end(2))
        yield from client_facts(tree, Source(plain))
        yield from (row("problem", None, src.at(o), e) for o, e in errors)
        yield from (row("html_fetch", None, src.at(m.start(2) + f.start()), f.group(1)) for f in re.finditer(r"""\bfetch\s*\(\s*['"`](http://[^'"`]*)""", m.group(2)))
    handled = any("preventDefault" in m.group(2) for m in SCRIPT.finditer(plain))
    for m in re.finditer(r"<([a-zA-Z]+)\b([^>]*)>", plain):
        tag, attributes, at = m.group(1).lower(), m.group(2), src.at(m.start())
        value = lambda name: (re.search(rf"""\b{name}\s*=\s*["']?([^"'\s>]*)""", attributes, re.I) or [None, None])[1]  # noqa: E731,B023
        if tag in RESOURCE_ATTRIBUTES and (url := value(RESOURCE_ATTRIBUTES[tag])) and url.lower().startswith("http://"):
            yield row("html_resource", None, at, tag, url)
        elif tag == "base" and value("target"):
            yield row("html_base", None, at, value("target"))
        elif tag == "a" and (href := value("href")) and not href.startswith("#") and not value("target"):
            yield row("html_link", None, at, href)
        elif tag == "form":
            yield row("html_form", None, at, flag=handled or "preventDefault" in attributes or "return false" in attributes)


def client_facts(tree: Node, src: Source) -> Iterator[tuple]:
    def handler(name: str, f: Node) -> Iterator[tuple]:
        first = f.params[0].target if f.params and f.params[0].target.kind == "name" else None
        yield row("handler", name, src.at(f.start), first.text if first else None)
        if first:
            yield from (row("handler_read", name, src.at(n.start), n.prop.text) for n in walk(f.body) if n.kind == "member" and n.of.kind == "name" and n.of.text == first.text)

    for name, f, _, _ in definitions(tree):
        yield from handler(name, f)
    taken = set()
    for n in walk(tree):
        if n.kind != "call" or id(n) in taken or not (found := steps_of(n)):
            continue
        root, calls = found
        if src.text[root.start : root.end] != "google.script.run" or not calls:
            continue
        taken.update(id(c) for c in calls)
        named = {}
        for c in calls[:-1]:
            if c.args and c.of.prop.text in ("withSuccessHandler", "withFailureHandler"):
                h, at = c.args[0], src.at(c.args[0].start)
                named[c.of.prop.text] = h.text if h.kind == "name" else f"@{at[0]}:{at[1]}" if h.kind in FUNCTIONS else "?"
                if h.kind in FUNCTIONS:
                    yield from handler(f"@{at[0]}:{at[1]}", h)
        last = calls[-1]
        yield row("client_call", None, src.at(last.of.prop.start), last.of.prop.text, named.get("withSuccessHandler"), named.get("withFailureHandler"), items=[src.text[a.start : a.end] for a in last.args])


#: Fixed value: methods that open a resource by its id.
OPENS = re.compile(r"""\b(openById|getFileById|getFolderById|getFormById|getDocumentById|getSpreadsheetById|openByUrl)\s*\(\s*['"]([^'"]+)['"]""")
ID_IN_ADDRESS = re.compile(r"/(?:d|folders)/([\w-]{20,})", re.A)


def resource_facts(text: str) -> Iterator[tuple]:
    """Resources opened by a literal."""
    src = Source(text)
    for m in OPENS.finditer(text):
        found = ID_IN_ADDRESS.search(m.group(2)) if m.group(1) == "openByUrl" else re.fullmatch(r"([\w-]{20,})", m.group(2), re.A)
        if found:
            yield row("resource_open", None, src.at(m.start()), m.group(1), found.group(1))


def undigested_facts(kind: str | None, content: str | None) -> Iterator[tuple]:
    """Facts of a script (gs) or a page (html); other kinds and null contents have none. Where a digest belongs stands the slice that it is of."""
    if kind in ("gs", "html") and content is not None:
        yield row("file", None, (1, 0), WHOLE, kind)
    if content:
        yield from script_facts(content) if kind == "gs" else page_facts(content) if kind == "html" else ()
        yield from resource_facts(content) if kind in ("gs", "html") else ()


def digest(content: str, of: slice) -> str:
    """A file's digest is of the whole content, a function's of its body with white space collapsed and trimmed."""
    if of == WHOLE:
        return hashlib.sha1(content.encode("utf-8", "replace")).hexdigest()
    return hashlib.sha256(re.sub(SCRIPT_SPACE, " ", content[of]).strip(" ").encode("utf-8", "replace")).hexdigest()[:16]


def facts_of(kind: str | None, content: str | None) -> Iterator[tuple]:
    """Facts of a script (gs) or a page (html), with its digest; other kinds and null contents have none."""
    return (tuple(digest(content, v) if isinstance(v, slice) else v for v in f) for f in undigested_facts(kind, content))
