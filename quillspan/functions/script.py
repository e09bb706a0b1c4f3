"""A parser for scripts: tokens, then a tree by precedence climbing. Errors cost one statement, not the file."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

SPACE = re.compile(r"(?:\s|\ufeff|//[^\n]*|/\*.*?(?:\*/|\Z)|<!--[^\n]*)+", re.S)
TOKEN = re.compile(
    r"""(?P<name>\#?(?:[^\W\d]|[$_])(?:\w|\$)*)|(?P<num>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"""
    r"""|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])""",
    re.S,
)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: Words after which a slash starts a pattern, not a division.
BEFORE_REGEX = frozenset("return typeof case do else in instanceof new void delete throw yield await of".split())
BINARY = {op: n for n, ops in enumerate(["??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**"], 1) for op in ops.split()}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
UNARY = frozenset("! ~ + - typeof void delete".split())


class Node:
    """kind, start and end offsets, and the parts of the kind as attributes."""

    __slots__ = ("below", "kind", "start", "end", "parts")

    def __init__(self, kind: str, start: int, end: int, **parts):
        self.kind, self.start, self.end, self.parts, self.below = kind, start, end, parts, None

    def __getattr__(self, name):
        try:
            return self.parts[name]
        except KeyError:
            raise AttributeError(name) from None

    def children(self) -> list[Node]:
        """The nodes among the parts; looked up once, when the tree is whole."""
        if self.below is None:
            self.below = []
            for v in self.parts.values():
                if isinstance(v, Node):
                    self.below.append(v)
                elif isinstance(v, list):
                    self.below += [x for x in v if isinstance(x, Node)]
        return self.below


def walk(node: Node, into=lambda n: True) -> Iterator[Node]:
    """The node and all below in source order; those for which `into` is false are given but not entered."""
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        if n is node or into(n):
            todo.extend(reversed(n.children()))


class SyntaxProblem(Exception):
    pass


class Source:
    """Text with 1-based lines and 0-based columns; `base` shifts offsets of a part of a page."""

    def __init__(self, text: str):
        self.text, self.starts = text, [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1]


class Tokens:
    """Kinds, texts, offsets and 'a line ends before' of text[start:end], and where brackets close."""

    def __init__(self, text: str, start: int, end: int):
        self.kind, self.text, self.start, self.end, self.fresh, self.close, self.holes = [], [], [], [], [], {}, {}
        at, opened, fresh = start, [], True
        while True:
            while m := SPACE.match(text, at, end):
                fresh |= "\n" in m.group()
                at = m.end()
            if at >= end:
                break
            kind, stop = self._next(text, at, end)
            if text[at:stop] in ("(", "[", "{"):
                opened.append(len(self.kind))
            elif text[at:stop] in (")", "]", "}") and opened:
                self.close[opened.pop()] = len(self.kind)
            self._add(kind, text[at:stop], at, stop, fresh)
            at, fresh = stop, False
        self._add("end", "", end, end, True)

    def _add(self, kind, text, start, end, fresh):
        self.kind.append(kind), self.text.append(text), self.start.append(start), self.end.append(end), self.fresh.append(fresh)

    def _next(self, text: str, at: int, end: int) -> tuple[str, int]:
        c = text[at]
        if c == "`":
            return "tmpl", self._template(text, at, end)
        if c == "/" and self._may_be_regex() and (m := REGEX.match(text, at, end)):
            return "re", m.end()
        if m := TOKEN.match(text, at, end):
            return m.lastgroup, m.end()
        return "bad", at + 1

    def _may_be_regex(self) -> bool:
        if not self.kind:
            return True
        kind, text = self.kind[-1], self.text[-1]
        return text in BEFORE_REGEX if kind == "name" else kind == "p" and text not in (")", "]", "++", "--")

    def _template(self, text: str, at: int, end: int) -> int:
        holes, i = [], at + 1
        while i < end and text[i] != "`":
            if text[i] == "\\":
                i += 2
            elif text.startswith("${", i):
                stop = self._hole(text, i + 2, end)
                holes.append((i + 2, stop))
                i = stop + 1
            else:
                i += 1
        self.holes[at] = holes
        return min(i + 1, end)

    def _hole(self, text: str, at: int, end: int) -> int:
        depth = 0
        while at < end:
            c = text[at]
            if c == "`":
                at = self._template(text, at, end)
                continue
            if c in "'\"" and (m := TOKEN.match(text, at, end)):
                at = m.end()
                continue
            if c == "}" and depth == 0:
                return at
            depth += (c == "{") - (c == "}")
            at += 1
        return end


class Parser:
    def __init__(self, text: str, start: int = 0, end: int | None = None):
        self.src, self.t, self.i, self.errors = text, Tokens(text, start, len(text) if end is None else end), 0, []

    # ---- tokens

    def word(self, *texts: str) -> bool:
        return self.t.text[self.i] in texts and self.t.kind[self.i] in ("p", "name")

    def take(self, *texts: str) -> bool:
        if found := self.word(*texts):
            self.i += 1
        return found

    def need(self, text: str) -> None:
        if not self.take(text):
            raise SyntaxProblem(f"{text} expected at {self.t.start[self.i]}")

    def here(self) -> int:
        return self.t.start[self.i]

    def last(self) -> int:
        return self.t.end[self.i - 1] if self.i else self.here()

    def node(self, kind: str, start: int, **parts) -> Node:
        return Node(kind, start, self.last(), **parts)

    def name(self) -> Node:
        if self.t.kind[self.i] != "name":
            raise SyntaxProblem(f"name expected at {self.here()}")
        self.i += 1
        return Node("name", self.t.start[self.i - 1], self.t.end[self.i - 1], text=self.t.text[self.i - 1])

    # ---- statements

    def program(self) -> Node:
        start = self.here()
        return self.node("program", start, body=self.statements("end"))

    def statements(self, until: str) -> list[Node]:
        out = []
        while self.t.kind[self.i] != "end" and not (until == "}" and self.word("}")) and not (until == "case" and self.word("}", "case", "default")):
            began = self.i
            try:
                out.append(self.statement())
            except SyntaxProblem as e:
                self.errors.append((self.t.start[began], str(e)))
                self.skip(began)
        return out

    def skip(self, began: int) -> None:
        """To the next line or semicolon outside brackets opened since the statement began."""
        self.i = began
        while self.t.kind[self.i] != "end":
            text = self.t.text[self.i]
            self.i = self.t.close.get(self.i, self.i) + 1
            if text == ";" or self.t.fresh[self.i] or self.word("}"):
                break
        if self.i == began:
            self.i += 1

    def semicolon(self) -> None:
        if not self.take(";") and not (self.word("}") or self.t.fresh[self.i] or self.t.kind[self.i] == "end"):
            raise SyntaxProblem(f"; expected at {self.here()}")

    def block(self) -> Node:
        start = self.here()
        self.need("{")
        body = self.statements("}")
        self.need("}")
        return self.node("block", start, body=body)

    def follows(self, *texts: str) -> bool:
        return self.t.text[self.i + 1] in texts if self.i + 1 < len(self.t.kind) else False

    def statement(self) -> Node:
        start, text, is_name = self.here(), self.t.text[self.i], self.t.kind[self.i] == "name"
        if self.word("{"):
            return self.block()
        if self.take(";"):
            return self.node("empty", start)
        if is_name and text in ("var", "const") or is_name and text == "let" and (self.follows("[", "{") or self.t.kind[self.i + 1] == "name"):
            out = self.declaration()
            self.semicolon()
            return out
        if is_name and text == "async" and self.follows("function") or is_name and text == "function":
            return self.function()
        if is_name and (rule := getattr(self, f"on_{text}", None)) and not self.follows("=>", "=", ".", ":") :
            self.i += 1
            return rule(start)
        if is_name and self.follows(":"):
            self.i += 2
            return self.node("label", start, body=self.statement())
        value = self.sequence()
        self.semicolon()
        return self.node("expr", start, value=value)

    def declaration(self, can_in: bool = True) -> Node:
        start, made = self.here(), []
        self.i += 1
        while True:
            at = self.here()
            target = self.target()
            value = self.assignment(can_in) if self.take("=") else None
            made.append(self.node("declarator", at, target=target, value=value))
            if not self.take(","):
                return self.node("declaration", start, made=made)

    def target(self) -> Node:
        return self.primary() if self.word("[", "{") else self.name()

    def clause(self) -> Node:
        self.need("(")
        out = self.sequence()
        self.need(")")
        return out

    def on_if(self, start):
        test, then = self.clause(), self.statement()
        return self.node("if", start, test=test, then=then, other=self.statement() if self.take("else") else None)

    def on_while(self, start):
        return self.node("while", start, test=self.clause(), body=self.statement())

    def on_do(self, start):
        body = self.statement()
        self.need("while")
        test = self.clause()
        self.take(";")
        return self.node("do_while", start, body=body, test=test)

    def on_for(self, start):
        self.take("await")
        self.need("(")
        first = None
        if self.word("var", "let", "const"):
            first = self.declaration(False)
        elif not self.word(";"):
            first = self.sequence(False)
        if self.take("of", "in"):
            over = self.sequence()
            self.need(")")
            return self.node("for_in", start, first=first, over=over, body=self.statement())
        self.need(";")
        test = None if self.word(";") else self.sequence()
        self.need(";")
        step = None if self.word(")") else self.sequence()
        self.need(")")
        return self.node("for", start, first=first, test=test, step=step, body=self.statement())

    def on_switch(self, start):
        of, cases = self.clause(), []
        self.need("{")
        while not self.take("}"):
            at = self.here()
            test = None if self.take("default") else (self.need("case"), self.sequence())[1]
            self.need(":")
            cases.append(self.node("case", at, test=test, body=self.statements("case")))
        return self.node("switch", start, of=of, cases=cases)

    def on_try(self, start):
        body, caught, handler, last = self.block(), None, None, None
        if self.take("catch"):
            if self.take("("):
                caught = self.target()
                self.need(")")
            handler = self.block()
        if self.take("finally"):
            last = self.block()
        return self.node("try", start, body=body, caught=caught, handler=handler, last=last)

    def on_return(self, start, kind="return"):
        value = None if self.word(";", "}") or self.t.fresh[self.i] or self.t.kind[self.i] == "end" else self.sequence()
        self.semicolon()
        return self.node(kind, start, value=value)

    def on_throw(self, start):
        return self.on_return(start, "throw")

    def on_break(self, start):
        if self.t.kind[self.i] == "name" and not self.t.fresh[self.i]:
            self.i += 1
        self.semicolon()
        return self.node("jump", start)

    on_continue = on_debugger = on_break

    def on_export(self, start):
        self.take("default")
        return self.statement()

    def on_import(self, start):
        if self.word("("):
            self.i -= 1
            value = self.sequence()
            return self.node("expr", start, value=value)
        while not self.take(";") and not self.t.fresh[self.i]:
            self.i += 1
        return self.node("empty", start)

    def on_class(self, start):
        name = self.name() if self.t.kind[self.i] == "name" and not self.word("extends") else None
        parent = self.unary() if self.take("extends") else None
        return self.node("class", start, name=name, parent=parent, body=self.members())

    def members(self) -> list[Node]:
        self.need("{")
        out = []
        while not self.take("}"):
            if self.take(";"):
                continue
            if self.word("static") and self.follows("{"):
                self.i += 1
                out.append(self.block())
            else:
                out.append(self.member(True))
        return out

    # ---- functions

    def function(self) -> Node:
        start = self.here()
        self.take("async")
        self.need("function")
        self.take("*")
        name = self.name() if self.t.kind[self.i] == "name" else None
        return self.rest_of_function(start, name, "function")

    def rest_of_function(self, start: int, name: Node | None, kind: str) -> Node:
        params, body = self.params(), self.block()
        return self.node(kind, start, name=name, params=params, body=body)

    def params(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.take(")"):
            at = self.here()
            spread = self.take("...")
            target = self.target()
            value = self.assignment() if self.take("=") else None
            out.append(self.node("param", at, target=target, value=value, spread=spread))
            if not self.word(")"):
                self.need(",")
        return out

    def arrow(self, start: int) -> Node:
        self.take("async")
        if self.word("("):
            params = self.params()
        else:
            name = self.name()
            params = [Node("param", name.start, name.end, target=name, value=None, spread=False)]
        self.need("=>")
        body = self.block() if self.word("{") else self.assignment()
        return self.node("arrow", start, name=None, params=params, body=body)

    def is_arrow(self) -> bool:
        i = self.i + (self.word("async") and not self.t.fresh[self.i + 1] and (self.t.kind[self.i + 1] == "name" or self.follows("(")))
        if self.t.text[i] == "(":
            i = self.t.close.get(i, len(self.t.kind) - 2)
        elif self.t.kind[i] != "name":
            return False
        return self.t.text[min(i + 1, len(self.t.kind) - 1)] == "=>"

    # ---- expressions

    def sequence(self, can_in: bool = True) -> Node:
        start, one = self.here(), self.assignment(can_in)
        if not self.word(","):
            return one
        items = [one]
        while self.take(","):
            items.append(self.assignment(can_in))
        return self.node("sequence", start, items=items)

    def assignment(self, can_in: bool = True) -> Node:
        start = self.here()
        if self.is_arrow():
            return self.arrow(start)
        if self.word("yield") and not self.follows("=", ".", ")"):
            self.i += 1
            self.take("*")
            stop = self.word(")", "]", "}", ",", ";") or self.t.fresh[self.i]
            return self.node("unary", start, op="yield", value=None if stop else self.assignment(can_in))
        left = self.binary(0, can_in)
        if self.take("?"):
            then = self.assignment()
            self.need(":")
            return self.node("choice", start, test=left, then=then, other=self.assignment(can_in))
        if self.t.text[self.i] in ASSIGN and self.t.kind[self.i] == "p":
            op = self.t.text[self.i]
            self.i += 1
            return self.node("assign", start, op=op, target=left, value=self.assignment(can_in))
        return left

    def binary(self, least: int, can_in: bool) -> Node:
        start, left = self.here(), self.unary()
        while True:
            op = self.t.text[self.i]
            power = BINARY.get(op, 0) if self.t.kind[self.i] in ("p", "name") and (can_in or op != "in") else 0
            if power <= least:
                return left
            self.i += 1
            left = self.node("binary", start, op=op, left=left, right=self.binary(power - (op == "**"), can_in))

    def unary(self) -> Node:
        start, text = self.here(), self.t.text[self.i]
        if self.t.kind[self.i] in ("p", "name"):
            if text in UNARY or text == "await" and self.t.kind[self.i + 1] in ("name", "str", "tmpl") or text == "await" and self.follows("(", "["):
                self.i += 1
                return self.node("unary", start, op=text, value=self.unary())
            if text in ("++", "--"):
                self.i += 1
                return self.node("update", start, value=self.unary())
        out = self.postfix(self.primary(), start)
        if self.word("++", "--") and not self.t.fresh[self.i]:
            self.i += 1
            return self.node("update", start, value=out)
        return out

    def arguments(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.take(")"):
            at = self.here()
            spread = self.take("...")
            value = self.assignment()
            out.append(self.node("spread", at, value=value) if spread else value)
            if not self.word(")"):
                self.need(",")
        return out

    def postfix(self, of: Node, start: int, calls: bool = True) -> Node:
        while True:
            if self.take("?."):
                if self.word("("):
                    of = self.node("call", start, of=of, args=self.arguments())
                elif self.take("["):
                    index = self.sequence()
                    self.need("]")
                    of = self.node("index", start, of=of, index=index)
                else:
                    of = self.node("member", start, of=of, prop=self.name())
            elif self.take("."):
                of = self.node("member", start, of=of, prop=self.name())
                of.end = self.last()
            elif self.take("["):
                index = self.sequence()
                self.need("]")
                of = self.node("index", start, of=of, index=index)
            elif calls and self.word("("):
                args = self.arguments()
                of = self.node("call", start, of=of, args=args)
            elif self.t.kind[self.i] == "tmpl":
                args = [self.primary()]
                of = self.node("tagged", start, of=of, args=args)
            else:
                return of

    def primary(self) -> Node:
        start, kind, text = self.here(), self.t.kind[self.i], self.t.text[self.i]
        if kind in ("num", "re"):
            self.i += 1
            return self.node(kind, start)
        if kind == "str":
            self.i += 1
            return self.node("str", start, value=re.sub(r"\\(.)", r"\1", text[1:-1], flags=re.S))
        if kind == "tmpl":
            self.i += 1
            holes = [self.inner(a, b) for a, b in self.t.holes[start]]
            return self.node("tmpl", start, holes=[h for h in holes if h], value=None if self.t.holes[start] else text[1:-1])
        if kind == "name":
            if text == "function" or text == "async" and self.follows("function"):
                return self.function()
            if text == "class":
                self.i += 1
                return self.on_class(start)
            if text == "new":
                return self.new(start)
            if text in BEFORE_REGEX | {"if", "else", "for", "while", "switch", "var", "const", "catch", "finally"} and text != "of":
                raise SyntaxProblem(f"expression expected at {start}")
            return self.name()
        if self.take("("):
            value = self.sequence()
            self.need(")")
            return self.node("paren", start, value=value)
        if self.take("["):
            items, holes = [], 0
            while not self.take("]"):
                if self.take(","):
                    holes += 1
                    continue
                at = self.here()
                spread = self.take("...")
                value = self.assignment()
                items.append(self.node("spread", at, value=value) if spread else value)
                if not self.word("]"):
                    self.need(",")
            return self.node("array", start, items=items, holes=holes)
        if self.take("{"):
            items = []
            while not self.take("}"):
                items.append(self.member(False))
                if not self.word("}"):
                    self.need(",")
            return self.node("object", start, items=items)
        raise SyntaxProblem(f"expression expected at {start}")

    def inner(self, start: int, end: int) -> Node | None:
        sub = Parser(self.src, start, end)
        try:
            return sub.sequence() if sub.t.kind[0] != "end" else None
        except SyntaxProblem as e:
            self.errors.append((start, str(e)))
            return None

    def new(self, start: int) -> Node:
        self.i += 1
        if self.take("."):
            return self.node("member", start, of=Node("name", start, start + 3, text="new"), prop=self.name())
        at = self.here()
        of = self.new(at) if self.word("new") else self.postfix(self.primary(), at, calls=False)
        return self.node("new", start, of=of, args=self.arguments() if self.word("(") else [])

    def member(self, in_class: bool) -> Node:
        """A member of an object or a class: pair, short, method, spread; key is null where computed."""
        start = self.here()
        if self.take("..."):
            return self.node("spread", start, value=self.assignment())
        for mark in ("static", "async", "get", "set"):
            if self.word(mark) and not self.follows("(", ",", "}", ":", "=", ";"):
                self.i += 1
        self.take("*")
        key, computed = None, None
        if self.take("["):
            computed = self.assignment()
            self.need("]")
        elif self.t.kind[self.i] in ("name", "num", "str"):
            key = self.t.text[self.i].strip("'\"") if self.t.kind[self.i] == "str" else self.t.text[self.i]
            self.i += 1
        else:
            raise SyntaxProblem(f"member expected at {start}")
        if self.word("("):
            body = self.rest_of_function(start, None, "function")
            return self.node("method", start, key=key, computed=computed, value=body)
        if not in_class and self.take(":"):
            return self.node("pair", start, key=key, computed=computed, value=self.assignment())
        value = self.assignment() if self.take("=") else None
        if in_class:
            self.take(";")
            return self.node("field", start, key=key, computed=computed, value=value)
        return self.node("short", start, key=key, value=value)


def parse(text: str, start: int = 0, end: int | None = None) -> tuple[Node, list[tuple[int, str]]]:
    """The tree of text[start:end], its offsets those of the whole text, and (offset, message) of what is no script."""
    p = Parser(text, start, end)
    try:
        return p.program(), p.errors
    except RecursionError:
        return Node("program", start, start, body=[]), [(start, "nested too deep")]
