"""Files of one shape give the facts that parsing each of them gives; only a few of them are parsed."""

import re
from pathlib import Path

import pytest

from quillspan.functions import extract, shapes
from quillspan.functions.extract import facts_of

TEXTS = [
    ("gs", "/** Gives {@link f%s}.\n * @param {T%s} p%s it\n * @returns {{z%s: number, a%s: T}} */\nfunction f%s(p%s, b) {\n  // g%s\n  const v = S.getSheetByName('x%s').getValues();\n  v.forEach(r => { r[12] = r[3]; s.getRange(1, 1).setFormulaR1C1('k%s'); });\n  return {z%s: `${f%s(1)}{}`, a%s: [p%s.q%s], 77: 0x%s};\n}"),
    ("html", "<p><?= data.t%s ?><h1>n%s</h1></p>\n<script>\nfunction show%s(o) { alert(o.a%s); }\ngoogle.script.run.withSuccessHandler(show%s).get%s('x%s', 33);\n</script><a href='u%s'>"),
    ("gs", "function f%s( { broken%s }\nfunction g%s() { return DriveApp.getFileById('aaaaaaaaaaaaaaaaaaaaaaaa%s'); }"),
]
NUMBERS = ["10", "99", "37", "10", "123", "4567", "12", "98", "7", "11"]


def found(memory: shapes.Shapes, kind: str, content: str) -> list[tuple]:
    columns = [["before"] for _ in range(extract.WIDTH)]
    n = memory.add(kind, content, columns)
    assert all(c[0] == "before" and len(c) == n + 1 for c in columns)
    return list(zip(*columns))[1:]


def numbered(text: str, start: int, equal: bool) -> str:
    n = iter(range(start, start + 99))
    return re.sub("%s", lambda m: NUMBERS[(start if equal else next(n)) % len(NUMBERS)], text)


@pytest.mark.parametrize("kind,text", TEXTS)
def test_shapes_equal_parsing(kind, text):
    memory = shapes.Shapes()
    contents = [numbered(text, i, equal) for equal in (True, False) for i in range(10)] * 2 + [text, text + "\\x41", ""]
    for c in contents:
        assert found(memory, kind, c) == list(facts_of(kind, c))


def test_one_shape_is_parsed_twice(monkeypatch):
    parsed = []
    monkeypatch.setattr(shapes, "undigested_facts", lambda kind, content: parsed.append(content) or extract.undigested_facts(kind, content))
    memory = shapes.Shapes()
    for i in range(1000, 1500):
        found(memory, "gs", f"function f{i}(a) {{ return g{i}(a); }}")
    assert len(parsed) == 2


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(shapes, "CHARACTERS", 1000)
    memory = shapes.Shapes()
    for i in range(200):
        found(memory, "gs", f"function f() {{ return {i}; }}")
    assert memory.size <= 1000 and memory.size == sum(s.size for s in memory.seen.values())


def test_only_wanted_facts():
    kind, text = TEXTS[0]
    memory, some = shapes.Shapes(frozenset(["call", "file"])), lambda c: [f for f in facts_of(kind, c) if f[0] in ("call", "file")]
    for i in range(6):
        assert found(memory, kind, numbered(text, i, False)) == some(numbered(text, i, False)) != []


def test_the_parser_knows_no_numbered_name():
    """A name with two or more digits that the parser gave a meaning would have to keep them."""
    for module in ("extract", "script"):
        source = re.sub(r"\\u[0-9a-f]{4}|# noqa.*", "", (Path(extract.__file__).parent / f"{module}.py").read_text())
        assert set(re.findall(r"[A-Za-z_$]+[0-9]{2,}", source)) <= {"sha256"}


def test_scripts_of_orders_are_parsed_once_for_a_shape(monkeypatch):
    """As the catalog renders them: a parse for every text would be one for each of 2000 orders."""
    parsed = []
    monkeypatch.setattr(shapes, "undigested_facts", lambda kind, content: parsed.append(content) or extract.undigested_facts(kind, content))
    memory = shapes.Shapes()
    for k in range(0, 2_000_000, 1000):
        code = f"/** Order. */\nfunction f{k}(a, b) {{\n  if (a > 1) {{ return g{k}(a, 'x)'); }}\n  return null;\n}}\nconst g{k} = x => ({{id: x, s: `${{f{k}(x, 1)}}`}});\n"
        assert len(found(memory, "gs", code)) == 8
    assert len(parsed) < 20


def test_edited_scripts_are_few_shapes(monkeypatch):
    """An edit that many scripts got is one more shape, also where digits differ in number."""
    parsed = []
    monkeypatch.setattr(shapes, "undigested_facts", lambda kind, content: parsed.append(content) or extract.undigested_facts(kind, content))
    memory = shapes.Shapes()
    for k in range(10_007, 2_000_000, 3000):
        text = f"function f{k}(a) {{ return g{k}(a); }}\n" + ("function more() { return f(1); }\n" if k % 100 == 7 else "")
        assert found(memory, "gs", text) == list(facts_of("gs", text))
    assert len(parsed) <= 20
