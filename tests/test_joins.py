"""Similarity, substring and prefix joins, walks, kept counts, places and texts against brute force."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspan.functions.text import normalised, short_hash
from quillspan.operators import deltas, patterns, production, walks
from quillspan.operators import relations as op
from quillspan.operators.similarity import similar_names


def edits(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_similar_names(spark):
    """5000 random names, short and long ones, of few letters, in both cases; 300 of them are looked through by hand."""
    rng = random.Random(3)
    parts = ["get", "set", "row", "user", "Cell", "mail", "Sheet", "x", "é", "fo", "bar", "Up", "date"]
    names = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(9000)} | {"".join(rng.choice("abcAB") for _ in range(rng.randint(0, 7))) for _ in range(900)}
    names = sorted(names, key=lambda n: (len(n) > 7, rng.random()))[:5000]
    df = spark.createDataFrame([*enumerate(names), (-1, None)], "id long, name string")
    found = similar_names(df, df, "name", 3)
    assert not any(x in plan_of(found) for x in ("NestedLoop", "Cartesian"))
    got = {}
    for r in found.collect():
        got.setdefault(r.id, []).append((r.place, r.distance, r.other))
    assert -1 not in got
    for i in [*rng.sample(range(len(names)), 250), *[i for i, n in enumerate(names) if len(n) < 3]]:
        a, low = names[i], names[i].lower()
        most = max(2, len(a) // 3)
        near = [(edits(low, b.lower(), 99 if low in b.lower() else most), b) for b in names if b != a]
        want = sorted(x for x in near if x[0] <= most or low in x[1].lower())[:3]
        assert sorted(got.get(i, [])) == [(k + 1, *x) for k, x in enumerate(want)], a


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé d\n𝔘") for _ in range(n))
    return [(i % 50, word(rng.randint(0, 400))) for i in range(120)] + [(1, None), (2, ""), (3, "a"), (3, "a")], rng, word


def test_patterns_of_any_length(spark, texts):
    rows, rng, word = texts
    known = [t[i : i + n] for _, t in rows if t for i, n in [(rng.randrange(len(t)), rng.choice([1, 3, 7, 8, 9, 20, 30, 31, 32, 60, 100]))]]
    known += [word(n) for n in (1, 2, 5, 8, 30, 31, 40)] + ["", None]
    df, p = spark.createDataFrame(rows, "id long, t string"), spark.createDataFrame([(x,) for x in known], "p string")
    want = sorted((i, t, x) for i, t in rows if t is not None for x in set(known) if x and x in t)
    assert sorted(map(tuple, patterns.containing(df, "t", p, "p").collect())) == want and len(want) > 500
    assert patterns.containing(df, "t", p.where("p = ''"), "p").count() == 0
    long_id, short_id = "Z" * 40, "q7"
    lines = spark.createDataFrame([(1, f"x{long_id}y"), (2, "aq7b"), (3, "Q7")], "id int, t string")
    ids = spark.createDataFrame([(long_id,), (short_id,)], "p string")
    assert sorted((r.id, r.p) for r in patterns.containing(lines, "t", ids, "p").collect()) == [(1, long_id), (2, short_id)]


def test_longest_prefixes(spark, texts):
    rows, rng, _ = texts
    listed = [t[: rng.randint(0, 12)] for _, t in rows if t][:60]
    df = spark.createDataFrame(rows, "id long, t string")
    for known in ([*listed, None], [x for x in listed if x]):
        best = lambda t: max((x for x in known if x is not None and t is not None and t.startswith(x)), key=len, default=None)
        got = patterns.longest_prefixes(df, "t", spark.createDataFrame([(x,) for x in known], "p string"), "p").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str((i, t, best(t))) for i, t in rows)
    assert {r.p for r in patterns.longest_prefixes(df, "t", spark.createDataFrame([], "p string"), "p").collect()} == {None}


def test_walks_of_any_length(spark):
    rng = random.Random(5)
    types = "ABCDE"
    registry = {(a, s): rng.choice(types) for a in types for s in "xyzuvw" if s in "xy" or rng.random() < 0.93}
    chains = ["".join(rng.choice("xyzuvw") for _ in range(rng.choice([0, 1, 2, 5, 63, 64, 65, 300]))) for _ in range(100)]
    chains += ["".join(rng.choice("xy") for _ in range(n)) for n in (1, 64, 4096, 4097, 5000)] + ["xq", "q"]
    steps = spark.createDataFrame([(i, k, s) for i, c in enumerate(chains) for k, s in enumerate(c)] + [(1000, 0, None)], "chain long, pos long, step string")
    roots = spark.createDataFrame([(i, types[i % 5]) for i in range(len(chains))] + [(1000, "A")], "chain long, type string")
    table = spark.createDataFrame([(a, s, t) for (a, s), t in registry.items()], "type string, step string, returns string")

    def go(a, c):
        for k, s in enumerate(c):
            if (a, s) not in registry:
                return a, k, True
            a = registry[a, s]
        return a, len(c), False

    got = sorted(map(tuple, walks.walk(steps, roots, table).collect()))
    assert got == sorted([(i, *go(types[i % 5], c)) for i, c in enumerate(chains)] + [(1000, "A", 0, True)])


def test_kept_counts(spark):
    rng = random.Random(7)
    rows = [(rng.choice("abcdef"), rng.randrange(9)) for _ in range(200)] + [(None, 1)]
    gone, come = rng.sample(rows, 60) + [(None, 1)], [(rng.choice("abgh"), rng.randrange(9)) for _ in range(50)]
    frame = lambda r: spark.createDataFrame(r, "k string, m int")
    after = list(rows)
    for x in gone:
        after.remove(x) if x in after else None
    after += come
    gone = [x for x in gone if x is not None]
    edges = deltas.edge_counts(frame(rows), ["k"], ["m"])
    delta = deltas.signed(frame(gone), frame(come), ["k", "m"])
    got = deltas.maintained_members(deltas.members(edges, ["k"]), edges, delta, ["k"], ["m"])
    want = deltas.members(deltas.edge_counts(frame(after), ["k"], ["m"]), ["k"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "c" in {r.k for r in got.collect()}


def test_places_as_readers_have_them(spark):
    rows = list(enumerate(["b", "a", "B", "á", "A", "é", "Z", "z", None, "a", "_", "1"]))
    got = sorted(op.in_order(spark.createDataFrame(rows, "i int, s string"), "s", "place", "i").collect(), key=lambda r: r.place)
    assert [r.s for r in got] == [None, "_", "1", "a", "a", "A", "á", "b", "B", "é", "z", "Z"] and [r.place for r in got] == list(range(1, 13))


def test_first_rows_of_a_key(spark):
    rows = [(i % 3, i * 7 % 50) for i in range(50)] + [(None, 1), (None, 0)]
    found = op.first_by_key(spark.createDataFrame(rows, "k int, v int"), ["k"], ["v"], 4, "first", "total")
    assert "WindowGroupLimit" in plan_of(found)
    want = {k: (sorted(v for q, v in rows if q == k)[:4], sum(q == k for q, _ in rows)) for k in (0, 1, 2, None)}
    assert {r.k: ([x.v for x in r["first"]], r.total) for r in found.collect()} == want


def test_trailing_days(spark):
    rows = [("f", "FAILED" if d % 4 == 0 else "COMPLETED", d) for d in (0, 0, 1, 5, 5, 5, 9)] + [("g", "COMPLETED", 12)]
    log = spark.createDataFrame(rows, "function string, status string, d int").selectExpr("function", "status", "timestamp_seconds(1700000000 + d * 86400) as started")
    got = {(r.function, i % 13): (r.runs, r.errors, r.heat) for i, r in enumerate(production.trailing(log, ["function"], 5).orderBy("function", "day").collect())}
    for f in "fg":
        for d in range(13):
            runs = [r for r in rows if r[0] == f and d - 5 < r[2] <= d]
            want = len(runs), sum(r[1] == "FAILED" for r in runs)
            assert got[f, d] == (*want, "cold" if not runs else "hot" if len(runs) >= 5 else "warm")


def test_needs_of_all_scripts(spark):
    """Marks go, letters and digits of any script stay; ids are those of scripts' 32-bit numbers."""

    def short(s):
        h, data, out = 5381, s.encode("utf-16-le"), ""
        for i in range(0, len(data), 2):
            h = ((h * 33) ^ int.from_bytes(data[i : i + 2], "little")) & 0xFFFFFFFF
        while h:
            h, k = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[k] + out
        return out

    want = {"привет мир": "привет мир", "До свидания!": "до свидания", "你好": "你好", "Ça  va, là-bas?": "ca va la bas", "Ελληνικά ΆΈ": "ελληνικα αε", "عَرَبِيّ": "عربي", "a^b `c": "ab c", "Straße": "straße", "naïve": "naive", "": "", "!!": "", "𝔘𝔫 x😀y": "𝔘𝔫 x y", "й": "и", "한국어": "한국어"}
    want |= {unicodedata.normalize("NFD", k): v for k, v in list(want.items()) if k != "한국어"}
    rows = spark.createDataFrame([(k,) for k in want], "s string").select("s", normalised(F.col("s")).alias("n"), short_hash(F.col("s")).alias("h")).collect()
    assert {r.s: r.n for r in rows} == want and all(r.h == short(r.s) for r in rows)
    counted = op.upsert_counts(spark.createDataFrame([("привет мир", 1, 1), ("до свидания", 2, 1), ("你好", 3, 1), ("Привет, мир", 4, 1)], "text string, conv_id int, turn int"), "text", ["conv_id", "turn"]).collect()
    assert sorted((r.need, r.occurrences, r.first_seen, r.last_seen) for r in counted) == [("до свидания", 1, 2, 2), ("привет мир", 2, 1, 4), ("你好", 1, 3, 3)]


def test_merged_lists_keep_what_is_there(spark):
    from quillspan.operators.workspace import merged_settings

    schema = "k string, allow array<string>, mode string"
    old = spark.createDataFrame([("a", ["x", "y", "x"], None), ("b", None, "m"), ("c", ["q"], "n")], schema)
    new = spark.createDataFrame([("a", ["z", "y", "z"], "g"), ("b", ["w"], "g"), ("d", ["v"], None)], schema)
    got = {r.k: (r.allow, r["mode"]) for r in merged_settings(old, new, "k", ["allow"], ["mode"]).collect()}
    assert got == {"a": (["x", "y", "x", "z"], "g"), "b": (["w"], "m"), "c": (["q"], "n"), "d": (["v"], None)}


def test_checks_of_documentation_by_name(spark):
    from quillspan.operators import facts as fs
    from quillspan.plans import rules

    code = "/** A.\n * @param {number} q\n */\nfunction a(x) {}\nfunction b_() {}\nfunction e() {}"
    store = fs.facts(spark.createDataFrame([("p", "m.gs", "gs", code)], "project string, file string, kind string, content string"))
    told = lambda *a, **b: sorted((r.kind, r.symbol) for r in rules.doc_rules(store, *a, **b).collect())
    assert told() == [("doc.param_drift", "a"), ("doc.undocumented", "b_"), ("doc.undocumented", "e")]
    assert told(["undocumented"], public_only=True) == [("doc.undocumented", "e")] and told(["drift"]) == [("doc.param_drift", "a")]
    with pytest.raises(ValueError):
        rules.doc_rules(store, ["spelling"])


def test_first_handler_of_a_name_counts(spark):
    from quillspan.operators import facts as fs

    page = "<script>\nfunction show(o) { use(o.a); }\nfunction show(p) { use(p.b); }\ngoogle.script.run.withSuccessHandler(show).load(1);\n</script>"
    rows = [("p", "m.gs", "gs", "function load(x) { return x; }"), ("p", "page.html", "html", page)]
    reads = fs.field_reads(fs.facts(spark.createDataFrame(rows, "project string, file string, kind string, content string"))).collect()
    assert [(r.symbol, r.field, r.line) for r in reads] == [("load", "a", 2)]


def test_types_of_documentation():
    from quillspan.functions.codegen import declared_type

    cases = {None: "unknown", " ": "unknown", "any": "unknown", "*": "unknown", "Object": "object", "Order": "Order", "Base.Blob": "Base.Blob", "Array<Array<object>>": "object[][]", "{a: T, b?: U}": "{ a: T; b?: U }", "string|null": "string|null", "Array<>": "Array<>"}
    assert {k: declared_type(k) for k in cases} == cases
