"""Relational operators against brute force."""

from quillspan.operators import relations as op


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_names_searches_all_names(spark):
    names = ["red plate", "small widget", "old rod", "Old Rod", "rod", "getSheet", "GETSHEET", "getSheetByName", "sheet", "openById", "openbyid", "x", "", "completelyOther", "red plates", None]
    df = spark.createDataFrame(list(enumerate([*names, "rod"])), "id int, name string").repartition(3)
    got = {}
    for r in op.similar_names(df, df, "name", 3).collect():
        got.setdefault(r.id, []).append((r.place, r.distance, r.other))
    known = {n for n in names if n is not None}
    for i, n in enumerate([*names, "rod"]):
        far = {o: distance(n.lower(), o.lower()) for o in known - {n}} if n is not None else {}
        near = sorted((k, o) for o, k in far.items() if k <= max(2, len(n) // 3) or n.lower() in o.lower())
        assert sorted(got.get(i, [])) == [(p, *x) for p, x in enumerate(near[:3], 1)]
    assert (1, 0, "Old Rod") in got[2] and "getSheetByName" in [o for *_, o in got[5]]
