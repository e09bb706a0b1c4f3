"""Operators 11 to 13 against brute force, on small tables with every odd case."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspan.llm import kmeans, merkle, substring

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, i int, n int, h string, path string, group string, leaf string, end int, m long"
EXTRA = (1, 2, "h", "p", "g", "l", 3, 4)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeéñß"), rng.integers(1, 7))) for _ in range(300)]
    draw = lambda n: list(rng.choice(words, n))
    shared, other, short = draw(60), draw(120), draw(34)
    texts = [" ".join(draw(rng.integers(1, 150))) for _ in range(40)]
    texts += [" ".join(draw(20) + shared[rng.integers(0, 20) :][: rng.integers(20, 60)] + draw(15)) for _ in range(25)]
    texts += [" ".join(other[: i] + ["changed"] + other[i + 1 :]) for i in range(0, 120, 9)]
    texts += ["\n".join(draw(3) + short + draw(4)) for _ in range(4)] + [" ".join(draw(80))] * 3
    texts += [None, "", " \n", "a", "word " * 3000, "x" * 5000, "ab " * 35, "ab " * 34, "\t".join(shared) + "\n" + " ".join(shared), " ".join(draw(20_000)) + " " + " ".join(other)]
    out = [(None if i % 31 == 30 else i, t, ("en", None)[i % 2], ("s1", "s2", None, "s1", "é")[i % 5], None if i % 7 == 3 else i, *EXTRA) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (5, "another text of id 5", None, "s1", 1, *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def brute_repeats(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), sorted(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("shard, task, block", [(substring.SHARD_WINDOWS, substring.TASK_WINDOWS, substring.BLOCK), (5, 40, 30)])
def test_repeats(docs, rows, empty, monkeypatch, shard, task, block):
    """With the registered bounds, and with so small ones that shards, hot anchors and long documents are cut many times."""
    monkeypatch.setattr(substring, "SHARD_WINDOWS", shard)
    monkeypatch.setattr(substring, "TASK_WINDOWS", task)
    monkeypatch.setattr(substring, "BLOCK", block)
    want = sorted((str(r[0]), n, len(gone), hashlib.sha256(kept.encode()).hexdigest()) for r, (n, gone, kept) in zip(rows, brute_repeats([r[1] for r in rows], 35)))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeats_digest(docs).collect())
    assert got == want
    assert not substring.repeats_digest(empty).collect()


def test_spans_and_kept_text(docs, rows):
    got = {(r.doc_id, r.kept_text, tuple((s["start"], s["end"]) for s in r.spans)) for r in substring.without_repeats(docs, window=12, anchor=3).collect()}
    for r, (_, gone, kept) in zip(rows, brute_repeats([r[1] for r in rows], 12)):
        ends = tuple(substring.merged([(i, i + 1) for i in gone]))
        assert (r[0], kept, ends) in got


def test_automaton_against_all_substrings():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sequences = [rng.integers(0, 3, rng.integers(1, 25)).tolist() for _ in range(3)]
        automaton = substring.SuffixAutomaton()
        for s in sequences:
            automaton.add(s)
        have = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i, len(s) + 1)}
        text, least = rng.integers(0, 3, 60).tolist(), 5
        covered = {i + k for i in range(len(text)) for n in range(least, 26) if i + n <= len(text) and tuple(text[i : i + n]) in have for k in range(n)}
        assert {i for a, b in automaton.spans(text, least) for i in range(a, b)} == covered


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 40, 3000).astype(np.uint64)
    bounds = np.array([0, 10, 10, 1200, 1234, 3000])
    owner, pos, n, m = substring.anchored(h, bounds, 35, 8)
    of = {(o, p + k): x for o, p, n_, x in zip(owner, pos, n, m) for k in range(n_)}
    assert set(of) == {(k, p) for k in range(5) for p in range(max(0, bounds[k + 1] - bounds[k] - 34))}
    short = substring.shingles(h, 8)
    for (k, p), x in of.items():
        assert x == short[bounds[k] + p : bounds[k] + p + 28].min()


def brute_clusters(vectors, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        c = [[sum(x) // len(x) for x in zip(*[v for (_, v), a in zip(kept, at) if a == j])] if j in at else c[j] for j in range(len(c))]
    at = assign()
    d = [far(v, c[a]) for (_, v), a in zip(kept, at)]
    per = Counter()
    for a, x in zip(at, d):
        per[a] += x
    return sorted((str(i), a, x, per[a], sum(d), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, at, d))


def cluster_rows(spark, vectors, **more):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in vectors], "vec_id long, embedding array<float>, cluster string, v string").repartition(3)
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in kmeans.cluster_digest(df, **more).collect())


def test_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 64)) / 8
    vectors = [(i, (centres[i % 12] + rng.normal(size=64) / 30).tolist()) for i in range(600)]
    vectors += [(1000 + i, (np.round(rng.normal(size=64)) / 64).tolist()) for i in range(200)]  # many ties
    vectors += [(7, vectors[7][1]), (7, vectors[8][1]), (None, vectors[9][1])] + [(3000 + i, [0.0] * 64) for i in range(20)]
    vectors += [(2000, None), (2001, [0.1] * 63), (2002, []), (2003, [None] + [0.1] * 63), (2004, [float("nan")] + [0.1] * 63), (2005, [float("inf")] * 64), (2006, [0.1] * 65)]
    for rounds in (3, 12):
        assert cluster_rows(spark, vectors, rounds=rounds) == brute_clusters(vectors, rounds=rounds)
    assert cluster_rows(spark, vectors[:5]) == brute_clusters(vectors[:5])
    assert cluster_rows(spark, [(1, [0.5] * 64), (2, None)]) == brute_clusters([(1, [0.5] * 64)])
    assert cluster_rows(spark, [(2, None)]) == [] and cluster_rows(spark, []) == []
    big = [(i, [float(x) for x in rng.integers(-(1 << 20), 1 << 20, 64)]) for i in range(50)]
    assert cluster_rows(spark, big) == brute_clusters(big)
    assert len(cluster_rows(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)])) == 2


def test_bounds_spare_scans_and_stay_exact():
    """Bounds after several moves give what whole scans give; some vectors are settled without a scan."""
    rng = np.random.default_rng(6)
    v, c = rng.integers(-60, 60, (3000, 64)), rng.integers(-60, 60, (16, 64))
    v[:2000] = c[rng.integers(0, 16, 2000)] + rng.integers(-9, 9, (2000, 64))
    state, kept, spared = kmeans.Bounds.scanned(v, c, 4), 4, 0
    for k in range(8):
        new = c + rng.integers(-4, 5, c.shape) * (rng.random((16, 1)) < 0.7)
        drift = np.sqrt(((new - c) ** 2).sum(axis=1).astype(float)) * (1 + 1e-9)
        c = new
        before = state.up.copy()
        if k == 4:
            state.fewer(2)
        state.moved(v, c, drift)
        d = kmeans.squares(v, c)
        assert (state.own == d.argmin(axis=1)).all() and (state.up * (1 + 1e-9) + 1e-9 >= np.sqrt(d.min(axis=1))).all()
        spared += int((state.up == before + drift[state.own]).sum())
    assert spared > 1000


def _h(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def brute_manifest(rows):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: _h(told(r[0]), told(r[3]), told(r[2]), told(r[4]), told(text))

    def climb(nodes):
        """The root, and each node's path: (before, after) of each level."""
        paths, owners, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], nodes
        while len(level) > 1:
            up, own = [], []
            for p in range(0, len(level), 3):
                run = level[p : p + 3]
                for k in range(len(run)):
                    for o in owners[p + k]:
                        paths[o].append(("".join(run[:k]), "".join(run[k + 1 :])))
                up.append(_h(*run))
                own.append([o for x in owners[p : p + 3] for o in x])
            level, owners = up, own
        return level[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees.append(climb([x[0] for x in groups[s]]))
    root, tops = climb([t[0] for t in trees])
    out = []
    for s, (sub, paths), top in zip(names, trees, tops):
        for (own, r), path in zip(groups[s], paths):
            text = r[1]
            if zlib.crc32((str(r[0]) if r[0] is not None else "").encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            x = leaf(r, text)
            for before, after in path + top:
                x = _h(before, x, after)
            out.append((str(r[0]), own, sub, root, _h(*[b + a for b, a in path + top]), x, x == root))
    return sorted(out)


def test_manifest(docs, rows, empty, spark):
    read = lambda df: sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.manifest_digest(df).collect())
    got = read(docs)
    assert got == brute_manifest(rows) and {r[-1] for r in got} == {True, False}
    assert read(empty) == []
    for n in (1, 2, 4):  # lone leaves, lone sources
        assert read(spark.createDataFrame(rows[:n], COLUMNS)) == brute_manifest(rows[:n])
    one = [(*r[:3], "one", *r[4:]) for r in rows]
    assert read(spark.createDataFrame(one, COLUMNS)) == brute_manifest(one)
