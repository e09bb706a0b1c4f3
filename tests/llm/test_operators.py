"""The training-data operators against brute force, on a small table with every odd case."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from quillspan.llm import bpe, embed_dedup, fingerprints, idcoder, langid, minhash, mixing, quality, sharding, token_binary, token_count
from quillspan.llm.components import components
from quillspan.llm.tokenizer_files import tokenizer_json

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard int, component string, size string, k string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeéñß"), rng.integers(1, 8))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(5, 120))) for _ in range(60)]
    near = texts[0].split() + list(rng.choice(words, 60))
    texts += [" ".join([*near[:i], "changed", *near[i + 1 :]]) for i in range(0, len(near), 4)] + [" ".join(near)] * 5
    texts += [None, "", " ", "a", "one two", "A B\tc\nd", "<|endoftext|> x", "!!! 123", "word " * 30_000, "x" * 5000]
    out = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", None, "s1")[i % 4], None if i % 5 else len(t or ""), 1, "c", "s", "k") for i, t in enumerate(texts)]
    return [*out, out[3], out[3]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def jump(key, shards):
    b, j = -1, 0
    key %= 1 << 64
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(docs, rows, empty):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows) and not sharding.shard_documents(empty).collect()
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        data = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.shard, r.grown_shard) == (len(data) + 8, zlib.crc32(data), jump(r.doc_id, 24), jump(r.doc_id, 25))
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


def test_mixing(docs, rows, empty):
    got = mixing.mix_digest(docs).collect()
    assert len(got) == len(rows) and not mixing.mix_digest(empty).collect()
    source = {r[0]: r[3] for r in rows}
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    mixed = mixing.mixed_rows(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(count(r.text) for r in mixed) == sum(taken.values()) and set(mixed[0].asDict()) == set(docs.columns)


@pytest.mark.parametrize("operator", [lambda d: token_count.token_counts(d, tokenizer_json(name="word_bpe_49k.json"))])
def test_token_counts(docs, rows, empty, operator):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json(name="word_bpe_49k.json"))
    got = by_id(operator(docs))
    for r in rows:
        assert got[r[0]]["n_tokens"] == len(t.encode(r[1] or "", add_special_tokens=False).ids)
    assert not operator(empty).collect()


def test_bpe_and_token_files(docs, rows, empty):
    from tokenizers import Tokenizer

    spec = tokenizer_json()
    t = Tokenizer.from_str(spec)
    got = by_id(bpe.round_trip(docs, spec))
    ids = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    for k, x in ids.items():
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()
    files = sorted(token_binary.ids_digest(docs, spec).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in files] == sorted(r[0] for r in rows)
    at = 0
    for r in files:
        x = np.array([*ids[r.doc_id], 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    assert not bpe.round_trip(empty, spec).collect() and not token_binary.ids_digest(empty, spec).collect()


def test_range_coder_and_damage():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 65536, n) for n in (0, 1, 2, 50, 2048)] + [np.zeros(300, int), np.full(100, 65535), np.tile([1, 2, 3], 500)]
    counts = np.bincount(np.concatenate(blocks), minlength=65536)
    files = [idcoder.Frequencies(idcoder.Frequencies.levels(counts), int(counts.sum())), idcoder.Frequencies(idcoder.Frequencies.levels(np.ones(5, int)), 1500)]
    blocks.append(np.tile([1, 2, 3], 500))
    owner = [0] * (len(blocks) - 1) + [1]
    code = idcoder.encode(blocks, files, owner)
    assert all((a == b).all() for a, b in zip(blocks, idcoder.decode(code, [len(b) for b in blocks], files, owner)))
    assert len(code[-1]) < 150 and not idcoder.encode([], [], []) and not idcoder.decode([], [], [], [])
    data = token_binary.write_files([([5, None], [np.array([7, 7, 9], np.uint32), np.array([1], np.uint32)])])[0]
    (docs, ids), = token_binary.read_files([data])
    assert docs == [5, None] and [x.tolist() for x in ids] == [[7, 7, 9], [1]]
    with pytest.raises(ValueError):
        token_binary.read_files([data[:-9] + bytes([data[-9] ^ 255]) + data[-8:]])


def test_files_of_any_number_of_distinct_ids():
    ids = [np.random.default_rng(1).permutation(150_000).astype(np.uint32), np.array([149_999, 5, 5], np.uint32)]
    (docs, back), = token_binary.read_files(token_binary.write_files([([1, 2], ids)]))
    assert docs == [1, 2] and all((a == b).all() for a, b in zip(ids, back))


def test_files_of_real_text_are_smaller_than_order_0():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    library = token_binary.Library(tokenizer_json())
    ids = [np.append(x, np.uint32(2)) for x in library.many(texts)]
    data = token_binary.write_files([(list(range(len(ids))), ids)])
    flat = np.concatenate(ids)
    n = np.unique(flat, return_counts=True)[1]
    order_0 = -float((n * np.log2(n / n.sum())).sum())
    assert 8 * len(data[0]) < 0.98 * order_0  # with the header's tables
    assert all((a == b).all() for a, b in zip(ids, token_binary.read_files(data)[0][1], strict=True))


def sets_of(rows, size):
    out = {}
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes((r[1] or "").encode()).lower())
        out[r[0]] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    return out


def least_reachable(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_minhash(docs, rows, empty):
    sets = sets_of(rows, 4)
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = least_reachable(ids, linked)
    out = minhash.near_duplicates(docs)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert not minhash.near_duplicates(empty).collect()


def test_large_clusters_are_cut_without_loss(docs, rows, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 4)
    monkeypatch.setattr(minhash, "BUCKET_DOCS", 3)
    sets = sets_of(rows, 4)
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = least_reachable(ids, linked)
    assert all(r.component_id == want[r.doc_id] for r in minhash.near_duplicates(docs).collect())


def test_pairs_of_groups_and_of_blocks():
    i, j = minhash.pairs_of_groups(np.array([3, 1, 2]))
    assert list(zip(i.tolist(), j.tolist())) == [(0, 1), (0, 2), (1, 2), (4, 5)]
    assert len(minhash.pairs_of_groups(np.zeros(0, np.int64))[0]) == 0


def test_documents_that_share_no_link_are_hardly_compared(spark, monkeypatch):
    """3000 documents, each of two texts half alike: of millions of pairs few are verified, and the near copies among them are found."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(words, 60))
    texts = [" ".join(base + list(rng.choice(words, 55))) for _ in range(3000)]  # a similarity of about 0.35 to each other
    texts += [t + " more" for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    met, tasks = [], minhash._class_tasks
    monkeypatch.setattr(minhash, "_class_tasks", lambda rows, num, den: (met.append(rows.count()), tasks(rows, num, den))[1])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert all(got[i] == (i if i < 3000 else i - 3000) for i in range(len(texts)))
    assert len(met) == 1 and met[0] < 100  # all others share buckets, and are ruled out by signatures


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base[rng.integers(0, 12, 300)] + rng.normal(scale=0.22, size=(300, 16)), np.repeat(base[:1], 40, 0)]).astype(np.float32)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [float("inf")] * 16]
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + i, v, 2) for i, v in enumerate(odd)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, id int").repartition(4)
    d = x.astype(float)
    n = np.linalg.norm(d, axis=1)
    near = (d @ d.T) / (n[:, None] * n) >= 0.95
    np.fill_diagonal(near, False)
    want = least_reachable(range(len(x)), list(zip(*map(lambda a: a.tolist(), np.nonzero(near)))))
    for block in (2048, 50):
        embed_dedup.BLOCK = block
        got = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
        embed_dedup.BLOCK = 2048
        assert all((got[i].n_links, got[i].component_id) == (near[i].sum(), want[i]) for i in range(len(x)))
        assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in got if k >= 1000)
    assert not embed_dedup.near_vectors(df.where("false")).collect()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (1, 0)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


def test_language_and_quality(spark, docs, empty):
    for df in (docs, empty):
        out = langid.language_digest(df).collect()
        assert len(out) == df.count()
        assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id in (d.doc_id for d in docs.where("text is null or text in ('', ' ')").collect()))
        assert all(0 <= r.score <= 1 for r in out)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    for df, some in ((docs, labels), (empty, labels), (docs, labels.where("false"))):
        out = quality.quality_digest(df, some).collect()
        assert len(out) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_epochs_do_not_depend_on_size(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Machine, "fit", lambda self, rows, y, epochs: seen.append((len(y), epochs)))
    for n in (40, 900):
        docs = spark.range(n).selectExpr("id as doc_id", "concat('a b ', id) as text")
        quality.learn(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    assert seen[0][0] < 400 < seen[1][0] and seen[0][1] == seen[1][1] == quality.EPOCHS


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    lang = langid.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (lang.lang == lang.lang_pred).mean() > 0.97
    good = quality.quality_digest(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (good.quality == good.predicted).mean() > 0.93


def test_fingerprints(docs, rows, empty):
    unique = docs.dropDuplicates(["doc_id"])
    text = {r[0]: r[1] or "" for r in rows}
    ids, got = sorted(text), by_id(fingerprints.fingerprints(unique))
    for i, k in enumerate(ids):
        t, n = text[k], text[ids[(i + 1) % len(ids)]]
        q = len(t) // 4
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()
    assert len({got[k]["fingerprint"] for k in ids if text[k] == text[ids[0]]}) == 1
    assert len(fingerprints.fingerprints(docs).collect()) == len(rows) and not fingerprints.fingerprints(empty).collect()


def test_samples_agree_as_often_as_jaccard():
    sampler = fingerprints.Sampler(4096)
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 40, 600) for _ in range(2))
    words = fingerprints.text_hashes(" ".join(f"w{i}" for i in range(40)).encode())
    b[:400] = a[:400]
    x, y = (Counter(zip(v[:-1].tolist(), v[1:].tolist())) for v in (a, b))
    jaccard = sum((x & y).values()) / sum((x | y).values())
    assert abs(fingerprints.likeness(sampler.signature(words[a]), sampler.signature(words[b])) - jaccard) < 0.03


def test_error_of_the_registered_samples():
    """What README says of 64 samples: an error of 0.05 to 0.06 at likeness 0.6 to 0.8, without bias."""
    sampler, rng = fingerprints.Sampler(), np.random.default_rng(7)
    assert fingerprints.SAMPLES == len(sampler.chain) == 64
    hashes = lambda k: fingerprints.text_hashes(" ".join(f"w{i}" for i in rng.integers(0, 1 << 40, k)).encode())
    for share in (0.6, 0.7, 0.8):
        errors = []
        for _ in range(200):
            a, k = hashes(400), round(800 * share / (1 + share))
            b = np.concatenate([a[:k], hashes(400 - k)])
            x, y = ({*zip(v[:-1].tolist(), v[1:].tolist())} for v in (a, b))
            errors.append(fingerprints.likeness(sampler.signature(a), sampler.signature(b)) - len(x & y) / len(x | y))
        assert abs(np.mean(errors)) < 0.02 and 0.04 < np.sqrt(np.mean(np.square(errors))) < 0.07


def targets_of(sizes):
    order = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight, left, share, target = {k: 1 + i % 3 for i, k in enumerate(order)}, set(order), sum(sizes.values()), {}
    while left:
        unit = share / sum(weight[k] for k in left)
        over = {k for k in left if weight[k] * unit > 3 * sizes[k]}
        if not over:
            return target | {k: weight[k] * unit for k in left}
        target |= {k: 3 * sizes[k] for k in over}
        share, left = share - sum(3 * sizes[k] for k in over), left - over
    return target


def test_pipeline_stages(spark):
    """Each stage against its own input: filters keep rows as they are, the others equal brute force or the library."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        assert i + 1 == len(corpus_pipeline.STAGES) or out.columns == docs.columns
        docs = corpus_pipeline.stored(out)
        seen.append(docs.collect())
    read, language, scored, unique, mixed, encoded = seen
    assert set(language) <= set(read) and set(scored) <= set(language) and set(unique) <= set(scored)

    sets = sets_of([(r.doc_id, r.text) for r in scored], corpus_pipeline.SHINGLE_WORDS)
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = least_reachable(ids, linked)
    assert sorted(r.doc_id for r in unique) == [i for i in ids if least[i] == i]

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for r in unique:
        sizes[r.source] += words(r.text)
    for r in mixed:
        taken[r.source] += words(r.text)
    for source, target in targets_of(sizes).items():
        assert abs(taken[source] - target) <= 1, source

    library = Tokenizer.from_str(tokenizer_json())
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for r in mixed:
        got = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(got), hashlib.sha256(np.array(got, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(got, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded) == want


def test_rows_of_one_id_link_each_on_its_own(spark):
    """Rows of one doc_id or vec_id with different contents: none loses its links, and no row goes but near duplicates."""
    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 10_000, 120))
    edit = lambda t: t + " end"
    a, b, c, e = (text() for _ in range(4))
    data = [(5, a), (5, b), (7, edit(b)), (3, edit(a)), (9, c), (9, edit(c)), (9, c), (9, c.upper()), (11, e), (11, c), (2, e), (12, text()), (12, text()), (13, ""), (13, None), (13, "x y"), (None, a), (20, text())]
    data = [(i, t, f"s{n}") for n, (i, t) in enumerate(data)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    sets = [next(iter(sets_of([(0, t)], 4).values())) for _, t, _ in data]
    linked = [(x, y) for x in range(len(data)) for y in range(x) if sets[x] and sets[y] and None not in (data[x][0], data[y][0]) and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    least = least_reachable({i for i, *_ in data if i is not None}, [(data[x][0], data[y][0]) for x, y in linked])
    got = Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect() if r.n_shingles)
    assert got == Counter((i, i if i is None else least[i]) for (i, *_), s in zip(data, sets) if s)
    assert {least[i] for i in (3, 5, 7)} == {3} and {least[i] for i in (2, 9, 11)} == {2}

    group = least_reachable(range(len(data)), linked)
    kept = minhash.without_near_duplicates(df).collect()
    at = [int(r.source[1:]) for r in kept]
    assert Counter(group[x] for x in at) == Counter(set(group.values()))
    assert all(data[x][0] is None or data[x][0] == min(data[y][0] for y in group if group[y] == group[x]) for x in at)

    x, y, z = rng.normal(size=(3, 16))
    vectors = [(5, x), (5, y), (7, y + 0.01), (3, x + 0.01), (9, z), (9, z), (1, x * 2), (30, -z)]
    out = embed_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "vec_id long, embedding array<double>").repartition(4)).collect()
    d = np.array([v for _, v in vectors])
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    near = (d @ d.T >= 0.95) & ~np.eye(len(d), dtype=bool)
    least = least_reachable({i for i, _ in vectors}, [(vectors[p][0], vectors[q][0]) for p, q in zip(*np.nonzero(near))])
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in out) == Counter((i, int(near[p].sum()), least[i]) for p, (i, _) in enumerate(vectors))
    assert least[7] == 1


def test_frequent_table_catches_most_pieces():
    """Counted in the even rows of sf0.01, it misses under a quarter of the odd rows' pieces; lengths are the library's."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist() if t]
    spec, seen = tokenizer_json(name="word_bpe_49k.json"), Counter()
    for one, _, _, strings in token_count.pieces([t for t in texts[::2] if not token_count.odd(t)]):
        seen.update(strings(np.arange(len(one))))
    top = [p for p, _ in seen.most_common(token_count.FREQUENT)]
    library = Tokenizer.from_str(spec)
    counter = token_count.Counter(spec, token_count.length_table(top, spec))
    assert counter.encoded(top).tolist() == [len(e) for e in library.encode_batch(top, add_special_tokens=False)]
    assert counter.count(texts[1::2]).tolist() == [len(e) for e in library.encode_batch(texts[1::2], add_special_tokens=False)]
    assert counter.missed < 0.25 * counter.seen


def test_pieces_of_odd_texts_add_up_to_the_library(monkeypatch):
    from tokenizers import Tokenizer

    from quillspan.llm import pieces

    spec, rng = tokenizer_json(name="word_bpe_49k.json"), np.random.default_rng(4)
    alphabet = [*"abcXYZ019.,'!-_ \n\t\r\x0b\x00éÉßñ×÷ªº²«»–’€đƒ\x1c\x85\xa0İΣσς中", "'s", "'ll", " 've", "<|endoftext|>", "  ", "don't"]
    texts = ["".join(rng.choice(alphabet[: rng.choice([20, 36, len(alphabet)])], rng.integers(0, 40))) for _ in range(3000)] + ["x" * 600_000, "ab, " * 300_000]
    want = [len(e) for e in Tokenizer.from_str(spec).encode_batch(texts, add_special_tokens=False)]
    for size, cache in ((1 << 19, 10_000), (32, 50)):
        monkeypatch.setattr(pieces, "SLICE", size)
        assert token_count.Counter(spec, token_count.length_table([], spec), cache).count(texts[:-2] if size == 32 else texts).tolist() == want[: -2 if size == 32 else None]


def grams_of(text):
    """4-grams of letters, runs of others as one space, two before the text and one after it."""
    s = "  "
    for c in text.lower() + "\n":
        s += c if c.isalpha() else " " if s[-1] != " " else ""
    return Counter(s[i : i + 4] for i in range(len(s) - 3))


def test_ngrams_of_long_texts_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice([*"abcÉσΣ  ..1\n"], n)) for n in (0, 1, 2, 7, 40, 333)] + ["." * 90 + "ab" + " " * 70 + "c", "a" * 100]
    for size in (1 << 19, 1, 3, 16):
        monkeypatch.setattr(langid, "_SLICE", size)
        for t in texts:
            hashes = Counter()
            for parts, heads, _ in langid.runs([t]):
                hashes.update(langid.grams(parts, heads)[0].tolist())
            assert sorted(hashes.values()) == sorted(grams_of(t).values()), (size, t)


def test_filters_against_sets_of_ngrams():
    """Filters find every learned n-gram, few others, and predict what exact sets predict."""
    rng = np.random.default_rng(8)
    words = {lang: ["".join(rng.choice(list(a), rng.integers(2, 7))) for _ in range(300)] for lang, a in (("aa", "abcdefg"), ("bb", "efghijk"), ("cc", "qrstuvw"))}
    texts = {lang: [" ".join(rng.choice(w, 60)) for _ in range(30)] for lang, w in words.items()}
    gram_sets = {lang: np.unique(np.concatenate([langid.grams(p, h)[0] for p, h, _ in langid.runs(t[:20])])) for lang, t in texts.items()}
    filters = langid.Filters(sorted(gram_sets), [gram_sets[k] for k in sorted(gram_sets)], 0)
    for i, lang in enumerate(sorted(gram_sets)):
        assert (filters.languages(gram_sets[lang])[:, 0] >> np.uint64(i) & np.uint64(1)).all()
    others = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert (filters.languages(others) != 0).mean() < 1e-3
    for lang, own in texts.items():
        predicted, _, known = filters.predict(own[20:])
        for t, p, k in zip(own[20:], predicted, known):
            h = np.concatenate([langid.grams(q, z)[0] for q, z, _ in langid.runs([t])])
            share = {x: np.isin(h, s).mean() for x, s in gram_sets.items()}
            assert p == max(share, key=share.get) == lang and abs(k - share[lang]) < 0.01


def test_factorisation_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(9)
    machine = quality.Machine(np.zeros(quality.STATS), np.ones(quality.STATS))
    machine.w0, machine.w = 0.3, rng.normal(size=machine.w.shape).astype(np.float32)
    feature, x = rng.choice(quality.WORDS, 12, replace=False), rng.normal(size=12)
    want = machine.w0 + (machine.w[feature] * x).sum() + sum(machine.v[feature[i]] @ machine.v[feature[j]] * x[i] * x[j] for i in range(12) for j in range(i))
    assert abs(machine.raw(1, np.zeros(12, int), feature, x)[0][0] - want) < 1e-4


def test_likeness_of_the_query_is_near_jaccard(docs):
    """near_edited and near_next of the registered query against generalised Jaccard similarity of the word pairs."""
    unique = docs.where("length(text) > 200 and length(text) < 5000").dropDuplicates(["doc_id"])
    text = {r.doc_id: r.text for r in unique.collect()}
    ids = sorted(text)
    pairs = lambda t: Counter(zip(w, w[1:])) if len(w := re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))) > 1 else Counter({tuple(w): 1} if w else {})
    jaccard = lambda a, b: sum((a & b).values()) / max(1, sum((a | b).values()))
    errors = []
    for i, r in enumerate(sorted(fingerprints.fingerprints(unique).collect(), key=lambda r: r.doc_id)):
        t, n = text[r.doc_id], text[ids[(i + 1) % len(ids)]]
        q = len(t) // 4
        errors += [r.near_edited - jaccard(pairs(t), pairs(t[: len(t) - q] + n[:q])), r.near_next - jaccard(pairs(t), pairs(n))]
    assert len(errors) > 100 and abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.07


def test_columns_of_any_name(spark, rows):
    """Stages take columns with the names that the operators use inside."""
    import corpus_pipeline

    names = "start target skey source_size size rng key id row cut here nth part copies left _t _n _score _lang _score_ _known _kept _doc _row _text node rep c u v n lang_".split()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    plain = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    wide = plain.selectExpr("*", *[f"cast({i} as int) as `{n}`" for i, n in enumerate(names)])
    stages = {"language": langid.language_stage, "quality": lambda d: quality.quality_stage(d, labels), "minhash": minhash.without_near_duplicates, "mixing": mixing.mixed_rows}
    for name, stage in stages.items():
        got = stage(wide)
        assert got.columns == wide.columns, name
        few = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        assert few(got) == few(stage(plain)), name
        assert all(r[n] == i for r in got.select(*names).limit(5).collect() for i, n in enumerate(names))
    assert len(corpus_pipeline.STAGES) == 5


def test_tiny_and_huge_vectors(spark):
    x = [[3.0, 1.0, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    data = [(i + 3 * k, [c * s for c in v]) for k, s in enumerate((1.0, 1e-200, 1e200, 1e-310)) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in embed_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert all((got[i].n_links, got[i].component_id) == (3, i % 3) for i in got)


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from quillspan.llm import common

    spark = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    spark.conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError):
        common.shared_dir(spark)


def test_ids_of_odd_texts_are_the_library_s(monkeypatch):
    """Texts of every class of characters, cut in small runs and with small tables, by the library's merges and by the backtracking encoder."""
    from tokenizers import Tokenizer

    from quillspan.llm import pieces

    spec, rng = tokenizer_json(), np.random.default_rng(12)
    alphabet = [*"abcXYZ019.,'!-_ \n\t\r\x0b\x0c\x00\x1c\x1f\x85\xa0éÉßñ×÷ªº²«»đƒʯ–’€İΣσς中あ😀", "'s", "'ll", " 've", "don't ", "<|endoftext|>", "  ", "\n\n", " \n", "\n "]
    texts = ["".join(rng.choice(alphabet[: rng.choice([20, 36, 46, len(alphabet)])], rng.integers(0, 40))) for _ in range(6000)] + [None, "", " ", "\n", "  ", "ab, " * 400, "x" * 3000]
    want = [e.ids for e in Tokenizer.from_str(spec).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for size, cache in ((1 << 19, 10_000), (32, 50)):
        monkeypatch.setattr(pieces, "SLICE", size)
        for coder in (token_binary.Library(spec, cache), bpe.Codec(spec, cache)):
            got = [x.tolist() for p in range(0, len(texts), 500) for x in coder.many(texts[p : p + 500])]
            assert [(t, g, w) for t, g, w in zip(texts, got, want) if g != w] == []
