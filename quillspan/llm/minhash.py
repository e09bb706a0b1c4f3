"""Operator 6, MinHash near-duplicates: universal hash minima, banding, signature verification, exact verification, star components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, partitions, stored
from .components import components, id_ties, least_ids
from .wordhash import mixed, shingles, word_hashes

#: 30 bands of 5 minima: a pair at similarity 0.8 shares none with probability 7e-6.
BANDS, ROWS = 30, 5
#: Full sets are compared in blocks of about so many documents and shingles, signatures of a bucket in blocks of so many documents.
BLOCK_DOCS, BLOCK_SHINGLES, BUCKET_DOCS = 192, 1 << 20, 1024
#: Five standard deviations of a signature's estimate at the threshold.
SLACK = 5.0
_U = np.uint64


class Minima:
    """BANDS * ROWS multiply-add-shift hash functions over 64-bit shingles, from a fixed seed."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, n = bands, rows, bands * rows
        self.a = (rng.integers(0, 1 << 63, n, dtype=np.uint64) << _U(1)) | _U(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64) << _U(1)
        self.chain = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) | _U(1)

    def signature(self, s: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), (1 << 32) - 1, np.uint64)
        for p in range(0, len(s), 1024):
            x = self.a[:, None] * s[None, p : p + 1024]
            x += self.b[:, None]
            x >>= _U(32)
            np.minimum(least, x.min(axis=1), out=least)
        return least

    def keys(self, sig: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band."""
        return mixed((sig.reshape(self.bands, self.rows) * self.chain).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def document_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for i, j, h, bounds in word_hashes(texts):
        for k in range(j - i):
            yield np.unique(shingles(h[bounds[k] : bounds[k + 1]], size))


_SKETCH = "doc_id long, text_key long, n_shingles long, set_key binary, sig binary, bands array<long>"


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def text_key(text: Column | str) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sketches(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(bands, rows)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for s in document_sets(batch.column("text"), size):
                sig = minima.signature(s)
                out[0].append(len(s))
                out[1].append(set_key(s))
                out[2].append((sig & _U(255)).astype(np.uint8).tobytes())
                out[3].append(minima.keys(sig).view(np.int64) if len(s) else np.zeros(0, np.int64))
            lengths = np.cumsum([0, *map(len, out[3])])
            bands_ = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(out[3]) if out[3] else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), bands_], ["doc_id", "text_key", "n_shingles", "set_key", "sig", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for p in range(0, batch.num_rows, 256):
                part = batch.slice(p, 256)
                sets = list(document_sets(part.column(at), size))
                part = part.set_column(at, "shingles", pa.array([s.tobytes() for s in sets], pa.binary()))
                # a row of the same doc_id with another set is another node's
                own = [set_key(s) == k for s, k in zip(sets, part.column("set_key").to_pylist())]
                yield part if all(own) else part.filter(pa.array(own))

    return run


def linked_pairs(ids: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links of a forest that joins what pairs (left, not left), or all pairs if all are left, join at den * |and| >= num * |or|.

    Pairs whose signatures differ by far more than chance allows are passed
    over; of the others, intersections are counted on the full sets.
    """
    n = len(ids)
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = (np.arange(n), np.arange(n)) if left.all() else (np.flatnonzero(left), np.flatnonzero(~left))
    want, k = num / den, sigs.shape[1]
    least = k * (want - SLACK * np.sqrt(want * (1 - want) / k))
    agree = np.zeros((len(a), len(b)), np.uint16)
    for c in range(k):
        agree += sigs[a, c][:, None] == sigs[b, c][None, :]
    may = agree >= least
    if left.all():
        may &= np.arange(n)[:, None] < np.arange(n)[None, :]
    rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    if not len(rows):
        return []
    inter = np.zeros((len(rows), len(cols)), np.int64)
    used = np.unique(np.concatenate([a[rows], b[cols]]))
    flat, owner = np.concatenate([sets[i] for i in used]), np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    if not len(column):
        return []
    _, column = np.unique(column, return_inverse=True)
    place = np.searchsorted(used, a[rows]), np.searchsorted(used, b[cols])
    width = max(256, (1 << 21) // len(used))
    for p in range(0, int(column[-1]) + 1, width):
        here = slice(*np.searchsorted(column, [p, p + width]))
        m = np.zeros((len(used), width), np.float32)
        m[owner[here], column[here] - p] = 1
        inter += np.rint(m[place[0]] @ m[place[1]].T).astype(np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    union = size[a[rows]][:, None] + size[b[cols]][None, :] - inter
    out = []
    for i, j in zip(*np.nonzero(may[np.ix_(rows, cols)] & (den * inter >= num * union))):
        u, v = int(a[rows[i]]), int(b[cols[j]])
        if (x := root(u)) != (y := root(v)):
            parent[max(x, y)] = min(x, y)
            out.append((int(ids[u]), int(ids[v])))
    return out


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        task, seen = None, set()

        def links() -> pa.RecordBatch:
            found = []
            if len(held) > 1:
                found = linked_pairs(np.array([x[0] for x in held]), np.array([np.frombuffer(x[1], np.uint8) for x in held]), [np.frombuffer(x[2], np.uint64) for x in held], np.array([x[3] for x in held]), num, den)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            for t, *row in zip(*(batch.column(c).to_pylist() for c in ("task", "id", "sig", "shingles", "left"))):
                if t != task:
                    if held:
                        yield links()
                    held, task, seen = [], t, set()
                if row[0] not in seen:  # repeated rows of one text
                    seen.add(row[0])
                    held.append(tuple(row))
        if held:
            yield links()

    return run


_FULL = "n_shingles > 0 and doc_id is not null"


def _linked_sets(docs: DataFrame, size: int, num: int, den: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Steps 1 to 3 of near_duplicates(): known (doc_id, text_key, n_shingles, set_key, ...) for each row, classes (set_key, rep, node), edges between nodes, rows.

    A class is a set; its node is a number that is fixed as the classes are written.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key("text").alias("text_key"))
    known = stored(slim.mapInArrow(_sketches(size, bands, rows), _SKETCH))
    full = known.where(_FULL)
    n = known.count()
    classes = stored(full.groupBy("set_key").agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()), n)
    reps = stored(full.join(classes.withColumnRenamed("set_key", "_key"), (F.col("doc_id") == F.col("rep")) & (F.col("set_key") == F.col("_key"))).select(F.col("node").alias("id"), "rep", "set_key", "n_shingles", "sig", "bands"), 4 * n)
    buckets = reps.select("id", F.explode("bands").alias("key"))
    least = stored(buckets.groupBy(F.col("key").alias("k")).agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("k", "least"), n)
    ties = stored(buckets.join(least, F.col("key") == F.col("k")).where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct(), n)
    members = stored(ties.select(F.explode(F.array("u", "v")).alias("id")).distinct(), n)

    # the full sets of all documents that have a candidate, made once
    held = reps.join(members, "id", "left_semi").groupBy("id", "rep", "set_key").agg(F.min("sig").alias("sig"))
    texts = slim.where("text is not null").join(held, F.col("doc_id") == F.col("rep")).select("id", "set_key", "sig", "text")
    sets = stored(texts.mapInArrow(_sets(size), "id long, set_key binary, sig binary, shingles binary").select("id", "sig", "shingles"))
    sized = stored(reps.select("id", "n_shingles").distinct().join(members, "id"), n)

    def linked(tasks: DataFrame) -> DataFrame:
        """Links found in tasks (id, task, left)."""
        dealt = sets.join(tasks, "id").select("task", "id", "sig", "shingles", "left")
        return dealt.repartition(partitions(spark), "task").sortWithinPartitions("task").mapInArrow(_verify(num, den), "u long, v long")

    def with_class(links: DataFrame, of: DataFrame) -> DataFrame:
        """of (id, ...) with the class of each id by the links."""
        told = components(links, n).select(F.col("id").alias("_id"), F.col("component").alias("_class"))
        return of.join(told, F.col("id") == F.col("_id"), "left").withColumn("class", F.coalesce("_class", "id")).drop("_id", "_class")

    stars = stored(linked(_star_tasks(ties, sized)))  # not put together: each task has work to do
    # documents of one bucket that are still of several classes meet by their signatures; what these don't rule out makes clusters
    open_ = stored(with_class(stars, sized.select("id", "n_shingles")), n)
    placed = buckets.join(open_, "id")
    several = stored(placed.groupBy(F.col("key").alias("k")).agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("k"), n)
    mixed_ = placed.join(several, F.col("key") == F.col("k"), "left_semi").join(reps.groupBy("id").agg(F.min("sig").alias("sig")), "id")
    met = _bucket_tasks(mixed_.select("key", "id", "sig", "class", "n_shingles")).repartition(partitions(spark), "task").sortWithinPartitions("task")
    likely = stored(met.mapInArrow(_candidates(num, den), "u long, v long").distinct(), n)
    of_class = components(likely, n).select(F.col("id").alias("_id"), F.col("component").alias("_cluster"))
    clustered = open_.join(of_class, F.col("class") == F.col("_id")).select("id", "n_shingles", F.col("_cluster").alias("component"), "class")
    rest = linked(_class_tasks(stored(clustered, n), num, den))
    return known, classes, stars.unionByName(rest), n


def _blocks() -> Column:
    return F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")


def _star_tasks(ties: DataFrame, sized: DataFrame) -> DataFrame:
    """Tasks (id, task, left) that compare each bucket's documents with its least one, the left of its tasks; blocks are of bounded size, so a hot bucket is spread."""
    of = sized.select("id", "n_shingles")
    tied = ties.join(of, F.col("u") == F.col("id"))
    blocks = tied.groupBy("v").agg(_blocks().alias("blocks"))
    task = lambda b: F.xxhash64("v", b)
    many = ties.join(blocks, "v").select(F.col("u").alias("id"), task(F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")).alias("task"), F.lit(False).alias("left"))
    return many.unionByName(blocks.select(F.col("v").alias("id"), F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), task)).alias("task"), F.lit(True).alias("left")))


def _class_tasks(open_: DataFrame, num: int, den: int) -> DataFrame:
    """Tasks (id, task, left) that compare all pairs of a cluster but those inside one class of more than half a block.

    open_: (id, n_shingles, component, class). A cluster of bounded size is one
    task. Others are cut by set size (sets that can link differ by a quarter at
    the most, so they are of one level or of neighbouring ones) and each level
    into blocks: of each large class its own, of the others' mixed ones (label -1).
    Two blocks of one large class don't meet, so a class of n copies beside a
    few other documents costs n comparisons for each of them, not n squared.
    """
    whole = open_.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("total")).where((F.col("docs") > BLOCK_DOCS) | (F.col("total") > BLOCK_SHINGLES)).select(F.col("component").alias("_big"))
    step = -np.log(num / den)
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / step - 1e-9).cast("int")
    rows = open_.join(whole, F.col("component") == F.col("_big"), "left")
    small = rows.where("_big is null").select("id", F.xxhash64("component").alias("task"), F.lit(True).alias("left"))
    big = rows.where("_big is not null").withColumn("level", level)
    at = ["component", "level", "class"]
    large = big.groupBy(*at).agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK_DOCS / 2).select(*at, F.col("class").alias("_label"))
    big = materialize(big.join(large, at, "left").select("id", "n_shingles", "component", "level", F.coalesce("_label", F.lit(-1)).alias("label")))
    cut = big.groupBy("component", "level", "label").agg(_blocks().alias("blocks"))
    by_level = cut.groupBy("component", "level").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("label", "blocks"))), lambda x: F.array_repeat(x["label"], x["blocks"]))).alias("labels"))
    near = by_level.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("level", "labels"))).alias("by_level"))
    labels = lambda d: F.coalesce(F.try_element_at("by_level", F.col("level") + d), F.array().cast("array<bigint>"))
    own_blocks = F.size(F.filter(labels(0), lambda x: x == F.col("label")))
    placed = big.join(near, "component").withColumn("own", (F.array_position(labels(0), F.col("label")) - 1 + F.pmod(F.xxhash64("id"), own_blocks)).cast("int"))
    # tasks are (cluster, level and block, level and block), the lower first; the row of a task's first block is `left`
    name = lambda l1, b1, l2, b2: F.xxhash64("component", l1, b1, l2, b2)
    own, lev, mixed_ = F.col("own"), F.col("level"), F.col("label") == -1
    none = F.array().cast("array<struct<task:bigint,left:boolean>>")

    def against(d: int) -> Column:
        """Tasks with the blocks of level + d: with its own block only if that is mixed, with none of its own class."""
        there = F.filter(F.transform(labels(d), lambda x, b: F.struct(b.alias("b"), x.alias("x"))), lambda s: mixed_ | (s["x"] != F.col("label")))
        first = F.lit(d > 0) if d else None
        pair = lambda s: F.struct(
            F.when(s["b"] >= own if d == 0 else first, name(lev, own, lev + d, s["b"])).otherwise(name(lev + d, s["b"], lev, own)).alias("task"),
            (s["b"] >= own if d == 0 else first).alias("left"),
        )
        return F.transform(there, pair)

    tasks = F.concat(none, against(0), against(1), against(-1))
    return small.unionByName(placed.select("id", F.explode(tasks).alias("t")).select("id", F.col("t.task").alias("task"), F.col("t.left").alias("left")))


def _bucket_tasks(rows: DataFrame) -> DataFrame:
    """rows (key, id, class, ...) with task and left: pairs to look at are those of left rows with the others, or all if all are left.

    A bucket of bounded size is one task. Of a larger one the most frequent
    class stands apart: its documents are linked already, so they meet those
    of other classes only, block by block, and those meet each other. A hot
    bucket of one class and a few others costs what it has documents.
    """
    counts = rows.groupBy("key", F.col("class").alias("c")).agg(F.count("*").alias("n"))
    large = counts.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("n", "c")).alias("most"), F.sum("n").alias("all")).where(F.col("all") > BUCKET_DOCS)
    blocks = lambda n: F.ceil(n / BUCKET_DOCS).cast("int")
    large = stored(large.select("_key", F.col("most.c").alias("_most"), blocks(F.col("most.n")).alias("_m"), blocks(F.col("all") - F.col("most.n")).alias("_o")))
    met = rows.join(large, F.col("key") == F.col("_key"), "left")
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    task = lambda kind, i, j, left: F.struct(F.xxhash64("key", F.lit(kind), i, j).alias("task"), left.alias("left"))
    o, m, yes, no = F.col("_o"), F.col("_m"), F.lit(True), F.lit(False)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    other = F.concat(F.transform(upto(o), lambda j: task(0, F.least(own(o), j), F.greatest(own(o), j), own(o) <= j)), F.transform(upto(m), lambda j: task(1, own(o), j, yes)))
    most = F.transform(upto(o), lambda i: task(1, i, own(m), no))
    tasks = F.when(o.isNull(), F.array(F.struct(F.col("key").alias("task"), yes.alias("left")))).when(F.col("class") == F.col("_most"), most).otherwise(other)
    return met.withColumn("_t", F.explode(tasks)).select("sig", "class", "n_shingles", F.col("_t.task").alias("task"), F.col("_t.left").alias("left"))


def pairs_of_groups(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of all pairs within groups of so many rows that follow each other."""
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = int(sizes.sum())
    later = starts + np.repeat(sizes, sizes) - np.arange(n) - 1  # rows of the group that come after each
    i = np.repeat(np.arange(n), later)
    first = np.repeat(np.cumsum(later) - later, later)
    return i, i + 1 + np.arange(len(i)) - first


def alike(sig: np.ndarray, size: np.ndarray, of: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (i, j) those of different classes whose sizes and signatures don't rule a link out."""
    want, k = num / den, sig.shape[1]
    may = (of[i] != of[j]) & (den * np.minimum(size[i], size[j]) >= num * np.maximum(size[i], size[j]))
    i, j = i[may], j[may]
    agree = np.concatenate([(sig[i[p : p + 65536]] == sig[j[p : p + 65536]]).sum(axis=1) for p in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
    may = agree >= k * (want - SLACK * np.sqrt(want * (1 - want) / k))
    return i[may], j[may]


def _candidates(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("task", "sig", "class", "n_shingles", "left")
        rest: pa.Table | None = None

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            task, of, size, left = (table.column(c).to_numpy() for c in ("task", "class", "n_shingles", "left"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(task), -1)
            cut = np.append(np.flatnonzero(np.append(True, task[1:] != task[:-1])), len(task))
            sizes = np.diff(cut)
            whole = np.logical_and.reduceat(left, cut[:-1]) if len(task) else np.zeros(0, bool)
            small = whole & (sizes <= 64)
            at = np.flatnonzero(np.repeat(small, sizes))
            i, j = pairs_of_groups(sizes[small])
            found = [alike(sig, size, of, at[i], at[j], num, den)]
            for a, b, w in zip(cut[:-1][~small], cut[1:][~small], whole[~small]):
                rows = np.arange(a, b)
                l, r = (rows, rows) if w else (rows[left[a:b]], rows[~left[a:b]])
                for x in l:
                    other = r[r > x] if w else r
                    found.append(alike(sig, size, of, np.full(len(other), x), other, num, den))
            i, j = (np.concatenate([x[c] for x in found]) for c in range(2))
            names, code = np.unique(of, return_inverse=True)
            each = np.unique(np.maximum(code[i], code[j]) * len(names) + np.minimum(code[i], code[j]))
            yield from forest(names[each // len(names)], names[each % len(names)])

        def forest(one: np.ndarray, two: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Of the classes that edges join, as many edges as keep them joined."""
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            kept = []
            for u, v in zip(one.tolist(), two.tolist()):
                if (x := root(u)) != (y := root(v)):
                    parent[max(x, y)] = min(x, y)
                    kept.append((u, v))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in kept], pa.int64()) for c in (0, 1)], ["u", "v"])

        for batch in batches:
            if batch.num_rows:
                rest = pa.Table.from_batches([batch.select(columns)] if rest is None else [*rest.to_batches(), batch.select(columns)])
                task = rest.column("task").to_numpy()
                last = int(np.searchsorted(task, task[-1]))  # the last task may go on in the next batch
                if last:
                    yield from pairs(rest.slice(0, last))
                    rest = rest.slice(last)
        if rest is not None:
            yield from pairs(rest)

    return run


def near_duplicates(docs: DataFrame, size: int = 4, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked at den * |and| >= num * |or| of their word shingle sets.

    1. One pass turns each whole text into its set's size, a 128-bit key of
       the set, band keys and an 8-bit signature; copies of a set become one
       class, so groups of exact copies never meet.
    2. Each bucket's documents are compared with its least one first, on full
       sets and in blocks: that is linear, and what links so is one class.
    3. In a bucket that still has documents of several classes, those of
       different classes are compared by signature (a hot bucket in blocks;
       documents of its most frequent class meet the others only). Pairs that
       size or signature rule out end here; the others tie classes to
       clusters, of which a task returns a forest, not all pairs. So documents
       that are a little alike don't grow together, however many share buckets.
       In a cluster every pair is compared on full sets but those inside a
       large class, in tasks over two blocks of bounded size (see _class_tasks).
    4. The least id of each component is found by large-star and small-star.

    Null and empty texts have no shingles, component doc_id, kept true. Rows
    of one doc_id are one component, and each of their sets links on its own:
    a node is a set, not a doc_id. Rows with a null doc_id link with
    nothing: their component_id and kept are null. A text longer than memory
    allows in one row fails in Spark's reader, not here. An empty table gives
    no rows.
    """
    known, classes, edges, n = _linked_sets(docs, size, num, den, bands, rows)
    ties = id_ties(known.where(_FULL).select(F.col("doc_id").alias("id"), "set_key"), classes, "set_key")
    component = stored(least_ids(classes, edges.unionByName(ties), n).select(F.col("set_key").alias("_key"), "c"), n)
    out = known.select("doc_id", "n_shingles", "set_key").join(component, F.col("set_key") == F.col("_key"), "left")
    found = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("c"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), (F.col("doc_id") == found).alias("kept"))


def without_near_duplicates(docs: DataFrame, size: int = 4, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Of each group of rows linked as in near_duplicates(), one row of the least doc_id; all rows that link with nothing.

    Here rows are linked by their sets only, not by their doc_id: two rows of
    one doc_id stay both unless they are found to be near duplicates. Of equal
    texts of one doc_id the row that is least in the other columns stays.
    """
    known, classes, edges, n = _linked_sets(docs, size, num, den, bands, rows)
    found = least_ids(classes, edges, n)
    heads = found.where("rep = c").groupBy("component").agg(F.min("node").alias("_head"))
    heads = found.join(heads.select("_head"), F.col("node") == F.col("_head"), "left_semi").select("rep", F.col("set_key").alias("_key"))
    kept = known.join(heads, (F.col("set_key") == F.col("_key")) & (F.col("doc_id") == F.col("rep"))).groupBy(F.col("doc_id").alias("_doc"), "_key").agg(F.min("text_key").alias("_kept"))
    kept = stored(kept.select("_doc", "_kept"), n)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    linkable = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    # whole rows travel as one struct, so their columns may have any names
    whole = docs.where(linkable).select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key("text").alias("key"))
    told = whole.join(kept, (F.col("id") == F.col("_doc")) & (F.col("key") == F.col("_kept")))
    told = told.withColumn("nth", F.row_number().over(Window.partitionBy("_doc", "_kept").orderBy(*[F.col("row")[c] for c in others] or ["key"]))).where("nth = 1")
    return told.select("row.*").unionByName(docs.where(~linkable))
