"""Operator 12, substring dedup: documents are streamed through suffix automata of the passages that repeat, shard by shard."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_dir, stored
from .wordhash import mixed, shingles, word_hashes

#: Words of a window, and of the anchors by which equal windows find each other.
WINDOW, ANCHOR = 35, 8
#: Repeated windows in a shard's automaton, and windows that one task streams through it, about.
SHARD_WINDOWS, TASK_WINDOWS = 16_384, 262_144
#: Parts of a long document that may go to different tasks; bytes of text in a bucket.
BLOCK, BUCKET_BYTES = 65_536, 128 << 20
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_U = np.uint64


class SuffixAutomaton:
    """The suffix automaton of several sequences: its paths from state 0 are exactly their substrings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _copied(self, p: int, q: int, c: int) -> int:
        """A copy of q for the shorter strings that come to it through p."""
        new, nexts, link = len(self.next), self.next, self.link
        nexts.append(nexts[q].copy())
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        link[q] = new
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = new
            p = link[p]
        return new

    def add(self, sequence: list[int]) -> None:
        nexts, link, length, last = self.next, self.link, self.length, 0
        for c in sequence:
            q = nexts[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._copied(last, q, c)
                continue
            new, p = len(nexts), last
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._copied(p, q, c)
            last = new

    def spans(self, sequence: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal ranges that are covered by substrings of at least `least` symbols: those places where the matching statistic reaches it."""
        nexts, link, length, out = self.next, self.link, self.length, []
        state = matched = 0
        start = end = -1
        for i, c in enumerate(sequence):
            to = nexts[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nexts[state].get(c)
            if to is None:
                matched = 0
                continue
            state = to
            matched += 1
            if matched >= least:
                if i - matched + 1 > end:
                    if end >= 0:
                        out.append((start, end))
                    start = i - matched + 1
                end = i + 1
        if end >= 0:
            out.append((start, end))
        return out


class _Rolling:
    """Hashes of runs of words from prefix sums: sum of h[i] * base^i, divided by base^start, modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, _U), np.ones(1, _U)

    def of(self, h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        if len(self.up) < len(h):
            n = max(len(h), 2 * len(self.up))
            powers = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n - 1, b & ((1 << 64) - 1), _U)]))
            self.up, self.down = powers(self.base), powers(self.inverse)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(h * self.up[: len(h)], dtype=_U)])
        return mixed((sums[starts + size] - sums[starts]) * self.down[starts])


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Where in each run of `size` entries the least one is, the first of equals; by doubling."""
    at, run = np.arange(len(x)), 1
    value = x
    while run < size:
        step = min(run, size - run)
        later = value[step:] < value[:-step]
        value, at = np.where(later, value[step:], value[:-step]), np.where(later, at[step:], at[:-step])
        run += step
    return at


def anchored(h: np.ndarray, bounds: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, anchor) of each run of windows that share an anchor; h are the words of documents between bounds.

    A window's anchor is the least hash among those of its runs of `anchor`
    words, the first of equals: equal windows have equal anchors.
    """
    n = len(h) - size + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),)
    short = shingles(h, anchor)
    at = _least(short, size - anchor + 1)[:n]
    end = np.repeat(bounds[1:], np.diff(bounds))[:n]
    valid = np.arange(n) + size <= end
    at = np.where(valid, at, -1)
    cut = np.flatnonzero(np.diff(at, prepend=-2))
    length = np.diff(np.append(cut, n))
    keep = at[cut] >= 0
    cut, length = cut[keep], length[keep]
    owner = np.searchsorted(bounds, cut, "right") - 1
    return owner, cut - bounds[owner], length, short[at[cut]]


def _anchors(size: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            for i, j, h, bounds in word_hashes(batch.column("text"), False):
                owner, pos, n, m = anchored(h, np.asarray(bounds), size, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(docs[i:j][owner]), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))], ["m", "doc", "pos", "n"])

    return run


def _listed(batch: pa.RecordBatch, i: int, j: int) -> tuple[np.ndarray, pa.StructArray]:
    """The entries of rows i to j of the column `at`, each with its row."""
    lists = batch.column("at").slice(i, j - i)
    return np.repeat(np.arange(j - i), lists.value_lengths().to_numpy()), lists.flatten()


def _windows(size: int):
    rolling = _Rolling(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            for i, j, h, bounds in word_hashes(batch.column("text"), False):
                row, at = _listed(batch, i, j)
                pos, n, m = (at.field(c).to_numpy() for c in ("pos", "n", "m"))
                ends = np.cumsum(n)
                inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
                row, pos, m = np.repeat(row, n), np.repeat(pos, n) + inside, np.repeat(m, n)
                w = rolling.of(h, np.asarray(bounds)[row] + pos, size)
                _, where, times = np.unique(w ^ m.view(_U), return_index=True, return_counts=True)  # repeats nearby count at once
                order = np.argsort(where)  # as they come: documents and places next to each other shrink well on their way
                where, times = where[order], times[order]
                yield pa.RecordBatch.from_arrays([pa.array(w[where].view(np.int64)), pa.array(m[where]), pa.array(docs[i:j][row[where]]), pa.array(pos[where].astype(np.int32)), pa.array(times.astype(np.int32))], ["w", "m", "doc", "pos", "n"])

    return run


def _pieces(size: int):
    """Words of the references (kind 0) and of the regions to stream (kind 1), for the tasks they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            for i, j, h, bounds in word_hashes(batch.column("text"), False):
                row, at = _listed(batch, i, j)
                kind, shard, salt, pos, n = (at.field(c).to_numpy().astype(np.int64) for c in ("kind", "shard", "salt", "pos", "n"))
                order = np.lexsort((pos, kind, salt, shard, row))
                row, kind, shard, salt, pos, n = (x[order] for x in (row, kind, shard, salt, pos, n))
                # references hold runs of repeated windows only; regions go on where their words overlap
                gap = pos[1:] - (pos + n)[:-1]
                same = (row[1:] == row[:-1]) & (kind[1:] == kind[:-1]) & (shard[1:] == shard[:-1]) & (salt[1:] == salt[:-1])
                cut = np.flatnonzero(np.append(True, ~(same & (gap <= np.where(kind[1:] == 1, size - 1, 0)))))
                if not len(pos):
                    continue
                last = np.append(cut[1:], len(pos)) - 1
                begin, end = pos[cut], (pos + n)[last] + size - 1
                base = np.asarray(bounds)[row[cut]]
                words = [h[a:b].tobytes() for a, b in zip(base + begin, base + end)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[cut]), pa.array(salt[cut]), pa.array(kind[cut]), pa.array(docs[i:j][row[cut]]), pa.array(begin), pa.array(words, pa.binary())], ["shard", "salt", "kind", "doc", "pos", "words"])

    return run


def _streamed(size: int):
    """Rows come by (shard, salt, kind): first the references of a shard, then what is streamed through their automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, automaton = None, SuffixAutomaton()
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for shard, salt, kind, doc, pos, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "salt", "kind", "doc", "pos", "words"))):
                if (shard, salt) != held:
                    held, automaton = (shard, salt), SuffixAutomaton()
                symbols = np.frombuffer(words, _U).tolist()
                if kind == 0:
                    automaton.add(symbols)
                else:
                    out += [(doc, pos + a, pos + b) for a, b in automaton.spans(symbols, size)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["doc", "start", "end"])

    return run


_OUT = "row long, n_words long, spans array<struct<start:long,end:long>>, kept_text string"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that meet or overlap put together."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in range(0, batch.num_rows, 512):
            part, out = batch.slice(p, 512), []
            for doc, text, found in zip(part.column("doc").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist(), part.column("found").to_pylist()):
                words = _WORDS.findall(text or b"")
                spans, kept, at = merged([(s["start"], s["end"]) for s in found or ()]), [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                out.append((doc, len(words), [{"start": a, "end": b} for a, b in spans], b" ".join(kept + words[at:] if spans else words).decode()))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "spans", "kept_text"])


def _bucketed(docs: DataFrame, key: str) -> DataFrame:
    """(doc, key, text), a number for each row; written once in buckets of doc, so that joins with what is found of a row move no text."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(key).alias("key"), F.col("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, name = min(100_000, max(partitions(spark), size // BUCKET_BYTES + 1)), f"quillspan_{uuid.uuid4().hex}"
    rows.repartition(buckets, "doc").write.bucketBy(buckets, "doc").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _hash(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def repeated_spans(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, start, end): ranges of words covered by windows that start at least twice in the texts (doc, text). Ranges may overlap."""
    found = stored(texts.select("doc", "text").where("text is not null").mapInArrow(_anchors(window, anchor), "m long, doc long, pos int, n int"))
    # written, so that the join has its own exchange and Spark can split a hot anchor in it
    often = stored(found.groupBy(F.col("m").alias("_m")).agg(F.count("*").alias("_n")).where("_n > 1").select("_m"))
    runs = stored(found.join(often, F.col("m") == F.col("_m"), "left_semi"))
    with_text = lambda lists: texts.select("doc", "text").join(lists.withColumnRenamed("doc", "_doc"), F.col("doc") == F.col("_doc")).select("doc", "text", "at")

    # references: one place of each window that is there more than once
    at = runs.groupBy("doc").agg(F.collect_list(F.struct("pos", "n", "m")).alias("at"))
    counted = with_text(at).mapInArrow(_windows(window), "w long, m long, doc long, pos int, n int")
    twice = counted.groupBy("w", "m").agg(F.sum("n").alias("times"), F.min_by("pos", "doc").alias("pos"), F.min("doc").alias("doc"))
    reference = stored(twice.where("times > 1").select("m", "doc", "pos"))

    # shards: anchors of one document's passages stay together; what is too much for a shard is cut by anchor, then by place
    by_anchor = stored(reference.groupBy("m").agg(F.count("*").alias("windows"), F.min("doc").alias("home")))
    load = by_anchor.groupBy(F.col("home").alias("_home")).agg(F.sum("windows").alias("load"))
    shards = reference.count() // SHARD_WINDOWS + 1
    whole = lambda c: F.ceil(F.col(c) / SHARD_WINDOWS)
    homes = by_anchor.join(load, F.col("home") == F.col("_home")).select(F.col("m").alias("_m"), _hash("home", F.pmod(_hash("m"), whole("load"))).alias("base"), whole("windows").alias("parts"))
    homes = stored(homes)
    shard = lambda part: F.pmod(_hash("base", part), F.lit(shards)).alias("shard")
    # `of` is an anchor's own share of a shard; most anchors have one part
    refs = reference.join(homes, F.col("m") == F.col("_m")).select("doc", F.lit(0).alias("kind"), shard(F.pmod(_hash("doc", "pos"), F.col("parts"))), "pos", F.lit(1).alias("n"))
    regions = stored(runs.join(homes, F.col("m") == F.col("_m")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("doc", F.lit(1).alias("kind"), shard(F.col("part")), "pos", "n"))
    tasks = stored(regions.groupBy(F.col("shard").alias("_shard")).agg((F.sum("n") / TASK_WINDOWS + 1).cast("int").alias("salts")))
    dealt = refs.unionByName(regions).join(tasks, F.col("shard") == F.col("_shard"))
    own = F.pmod(_hash("doc", F.floor(F.col("pos") / BLOCK)), F.col("salts")).cast("int")
    dealt = dealt.withColumn("salt", F.explode(F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(own))))
    lists = dealt.groupBy("doc").agg(F.collect_list(F.struct("kind", "shard", "salt", "pos", "n")).alias("at"))
    pieces = with_text(lists).mapInArrow(_pieces(window), "shard long, salt long, kind long, doc long, pos long, words binary")
    ordered = pieces.repartition(partitions(texts.sparkSession), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return ordered.mapInArrow(_streamed(window), "doc long, start long, end long")


def without_repeats(docs: DataFrame, key: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """key, n_words, spans (ranges of words removed, from 0), kept_text (the others joined by one space), for each row.

    A word goes if a window of `window` words covers it that starts anywhere
    else too, in the same text or another.

    1. Each window has an anchor, a short run of words that its content
       chooses. Windows whose anchor is nowhere else are out; that loses none.
    2. Of the others, those found twice or more by two 64-bit hashes, of the
       window and of its anchor, are the reference: one place of each, so its size follows the distinct repeated
       text, not the copies. Counts are partial sums, no group is gathered.
    3. The reference is dealt out to shards of bounded size, by anchor. Each
       shard's words go to every task that streams regions for it, and there
       make a suffix automaton. A hot shard has many such tasks.
    4. Regions around anchors are streamed through the automaton of their
       anchor's shard. Where the matching statistic reaches `window` words the
       maximal span goes. Words are compared one by one there, by 64-bit hashes.

    Equal windows have equal anchors, so every repeated window meets its
    reference; all windows of a reference are repeated, so nothing else goes.
    Null and empty texts, and texts of fewer words than a window, keep what
    they have. Every row is a document of its own, also if rows share a key or
    a text: two equal long texts remove each other whole. Null keys are keys
    like others. An empty table gives no rows. A long text is hashed in
    slices, and its regions may go to several tasks.
    """
    texts = _bucketed(docs, key)
    spans = repeated_spans(texts, window, anchor).groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("start", "end")).alias("found"))
    out = texts.join(spans, F.col("doc") == F.col("_doc"), "left")
    kept = out.select("doc", "key", "text", "found")
    schema = f"key {docs.schema[key].dataType.simpleString()}, " + _OUT
    return kept.mapInArrow(_with_key, schema).select(F.col("key").alias(key), "n_words", "spans", "kept_text")


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, at = batch.column("key"), 0
        for part in _kept(iter([batch])):
            yield pa.RecordBatch.from_arrays([keys.slice(at, part.num_rows), *part.columns], ["key", *part.schema.names])
            at += part.num_rows


def repeats_digest(docs: DataFrame) -> DataFrame:
    """The digest of op12: doc_id, n_words, n_removed, kept_sha256. Odd rows are as in without_repeats()."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return without_repeats(docs).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


REPEATS_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
n AS (SELECT r, generate_subscripts(w, 1) AS i, w FROM d),
g AS (SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS k FROM n WHERE i + {WINDOW - 1} <= len(w)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM g) WHERE c > 1),
x AS (SELECT DISTINCT r, unnest(generate_series(i, i + {WINDOW - 1})) AS i FROM t),
s AS (SELECT r, list(i) AS gone FROM x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[i] FOR i IN generate_series(1, len(w)) IF NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN s ON s.r = d.r"""
