"""Operator 10, document fingerprints: consistent weighted sampling of word pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, range_bounds
from .wordhash import mixed, shingles, text_hashes

#: Samples of a fingerprint; each becomes 16 bits of it.
SAMPLES = 64
#: Words of a term; a term's weight is how often it occurs.
TERM_WORDS = 2
#: Terms whose values are held at once; a text of no more hands them on to its edited text and to the one before it.
PART = 8192
#: Buckets of the order by doc_id, for each shuffle partition, and in all at the most.
BUCKETS_EACH, BUCKETS_MOST = 16, 1 << 16
_U = np.uint64
_NONE = np.iinfo(np.int64).min


class Values:
    """ln a of some terms for each sample; steps are those t that may not be 0, of the rows `more`."""

    def __init__(self, x: np.ndarray, w: np.ndarray, a: np.ndarray, more: np.ndarray, steps: np.ndarray):
        self.x, self.w, self.a, self.more, self.steps = x, w, a, more, steps

    def steps_of(self, rows: np.ndarray, samples: np.ndarray) -> np.ndarray:
        if not len(self.more):
            return np.zeros(len(rows), np.float32)
        at = np.minimum(np.searchsorted(self.more, rows), len(self.more) - 1)
        return np.where(self.more[at] == rows, self.steps[at, samples], np.float32(0))


class Sampler:
    """Improved consistent weighted sampling.

    For term x of weight w and sample k, with r, c ~ Gamma(2, 1) and b ~
    U(0, 1) fixed by (x, k): t = floor(ln w / r + b), ln y = r (t - b),
    ln a = ln c - ln y - r; the sample is (x, t) of the least a. Two texts'
    samples agree with the probability of their generalised Jaccard
    similarity, sum of least over sum of greatest weights.

    The three uniforms are sums modulo 1 of two table entries picked by two
    independent parts of x's hash, at 16 bits; a table maps them to Gamma.
    """

    def __init__(self, samples: int = SAMPLES, seed: int = 29):
        rng = np.random.default_rng(seed)
        self.tables = [[rng.integers(0, 1 << 16, (4096, samples), dtype=np.uint16) for _ in range(2)] for _ in range(3)]
        self.chain = rng.integers(0, 1 << 63, samples, dtype=np.uint64)
        u = (np.arange(1 << 16) + 0.5) / (1 << 16)
        x = np.linspace(0, 40, 400_001)
        gamma = np.interp(u, 1 - (1 + x) * np.exp(-x), x)  # the quantiles of Gamma(2, 1)
        self.gamma, self.log_gamma = gamma.astype(np.float32), np.log(gamma).astype(np.float32)

    def terms(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct terms of word hashes, ascending, and their weights."""
        return np.unique(shingles(h, TERM_WORDS), return_counts=True)

    def values(self, x: np.ndarray, w: np.ndarray) -> Values:
        """ln a of terms x of weights w for each sample, 1024 terms at once."""
        n = len(self.chain)
        a, more = np.empty((len(x), n), np.float32), np.flatnonzero(w > 1)
        steps = np.zeros((len(more), n), np.float32)
        for p in range(0, len(x), 1024):
            y = x[p : p + 1024]
            one, two = (y >> _U(52)).astype(np.intp), ((y >> _U(40)) & _U(4095)).astype(np.intp)
            r, c, b = (u.take(one, axis=0) + z.take(two, axis=0) for u, z in self.tables)
            r, c = self.gamma[r.astype(np.intp)], self.log_gamma[c.astype(np.intp)]
            b = (b + np.float32(0.5)) * np.float32(1 / 65536)
            a[p : p + 1024] = b * r + c - r  # with t = 0, as for every weight of 1
            i, j = np.searchsorted(more, [p, p + 1024])
            if i < j:
                at = more[i:j] - p
                t = steps[i:j] = np.floor(np.log(w[more[i:j]]).astype(np.float32)[:, None] / r[at] + b[at])
                a[more[i:j]] = c[at] - r[at] * (t - b[at]) - r[at]
        return Values(x, w, a, more, steps)

    def printed(self, parts: list[tuple[Values, np.ndarray | None]]) -> np.ndarray:
        """The signature of the terms of all parts (of some of a part's rows, ascending, if they are given); all zero without terms.

        Of equal least values that of the least term is taken, so parts may be cut in any way.
        """
        n = len(self.chain)
        best, term, code, every = np.full(n, np.inf, np.float32), np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.arange(n)
        some = False
        for v, rows in parts:
            count = len(v.x) if rows is None else len(rows)
            some |= count > 0
            for p in range(0, count, 1024):
                of = np.arange(p, min(p + 1024, count)) if rows is None else rows[p : p + 1024]
                a = v.a[p : p + 1024] if rows is None else v.a[of]
                at = a.argmin(axis=0)
                own, row = a[at, every], of[at]
                x = v.x[row]
                less = (own < best) | ((own == best) & (x < term))
                best[less], term[less] = own[less], x[less]
                code[less] = (x + v.steps_of(row, every).astype(np.int64).view(np.uint64) * _U(0x9E3779B97F4A7C15))[less]
        return (mixed(code ^ self.chain) >> _U(48)).astype("<u2") if some else np.zeros(n, "<u2")

    def signature(self, h: np.ndarray) -> np.ndarray:
        """Of word hashes; all zero without terms. Values of PART terms are held at once."""
        x, w = self.terms(h)
        return self.printed_in_parts(x, w, [])

    def printed_in_parts(self, x: np.ndarray, w: np.ndarray, known: list[Values]) -> np.ndarray:
        """The signature of terms x of weights w; values that are known are looked up there, the others are made, PART at once."""
        parts, rest = [], np.arange(len(x))
        for v in known:
            if len(v.x) and len(rest):
                at = np.minimum(np.searchsorted(v.x, x[rest]), len(v.x) - 1)
                same = (v.x[at] == x[rest]) & (v.w[at] == w[rest])
                parts.append((v, at[same]))
                rest = rest[~same]
        return self.printed([*parts, *((self.values(x[rest[p : p + PART]], w[rest[p : p + PART]]), None) for p in range(0, len(rest), PART))])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal samples; of fingerprints without terms, 1 if both are such and 0 otherwise."""
    if not a.any() or not b.any():
        return float(not a.any() and not b.any())
    return float((a == b).mean())


def _bucket(bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, ids, "right")


def _firsts(bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("k").to_numpy()
            buckets, at = np.unique(_bucket(bounds.value, ids), return_inverse=True)
            least = np.full(len(buckets), np.iinfo(np.int64).max)
            np.minimum.at(least, at, ids)
            yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int64)), pa.array(least)], ["b", "k"])

    return run


def _dealt(bounds, guests):
    """Rows with their bucket and compressed text; a bucket's first document also goes, as a guest, to the bucket before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for p in range(0, batch.num_rows, 512):
                part = batch.slice(p, 512)
                ids = part.column("k").to_numpy()
                z = [press.compress(t.encode()) for t in part.column("text").to_pylist()]
                real = part.column("doc_id").to_pylist()
                rows = [(b, 0, k, x, d) for b, k, x, d in zip(_bucket(bounds.value, ids).tolist(), ids.tolist(), z, real)]
                rows += [(g, 1, k, x, d) for _, _, k, x, d in rows if (g := guests.value.get(k)) is not None]
                b, late, k, x, d = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(late, pa.int32()), pa.array(k, pa.int64()), pa.array(x, pa.binary()), pa.array(d, pa.int64())], ["bucket", "late", "k", "z", "doc_id"])

    return run


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _printed(samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, sampler = zstandard.ZstdDecompressor(), Sampler(samples)
        out: list[tuple] = []
        before, closed = None, None  # the document that waits for its next one; the bucket whose guest has come

        def batch_of() -> pa.RecordBatch:
            rows, kinds = list(zip(*out)), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], [c.split()[0] for c in _RESULT.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                bucket, late = batch.column("bucket")[i].as_py(), batch.column("late")[i].as_py()
                if late and bucket == closed:
                    continue  # one of several rows of the first doc_id; the first of them has been taken
                data = press.decompress(batch.column("z")[i].as_py())
                text = data.decode()
                x, w = sampler.terms(text_hashes(data))
                values = sampler.values(x, w) if len(x) <= PART else None
                print_ = sampler.printed([(values, None)]) if values else sampler.printed_in_parts(x, w, [])
                if before is not None and before[0] == bucket:
                    _, d, old, old_print, old_values = before
                    n = len(old)
                    edited = (old[: n - n // 4] + text[: n // 4]).encode()
                    # most terms of the edited text are those of the two texts it is made of
                    other = sampler.printed_in_parts(*sampler.terms(text_hashes(edited)), [v for v in (old_values, values) if v])
                    out.append((d, n, hashlib.sha256(edited).hexdigest(), old_print.tobytes().hex(), other.tobytes().hex(), likeness(old_print, other), likeness(old_print, print_)))
                    if len(out) >= 512:
                        yield batch_of()
                before, closed = (None, bucket) if late else ((bucket, batch.column("doc_id")[i].as_py(), text, print_, values), closed)
        if out:
            yield batch_of()

    return run


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every whole text.

    Documents go, compressed, to buckets of the order by doc_id (cut points
    from a bounded sample of the ids), are sorted there and pass a worker one
    by one, each met by its next; the next of a bucket's last document comes
    to it as a guest. After the last document comes the first, which is its
    own next if it is alone. A null doc_id comes before all others; rows of
    equal doc_id are ordered by a hash of the text. Null texts count as empty;
    a text without words has a fingerprint of zeros. An empty table gives no
    rows. Memory holds two texts and the values of PART terms of each.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("k"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    buckets = min(BUCKETS_MOST, BUCKETS_EACH * partitions(spark))
    ids = rows.select("k")
    bounds = sc.broadcast(range_bounds(ids, "k", buckets))
    firsts = sorted((r["b"], r["k"]) for r in ids.mapInArrow(_firsts(bounds), "b long, k long").groupBy("b").agg(F.min("k").alias("k")).collect())
    guests = sc.broadcast({k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)})
    dealt = rows.mapInArrow(_dealt(bounds, guests), "bucket long, late int, k long, z binary, doc_id long")
    return dealt.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "late", "k", F.xxhash64("z")).mapInArrow(_printed(samples), _RESULT)
