"""Operator 5, quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, crc_fold, unused
from .wordhash import SLICE, mixed, shingles, word_hashes

#: Labelled documents that the model learns from, at the most.
TRAIN_DOCS = 8000
#: Buckets of words; statistics come after them.
WORDS, RANK = 1 << 16, 8
#: Score from which a document counts as good.
GOOD = 0.7
_U = np.uint64
#: Byte classes: upper case, lower case, digits, white space, stops, other ASCII signs, beyond ASCII, newlines.
_CLASSES = 8


def _classes() -> np.ndarray:
    c = np.full(256, 5, np.uint8)
    c[65:91], c[97:123], c[48:58] = 0, 1, 2
    c[[32, 9, 11, 12, 13]], c[10], c[128:] = 3, 7, 6
    c[[ord(x) for x in ".,;:?'\"-()"]] = 4
    return c


_CLASS = _classes()
STATS = 6 * 2 + 8


def byte_counts(texts: pa.Array) -> np.ndarray:
    """Bytes of each class in each text."""
    texts = texts.cast(pa.large_string())
    out = np.zeros((len(texts), _CLASSES), np.int64)
    if not len(texts):
        return out
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a, end = int(offsets[0]), int(offsets[-1])
    while a < end:
        b = min(end, a + SLICE)
        first, last = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
        cuts = np.clip(offsets[first : last + 1], a, b) - a
        doc = np.repeat(np.arange(last - first, dtype=np.int32), np.diff(cuts))
        out[first:last] += np.bincount(doc * _CLASSES + _CLASS[raw[a:b]], minlength=(last - first) * _CLASSES).reshape(-1, _CLASSES)
        a = b
    return out


def features(texts: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (bounds, ids, values) of words with unit length in each row; STATS dense values follow from `statistics`."""
    bounds, ids, values = [0], [], []
    dense = np.zeros((len(texts), STATS), np.float32)
    counts = byte_counts(texts).astype(np.float64)
    total = np.maximum(counts.sum(axis=1), 1)
    for i, j, h, cuts in word_hashes(texts, lower=False):
        n = np.diff(cuts)
        doc = np.repeat(np.arange(j - i), n)
        key, tf = np.unique(doc.astype(np.int64) << 16 | (h >> _U(48)).astype(np.int64), return_counts=True)
        d = key >> 16
        x = np.sqrt(tf).astype(np.float32)
        norm = np.sqrt(np.bincount(d, x * x, minlength=j - i))
        ids.append((key & 0xFFFF).astype(np.int32))
        values.append((x / norm[d]).astype(np.float32))
        bounds.extend((bounds[-1] + np.cumsum(np.bincount(d, minlength=j - i))).tolist())
        distinct = np.bincount(d, minlength=j - i) / np.maximum(n, 1)
        s = shingles(h, 3) if len(h) >= 3 else h[:0]
        own = doc[: len(s)]
        same = own == doc[2:] if len(s) else np.zeros(0, bool)
        _, at = np.unique(mixed(s[same] + own[same].astype(np.uint64)), return_index=True)
        runs = np.bincount(own[same], minlength=j - i)
        fresh = np.where(runs > 0, np.bincount(own[same][at], minlength=j - i) / np.maximum(runs, 1), 1)
        share = np.zeros(j - i)
        np.maximum.at(share, d, tf / np.maximum(n, 1)[d])
        dense[i:j, 12:] = np.stack([np.log1p(n), np.log1p(n_chars[i:j]), distinct, fresh, share, counts[i:j, [0, 1, 2, 6]].sum(1) / np.maximum(n, 1), np.log1p(counts[i:j, 7]), counts[i:j, 7] / np.maximum(n, 1)], axis=1)
    part = counts[:, [0, 2, 4, 5, 6, 3]] / total[:, None]
    dense[:, :6], dense[:, 6:12] = part, np.sqrt(part)
    return np.array(bounds, np.int64), np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate(values) if values else np.zeros(0, np.float32), dense


#: Passes over the labelled documents, at every size.
EPOCHS = 40


class Machine:
    """y = w0 + sum w x + 1/2 sum over factors of (sum v x)^2 - sum (v x)^2: linear in the nonzero features."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 5):
        self.mean, self.spread = mean, spread
        self.w0, self.w = 0.0, np.zeros(WORDS + STATS, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (WORDS + STATS, RANK)).astype(np.float32)

    def rows(self, bounds, ids, values, dense) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value) of all nonzero features; statistics are standardised and clipped."""
        n = len(bounds) - 1
        z = np.clip((dense - self.mean) / self.spread, -4, 4).astype(np.float32) * 0.5
        return (
            np.concatenate([np.repeat(np.arange(n), np.diff(bounds)), np.repeat(np.arange(n), STATS)]),
            np.concatenate([ids, np.tile(np.arange(WORDS, WORDS + STATS, dtype=np.int32), n)]),
            np.concatenate([values, z.ravel()]),
        )

    def raw(self, n: int, row, feature, x) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[feature] * x[:, None]
        sums = np.stack([np.bincount(row, v[:, f], minlength=n) for f in range(RANK)], axis=1)
        return self.w0 + np.bincount(row, self.w[feature] * x, minlength=n) + 0.5 * ((sums**2).sum(1) - np.bincount(row, (v * v).sum(1), minlength=n)), sums

    def score(self, texts: pa.Array, n_chars: np.ndarray) -> np.ndarray:
        found = features(texts, n_chars)
        return 1 / (1 + np.exp(-np.clip(self.raw(len(texts), *self.rows(*found))[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.08, decay: float = 1e-4) -> None:
        """Adagrad on the logistic loss, in an order fixed by the seed."""
        rng, sw, sv, s0 = np.random.default_rng(7), np.full(len(self.w), 1e-3), np.full(self.v.shape, 1e-3), 1e-3
        self.w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for p in range(0, len(order), batch):
                own = order[p : p + batch]
                row = np.concatenate([np.full(len(rows[i][0]), k) for k, i in enumerate(own)])
                feature, x = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
                out, sums = self.raw(len(own), row, feature, x)
                d = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[own]) / len(own)).astype(np.float32)
                used, at = np.unique(feature, return_inverse=True)
                dx = d[row] * x
                gw = np.bincount(at, dx) + decay * self.w[used]
                gv = np.stack([np.bincount(at, dx * (sums[row, f] - self.v[feature, f] * x)) for f in range(RANK)], axis=1) + decay * self.v[used]
                g0 = float(d.sum())
                s0 += g0 * g0
                sw[used] += gw * gw
                sv[used] += gv * gv
                self.w0 -= rate * g0 / np.sqrt(s0)
                self.w[used] -= (rate * gw / np.sqrt(sw[used])).astype(np.float32)
                self.v[used] -= (rate * gv / np.sqrt(sv[used])).astype(np.float32)


def _prepared(docs: DataFrame, names: list[str], *keep: str | Column) -> DataFrame:
    """The columns kept, and by these two names text and number of characters (the metadata column, where it is there and not null)."""
    n = F.length("text").cast("long")
    n = F.coalesce(F.col("n_chars").cast("long"), n, F.lit(0)) if "n_chars" in docs.columns else F.coalesce(n, F.lit(0))
    return docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias(names[0]), F.greatest(n, F.lit(0)).alias(names[1]))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bounds, ids, values, dense = features(batch.column("_t"), batch.column("_n").to_numpy())
        rows = range(batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array([ids[bounds[i] : bounds[i + 1]].tobytes() for i in rows], pa.binary()), pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in rows], pa.binary()), pa.array([dense[i].tobytes() for i in rows], pa.binary())], ["doc_id", "y", "ids", "x", "dense"]
        )


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Machine:
    """A machine fitted to labels.quality outside fold 2 of 4, of at most train_docs documents, by a hash of doc_id.

    The labels chosen are as bounded, so they are broadcast: no text moves.
    Repeated labels of a document count once, the least; null ones not at all;
    of a repeated doc_id one row, the least by text.
    """
    told = labels.where(crc_fold("doc_id", 4) != 2).where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").cast("double").alias("y"))
    chosen = bounded_sample(told, "_id", told.count(), train_docs)
    picked = _prepared(docs, ["_t", "_n"], F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    one = picked.groupBy("doc_id").agg(F.min("y").alias("y"), F.min(F.struct("_t", "_n")).alias("_r"))
    got = one.select("doc_id", "y", "_r._t", "_r._n").mapInArrow(_featured, "doc_id long, y double, ids binary, x binary, dense binary").toArrow()
    got = got.take(np.argsort(got.column("doc_id").to_numpy(), kind="stable"))
    if not got.num_rows:
        return Machine(np.zeros(STATS, np.float32), np.ones(STATS, np.float32))
    dense = np.array([np.frombuffer(x, np.float32) for x in got.column("dense").to_pylist()])
    machine = Machine(dense.mean(0), dense.std(0) + 1e-3)
    rows = []
    for i, x, d in zip(got.column("ids").to_pylist(), got.column("x").to_pylist(), dense):
        ids = np.frombuffer(i, np.int32)
        rows.append(machine.rows(np.array([0, len(ids)]), ids, np.frombuffer(x, np.float32), d[None])[1:])
    y = (got.column("y").to_numpy() > 0.5).astype(np.float32)
    machine.fit(rows, y, epochs=EPOCHS)
    return machine


def _scored(machine, names: list[str], keep: list[str], added: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in range(0, batch.num_rows, 512):
                part = batch.slice(p, 512)
                score = machine.value.score(part.column(names[0]), part.column(names[1]).to_numpy())
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), pa.array(score, pa.float64())], [*keep, added])

    return run


def scored(docs: DataFrame, machine: Machine, *keep: str) -> tuple[DataFrame, Column]:
    """The columns kept and a score, and that score's column: its name differs from all others."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    *names, added = unused(docs.columns, "_t", "_n", "_score")
    kind = T.StructType([*[docs.schema[c] for c in keep], T.StructField(added, T.DoubleType())])
    return _prepared(docs, names, *keep).mapInArrow(_scored(shared, names, list(keep), added), kind), F.col(added)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of op5: doc_id, held_out, score, predicted; null texts are scored as empty ones.

    Each row is scored on its own, so repeated rows get equal scores and ties
    don't matter; only doc_id and text are read, whatever other columns are
    called. A very long text is scored whole, by the features it has. An empty
    table gives no rows; without labels every score is the same.
    """
    out, score = scored(docs, learn(docs, labels), "doc_id")
    return out.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), score.alias("score"), (score >= GOOD).cast("int").alias("predicted"))


def quality_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Keeps documents that score GOOD or more; columns may have any names. Null texts are scored as empty ones; an empty table stays empty."""
    out, score = scored(docs, learn(docs, labels), *docs.columns)
    return out.where(score >= GOOD).select(*docs.columns)
