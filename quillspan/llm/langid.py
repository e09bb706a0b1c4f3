"""Operator 8, language ID: n-gram filters that return a bitmask of languages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold, unused, utf32
from .wordhash import mixed

#: Documents of each language that the filters learn from, at the most.
TRAIN_DOCS = 3000
#: A language's n-grams with at least this share of all it has: 1 / SHARE of them at the most.
SHARE = 1e-5
#: Rows of the bit-sliced filter (a power of two), and how many of them an n-gram sets.
SLOTS, PROBES = 1 << 21, 3
#: The pipeline's bound: a document goes if this part of its n-grams at the least is in no language's filter.
UNKNOWN = 0.8
_SLICE = 1 << 19
_U = np.uint64


def _letters() -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _ALPHA


_ALPHA: np.ndarray | None = None


def symbols(parts: list[str], heads: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the parts, each run of other characters as one space; the part each is of; which parts have a letter after their head.

    A part's first `heads` characters are kept as they are.
    """
    points = [utf32(p) for p in parts]
    x, part = np.concatenate(points), np.repeat(np.arange(len(parts)), [len(p) for p in points])
    at = np.arange(len(x)) - np.repeat(np.cumsum([0, *[len(p) for p in points[:-1]]]), [len(p) for p in points])
    alpha, head = _letters()[x], at < np.array(heads)[part]
    lettered = np.bincount(part[alpha & ~head], minlength=len(parts)) > 0
    keep = alpha | head
    keep[1:] |= alpha[:-1]
    return np.where(alpha[keep], x[keep], 32), part[keep], lettered


def grams(parts: list[str], heads: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of 4-grams of the parts' symbols, the part each is of, and which parts have a letter after their head."""
    x, part, lettered = symbols(parts, heads)
    if len(x) < 4:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), lettered
    x = x.astype(np.uint64)
    h = mixed((x[:-3] | x[1:-2] << _U(21) | x[2:-1] << _U(42)) + x[3:] * _U(0xD6E8FEB86659FD93))
    whole = part[:-3] == part[3:]
    return h[whole], part[:-3][whole], lettered


def runs(texts: list[str | None]) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Parts of lower-cased texts, their heads, and the text each is of, about _SLICE characters at once.

    A text has two spaces before it and one after it. A longer one comes in
    parts; a part's head is the last three symbols before it, so the parts have
    the n-grams of the whole text.
    """
    parts, heads, owners, held = [], [], [], 0
    for i, t in enumerate(texts):
        text, head = (t or "").lower() + "\n", "\n\n"
        for p in range(0, len(text), _SLICE):
            parts.append(head + text[p : p + _SLICE])
            heads.append(len(head))
            owners.append(i)
            held += len(parts[-1])
            if p + _SLICE < len(text):
                head = "".join(map(chr, symbols([parts[-1]], [len(head)])[0][-3:].tolist()))
            if held >= _SLICE:
                yield parts, heads, owners
                parts, heads, owners, held = [], [], [], 0
    if parts:
        yield parts, heads, owners


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in set(langs):
            own = [t for t, x in zip(batch.column("text").to_pylist(), langs) if x == lang]
            for parts, heads, _ in runs(own):
                h, n = np.unique(grams(parts, heads)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Filters:
    """A row of language bits for each of SLOTS places; an n-gram's languages are the AND of its PROBES rows."""

    def __init__(self, langs: list[str], sets: list[np.ndarray], common: int):
        self.langs, self.common, words = langs, common, -(-max(1, len(langs)) // 64)
        self.rows = np.zeros((SLOTS, words), np.uint64)
        for i, s in enumerate(sets):
            for k in range(PROBES):
                np.bitwise_or.at(self.rows[:, i // 64], self._slots(s, k), _U(1) << _U(i % 64))
        fill = [((self.rows[:, i // 64] >> _U(i % 64)) & _U(1)).mean() for i in range(len(langs))]
        self.false = np.array(fill) ** PROBES

    @staticmethod
    def _slots(h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> _U(21 * k)) & _U(SLOTS - 1)).astype(np.int64)

    def languages(self, h: np.ndarray) -> np.ndarray:
        out = self.rows[self._slots(h, 0)]
        for k in range(1, PROBES):
            out &= self.rows[self._slots(h, k)]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and the share of n-grams that the language knows, for each text."""
        n = len(texts)
        total, hits, lettered = np.zeros(n), np.zeros((n, len(self.langs))), np.zeros(n, bool)
        for parts, heads, owners in runs(texts):
            h, doc, some = grams(parts, heads)
            owner = np.array(owners)
            np.logical_or.at(lettered, owner, some)
            doc = owner[doc]
            total += np.bincount(doc, minlength=n)
            masks = self.languages(h)
            for i in range(len(self.langs)):
                hits[:, i] += np.bincount(doc, (masks[:, i // 64] >> _U(i % 64)) & _U(1), minlength=n)
        if not self.langs:
            return ["und"] * n, np.zeros(n), np.zeros(n)
        true = np.clip((hits - total[:, None] * self.false) / (1 - self.false), 0, None)
        best = np.where(true.max(axis=1) > 0, true.argmax(axis=1), self.common)
        top = true[np.arange(n), best]
        score = np.where(true.sum(axis=1) > 0, top / np.maximum(true.sum(axis=1), 1e-12), 0)
        known = np.divide(top, total, out=np.zeros(n), where=total > 0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered)], np.where(lettered, score, 0), np.where(lettered, np.minimum(known, 1), 0)


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Filters:
    """Filters from rows (doc_id, text, lang) outside fold 1 of 3 with a language: at most train_docs of each, by a hash of doc_id."""
    rows = docs.where(crc_fold("doc_id", 3) != 1).where("lang is not null and text is not null").select("doc_id", "lang", "text")
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(many)
    if not langs:
        return Filters([], [], 0)
    near = F.lit(False)
    for lang in langs:
        share = min(1.0, train_docs / many[lang])
        near = near | ((F.col("lang") == lang) & (F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30)) < int((1 << 30) * share)))
    counts = rows.where(near).select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(total, "lang").where(F.col("n") >= F.greatest(F.lit(2), F.col("total") * SHARE)).select("lang", "gram").toPandas()
    sets = [kept["gram"][kept["lang"] == lang].to_numpy(np.int64).view(np.uint64) for lang in langs]
    return Filters(langs, sets, max(range(len(langs)), key=lambda i: many[langs[i]]))


def _predicted(filters, at: str, keep: list[str], added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Filters = filters.value
        for batch in batches:
            for p in range(0, batch.num_rows, 512):
                part = batch.slice(p, 512)
                lang, score, known = f.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], [*keep, *added])

    return run


def predict(docs: DataFrame, filters: Filters, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """The columns kept and language, score and known share, and the names of these three. Null texts and texts without a letter are 'und' with score 0."""
    shared, added = docs.sparkSession.sparkContext.broadcast(filters), unused(docs.columns, "_lang", "_score", "_known")
    kind = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, t) for c, t in zip(added, (T.StringType(), T.DoubleType(), T.DoubleType()))]])
    return docs.mapInArrow(_predicted(shared, "text", keep, added), kind), added


def language_digest(docs: DataFrame) -> DataFrame:
    """The digest of op8; where no row has a language, every prediction is 'und'.

    Each row is predicted on its own, so repeated rows agree; languages that
    tie are told in order of their names. Only doc_id, text and, for learning,
    lang are read, whatever other columns are called. A very long text is read
    in slices and predicted by all of its n-grams. An empty table gives no rows.
    """
    out, (lang, score, _) = predict(docs.select("doc_id", "text"), learn(docs), ["doc_id"])
    return out.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def language_stage(docs: DataFrame) -> DataFrame:
    """Keeps documents with letters of whose n-grams the predicted language knows at least 1 - UNKNOWN; columns may have any names. Null texts go; an empty table stays empty."""
    out, (lang, _, known) = predict(docs, learn(docs), docs.columns)
    return out.where((F.col(lang) != "und") & (F.col(known) >= 1 - UNKNOWN)).select(*docs.columns)
