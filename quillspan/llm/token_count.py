"""Operator 3, token counts: a broadcast hash table of frequent pieces' lengths, and a worker's cache behind it."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import Table, borders, distinct, hashes, runs

#: Frequent pieces in the broadcast table, and rows that they are counted in, at the most; counts of tokens don't depend on either.
FREQUENT, SAMPLE_ROWS = 50_000, 4_000
#: Lengths of other pieces that a worker keeps, at the most; then it starts anew.
CACHE = 600_000
#: Characters for which white space, lower case and composition are the same in every Unicode version: up to
#: U+02AF but for separators U+001C to U+001F, U+0085, U+00A0 and U+0130, and common dashes, quotes and signs.
_ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-įı-ʯ‐-‧‰-⁞€™]")
_WORD = re.compile(" ?[a-z]+")


def odd(text: str) -> bool:
    """Whether a text is left to the library whole: special strings, or characters that may be treated in more than one way."""
    return "<|" in text or not text.isascii() and _ODD.search(text) is not None or any(c in text for c in "\x1c\x1d\x1e\x1f")


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """For runs of lower-cased texts: two hashes of each piece, the text each is of, and a function from places to the pieces' strings."""
    for data, firsts, owners in runs([t.lower().encode() for t in texts]):
        raw = np.frombuffer(data, np.uint8)
        starts = borders(raw, firsts)
        ends = np.append(starts[1:], len(data))
        yield *hashes(raw, starts), owners[np.searchsorted(firsts, starts, "right") - 1], lambda k, d=data, a=starts, b=ends: [d[x:y].decode() for x, y in zip(a[k].tolist(), b[k].tolist())]


class Counter:
    """Lengths of texts in tokens: pieces by the frequent ones' table, then by the worker's own, then by the library."""

    def __init__(self, tokenizer_json: str, frequent: Table, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.frequent, self.most, self.known = frequent, cache, Table(cache)
        self.seen = self.missed = 0

    def encoded(self, texts: list[str]) -> np.ndarray:
        """Lengths by the library: a plain word is one pre-token, which its model takes as it is; the others go through it whole, in one call."""
        words = [_WORD.fullmatch(t) is not None for t in texts]
        others = iter(self.library.encode_batch([t for t, w in zip(texts, words) if not w], add_special_tokens=False))
        return np.array([len(self.model.tokenize(t.lstrip())) if w else len(next(others)) for t, w in zip(texts, words)], np.int64)

    def lengths(self, one: np.ndarray, two: np.ndarray, strings) -> np.ndarray:
        n = self.frequent.find(one, two)
        rare = np.flatnonzero(n < 0)
        self.seen, self.missed = self.seen + len(n), self.missed + len(rare)
        if not len(rare):
            return n
        a, b = one[rare], two[rare]
        found = self.known.find(a, b)
        if (found < 0).any():
            new = np.flatnonzero(found < 0)
            new = new[distinct(a[new], b[new])]
            if self.known.size + len(new) > self.most:
                new = distinct(a, b)
                self.most = max(self.most, 2 * len(new))
                self.known = Table(self.most)
            self.known.add(a[new], b[new], self.encoded(strings(rare[new])))
            found = self.known.find(a, b)
        n[rare] = found
        return n

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        plain = []
        for i, t in enumerate(texts):
            if t and odd(t):  # the library itself, for its own tables and special strings
                out[i] = self.encoded([t])[0]
            elif t:
                plain.append(i)
        for one, two, owner, strings in pieces([texts[i] for i in plain]):
            out += np.bincount(np.array(plain)[owner], self.lengths(one, two, strings), minlength=len(texts)).astype(np.int64)
        return out


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one, _, _, strings in pieces([t for t in batch.column("text").to_pylist() if t and not odd(t)]):
            _, at, n = np.unique(one, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(strings(at), pa.string()), pa.array(n.astype(np.int64))], ["piece", "n"])


def length_table(found: list[str], tokenizer_json: str) -> Table:
    """The lengths of distinct pieces, by the library."""
    table = Table(len(found))
    if found:
        n = Counter(tokenizer_json, table).encoded(found)
        data = [p.encode() for p in found]
        table.add(*hashes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data[:-1])])), n)
    return table


def frequent_lengths(docs: DataFrame, tokenizer_json: str, frequent: int = FREQUENT, sample_rows: int = SAMPLE_ROWS) -> Table:
    """The table of the pieces that are most frequent in a sample of at most about sample_rows rows, of any script and any length in tokens.

    Only the sample's pieces are shuffled, as counts for each slice of text;
    the driver gets `frequent` of them, and encodes those.
    """
    rows = docs.count()
    sample = docs.select("text").where("text is not null")
    sample = sample if rows <= sample_rows else sample.sample(sample_rows / rows, seed=3)
    counts = sample.mapInArrow(_partial, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return length_table([r["piece"] for r in counts.orderBy(F.desc("n"), "piece").limit(frequent).collect()], tokenizer_json)


def _counted(shared, cache: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, frequent = shared.value
        counter = Counter(tokenizer, frequent, cache)
        for batch in batches:
            for p in range(0, batch.num_rows, 512):
                part = batch.slice(p, 512)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(counter.count(part.column("_text").to_pylist()))], [*names, "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_json: str, limit: int = 2048, cache: int = CACHE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; one pass, no shuffle of its pre-tokens.

    Counts are those of the library without added tokens: its normaliser maps
    white space to spaces and lower-cases, and no pre-token crosses the borders
    of pieces, so a text has the sum of its pieces' lengths. Pieces are told
    apart by two 64-bit hashes. Texts with special strings or characters whose
    class varies between Unicode versions go to the library whole. Null and
    empty texts have none; rows may repeat; an empty table gives no rows. A
    very long text is cut like others, and only its length is summed.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast((tokenizer_json, frequent_lengths(docs, tokenizer_json)))
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    kind = f"doc_id {dict(slim.dtypes)['doc_id']}, n_bytes long, n_tokens long"
    return slim.mapInArrow(_counted(shared, cache, ["doc_id", "n_bytes"]), kind).withColumn("over_limit", F.col("n_tokens") > limit)
