"""Many patterns searched in many texts, and prefixes of many texts, both by joins of equality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.sources.shared import stored

#: Characters of a gram; grams from which a long pattern's anchor is chosen; slots of the filter that tasks hold.
GRAM, CHOICE, SLOTS = 8, 24, 1 << 20
_U = np.uint64


def grams(text: str, size: int) -> np.ndarray:
    """64-bit hashes of the runs of `size` characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    n = len(codes) - size + 1
    if n < 1:
        return np.zeros(0, _U)
    out = np.full(n, size, _U)
    for k in range(size):
        out = (out ^ codes[k : k + n]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return out


def least_of_runs(x: np.ndarray, size: int) -> np.ndarray:
    """The least entry of each run of `size`, by doubling."""
    run = 1
    while run < size:
        step = min(run, size - run)
        x, run = np.minimum(x[step:], x[:-step]), run + step
    return x


def tier_of(length: int) -> int:
    """How a pattern of so many characters is anchored: 0 by the least gram of its first CHOICE, GRAM by its first gram, less by itself."""
    return 0 if length >= GRAM + CHOICE - 1 else min(length, GRAM)


def anchor(pattern: str) -> tuple[int, int]:
    tier = tier_of(len(pattern))
    found = grams(pattern, tier or GRAM)
    return tier, int((found[:CHOICE].min() if tier == 0 else found[0]).view(np.int64))


def text_anchors(text: str, tiers: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each tier the distinct hashes of which a pattern of that tier has one if the text contains it."""
    for tier in tiers:
        found = grams(text, tier or GRAM)
        if tier == 0:
            if len(found) < CHOICE:
                continue
            found = least_of_runs(found, CHOICE)
        yield tier, np.unique(found)


def _pattern_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [anchor(p) for p in batch.column("pattern").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("pattern"), pa.array([t for t, _ in told], pa.int32()), pa.array([h for _, h in told], pa.int64())], ["pattern", "tier", "hash"])


def _search(tiers: list[int], slots: bytes):
    may = np.unpackbits(np.frombuffer(slots, np.uint8)).astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                for tier, found in text_anchors(text, tiers):
                    found = found[may[(found % _U(SLOTS)).astype(np.int64)]]
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row)), pa.array(np.full(len(found), tier, np.int32)), pa.array(found.view(np.int64))], ["row", "tier", "hash"])

    return run


def containing(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Rows of texts with each distinct pattern that they contain, as it is written, also inside of words; `pattern` is added.

    Any number of patterns, of any lengths. Each has one anchor: a run of its
    characters which is also looked at in every text that contains it. For
    patterns of 31 characters or more a text has one such run in about twelve;
    only if there are shorter ones, all of its runs of their length. What no
    pattern can have is dropped where it arises, by a bit table of fixed size
    (a full one drops less, and loses nothing). Texts and patterns then meet by
    equality of anchors, and `contains` decides. Texts aren't shuffled unless
    the pairs that met are too many for Spark to broadcast. Null and empty
    patterns, and null texts, are met by nothing; equal rows are each told.
    """
    spark = texts.sparkSession
    known = stored(patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct().mapInArrow(_pattern_anchors, "pattern string, tier int, hash long"))
    tiers = sorted(r["tier"] for r in known.select("tier").distinct().collect())
    bits = np.zeros(SLOTS, bool)
    slots = known.select(F.col("hash").bitwiseAND(SLOTS - 1).cast("int").alias("s")).distinct()
    bits[[r["s"] for r in slots.collect()]] = True  # SLOTS at the most
    row = F.xxhash64(*texts.columns)
    if not tiers:
        return texts.where("false").withColumn(pattern, F.lit(None).cast("string"))
    found = texts.where(F.col(text).isNotNull()).select(row.alias("row"), F.col(text).alias("text")).mapInArrow(_search(tiers, np.packbits(bits).tobytes()), "row long, tier int, hash long")
    met = found.join(known.withColumnRenamed("tier", "_t").withColumnRenamed("hash", "_h"), (F.col("tier") == F.col("_t")) & (F.col("hash") == F.col("_h"))).select(F.col("row").alias("_row"), F.col("pattern").alias("_pattern")).distinct()
    out = texts.join(stored(met), row == F.col("_row")).where(F.col(text).contains(F.col("_pattern")))
    return out.select(*texts.columns, F.col("_pattern").alias(pattern))


def by_owner(hits: DataFrame, owners: DataFrame, key: str, env: str) -> DataFrame:
    """hits (key, env, ...) with owners (array of environments that own the key) and own: whether the hit's own environment is one of them.

    owners (key, env): a key of an environment's own is written out in its place, one of others only leaks.
    """
    of = owners.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_set(env)).alias("owners"))
    return hits.join(of, F.col(key) == F.col("_key")).drop("_key").withColumn("own", F.array_contains("owners", F.col(env)))


def longest_prefixes(texts: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """All rows of texts with the longest of the prefixes that the text starts with, or null, as `prefix`.

    Distinct texts are cut to each length that prefixes have, and meet them by
    equality; the longest hit is a partial aggregate. The list is a table of
    any size; only its different lengths come to the driver, so as many
    numbers as its longest entry has characters at the most. An empty prefix is one of every text; null ones are of none.
    """
    known = stored(prefixes.select(F.col(prefix).alias("_prefix")).where("_prefix is not null").distinct())
    lengths = sorted(r[0] for r in known.select(F.length("_prefix")).distinct().collect())
    if not lengths:
        return texts.withColumn(prefix, F.lit(None).cast("string"))
    cut: Column = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("_text"))
    tried = texts.select(F.col(text).alias("_text")).where("_text is not null").distinct().select("_text", F.explode(F.transform(cut, lambda n: F.substring(F.col("_text"), F.lit(1), n))).alias("_cut"))
    best = tried.join(known, F.col("_cut") == F.col("_prefix")).groupBy("_text").agg(F.max_by("_prefix", F.length("_prefix")).alias("_best"))
    return texts.join(best, F.col(text) == F.col("_text"), "left").select(*texts.columns, F.col("_best").alias(prefix))
