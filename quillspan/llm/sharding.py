"""Operator 1, sharding: jump consistent hashing, native expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published generator: multiplier, 2^64, 2^33, 2^31.
MULTIPLIER, WORD_64, SHIFT_33, SCALE_31 = 2862933555777941757, 1 << 64, 1 << 33, 1 << 31
#: Sub-buckets of a shard; each is ranked by a task of its own.
SLOT_BUCKETS = 4096


def jump(key: str, shards: int) -> Column:
    """struct(b, j): the shard of a key among `shards`, and the shard it jumps to next (>= shards).

    b is exactly the published jump hash of the key as an unsigned 64-bit
    number; with any larger count n the shard stays b unless j < n. The
    products need 126 bits, so they are decimals (long would overflow).
    A null key counts as 0. Jumps strictly rise, so shards + 1 steps always
    suffice; over 128 they are cut at a length that chance exceeds less often
    than once in 10^20 keys.
    """
    step = lambda k: f"cast(({k} * {MULTIPLIER}BD + 1BD) % {WORD_64}BD as decimal(20,0))"
    steps = shards + 1 if shards <= 127 else int(128 + 4 * math.log(shards))
    first = f"cast(pmod(cast(coalesce({key}, 0) as decimal(20,0)), {WORD_64}BD) as decimal(20,0))"
    return F.expr(
        f"""aggregate(sequence(1, {steps}),
            named_struct('k', {step(first)}, 'b', -1L, 'j', 0L),
            (s, i) -> if(s.j < {shards},
                named_struct('k', {step("s.k")}, 'b', s.j,
                             'j', cast(floor((s.j + 1) * ({float(SCALE_31)}D / ((s.k div {SHIFT_33}BD) + 1))) as bigint)),
                s),
            s -> named_struct('b', s.b, 'j', s.j))"""
    )


def shard(docs: DataFrame, shards: int, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Deals rows out to `shards` shards by their key.

    Returns key, the columns of `keep`, shard int, slot long and grown_shard
    int (the shard with one shard more: its own, or the new one). Slots of a
    shard run from 0 without a gap, in order of (sub-bucket, key); the
    sub-bucket is a hash of the key, so no task ranks more than a shard's
    4096th part. Null keys share the shard of key 0; rows of the same key
    share a shard and get slots of their own. An empty table gives no rows.
    Only the key column is read for the counts; the wide columns move once.
    """
    rows = docs.select(F.col(key).cast("long").alias("_k"), *[F.col(c) for c in keep])
    at = lambda df: df.withColumn("_s", jump("_k", shards)).withColumn("_bucket", F.pmod(F.xxhash64("_k"), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = at(rows.select("_k")).groupBy(F.col("_s.b").cast("int").alias("_sh"), F.col("_bucket").alias("_bk")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_sh").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_sh", "_bk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    dealt = at(rows).withColumn("_shard", F.col("_s.b").cast("int"))
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_shard", "_bucket").orderBy("_k", *keep)))
    return ranked.join(starts, (F.col("_shard") == F.col("_sh")) & (F.col("_bucket") == F.col("_bk"))).select(
        F.col("_k").alias(key), *keep, F.col("_shard").alias("shard"), (F.col("_start") + F.col("_r") - 1).alias("slot"), F.when(F.col("_s.j") == shards, F.lit(shards)).otherwise(F.col("_shard")).cast("int").alias("grown_shard")
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The digest of op1: doc_id, size, text_crc32, law 'key', shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8; a null text has none, and the
    checksum 0 of no bytes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(slim, shards, keep=("size", "text_crc32")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
