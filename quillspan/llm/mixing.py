"""Operator 9, mixing sources to target weights: native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Ranges of the hash key, by its first four hexadecimal digits.
KEY_DIGITS = 4


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """(skey, source_size, target) of sources (skey, source_size); sorted by skey, they weigh 1, 2, 3, repeating.

    All sizes together are shared out by weight; a target stops at cap times
    its source's size, and the excess is reshared by weight until none is
    above. That ends at one level L with target = min(cap * size, L * weight),
    which is found here in one pass over sources sorted by size / weight.
    This frame has a row for each source, not for each document.
    """
    weighed = sizes.withColumn("weight", (F.row_number().over(Window.orderBy("skey")) - 1) % 3 + 1)
    up = Window.orderBy(F.col("source_size") / F.col("weight"), "skey")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    told = (
        weighed.withColumn("lower_caps", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
        .withColumn("lower_weights", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("level", (F.col("total") - F.col("lower_caps")).cast("double") / (F.col("weights") - F.col("lower_weights")).cast("double"))
    )
    # the first source, in this order, that stays under its cap at the level of all sources from it on sets the level
    set_by = told.withColumn("_level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("source_size") * cap, F.struct(F.col("source_size") / F.col("weight"), "skey", "level"))).over(every)["level"])
    return set_by.select("skey", "source_size", F.coalesce(F.least((F.col("source_size") * cap).cast("double"), F.col("_level") * F.col("weight")), F.lit(0.0)).alias("target"))


def plan(docs: DataFrame, cap: int = 3, seed: str = "mix") -> DataFrame:
    """Every row, as struct `row`, with size, source_size, target, copies and part.

    copies are whole ones; part are the words taken from one copy more.
    Within a source, rows are ordered by a hash of doc_id and seed; whole
    epochs repeat all rows, and the last epoch is cut at the source's exact
    budget, inside the row where it falls. Prefix sums are distributed: sizes
    are summed by source and key range (the first hexadecimal digits of the
    key, so ranges are ordered), then along the ranges, which gives the one
    range of each source in which the cut falls. Rows of other ranges are
    whole in or out by their range alone, so no text of theirs is sorted; rows
    of the cut's range, a 65536th part of a source, are summed in order.
    Null sources are a source, the last; null texts and texts without words
    have size 0 and nothing is taken; rows of equal doc_id are ordered by
    size. Columns may have any names. An empty table gives no rows.
    """
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"),
        words().alias("size"),
        F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("skey"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|" + seed)).cast("binary")).alias("key"),
        F.col("doc_id").alias("id"),
    ).withColumn("rng", F.substring("key", 1, KEY_DIGITS))
    ranges = keyed.groupBy("skey", "rng").agg(F.sum("size").alias("n"))
    goals = targets(ranges.groupBy("skey").agg(F.sum("n").alias("source_size")), cap)
    budget = F.round(F.col("target")).cast("long")
    copies = F.when(F.col("source_size") > 0, F.expr(f"least(cast(round(target) as bigint) div source_size, {cap})")).otherwise(F.lit(0)).cast("int")
    goals = goals.withColumn("copies", copies).withColumn("left", F.when(F.col("copies") < cap, budget - F.col("copies") * F.col("source_size")).otherwise(F.lit(0)))
    # the range in which the words left run out, and how many of them are left at its start
    along = Window.partitionBy("skey").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("skey", "rng", "n", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start"))
    cuts = starts.join(goals.select("skey", "left"), "skey").where("start + n > left").groupBy(F.col("skey").alias("_c")).agg(F.min(F.struct("rng", (F.col("left") - F.col("start")).alias("here"))).alias("cut"))
    sources = goals.join(cuts, F.col("skey") == F.col("_c"), "left").select(F.col("skey").alias("_s"), "source_size", "target", "copies", F.col("cut.rng").alias("cut"), F.col("cut.here").alias("here"))
    # written first, so that its size is known: under Spark's threshold it is broadcast and no text moves, else the join is Spark's choice
    met = keyed.join(stored(sources), F.col("skey") == F.col("_s"))
    known = ["row", "size", "source_size", "target", "copies"]
    whole = F.coalesce(F.col("rng") != F.col("cut"), F.lit(True))
    out = met.where(whole).select(*known, F.when(F.col("cut").isNull() | (F.col("rng") < F.col("cut")), F.when(F.col("copies") < cap, F.col("size")).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("long").alias("part"))
    within = Window.partitionBy("skey").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("here") - F.coalesce(F.sum("size").over(within), F.lit(0))
    return out.unionByName(met.where(~whole).select(*known, F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("long").alias("part")))


def mix_digest(docs: DataFrame) -> DataFrame:
    """The digest of op9."""
    return plan(docs.select("doc_id", "source", "text")).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each copy taken.

    The copy in which a source's budget ends keeps the words that fit, with
    the white space before them; n_chars follows the text.
    """
    pieces = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    copies = F.col("copies") + F.when(F.col("part") > 0, F.lit(1)).otherwise(F.lit(0))
    out = plan(docs).where(copies > 0).withColumn("nth", F.explode(F.sequence(F.lit(1), copies)))
    last = (F.col("nth") > F.col("copies")) & (F.col("part") < F.col("size"))
    text = F.when(last, F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")).otherwise(F.col("row.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(last, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix') AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, encode(source) NULLS LAST) AS i FROM w),
l AS (SELECT a.*, (SELECT sum(source_size) FROM o) AS total,
             coalesce((SELECT sum(3 * b.source_size) FROM o b WHERE b.i < a.i), 0) AS caps,
             (SELECT sum(b.weight) FROM o b WHERE b.i >= a.i) AS weights FROM o a),
v AS (SELECT *, CAST(total - caps AS DOUBLE) / CAST(weights AS DOUBLE) AS level FROM l),
g AS (SELECT source, source_size,
             least(CAST(3 * source_size AS DOUBLE),
                   (SELECT arg_min(x.level, x.i) FROM v x WHERE x.level * x.weight <= 3 * x.source_size) * weight) AS target FROM v),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
             CASE WHEN g.source_size > 0 THEN least(CAST(round(g.target) AS BIGINT) // g.source_size, 3) ELSE 0 END AS copies
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(copies * size + CASE WHEN copies < 3 THEN
         greatest(0, least(size, CAST(round(target) AS BIGINT) - copies * source_size - ahead)) ELSE 0 END AS BIGINT) AS taken
FROM c
"""
