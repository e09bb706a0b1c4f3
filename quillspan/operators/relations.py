"""Operators of the fact store, as plans over DataFrames. None collects rows to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import normalised
from quillspan.operators.similarity import similar_names  # noqa: F401  (callers know it by this module too)
from quillspan.sources.shared import stored


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that are first by key, and the collisions that come later."""
    n = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return n.where("_n = 1").drop("_n"), n.where("_n > 1").drop("_n")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, state: str) -> DataFrame:
    """(key, change) of keys that were added, removed or changed state; one full outer join on the key."""
    a, b = before.select(F.col(key).alias("_a"), F.col(state).alias("_x")), after.select(F.col(key).alias("_b"), F.col(state).alias("_y"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_x").eqNullSafe(F.col("_y")), "changed")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), change.alias("change")).where("change is not null")


def ranked(df: DataFrame, key: str, order: str, to: str) -> DataFrame:
    """df with the row's place among those of its key, by order, from 1.

    Rows are dealt out in ranges of (key, order), so a hot key is spread over
    many tasks; each range is ranked alone, and a key's ranges are added up.
    The ranges are written once: what they hold must not change between reads.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, key, order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_key", "_p", F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")).where("_before > 0")
    inside = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_part").orderBy(order)))
    out = inside.join(before, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_p")), "left")
    return out.withColumn(to, F.col("_i") + F.coalesce("_before", F.lit(0))).drop("_part", "_i", "_key", "_p", "_before")


def pair_one_to_one(removed: DataFrame, added: DataFrame, fingerprint: str, order: str) -> DataFrame:
    """(fingerprint, old, new): the nth removed row of a fingerprint with its nth added row: what greedy pairing in order finds.

    Both sides are written once, narrow, and numbered together, so what makes
    a fingerprint (a regex and a digest of whole texts) runs once for each row;
    rows of one fingerprint and number then meet in one aggregate. A
    fingerprint that only one side has is never numbered.
    """
    side = lambda df, new: df.select(F.col(fingerprint).alias("_f"), F.lit(new).alias("_new"), F.col(order).alias("_o"))
    rows = stored(side(removed, False).unionByName(side(added, True)))
    both = rows.groupBy(F.col("_f").alias("_b")).agg(F.count_if("_new").alias("_y"), F.count_if(~F.col("_new")).alias("_x")).where("_x > 0 and _y > 0")
    met = rows.join(both.select("_b"), F.col("_f") == F.col("_b"), "left_semi").withColumn("_k", F.struct("_f", "_new"))
    placed = ranked(met.select("_k", "_o"), "_k", "_o", "_n")
    pairs = placed.groupBy(F.col("_k._f").alias(fingerprint), "_n").agg(F.max(F.when(~F.col("_k._new"), F.col("_o"))).alias("old"), F.max(F.when(F.col("_k._new"), F.col("_o"))).alias("new"))
    return pairs.where("old is not null and new is not null").select(fingerprint, "old", "new")


def key_state(reads: Column, writes: Column) -> Column:
    """write_only, read_only or ok, from the numbers of reads and writes."""
    r, w = reads > 0, writes > 0
    return F.when(w & ~r, "write_only").when(r & ~w, "read_only").otherwise("ok")


def key_status(uses: DataFrame, keys: list[str], kind: str, read: str, write: str, delete: str) -> DataFrame:
    """Counts of reads, writes and deletes by key, and write_only, read_only or ok (a key only deleted is ok). Null keys don't count."""
    n = lambda k: F.count_if(F.col(kind) == k)
    known = uses.where(F.col(kind).isin(read, write, delete))
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    told = known.groupBy(*keys).agg(n(read).alias("reads"), n(write).alias("writes"), n(delete).alias("deletes"))
    return told.withColumn("status", key_state(F.col("reads"), F.col("writes")))


def coverage(uncertain: Column) -> Column:
    """100 less 5 for each uncertain place, 40 at the most."""
    return F.greatest(F.lit(50), 100 - F.least(F.lit(40), uncertain * 5)).cast("long")


def confidence(pct: Column, high: int = 95, medium: int = 80) -> Column:
    return F.when(pct >= high, "high").when(pct >= medium, "medium").otherwise("low")


def anti(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_anti")


def fallback_join(facts: DataFrame, providers: list[tuple[DataFrame, str, str, str]], out: str) -> DataFrame:
    """Left joins to providers (frame, own key, facts' key, value) in order; the first value found wins."""
    values = []
    for i, (p, own, key, value) in enumerate(providers):
        facts = facts.join(p.select(F.col(own).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), F.col(key) == F.col(f"_k{i}"), "left")
        values.append(f"_v{i}")
    return facts.withColumn(out, F.coalesce(*values)).drop(*values, *[f"_k{i}" for i in range(len(providers))])


def log_metrics(log: DataFrame, since: Column | None = None) -> DataFrame:
    """Runs, errors (FAILED or TIMED_OUT), last start and error rate in thousandths by function."""
    log = log if since is None else log.where(F.col("started") >= since)
    told = log.groupBy("function").agg(F.count("*").alias("runs"), F.count_if(F.col("status").isin("FAILED", "TIMED_OUT")).alias("errors"), F.max("started").alias("last_run"))
    return told.withColumn("rate_1000", F.floor(F.col("errors") * 1000 / F.col("runs")).cast("long"))


def upsert_counts(entries: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Entries with the same normalised text (lower case, marks dropped, only letters and digits of any script) count as one: occurrences, first and last time."""
    need = normalised(F.col(text))
    seq = F.struct(*order)
    return entries.groupBy(need.alias("need")).agg(F.count("*").alias("occurrences"), F.min(seq).alias("_a"), F.max(seq).alias("_b")).select("need", "occurrences", F.col("_a")[order[0]].alias("first_seen"), F.col("_b")[order[0]].alias("last_seen"))


def first_by_key(df: DataFrame, keys: list[str], order: list[str], most: int, rows: str, total: str) -> DataFrame:
    """(keys, rows, total): the first `most` rows of a key as an array of the other columns, in order, and how many it has in all.

    Of each key only `most` rows leave a task and only so many meet (Spark
    limits a rank's groups before they are shuffled), so a hot key isn't
    gathered; the total is a partial count. Order should tell all rows apart,
    or any of equal ones is taken.
    """
    others = [c for c in df.columns if c not in keys]
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most)
    told = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", *others))), lambda x: F.struct(*[x[c].alias(c) for c in others])).alias(rows))
    counts = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias(total))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return told.join(counts, on).select(*keys, rows, total)


def in_order(df: DataFrame, order: str, to: str, then: str | None = None, collation: str = "UNICODE") -> DataFrame:
    """df with each row's place, from 1, in the order of a text under a collation, and then of another column.

    Texts are compared as readers do, not by bytes. Rows are dealt out in
    ranges of that order and each range is numbered alone (ranked), so the
    place of every row is known without one task that holds them all. Nulls come first.
    """
    key = F.collate(F.col(order), collation) if collation else F.col(order)
    whole = df.select(F.struct(*df.columns).alias("_row"), F.lit(0).alias("_all"), F.struct(key.alias("a"), *([F.col(then).alias("b")] if then else [])).alias("_by"))
    return ranked(whole, "_all", "_by", "_place").select("_row.*", F.col("_place").alias(to))


def content_diff(local: DataFrame, remote: DataFrame, path: str, digest: str) -> DataFrame:
    """modified, only_local or only_remote by path; one full outer join."""
    changed = snapshot_diff(local, remote, path, digest)
    names = F.when(F.col("change") == "added", "only_remote").when(F.col("change") == "removed", "only_local").otherwise("modified")
    return changed.select(path, names.alias("status"))


def chain_fold(chain: DataFrame, steps: str, registry: Column) -> DataFrame:
    """Walks each chain's steps through a map 'type.step' -> type, from its `root` type; the first unknown step stops it.

    The state is folded in one projection: no join for each step.
    """
    walk = F.aggregate(
        F.col(steps),
        F.struct(F.col("root").alias("type"), F.lit(0).alias("done"), F.lit(False).alias("stopped")),
        lambda s, m: F.when(s["stopped"] | F.try_element_at(registry, F.concat(s["type"], F.lit("."), m)).isNull(), F.struct(s["type"].alias("type"), s["done"].alias("done"), F.lit(True).alias("stopped"))).otherwise(
            F.struct(F.try_element_at(registry, F.concat(s["type"], F.lit("."), m)).alias("type"), (s["done"] + 1).alias("done"), F.lit(False).alias("stopped"))
        ),
    )
    return chain.withColumn("_w", walk).select(*[c for c in chain.columns if c not in (steps, "root")], F.col("_w.type").alias("type"), F.col("_w.done").cast("long").alias("done"), F.col("_w.stopped").alias("stopped"))
