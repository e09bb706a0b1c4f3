"""Operator 13, Merkle dataset manifest: leaves, subtrees by group, a root, and a path for each row, level by level with windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, partitions, stored

#: Children of a node.
FAN = 3
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """The digest of a row's values: each is `-` if null, else its UTF-8 byte count, `:` and itself as text."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return digest(*told)


def fold(leaf: Column, path: Column) -> Column:
    """The root to which a leaf and the siblings along its path lead."""
    return F.aggregate(path, leaf, lambda x, s: digest(s["before"], x, s["after"]))


def siblings_digest(path: Column) -> Column:
    """The digest of all siblings along a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows, stored, with i, their place in the group from 0, and n, the group's size.

    Rows are dealt out in ranges of (group, *order), so a hot group is spread
    over many tasks; each range is numbered alone and a group's ranges are
    added up. Ranges are written once: what they hold must not change between
    two reads.
    """
    dealt = stored(rows.repartitionByRange(partitions(rows.sparkSession), group, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    of = Window.partitionBy("_g")
    before = of.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("_g", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(of).alias("n")))
    numbered = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    found = numbered.join(starts, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
    return stored(found.select(*rows.columns, (F.col("_start") + F.col("_r") - 1).alias("i"), "n"))


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, root) of each group, and (group, i, path) of its nodes, from nodes (group, i, n, h): n nodes h, numbered from 0.

    A level is one window over (group, parent): its whole frame, in order, is
    the parent's preimage and gives each child its siblings. Each parent is
    kept once, with its first child, before the next level. Frames hold FAN
    rows, however large a group is. Paths are handed down from the root, so
    the rows joined add up to half as many again as there are nodes.
    """
    steps, roots, level = [], [], nodes.select("group", "i", "n", "h")
    most = level.agg(F.max("n")).first()[0] or 0
    run = Window.partitionBy("group", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while most > 1:
        roots.append(level.where("n = 1").select("group", F.col("h").alias("root")))
        at = (F.col("i") % FAN).cast("int")
        kin = F.col("kin")
        level = level.where("n > 1").withColumn("p", F.floor(F.col("i") / FAN)).withColumn("kin", F.collect_list("h").over(run))
        step = level.select("group", "i", "p", "n", F.array_join(F.slice(kin, F.lit(1), at), "").alias("before"), F.array_join(F.slice(kin, at + 2, F.lit(FAN)), "").alias("after"), F.when(at == 0, F.sha2(F.array_join(kin, ""), 256)).alias("h"))
        steps.append(stored(step))
        level = steps[-1].where("h is not null").select("group", F.col("p").alias("i"), F.ceil(F.col("n") / FAN).alias("n"), "h")
        most = -(-most // FAN)
    roots.append(level.select("group", F.col("h").alias("root")))
    all_roots = roots[0]
    for r in roots[1:]:
        all_roots = all_roots.unionByName(r)
    paths = None
    for step in reversed(steps):
        own = F.array(F.struct("before", "after")).cast(_PATH)
        if paths is None:
            paths = step.select("group", "i", own.alias("path"))
        else:
            above = paths.select(F.col("group").alias("_g"), F.col("i").alias("_i"), F.col("path").alias("_above"))
            joined = step.join(above, (F.col("group") == F.col("_g")) & (F.col("p") == F.col("_i")), "left")
            paths = joined.select("group", "i", F.concat(own, F.coalesce("_above", F.array().cast(_PATH))).alias("path"))
    if paths is None:
        paths = nodes.where("false").select("group", "i", F.array().cast(_PATH).alias("path"))
    return all_roots, paths


def manifest(rows: DataFrame) -> DataFrame:
    """rows (group, key, leaf, ...) with subroot, root and path: array of (before, after) from the leaf's own level to the root.

    In a group leaves ascend by key (null first) and then by leaf; groups
    ascend bytewise by name, null first. FAN consecutive nodes have one parent,
    the digest of their digests; the last of a level may have fewer children,
    even one. A lone leaf is its group's subroot, a lone subroot the root. The
    same row twice is two leaves. An empty table gives no rows. Only digests
    travel, so the length of texts doesn't matter after the first pass.
    """
    named = rows.withColumn("group", F.coalesce(F.concat(F.lit("1"), F.col("group")), F.lit("0")))
    leaves = placed(stored(named), "group", "key", "leaf")
    subroots, paths = tree(leaves.select("group", "i", "n", F.col("leaf").alias("h")))
    groups = placed(stored(subroots.select(F.lit(0).alias("all"), F.col("group").alias("name"), F.col("root").alias("h"))), "all", "name")
    top, above = tree(groups.select(F.col("all").alias("group"), "i", "n", "h"))
    root = top.first()
    heads = groups.join(above.select(F.col("i").alias("_i"), F.col("path").alias("_up")), F.col("i") == F.col("_i"), "left").select(F.col("name").alias("_name"), F.col("h").alias("subroot"), F.coalesce("_up", F.array().cast(_PATH)).alias("_up"))
    met = leaves.join(paths.select(F.col("group").alias("_g"), F.col("i").alias("_i"), "path"), (F.col("group") == F.col("_g")) & (F.col("i") == F.col("_i")), "left").join(stored(heads), F.col("group") == F.col("_name"))
    others = [c for c in rows.columns if c != "group"]
    return met.select(F.when(F.col("group") != "0", F.substring("group", 2, 1 << 30)).alias("group"), *others, "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"), F.concat(F.coalesce("path", F.array().cast(_PATH)), "_up").alias("path"))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The digest of op13: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows whose doc_id has an even crc32 are tampered with: their text loses
    its line feeds, and the root is folded anew from the leaf that gives. A
    null doc_id is a key like others, first in its source, and counts as empty
    text for the crc32. Null, empty and very long texts are leaves like others:
    a text is hashed where it is read and doesn't move.
    """
    columns = [F.col(c) for c in FIELDS]
    tampered = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    leaves = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("key"), leaf_digest(*columns).alias("leaf"), F.when(crc_fold("doc_id", 2) == 0, leaf_digest(*tampered)).alias("changed"))
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    out = manifest(leaves).select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(name: str, nodes: str, levels: int) -> str:
    """CTEs name_0 ... of a tree's levels, from nodes (g, i, n, h); the last one has only roots."""
    out = [f"{name}_0 AS (SELECT g, i, n, h FROM {nodes})"]
    for k in range(levels):
        out.append(f"""{name}_{k + 1} AS (SELECT g, CASE WHEN n > 1 THEN i // {FAN} ELSE i END AS i, (n + {FAN - 1}) // {FAN} AS n,
  CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY {name}_{k}.i)) ELSE min(h) END AS h FROM {name}_{k} GROUP BY g, n, CASE WHEN n > 1 THEN {name}_{k}.i // {FAN} ELSE {name}_{k}.i END)""")
    return ",\n".join(out)


def _manifest_sql(levels: int = 24) -> str:
    """Levels are written out one by one: enough for 3^24 leaves of a source."""
    told = lambda v: f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(told(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    # crc32, a byte or a shift at a time (-1: a shift)
    crc = "xor(list_reduce(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END, 4294967295::BIGINT), 4294967295)"

    def fold_sql(tree: str, first: str, rows: str, out: str) -> str:
        """CTEs that take each of `rows` (r, g, i, h, x, s) up a tree: x folded, s its siblings so far."""
        parts = [f"{out}_0 AS (SELECT r, g, i, x, s FROM {rows})"]
        for k in range(levels):
            parts.append(f"""{out}_{k + 1} AS (SELECT f.r, f.g, CASE WHEN min(t.n) > 1 THEN f.i // {FAN} ELSE f.i END AS i,
  CASE WHEN min(t.n) > 1 THEN sha256(string_agg(CASE WHEN t.i = f.i THEN f.x ELSE t.h END, '' ORDER BY t.i)) ELSE f.x END AS x,
  f.s || CASE WHEN min(t.n) > 1 THEN coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i <> f.i), '') ELSE '' END AS s
  FROM {out}_{k} f JOIN {tree}_{k} t ON t.g = f.g AND t.i // {FAN} = f.i // {FAN} GROUP BY f.r, f.g, f.i, f.x, f.s)""")
        return ",\n".join(parts)

    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('1' || source, '0') AS g, {leaf("text")} AS leaf,
  CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS changed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
leaves AS (SELECT g, i, n, leaf AS h FROM p),
{_levels_sql("t", "leaves", levels)},
subs AS (SELECT 0 AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n, h, g AS name FROM t_{levels}),
{_levels_sql("u", "subs", levels)},
rows1 AS (SELECT r, g, i, coalesce(changed, leaf) AS x, '' AS s FROM p),
{fold_sql("t", "leaves", "rows1", "f")},
rows2 AS (SELECT f.r, 0 AS g, subs.i, f.x, f.s FROM f_{levels} f JOIN subs ON subs.name = f.g),
{fold_sql("u", "subs", "rows2", "v")}
SELECT p.doc_id, p.leaf, subs.h AS subroot, u.h AS root, sha256(v.s) AS proof_sha256, v.x AS folded_root, v.x = u.h AS verified
FROM p JOIN v_{levels} v ON v.r = p.r JOIN subs ON subs.name = p.g JOIN u_{levels} u ON true"""


MANIFEST_SQL = _manifest_sql()
