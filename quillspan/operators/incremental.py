"""Incremental scans: only files whose content is new are parsed; the other facts are taken over from the store before."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillspan.operators import deltas
from quillspan.operators import facts as fs

_FILE = ["project", "file"]
#: What a place that names a function is counted by, and what tells such places apart.
CALLED, CALLER = ["project", "symbol"], ["kind", "file", "line", "owner"]


def file_digests(files: DataFrame) -> DataFrame:
    """(project, file, sha1) of scripts and pages; a digest of what was read, never a time."""
    return files.where("kind in ('gs', 'html') and content is not null").select(*_FILE, F.sha1(F.encode("content", "UTF-8")).alias("sha1"))


def changed_files(store: DataFrame, files: DataFrame) -> DataFrame:
    """(project, file, change): added, removed or changed files, by one full outer join of digests."""
    before = fs.view(store, "file").select(F.col("project").alias("_p"), F.col("file").alias("_f"), F.col("sha1").alias("_s"))
    both = file_digests(files).join(before, (F.col("project") == F.col("_p")) & (F.col("file") == F.col("_f")), "full_outer")
    change = F.when(F.col("_p").isNull(), "added").when(F.col("project").isNull(), "removed").when(F.col("sha1") != F.col("_s"), "changed")
    return both.select(F.coalesce("project", "_p").alias("project"), F.coalesce("file", "_f").alias("file"), change.alias("change")).where("change is not null")


def scan_incremental(store: DataFrame, files: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """The store of `files`: equal to facts(files), but only added and changed files are parsed.

    store: the facts of an earlier scan, written. Facts of files that are as
    they were are taken over by an anti join with the changes, which are few,
    so Spark broadcasts them and the store isn't shuffled. What the facts
    mean together (calls, exposures, gaps) is joined anew from them, so no
    edge to a file that went is left. Parsing the same files again gives the
    same store: an update can be repeated. only: as in facts(), if the store
    before was made so.
    """
    changes = changed_files(store, files)
    kept = store.join(changes.select(*_FILE), _FILE, "left_anti").select(*store.columns)
    fresh = files.join(changes.where("change <> 'removed'").select(*_FILE), _FILE, "left_semi")
    return kept.unionByName(fs.facts(fresh, only))


def scan_measured(store: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the written store of scan_incremental(), one row: files parsed, taken over and removed, functions).

    The numbers are observed in the job that writes the store, not counted afterwards.
    """
    changes = changed_files(store, files)
    kept = store.join(changes.select(*_FILE), _FILE, "left_anti").select(*store.columns)
    fresh = fs.facts(files.join(changes.where("change <> 'removed'").select(*_FILE), _FILE, "left_semi"))
    old, new = Observation(), Observation()
    file, function = F.col("fact") == "file", F.col("fact") == "function"
    kept = kept.observe(old, F.count_if(file).alias("files"), F.count_if(function).alias("functions"))
    fresh = fresh.observe(new, F.count_if(file).alias("files"), F.count_if(function).alias("functions"))
    after = fs.written(kept.unionByName(fresh))
    told, was = new.get, old.get
    removed = changes.where("change = 'removed'").count()
    row = (told["files"], was["files"], removed, told["functions"] + was["functions"])
    return after, store.sparkSession.createDataFrame([row], "parsed long, taken_over long, removed long, functions long")


def call_edges(store: DataFrame) -> DataFrame:
    """(project, symbol, kind, file, line, owner, n): places that name a function, known or not."""
    return deltas.edge_counts(fs.consumers(store), CALLED, CALLER)


def maintained_calls(store: DataFrame, files: DataFrame, edges: DataFrame, counts: DataFrame) -> DataFrame:
    """(project, symbol, members, links) of the files as they are now, from edges and counts of the store before.

    Calls of a file that went or changed count -1, those of its new text +1.
    Only changed files are read and parsed, and only names that they lost or
    got are counted anew.
    """
    changes = changed_files(store, files)
    gone = fs.consumers(store.join(changes.where("change <> 'added'").select(*_FILE), _FILE, "left_semi"))
    come = fs.consumers(fs.written(fs.facts(files.join(changes.where("change <> 'removed'").select(*_FILE), _FILE, "left_semi"))))
    delta = fs.stored(deltas.signed(gone, come, CALLED + CALLER))
    return deltas.maintained_members(counts, edges, delta, CALLED, CALLER)
