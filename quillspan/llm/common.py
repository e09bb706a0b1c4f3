"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spaces between words: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Narrow rows of a written file: a few MB.
FILE_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only if that is unset in local mode (tests, one machine)."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
        return found
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspan-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends, columns can be pruned, sizes are known.

    With an estimate of its narrow rows, partitions are put together without a shuffle into
    files of about FILE_ROWS, where Spark's own coalescing hasn't done so: many tiny files
    cost more than the work on them. Fewer partitions than that stay as they are.
    """
    at = f"{shared_dir(df.sparkSession)}/quillspan-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(rows // FILE_ROWS + 1)).write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo mod; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many leading underscores more as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    return [next(x for k in range(len(taken) + 1) if (x := "_" * k + n).lower() not in taken) for n in names]


def bounded_sample(df: DataFrame, key: str, rows: int, most: int) -> DataFrame:
    """About `most` of `rows` rows at the most, chosen by a hash of a key that doesn't repeat: the same rows on each run."""
    if rows <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * most / rows))


def utf32(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def groups_of_texts(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose lengths add up to about `most` characters; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def range_bounds(df: DataFrame, key: str, buckets: int) -> np.ndarray:
    """Cut points that deal integer keys out to about `buckets` ranges of about equal row counts.

    They come from a sample of about 64 rows for each bucket at the most, so
    what the driver gets is bounded by `buckets`, however often a key repeats;
    only the key column is read.
    """
    keys = df.select(F.col(key).cast("long").alias("k")).where(F.col("k").isNotNull())
    rows = keys.count()
    got = (keys if rows <= 64 * buckets else keys.sample(64 * buckets / rows, seed=5)).toPandas()["k"].to_numpy(np.int64)
    if not len(got) or buckets < 2:
        return np.zeros(0, np.int64)
    got.sort()
    return np.unique(got[np.linspace(0, len(got) - 1, buckets + 1).astype(np.int64)[1:-1]])
