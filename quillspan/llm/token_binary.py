"""Operator 4, token-id output: files of context-mixed, range-coded ids, in ascending doc_id order."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import idcoder
from .bpe import Texts, byte_letters
from .common import partitions, range_bounds, stored

#: A file closes with the document that brings it to so many ids.
FILE_IDS = 1 << 19
#: Buckets of the order by doc_id, for each shuffle partition, and in all at the most.
BUCKETS_EACH, BUCKETS_MOST = 16, 1 << 16
#: Encodings of pieces, and of pre-tokens, that a worker keeps, at the most; then it starts anew.
CACHE = 600_000
_HEAD = struct.Struct("<4sHHIQIII")
_BLOCK = struct.Struct("<III")
MAGIC, VERSION = b"QTID", 2


class Library:
    """Ids by the tokenizers library; what it says of pre-tokens is kept, as no merge crosses their borders."""

    def __init__(self, tokenizer_json: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer_json)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.space = self.letters[ord(" ")]
        self.texts = Texts(self.pretoken, self.special, self.with_special, cache)

    def pretoken(self, p: str) -> list[int]:
        # of printable ASCII only the space has another letter
        letters = p.replace(" ", self.space) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(letters)]

    def with_special(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.texts.many(texts)


@lru_cache(maxsize=1)
def library_of(tokenizer_json: str, cache: int) -> Library:
    """A worker process goes from task to task with the pieces it knows."""
    return Library(tokenizer_json, cache)


def write_files(files: list[tuple[list[int | None], list[np.ndarray]]]) -> list[bytes]:
    """Files of (doc_ids, ids of each document), whose blocks are coded side by side.

    Header: magic, version, flags, documents, ids, distinct ids, blocks, bytes
    of the tables; the tables, compressed by zlib: doc_ids (8 bytes each),
    which of them are null (1 byte), lengths (4 bytes), the distinct ids in
    ascending order as differences (4 bytes), how frequent each is (1 byte);
    the crc32 of all these. Then for each block its ids, its bytes, the crc32
    of its ids, and its code. A block codes places in the list of distinct ids.
    """
    heads, blocks, orders, owner = [], [], [], []
    for docs, ids in files:
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        n = np.bincount(flat)
        values = np.flatnonzero(n).astype(np.uint32)
        rank = np.zeros(len(n), np.uint16 if len(values) <= 1 << 16 else np.uint32)
        rank[values] = np.arange(len(values))
        ranks, levels = rank[flat], idcoder.Frequencies.levels(n[values])
        own = [(flat[p : p + idcoder.BLOCK], ranks[p : p + idcoder.BLOCK]) for p in range(0, len(flat), idcoder.BLOCK)]
        blocks += own
        owner += [len(orders)] * len(own)
        orders.append(idcoder.Frequencies(levels, len(flat)))
        tables = (np.array([d or 0 for d in docs], "<i8").tobytes(), bytes(d is None for d in docs), np.array([len(x) for x in ids], "<u4").tobytes(), np.diff(values, prepend=np.uint32(0)).astype("<u4").tobytes(), levels.tobytes())
        packed = zlib.compress(b"".join(tables))
        head = _HEAD.pack(MAGIC, VERSION, 0, len(docs), len(flat), len(values), len(own), len(packed)) + packed
        heads.append([head + struct.pack("<I", zlib.crc32(head))])
    for p, q in idcoder.groups(len(blocks)):
        part = blocks[p:q]
        for k, code in enumerate(idcoder.encode([r for _, r in part], orders, owner[p:q])):
            heads[owner[p + k]].append(_BLOCK.pack(len(part[k][0]), len(code), zlib.crc32(part[k][0].astype("<u4").tobytes())) + code)
    return [b"".join(h) for h in heads]


def read_files(files: list[bytes]) -> list[tuple[list[int | None], list[np.ndarray]]]:
    """What write_files() was given; every checksum is checked."""
    parsed, orders, owner, codes, sizes, sums = [], [], [], [], [], []
    for data in files:
        magic, version, _, docs, n, distinct, many, packed = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of ids")
        at = _HEAD.size + packed
        if zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
            raise ValueError("a damaged header")
        tables = zlib.decompress(data[_HEAD.size : at])
        ids = np.frombuffer(tables, "<i8", docs).tolist()
        null = tables[8 * docs : 9 * docs]
        lengths = np.frombuffer(tables, "<u4", docs, 9 * docs)
        values = np.cumsum(np.frombuffer(tables, "<u4", distinct, 13 * docs), dtype=np.uint32)
        orders.append(idcoder.Frequencies(np.frombuffer(tables, np.uint8, distinct, 13 * docs + 4 * distinct), n))
        at += 4
        parsed.append(([None if z else d for d, z in zip(ids, null)], lengths, values, len(codes), many))
        owner += [len(orders) - 1] * many
        for _ in range(many):
            size, width, crc = _BLOCK.unpack_from(data, at)
            at += _BLOCK.size
            codes.append(data[at : at + width])
            sizes.append(size)
            sums.append(crc)
            at += width
    ranks: list[np.ndarray] = []
    for p, q in idcoder.groups(len(codes)):
        ranks += idcoder.decode(codes[p:q], sizes[p:q], orders, owner[p:q])
    out = []
    for ids, lengths, values, first, many in parsed:
        if any(len(r) and r.max() >= len(values) for r in ranks[first : first + many]):
            raise ValueError("a damaged block")
        blocks = [values[r] for r in ranks[first : first + many]]
        for k, b in enumerate(blocks):
            if zlib.crc32(b.astype("<u4").tobytes()) != sums[first + k]:
                raise ValueError("a damaged block")
        flat = np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)
        out.append((ids, np.split(flat, np.cumsum(lengths.astype(np.int64))[:-1]) if len(ids) else []))
    return out


def _tokenized(shared, end_id: int, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, bounds = shared.value
        library, end = library_of(tokenizer, cache), np.array([end_id], np.uint32)
        for batch in batches:
            for p in range(0, batch.num_rows, 512):
                part = batch.slice(p, 512)
                keys = part.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
                # ids below 65536 move as two bytes each; a file of larger ids as four
                ids = [np.concatenate([x, end]) for x in library.many(part.column("text").to_pylist())]
                small = [x.astype("<u2") if x.max() < 1 << 16 else x for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.searchsorted(bounds, keys, "right").astype(np.int64)), pa.array([x.dtype.itemsize for x in small], pa.int32()), pa.array([x.tobytes() for x in small], pa.binary())], ["doc_id", "bucket", "width", "ids"])

    return run


def _written(file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[int, int, tuple]] = []
        bucket, part, docs, ids, held, waiting = None, 0, [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (b, p, f), data in zip(ready, write_files([f for _, _, f in ready])):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([p], pa.int64()), pa.array([sum(map(len, f[1]))], pa.int64()), pa.array([data], pa.binary())], ["bucket", "part", "n_ids", "file"])
            ready.clear()

        for batch in batches:
            for doc_id, b, width, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "bucket", "width", "ids"))):
                if docs and (b != bucket or held >= file_ids):
                    ready.append((bucket, part, (docs, ids)))
                    waiting += held
                    part, docs, ids, held = part + 1, [], [], 0
                    if waiting >= idcoder.BLOCK * idcoder.LANES:
                        yield from flush()
                        waiting = 0
                if b != bucket:
                    bucket, part = b, 0
                docs.append(doc_id)
                ids.append(np.frombuffer(raw, f"<u{width}").astype(np.uint32))
                held += len(ids[-1])
        if docs:
            ready.append((bucket, part, (docs, ids)))
        yield from flush()

    return run


def write_ids(docs: DataFrame, tokenizer_json: str, end_id: int = 2, file_ids: int = FILE_IDS, cache: int = CACHE) -> DataFrame:
    """Rows (bucket, part, n_ids, file), whose order by bucket and part is that of doc_id; see write_files for the format.

    The files are values of a table, so that Spark's committer places them on
    any store and a lost task leaves none behind. Texts are encoded where they
    are read; ids, not texts, move to their bucket of the order (cut points
    from a bounded sample of doc_ids), once. Null texts count as empty and
    leave the end id alone; a null doc_id comes before all others; rows of one
    doc_id are ordered by a hash of their ids. A document isn't cut: a file is
    as large as file_ids and one document more.
    """
    spark = docs.sparkSession
    bounds = range_bounds(docs, "doc_id", min(BUCKETS_MOST, BUCKETS_EACH * partitions(spark)))
    shared = spark.sparkContext.broadcast((tokenizer_json, bounds))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenized(shared, end_id, cache), "doc_id long, bucket long, width int, ids binary")
    return rows.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")).mapInArrow(_written(file_ids), "bucket long, part long, n_ids long, file binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        for (b, p, _, _), (docs, ids) in zip(held, read_files([x[3] for x in held])):
            n = np.array([len(x) for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b] * len(docs), pa.int64()), pa.array([p] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], ["bucket", "part", "doc_id", "inside", "n_tokens", "ids_crc32"]
            )
        held.clear()

    waiting = 0
    for batch in batches:
        for i in range(batch.num_rows):
            held.append(tuple(batch.column(c)[i].as_py() for c in ("bucket", "part", "n_ids", "file")))
            waiting += held[-1][2]
            if waiting >= idcoder.BLOCK * idcoder.LANES:
                yield from flush()
                waiting = 0
    yield from flush()


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from files: where each document's ids start among all, how many, and their checksum.

    Starts are prefix sums in two steps: over a bucket's files, then over
    buckets (BUCKETS_MOST rows at the most).
    """
    totals = files.select("bucket", "part", "n_ids")
    inside = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = totals.groupBy("bucket").agg(F.sum("n_ids").alias("n")).select(F.col("bucket").alias("_b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    starts = totals.withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(buckets, F.col("bucket") == F.col("_b0")).select(F.col("bucket").alias("_b"), F.col("part").alias("_p"), (F.col("_inside") + F.col("_before")).alias("_start"))
    docs = files.mapInArrow(_read, "bucket long, part long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(starts, (F.col("bucket") == F.col("_b")) & (F.col("part") == F.col("_p"))).select("doc_id", (F.col("_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def ids_digest(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """The digest of op4: writes the files to the shared folder and reads them back."""
    return read_ids(stored(write_ids(docs, tokenizer_json)))
