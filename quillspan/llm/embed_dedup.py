"""Operator 2, near-duplicate vectors: an epsilon grid order join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, partitions, stored
from .components import id_ties, least_ids
from .wordhash import mixed

#: The rotation is fitted to at most so many vectors; it only orders and prunes, results don't depend on it.
FIT_ROWS = 20_000
#: Vectors in a block of the grid order, and in a leaf of the recursion.
BLOCK, LEAF = 2048, 128
#: Blocks in a row that travel together, and leading directions by which such groups are told apart before they do.
GROUP, LEADING = 8, 8
#: Bits of the order: cells of the leading dimensions, place in the first cell, spread of equal places.
CELL_BITS, PLACE_BITS, SPREAD_BITS = 40, 10, 13


def usable_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, which rows hold a usable vector of it (no nulls, all finite, not zero), and those vectors as rows of doubles.

    Each vector is scaled by a power of two, so that its greatest component is
    from 0.5 to 1: no cosine changes, and no norm is too large or too small.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_list(pa.float64()))
    offsets, values = column.offsets.to_numpy(), column.values
    starts, sizes = offsets[:-1], np.diff(offsets)
    flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    there = column.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
    for d in np.unique(sizes[there]):
        rows = np.flatnonzero(there & (sizes == d))
        x = flat[starts[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1) & x.any(axis=1)
        rows, x = rows[good], x[good]
        if len(rows):
            yield rows, np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) + 0.0


def vector_keys(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """A digest and the length of each row's vector; null where it isn't usable."""
    keys: list[bytes | None] = [None] * len(column)
    dims: list[int | None] = [None] * len(column)
    for rows, x in usable_vectors(column):
        for i, v in zip(rows.tolist(), x):
            keys[i], dims[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest(), x.shape[1]
    return pa.array(keys, pa.binary()), pa.array(dims, pa.int32())


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), *vector_keys(batch.column("v"))], ["id", "key", "dim"])


class Grid:
    """Rotation onto principal directions of one dimension's vectors, and the order of grid cells of width eps."""

    def __init__(self, sample: np.ndarray, eps: float):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        _, axes = np.linalg.eigh(np.cov(unit.T).reshape(unit.shape[1], -1) if len(unit) > 1 else np.eye(unit.shape[1]))
        self.axes, self.eps = np.ascontiguousarray(axes[:, ::-1]), eps
        self.bits = max(1, int(np.ceil(np.log2(2 * np.ceil(1 / eps) + 1))))
        self.dims = max(1, min(sample.shape[1], CELL_BITS // self.bits))

    def place(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.axes

    def order(self, p: np.ndarray, ids: np.ndarray) -> np.ndarray:
        cells = np.floor(p[:, : self.dims] / self.eps)
        part = p[:, 0] / self.eps - cells[:, 0]
        cells = np.clip(cells + np.ceil(1 / self.eps), 0, (1 << self.bits) - 1).astype(np.int64)
        key = np.zeros(len(p), np.int64)
        for k in range(self.dims):
            key = key << self.bits | cells[:, k]
        key = key << PLACE_BITS | np.clip(part * (1 << PLACE_BITS), 0, (1 << PLACE_BITS) - 1).astype(np.int64)
        return key << SPREAD_BITS | (mixed(ids.view(np.uint64)) >> np.uint64(64 - SPREAD_BITS)).view(np.int64)


def _placed(grids, bounds):
    """bounds None: the order of each row; else its block, for the blocks' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "n"))
            for rows, x in usable_vectors(batch.column("v")):
                d, ids, n = x.shape[1], reps[rows], copies[rows]
                order = grids.value[d].order(grids.value[d].place(x), ids.astype(np.int64))
                dim = pa.array(np.full(len(rows), d, np.int32))
                if bounds is None:
                    yield pa.RecordBatch.from_arrays([dim, pa.array(order)], ["dim", "ord"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [dim, pa.array(np.searchsorted(bounds.value[d], order, "right").astype(np.int64)), pa.array(order), pa.array(ids), pa.array(n), pa.array([v.tobytes() for v in x], pa.binary())], ["dim", "block", "ord", "rep", "n", "v"]
                    )

    return run


def _packed(grids):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        grid = grids.value[key[0].as_py()]
        table = table.sort_by("ord")
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(table.num_rows, -1)
        p = grid.place(x)
        lists = lambda a: pa.array([a.tolist()], pa.list_(pa.float64()))
        blob = lambda c: pa.array([table.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary())
        pad = np.zeros(max(0, LEADING - x.shape[1]))
        return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "lo": lists(np.append(p.min(0)[:LEADING], pad)), "hi": lists(np.append(p.max(0)[:LEADING], pad)), "reps": blob("rep"), "ns": blob("n"), "vs": pa.array([x.tobytes()], pa.binary())})

    return run


class _Side:
    """A block: its vectors, their norms, and the boxes of all intervals that the recursion meets."""

    def __init__(self, reps: bytes, ns: bytes, vs: bytes, grid: Grid):
        self.reps, self.ns = np.frombuffer(reps, np.int64), np.frombuffer(ns, np.int64)
        self.x = np.frombuffer(vs, np.float64).reshape(len(self.reps), -1)
        self.norm, self.p = np.linalg.norm(self.x, axis=1), grid.place(self.x)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            self.boxes[a, b] = self.p[a:b].min(0), self.p[a:b].max(0)
        return self.boxes[a, b]


def join_blocks(left: _Side, right: _Side, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Copies linked with each vector of left and of right, and a forest over the links.

    Recursive join of two sequence intervals: intervals whose boxes are more
    than eps apart are skipped; small ones are compared in double precision.
    """
    far = 2 - 2 * threshold + 1e-9
    found = np.zeros(len(left.reps), np.int64), np.zeros(len(right.reps), np.int64)
    ties: set[tuple[int, int]] = set()
    todo = [(0, len(left.reps), 0, len(right.reps))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a:
            continue
        (lo, hi), (lo2, hi2) = left.box(a, b), right.box(c, d)
        gap = np.maximum(0, np.maximum(lo2 - hi, lo - hi2))
        if gap @ gap > far:
            continue
        if b - a > LEAF or d - c > LEAF:
            if b - a >= d - c:
                m = (a + b) // 2
                todo += [(a, m, c, d), (m, b, c, d)]
            else:
                m = (c + d) // 2
                todo += [(a, b, c, m), (a, b, m, d)]
            continue
        near = left.x[a:b] @ right.x[c:d].T >= threshold * (left.norm[a:b, None] * right.norm[None, c:d])
        if same:
            near &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
        if not near.any():
            continue
        found[0][a:b] += near @ right.ns[c:d]
        found[1][c:d] += near.T @ left.ns[a:b]
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        near = near[np.ix_(rows, cols)]
        lab, none = left.reps[a:b][rows].copy(), np.iinfo(np.int64).max
        while True:
            lab2 = np.where(near, lab[:, None], none).min(0)
            new = np.minimum(lab, np.where(near, lab2[None, :], none).min(1))
            if (new == lab).all():
                break
            lab = new
        ties.update(zip(left.reps[a:b][rows].tolist(), lab.tolist()))
        ties.update(zip(right.reps[c:d][cols].tolist(), lab2.tolist()))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = parent[y]
            x = y
        return x

    forest = []
    for u, v in ties:
        if (x := root(u)) != (y := root(v)):
            parent[max(x, y)] = min(x, y)
            forest.append((u, v))
    return *found, forest


def _joined(grids, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sides = None, []

        def links() -> Iterator[pa.RecordBatch]:
            """Of all pairs of blocks of the task's two groups; of one group, of each pair once."""
            _, left, right = task
            for i, (group, block, a) in enumerate(sides):
                for group2, block2, b in sides[i:] if left == right else [x for x in sides if group == left and x[0] == right]:
                    x, y, forest = join_blocks(a, b, a is b, threshold)
                    if a is b:
                        x, y = x + y, x[:0]
                    ids, n = np.concatenate([a.reps, b.reps[: len(y)]]), np.concatenate([x, y])
                    ids, n = ids[n > 0], n[n > 0]
                    u, v = [e[0] for e in forest], [e[1] for e in forest]
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array([*ids.tolist(), *u], pa.int64()), pa.array([*[None] * len(ids), *v], pa.int64()), pa.array([*n.tolist(), *[None] * len(u)], pa.int64())], ["u", "v", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (r["dim"], r["left"], r["right"]) != task:
                    if task:
                        yield from links()
                    task, sides = (r["dim"], r["left"], r["right"]), []
                sides.append((r["group"], r["block"], _Side(r["reps"], r["ns"], r["vs"], grids.value[r["dim"]])))
        if task:
            yield from links()

    return run


def _near_groups(blocks: DataFrame, eps: float) -> DataFrame:
    """(dim, left, right): groups of blocks whose boxes are within eps in the leading directions, left <= right.

    Boxes meet in cells of the first two directions; of a pair that meets in
    several cells one row stays.
    """
    k = range(LEADING)
    boxes = blocks.groupBy("dim", "group").agg(F.array(*[F.min(F.col("lo")[i]) for i in k]).alias("lo"), F.array(*[F.max(F.col("hi")[i]) for i in k]).alias("hi"))
    cell = lambda c: F.floor(c / eps)
    spread = lambda df, more: df.withColumn("c1", F.explode(F.sequence(cell(F.col("lo")[0]) - more, cell(F.col("hi")[0]) + more))).withColumn("c2", F.explode(F.sequence(cell(F.col("lo")[1]) - more, cell(F.col("hi")[1]) + more)))
    here = spread(boxes, 0).withColumnRenamed("group", "left")
    there = spread(boxes, 1).select("dim", F.col("group").alias("right"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "c1", "c2")
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col("lo2")[i] - F.col("hi")[i], F.col("lo")[i] - F.col("hi2")[i]), 2) for i in k), F.lit(0.0))
    return here.join(there, ["dim", "c1", "c2"]).where("left <= right").where(gap <= eps * eps + 1e-9).select("dim", "left", "right").distinct()


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors linked at cosine >= threshold, in double precision.

    Equal vectors become one class with a count. Unit vectors are rotated onto
    the principal directions of a bounded sample, sorted by grid cells of
    width eps (cosine >= t is a distance <= sqrt(2 - 2t)) and cut into blocks.
    Groups of blocks in a row whose boxes are within eps, found by an
    equi-join of neighbouring cells of the first two directions, meet in one
    task, where blocks are joined by recursion over halves of the two
    sequences; what is provably far apart is skipped. A task returns counts
    and a forest, never all pairs, so dense groups stay linear in what moves.

    Vectors that are null, empty, zero or hold null, NaN or infinite
    components link with nothing; vectors of different lengths don't link.
    Rows of one id are one component, each with the links of its own vector: a
    node is a class of equal vectors, not an id. A null id links with nothing
    and has a null component. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    sc, eps = spark.sparkContext, float(np.sqrt(2 - 2 * threshold))
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    known = stored(slim.mapInArrow(_keyed, "id long, key binary, dim int"))
    usable = known.where("key is not null and id is not null")
    classes = stored(usable.groupBy("key", "dim").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    sizes = {r["dim"]: r["rows"] for r in classes.groupBy("dim").agg(F.count("*").alias("rows")).collect()}
    reps = stored(slim.mapInArrow(_with_key, f"id long, key binary, v {dict(slim.dtypes)['v']}").join(classes.withColumnRenamed("key", "_k"), (F.col("id") == F.col("rep")) & (F.col("key") == F.col("_k"))).select("node", "rep", "n", "dim", "v").dropDuplicates(["node"]))
    nodes = lambda df: df.select(F.col("node").alias("rep"), "n", "v")
    grids, bounds = {}, {}
    for d, rows in sizes.items():
        sample = bounded_sample(reps.where(F.col("dim") == d).select("node", "v"), "node", rows, FIT_ROWS).select("v").toArrow().column("v")
        found = [x for _, x in usable_vectors(sample)]
        grids[d] = Grid(found[0] if found else np.eye(d), eps)
    grids = sc.broadcast(grids)
    for d, rows in sizes.items():
        blocks = -(-rows // BLOCK)
        keys = nodes(bounded_sample(reps.where(F.col("dim") == d), "node", rows, 8 * blocks)).mapInArrow(_placed(grids, None), "dim int, ord long").select("ord").toPandas()["ord"].to_numpy(np.int64)
        keys.sort()
        bounds[d] = keys[np.linspace(0, len(keys), blocks + 1).astype(np.int64)[1:-1]] if len(keys) else keys
    bounds = sc.broadcast(bounds)
    placed = nodes(reps).mapInArrow(_placed(grids, bounds), "dim int, block long, ord long, rep long, n long, v binary")
    kinds = "dim int, block long, lo array<double>, hi array<double>, reps binary, ns binary, vs binary"
    blocks = stored(placed.groupBy("dim", "block").applyInArrow(_packed(grids), kinds).withColumn("group", F.floor(F.col("block") / GROUP).cast("long")))
    pairs = stored(_near_groups(blocks.select("dim", "group", "lo", "hi"), eps))
    # a block goes once to each pair of groups that its own is in
    asked = pairs.select("dim", F.explode(F.array_distinct(F.array("left", "right"))).alias("group"), "left", "right")
    both = blocks.select("dim", "group", "block", "reps", "ns", "vs").join(asked, ["dim", "group"]).select("dim", "left", "right", "group", "block", "reps", "ns", "vs")
    links = stored(both.repartition(partitions(spark), "dim", "left", "right").sortWithinPartitions("dim", "left", "right", "block").mapInArrow(_joined(grids, threshold), "u long, v long, n long"))
    found = links.where("n is not null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("others"))
    edges = links.where("v is not null").select("u", "v").unionByName(id_ties(usable, classes, "key"))
    linked = least_ids(classes, edges)
    told = stored(linked.join(found, F.col("node") == F.col("id"), "left").select(F.col("key").alias("_key"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "c"))
    out = known.join(told, F.col("key") == F.col("_key"), "left")
    alone = F.col("key").isNull() | F.col("id").isNull()
    out = out.select(F.col("id").alias(id_col), F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("c")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), vector_keys(batch.column("v"))[0], batch.column("v")], ["id", "key", "v"])
