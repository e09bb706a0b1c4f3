"""Operator 11, centroid clustering: exact integer k-means with Drake's adaptive bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Components are integers up to this size, so a squared distance of 64 of them fits a long.
LARGEST = 1 << 27
#: Bounds are doubles: what they certify is held apart by far more than their rounding.
_SLACK = 1e-9


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v to those of c; both hold integers up to LARGEST."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < 1 << 22:  # every sum stays under 2^53
        a, b = v.astype(np.float64), c.astype(np.float64)
        return np.rint((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(axis=1) for row in c], axis=1)


class Bounds:
    """Drake's state of some vectors: the centroid of each, an upper bound to it, lower bounds to the `kept` nearest others, and one to all the rest.

    ids[:, j] is the j-th nearest other centroid when it was last ordered,
    low[:, j] a lower bound of the distance to it, rest one for all centroids
    that are neither assigned nor among ids.
    """

    def __init__(self, own: np.ndarray, up: np.ndarray, ids: np.ndarray, low: np.ndarray, rest: np.ndarray):
        self.own, self.up, self.ids, self.low, self.rest = own, up, ids, low, rest

    @classmethod
    def scanned(cls, v: np.ndarray, c: np.ndarray, kept: int) -> Bounds:
        """Of a whole scan; ties go to the smaller number."""
        d = squares(v, c)
        order = np.argsort(d, axis=1, kind="stable")
        near = np.sqrt(np.take_along_axis(d, order[:, : kept + 2], axis=1).astype(np.float64))
        rest = near[:, kept + 1] if near.shape[1] > kept + 1 else np.full(len(v), np.inf)
        return cls(order[:, 0].astype(np.int32), near[:, 0], order[:, 1 : kept + 1].astype(np.int32), near[:, 1 : kept + 1], rest)

    def fewer(self, kept: int) -> None:
        """Keeps only `kept` lower bounds; the remainder takes over the others."""
        if kept < self.low.shape[1]:
            self.rest = np.minimum(self.rest, self.low[:, kept:].min(axis=1))
            self.ids, self.low = self.ids[:, :kept], self.low[:, :kept]

    def moved(self, v: np.ndarray, c: np.ndarray, drift: np.ndarray) -> int:
        """After the centroids moved by `drift` to c: bounds are loosened, and vectors rescanned as far as bounds don't certify. The most bounds that one needed."""
        kept = self.low.shape[1]
        self.up = self.up + drift[self.own]
        self.low = self.low - drift[self.ids]
        self.rest = self.rest - drift.max(initial=0)
        # a bound for a rank and all ranks after it
        ranks = np.minimum.accumulate(np.concatenate([self.low, self.rest[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
        open_ = np.flatnonzero(self._fails(self.up[:, None], ranks[:, :1])[:, 0])
        if not len(open_):
            return 0
        exact = np.sqrt(((v[open_] - c[self.own[open_]]) ** 2).sum(axis=1).astype(np.float64))
        self.up[open_] = exact
        need = self._fails(exact[:, None], ranks[open_]).sum(axis=1)  # ranks are in rising order: the first so many fail
        for j in range(1, kept + 1):
            self._reorder(open_[need == j], j, v, c)
        far = open_[need > kept]
        if len(far):
            new = Bounds.scanned(v[far], c, kept)
            self.own[far], self.up[far], self.ids[far], self.low[far], self.rest[far] = new.own, new.up, new.ids, new.low, new.rest
        return int(np.minimum(need, kept).max())

    @staticmethod
    def _fails(up: np.ndarray, low: np.ndarray) -> np.ndarray:
        return up * (1 + _SLACK) >= low * (1 - _SLACK) - _SLACK

    def _reorder(self, at: np.ndarray, j: int, v: np.ndarray, c: np.ndarray) -> None:
        """Orders the assigned centroid and the first j others of some vectors by their exact distances; later ranks are certified."""
        if not len(at):
            return
        ids = np.concatenate([self.own[at][:, None], self.ids[at, :j]], axis=1)
        d = ((v[at][:, None, :] - c[ids]) ** 2).sum(axis=2)
        order = np.lexsort((ids, d), axis=1)
        ids, near = np.take_along_axis(ids, order, axis=1), np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
        self.own[at], self.up[at] = ids[:, 0], near[:, 0]
        self.ids[at, :j], self.low[at, :j] = ids[:, 1:], near[:, 1:]


_STATE = "vec_id long, v array<int>, cluster int, up double, ids array<int>, low array<double>, rest double, used int"


def _matrix(column: pa.Array, kind: type, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).reshape(-1), kind))


def _assigned(centroids: np.ndarray, drift: np.ndarray | None, kept: int):
    """Assigns batches of vectors: by a whole scan, or, with a drift, from the state of the round before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = _matrix(batch.column("v"), np.int64, n)
            if drift is None:
                state, used = Bounds.scanned(v, centroids, kept), 0
            else:
                got = lambda c: batch.column(c).to_numpy(zero_copy_only=False).copy()
                state = Bounds(got("cluster"), got("up"), _matrix(batch.column("ids"), np.int32, n), _matrix(batch.column("low"), np.float64, n), got("rest"))
                state.fewer(kept)
                used = state.moved(v, centroids, drift)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(state.own, pa.int32()), pa.array(state.up), _lists(state.ids, pa.int32()), _lists(state.low, pa.float64()), pa.array(state.rest), pa.array(np.full(n, used, np.int32))], ["vec_id", "v", "cluster", "up", "ids", "low", "rest", "used"])

    return run


def integer_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = 64) -> DataFrame:
    """(vec_id, v): vectors of exactly dims components, none null or non-finite, each x as floor(64 * x)."""
    x = F.transform(F.col(column), lambda y: y.cast("double"))
    sound = (F.size(column) == dims) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
    whole = lambda y: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), y * 64))).cast("int")
    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), F.transform(x, whole)).alias("v")).where("v is not null")


def seeds(kept: DataFrame, k: int, name: str = "1:") -> np.ndarray:
    """The k vectors with the smallest sha256 of name and key; ties, which are rows of one key, in order of their components; null keys last."""
    first = kept.orderBy(F.sha2(F.concat(F.lit(name), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64) if first else np.zeros((0, 0), np.int64)


def _means(assigned: DataFrame, before: np.ndarray) -> tuple[np.ndarray, int]:
    """Exact floors of the clusters' componentwise means, empty ones as before; the most bounds used. k rows come to the driver."""
    dims, after, used = before.shape[1], before.copy(), 0
    sums: list[Column] = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dims)]
    for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.max("used").alias("used"), *sums).collect():
        after[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
        used = max(used, r["used"])
    return after, used


def clustered(kept: DataFrame, k: int = 16, rounds: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(assigned vectors with bounds, final centroids) of integer vectors (vec_id, v), already written once.

    A round is one pass without a shuffle over a table that holds each vector
    beside its bounds, and one partial aggregate of k rows. The first pass
    scans all centroids; later ones shift the bounds by how far centroids
    moved, order exactly as many of the nearest centroids as the bounds leave
    open, and scan all of them only if the remainder bound fails. A quarter of
    the centroids are bounded at first; later rounds keep as many as the
    round before used, an eighth at the least. Bounds certify strictly smaller distances
    only, so ties are met exactly and go to the smaller number.
    """
    c = seeds(kept, k)
    if not len(c):
        return kept.sparkSession.createDataFrame([], _STATE), c
    bounded = max(1, len(c) // 4)
    state = stored(kept.mapInArrow(_assigned(c, None, bounded), _STATE))
    for _ in range(rounds):
        new, used = _means(state, c)
        if state is not None and used:
            bounded = min(bounded, max(1, len(c) // 8, used))
        drift = np.sqrt(((new - c) ** 2).sum(axis=1).astype(np.float64)) * (1 + _SLACK)
        c = new
        state = stored(state.mapInArrow(_assigned(c, drift, bounded), _STATE))
    return state, c


def cluster_digest(vectors: DataFrame, k: int = 16, rounds: int = 3) -> DataFrame:
    """The digest of op11: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or hold null or non-finite
    components are not kept; each kept row is a vector of its own, also if
    rows share a vec_id or all their components. With fewer than k kept
    vectors there are as many centroids. Components beyond LARGEST, whose
    distances would not fit a long, count as LARGEST; sums of distances that
    don't fit a long are null. An empty table gives no rows.
    """
    state, c = clustered(stored(integer_vectors(vectors)), k, rounds)
    spark = vectors.sparkSession
    at = F.array(*[F.array(*[F.lit(int(x)) for x in row]) for row in c]) if len(c) else F.array(F.array(F.lit(0)))
    own = F.element_at(at, F.col("cluster") + 1)
    distance = F.aggregate(F.zip_with("v", own, lambda x, y: (x.cast("long") - y) * (x.cast("long") - y)), F.lit(0).cast("long"), lambda s, x: s + x)
    out = stored(state.select("vec_id", "cluster", distance.alias("distance")))
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: int(x) if x < 1 << 63 else None
    rows = [(i, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i, s in sums.items()]
    # one row for each cluster: k at the most
    told = spark.createDataFrame(rows, "_c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(told), F.col("cluster") == F.col("_c")).drop("_c")


def _cluster_sql(k: int = 16, rounds: int = 3) -> str:
    """Rounds are written out one by one; a centroid is a list of 64 numbers."""
    parts = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v AS c FROM (SELECT v, sha256('1:' || vec_id) AS h FROM kept ORDER BY h LIMIT {k}))"""]
    floor_div = "(s - ((s % n) + n) % n) // n"
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, cluster := cluster)) AS best
  FROM (SELECT r, cluster, list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM kept, c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT cluster, list({floor_div} ORDER BY i) AS c FROM (SELECT best.cluster AS cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
  FROM a{i} JOIN kept USING (r), (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} ON c{rounds}.cluster = best.cluster"""


CLUSTER_SQL = _cluster_sql()
