"""Centroid clustering of integer vectors: a stored table of distances to fixed pivots rules centroids out before any distance is computed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

#: Pivots that the table has distances to.
PIVOTS = 8
#: Components beyond this count as this, so that squared distances of up to 64 of them fit in 64 bits.
LARGEST = 1 << 27


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v): vectors of `dims` finite components as integers floor(scale * x); null, short, long and non-finite vectors go."""
    bound = float(LARGEST)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = df.where((F.size(vector_col) == dims) & ~F.exists(vector_col, odd))
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-bound)), F.lit(bound))).cast("int")
    return kept.select(F.col(id_col).alias("id"), F.transform(vector_col, whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors with the k smallest digests of `salt:id`, in that order; equal digests by their components, null ids last."""
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    rows = vectors.select("v", mark.alias("mark")).orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    return np.square(a - b).sum(-1)


def choose_pivots(centroids: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Of the first centroids the first one, then always the one with the largest sum of distances to those chosen."""
    chosen, total = [0], np.zeros(len(centroids))
    while len(chosen) < min(n, len(centroids)):
        total += np.sqrt(squared(centroids, centroids[chosen[-1]]))
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return centroids[chosen]


def nearest(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (ties: the smaller number), its squared distance, and how many distances were computed.

    |d(v, p) - d(c, p)| is at most d(v, c) for every pivot p. The centroid with the least such bound is measured first; the
    others only where their bound does not exceed that distance. Bounds are doubles, taken down by more than they can be off.
    """
    own = np.sqrt(to_pivots.astype(np.float64))
    bound, slack = np.zeros((len(v), len(centroids))), 1e-9
    for j, pivot in enumerate(pivots):
        far = np.sqrt(squared(centroids, pivot).astype(np.float64))
        np.maximum(bound, np.abs(own[:, j, None] - far[None, :]), out=bound)
        slack = max(slack, 1e-12 * float(max(own[:, j].max(initial=0), far.max(initial=0))))
    best = bound.argmin(1)
    distance, computed = squared(v, centroids[best]), len(v)
    bound = np.square(np.maximum(bound - slack, 0)) * (1 - 1e-12)
    for c, centroid in enumerate(centroids):
        rows = np.flatnonzero((bound[:, c] <= distance) & (best != c))
        d = squared(v[rows], centroid)
        computed += len(rows)
        nearer = (d < distance[rows]) | ((d == distance[rows]) & (c < best[rows]))
        best[rows[nearer]], distance[rows[nearer]] = c, d[nearer]
    return best, distance, computed


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, to_pivots): squared distances to the pivots, computed once and stored."""
    dims = pivots.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            v = _matrix(rows.column("v"), dims)
            flat = np.stack([squared(v, p) for p in pivots], 1).ravel()
            at = pa.array(np.arange(0, len(flat) + 1, len(pivots), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(at, pa.array(flat))], names=["id", "v", "to_pivots"])

    kind = vectors.schema["id"].dataType.simpleString()
    return storage.written(vectors.mapInArrow(run, f"id {kind}, v array<int>, to_pivots array<long>"), "pivots")


def _means(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One round: each task adds up its own vectors by centroid, Spark the tasks; a centroid without vectors stays."""
    k, dims = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for rows in batches:
            v = _matrix(rows.column("v"), dims)
            best, _, _ = nearest(v, _matrix(rows.column("to_pivots"), len(pivots)), centroids, pivots)
            order = np.argsort(best, kind="stable")
            found, first = np.unique(best[order], return_index=True)
            if len(found):
                total[found] += np.add.reduceat(v[order], first)
                n += np.bincount(best, minlength=k)
        c, d = np.divmod(np.arange(k * dims), dims)
        held = n[c] > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[held].astype(np.int32)), pa.array(d[held].astype(np.int32)), pa.array(total.ravel()[held]), pa.array(n[c][held])], names=["cluster", "dim", "total", "n"])

    sums = table.mapInArrow(run, "cluster int, dim int, total long, n long").groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for c, d, total, n in sums.collect():  # centroids x components rows
        out[c, d] = int(total) // n
    return out


def clustered(df: DataFrame, id_col: str, vector_col: str, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1", pivots: int = PIVOTS) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each whole vector after some rounds of centroids.

    Components are integers floor(scale * x), at most LARGEST in size; all distances and means are exact. The k x dims centroids
    are all that the driver holds. Fewer than k vectors make fewer centroids, none give no rows. Rows that repeat an id count
    each; a null id is kept and never starts a centroid before others. Sums beyond 64 bits are null.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, id_col, vector_col, dims, scale)
    centroids = first_centroids(vectors, k, salt)
    kind = vectors.schema["id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    fixed = choose_pivots(centroids, pivots)
    table = pivot_table(vectors, fixed)
    for _ in range(rounds):
        centroids = _means(table, centroids, fixed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            best, distance, _ = nearest(_matrix(rows.column("v"), dims), _matrix(rows.column("to_pivots"), len(fixed)), centroids, fixed)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    found = storage.written(table.mapInArrow(run, f"id {kind}, cluster int, distance long"), "assigned")
    spread = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    whole = sum(spread.values())
    long = lambda x: x if x < 1 << 63 else None
    rows = [(c, long(s), long(whole), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(spread.items())]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
