"""Centroid clustering in whole numbers with a LAESA pivot table.

1. Vectors become whole numbers once (component x: floor(256 x)) and are written with their distances to
   a few fixed pivots: the pivot table. Pivots are picked from a bounded sample, each as far as possible
   from those before it.
2. A round sends the centroids to the tasks (k x dim numbers). The distances between centroids and pivots
   give a lower bound for every pair of vector and centroid: the largest difference of their distances to
   a pivot. The centroid with the least bound is measured first; only those whose bound does not exceed
   that distance are measured too, in exact 64-bit integers.
3. Tasks return sums and counts per centroid; the driver sees k x (dim + 1) whole numbers a round.

Bounds are computed in doubles and lowered by more than their rounding error, so no nearest centroid is lost.

Defined results: vectors with another number of components, null, or with null or non-finite components
take no part, nor do those with a component of 2**19 or more in magnitude, whose squared distance may not
fit 64 bits. Repeated rows are vectors each. A null id comes last among the starting centroids; equal hashes
go by components. Fewer vectors than ``k``: each is a centroid. Sums of distances beyond 64 bits are the
largest long. No vectors: no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtrail.llm.common import stored

DIM, K, ROUNDS = 64, 40, 5
SCALE = 256
PIVOTS = 16
SAMPLE = 512          # vectors from which pivots are picked
LARGEST = 1 << 19     # components of this magnitude or more take no part
LONG = (1 << 63) - 1
PAIRS = 1 << 16       # exact distances computed at once


def whole(vectors: DataFrame, dim: int = DIM, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v: the vectors that take part, as whole numbers."""
    v = F.col(vector)
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= LARGEST))
    return vectors.filter((F.size(v) == dim) & ~wrong).select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.transform(v, lambda x: F.floor(SCALE * x.cast("double")).cast("int")).alias("v"))


def starts(points: DataFrame, k: int = K, salt: str = "2:") -> np.ndarray:
    """The ``k`` vectors with the smallest hash of their id, in that order."""
    rows = (points.select("v", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h"))
            .orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect())  # k rows
    return np.array([r.v for r in rows], dtype=np.int64)


def pivots(points: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Vectors far from each other, from a sample of ``sample`` rows by a hash of the row."""
    rows = np.array([r.v for r in points.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").select("v").limit(sample).collect()],
                    dtype=np.int64)
    chosen = [0]
    near = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(rows)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from the rows of y, pair by pair."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances (doubles) of all rows of x from the few rows of y."""
    return np.sqrt(np.stack([squared(x, row[None, :]) for row in y], axis=1).astype(np.float64))


def nearest(v: np.ndarray, table: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: the smaller number) and squared distance of each vector, and the exact distances it took.

    ``table``: distances of the vectors to the pivots; ``to_pivots``: those of the centroids."""
    n, k = len(v), len(centroids)
    bound = np.zeros((n, k))
    for p in range(table.shape[1]):
        np.maximum(bound, np.abs(table[:, p, None] - to_pivots[None, :, p]), out=bound)
    slack = 1e-12 * (table.max(axis=1, initial=0.0)[:, None] + to_pivots.max(axis=1, initial=0.0)[None, :])
    bound = np.maximum(0.0, bound - slack) ** 2 * (1 - 1e-12)
    first = bound.argmin(axis=1)
    best = squared(v, centroids[first])
    found = first.copy()
    bound[np.arange(n), first] = np.inf
    row, other = np.nonzero(bound <= best[:, None])
    for s in range(0, len(row), PAIRS):
        i, c = row[s:s + PAIRS], other[s:s + PAIRS]
        d = squared(v[i], centroids[c])
        # the best of each vector in this part: by distance, then by number
        order = np.lexsort((c, d, i))
        head = order[np.concatenate([[True], i[order][1:] != i[order][:-1]])]
        i, c, d = i[head], c[head], d[head]
        better = (d < best[i]) | ((d == best[i]) & (c < found[i]))
        best[i[better]], found[i[better]] = d[better], c[better]
    return found, best, n + len(row)


def _vectors(batch: pa.RecordBatch, name: str, dtype) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(dtype)


def with_pivots(points: DataFrame, chosen: np.ndarray) -> DataFrame:
    """Adds ``to_pivots``, the distances to the pivots: the pivot table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = distances(_vectors(b, "v", np.int64), chosen)
                lists = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), d.ravel())
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["vec_id", "v", "to_pivots"])

    return points.mapInArrow(run, "vec_id bigint, v array<int>, to_pivots array<double>")


def sums(table: DataFrame, centroids: np.ndarray, chosen: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of the vectors of each non-empty centroid."""
    k, dim = centroids.shape
    to_pivots = distances(centroids, chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                v = _vectors(b, "v", np.int64)
                c, _, _ = nearest(v, _vectors(b, "to_pivots", np.float64), centroids, to_pivots)
                order = np.argsort(c, kind="stable")
                ids, at = np.unique(c[order], return_index=True)
                total[ids] += np.add.reduceat(v[order], at, axis=0)
                count += np.bincount(c, minlength=k)
        some = np.flatnonzero(count)
        if len(some):
            parts = np.concatenate([count[some, None], total[some]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(some, dim + 1).astype(np.int32)), pa.array(np.tile(np.arange(dim + 1, dtype=np.int32), len(some))),
                 pa.array(parts.ravel())], names=["c", "at", "x"])

    out: dict[int, list[int]] = {}
    for r in table.mapInArrow(run, "c int, at int, x bigint").groupBy("c", "at").agg(F.sum("x").alias("x")).collect():
        out.setdefault(r.c, [0] * (dim + 1))[r["at"]] = r.x  # k x (dim + 1) numbers
    return {c: (x[0], x[1:]) for c, x in out.items()}


def assigned(table: DataFrame, centroids: np.ndarray, chosen: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""
    to_pivots = distances(centroids, chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c, d, _ = nearest(_vectors(b, "v", np.int64), _vectors(b, "to_pivots", np.float64), centroids, to_pivots)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.astype(np.int32)), pa.array(d)],
                                                 names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, salt: str = "2:",
            vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Assignment (vec_id, cluster, distance) and centroids (cluster, v, n, cluster_inertia, inertia)."""
    spark = vectors.sparkSession
    points = whole(vectors, dim, vec_id, vector)
    centroids = starts(points, k, salt)
    wide = "cluster int, v array<bigint>, n bigint, cluster_inertia bigint, inertia bigint"
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), spark.createDataFrame([], wide)
    chosen = pivots(points)
    table = stored(with_pivots(points, chosen), "pivot-table")
    for _ in range(rounds):
        for c, (n, total) in sums(table, centroids, chosen).items():
            centroids[c] = [x // n for x in total]
    found = stored(assigned(table, centroids, chosen), "assigned")
    each = {r.cluster: (r.n, int(r.d)) for r in found.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    inertia = min(LONG, sum(d for _, d in each.values()))
    rows = [(c, centroids[c].tolist(), each.get(c, (0, 0))[0], min(LONG, each.get(c, (0, 0))[1]), inertia)
            for c in range(len(centroids))]
    return found, spark.createDataFrame(rows, wide)


def report(found: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row per vector with its cluster's figures and the hash of its centroid."""
    figures = centroids.select("cluster", "cluster_inertia", "inertia",
                               F.sha2(F.array_join("v", ","), 256).alias("centroid_sha256"))
    return found.join(F.broadcast(figures), "cluster").select(  # at most k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
