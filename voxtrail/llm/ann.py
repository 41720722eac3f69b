"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns a unit vector;
its bucket is the signed axis it lies nearest to. Each of TABLES tables has its own rotation. A
query visits the buckets of its PROBES nearest axes in every table; candidates are reranked by
their exact cosine where they lie, and only each bucket's best travel on.

Bucket sizes are counted first (2 x dimension x TABLES numbers per vector length); a bucket of more
than ``most`` vectors or queries is split by a hash, members and queries alike, and each pair of parts is a group of
its own, so a hot bucket is no hot task. A query that finds fewer than k visits all axes of one table, which holds every vector:
all candidates are returned where there are fewer than k.

Recall at 5 for 51,000 random 64-dimensional vectors is about 0.99 (the hardest case: the fifth
neighbour lies at cosine 0.4); see the tests.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and
rows without an id, take no part. Only vectors of equal length are compared. Ties go to the smaller
id; a repeated row counts once per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtrail.llm.common import matrix, stored, unit, usable

TABLES = 8
PROBES = 16
MOST = 1024
SEED = 20240919


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), not scaled."""
    n, dim = x.shape
    h = 1
    while h < dim:
        y = x.reshape(n, dim // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, dim)
        h *= 2
    return x


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of unit vectors, padded to a power of two."""
    dim = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    rng = np.random.default_rng([SEED, table, dim])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], dim)) / np.sqrt(dim)
    return x


def nearest_axes(y: np.ndarray, probes: int) -> np.ndarray:
    """Signed axes by nearness; axis a + dim is the negative side of axis a."""
    both = np.concatenate([y, -y], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _hashed(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """id, v, dim and the buckets (table, axis) of each row of (id, v)."""
    kind = dict(rows.dtypes)["v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = b.column(1).to_pylist()
            dims = np.array([len(v) for v in vs])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = unit(np.array([vs[i] for i in at], dtype=np.float64))
                axes = [nearest_axes(rotated(x, t), probes) for t in range(tables)]
                buckets = [[{"table": t, "axis": int(a)} for t in range(tables) for a in axes[t][i]] for i in range(len(at))]
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([int(dim)] * len(at), pa.int32()),
                     pa.array(buckets, pa.list_(pa.struct([("table", pa.int32()), ("axis", pa.int32())])))],
                    names=["id", "v", "dim", "buckets"])

    return (rows.select("id", "v").mapInArrow(run, f"id bigint, v {kind}, dim int, buckets array<struct<table:int,axis:int>>")
            .select("id", "v", "dim", F.explode("buckets").alias("b")).select("id", "v", "dim", "b.table", "b.axis"))


def _best(k: int):
    def rerank(key, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(members):
            q, x, ids = matrix(queries["v"]), matrix(members["v"]), members["id"].to_numpy()
            by = np.argsort(ids, kind="stable")
            x, ids = x[by], ids[by]
            first = np.concatenate([[True], ids[1:] != ids[:-1]])  # rows of one id are neighbours
            start = np.flatnonzero(first)
            qu, xu = unit(q), unit(x)
            for s in range(0, len(q), 256):
                near = qu[s:s + 256] @ xu.T
                for r, me in enumerate(queries["id"].to_numpy()[s:s + 256]):
                    row = np.where(ids == me, -np.inf, near[r])
                    each = row if first.all() else np.maximum.reduceat(row, start)  # a repeated id takes one place
                    take = min(k, len(each))
                    least = np.partition(each, len(each) - take)[len(each) - take]
                    at = np.flatnonzero((row >= least - 1e-9) & np.isfinite(row))
                    # the exact cosine, by a sum whose order does not depend on the bucket
                    exact = (qu[s + r] * xu[at]).sum(axis=1)
                    order = np.lexsort((ids[at], -exact))
                    seen = pd.unique(ids[at][order])[:k]
                    best = dict(zip(ids[at][order][::-1], exact[order][::-1]))
                    out += [(me, i, best[i]) for i in seen]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return rerank


def _search(queries: DataFrame, rows: DataFrame, k: int, tables: int, probes: int, most: int) -> DataFrame:
    """(query_id, vec_id, score): candidates that are among the best k of some bucket."""
    keys = ["dim", "table", "axis"]
    index, asked = _hashed(rows, tables, 1), _hashed(queries, tables, probes)

    def parts(df: DataFrame, name: str) -> DataFrame:
        # written once: both sides must see the same parts
        return stored(df.groupBy(*keys).count().filter(F.col("count") > most).select(
            *[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("count") / most).cast("int").alias(name)), "bucket-sizes")

    members_in, queries_in = parts(index, "__mp"), parts(asked, "__qp")

    def dealt(df: DataFrame, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        for sizes in (members_in, queries_in):
            s = sizes.select(*[F.col(c).alias(c) for c in sizes.columns])
            same = [F.col(k) == F.col(f"__{k}") for k in keys]
            df = df.join(s, same[0] & same[1] & same[2], "left").drop(*[f"__{k}" for k in keys])
        return df.select(*keys, "id", "v", F.pmod(F.xxhash64("id"), F.coalesce(own_parts, F.lit(1))).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.coalesce(other_parts, F.lit(1)) - 1)).alias(other))

    left, right = dealt(index, "part", "__mp", "asked", "__qp"), dealt(asked, "asked", "__qp", "part", "__mp")
    return (right.groupBy(*keys, "part", "asked").cogroup(left.groupBy(*keys, "part", "asked"))
            .applyInPandas(_best(k), "query_id bigint, vec_id bigint, score double"))


def nearest(rows: DataFrame, is_query: Column, k: int = 5, row_id: str = "vec_id", vector: str = "embedding",
            tables: int = TABLES, probes: int = PROBES, most: int = MOST) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, itself excluded."""
    d = rows.filter(F.col(row_id).isNotNull() & usable(vector)).select(
        F.col(row_id).cast("bigint").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))
    members, queries = d.select("id", "v"), d.filter("q").select("id", "v")
    found = stored(_search(queries, members, k, tables, probes, most)
                   .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "neighbours")
    enough = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id"))
    lacking = stored(queries.join(enough, "id", "left_anti"), "lacking")
    if lacking.take(1):  # they meet the members of their own dimensions
        widths = lacking.select(F.size("v").alias("__w")).distinct()
        near = members.join(widths, F.size("v") == F.col("__w"), "left_semi")
        width = lacking.agg(F.max(F.size("v"))).first()[0]  # one number
        found = found.unionByName(_search(lacking, near, k, 1, 2 << max(0, width - 1).bit_length(), most))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
