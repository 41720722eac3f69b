"""Helpers that several operators share: tables, cuts, components, vectors."""

from __future__ import annotations

import gc
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtrail.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes a Parquet table to the shared folder and reads it again.

    The folder is the one ``spark.checkpoint.dir`` names, so the table outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps.

    Its cleaner removes what the driver's garbage collection has found unused; between two large
    steps that would come too late for the disks. The first collection ends the queries that hold
    the shuffles, the second finds these unused."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def held_out(doc_id) -> F.Column:
    """True if crc32 of the id as text leaves remainder 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """(node, root): root is the smallest node reachable over the undirected links.

    Each round, every node points to its smallest neighbour, chains of pointers are halved, and
    the links are contracted to links between roots; the links left shrink at least by half of
    the trees that have one, so the rounds grow with the logarithm of the longest chain. No group
    of a node's links is ever gathered: only minima and joins. Nodes without a link are absent."""
    x, y = F.col(a), F.col(b)
    edges = stored(links.filter((x != y) & x.isNotNull() & y.isNotNull())
                   .select(F.explode(F.array(F.struct(x.alias("a"), y.alias("b")),
                                             F.struct(y.alias("a"), x.alias("b")))).alias("e"))
                   .select("e.a", "e.b").distinct(), name)
    labels = None
    while edges.take(1):
        hook = stored(edges.groupBy("a").agg(F.min("b").alias("m"))
                      .select("a", F.least("a", "m").alias("p")), name)
        while True:
            above = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = stored(hook.join(above, "p").select("a", "p", "pp"), name)
            hook = jumped.select("a", F.col("pp").alias("p"))
            if not jumped.filter("p <> pp").take(1):
                break
        if labels is None:
            labels = hook.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            up = hook.select(F.col("a").alias("root"), F.col("p").alias("higher"))
            labels = stored(labels.join(up, "root", "left")
                            .select("node", F.coalesce("higher", "root").alias("root")), name)
        left = hook.select("a", F.col("p").alias("x"))
        right = hook.select(F.col("a").alias("b"), F.col("p").alias("y"))
        edges = stored(edges.join(left, "a").join(right, "b").filter("x <> y")
                       .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), name)
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def usable(vector: str) -> F.Column:
    """True for a vector that is not null, not empty, all finite and not zero."""
    v = F.col(vector)
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(v.isNotNull() & ~wrong & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of a vector column as a float64 matrix."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
