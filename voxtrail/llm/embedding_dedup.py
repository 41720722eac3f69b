"""Near-duplicate vectors of one label by collision counting on random projections.

Vectors of a label meet in the cells of BANDS shifted grids over a few projections each. In a cell,
COUNTED further projections are sorted; around each vector's place a window is opened, and for each
pair the windows in which they collide are counted. Pairs with at least ``need`` collisions are
verified by their cosine in double precision. Widths and ``need`` are calibrated from the
threshold: for a pair exactly at it, the chance to share no cell is about 7e-5 and the chance to
miss the count 1e-4 at most; nearer pairs are missed far less.

Equal vectors of a label count as one point with a weight, so copies of any number make no pairs.
A pair is looked at in the first band that joins it. Hot cells are split (see ``blocks``); links
leave a cell as degrees and a spanning forest.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and
rows with a null label or id, link with nothing (their component is their own id). Only vectors of
equal length are compared. Repeated rows are returned each."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtrail.llm.blocks import Forest, pairs, subcells, whole_cells
from voxtrail.llm.common import components, stored, unit, usable

BANDS = 16
WIDE = 6             # projections of a band
COUNTED = 32
MOST = 2048          # points of a cell that one task pairs
SEED = 20240923


def calibrate(threshold: float, counted: int = COUNTED, miss: float = 1e-4) -> tuple[float, float, int]:
    """Cell width, half window and least count for pairs at the threshold."""
    d = math.sqrt(2 - 2 * threshold)  # the projections of such a pair differ by N(0, d**2)
    p = math.erf(2 / math.sqrt(2))
    need, tail = counted + 1, 0.0
    while tail < 1 - miss:
        need -= 1
        tail += math.comb(counted, need) * p ** need * (1 - p) ** (counted - need)
    return 6.4 * d, 2 * d, need


def directions(dim: int, width: float, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return (rng.standard_normal((dim, BANDS * WIDE)), rng.random(BANDS * WIDE) * width,
            rng.standard_normal((dim, COUNTED)))


def band_keys(x: np.ndarray, width: float) -> np.ndarray:
    """(rows, BANDS) cell keys of unit vectors; equal cells have equal keys."""
    across, shift, _ = directions(x.shape[1], width)
    cell = np.floor((x @ across + shift) / width).astype(np.int64).reshape(len(x), BANDS, WIDE) + 512
    return (cell * (1 << 10 * np.arange(WIDE))).sum(axis=2)


def vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def links(points: DataFrame, threshold: float, most: int = MOST) -> DataFrame:
    """(a, b, n_a, n_b): degrees (weights of linked points) and forest links of each cell.

    ``points``: label, dim, rep (id), n (weight), v (vector). Rows with b null carry a degree."""
    width, half, need = calibrate(threshold)
    kinds = dict(points.dtypes)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            dims = t.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = t.filter(pa.array(dims == dim))
                keys = band_keys(unit(vectors(part.column("v"))), width)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield from part.append_column("keys", lists).combine_chunks().to_batches()

    schema = f"label {kinds['label']}, dim int, rep bigint, n bigint, v {kinds['v']}"
    rows = (points.select("label", "dim", "rep", "n", "v").mapInArrow(keyed, schema + ", keys array<bigint>")
            .select("*", F.posexplode("keys").alias("band", "cell")))
    cell = ["label", "dim", "band", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ends in whole_cells(batches, [*cell, "__a", "__b"]):
            dims = t.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)  # a contiguous run of each label
                yield from look(t.take(pa.array(at)), np.searchsorted(at, ends[at]))

    def look(t: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = unit(vectors(t.column("v")))
        across = x @ directions(x.shape[1], width)[2]
        rank, low, high = (np.empty(across.shape, dtype=np.int32) for _ in range(3))
        for k in range(across.shape[1]):
            order = np.argsort(across[:, k], kind="stable")
            placed = across[order, k]
            rank[order, k] = np.arange(len(order))
            low[:, k] = np.searchsorted(placed, across[:, k] - half, side="left")
            high[:, k] = np.searchsorted(placed, across[:, k] + half, side="right")
        keys = vectors_of_keys(t.column("keys"))
        band, weight, rep = (t.column(c).to_numpy() for c in ("band", "n", "rep"))
        part, split = t.column("__part").to_numpy(), t.column("__a").to_numpy() != t.column("__b").to_numpy()
        forest, degree = Forest(len(rep)), np.zeros(len(rep), dtype=np.int64)
        for i, j in pairs(ends):
            live = ~split[i] | (part[i] != part[j])
            i, j = i[live], j[live]
            hits = ((low[i] <= rank[j]) & (rank[j] < high[i])).sum(axis=1)
            i, j = i[hits >= need], j[hits >= need]
            if not len(i):
                continue
            near = (x[i] * x[j]).sum(axis=1) >= threshold
            i, j = i[near], j[near]
            first = (keys[i] == keys[j]).argmax(axis=1) == band[i]  # no earlier band joins them
            i, j = i[first], j[first]
            np.add.at(degree, i, weight[j])
            np.add.at(degree, j, weight[i])
            forest.add(i, j)
        at = np.flatnonzero(degree)
        roots = forest.root[at]
        yield pa.RecordBatch.from_arrays([pa.array(rep[at], pa.int64()), pa.array(rep[roots], pa.int64()),
                                          pa.array(degree[at], pa.int64())], names=["a", "b", "n"])

    return subcells(rows, cell, "rep", most).mapInArrow(run, "a bigint, b bigint, n bigint")


def vectors_of_keys(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def near_duplicates(rows: DataFrame, threshold: float = 0.93, row_id: str = "vec_id", vector: str = "embedding",
                    label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    d = rows.select(F.col(row_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    fit = usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    points = stored(d.filter(fit).groupBy("label", "v").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("v")), "points")
    found = stored(links(points, threshold), "vector-links")
    degree = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    roots = components(found.select("a", "b"), name="vector-roots").withColumnRenamed("node", "rep")
    # a label's equal vectors share their representative; the representative names the point
    named = (points.select("label", F.col("v").alias("pv"), "rep", "n").join(degree, "rep", "left")
             .join(roots, "rep", "left")
             .select(F.col("label").alias("pl"), "pv", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"),
                     F.coalesce("root", "rep").alias("root")))
    out = d.withColumn("fit", fit).join(
        named, F.col("fit") & (F.col("label") == F.col("pl")) & (F.col("v") == F.col("pv")), "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
