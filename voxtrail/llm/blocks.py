"""Pair search inside cells: hot cells are split, pairs are never emitted.

Rows meet in cells (a grid cell, a hash bucket). A cell with more than ``most`` rows is split by a
hash of the row into S parts, and its rows go to the S sub-cells (a, b) that pair their part with
each other, so that a task holds about 2 * ``most`` rows of a cell and no pair is lost. A sub-cell
gives a spanning forest of its links, not the links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtrail.llm.common import stored

PAIRS = 100_000  # pairs looked at in one step


def subcells(rows: DataFrame, cell: list[str], row: str, most: int) -> DataFrame:
    """Adds ``__part``, ``__a`` and ``__b``: the row's part and the sub-cell it goes to.

    Cells of at most ``most`` rows have one sub-cell (0, 0). The rows come out dealt and sorted
    by sub-cell. The list of hot cells is written first: as a table of known size it is usually
    broadcast, so that the rows are shuffled once."""
    heavy = stored(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
                   .select(*cell, F.ceil(F.col("__n") / most).cast("int").alias("__s")), "hot-cells")
    parts = F.coalesce("__s", F.lit(1))
    d = rows.join(heavy, cell, "left").withColumn("__part", F.pmod(F.xxhash64(row, F.lit(17)), parts).cast("int"))
    d = d.withColumn("__o", F.explode(F.sequence(F.lit(0), parts - 1)))
    d = d.withColumn("__a", F.least("__part", "__o")).withColumn("__b", F.greatest("__part", "__o")).drop("__s", "__o")
    keys = [*cell, "__a", "__b"]
    return d.repartition(*keys).sortWithinPartitions(*keys, row)


def whole_cells(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cells from sorted batches, with the end of the cell of each row."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        tail = tuple(batch.column(k)[-1].as_py() for k in keys)
        head = tuple(batch.column(k)[0].as_py() for k in keys)
        if head == tail and last == tail:
            continue  # still the same cell
        last = tail
        t = pa.Table.from_batches(held)
        ends = _ends(t, keys)
        cut = int(np.searchsorted(ends, len(ends)))  # first row of the last cell
        if cut:
            yield t.slice(0, cut), ends[:cut]
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, _ends(t, keys)


def _ends(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(new)
    return np.repeat(np.append(starts[1:], t.num_rows), np.diff(np.append(starts, t.num_rows)))


def pairs(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of row numbers within cells, about PAIRS at a time."""
    later = ends - np.arange(len(ends)) - 1
    total = np.concatenate([[0], np.cumsum(later)])
    s = 0
    while s < len(ends):
        e = max(s + 1, int(np.searchsorted(total, total[s] + PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(s, e), later[s:e])
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - np.repeat(total[s:e] - total[s], later[s:e])
        s = e


class Forest:
    """Roots of the links seen so far; a root is the smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        r = self.root
        while len(i):
            a, b = r[i], r[j]
            live = a != b
            i, j, a, b = i[live], j[live], a[live], b[live]
            if len(i):
                np.minimum.at(r, np.maximum(a, b), np.minimum(a, b))
                while (r[r] != r).any():
                    r[:] = r[r]
