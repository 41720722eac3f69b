"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits are 32 segments of two; the embedding is the count of ones in each. The
Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints. Counts
are kept as thermometer codes (0: 00, 1: 01, 2: 11), whose Hamming distance is that Manhattan
distance. The 32 dimensions are cut into six blocks; embeddings within distance four agree on two
blocks at least, so each of the 15 block pairs is a grid, cells being equal counts there. Inside a
cell the lower bound comes first, then the exact test.

Copies share a fingerprint and count as one point, so copies of any number make no pairs. Hot
cells are split (see ``blocks``); links leave a cell as a spanning forest.

Defined results: null or blank text has fingerprint zero and is linked like any other. Null ids
link to nothing: such a row takes the component of the smallest id with its fingerprint, else null.
Repeated rows are returned each."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from voxtrail.llm.blocks import Forest, pairs, subcells, whole_cells
from voxtrail.llm.common import components, stored

SEED = 42
SHINGLE = 4
DISTANCE = 4
BLOCKS = DISTANCE + 2
MOST = 4096          # fingerprints of a cell that one task pairs
ODD = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the hashes of all word shingles, as a signed 64-bit number."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:len(starts) - n + 1].tolist(), ends[n - 1:].tolist())],
                 dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for s in range(0, len(h), 8192):
        ones += np.unpackbits(h[s:s + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def thermometer(fp: Column) -> Column:
    up = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(F.lit(ODD)).bitwiseOR(
        F.shiftleft(fp.bitwiseAND(up).bitwiseAND(F.lit(ODD)), 1))


def grids(blocks: int = BLOCKS, equal: int = BLOCKS - DISTANCE) -> list[int]:
    """Masks of the dimensions on which two near embeddings agree, as signed numbers."""
    cuts = [round(32 * i / blocks) for i in range(blocks + 1)]
    part = [sum(3 << 2 * d for d in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), equal)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(points: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """(a, b): a spanning forest per cell of the links between ``points`` (fp, rep)."""
    code = thermometer(F.col("fp"))
    cells = F.array(*[F.struct(F.lit(g).alias("grid"), F.shiftleft(code.bitwiseAND(F.lit(m)), 0).alias("cell"))
                      for g, m in enumerate(grids())])
    rows = points.select("fp", "rep", F.explode(cells).alias("c")).select("c.grid", "c.cell", "fp", "rep")
    keys = ["grid", "cell", "__a", "__b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ends in whole_cells(batches, keys):
            fp = t.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            up, odd = fp >> np.uint64(1), np.uint64(ODD)
            code = (fp | up) & odd | (fp & up & odd) << np.uint64(1)
            part, split = t.column("__part").to_numpy(), t.column("__a").to_numpy() != t.column("__b").to_numpy()
            forest = Forest(len(fp))
            for i, j in pairs(ends):
                near = np.bitwise_count(code[i] ^ code[j]) <= distance  # Manhattan: a lower bound
                near &= ~split[i] | (part[i] != part[j])
                i, j = i[near], j[near]
                same = np.bitwise_count(fp[i] ^ fp[j]) <= distance
                forest.add(i[same], j[same])
            at = np.flatnonzero(forest.root != np.arange(len(fp)))
            rep = t.column("rep").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(rep[at], pa.int64()), pa.array(rep[forest.root[at]], pa.int64())],
                                             names=["a", "b"])

    return subcells(rows, ["grid", "cell"], "fp", most).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: one row per document."""
    fps = stored(fingerprints(docs), "fingerprints")
    points = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(points.filter(F.col("rep").isNotNull())), name="simhash")
    # written, so that a fingerprint of many documents is a join that Spark can split
    of = stored(points.join(roots, points.rep == roots.node, "left").select(
        F.col("fp").alias("__fp"), F.coalesce("root", "rep").alias("component_id")), "classes")
    return fps.join(of, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")
