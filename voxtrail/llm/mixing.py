"""Mixing sources to target weights, in fixed-length blocks of words.

1. The documents of a source are laid end to end and cut into blocks of ``block`` words (fewer in a
   source of under MANY such blocks, so that a small source can meet its target too).
2. Each source's target gives its number of slots, at most ``most`` times its blocks. The slots of
   all sources are dealt to output shards of about ``shard`` slots: the counts of a shard are a
   multinomial draw given those totals (a multivariate hypergeometric draw), made by halving
   the range of shards again and again. A shard finds its own counts, and how many slots of each
   source lie before it, in log(shards) draws without any other shard.
3. Slot i of a source with n blocks takes block permutation(i mod n) of round i div n. The
   permutation is a keyed Feistel network with cycle walking, so no list of indexes is kept, and a
   block is taken once a round.
4. Slots and blocks meet by (source, block) in an equi-join.

The driver sees one row per source (a list that carries the weights). Offsets of documents in a
hot source are running sums inside hash buckets plus the buckets' offsets. Everything is seeded: reruns
agree.

Defined results: null text has size 0 and is never taken; null sources form one source, the last.
Repeated rows are laid out each. No documents, or no words: nothing is taken. A very long text is many
blocks and is mixed in parts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxtrail.functions import arrays as A
from voxtrail.llm.common import stored

BLOCK = 32
MANY = 256
SHARD = 1 << 16
SEED = 20240925
BUCKET = 1_000       # documents of a bucket, or the root of their number
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Shares of ``share`` x all sizes by weight; none above ``most`` x its size, the excess reshared."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        for i in above or open_:
            out[i] = most * sizes[i] if above else weights[i] * unit
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)] if above else []
    return out


def draw(colors: np.ndarray, take: int, seed: list[int]) -> np.ndarray:
    """``take`` balls without replacement: the count of each colour."""
    rng = np.random.default_rng(seed)
    if colors.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(colors, take, method="marginals")
    out, rest, left = np.zeros_like(colors), int(colors.sum()), take
    for i, c in enumerate(colors.tolist()):  # normal draws are exact enough for such counts
        rest -= c
        p = c / max(1, c + rest)
        sd = np.sqrt(max(0.0, left * p * (1 - p) * (c + rest - left) / max(1, c + rest - 1)))
        out[i] = min(c, left, max(0, left - rest, round(left * p + sd * rng.standard_normal())))
        left -= int(out[i])
    return out


def shard_counts(slots: np.ndarray, shards: int, shard: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The shard's slots of each source, and those in all shards before it."""
    total = int(slots.sum())
    low, high, counts, before = 0, shards, slots.copy(), np.zeros_like(slots)
    while high - low > 1:
        mid = (low + high) // 2
        left = draw(counts, total * mid // shards - total * low // shards, [seed, low, high])
        if shard < mid:
            high, counts = mid, left
        else:
            low, counts, before = mid, counts - left, before + left
    return counts, before


def permuted(i: np.ndarray, n: int, key: list[int]) -> np.ndarray:
    """Place of each index under a keyed permutation of range(n)."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    rounds = np.random.default_rng(key).integers(0, 2 ** 63, 4, dtype=np.uint64)

    def once(x):
        l, r = x >> half, x & mask
        for k in rounds:
            m = (r + k) * np.uint64(0x9E3779B97F4A7C15)
            m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            l, r = r, l ^ ((m >> np.uint64(32)) & mask)
        return l << half | r

    x = once(i.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


@dataclass
class Mix:
    """``documents``: doc_id, source, size, k, start, at and the row's key (k, bucket, row).
    ``pieces``: the same, one row per block the document lies in, with ``words`` and ``begin``
    (words of the document before the piece). ``slots``: shard, slot, k, epoch, block.
    ``sources``: source, k, source_size, target, length, blocks, slots."""

    documents: DataFrame
    pieces: DataFrame
    slots: DataFrame
    sources: DataFrame


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
         block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> Mix:
    """Lays out the mix of ``docs`` (doc_id, text, source); the weights repeat over the sources."""
    spark = docs.sparkSession
    sized = stored(docs.select("doc_id", "source", F.coalesce(
        F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")), "sizes")
    sums = {r.source: int(r.size) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}  # the source list
    names = sorted(s for s in sums if s is not None) + [None] * (None in sums)
    sizes = [sums[s] for s in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, most)
    length = [min(block, max(1, s // MANY)) for s in sizes]
    blocks = [-(-s // b) for s, b in zip(sizes, length)]
    slots = [min(int(most * n), round(g / s * n)) if s else 0 for n, g, s in zip(blocks, goal, sizes)]
    sources = spark.createDataFrame(
        list(zip(names, range(len(names)), sizes, goal, length, blocks, slots)),
        "source string, k int, source_size bigint, target double, length bigint, blocks bigint, slots bigint")

    count = sized.count()
    keyed = (sized.join(F.broadcast(sources.select(F.col("source").alias("s"), "k", "source_size", "target", "length"))
                        if len(names) <= 10_000 else sources.select(F.col("source").alias("s"), "k", "source_size", "target", "length"),
                        F.col("source").eqNullSafe(F.col("s")), "inner").drop("s")
             .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(int(count / max(BUCKET, count ** 0.5)) + 1))))
    order = Window.partitionBy("k", "bucket").orderBy("doc_id", "size")
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("k", "bucket").agg(F.sum("size").alias("n")).select(
        F.col("k").alias("ok"), F.col("bucket").alias("ob"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    laid = (keyed.withColumn("row", F.row_number().over(order))
            .withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
            .join(offsets, (F.col("k") == F.col("ok")) & (F.col("bucket") == F.col("ob")))
            .withColumn("start", F.col("base") + F.col("at")).drop("ok", "ob", "base", "at"))
    laid = stored(laid, "layout")
    end = F.col("start") + F.col("size")
    pieces = (laid.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(
                  F.floor(F.col("start") / F.col("length")), F.floor((end - 1) / F.col("length"))))))
              .withColumn("begin", F.greatest(F.lit(0), F.col("block") * F.col("length") - F.col("start")))
              .withColumn("words", F.coalesce(F.least(end, (F.col("block") + 1) * F.col("length"))
                                              - F.col("start") - F.col("begin"), F.lit(0))))
    # Spark takes the slots for as small as the list of shards; they must not be broadcast
    return Mix(laid, pieces.hint("merge"), _slots(spark, np.array(slots, dtype=np.int64), np.array(blocks, dtype=np.int64), shard, seed), sources)


def _slots(spark, slots: np.ndarray, blocks: np.ndarray, shard: int, seed: int) -> DataFrame:
    shards = max(1, -(-int(slots.sum()) // shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                counts, before = shard_counts(slots, shards, s, seed)
                k = np.repeat(np.arange(len(counts)), counts)
                i = np.arange(len(k)) - np.repeat(np.cumsum(counts) - counts - before, counts)
                epoch, taken = i // np.maximum(1, blocks[k]), np.zeros(len(k), dtype=np.int64)
                for source, e in set(zip(k.tolist(), epoch.tolist())):
                    at = (k == source) & (epoch == e)
                    n = int(blocks[source])
                    taken[at] = permuted(i[at] - e * n, n, [seed, source, e])
                slot = np.random.default_rng([seed, s]).permutation(len(k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), s)), pa.array(slot), pa.array(k.astype(np.int32)),
                     pa.array(epoch.astype(np.int32)), pa.array(taken)], names=["shard", "slot", "k", "epoch", "block"])

    return spark.range(0, shards, 1, min(shards, 10_000)).mapInArrow(
        run, "shard bigint, slot bigint, k int, epoch int, block bigint").hint("merge")


def mixed(m: Mix) -> DataFrame:
    """The mix: which words of which document fill each slot of each shard."""
    return m.slots.join(m.pieces, ["k", "block"]).select(
        "shard", "slot", "source", "doc_id", "begin", "words", "epoch", "k", "block")


def taken(m: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words the mix takes of each document."""
    times = m.slots.groupBy("k", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")
    return (m.pieces.join(times, ["k", "block"], "left")
            .groupBy("k", "bucket", "row", "doc_id", "size", "source_size", "target")
            .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("bigint").alias("taken"))
            .select("doc_id", "size", "source_size", "target", "taken"))


def mixed_documents(docs: DataFrame, m: Mix) -> DataFrame:
    """The mix as documents: the columns of ``docs``, one row per document and round it is taken in.

    ``text`` holds the words taken, in order, each with the blanks behind it; a document taken
    whole keeps its text as it is. Rows of equal id, source and size stand for each other. A very long
    text is cut into words once a row, so its cost grows with its length."""
    cols = docs.columns
    parts = (m.slots.join(m.pieces, ["k", "block"])
             .groupBy("k", "bucket", "row", "doc_id", "source", "size", "epoch")
             .agg(F.array_sort(F.collect_list(F.struct("begin", "words"))).alias("parts"), F.sum("words").alias("words")))
    same = Window.partitionBy("doc_id", "source", "size").orderBy("k", "bucket", "row")
    parts = parts.withColumn("nth", F.dense_rank().over(same)).select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"),
        F.col("nth").alias("__nth"), F.col("parts").alias("__parts"), F.col("words").alias("__words")).hint("merge")
    sized = docs.withColumn("__n", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))
    sized = sized.withColumn("__at", F.row_number().over(
        Window.partitionBy("doc_id", "source", "__n").orderBy(F.xxhash64("text"))))
    joined = sized.join(parts, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
                        & (F.col("__n") == F.col("__size")) & (F.col("__at") == F.col("__nth")))
    words = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    # the words are bound once: named inside the lambda they would be extracted again for each part
    some = A.let(F.struct(words.alias("words"), F.col("__parts").alias("parts")), lambda t: F.array_join(F.flatten(F.transform(
        t["parts"], lambda p: F.slice(t["words"], (p["begin"] + 1).cast("int"), p["words"].cast("int")))), ""))
    text = F.when(F.col("__words") == F.col("__n"), F.col("text")).otherwise(some)
    out = joined.withColumn("text", text)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in cols])
