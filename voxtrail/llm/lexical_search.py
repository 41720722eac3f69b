"""Ranked lexical search, part term at a time and part document at a time.

1. Documents become rows of (length in terms, terms of the queries they hold, occurrences), written
   once: the postings. N, L and the document frequencies are counted over all of them.
2. A task lays about SHARD documents out as lists (document number, impact) per term, where the impact is
   the term's whole part of the score. For each query:
   - lists are taken from the shortest while their sum is at most SHORT of the shard's documents and summed
     into accumulators, term at a time; these are one iterator then, bounded by the largest accumulator;
   - the long lists and that iterator are walked document at a time in blocks of BLOCK documents. A block
     is skipped where the bounds of its iterators cannot reach the query's tenth best score; otherwise the
     iterators are taken by falling bound until the rest cannot lift a new document over that score, and
     the rest is looked up only for documents that can still get in.
3. The tenth best score is kept from shard to shard of a task. A task returns at most ``top`` documents a
   query; a window over these takes the best.

Scores and bounds are 64-bit integers, so the bounds are exact and no document is lost. Queries are sent
to the tasks in groups of at most TERMS term occurrences, each group one pass over the documents: what is sent is
bounded, whatever the number of queries (all texts of one id go together).

Defined results: null text has no terms. Null and repeated ids are documents each; a null id comes last among
equal scores. Repeated rows of a query count once; an id with several texts is ranked over all of them, each
document by its best text. A query without a match has no rows. A very long text is counted once, as a
whole. No documents or no queries: no rows."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxtrail.llm.common import stored

TOP = 10
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # UTF-8 bytes of letters, digits and all beyond ASCII
TERMS = 200_000
SHARD = 1 << 16
BLOCK = 1 << 12
SHORT = 0.25
NO_DOC = (1 << 63) - 1


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, A-Z lower-cased."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, ids, tfs: length and query terms of each document that has a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, n, ids, tfs = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                found = terms(text)
                if found:
                    mine = [(vocabulary[t], k) for t, k in Counter(found).items() if t in vocabulary]
                    keep.append(i)
                    n.append(len(found))
                    ids.append([t for t, _ in mine])
                    tfs.append([k for _, k in mine])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n bigint, ids array<int>, tfs array<bigint>")


class Best:
    """The best (score, document) pairs seen so far, and the score a new one must reach."""

    def __init__(self, top: int):
        self.top, self.score, self.doc = top, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[:self.top]
        self.score, self.doc = score[order], doc[order]


class Shard:
    """Lists of (document number, impact) of some documents, and the largest impact by block."""

    def __init__(self, doc: np.ndarray, n: np.ndarray, term: np.ndarray, tf: np.ndarray, owner: np.ndarray,
                 weight: np.ndarray, documents: int, length: int):
        self.doc = doc
        order = np.lexsort((owner, term))
        term, self.at = term[order], owner[order]
        m = 25 + (75 * n * documents) // max(1, length)
        tf = tf[order]
        self.impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.at]))
        self.cut = np.searchsorted(term, np.arange(len(weight) + 1))
        self.blocks = -(-len(doc) // BLOCK)

    def search(self, query: list[tuple[int, int]], best: Best) -> int:
        """Adds the documents of the shard that belong to the best; returns how many were scored."""
        lists = sorted(((self.cut[t + 1] - self.cut[t], t, times) for t, times in query if self.cut[t + 1] > self.cut[t]))
        if not lists:
            return 0
        short, total = 0, 0
        while short < len(lists) and total + lists[short][0] <= max(SHORT * len(self.doc), lists[0][0]):
            total += lists[short][0]
            short += 1
        iterators = [self._accumulated(lists[:short])]
        iterators += [(self.at[self.cut[t]:self.cut[t + 1]], self.impact[self.cut[t]:self.cut[t + 1]] * times) for _, t, times in lists[short:]]
        edges = np.arange(self.blocks + 1) * BLOCK
        cuts = np.stack([np.searchsorted(at, edges) for at, _ in iterators])
        bound = np.zeros((len(iterators), self.blocks), dtype=np.int64)
        for i, (_, value) in enumerate(iterators):
            some = np.flatnonzero(cuts[i, 1:] > cuts[i, :-1])
            if len(some):
                bound[i, some] = np.maximum.reduceat(value, cuts[i, some])
        whole = bound.sum(axis=0)
        scored = 0
        for b in range(self.blocks):
            if whole[b] >= best.least and whole[b] > 0:
                scored += self._block(b, iterators, cuts[:, b], cuts[:, b + 1], bound[:, b], best)
        return scored

    def _accumulated(self, lists: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: the summed impacts of short lists, by document number."""
        at = np.concatenate([self.at[self.cut[t]:self.cut[t + 1]] for _, t, _ in lists])
        value = np.concatenate([self.impact[self.cut[t]:self.cut[t + 1]] * times for _, t, times in lists])
        order = np.argsort(at, kind="stable")
        at, value = at[order], value[order]
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return at[head], np.add.reduceat(value, head)

    def _block(self, b: int, iterators, low: np.ndarray, high: np.ndarray, bound: np.ndarray, best: Best) -> int:
        """Document at a time in one block: a sum for each document that the leading iterators hold."""
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the iterators from here on can add
        total, seen = np.zeros(BLOCK, dtype=np.int64), np.zeros(BLOCK, dtype=bool)
        base, least, j = b * BLOCK, best.least, 0
        while j < len(order) and rest[j] >= least:
            at, value = iterators[order[j]]
            own = at[low[order[j]]:high[order[j]]] - base
            total[own] += value[low[order[j]]:high[order[j]]]
            seen[own] = True
            j += 1
        live = np.flatnonzero(seen)
        for k in range(j, len(order)):
            live = live[total[live] + rest[k] >= least]
            if not len(live):
                return 0
            at, value = iterators[order[k]]
            at, value = at[low[order[k]]:high[order[k]]] - base, value[low[order[k]]:high[order[k]]]
            if len(at):
                place = np.minimum(np.searchsorted(at, live), len(at) - 1)
                hit = at[place] == live
                total[live[hit]] += value[place[hit]]
        live = live[total[live] >= least]
        if len(live):
            best.add(total[live], self.doc[base + live])
        return len(live)


def _weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _searched(held: DataFrame, queries: list[list[tuple[int, int]]], weight: np.ndarray, documents: int, length: int, top: int) -> DataFrame:
    """query, doc_id, score: the best documents of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in queries]
        parts: list[pa.RecordBatch] = []
        size = 0

        def shard():
            t = pa.Table.from_batches(parts)
            ids = t.column("ids").combine_chunks()
            sizes = np.diff(ids.offsets.to_numpy()) if len(ids) else np.empty(0, np.int64)
            index = Shard(t.column("doc_id").fill_null(NO_DOC).to_numpy(), t.column("n").to_numpy(), ids.flatten().to_numpy(),
                          t.column("tfs").combine_chunks().flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes), weight, documents, length)
            for q, b in zip(queries, best):
                index.search(q, b)

        for b in batches:
            for s in range(0, b.num_rows, SHARD):
                parts.append(b.slice(s, SHARD))
                size += parts[-1].num_rows
                if size >= SHARD:
                    shard()
                    parts, size = [], 0
        if size:
            shard()
        q = np.repeat(np.arange(len(queries)), [len(b.doc) for b in best])
        if len(q):
            doc, score = np.concatenate([b.doc for b in best]), np.concatenate([b.score for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(doc, mask=doc == NO_DOC), pa.array(score)],
                                             names=["query", "doc_id", "score"])

    return held.mapInArrow(run, "query int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, group: int = TERMS, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents (doc_id, text) of each item with a score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(item).cast("bigint").alias("item_id"), F.col(text).alias("text")).distinct()
    rough = asked.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0  # a term and its blank take two bytes at least
    groups = int(rough / group) + 1
    out = None
    for g in range(groups):
        some = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g) if groups > 1 else asked
        found = _group(spark, docs, some.collect(), top)  # about ``group`` terms
        out = found if out is None else out.unionByName(found)
    return out


def _group(spark, docs: DataFrame, rows: list, top: int) -> DataFrame:
    counted = [(r.item_id, Counter(terms(r.text))) for r in rows]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, c in counted for t in c}))}
    queries = [[(vocabulary[t], k) for t, k in c.items()] for _, c in counted]
    held = stored(postings(docs, vocabulary), "postings")
    documents, length = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r.t: r["count"] for r in held.select(F.explode("ids").alias("t")).groupBy("t").count().collect()}  # the group's terms
    weight = np.array([_weight(documents, df.get(i, 0)) for i in range(len(vocabulary))], dtype=np.int64)
    found = _searched(held, queries, weight, documents, length, top)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(counted)], "query int, item_id bigint")
    found = found.join(F.broadcast(names), "query").drop("query")  # at most ``group`` rows
    if len({x for x, _ in counted}) < len(counted):  # several texts of an id: each document by its best
        found = found.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))
