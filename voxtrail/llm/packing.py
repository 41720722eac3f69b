"""Packing token sequences with Karmarkar-Karp multiway differencing.

A document is its tokenizer ids and a closing 0. Whole stretches of ``capacity`` ids fill a window
alone; the rest is cut into pieces of at most ``PIECE`` ids. Pieces are gathered until they fill
``WINDOWS`` windows but for a small slack (the last one is cut to meet it), and the group is
dealt to its windows by multiway differencing: the two partial partitions with the largest
imbalance merge, the fullest window of one with the emptiest of the other, so imbalances cancel.
If a window exceeds the capacity, the group gets one window more and is dealt again.

Each task packs the documents of its own input split in the same pass that tokenizes them, so
there is no shuffle at all, and a task holds one group at a time whatever the table's size. A split
that is run again packs alike.

Defined results: null text counts as empty, so a document has one token at least. Repeated rows are
packed each. No rows, no sequences."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

CAPACITY = 1024
PIECE = 256
WINDOWS = 64
SLACK = 4            # ids a window that a group leaves free
END = np.zeros(1, dtype="<u4")

# Both libraries split texts of these blocks alike (letters and numbers of long standing).
_OTHER = re.compile("[^\0-\u05ff\u2000-\u206f\u20a0-\u20bf\u3000-\u9fef\uac00-\ud7a3]")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    A faster library reads the same vocabulary (its merges are its ids' order); texts with a
    special token's string or rare scripts go to the tokenizer itself."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = _byte_letters()
        vocabulary = {bytes(letters[c] for c in token): i for token, i in
                      self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return END
        if _OTHER.search(text) or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        ids.append(0)
        return np.array(ids, dtype="<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deals items to k windows: multiway largest differencing. Returns the items of each."""
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = size
        heap.append((-size, i, sums, [[i]] + [[]] * (k - 1)))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, s1, g1 = heapq.heappop(heap)
        _, _, s2, g2 = heapq.heappop(heap)
        s = s1 + s2[::-1]  # both descending: the fullest meets the emptiest
        order = np.argsort(-s, kind="stable")
        g = [a + b if a and b else a or b for a, b in zip(g1, reversed(g2))]
        s = s[order]
        heapq.heappush(heap, (int(s[-1] - s[0]), tie, s, [g[j] for j in order.tolist()]))
        tie += 1
    return heap[0][3] if heap else [[] for _ in range(k)]


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; their count rises while one exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += 1


def _pieces(ids: np.ndarray, capacity: int, piece: int) -> Iterator[tuple[int, int]]:
    full = len(ids) // capacity * capacity
    for s in range(0, full, capacity):
        yield s, capacity
    for s in range(full, len(ids), piece):
        yield s, min(piece, len(ids) - s)


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType())])


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, piece: int = PIECE,
         windows: int = WINDOWS, slack: int = SLACK, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and their place: one row per piece.

    ``ids`` are the piece's ids as little-endian 32-bit numbers (null without ``with_ids``)."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    target = windows * (capacity - slack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        first = TaskContext.get().partitionId() << 40
        used, out, group, held = 0, [], [], 0

        def put(members):
            nonlocal used
            at = 0
            for doc, start, part, total in members:
                out.append((doc, start, len(part), zlib.crc32(part.tobytes()), total, first + used, at,
                            part.tobytes() if with_ids else None))
                at += len(part)
            used += 1

        def flush(members):
            for w in deal([len(m[2]) for m in members], capacity):
                put([members[i] for i in w])

        def batch():
            cols = list(zip(*out)) or [()] * len(SCHEMA)
            out.clear()
            types = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=SCHEMA.names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py())
                for start, n in _pieces(ids, capacity, piece):
                    if n == capacity:
                        put([(doc, start, ids[start:start + n], len(ids))])
                        continue
                    while n:
                        cut = min(n, target - held)
                        group.append((doc, start, ids[start:start + cut], len(ids)))
                        held, start, n = held + cut, start + cut, n - cut
                        if held == target:
                            flush(group)
                            group, held = [], 0
                if len(out) >= 5000:
                    yield batch()
        if group:
            flush(group)
        yield batch()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)
