"""Repeated word windows by compressed full-text indexes, one per shard.

A word is removed if a window of SPAN words that covers it also starts anywhere else. Work is split by
content, so that no document meets all others:

1. Anchors. Of the runs of GRAM words in a window, the one with the smallest hash is the window's anchor;
   equal windows have equal anchors. Keys of anchors are counted by Spark (partial sums first), and the keys
   with more than one place are joined back to the documents that hold them.
2. Snippets. At each such anchor a document gives the words whose windows have it. Equal snippets of a task
   settle each other at once; one goes on as their witness.
3. Shards. The snippets of a key meet in one task, and whole keys make a shard of a few megabytes. The
   longest snippet of each key is indexed: a suffix array gives the Burrows-Wheeler transform, a wavelet tree
   with Shannon codes (near the entropy of the words) holds it. All other snippets, none of them in the index,
   are streamed by backward search: where a word does not fit, the match falls back to the enclosing interval
   of common prefixes. That gives the matching statistics: for each word the longest match that starts there.
   From SPAN on, the window is repeated, here and at its places in the index.
4. What matches nothing in a representative is indexed by itself in a second round, and windows that share
   SPAN words there are neighbours in its suffix order. Every pair of equal windows is so met: both streamed
   to one representative, one indexed and one streamed, or both left over.
5. The losses of a document are united and its other words kept.

A key with more than MANY places goes window by window, keyed by the window's content, and a task sends a
window twice at most: a phrase found in a third of all documents gives two rows a task and window, spread over
as many keys as there are contexts.

Defined results: null text has no words. Null and repeated ids are documents each; equal rows (id and text)
lose the same words, as each holds all windows of the other. Documents of fewer than SPAN words keep all. A very
long text is read in pieces that overlap. No documents: no rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtrail.llm.blocks import whole_cells
from voxtrail.llm.common import release, stored

SPAN, GRAM = 35, 8
MANY = 16_384
PIECE = 1 << 22      # bytes of a long text read at once
STRIP = 1 << 22      # bytes hashed at once
SHARD = 3 << 20      # bytes of snippets that make a shard; an index has less than 2**21 symbols
RECALLED = 1 << 20   # windows of frequent keys that a task remembers
NO_DOC = (1 << 63) - 1
LOW = np.uint64((1 << 24) - 1)
GAP = re.compile(rb"[\x20\x09-\x0d]")
_rng = np.random.default_rng(20250311)
_LETTER = _rng.integers(0, 2 ** 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _rng.integers(0, 2 ** 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


# ---- 1: anchors --------------------------------------------------------------------------

def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last."""
    inside = np.concatenate([[False], ~_BLANK[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; it only groups, the words themselves are compared later."""
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    data, own = data[start[0]:], start - start[0]
    at = np.arange(len(data)) - np.repeat(own, np.diff(np.append(own, len(data))))
    value = _LETTER[data] * _PLACE[np.minimum(at, 255)]
    value[_BLANK[data]] = 0
    return np.add.reduceat(value, own) + (end - start).astype(np.uint64)


def anchors(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window and number of windows of each anchor; ``ends``: where each piece's words end."""
    n = len(h) - SPAN + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    width = 1
    for step in _STEPS:
        if width * 2 > GRAM:
            break
        h = h[:-width] * step + h[width:]
        width *= 2
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    need, wide = SPAN - GRAM + 1, 1
    while wide * 2 <= need:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if need > wide:
        least = np.minimum(least[:-(need - wide)], least[need - wide:])
    at = (least[:n] & LOW).astype(np.int64)
    inside = np.ones(n + 1, dtype=bool)
    inside[n] = False
    for e in ends[:-1].tolist():  # windows that cross from one piece to the next
        inside[max(0, e - SPAN + 1):e] = False
    inside = inside[:n]
    first = inside.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    start = np.flatnonzero(first)
    count = np.add.reduceat(inside, start, dtype=np.int64) if len(start) else start
    return (h[at[start]] >> np.uint64(2)).astype(np.int64), start, count


def pieces(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A text, or overlapping parts of a long one, with the number of words before each."""
    at, before, size = 0, 0, PIECE
    while len(text) - at > size:
        gap = GAP.search(text, at + size)
        stop = gap.start() if gap else len(text)
        start, _ = word_bounds(np.frombuffer(text[at:stop], dtype=np.uint8))
        if stop < len(text) and len(start) < SPAN:
            size *= 2  # endless words
            continue
        yield text[at:stop], before
        if stop == len(text):
            return
        at, before, size = at + int(start[1 - SPAN]), before + len(start) - SPAN + 1, PIECE
    yield text[at:], before


def strips(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, and end, row and first word of each piece, a few megabytes at a time."""
    held, rows, offsets, size = [], [], [], 0
    for i, text in enumerate(texts):
        for part, before in pieces(text):
            held.append(part)
            rows.append(i)
            offsets.append(before)
            size += len(part) + 1
            if size >= STRIP:
                yield b"\n".join(held), np.cumsum([len(p) + 1 for p in held]), np.array(rows), np.array(offsets)
                held, rows, offsets, size = [], [], [], 0
    if held:
        yield b"\n".join(held), np.cumsum([len(p) + 1 for p in held]), np.array(rows), np.array(offsets)


def _found(raw: bytes, ends: np.ndarray):
    """Word bounds, words per piece (ends), and the anchors of a strip with their pieces."""
    data = np.frombuffer(raw, dtype=np.uint8)
    start, end = word_bounds(data)
    stops = np.searchsorted(start, ends)
    key, first, count = anchors(word_hashes(data, start, end), stops)
    return start, end, stops, key, first, count, np.searchsorted(stops, first, side="right")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_DOC)).alias("doc_id"),
                       F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw, ends, *_ in strips(b.column(0).cast(pa.binary()).to_pylist()):
            key, n = np.unique(_found(raw, ends)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, th = b.column(0).to_numpy(), b.column(1).to_numpy()
        for raw, ends, rows, _ in strips(b.column(2).cast(pa.binary()).to_pylist()):
            *_, key, _, _, piece = _found(raw, ends)
            row = rows[piece]
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])]) if len(row) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(doc[row[new]]), pa.array(th[row[new]])],
                                             names=["key", "doc_id", "th"])


def repeated_keys(docs: DataFrame) -> DataFrame:
    """doc_id, th, keys: the repeated anchors of each document that has one; -1 - key if over MANY."""
    rows = _rows(docs)
    counts = (rows.select("text").mapInArrow(_counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
              .filter(F.col("n") > 1))
    held = rows.mapInArrow(_held, "key bigint, doc_id bigint, th bigint")
    return (held.hint("merge").join(counts.hint("merge"), "key")  # sizes unknown to Spark; a hot key is split as a skewed join
            .groupBy("doc_id", "th").agg(F.collect_list(F.when(F.col("n") > MANY, -1 - F.col("key")).otherwise(F.col("key"))).alias("keys")))


# ---- 2: snippets -------------------------------------------------------------------------

# A start of -1 marks a row of settled losses: its snippet is pairs of start and windows.
_SNIP = pa.schema([("key", pa.int64()), ("snippet", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()),
                   ("start", pa.int64()), ("twice", pa.bool_())])
_SNIP_SQL = "key bigint, snippet binary, doc_id bigint, th bigint, start bigint, twice boolean"


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _own_key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") >> 1


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    recalled: dict[bytes, bool] = {}  # windows of frequent keys this task has sent: whether as seen twice
    for b in batches:
        doc, th, keys = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)
        texts = [b" ".join(t.split()) for t in b.column(2).cast(pa.binary()).to_pylist()]
        own = [np.sort(keys[i].values.to_numpy()) for i in range(b.num_rows)]
        for raw, ends, rows, offsets in strips(texts):
            start, end, stops, key, first, count, piece = _found(raw, ends)
            before = np.concatenate([[0], stops[:-1]])
            found: list[tuple] = []  # key (none: frequent), snippet, row, first word, windows
            cuts = np.searchsorted(piece, np.arange(len(ends) + 1))
            for p in range(len(ends)):
                r, (low, high) = int(rows[p]), cuts[p:p + 2]
                mine = key[low:high]
                light, heavy = np.isin(mine, own[r]), np.isin(-1 - mine, own[r])
                for i in (low + np.flatnonzero(light | heavy)).tolist():
                    a, c = int(first[i]), int(count[i])
                    place = int(offsets[p] + a - before[p])
                    if heavy[i - low]:
                        for o in range(c):
                            text = raw[start[a + o]:end[a + o + SPAN - 1]]
                            found.append((None, text, r, place + o, 1))
                    else:
                        found.append((int(key[i]), raw[start[a]:end[a + c + SPAN - 2]], r, place, c))
            yield _settled(found, doc, th, recalled)


def _settled(found: list[tuple], doc: list[int], th: list[int], recalled: dict[bytes, bool]) -> pa.RecordBatch:
    """Snippets of a strip; equal ones lose their windows already here, one of them stays as witness."""
    times = Counter(x[1] for x in found)
    out, lost, sent = [], {}, set()

    def lose(r: int, place: int, n: int) -> None:
        gone = lost.setdefault(r, [])
        if gone and sum(gone[-1]) == place:
            place, n = gone[-1][0], gone.pop()[1] + n
        gone.append((place, n))

    for key, text, r, place, n in found:
        own = _digest(text) if key is None else b""
        known = recalled.get(own)
        twice = times[text] > 1 or known is not None
        if twice:
            lose(r, place, n)
        if text in sent or known:
            continue  # its witness went before
        sent.add(text)
        out.append((_own_key(own) if own else key, text, doc[r], th[r], place, twice))
        if own and (known is not None or len(recalled) < RECALLED):
            recalled[own] = twice
    out += [(_own_key(_digest(np.array([doc[r], x[0][0]]).tobytes())), np.array(x, dtype="<i8").tobytes(), doc[r], th[r], -1, False)
            for r, x in lost.items()]
    cols = list(zip(*out)) or [()] * len(_SNIP)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SNIP)], schema=_SNIP)


# ---- 3: the index ------------------------------------------------------------------------

class WaveletTree:
    """Rank of symbols in a sequence; code lengths follow the symbols' frequency (Shannon codes).

    Level l holds one bit for each symbol whose code is longer than l, sorted by the l bits before,
    packed in 64-bit words with a running count a word."""

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        freq = np.bincount(seq)
        by = np.argsort(-freq, kind="stable")
        f = freq[by]
        f, by = f[f > 0], by[f > 0]
        cum = np.cumsum(f) - f
        size = np.maximum(1, np.ceil(np.log2(n / f)).astype(np.int64))
        size += (f << size) < n
        wide = int(size.max())
        left = ((cum << size) // n) << (wide - size)
        self.number = np.zeros(len(freq), dtype=np.int64)  # symbol -> place in the order of codes
        self.number[by] = np.arange(len(by))
        self.size, self.left, self.wide = size, left, wide
        self.words, self.ones, self.start, self.before = [], [], [], []
        s = self.number[seq]
        for level in range(wide):
            count = np.where(size > level, f, 0)
            upto = np.cumsum(count) - count
            prefix = left >> (wide - level)
            head = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            node = np.cumsum(head) - 1
            start = upto[np.flatnonzero(head)][node]
            bit = (left[s] >> (wide - 1 - level)) & 1
            self._pack(bit)
            ones = np.concatenate([[0], np.cumsum(bit)])
            self.start.append(start)
            self.before.append(ones[start])
            # stable partition inside the nodes, without the symbols that end here
            last = np.append(start[np.flatnonzero(head)][1:], len(s))[node]
            a, e = start[s], last[s]
            zeros = (e - a) - (ones[e] - ones[a])
            mine = ones[:-1] - ones[a]
            place = np.where(bit == 1, a + zeros + mine, np.arange(len(s)) - mine)
            moved = np.empty_like(s)
            moved[place] = s
            s = moved[size[moved] > level + 1]

    def _pack(self, bit: np.ndarray) -> None:
        padded = np.zeros((len(bit) // 64 + 1) * 64, dtype=np.uint8)
        padded[:len(bit)] = bit
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.words.append(words)
        self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place beside it."""
        c = self.number[symbol]
        size, left = self.size[c], self.left[c]
        at = upto.copy()
        for level in range(int(size.max(initial=0))):
            p = np.where(size > level, self.start[level][c] + at, 0)
            w = p >> 6
            mask = (np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[level][w] + np.bitwise_count(self.words[level][w] & mask) - self.before[level][c]
            nxt = np.where((left >> (self.wide - 1 - level)) & 1 == 1, ones, at - ones)
            at = np.where(size > level, nxt, at)
        return at

    def bytes(self) -> int:
        return sum(x.nbytes for part in (self.words, self.ones) for x in part)


class FMIndex:
    """Index of snippets of words (numbers from 1), each ended by 0.

    Suffixes are compared up to their snippet's end, then by place. ``common`` holds the words that
    neighbours in suffix order share, SPAN at most; ``group`` numbers the suffixes that share SPAN words."""

    def __init__(self, sym: np.ndarray):
        n = len(sym)
        ends = np.flatnonzero(sym == 0)
        left = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(n)
        order, ranks = _suffixes(sym, left)
        self.n, self.order = n, order
        count = np.bincount(sym)
        self.first = np.cumsum(count) - count
        self.tree = WaveletTree(sym[order - 1])
        self.common = np.full(n + 1, -1, dtype=np.int64)
        self.common[1:n] = np.minimum(_shared(sym, ranks, left, order[:-1], order[1:]), SPAN)
        self.group = np.cumsum(self.common[:n] < SPAN) - 1
        self._enclosing()

    def _enclosing(self) -> None:
        """For each border between suffixes, the nearest borders with less in common on either side."""
        n, common = self.n, self.common
        at = np.arange(n + 1)
        self.below, self.above = np.zeros(n + 1, dtype=np.int64), np.full(n + 1, n, dtype=np.int64)
        for d in np.unique(common[common >= 0]).tolist():
            mine = np.flatnonzero(common == d)
            less = at[common < d]
            k = np.searchsorted(less, mine)
            self.below[mine], self.above[mine] = less[k - 1], less[k]

    def matches(self, pattern: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streams pattern[start:end] (words; below 1: unknown to the index).

        For each place the length of the longest match that starts there and stays in its stream (SPAN at
        most), and the rank of a suffix that has it. All streams go backwards side by side."""
        length, rank = np.zeros(len(pattern), dtype=np.int64), np.zeros(len(pattern), dtype=np.int64)
        p, low, high = end - 1, np.zeros(len(end), dtype=np.int64), np.full(len(end), self.n)
        size, begin = np.zeros(len(end), dtype=np.int64), start.copy()
        known = len(self.first)
        while True:
            on = p >= begin
            if not on.all():
                p, low, high, size, begin = p[on], low[on], high[on], size[on], begin[on]
            if not len(p):
                return length, rank
            c = pattern[p]
            fits = (c > 0) & (c < known)
            s = np.where(fits, c, 0)
            both = self.tree.rank(np.concatenate([s, s]), np.concatenate([low, high]))
            a, e = self.first[s] + both[:len(s)], self.first[s] + both[len(s):]
            go = fits & (e > a)
            back = fits & ~go
            # the enclosing interval: words in common at its nearer border
            d = np.maximum(self.common[low], self.common[high])
            out_low = np.where(self.common[low] == d, self.below[low], low)
            out_high = np.where(self.common[high] == d, self.above[high], high)
            low = np.where(go, a, np.where(back, out_low, 0))
            high = np.where(go, e, np.where(back, out_high, self.n))
            size = np.where(go, np.minimum(size + 1, SPAN), np.where(back, np.minimum(d, size), 0))
            length[p[go]], rank[p[go]] = size[go], low[go]
            p = p - ~back


def _suffixes(sym: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix order by doubling, and the ranks by the first 2, 4, 8 ... words."""
    n = len(sym)
    at = np.arange(n)
    nxt = np.append(sym[1:], 0)
    key = sym * (int(sym.max()) + 1) + np.where(left > 0, nxt, 0)
    reach, ranks = 2, []
    while True:
        packed = np.sort(key << 21 | at)
        order, head = packed & ((1 << 21) - 1), packed >> 21
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], head[1:] != head[:-1]]))
        ranks.append((reach, rank))
        if reach > left.max():
            return order, ranks
        second = np.zeros(n, dtype=np.int64)
        second[:n - reach] = rank[reach:] + 1
        key = rank << 21 | np.where(left >= reach, second, 0)
        reach *= 2


def _shared(sym: np.ndarray, ranks: list[tuple[int, np.ndarray]], left: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that the suffixes at i and j have in common, up to the end of either snippet."""
    limit = np.minimum(left[i], left[j])
    got = np.zeros(len(i), dtype=np.int64)
    top = len(sym) - 1
    for reach, rank in [*ranks[::-1], (1, sym)]:
        same = rank[np.minimum(i + got, top)] == rank[np.minimum(j + got, top)]
        got += np.where(same & (got < limit), reach, 0)
    return np.minimum(got, limit)


def repeated(words: np.ndarray, start: np.ndarray, size: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """For each word of the snippets: does its window of SPAN words stand in another snippet of its cell?

    ``words``: word numbers from 1; snippet s is words[start[s]:start[s] + size[s]]."""
    out = np.zeros(len(words), dtype=bool)
    order = np.lexsort((-size, cell))
    lead = order[np.concatenate([[True], cell[order][1:] != cell[order][:-1]])]
    streamed = np.setdiff1d(np.arange(len(start)), lead)
    if not len(streamed):
        return out
    sym, place = _laid(words, start[lead], size[lead])
    sym, pattern = _dense(sym, words)
    index = FMIndex(sym)
    length, rank = index.matches(pattern, start[streamed], start[streamed] + size[streamed])
    hit = length >= SPAN
    out |= hit
    marked = np.zeros(index.n, dtype=bool)
    marked[index.group[rank[hit]]] = True
    back = index.order[marked[index.group]]
    out[place[back]] = True
    # what matched no representative: windows of the streamed snippets that are left
    window = np.zeros(len(words) + 1, dtype=bool)
    some = np.repeat(start[streamed], np.maximum(0, size[streamed] - SPAN + 1))
    window[some + _counting(np.maximum(0, size[streamed] - SPAN + 1))] = True
    window[:-1] &= ~hit
    new = window[:-1] & ~np.concatenate([[False], window[:-2]])
    new[start[streamed]] = window[start[streamed]]  # a window does not go on into the next snippet
    begin = np.flatnonzero(new)
    if len(begin) > 1:
        runs = np.add.reduceat(window[:-1], begin, dtype=np.int64)
        sym, place = _laid(words, begin, runs + SPAN - 1)
        sym, _ = _dense(sym, sym[:0])
        index = FMIndex(sym)
        members = np.bincount(index.group)
        left = index.order[(members[index.group] > 1)]
        out[place[left]] = True
    return out


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... sizes[0] - 1, 0, 1, ... sizes[1] - 1, ..."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _laid(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Snippets end to end, each ended by 0, and where each word came from."""
    step = _counting(size + 1)
    place = np.minimum(np.repeat(start, size + 1) + step, len(words) - 1)
    return np.where(step < np.repeat(size, size + 1), words[place], 0), place


def _dense(sym: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words numbered anew from 1 by the index; 0 in the pattern for words it lacks."""
    used = np.bincount(sym, minlength=int(pattern.max(initial=0)) + 1) > 0
    used[0] = True
    number = np.where(used, np.cumsum(used) - 1, 0)
    return number[sym], number[pattern]


_MARK = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of repeated windows, from sorted snippets of whole keys, a shard at a time."""
    held, size = [], 0
    for t, ends in whole_cells(batches, ["key"]):
        lost = t.column("start").to_numpy() < 0
        if lost.any():
            yield _unpacked(t.filter(pa.array(lost)))
            t, ends = t.filter(pa.array(~lost)), np.cumsum(~lost)[ends - 1][~lost]
        if not t.num_rows:
            continue
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in t.column("snippet").to_pylist()])])
        start = 0
        while start < t.num_rows:
            end = int(ends[start])
            while end < t.num_rows and size + offsets[ends[end]] - offsets[start] <= SHARD:
                end = int(ends[end])
            if held and size + offsets[end] - offsets[start] > SHARD:
                yield _shard(pa.concat_tables(held))
                held, size = [], 0
            held.append(t.slice(start, end - start))
            size += int(offsets[end] - offsets[start])
            start = end
    if held:
        yield _shard(pa.concat_tables(held))


def _unpacked(t: pa.Table) -> pa.RecordBatch:
    marks = [np.frombuffer(x.as_py(), dtype="<i8").reshape(-1, 2) for x in t.column("snippet")]
    n = [len(m) for m in marks]
    every = np.concatenate(marks)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(t.column("doc_id").to_numpy(), n)), pa.array(np.repeat(t.column("th").to_numpy(), n)),
         pa.array(every[:, 0]), pa.array(every[:, 1])], schema=_MARK)


def _shard(t: pa.Table) -> pa.RecordBatch:
    """Repeated windows of whole keys: equal snippets by count, different ones by the index."""
    key = t.column("key").to_numpy()
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(x, len(number)) for x in t.column("snippet").to_pylist()], dtype=np.int64)
    snippets = list(number)
    often = (np.bincount(of) > 1) | (np.bincount(of, weights=t.column("twice").to_numpy(zero_copy_only=False)) > 0)
    cell = np.empty(len(snippets), dtype=np.int64)
    cell[of] = np.unique(key, return_inverse=True)[1]
    size = np.array([s.count(b" ") + 1 for s in snippets], dtype=np.int64)
    start = np.cumsum(size) - size
    flag = np.repeat(often, size)
    several = np.flatnonzero(np.bincount(cell)[cell] > 1)  # snippets of a key that has different ones
    if len(several):
        coded = pa.array(b" ".join([snippets[i] for i in several.tolist()]).split(b" "), pa.binary()).dictionary_encode()
        own = size[several]
        at = np.cumsum(own) - own
        found = repeated(coded.indices.to_numpy().astype(np.int64) + 1, at, own, cell[several])
        flag[np.repeat(start[several], own) + _counting(own)] |= found
    windows = np.maximum(0, size - SPAN + 1)[of]
    row = np.repeat(np.arange(len(of)), windows)
    step = _counting(windows)
    lost = flag[start[of][row] + step]
    new = lost.copy()
    new[1:] &= ~lost[:-1] | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    n = np.add.reduceat(lost, head, dtype=np.int64) if len(head) else head
    r = row[head]
    return pa.RecordBatch.from_arrays(
        [pa.array(t.column("doc_id").to_numpy()[r]), pa.array(t.column("th").to_numpy()[r]),
         pa.array(t.column("start").to_numpy()[r] + step[head]), pa.array(n)], schema=_MARK)


# ---- 5: cutting --------------------------------------------------------------------------

def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, n_words, n_removed = [], [], []
        for text, marks in zip(b.column(1).cast(pa.binary()), b.column(2)):
            words = text.as_py().split()
            gone = 0
            if marks.is_valid:
                begin = marks.values.field("start").to_numpy()
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edges, begin, 1)
                np.add.at(edges, begin + marks.values.field("windows").to_numpy() + SPAN - 1, -1)
                stay = np.cumsum(edges[:-1]) == 0
                gone = len(words) - int(stay.sum())
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stay).tolist()]))
            else:
                kept.append(b" ".join(words))
            n_words.append(len(words))
            n_removed.append(gone)
        ids = b.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=ids == NO_DOC), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, th, start, windows: stretches of repeated windows of each document of (doc_id, text hash)."""
    keys = stored(repeated_keys(docs), "repeated-keys")
    release(docs.sparkSession)
    snippets = (_rows(docs).join(keys.hint("merge"), ["doc_id", "th"]).select("doc_id", "th", "text", "keys")
                .mapInArrow(_snippets, _SNIP_SQL))
    return (snippets.repartition("key").sortWithinPartitions("key")
            .mapInArrow(_judged, "doc_id bigint, th bigint, start bigint, windows bigint"))


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by blanks): one row per document."""
    marks = stored(repeats(docs).groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("start", "windows")).alias("marks")), "losses")  # a document's own
    release(docs.sparkSession)
    return (_rows(docs).join(marks, ["doc_id", "th"], "left").select("doc_id", "text", "marks")
            .mapInArrow(_cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string"))
