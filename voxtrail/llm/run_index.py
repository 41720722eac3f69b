"""Long repeats across documents by a run-length compressed index.

A byte is removed if a string of SPAN bytes that covers it also starts in a document with a
smaller id. The work is split by content, so that no document meets all others:

1. Anchors. Of the 35 16-byte strings in a window of 50 bytes, the one with the smallest hash
   is its anchor; equal windows have equal anchors. Tasks send their anchors' keys, dealt by key
   range and packed as bytes, and learn which keys lie in more than one document. Keys that a task
   has seen in two documents itself are settled at once; of those it sends one witness.
2. Snippets. Around each repeated anchor, a document gives the stretch of text whose windows
   have that anchor. Equal snippets of a task are one; only the smallest document's goes on.
3. Index. Snippets of a key meet in one task, which builds an index of a few hundred kilobytes at
   a time: the Burrows-Wheeler transform of all snippets in runs, with the suffix positions
   at the runs' ends. Each snippet is streamed through it backwards (LF steps over the runs), giving
   for every place the rank of its suffix and the length matched so far. Where that reaches SPAN, the
   suffixes that share SPAN bytes are neighbours; the smallest document among them owns the
   string, and every other document loses it.
4. The losses of a document are united and cut out of its bytes.

A key with more than MANY occurrences goes window by window (each string its own key), so that its
text is dealt by content before the shuffle. Occurrences are counted over all strips, settled keys
included: every document that has the key in a strip, or each place if it has more than OFTEN there.
Equal windows of a bucket are one, so the largest group of a window grows with the buckets (one row
for BUCKET bytes of texts), besides the places in the smallest document of each.

Defined results: null text is empty and keeps nothing to remove. A null id counts as the largest,
and documents of one id remove nothing from each other; repeated rows are returned each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from voxtrail.llm.blocks import whole_cells
from voxtrail.llm.common import release, stored

SPAN, KMER = 50, 16
MANY = 16_384
OFTEN = 16           # places of a key in a document from which all are counted
PIECE = 1 << 22      # bytes of a long document taken at once
STRIP = 1 << 23      # bytes hashed at once; a strip has less than 2**24
INDEX = 1 << 20      # bytes of snippets that make an index; it has less than 2**21
RANGE = 400_000      # anchors of a key range
BUCKET = 1 << 22     # bytes of texts that one task opens at once
NO_DOC = (1 << 63) - 1
LOW = np.uint64((1 << 24) - 1)
_rng = np.random.default_rng(20240929)
_TABLE = _rng.integers(0, 2 ** 63, 256, dtype=np.uint64)
_STEPS = _rng.integers(0, 2 ** 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window and number of windows of each anchor in pieces laid end to end."""
    h = _TABLE[data]
    for k, step in enumerate(_STEPS):
        h = h[:-1 << k] * step + h[1 << k:] if len(h) > 1 << k else h[:0]
    n = len(data) - SPAN + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    m = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    wide = 1
    while wide * 2 <= SPAN - KMER + 1:
        m = np.minimum(m[:-wide], m[wide:])
        wide *= 2
    rest = SPAN - KMER + 1 - wide
    m = np.minimum(m[:len(m) - rest], m[rest:]) if rest else m
    at = (m[:n] & LOW).astype(np.int64)
    whole = np.ones(n, dtype=bool)  # windows inside one piece
    for e in ends[:-1].tolist():
        whole[max(0, e - SPAN + 1):e] = False
    first = whole.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~whole[:-1]
    start = np.flatnonzero(first)
    count = np.add.reduceat(whole, start, dtype=np.int64) if len(start) else start
    return (h[at[start]] >> np.uint64(16)).astype(np.int64), start, count


def strips(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, piece ends, and row and offset of each piece; long texts are cut with an overlap."""
    held, rows, offsets, size = [], [], [], 0
    for i, text in enumerate(texts):
        for off in range(0, max(1, len(text) - SPAN + 1), PIECE):
            part = text[off:off + PIECE + SPAN - 1]
            held.append(part)
            rows.append(i)
            offsets.append(off)
            size += len(part)
            if size >= STRIP or len(held) >= 60_000:
                yield _strip(held, rows, offsets)
                held, rows, offsets, size = [], [], [], 0
    if size:
        yield _strip(held, rows, offsets)


def _strip(held, rows, offsets):
    ends = np.cumsum([len(p) for p in held])
    return np.frombuffer(b"".join(held), dtype=np.uint8), ends, np.array(rows), np.array(offsets)


def _six(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


# ---- 1: which anchors lie in more than one document --------------------------------------

_SENT = "slot int, strip bigint, docs binary, rows binary, counts binary, keys binary, seen binary, n_seen binary"
_SENT_SCHEMA = pa.schema([("slot", pa.int32()), ("strip", pa.int64()),
                          *[(c, pa.binary()) for c in ("docs", "rows", "counts", "keys", "seen", "n_seen")]])
_KNOWN = "strip bigint, docs binary, rows binary, counts binary, keys binary, heavy binary, hot binary"
_KNOWN_SCHEMA = pa.schema([("strip", pa.int64()), *[(c, pa.binary()) for c in ("docs", "rows", "counts", "keys", "heavy", "hot")]])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _send(ranges: int):
    """Packed keys by range; documents are numbered inside their strip (16 bits).

    One row of a strip, dealt anywhere, holds what needs no question: its documents (id, text hash)
    and its settled keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = TaskContext.get().partitionId() << 32
        for b in batches:
            docs = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            for data, ends, rows, _ in strips(b.column(2).to_pylist()):
                key, start, _ = anchors(data, ends)
                own = np.unique(rows)
                row = np.searchsorted(own, rows)[np.searchsorted(ends, start, side="right")]
                both, places = np.unique(key.astype(np.uint64) << np.uint64(16) | row.astype(np.uint64), return_counts=True)
                key, row = (both >> np.uint64(16)).astype(np.int64), (both & np.uint64(0xFFFF)).astype(np.int64)
                new = np.ones(len(key), dtype=bool)
                new[1:] = key[1:] != key[:-1]
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(key)))
                many = np.repeat(n > 1, n)  # in two documents of this strip: settled
                places = np.add.reduceat(np.where(places > OFTEN, places, 1), at) if len(at) else n
                # a key of one document only is a witness too if it is frequent there, for all places but one
                witnesses = (n > 1) | (places > 1)
                seen, n_seen = key[at][witnesses], (places - (n == 1))[witnesses]
                by_seen, by_open = _split(seen % ranges, ranges), _split(key[~many] % ranges, ranges)
                out = [(strip % ranges, strip, docs[own].tobytes(), *_packed(row[many], key[many]), b"", b"")]
                for r in range(ranges):
                    mine, witness = by_open(r), by_seen(r)
                    if len(mine) or len(witness):
                        out.append((r, strip, b"", *_packed(row[~many][mine], key[~many][mine]),
                                    _six(seen[witness]), n_seen[witness].astype("<u4").tobytes()))
                strip += 1
                yield _batch(out, _SENT_SCHEMA)

    return run


def _split(slot: np.ndarray, n: int):
    """Members of each slot, by one sort."""
    order = np.argsort(slot, kind="stable")
    cuts = np.searchsorted(slot[order], np.arange(n + 1))
    return lambda r: order[cuts[r]:cuts[r + 1]]


def _packed(row: np.ndarray, key: np.ndarray) -> tuple[bytes, bytes, bytes]:
    order = np.argsort(row, kind="stable")
    rows, counts = np.unique(row, return_counts=True)
    return rows.astype("<u2").tobytes(), counts.astype("<u4").tobytes(), _six(key[order])


def _rows_of(table: pa.Table, i: int) -> np.ndarray:
    return np.repeat(np.frombuffer(table.column("rows")[i].as_py(), dtype="<u2").astype(np.int64),
                     np.frombuffer(table.column("counts")[i].as_py(), dtype="<u4"))


def _decide(table: pa.Table) -> pa.Table:
    """Of the packed keys of a range, those in more than one document; heavy: in more than MANY.

    The range alone counts all strips, so it also tells those that settled a key which are heavy (``hot``)."""
    settled = np.array([len(x.as_py()) > 0 for x in table.column("docs")])
    out = [(*[table.column(c)[i].as_py() for c in ("strip", "docs", "rows", "counts", "keys")],
            bytes(len(table.column("keys")[i].as_py()) // 6), b"") for i in np.flatnonzero(settled).tolist()]
    table = table.filter(pa.array(~settled))
    if not table.num_rows:
        return pa.Table.from_batches([_batch(out, _KNOWN_SCHEMA)])
    keys = [_from_six(x.as_py()) for x in table.column("keys")]
    witness = [_from_six(x.as_py()) for x in table.column("seen")]
    seen = np.concatenate(witness)
    weight = np.concatenate([np.frombuffer(x.as_py(), dtype="<u4") for x in table.column("n_seen")])
    every = np.concatenate([seen, *keys])
    total = np.empty(0, dtype=np.int64)
    if len(every):
        distinct, where = np.unique(every, return_inverse=True)
        weights = np.concatenate([weight, np.ones(len(every) - len(seen))])
        total = np.bincount(where, weights=weights)[where].astype(np.int64)
    at, before = len(seen), 0
    for i, (own, settled) in enumerate(zip(keys, witness)):
        n = total[at:at + len(own)]
        at += len(own)
        keep = n > 1
        hot = settled[total[before:before + len(settled)] > MANY]
        before += len(settled)
        if keep.any() or len(hot):
            row = _rows_of(table, i)[keep]
            out.append((table.column("strip")[i].as_py(), b"", *_packed(row, own[keep]),
                        (n > MANY)[keep][np.argsort(row, kind="stable")].tobytes(), _six(hot)))
    return pa.Table.from_batches([_batch(out, _KNOWN_SCHEMA)])


def _gather(table: pa.Table) -> pa.Table:
    """Repeated keys of the documents of a strip: one row per document."""
    docs = np.frombuffer(b"".join(x.as_py() for x in table.column("docs")), dtype=np.int64).reshape(-1, 2)
    row = np.concatenate([_rows_of(table, i) for i in range(table.num_rows)])
    keys = np.concatenate([_from_six(x.as_py()) for x in table.column("keys")])
    heavy = np.concatenate([np.frombuffer(x.as_py(), dtype=bool) for x in table.column("heavy")])
    hot = _from_six(b"".join(x.as_py() for x in table.column("hot")))
    heavy = heavy | np.isin(keys, hot) if len(hot) else heavy
    order = np.argsort(row, kind="stable")
    row, keys, heavy = row[order], keys[order], heavy[order]
    cuts = np.searchsorted(row, np.arange(len(docs) + 1))
    out = [(int(docs[i, 0]), int(docs[i, 1]), _six(keys[a:e][~heavy[a:e]]), _six(keys[a:e][heavy[a:e]]))
           for i, (a, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if e > a]
    return pa.Table.from_batches([_batch(out, pa.schema(
        [("doc_id", pa.int64()), ("th", pa.int64()), ("keys", pa.binary()), ("heavy", pa.binary())]))])


# ---- texts in packed buckets: two steps need them, next to what is known of their documents ----

_PACKED = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])


def _pack(buckets: int):
    """Documents of a batch by bucket, each bucket one compressed value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            doc, th, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            members = _split(_bucket(doc, th, buckets), buckets)
            out = []
            for k in range(buckets):
                at = members(k)
                if len(at):
                    part = [texts[i] for i in at.tolist()]
                    head = np.stack([doc[at], th[at], [len(x) for x in part]]).astype("<i8")
                    out.append((k, press.compress(np.int64(len(at)).tobytes() + head.tobytes() + b"".join(part))))
            yield _batch(out, _PACKED)

    return run


def _bucket(doc: np.ndarray, th: np.ndarray, buckets: int) -> np.ndarray:
    h = (doc.astype(np.uint64) ^ (th.astype(np.uint64) << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _unpacked(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """doc_id, th and texts of each blob."""
    for blob in table.column("blob"):
        raw = zstandard.ZstdDecompressor().decompress(blob.as_py())
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        head = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(3, n)
        ends = np.cumsum(head[2]) + 8 + 24 * n
        yield head[0], head[1], [raw[e - k:e] for e, k in zip(ends.tolist(), head[2].tolist())]


# ---- 2: snippets around repeated anchors -------------------------------------------------

# A start of -1 marks a row of settled losses: its snippet is pairs of start and windows.
_SNIP = pa.schema([("key", pa.int64()), ("snippet", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()),
                   ("start", pa.int64())])


def _snippets(texts: pa.Table, known: pa.Table) -> pa.Table:
    """Snippets of a bucket's documents at their repeated keys."""
    keys_of = {(d, t): (b"".join(k), b"".join(h)) for d, t, k, h in zip(
        *[known.column(c).to_pylist() for c in ("doc_id", "th", "keys", "heavy")])}
    batches = [_SNIP.empty_table()]
    for doc, th, own in _unpacked(texts):
        mine = [keys_of.get(x, (b"", b"")) for x in zip(doc.tolist(), th.tolist())]
        at = [i for i, (k, h) in enumerate(mine) if k or h]
        for some in (at[i:i + 30_000] for i in range(0, len(at), 30_000)):
            batches += [pa.Table.from_batches([x]) for x in _around(
                doc[some], th[some], [own[i] for i in some], [mine[i] for i in some])]
    return pa.concat_tables(batches)


def _around(doc: np.ndarray, th: np.ndarray, texts: list[bytes], keys: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    listed = []
    for c in (0, 1):
        one = [_from_six(k[c]) for k in keys]
        listed.append(_pairs(np.repeat(np.arange(len(one)), [len(k) for k in one]), np.concatenate(one)))
    for data, ends, rows, offsets in strips(texts):
        key, start, count = anchors(data, ends)
        piece = np.searchsorted(ends, start, side="right")
        row = rows[piece]
        mine = _pairs(row, key)
        heavy = np.isin(mine, listed[1]) if len(listed[1]) else np.zeros(len(mine), dtype=bool)
        keep = np.isin(mine, listed[0]) | heavy
        begin = np.concatenate([[0], ends[:-1]])[piece]
        raw = data.tobytes()
        doc_of, th_of = doc.tolist(), th.tolist()
        found: list[tuple] = []  # key, snippet, row, start
        for i in np.flatnonzero(keep).tolist():
            a, c, r = int(start[i]), int(count[i]), int(row[i])
            place = int(offsets[piece[i]] + a - begin[i])
            if heavy[i]:
                found += [(-1, raw[a + o:a + o + SPAN], r, place + o) for o in range(c)]
            else:
                found.append((int(key[i]), raw[a:a + c + SPAN - 1], r, place))
        best: dict[bytes, int] = {}
        for _, text, r, _ in found:
            if best.get(text, NO_DOC + 1) > doc_of[r]:
                best[text] = doc_of[r]
        # a copy in a larger document loses all its windows already here
        out, lost = [], {}
        for k, text, r, place in found:
            if best[text] < doc_of[r]:
                gone, n = lost.setdefault(r, []), len(text) - SPAN + 1
                if gone and sum(gone[-1]) == place:
                    place, n = gone[-1][0], gone.pop()[1] + n
                gone.append((place, n))
            else:
                out.append((_own_key(text) if k < 0 else k, text, doc_of[r], th_of[r], place))
        out += [(hash((doc_of[r], x[0][0])) >> 1, np.array(x, dtype="<i8").tobytes(), doc_of[r], th_of[r], -1) for r, x in lost.items()]
        yield _batch(out, _SNIP)


def _pairs(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    return key | (row.astype(np.int64) & 0x7FFF) << 48


def _own_key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=6).digest(), "little")


# ---- 3: the index ------------------------------------------------------------------------

class RunIndex:
    """Run-compressed Burrows-Wheeler transform of snippets, with suffix positions at run ends.

    Symbols are bytes + 1; 0 ends a snippet. Suffixes are compared up to their snippet's end, then
    by place. ``docs`` is the smallest document of each snippet."""

    def __init__(self, snippets: list[bytes], docs: np.ndarray):
        sizes = np.array([len(s) + 1 for s in snippets])
        self.ends = np.cumsum(sizes) - 1
        self.sizes = sizes - 1
        sym = np.frombuffer(b"\0".join(snippets) + b"\0", dtype=np.uint8).astype(np.int64) + 1
        sym[self.ends] = 0
        n = len(sym)
        at = np.arange(n)
        left = np.repeat(self.ends, sizes) - at  # symbols before the snippet's end
        order, rank, reach = self._sorted(sym, left)
        self.docs = docs
        # the transform in runs
        bwt = sym[order - 1]
        new = np.ones(n, dtype=bool)
        new[1:] = bwt[1:] != bwt[:-1]
        self.run = np.flatnonzero(new)
        self.symbol = bwt[self.run]
        length = np.diff(np.append(self.run, n))
        self.run_end = order[np.append(self.run[1:], n) - 1]  # sampled suffix positions
        by = np.argsort(self.symbol, kind="stable")
        before = np.cumsum(length[by]) - length[by]  # smaller symbols, then the same symbol in earlier runs
        self.shift = np.empty(len(by), dtype=np.int64)
        self.shift[by] = before - self.run[by]
        # suffixes that share SPAN bytes are neighbours; each such interval has its smallest document
        long = left[order] >= SPAN
        head = rank[order]
        tail = rank[np.minimum(order + SPAN - reach, n - 1)]
        new = np.ones(n, dtype=bool)
        new[1:] = ~(long[1:] & long[:-1] & (head[1:] == head[:-1]) & (tail[1:] == tail[:-1]))
        self.interval = np.flatnonzero(new)
        self.owner = np.minimum.reduceat(np.repeat(docs, sizes)[order], self.interval)

    @staticmethod
    def _sorted(sym: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Suffix order by doubling, and the ranks by their first ``reach`` symbols, half of SPAN at least."""
        n = len(sym)
        at = np.arange(n)
        code = np.cumsum(np.bincount(sym, minlength=257) > 0)[sym] - 1  # the symbols that occur, 0 the end
        bits = max(1, int(code.max()).bit_length())
        first = next(q for q in (7, 6, 5, 4) if q * bits <= 42)
        key = code.copy()
        live = sym > 0
        for i in range(1, first):
            nxt = np.zeros(n, dtype=np.int64)
            nxt[:n - i] = code[i:]
            key = key << bits | np.where(live, nxt, 0)
            live &= nxt > 0
        reach = first
        while True:
            packed = np.sort(key << 21 | at)
            order = packed & ((1 << 21) - 1)
            head = packed >> 21
            new = np.ones(n, dtype=np.int64)
            new[0] = 0
            new[1:] = head[1:] != head[:-1]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new)
            if SPAN <= 2 * reach <= 2 * SPAN:
                kept = rank, reach
            if reach > left.max():
                return order, *kept
            second = np.zeros(n, dtype=np.int64)
            second[:n - reach] = rank[reach:] + 1
            key = rank << 21 | np.where(left >= reach, second, 0)
            reach *= 2

    def owners(self) -> np.ndarray:
        """Streams every snippet backwards; the owner of the SPAN bytes at each place, one after another."""
        out = np.full(int(self.ends[-1]) + 1, NO_DOC)
        p = np.arange(len(self.ends))  # ends sort first, by place
        matched, place = 0, self.ends.copy()
        live = np.arange(len(self.ends))
        # which run and which interval a rank lies in, written out for the time of the stream
        n = len(out)
        run_of = np.repeat(np.arange(len(self.run), dtype=np.int32), np.diff(np.append(self.run, n)))
        owner_of = np.repeat(self.owner, np.diff(np.append(self.interval, n)))
        while len(live):
            run = run_of[p]
            go = self.symbol[run] > 0
            p, live = (p + self.shift[run])[go], live[go]
            matched += 1
            if matched >= SPAN:
                out[place[live] - matched] = owner_of[p]
        return out


_MARK = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("windows", pa.int32())])


def _losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of windows that a document loses, from sorted snippets of whole keys."""
    held, size = [], 0
    for t, ends in whole_cells(batches, ["key"]):
        lost = t.column("start").to_numpy() < 0
        if lost.any():
            yield from _settled(t.filter(pa.array(lost)))
            t, ends = t.filter(pa.array(~lost)), np.cumsum(~lost)[ends - 1][~lost]
        sums = np.concatenate([[0], np.cumsum(_sizes(t) + 1)])
        start = 0
        while start < t.num_rows:
            end = int(ends[start])
            while end < t.num_rows and size + sums[ends[end]] - sums[start] <= INDEX:
                end = int(ends[end])
            if held and size + sums[end] - sums[start] > INDEX:
                yield from _index(pa.concat_tables(held))
                held, size = [], 0
            held.append(t.slice(start, end - start))
            size += int(sums[end] - sums[start])
            start = end
    if held:
        yield from _index(pa.concat_tables(held))


def _sizes(t: pa.Table) -> np.ndarray:
    return pc.binary_length(t.column("snippet")).to_numpy().astype(np.int64)


def _settled(t: pa.Table) -> Iterator[pa.RecordBatch]:
    marks = [np.frombuffer(x.as_py(), dtype="<i8").reshape(-1, 2) for x in t.column("snippet")]
    n = [len(m) for m in marks]
    every = np.concatenate(marks)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.repeat(t.column("doc_id").to_numpy(), n)), pa.array(np.repeat(t.column("th").to_numpy(), n)),
        pa.array(every[:, 0]), pa.array(every[:, 1].astype(np.int32))], schema=_MARK)


def _index(t: pa.Table) -> Iterator[pa.RecordBatch]:
    text = t.column("snippet").to_pylist()
    doc = t.column("doc_id").to_numpy()
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(s, len(number)) for s in text], dtype=np.int64)
    if sum(map(len, number)) + len(number) >= 1 << 21:
        yield from _by_window(t)
        return
    least = np.full(len(number), NO_DOC)
    np.minimum.at(least, of, doc)
    index = RunIndex(list(number), least)
    owner = index.owners()
    count = index.sizes[of] - SPAN + 1
    first = index.ends[of] - index.sizes[of]
    row = np.repeat(np.arange(len(of)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    lost = owner[first[row] + step] < doc[row]
    new = lost.copy()
    new[1:] &= ~lost[:-1] | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return
    n = np.add.reduceat(lost, at, dtype=np.int64)
    r = row[at]
    yield pa.RecordBatch.from_arrays([
        pa.array(doc[r]), pa.array(t.column("th").to_numpy()[r]), pa.array(t.column("start").to_numpy()[r] + step[at]),
        pa.array(n.astype(np.int32))], schema=_MARK)


def _by_window(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """A key whose snippets exceed an index: its windows apart, in parts by their content."""
    parts: dict[int, list[tuple]] = {}
    n = int((_sizes(t) - SPAN + 1).sum()) * (SPAN + 1) // INDEX + 1
    for text, doc, th, start in zip(*[t.column(c).to_pylist() for c in ("snippet", "doc_id", "th", "start")]):
        for o in range(len(text) - SPAN + 1):
            own = text[o:o + SPAN]
            parts.setdefault(_own_key(own) % n, []).append((0, own, doc, th, start + o))
    for rows in parts.values():
        yield from _index(pa.Table.from_batches([_batch(rows, _SNIP)]))


# ---- 4: cutting ---------------------------------------------------------------------------

def spans(starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Maximal removed runs (begin, end) of stretches of windows."""
    order = np.argsort(starts, kind="stable")
    a, e = starts[order], np.maximum.accumulate(starts[order] + windows[order] + SPAN - 1)
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] > e[:-1]
    at = np.flatnonzero(new)
    return np.stack([a[at], e[np.append(at[1:], len(a)) - 1]], axis=1) if len(a) else np.empty((0, 2), np.int64)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(texts: pa.Table, losses: pa.Table) -> pa.Table:
    """A bucket's documents without what they lose."""
    of = {}
    for d, t, m in zip(losses.column("doc_id").to_pylist(), losses.column("th").to_pylist(), losses.column("marks")):
        of[d, t] = spans(m.values.field("start").to_numpy(), m.values.field("windows").to_numpy())
    batches = [_KEPT.empty_table()]
    for doc, th, own in _unpacked(texts):
        out = []
        for d, t, text in zip(doc.tolist(), th.tolist(), own):
            runs, at, parts = of.get((d, t), np.empty((0, 2), np.int64)), 0, []
            for s, e in runs.tolist():
                parts.append(text[at:s])
                at = e
            parts.append(text[at:])
            out.append((None if d == NO_DOC else d, len(text), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), b"".join(parts)))
        batches.append(pa.Table.from_batches([_batch(out, _KEPT)]))
    return pa.concat_tables(batches)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, th, start, windows: stretches of windows that each document of (doc_id, text) loses.

    ``th`` is the hash of the text; a null id is NO_DOC."""
    total = _bytes(docs)
    sent = _rows(docs).mapInArrow(_send(total // (18 * RANGE) + 1), _SENT)
    mine = stored(_known(sent), "repeated-anchors")
    release(docs.sparkSession)
    snippets = _beside(docs, mine, total, _snippets, "key bigint, snippet binary, doc_id bigint, th bigint, start bigint")
    return (snippets.repartition("key").sortWithinPartitions("key", "doc_id")
            .mapInArrow(_losses, "doc_id bigint, th bigint, start bigint, windows int"))


def _bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number


def _beside(docs: DataFrame, facts: DataFrame, total: int, work, schema: str) -> DataFrame:
    """``work(texts, facts)`` per bucket of documents; ``facts`` has doc_id and th."""
    buckets = total // BUCKET + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = _bucket(b.column(0).to_numpy(), b.column(1).to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k)], names=[*b.schema.names, "bucket"])

    texts = _rows(docs).mapInArrow(_pack(buckets), "bucket bigint, blob binary")
    placed = facts.mapInArrow(place, T.StructType([*facts.schema.fields, T.StructField("bucket", T.LongType())]))
    return texts.groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInArrow(work, schema)


def _known(sent: DataFrame) -> DataFrame:
    """doc_id, th, keys, heavy: the repeated keys of each document that has one."""
    known = sent.groupBy("slot").applyInArrow(_decide, _KNOWN).groupBy("strip").applyInArrow(
        _gather, "doc_id bigint, th bigint, keys binary, heavy binary")
    return known.groupBy("doc_id", "th").agg(F.collect_list("keys").alias("keys"), F.collect_list("heavy").alias("heavy"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_DOC)).alias("doc_id"),
                       F.hash("text").cast("bigint").alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes left): one row per document."""
    marks = stored(repeats(docs).groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("start", "windows")).alias("marks")), "losses")  # a document's own
    release(docs.sparkSession)
    return _beside(docs, marks, _bytes(docs), _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
