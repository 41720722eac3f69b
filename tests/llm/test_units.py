"""The methods inside the operators, on their own."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from voxtrail.llm import ann, blocks, embedding_dedup, mixing, packing, run_index, simhash, url_filter


@given(st.lists(st.integers(1, 256), min_size=1, max_size=120))
@settings(max_examples=40, deadline=None)
def test_differencing_deals_every_item_once(sizes):
    windows = packing.deal(sizes, 1024)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert max(sum(sizes[i] for i in w) for w in windows) <= 1024


def test_differencing_is_even():
    rng = random.Random(1)
    sizes = [rng.randint(1, 256) for _ in range(500)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 60)]
    assert max(sums) - min(sums) <= 4


def test_encoder_equals_tokenizer():
    import public_tokenizers
    e = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    pool = [chr(i) for i in [*range(0x600), *range(0x900, 0x980), *range(0x3000, 0x3100), 0x4E00, 0xAC00, 0x1F600]] + [" ", "\n", "'s"] * 200
    for _ in range(500):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(40)))
        assert e(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [0]
    assert e("a<|endoftext|>b").tolist() == e.tokenizer.encode("a<|endoftext|>b", add_special_tokens=False).ids + [0]


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([0, 10], [5, 2]) == [0, 15]
    assert mixing.targets([], []) == [] and mixing.targets([0], [5]) == [0]


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1000, 65537])
def test_permutation(n):
    p = mixing.permuted(np.arange(n), n, [1, 2])
    assert sorted(p.tolist()) == list(range(n))
    assert n < 100 or p.tolist() != mixing.permuted(np.arange(n), n, [1, 3]).tolist()


def test_shards_cover_every_slot_once():
    slots, shards = np.array([1000, 0, 37, 5000, 3]), 13
    at = np.zeros_like(slots)
    for s in range(shards):
        counts, before = mixing.shard_counts(slots, shards, s)
        assert (before == at).all()
        at = at + counts
    assert (at == slots).all()


def test_large_draws_stay_whole():
    colors = np.array([10 ** 12, 3, 5 * 10 ** 11, 0])
    out = mixing.draw(colors, 7 * 10 ** 11, [1])
    assert out.sum() == 7 * 10 ** 11 and (out <= colors).all() and (out >= 0).all()


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).standard_normal((5, 48))
    y = ann.rotated(x, 3)
    assert np.allclose(y @ y.T, x @ x.T)
    h = ann.hadamard(np.eye(4))
    assert np.allclose(h @ h.T, 4 * np.eye(4))


def test_thermometer_is_a_lower_bound_and_grids_lose_nothing():
    rng = np.random.default_rng(5)
    odd, masks = np.uint64(simhash.ODD), [np.uint64(m & (1 << 64) - 1) for m in simhash.grids()]
    a = rng.integers(0, 2 ** 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)

    def code(x):
        up = x >> np.uint64(1)
        return (x | up) & odd | (x & up & odd) << np.uint64(1)

    counts = [[(int(x) >> 2 * i & 3).bit_count() for i in range(32)] for x in a[:20]]
    assert [[(int(c) >> 2 * i & 3).bit_count() for i in range(32)] for c in code(a[:20])] == counts
    assert (np.bitwise_count(code(a) ^ code(b)) <= np.bitwise_count(a ^ b)).all()
    assert np.any([(code(a) & m) == (code(b) & m) for m in masks], axis=0).all()


def test_split_cells_find_the_same_groups(spark):
    rng = np.random.default_rng(6)
    centre = rng.integers(-2 ** 62, 2 ** 62, 5)
    fps = {int(c) ^ (1 << int(x)) ^ (1 << int(y)) for c in centre for x, y in rng.integers(0, 60, (60, 2))}
    points = spark.createDataFrame([(f, i) for i, f in enumerate(sorted(fps))], "fp bigint, rep bigint")

    def groups(most):
        root = {}
        for a, b in simhash.links(points, most=most).collect():
            ra, rb = root.get(a, a), root.get(b, b)
            root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()} | {a: min(ra, rb), b: min(ra, rb)}
        return root

    assert groups(10_000) == groups(7)


def test_pairs_and_forest():
    ends = np.array([3, 3, 3, 4, 6, 6])
    found = [(a, b) for i, j in blocks.pairs(ends) for a, b in zip(i.tolist(), j.tolist())]
    assert found == [(0, 1), (0, 2), (1, 2), (4, 5)]
    f = blocks.Forest(6)
    f.add(np.array([4, 2]), np.array([5, 3]))
    f.add(np.array([3]), np.array([5]))
    assert f.root.tolist() == [0, 1, 2, 2, 2, 2]


def test_cells_across_batches():
    t = pa.table({"k": pa.array([1] * 5 + [2] * 3 + [3])})
    for n in (1, 2, 4, 9):
        got = [(p.column("k").to_pylist(), e.tolist()) for p, e in blocks.whole_cells(iter(t.to_batches(n)), ["k"])]
        assert [x for ks, _ in got for x in ks] == t.column("k").to_pylist()
        for ks, e in got:
            assert all(ks[i:end] == [ks[i]] * (end - i) and (end == len(ks) or ks[end] != ks[i]) for i, end in enumerate(e))


def test_calibration_recall():
    rng = np.random.default_rng(7)
    width, half, need = embedding_dedup.calibrate(0.93)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((4000, 64))
    y -= (y * x).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    y = 0.93 * x + np.sqrt(1 - 0.93 ** 2) * y
    met = (embedding_dedup.band_keys(x, width) == embedding_dedup.band_keys(y, width)).any(axis=1)
    across = embedding_dedup.directions(64, width)[2]
    hits = (np.abs(x @ across - y @ across) <= half).sum(axis=1)
    assert (met & (hits >= need)).mean() > 0.998


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("concat('host', id, '.com/x') AS key")
    bits = url_filter.build_filter(keys, 5000)
    inside = np.array([r[0] for r in keys.selectExpr("xxhash64(key)").collect()])
    outside = np.array([r[0] for r in spark.range(20000).selectExpr("xxhash64(concat('other', id))").collect()])
    assert url_filter.may_contain(bits, inside).all() and url_filter.may_contain(bits, outside).mean() < 0.02


@pytest.mark.parametrize("alphabet", [b"ab", bytes(range(256))])
def test_index_finds_the_smallest_owner(alphabet):
    rng = random.Random(1)
    base = bytes(rng.choice(alphabet) for _ in range(300))
    snippets = set()
    for _ in range(60):
        a = rng.randrange(200)
        x = bytearray(base[a:a + rng.randrange(50, 86)])
        if rng.random() < 0.5:
            x[rng.randrange(len(x))] = rng.choice(alphabet)
        snippets.add(bytes(x))
    snippets = sorted(snippets)
    docs = np.array([rng.randrange(20) for _ in snippets])
    best = {}
    for s, d in zip(snippets, docs):
        for o in range(len(s) - 49):
            best[s[o:o + 50]] = min(best.get(s[o:o + 50], 99), d)
    index, at = run_index.RunIndex(snippets, docs), 0
    owner = index.owners()
    for s in snippets:
        assert [best[s[o:o + 50]] for o in range(len(s) - 49)] == owner[at:at + len(s) - 49].tolist()
        at += len(s) + 1
    assert len(index.run) <= len(owner)


def test_anchors_cover_every_window_and_depend_on_content_alone():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 256, 3000, dtype=np.uint8)
    key, start, count = run_index.anchors(text, np.array([3000]))
    assert count.sum() == 3000 - 49
    of = np.repeat(key, count)
    moved = run_index.anchors(np.concatenate([rng.integers(0, 256, 77, dtype=np.uint8), text]), np.array([77, 3077]))
    assert (np.repeat(moved[0], moved[2])[-len(of):] == of).all()
    assert run_index.anchors(np.zeros(10, np.uint8), np.array([10]))[0].size == 0


def test_windows_of_oversized_keys_give_the_same_losses():
    rows = [(1, b"q" * 10 + bytes([65 + d]) + b"x" * 49 + b"yz", d, 0, 0) for d in range(4)]
    t = pa.Table.from_batches([run_index._batch(rows, run_index._SNIP)])

    def lost(batches):
        return sorted((d, s + i) for b in batches for d, s, n in zip(*[b.column(c).to_pylist() for c in ("doc_id", "start", "windows")])
                      for i in range(n))

    assert lost(run_index._index(t)) == lost(run_index._by_window(t))


def test_strips_cut_long_texts_with_overlap(monkeypatch):
    monkeypatch.setattr(run_index, "PIECE", 100)
    monkeypatch.setattr(run_index, "STRIP", 250)
    text = bytes(range(256)) * 2
    seen = set()
    for data, ends, rows, offsets in run_index.strips([b"", text, b"short"]):
        start = 0
        for e, r, o in zip(ends.tolist(), rows.tolist(), offsets.tolist()):
            part = data[start:e].tobytes()
            start = e
            if r == 1:
                assert text[o:o + len(part)] == part
                seen.update(range(o, o + max(0, len(part) - 49)))
    assert seen == set(range(len(text) - 49))


def _lost_windows(monkeypatch, strips, many):
    """Lost windows by document, each key in a task of its own; also the snippets and the keys known."""
    class Task:
        partitionId = staticmethod(lambda: 0)
        get = classmethod(lambda cls: cls)

    monkeypatch.setattr(run_index, "MANY", many)
    monkeypatch.setattr(run_index, "TaskContext", Task)
    batches = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in s]), pa.array([0] * len(s)), pa.array([t for _, t in s])],
                                          names=["doc_id", "th", "bytes"]) for s in strips]
    sent = pa.Table.from_batches(list(run_index._send(3)(iter(batches))))

    def by(t, column):
        return [t.filter(pa.compute.equal(t.column(column), x)) for x in pa.compute.unique(t.column(column))]

    known = pa.concat_tables([run_index._decide(t) for t in by(sent, "slot")])
    known = [r for t in by(known, "strip") for r in run_index._gather(t).to_pylist()]
    of = {r["doc_id"]: (r["keys"], r["heavy"]) for r in known}
    snippets = []
    for s in strips:
        s = [x for x in s if x[0] in of]
        if s:
            ids = np.array([d for d, _ in s])
            snippets += run_index._around(ids, ids * 0, [t for _, t in s], [of[d] for d, _ in s])
    snippets = pa.Table.from_batches(snippets)
    lost = {(d, a + i) for t in by(snippets, "key") for b in run_index._losses(iter(t.sort_by("doc_id").to_batches()))
            for d, a, n in zip(*[b.column(c).to_pylist() for c in ("doc_id", "start", "windows")]) for i in range(n)}
    return lost, snippets, of


def _common_strips():
    rng = random.Random(4)
    line = bytes(rng.randrange(97, 123) for _ in range(120))
    own = lambda: bytes(rng.randrange(97, 123) for _ in range(60))
    return line, [[(d, own() + line + own()) for d in s] for s in ([5, 6], [1], [2], [7, 8, 9], [3], [0, 4])]


def test_heavy_keys_settled_in_a_strip_lose_like_the_others(monkeypatch):
    _, strips = _common_strips()
    for strips in (strips, strips[:-1], strips[:2] + strips[4:5]):
        owner = {}
        windows = [(d, i, t[i:i + 50]) for s in strips for d, t in s for i in range(len(t) - 49)]
        for d, _, w in windows:
            owner[w] = min(owner.get(w, d), d)
        for many in (3, 100):
            assert _lost_windows(monkeypatch, strips, many)[0] == {(d, i) for d, i, w in windows if owner[w] < d}


def test_heavy_is_one_property_of_a_key(monkeypatch):
    # keys of three documents or fewer beside heavy ones in several documents of a strip
    line, strips = _common_strips()
    rare = bytes(range(128, 248))
    strips += [[(20, line + rare), (21, rare + line), (22, line)], [(23, rare)]]
    _, _, of = _lost_windows(monkeypatch, strips, 3)
    keys, heavy = [{k for x in of.values() for k in run_index._from_six(x[c]).tolist()} for c in (0, 1)]
    assert keys and heavy and not keys & heavy


def test_hot_keys_are_dealt_by_window(monkeypatch):
    # a line in several documents of every strip, and one that a single document repeats in many contexts
    line, strips = _common_strips()
    rng = random.Random(5)
    often = b"".join(line[:60] + bytes(rng.randrange(97, 123) for _ in range(60)) for _ in range(40))
    for strips in ([s * 1 for s in strips if len(s) > 1], [[(1, often)], [(2, often[60:])]]):
        _, snippets, of = _lost_windows(monkeypatch, strips, 4)
        texts = {}
        for k, start, text in zip(*[snippets.column(c).to_pylist() for c in ("key", "start", "snippet")]):
            if start >= 0 and line[:60][:50] in text:
                texts.setdefault(k, set()).add(text)
        assert texts and all(x == {line[:50]} for x in texts.values())


def test_repeated_ids_take_one_place():
    import pandas as pd
    angle = {1: 0.1, 2: 0.2, 3: 0.3, 4: 0.4, 9: 0.0}
    rows = [(9, 0.0)] + [(1, 0.1)] * 7 + [(1, 0.15)] + [(i, angle[i]) for i in (4, 3, 2)]
    members = pd.DataFrame({"id": [i for i, _ in rows], "v": [[np.cos(a), np.sin(a)] for _, a in rows]})
    got = ann._best(3)(None, members[:1], members).sort_values("score", ascending=False)
    assert got.vec_id.tolist() == [1, 2, 3] and np.allclose(got.score, np.cos([0.1, 0.2, 0.3]))
