"""Pivot clusters, lexical search and word index against brute force, with hostile rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtrail.llm import chat_rotation, language_id, lexical_search, mixing, pivot_clusters, word_index

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- clusters ----------------------------------------------------------------------------

def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        for j, vs in own.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs)]
    return sorted((-1 if i is None else i, *nearest(v)[::-1]) for i, v in kept), c


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(6, 8))[rng.integers(0, 6, 400)] + 0.3 * rng.normal(size=(400, 8))).astype(np.float32)
    x[:30] = x[0]                        # copies
    x[30:60] = np.round(x[30:60])        # ties
    x[60], x[61] = 0, 5e5                # zero; near the largest
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[3].tolist()), (None, x[9].tolist())]
    bad = [(900, None), (901, [1.0] * 7), (902, [None] + [1.0] * 7), (903, [float("nan")] + [1.0] * 7),
           (904, [float("-inf")] + [1.0] * 7), (905, []), (906, [3e38] * 8)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows + bad], "vec_id bigint, embedding array<float>, cluster string, v int")
    found, centroids = pivot_clusters.cluster(df, k=12, rounds=4, dim=8)
    out = pivot_clusters.report(found, centroids).toPandas()
    want, c = brute_clusters(rows, 12, 4)
    assert sorted(zip(out.vec_id.fillna(-1).astype(int), out.cluster, out.distance)) == want
    inertia = Counter()
    for _, j, d in want:
        inertia[j] += d
    for r in out.itertuples():
        assert r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_pivots_spare_distances():
    rng = np.random.default_rng(4)
    c = rng.integers(-3000, 3000, (40, 64))
    v = c[rng.integers(0, 40, 2000)] + rng.integers(-60, 60, (2000, 64))
    pivots = c[:16]
    got, d, measured = pivot_clusters.nearest(v, pivot_clusters.distances(v, pivots), c, pivot_clusters.distances(c, pivots))
    every = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (got == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert measured < 0.2 * every.size


def test_clusters_of_few_or_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    none = pivot_clusters.report(*pivot_clusters.cluster(spark.createDataFrame([], schema)))
    assert none.count() == 0 and none.columns[:3] == ["vec_id", "cluster", "distance"]
    two = spark.createDataFrame([(1, [0.5] * 64), (2, [1.5] * 64), (2, [1.5] * 64)], schema)
    rows = pivot_clusters.report(*pivot_clusters.cluster(two)).collect()
    assert len(rows) == 3 and {r.distance for r in rows} == {0}
    assert len({r.cluster for r in rows if r.vec_id == 2}) == 1
    flat = spark.createDataFrame([(i, [0.0] * 64) for i in range(50)], schema)
    assert {(r.cluster, r.inertia) for r in pivot_clusters.report(*pivot_clusters.cluster(flat)).collect()} == {(0, 0)}


def test_inertia_beyond_64_bits_is_the_largest_long(spark):
    far = [(i, [(-1.0) ** i * 5.2e5] * 64) for i in range(12)]
    found, centroids = pivot_clusters.cluster(spark.createDataFrame(far, "vec_id bigint, embedding array<float>"), k=1, rounds=1)
    assert {r.inertia for r in pivot_clusters.report(found, centroids).collect()} == {pivot_clusters.LONG}


# ---- search ------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_search(docs, items, top=10):
    counted = [(d, Counter(brute_terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 25 + 75 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in brute_terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "é", "A1"]
    p = 1 / np.arange(1, len(vocab) + 1)
    make = lambda n: " ".join(rng.choice(vocab, n, p=p / p.sum()))
    docs = [(i, make(int(rng.integers(1, 60)))) for i in range(700)]
    docs += [(800, None), (801, ""), (802, " .,! \n"), (803, make(5000)), (None, docs[3][1]), (3, docs[3][1]), (804, "A1 a1 É é w1,w1;W1")]
    docs += [(900 + i, docs[5][1]) for i in range(40)]  # ties
    items = [(i, make(int(rng.integers(1, 30)))) for i in range(25)] + [(50, None), (51, "!!"), (52, "nothing here"), (None, "w3 w3 w9"), (53, "W1 w1 É日本")]
    monkeypatch.setattr(lexical_search, "SHARD", 128)
    monkeypatch.setattr(lexical_search, "BLOCK", 16)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id bigint, text string, n int, term string")
    q = spark.createDataFrame([(*r, 2) for r in items + items[:3]], "item_id bigint, text string, rank int")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(brute_search(docs, items), key=key)
    assert want
    for group in (lexical_search.TERMS, 100):  # one group of queries, several
        got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.search(d, q, group=group).collect()]
        assert sorted(got, key=key) == want


def test_search_skips_documents():
    rng = np.random.default_rng(6)
    n = 20_000
    term = np.concatenate([np.repeat(0, n), rng.integers(1, 3, n), np.full(40, 3)])
    owner = np.concatenate([np.arange(n), np.arange(n), rng.choice(n, 40, replace=False)])
    tf = rng.integers(1, 4, len(term))
    shard = lexical_search.Shard(np.arange(n), np.full(n, 50), term, tf, owner, np.array([3, 700, 690, 9000]), n, 50 * n)
    best = lexical_search.Best(10)
    scored = shard.search([(t, 1) for t in range(4)], best)
    every = np.zeros(n, dtype=np.int64)
    np.add.at(every, shard.at, shard.impact)
    order = np.lexsort((np.arange(n), -every))[:10]
    assert (best.doc == order).all() and (best.score == every[order]).all()
    assert scored < n / 4


def test_search_in_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical_search.search(docs, items).collect()] == [(1, 1, 1, 287 * (10 ** 9 // (1000 + 800)))]


# ---- windows -----------------------------------------------------------------------------

def brute_cut(docs, span):
    words = [WORD.findall(t or "") for _, t in docs]
    times = Counter(tuple(w[i:i + span]) for w in words for i in range(len(w) - span + 1))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - span + 1):
            if times[tuple(w[i:i + span])] > 1:
                gone.update(range(i, i + span))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def hostile_texts():
    rng = np.random.default_rng(8)
    text = lambda n, v=400: [f"w{i}" for i in rng.integers(0, v, n)]
    common, passage = text(12), text(60)
    docs = []
    for i in range(120):
        parts = [text(int(rng.integers(5, 80)))]
        for _ in range(int(rng.integers(0, 4))):
            a = int(rng.integers(0, 20))
            parts += [[common, passage, passage[a:a + 35], passage[a:a + 34]][int(rng.integers(0, 4))], text(int(rng.integers(0, 30)))]
        docs.append((i, rng.choice(["\n", " ", " \t", "\x0b "]).join(w for p in parts for w in p)))
    tail = text(50)
    for i in range(60):  # one frequent run of words in differing contexts
        docs.append((200 + i, " ".join(text(20) + common + tail[:int(rng.integers(10, 50))] + text(9))))
    docs += [(300 + i, docs[7][1]) for i in range(5)] + [docs[8], (None, docs[9][1]), (None, None), (301, ""), (302, " \n ")]
    docs += [(400, " ".join(["a"] * 300)), (401, " ".join(["a", "b"] * 40)), (402, "x" * 5000 + " " + " ".join(text(100))),
             (403, " ".join(passage + text(2000) + passage)), (404, " ".join(text(34))), (405, "é\xa0ü " * 40)]
    return docs


@pytest.mark.parametrize("changed", [{}, {"MANY": 3}, {"PIECE": 700, "STRIP": 900}, {"SHARD": 2000}, {"MANY": 2, "RECALLED": 2, "SHARD": 500}])
def test_cut_equals_brute_force(spark, monkeypatch, changed):
    for name, value in changed.items():
        monkeypatch.setattr(word_index, name, value)
    docs = hostile_texts()
    df = spark.createDataFrame([(*r, "k", 1) for r in docs], "doc_id bigint, text string, key string, start int").repartition(5)
    got = [tuple(r) for r in word_index.cut(df).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r[:3]) + (r[3],)
    want = sorted(brute_cut(docs, 35), key=key)
    assert sorted(got, key=key) == want and 0.2 < sum(r[2] for r in want) / sum(r[1] for r in want) < 0.9


def test_cut_of_nothing(spark):
    assert word_index.cut(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_matching_statistics(monkeypatch):
    rng = np.random.default_rng(9)
    for span in (3, 5, 9):
        monkeypatch.setattr(word_index, "SPAN", span)
        for letters in (2, 4, 12):
            words = rng.integers(1, letters + 1, 500)
            size = np.array([60, 25, 40, 5, 70])
            sym, _ = word_index._laid(words, np.cumsum(size) - size, size)
            sym, pattern = word_index._dense(sym, words)
            index = word_index.FMIndex(sym)
            start, end = np.array([200, 280, 401]), np.array([280, 400, 500])
            length, rank = index.matches(pattern, start, end)
            held = "".join(map(chr, np.where(sym > 0, 96 + sym, 32)))
            text = "".join(map(chr, np.where(pattern > 0, 96 + pattern, 33)))
            for a, e in zip(start, end):
                for p in range(a, e):
                    n = 0
                    while n < span and p + n < e and text[p:p + n + 1] in held:
                        n += 1
                    assert length[p] == n
                    assert held[index.order[rank[p]]:][:n] == text[p:p + n]


def test_wavelet_tree_is_compressed():
    rng = np.random.default_rng(10)
    p = 1 / np.arange(1, 2001)
    seq = rng.choice(2000, 50_000, p=p / p.sum())
    tree = word_index.WaveletTree(seq)
    at = rng.integers(0, len(seq) + 1, 300)
    c = seq[rng.integers(0, len(seq), 300)]
    assert tree.rank(c, at).tolist() == [int((seq[:a] == x).sum()) for x, a in zip(c, at)]
    f = np.bincount(seq) / len(seq)
    entropy = -(f[f > 0] * np.log2(f[f > 0])).sum()
    assert tree.bytes() * 8 < 1.55 * (entropy + 1) * len(seq)  # bits, and half of them for counts


def test_neighbours_with_hot_buckets_on_both_sides(spark):
    from voxtrail.llm import ann
    rng = np.random.default_rng(17)
    x = np.concatenate([rng.normal(size=16) + 0.05 * rng.normal(size=(60, 16)), rng.normal(size=(40, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0, 2.0]), (901, [2.0, 1.0])], "vec_id int, embedding array<double>")
    asked = (F.col("vec_id") % 2 == 0) | (F.col("vec_id") > 800)
    whole, split = ({(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(df, asked, most=m).collect()} for m in (10_000, 7))
    assert whole == split and len(whole) == 50 * 5 + 2
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 100, 2):
        s = u @ u[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5]) & {whole[q, k][0] for k in range(1, 6)})
    assert hit >= 0.95 * 250 and whole[900, 1][0] == 901


# ---- earlier operators against loops -----------------------------------------------------

def brute_profile(text):
    """Sum over trigrams of the products of rotated letter vectors, one trigram at a time."""
    t = language_id._letters()
    ids = [ord(c) % (language_id.ROWS - 1) + 1 if c.isalpha() else 0 for c in text.lower()]
    ids = [0, *[x for i, x in enumerate(ids) if x or i == 0 or ids[i - 1]], 0]
    while len(ids) > 2 and ids[0] == ids[1] == 0:
        ids.pop(0)
    while len(ids) > 2 and ids[-1] == ids[-2] == 0:
        ids.pop()
    out = np.zeros(language_id.DIM)
    for a, b, c in zip(ids, ids[1:], ids[2:]):
        out += np.roll(t["c"][a].astype(int), 2) * np.roll(t["c"][b].astype(int), 1) * t["c"][c]
    return out


def test_language_profiles_equal_loops(spark):
    words = {"en": "the hill and the dog were there today", "fr": "le chien et la colline hier soir", "de": "der Hund und der Hügel waren heute da"}
    rows = [(i, f"{w} {w[i % 5:]} {i}!", k) for k, w in words.items() for i in range(30)]
    asked = [(500, "the dog and the colline"), (501, "  Hügel,  HUND!! "), (502, "soir"), (503, "x"), (504, "und the le")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.learn(docs)
    own = {k: sum(brute_profile(t) for i, t, lang in rows if lang == k and zlib.crc32(str(i).encode()) % 3 != 1) for k in words}
    for k in words:
        assert np.array_equal(model[k], own[k])
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(asked, "doc_id bigint, text string"), model, ["doc_id"]).collect()}
    for i, text in asked:
        v = brute_profile(text)
        cos = {k: own[k] @ v / np.linalg.norm(own[k]) / np.linalg.norm(v) for k in own}
        assert got[i].lang_pred == max(sorted(cos), key=cos.get) and abs(got[i].score - min(1, max(0, max(cos.values())))) < 1e-9


def test_language_ties_go_to_the_smaller(spark):
    rows = [(i, "one and the same text", lang) for i, lang in enumerate(["nl", "da", "sv"] * 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = {k: language_id.encode("one and the same text") for k in ("nl", "da", "sv")}
    assert {r.lang_pred for r in language_id.identify(docs, model, ["doc_id"]).collect()} == {"da"}


def test_mix_equals_its_slots_one_by_one(spark):
    rng = np.random.default_rng(19)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), "abc"[int(rng.integers(0, 3))]) for i in range(300)] + [(7, "x y z", "a"), (None, "p q", None)]
    m = mixing.plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), block=5, shard=100)
    layout, sources = {}, {r.k: r for r in m.sources.collect()}
    for d in m.documents.collect():
        for at in range(d.start, d.start + d["size"]):
            assert (d.k, at) not in layout  # laid end to end, nothing twice
            layout[d.k, at] = (d.k, d.bucket, d.row)
    for k, s in sources.items():
        assert sum(1 for x, _ in layout if x == k) == s.source_size
        assert all((k, at) in layout for at in range(s.source_size))
    slots, taken, seen = m.slots.collect(), Counter(), Counter()
    for s in slots:
        seen[s.k, s.block, s.epoch] += 1
        for at in range(s.block * sources[s.k].length, min((s.block + 1) * sources[s.k].length, sources[s.k].source_size)):
            taken[layout[s.k, at]] += 1
    assert max(seen.values()) == 1  # a block once a round
    assert Counter(s.k for s in slots) == Counter({k: s.slots for k, s in sources.items() if s.slots})
    ids = {(d.k, d.bucket, d.row): (d.doc_id, d["size"]) for d in m.documents.collect()}
    got = sorted(((r.doc_id is None, r.doc_id or 0), r["size"], r.taken) for r in mixing.taken(m).collect())
    assert got == sorted(((ids[x][0] is None, ids[x][0] or 0), ids[x][1], taken[x]) for x in ids)


def test_rotation_of_a_very_long_turn(spark):
    long = "word " * 200_000
    d = spark.createDataFrame([(1, 0, "ann", long), (1, 1, "bob", "ok")], "conv_id bigint, turn int, role string, text string")
    got = chat_rotation.rotate(d).orderBy("perspective", "position").collect()
    assert len(got) == 4 and got[0].mask_length == len(long) + 10 and got[3].start > len(long)
