"""Registered queries on the small tables: against check SQL or brute force."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import harness
from voxtrail.llm.registry import CHECKS, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, source, lang from '{SF}/documents.parquet' order by doc_id").df()


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert harness.compare(got, harness.connection(SF).execute(CHECKS[name]).fetchdf()) is None


def test_mixing(spark, docs):
    got = QUERIES["op1_mixing"](spark, SF).toPandas()
    again = QUERIES["op1_mixing"](spark, SF).toPandas()
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, again.values))
    d = got.merge(docs, on="doc_id")
    assert len(d) == len(docs)
    assert (d["size"] == [len(WORD.findall(t)) for t in d.text]).all() and (d.taken <= 2 * d["size"]).all()
    s = d.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"),
                                source_size=("source_size", "first"))
    assert (s["size"] == s.source_size).all() and (s.target <= 2 * s["size"]).all()
    assert s.target.sum() == pytest.approx(1.5 * s["size"].sum())
    assert ((s.taken - s.target).abs() <= 0.02 * s.target + 16).all()
    below = s[s.target < 2 * s["size"] * 0.999].reset_index()
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(sorted(s.index))}
    assert np.ptp([t / weight[x] for t, x in zip(below.target, below.source)]) < 1e-6 * below.target.max()


def test_nearest_neighbours(spark):
    got = QUERIES["op2_nearest_neighbours"](spark, SF).toPandas()
    e = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by vec_id").df()
    x = np.array(e.embedding.tolist(), dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, hit = e.vec_id.to_numpy(), 0
    queries = ids[ids % 50 == 0]
    for q in queries:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(mine.vec_id)
        assert np.allclose(mine.score, [s[ids == v][0] for v in mine.vec_id], atol=1e-12, rtol=0)
        hit += len(set(ids[np.lexsort((ids, -s))[:5]]) & set(mine.vec_id))
    assert len(got) == 5 * len(queries) and hit >= 0.95 * len(got)


def test_packing(spark, docs):
    got = QUERIES["op4_packing"](spark, SF).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, text in zip(docs.doc_id, docs.text):
        ids, at = np.array(t.encode(text, add_special_tokens=False).ids + [0], dtype="<u4"), 0
        for r in got[got.doc_id == doc].sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at:at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024
    sizes = got.groupby("sequence_id").length.sum()
    assert sum(1024 - n for n in sizes if n & (n - 1)) < 0.02 * sizes.sum()


ENTITY = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+|\+\d \(\d{3}\) \d{3}-\d{4}|\b[3-6]\d{15}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b"
                    r"|AKIA[0-9A-Z]{16}|(?<=password = \")[^\"]+|(?<=token = \")[^\"]+")


def luhn(number):
    d = [int(c) for c in reversed(number)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_surrogates(spark, docs):
    big = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text as old from '{big}/documents.parquet'").df()
    d = QUERIES["op5_pii_surrogates"](spark, big).toPandas().merge(docs, on="doc_id")
    assert len(d) == len(docs)
    to, back = defaultdict(set), defaultdict(set)
    for old, new, n in zip(d.old, d.text, d.n_replaced):
        found = [x for x in ENTITY.findall(old) if not (len(x) == 16 and x.isdigit() and not luhn(x))]
        if not found:
            assert old == new and n == 0
            continue
        assert re.sub(r"\w", "", old) == re.sub(r"\w", "", new) or "@" in old
        after = [x for x in ENTITY.findall(new) if not (len(x) == 16 and x.isdigit() and not luhn(x))]
        assert len(after) == len(found) == n
        for a, b in zip(found, after):
            to[a].add(b)
            back[b].add(a)
            assert a != b and ("@" in a) == ("@" in b) and luhn(a) == luhn(b) if a.isdigit() else a != b
    assert len(to) >= 60 and not set(to) & set(back)
    assert max(map(len, to.values())) == max(map(len, back.values())) == 1


def test_language_id(spark, docs):
    d = QUERIES["op6_language_id"](spark, SF).toPandas().merge(docs, on="doc_id")
    assert (d.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in d.doc_id]).all()
    h = d[d.held_out]
    assert len(d) == len(docs) and d.score.between(0, 1).all() and (h.lang == h.lang_pred).mean() > 0.97


def test_run_index(spark, docs):
    got = QUERIES["op7_run_index"](spark, SF).toPandas().set_index("doc_id")
    first, removed = {}, 0
    texts = {d: t.encode() for d, t in zip(docs.doc_id, docs.text)}
    for d, b in texts.items():
        for i in range(len(b) - 49):
            first.setdefault(b[i:i + 50], d)
    for d, b in texts.items():
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 49):
            if first[b[i:i + 50]] < d:
                gone[i:i + 50] = True
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert tuple(got.loc[d, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]]) == (
            len(b), gone.sum(), runs, hashlib.sha256(kept).hexdigest())
        removed += gone.sum()
    assert removed


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    sh = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def test_simhash(spark, docs):
    got = QUERIES["op8_simhash"](spark, SF).toPandas().set_index("doc_id")
    fps = [brute_fingerprint(t) for t in docs.text]
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    for i, d in enumerate(docs.doc_id):
        assert got.loc[d, "fingerprint"] == f"{fps[i]:016x}" and got.loc[d, "component_id"] == docs.doc_id[root[i]]
    assert len(set(root)) < len(fps)
