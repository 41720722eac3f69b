"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

import corpus_pipeline
from voxtrail.llm import ann, chat_rotation, embedding_dedup, language_id, mixing, packing, pii, run_index, simhash, url_filter

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, k int, row string, "
          "fp bigint, node string, score double, rank int, key string, words array<string>")
EN = "the cat and the dog went over the hill to see what the other animals were doing there today"
FR = "le chat et le chien sont partis sur la colline pour voir ce que les autres faisaient hier soir"
LONG = " ".join(f"w{i * 7919 % 10007} the hill" for i in range(60_000))
EXTRA = (1, 2, "r", 3, "n", 0.5, 4, "key", ["x"])
ROWS = [
    (None, EN, "en", "a", 5), (None, EN, None, None, None), (1, None, "en", "a", 0), (2, "", None, "b", 0),
    (3, " \n\t ", "fr", None, 4), (4, LONG, "en", "a", len(LONG)), (5, EN, "en", "b", len(EN)),
    (5, EN, "en", "b", len(EN)), (6, EN, "en", "a", len(EN)), (7, FR, "fr", "b", len(FR)), (8, "12 34 !!", "en", "a", 8),
    (9, f"Write to Jo.Li@mail.test or call +1 (212) 555-0187, {FR}", "fr", "c", 99), (10, "你好 мир ñ", None, "c", 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + EXTRA for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(docs, none):
    got = mixing.taken(mixing.plan(docs)).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 2 * r["size"] for r in got)
    assert {r.doc_id: r["size"] for r in got if r.doc_id in (1, 2, 3)} == {1: 0, 2: 0, 3: 0}
    m = mixing.plan(docs)
    assert [r.source for r in m.sources.orderBy("k").collect()] == ["a", "b", "c", None]
    for r in m.sources.collect():
        took = mixing.mixed(m).filter(F.col("source").eqNullSafe(F.lit(r.source))).agg(F.sum("words")).first()[0] or 0
        assert abs(took - r.target) <= 0.05 * r.target + 16
    assert mixing.taken(mixing.plan(none)).count() == 0


def test_mixed_documents_hold_the_words_taken(docs):
    m = mixing.plan(docs, block=4)
    took = mixing.taken(m).groupBy().agg(F.sum("taken")).first()[0]
    out = mixing.mixed_documents(docs, m)
    assert out.columns == docs.columns
    words = out.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert words == took
    whole = {r.text for r in out.collect()}
    assert EN in whole


def test_a_million_words_are_mixed_in_linear_time(spark):
    long = " ".join(f"w{i}" for i in range(1_000_000))
    docs = spark.createDataFrame([(1, long, "a"), (2, EN, "b")], "doc_id bigint, text string, source string")
    m = mixing.plan(docs, block=64)
    took = mixing.taken(m).groupBy().agg(F.sum("taken")).first()[0]
    began = time.monotonic()
    out = mixing.mixed_documents(docs, m).select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert out == took > 1_000_000 and time.monotonic() - began < 120


def test_packing(docs, none):
    got = packing.pack(docs).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ROWS}
    assert [(r.length, r.doc_tokens) for r in got if r.doc_id == 2] == [(1, 1)]
    assert sum(r.length for r in got if r.doc_id == 5) == 2 * next(r.doc_tokens for r in got if r.doc_id == 5)
    assert packing.pack(none).count() == 0


def test_surrogates(docs, none, spark):
    out = pii.replace(docs)
    assert out.columns == docs.columns + ["__entities"]
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert len(out.collect()) == len(ROWS) and (1, None) in got and (2, "") in got and (4, LONG) in got
    text = next(t for d, t in got if d == 9)
    assert "Jo.Li@" not in text and "555-0187" not in text and text.endswith(FR) and text.startswith("Write to ")
    assert pii.replace(none).count() == 0
    names = spark.createDataFrame([(1, "Ask Mrs. Anna Berg, Mr. Tom Hill and Mrs. Anna Berg; госпожа Анна Белова. 4111 1111 1111 1111, "
                                       "4111111111111112, 999.1.1.1, 8.8.8.8, token = 'abcdef123', x@y"),
                                   (2, "Mrs. Anna Berg called 8.8.8.8")], "doc_id bigint, text string")
    a, b = [r.text for r in pii.replace(names).orderBy("doc_id").collect()]
    assert "Anna Berg" not in a + b and "4111111111111112" in a and "999.1.1.1" in a and "x@y" in a and "abcdef" not in a
    who = a.split("Mrs. ")[1].split(",")[0]
    assert who in b and who == a.split("Mrs. ")[2].split(";")[0] and who.split()[0] in pii.GIVEN["latin", "f"].split()
    assert a.split("Mr. ")[1].split()[0] in pii.GIVEN["latin", "m"].split()
    assert a.split("госпожа ")[1].split()[0] in pii.GIVEN["cyrillic", "f"].split() and "8.8.8.8" not in a + b


def test_later_mentions_follow_the_name(spark):
    rows = [(1, "Ask Mr. John Smith. John Smith said that Smith left; jsmith@acme.com, John wrote. Smithson and john stay."),
            (2, "Frau Anna Maria Weber kam. Weber's Hund, Anna und Maria-Anna; Webern bleibt."), (3, "John Smith alone has no title."),
            (4, "version 10.0.0.1 and 10.0.0.1, call 0171 5551234, passport no. C0123456 or passport: AB123456")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r.text for r in pii.replace(docs, key="k").collect()}
    assert not re.search(r"\b(John|Smith)\b", got[1]) and "Smithson and john stay" in got[1]
    who = re.match(r"Ask Mr\. (\S+) (\S+)\.", got[1]).groups()
    assert f". {who[0]} {who[1]} said that {who[1]} left;" in got[1] and f", {who[0]} wrote." in got[1]
    assert not re.search(r"\b(Anna|Maria|Weber)\b", got[2].replace("Maria-Anna", "")) and "Webern bleibt" in got[2] and "'s Hund" in got[2]
    assert got[3] == rows[2][1]
    assert got[4].startswith("version 10.0.0.1 and ") and not any(x in got[4][20:] for x in ("10.0.0.1", "0171 5551234", "0123456", "123456"))
    assert got == {r.doc_id: r.text for r in pii.replace(docs, key="k").collect()}
    other = {r.doc_id: r.text for r in pii.replace(docs, key="another").collect()}
    assert other[1] != got[1] and other[3] == got[3]


def brute_assign(values, draw):
    """Surrogates of (type, value) pairs drawn one round after another."""
    known, settled, left, attempt = {v for _, v in values}, {}, sorted(values), 0
    while left:
        drawn = {x: draw(x, attempt) for x in left}
        used = {(t, s) for (t, _), s in settled.items()}
        for x in left:
            if drawn[x] not in known and (x[0], drawn[x]) not in used:
                settled[x] = drawn[x]
                used.add((x[0], drawn[x]))
        left, attempt = [x for x in left if x not in settled], attempt + 1
    return settled


def test_surrogates_equal_rounds_one_by_one(spark):
    values = [("phone", f"555-01{i:02d}") for i in range(100)] + [("ssn", f"{i:03d}-00-0000") for i in range(50)]
    df = spark.createDataFrame(values, "type string, value string")
    made = {a: {(r.type, r.value): r.s for r in df.select("type", "value", pii.surrogate(
        F.col("type"), F.substring("value", 1, 30), F.lit(a), "k").alias("s")).collect()} for a in range(12)}
    got = {(r.type, r.value): r.surrogate for r in pii.assign(df, "k").collect()}
    assert got == brute_assign(values, lambda x, a: made[a][x])


def test_surrogates_stay_distinct_where_they_clash(spark):
    values = spark.range(3000).select(F.lit("name").alias("type"), F.concat(F.lit("Dr. X"), F.col("id").cast("string")).alias("value"))
    letters = values.withColumn("value", F.translate("value", "0123456789", "abcdefghij"))
    got = pii.assign(letters, "test key").collect()
    assert len(got) == 3000 == len({r.surrogate for r in got})
    assert not {r.surrogate for r in got} & {r.value for r in got}


def test_surrogates_of_any_characters_end(spark):
    rows = [(1, "password: ******** token: ......"), (2, "password: 密码安全测试一 and"), (3, "password: 另一个秘密词语 and"),
            (4, "secret=żółćęśą secret=ěščřžýů secret=รหัสผ่าน"), (5, "mail 李明@post.test or 王芳@post.test"), (6, "secret=ԱԲԳԴԵԶ secret=ԲԲԳԴԵԶ"),
            (7, " ".join(f"password: {c}*****" for c in "abcdefghijklmnopqrstuvwxyz")), (8, "password: ªªªªªª")]
    got = {r.doc_id: r for r in pii.replace(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[1].text, got[1]["__entities"]) == (rows[0][1], 0)
    for i in (2, 3):
        new = got[i].text.split()[1]
        assert new not in rows[i - 1][1] and len(new) == 7 and all("一" <= c <= "龥" for c in new)
    assert got[2].text != got[3].text
    for word, new in zip(rows[3][1].split(), got[4].text.split()):
        assert word != new and "x" not in new and len(word) == len(new)
    a, b = [x for x in got[5].text.split() if "@" in x]
    assert a.split("@")[0] != b.split("@")[0] and all("一" <= c <= "龥" for c in (a + b).replace("@", "")[:2])
    assert all("Ա" <= c <= "Ֆ" for x in got[6].text.split() for c in x.split("=")[1])
    letters = got[7].text.split()[1::2]
    assert len(set(letters)) == 26 and not set(letters) & set(rows[6][1].split())
    assert "ª" not in got[8].text


def test_language(docs, none):
    # ids 4, 5 and 6 are held out: one English text gets an id that is not
    model = language_id.learn(docs.withColumn("doc_id", F.when(F.col("doc_id") == 6, 13).otherwise(F.col("doc_id"))))
    assert set(model) == {"en", "fr"}
    got = language_id.identify(docs, model, ["doc_id", "score"], out=("lang_pred", "cosine")).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[i] for i in (1, 2, 3, 8)] == ["und"] * 4 and by[6] == "en" and by[7] == "fr"
    assert language_id.learn(none) == {} and language_id.identify(none, {}, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, {}, ["doc_id"]).collect()} == {"und"}


def test_run_index(docs, none):
    got = run_index.cut(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next((t or "" for d, t, *_ in ROWS if d == r.doc_id)).encode()
        assert r.n_bytes == len(text) and r.n_removed + len(r.kept) == r.n_bytes
        if r.doc_id == 5:
            assert r.n_removed == 0  # copies with one id, and those with none are later
        if r.doc_id == 6 or r.doc_id is None:
            assert r.n_removed == len(EN) and r.n_spans == 1
    assert run_index.cut(none).count() == 0


def test_run_index_on_periodic_and_common_text(spark):
    line = "this very common line stands in nearly every document of the table, word for word. "
    rows = [(i, f"{hashlib.md5(str(i).encode()).hexdigest()} {line if i % 3 else ''}{hashlib.sha256(str(i).encode()).hexdigest()}")
            for i in range(300)] + [(1000, "ab" * 4000), (1001, "ab" * 40 + "q")]
    got = {r.doc_id: r for r in run_index.cut(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    seen, texts = {}, dict(rows)
    for d, t in rows:
        for i in range(len(t) - 49):
            seen.setdefault(t[i:i + 50], d)
    for d, t in texts.items():
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 49):
            if seen[t[i:i + 50]] < d:
                gone[i:i + 50] = True
        assert got[d].n_removed == gone.sum() and got[d].kept.decode() == "".join(c for c, g in zip(t, gone) if not g)


def test_simhash(docs, none):
    got = [(r.doc_id, r.component_id, r.fp) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(ROWS)
    assert {c for d, c, _ in got if d in (5, 6, None)} == {5} and {c for d, c, _ in got if d in (1, 2, 3)} == {1}
    assert {f for d, _, f in got if d in (1, 2, 3)} == {0}
    assert simhash.near_duplicates(none).count() == 0


VECTORS = [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1),
           (4, [float("nan"), 1.0], 1), (5, [None, 1.0], 1), (6, None, 1), (7, [], 1), (8, [float("inf"), 1.0], 1),
           (9, [1.0, 0.05], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0], 2), (12, [1e-300, 0.0], 1), (13, [1.0, 0.0, 0.0], 1),
           (14, [-1.0, 0.0], 1)]


@pytest.fixture(scope="module")
def vectors(spark):
    schema = "vec_id bigint, embedding array<double>, label int, rank int, id bigint, cell bigint, v string, n int"
    return spark.createDataFrame([r + (1, 2, 3, "v", 4) for r in VECTORS], schema)


def test_vector_dedup(vectors, spark):
    got = embedding_dedup.near_duplicates(vectors).collect()
    assert len(got) == len(VECTORS)
    links = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert links[1] == (4, 1, True) and links[2] == (4, 1, False) and links[9] == (4, 1, False) and links[12] == (4, 1, False)
    for i in (3, 4, 5, 6, 7, 8, 10, 11, 13, 14):
        assert links[i] == (0, i, True)
    assert links[None] == (0, None, False)
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_vector_dedup_split_cells(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4, 16)).repeat(40, axis=0) + 0.05 * rng.standard_normal((160, 16))
    points = spark.createDataFrame([(1, 16, i, 1 + i % 3, v.tolist()) for i, v in enumerate(x)],
                                   "label int, dim int, rep bigint, n bigint, v array<double>")

    def degrees(most):
        return {r.a: r.n for r in embedding_dedup.links(points, 0.93, most).groupBy("a").agg(F.sum("n").alias("n")).collect()}

    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & ~np.eye(160, dtype=bool)
    exact = {i: int((near[i] * (1 + np.arange(160) % 3)).sum()) for i in range(160) if near[i].any()}
    assert degrees(10_000) == degrees(9) == exact


def test_neighbours(vectors, spark):
    got = ann.nearest(vectors, F.col("vec_id") % 2 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(by) == {2, 10, 12, 14}
    assert [v for _, v in sorted(by[2])] == [1, 10, 11, 12, 9]
    assert all(len(v) == 5 for v in by.values())
    few = ann.nearest(vectors.filter("vec_id in (1, 2, 14)"), F.col("vec_id") == 2).collect()
    assert sorted((r["rank"], r.vec_id) for r in few) == [(1, 1), (2, 14)]
    assert ann.nearest(vectors.limit(0), F.col("vec_id") == 2).count() == 0


def test_neighbours_split_buckets(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    x[:120] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    rows = [sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 20 == 0, most=m).collect())) for m in (10_000, 16)]
    assert rows[0] == rows[1]
    assert [r[2] for r in rows[0] if r[0] == 0] == [1, 2, 3, 4, 5]


def test_urls(spark):
    pages = spark.createDataFrame(
        [(None, "http://Example.ORG/es/x?q", 1), (1, None, 1), (2, "no scheme", 1), (3, "x://", 1), (3, "x://", 1),
         (4, "https://a.b.com/fr/", 1), (5, "https://xcom/fr/", 1), (6, "http://org?x", 1), (7, "http://org/" + "a" * 100_000, 1),
         (8, "http://" + "a." * 20_000 + "com/de/1#f", 1), (9, "http://notexample.org/es/", 1)],
        "page_id bigint, url string, verdict int")
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"),
                                   ("com", "/de/", "block"), (None, "/", "block"), ("", "/", "block"), ("x", None, "block")],
                                  "host string, path string, verdict string")
    got = {(r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {(None, "example.org/es/", "block"), (1, None, "allow"), (2, None, "allow"), (3, None, "allow"),
                   (4, "com/fr/", "allow"), (5, None, "allow"), (6, None, "allow"), (7, "org/", "allow"), (8, "com/de/", "block"),
                   (9, "org/", "allow")}
    assert url_filter.judge(pages, rules).count() == 11
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_chat(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be kind", 9), (1, 1, "ann", "hi", 9), (1, 2, "bob", None, 9), (1, 3, "cy", "", 9), (1, 3, "cy", "", 9),
         (1, None, "ann", "last", 9), (2, 0, None, "who", 9), (3, 0, " ", "x", 9), (3, 1, "ann", "y", 9), (None, 0, "ann", "z", 9),
         (4, 0, "system", "alone", 9)], "conv_id bigint, turn bigint, role string, text string, position int")
    got = chat_rotation.rotate(turns).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r.position):
        key = (r.conv_id, r.perspective)
        assert r.start == len(whole.get(key, ""))
        whole[key] = whole.get(key, "") + r.segment
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "cy"), (3, "ann"), (None, "ann")}
    for r in got:
        text = whole[r.conv_id, r.perspective][r.mask_start:r.mask_start + r.mask_length]
        assert (text.endswith("<|im_end|>") and r.role == "assistant") == (r.mask_length > 0)
    assert whole[1, "bob"] == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n"
                               "<|im_start|>assistant\n<|im_end|>\n" + "<|im_start|>user name=cy\n<|im_end|>\n" * 2
                               + "<|im_start|>user name=ann\nlast<|im_end|>\n")
    assert chat_rotation.rotate(turns.limit(0)).count() == 0


def test_pipeline_stages(docs, none, spark):
    kept = corpus_pipeline.keep_languages(spark, docs, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["10", "4", "5", "5", "6", "7", "9", "None", "None"]
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "10", "4", "5", "7", "8", "9", "None"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
        out = stage(spark, docs, "")
        assert name == "packing" or out.columns == docs.columns
        assert name == "packing" or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() > 0


def test_packed_texts_come_back():
    import pyarrow as pa
    rows = [(1, 5, b"abc"), (run_index.NO_DOC, 6, b""), (2, 7, b"x" * 1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["doc_id", "th", "bytes"])
    table = pa.Table.from_batches(list(run_index._pack(3)(iter([batch]))))
    assert sorted((d, t, x) for doc, th, own in run_index._unpacked(table) for d, t, x in zip(doc, th, own)) == sorted(rows)


def test_pipeline_runs_its_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        rows.append(docs.count())
    assert rows[0] <= 200 and rows[1] < rows[0] and rows[2] == rows[1]
    run = corpus_pipeline.run(spark, sf)
    cols = ["doc_id", "start", "length", "ids_crc32"]
    key = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert sum(r[2] for r in key(run)) == sum(r[2] for r in key(docs))
    assert isinstance(run.schema, T.StructType)
