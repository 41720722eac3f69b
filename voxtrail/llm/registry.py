"""Queries over the operators with production parameters, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtrail.llm import ann, chat_rotation, embedding_dedup, language_id, lexical_search, mixing, packing, pii, pivot_clusters, run_index, simhash, url_filter, word_index
from voxtrail.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# The rules the URL query judges by: fixed values.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


_RULE_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
CHECKS["op3_url_filter"] = rf"""
WITH rules(rh, rp, rv) AS (VALUES {_RULE_SQL}),
rest AS (SELECT page_id, row_number() OVER () AS rn,
  CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rn,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hits AS (SELECT rn, rh || rp AS rule, rv FROM parts JOIN rules
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
best AS (SELECT rn, arg_max(rule, length(rule)) AS rule, arg_max(rv, length(rule)) AS rv FROM hits GROUP BY rn)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM parts LEFT JOIN best USING (rn)
"""


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False).drop("ids")


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


@query
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 50 == 0)


@query
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs).withColumnRenamed("__entities", "n_replaced")


@query
def op7_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = run_index.cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


CHECKS["op9_chat_rotation"] = r"""
WITH d AS (SELECT conv_id, turn, nullif(trim(role), '') AS who, coalesce(text, '') AS body FROM conversations),
people AS (SELECT DISTINCT conv_id AS c, who AS perspective FROM d WHERE who IS NOT NULL AND who NOT IN ('system', 'developer')),
r AS (SELECT conv_id, perspective, turn, who, body,
  CASE WHEN who = perspective THEN 'assistant' WHEN who IN ('system', 'developer') THEN 'system' ELSE 'user' END AS role
  FROM d JOIN people ON conv_id IS NOT DISTINCT FROM c),
s AS (SELECT *, CASE WHEN role = 'user' THEN who END AS name FROM r),
h AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM s),
f AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM h),
p AS (SELECT *, row_number() OVER w - 1 AS position, sum(length(segment)) OVER w - length(segment) AS start FROM f
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, who, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, role, name, segment, CAST(start AS BIGINT) AS start,
  CAST(start + length(head) AS BIGINT) AS mask_start,
  CAST(CASE WHEN role = 'assistant' THEN length(body) + 10 ELSE 0 END AS BIGINT) AS mask_length FROM p
"""


@query
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


CHECKS["op10_embedding_dedup"] = """
WITH RECURSIVE u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT a AS n, a AS m FROM e UNION SELECT reach.n, e.b FROM reach JOIN e ON reach.m = e.a),
root AS (SELECT n, min(m) AS r FROM reach GROUP BY n),
deg AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, coalesce(r, vec_id) AS component_id,
  vec_id = coalesce(r, vec_id) AS kept FROM embeddings LEFT JOIN deg ON a = vec_id LEFT JOIN root ON n = vec_id
"""


@query
def op12_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = pivot_clusters.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return pivot_clusters.report(found, centroids)


def _cluster_sql(k: int = pivot_clusters.K, rounds: int = pivot_clusters.ROUNDS, dim: int = pivot_clusters.DIM) -> str:
    steps = [f"""WITH p AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS MATERIALIZED (SELECT row_number() OVER w - 1 AS c, v FROM p
  WINDOW w AS (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) QUALIFY row_number() OVER w <= {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT rn, c, list_sum(list_transform(list_zip(p.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM p CROSS JOIN c{r} AS q),
a{r} AS MATERIALIZED (SELECT rn, c, CAST(d AS BIGINT) AS d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rn ORDER BY d, c) = 1)""")
        if r < rounds:
            steps.append(f"""e{r} AS (SELECT c, unnest(range({dim})) AS i, unnest(v) AS x FROM a{r} JOIN p USING (rn)),
s{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e{r} GROUP BY c, i),
m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))""")
    last = f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(q.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN p USING (rn) JOIN c{rounds} AS q USING (c)"""
    return ",\n".join(steps) + last


CHECKS["op12_pivot_clusters"] = _cluster_sql()


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                 table(spark, sf_dir, "benchmark").select("item_id", "text"))


CHECKS["op13_lexical_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents WHERE text IS NOT NULL),
kept AS (SELECT * FROM d WHERE len(words) > 0),
totals AS (SELECT count(*) AS nn, CAST(sum(len(words)) AS BIGINT) AS ll FROM kept),
q AS (SELECT DISTINCT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(text,
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM q) GROUP BY ALL),
post AS (SELECT rn, doc_id, n, term, count(*) AS tf FROM (SELECT rn, doc_id, len(words) AS n, unnest(words) AS term FROM kept)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM dfs, totals),
score AS (SELECT item_id, rn, doc_id, CAST(sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM post JOIN asked USING (term) JOIN w USING (term), totals GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (
  PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 10
"""


@query
def op11_word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = word_index.cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


CHECKS["op11_word_index"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS ws FROM documents),
win AS (SELECT rn, i, md5(array_to_string(ws[i:i + 34], ' ')) AS s FROM (SELECT rn, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
often AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT rn, unnest(range(i, i + 35)) AS j FROM win SEMI JOIN often USING (s)),
words AS (SELECT rn, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS w FROM d),
kept AS (SELECT rn, count(*) AS n, string_agg(w, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (rn, j) GROUP BY rn)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rn)
"""
