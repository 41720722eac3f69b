"""Contract checks, lookups and comparisons."""

from pyspark.sql import functions as F

from voxtrail.functions import text
from voxtrail.operators import compare as C, groupstats as G, validate as V
from voxtrail.plans.groups import CELLS
from voxtrail.plans.registry import query

CONTRASTS = ["AF", "AO", "NF", "NO", "RF", "RO"]
ROIS = [f"roi{i}" for i in range(17)]
GRID = """grid AS (SELECT s.subject, r.roi, k.contrast FROM (SELECT DISTINCT subject FROM acc) s,
  (SELECT concat('roi', unnest(range(17))) AS roi) r, (SELECT unnest(['AF','AO','NF','NO','RF','RO']) AS contrast) k)"""


@query("p1_condition_label", """
SELECT vec_id, CASE WHEN source='natural' THEN valence ELSE valence||'AI' END AS condition FROM trials""")
def p1(c):
    return c.view("trials").select("vec_id", text.condition_label(F.col("source"), F.col("valence")).alias("condition"))


NAMES = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat('set/', p_partkey, '.1_', p_size, '.jpg')
 WHEN 1 THEN concat(p_partkey, '.1') WHEN 2 THEN concat(p_partkey, '_2.NII.GZ') WHEN 3 THEN concat('a_b', p_partkey, '.png')
 ELSE concat(p_partkey, '_x_', p_size) END AS name FROM {part}"""


@query("p2_base_identity", f"""WITH n AS ({NAMES.replace('{part}', 'part')})
SELECT p_partkey, regexp_replace(regexp_replace(regexp_extract(name, '([^/]*)$', 1),
  '\\.(nii\\.gz|nii|jpg|jpeg|png|bmp|gif|tif|tiff)$', '', 'i'), '_[0-9]+$', '') AS family FROM n""")
def p2(c):
    d = c.spark.sql(NAMES.replace("{part}", f"parquet.`{c.sf_dir}/part.parquet`"))
    return d.select("p_partkey", text.base_identity(F.col("name")).alias("family"))


@query("p3_subject_number", """
SELECT c_custkey, CAST(nullif(regexp_extract(concat('Sub', c_custkey, '_s', c_nationkey), '([0-9]+)', 1), '') AS BIGINT) AS first_run,
 CAST(regexp_replace(concat('Sub', c_custkey, '_s', c_nationkey), '[^0-9]', '', 'g') AS BIGINT) AS all_digits FROM customer""")
def p3(c):
    label = F.concat(F.lit("Sub"), "c_custkey", F.lit("_s"), "c_nationkey")
    return c.table("customer").select(
        "c_custkey", text.subject_number(label).alias("first_run"),
        text.subject_number(label, all_digits=True).alias("all_digits"))


@query("p5_subject_exclusion", """
SELECT count(DISTINCT subject) AS subjects_before, count(DISTINCT CASE WHEN subject NOT IN (3, 11, 27) THEN subject END) AS subjects_after,
  count(*) AS rows_before, count(*) FILTER (subject NOT IN (3, 11, 27)) AS rows_after FROM results""")
def p5(c):
    return V.excluded_subjects(c.view("results"), "subject", [3, 11, 27])


@query("p9_kept_regions", """
WITH g AS (SELECT DISTINCT subject FROM subject_map), r AS (SELECT DISTINCT roi_id FROM stat_map), k AS (SELECT DISTINCT contrast FROM subject_map),
n AS (SELECT subject, contrast, roi_id, count(*) AS n FROM subject_map JOIN stat_map USING (voxel_id) GROUP BY ALL),
d AS (SELECT subject, contrast, roi_id, coalesce(n, 0) AS n FROM (SELECT * FROM g, r, k) LEFT JOIN n USING (subject, contrast, roi_id))
SELECT contrast, roi_id, min(n) AS min_voxels, max(n) AS max_voxels, rnd(median(n)) AS median_voxels, min(n) >= 55 AS kept,
  CASE WHEN min(n) >= 55 THEN '' ELSE '< 55 voxels in at least one subject' END AS reason FROM d GROUP BY contrast, roi_id""")
def p9(c):
    n = c.sql("SELECT subject, contrast, roi_id, count(*) AS n FROM subject_map JOIN stat_map USING (voxel_id) GROUP BY subject, contrast, roi_id")
    units = c.view("subject_map").select("subject", "contrast").distinct()
    regions = [r.roi_id for r in c.view("stat_map").select("roi_id").distinct().collect()]  # the atlas's list
    subjects = V.dense_grid(units.select("subject").distinct(), {
        "contrast": [r.contrast for r in units.select("contrast").distinct().collect()], "roi_id": regions})
    return V.kept_regions(V.fill_grid(n, subjects, ["subject", "contrast", "roi_id"], {"n": 0}), ["contrast", "roi_id"], "n", 55)


@query("p10_manifest_contract", """
SELECT 'run' AS rule, concat(subject,'|',source,'|',run) AS "group", count(*) AS observed, 10::BIGINT AS expected FROM trials
 GROUP BY subject, source, run HAVING count(*) <> 10
UNION ALL SELECT 'condition', concat(subject,'|',source,'|',valence), count(*), 16 FROM trials
 GROUP BY subject, source, valence HAVING count(*) <> 16
UNION ALL SELECT 'image', concat(subject,'|',image), count(*), 10 FROM trials GROUP BY subject, image HAVING count(*) <> 10""")
def p10(c):
    return V.count_violations(c.view("trials"), {
        "run": (["subject", "source", "run"], 10), "condition": (["subject", "source", "valence"], 16),
        "image": (["subject", "image"], 10)})


OBS = """obs AS (SELECT CAST(o_custkey % 30 AS INT) AS subject, concat('roi', l_partkey % 18) AS roi,
   concat(l_returnflag, l_linestatus) AS contrast, l_tax * 14.7 - 0.03 AS accuracy, l_linenumber AS line
   FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey)"""


def observed(c):
    return c.spark.sql("WITH " + OBS.replace("{lineitem}", f"parquet.`{c.sf_dir}/lineitem.parquet`").replace(
        "{orders}", f"parquet.`{c.sf_dir}/orders.parquet`") + " SELECT * FROM obs")


@query("p11_key_set_check", "WITH " + OBS.replace("{lineitem}", "lineitem").replace("{orders}", "orders") + ", " + GRID + """,
o AS (SELECT subject, roi, contrast, count(*) AS n FROM obs GROUP BY ALL)
SELECT subject, roi, contrast, 'missing' AS issue FROM grid ANTI JOIN o USING (subject, roi, contrast)
UNION ALL SELECT subject, roi, contrast, 'unexpected' FROM o ANTI JOIN grid USING (subject, roi, contrast)
UNION ALL SELECT subject, roi, contrast, 'duplicate' FROM o SEMI JOIN grid USING (subject, roi, contrast) WHERE n > 1
UNION ALL SELECT subject, roi, contrast, 'out_of_range' FROM obs WHERE accuracy IS NULL OR accuracy < 0 OR accuracy > 1""")
def p11(c):
    o = observed(c)
    grid = V.dense_grid(o.select("subject").distinct(), {"roi": ROIS, "contrast": CONTRASTS})
    return V.result_issues(o, grid, ["subject", "roi", "contrast"], "accuracy")


@query("p11_count_consistency", """
SELECT roi, status, min(line) AS low, max(line) AS high FROM acc GROUP BY roi, status HAVING min(line) <> max(line)""")
def p11_counts(c):
    return V.inconsistent(c.view("acc"), ["roi", "status"], "line")


PLAN = """plan AS (SELECT o_orderkey AS asset_id, o_orderstatus AS sdc_mode, o_custkey % 30 AS subject FROM {orders}
  WHERE o_orderpriority <> '5-LOW'),
sel AS (SELECT o_orderkey AS asset_id, CASE WHEN o_custkey % 17 = 0 THEN 'F' ELSE o_orderstatus END AS sdc_mode,
  o_custkey % 30 + CAST(o_custkey % 97 = 0 AS INT) AS subject, concat('Src/', o_custkey, '_', CAST(floor(o_totalprice) AS BIGINT) % 50) AS src FROM {orders}
  WHERE o_orderpriority <> '1-URGENT')"""


def sub(c, t):
    for n in ("orders", "lineitem", "events", "part", "documents", "customer"):
        if "{" + n + "}" in t:
            t = t.replace("{" + n + "}", c.source(n))
    return t


@query("p12_asset_audit", "WITH " + PLAN.replace("{orders}", "orders") + """
SELECT asset_id::VARCHAR AS item, 'missing_asset' AS issue FROM plan ANTI JOIN sel USING (asset_id)
UNION ALL SELECT asset_id::VARCHAR, 'unexpected_asset' FROM sel ANTI JOIN plan USING (asset_id)
UNION ALL SELECT asset_id::VARCHAR, 'plan_mismatch:sdc_mode' FROM plan p JOIN sel s USING (asset_id) WHERE p.sdc_mode <> s.sdc_mode
UNION ALL SELECT asset_id::VARCHAR, 'plan_mismatch:subject' FROM plan p JOIN sel s USING (asset_id) WHERE p.subject <> s.subject
UNION ALL SELECT lower(src), 'duplicate_source' FROM sel GROUP BY lower(src) HAVING count(*) > 1""")
def p12(c):
    q = "WITH " + sub(c, PLAN)
    return V.audit_selection(c.spark.sql(q + " SELECT * FROM plan"), c.spark.sql(q + " SELECT * FROM sel"),
                             "asset_id", ["sdc_mode", "subject"], "src")


@query("p13_candidate_match", """
WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_shipdate >= TIMESTAMP '1999-01-01') AS np,
  min(l_partkey) AS c, min(l_partkey) FILTER (l_shipdate >= TIMESTAMP '1999-01-01') AS cp FROM lineitem WHERE l_quantity > 30 GROUP BY l_orderkey),
h AS (SELECT o_orderkey, CASE WHEN np > 0 THEN np ELSE n END AS k, CASE WHEN np > 0 THEN cp ELSE c END AS one
  FROM orders LEFT JOIN g ON l_orderkey = o_orderkey)
SELECT o_orderkey AS asset, o_orderkey, coalesce(k, 0) AS n_candidates, CASE WHEN k = 1 THEN one END AS proposal,
 CASE WHEN k = 1 THEN 'proposed_unique' WHEN k IS NULL THEN 'unresolved_missing' ELSE 'unresolved_ambiguous' END AS status FROM h""")
def p13(c):
    e = c.table("orders").select(F.col("o_orderkey"), F.col("o_orderkey").alias("asset"))
    cand = c.table("lineitem").filter("l_quantity > 30").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_partkey",
        (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).alias("pref"))
    return V.match_candidates(e, cand, ["o_orderkey"], "asset", "l_partkey", "pref")


@query("p14_aligned_manifests", """
WITH l AS (SELECT vec_id, run, valence FROM trials), r AS (SELECT vec_id, run + CAST(vec_id % 61 = 7 AS INT) AS run,
  CASE WHEN vec_id % 83 = 2 THEN 'neutral' ELSE valence END AS valence FROM trials WHERE vec_id <> 30)
SELECT vec_id, l.run AS run, l.valence AS valence, r.run AS r_run, r.valence AS r_valence FROM l FULL JOIN r USING (vec_id)
WHERE l.run IS DISTINCT FROM r.run OR l.valence IS DISTINCT FROM r.valence""")
def p14(c):
    t = c.view("trials").select("vec_id", "run", "valence")
    r = t.filter("vec_id <> 30").select(
        "vec_id", (F.col("run") + (F.col("vec_id") % 61 == 7).cast("int")).alias("run"),
        F.when(F.col("vec_id") % 83 == 2, "neutral").otherwise(F.col("valence")).alias("valence"))
    return V.misaligned(t, r, "vec_id", ["run", "valence"])


# the plan lists stimuli in event order; every 13th name was swapped
EVENTS = """
WITH pl AS (SELECT subject, run, row_number() OVER (PARTITION BY subject, run ORDER BY event_id) AS order_index,
   CASE WHEN event_id % 13 = 0 THEN 'S?' ELSE name END AS planned_name FROM run_events WHERE kind='signup'),
fx AS (SELECT subject, run, min(t_ms) AS fix_t, count(*) AS n_fix FROM run_events WHERE kind='view' GROUP BY ALL),
st AS (SELECT *, row_number() OVER w AS order_index, lag(t_ms) OVER w AS prev FROM run_events WHERE kind='signup'
   WINDOW w AS (PARTITION BY subject, run ORDER BY t_ms, event_id)),
ex AS (SELECT subject, run, order_index, name, t_ms - fix_t AS onset, n_fix, name IS NOT DISTINCT FROM planned_name AS name_ok,
   coalesce(t_ms > prev, true) AS increasing FROM st LEFT JOIN fx USING (subject, run) LEFT JOIN pl USING (subject, run, order_index))"""


def extracted(c):
    e = c.view("run_events")
    stim = V.time_index(e.filter("kind='signup'"), ["subject", "run"], "event_id", 1e6, [], "order_index")
    plan = stim.select("subject", "run", "order_index",
                       F.when(F.col("event_id") % 13 == 0, "S?").otherwise(F.col("name")).alias("planned_name"))
    return V.extract_events(e, plan, ["subject", "run"], "t_ms", "kind", "view", "signup", "name",
                            "event_id", 3.6e6)


@query("p15_event_extraction", EVENTS + " SELECT * FROM ex")
def p15(c):
    return extracted(c)


@query("p16_onset_audit", EVENTS + """,
g AS (SELECT subject, run, count(*) AS n_events, min(onset) AS first_onset, max(onset) AS last_onset,
  CASE WHEN coalesce(max(n_fix),0) <> 1 THEN 'fixation count' WHEN count(*) <> 1 THEN 'event count'
   WHEN NOT bool_and(name_ok) THEN 'plan mismatch' WHEN NOT bool_and(increasing) THEN 'not increasing' ELSE '' END AS message
  FROM ex GROUP BY subject, run)
SELECT *, CASE WHEN message='' THEN 'pass' ELSE 'fail' END AS status FROM g""")
def p16(c):
    return V.audit_onsets(extracted(c), ["subject", "run"], 1)


FROZEN = """SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN concat(text, ' ') WHEN doc_id % 10 = 4 THEN
 concat('#', substring(text, 2)) ELSE text END AS text FROM {documents}"""


@query("p17_content_identity", f"""
WITH f AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS fs, sha256(text) AS fh FROM ({FROZEN.replace('{documents}', 'documents')}))
SELECT doc_id, CASE WHEN octet_length(encode(text)) <> fs THEN 'size_changed' WHEN sha256(text) <> fh THEN 'content_changed'
  ELSE 'same' END AS status, octet_length(encode(text))::BIGINT AS size FROM documents JOIN f USING (doc_id)""")
def p17(c):
    frozen = c.spark.sql(sub(c, FROZEN)).select(
        "doc_id", F.octet_length("text").cast("bigint").alias("frozen_size"),
        F.sha2("text", 256).alias("frozen_sha256"))
    return V.content_identity(c.table("documents"), frozen, "doc_id", "text")


@query("p18_run_exclusion", """
WITH g AS (SELECT subject, count(DISTINCT CASE WHEN run IN (2, 7) THEN run END) AS n_found,
  count(DISTINCT CASE WHEN run NOT IN (2, 7) THEN run END) AS n_left FROM run_events GROUP BY subject)
SELECT * FROM g WHERE n_found < 2 OR n_left < 25""")
def p18(c):
    return V.excluded_run_issues(c.view("run_events"), "subject", "run", [2, 7], need=25)


@query("p19_single_session", """
SELECT subject, run, count(DISTINCT event_id % 2) AS n_sessions FROM run_events GROUP BY subject, run
HAVING count(DISTINCT event_id % 2) <> 1""")
def p19(c):
    return V.ambiguous_sessions(c.view("run_events").withColumn("session", F.col("event_id") % 2),
                                ["subject", "run"], "session")


@query("j1_stimulus_category", """
SELECT l_orderkey, l_linenumber, p_type AS category, coalesce(p_type IS NOT NULL, false) AS known
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey""")
def j1(c):
    dim = c.table("part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"),
                                                      F.col("p_type").alias("category"))
    known, unknown = C.lookup(c.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"),
                              dim, ["l_partkey"])
    return (known.withColumn("known", F.lit(True)).unionByName(
        unknown.withColumn("known", F.lit(False)), allowMissingColumns=True).drop("l_partkey"))


@query("j2_onset_metadata", """
SELECT onset_id, o.subject, emotion, ai, n_name AS image FROM onsets o JOIN nation ON o.subject % 30 = n_nationkey""")
def j2(c):
    img = c.table("nation").select(F.col("n_nationkey").cast("bigint").alias("code"), F.col("n_name").alias("image"))
    o = c.view("onsets").withColumn("code", F.col("subject") % 30)
    return o.join(img, "code").select("onset_id", "subject", "emotion", "ai", "image")


@query("j3_rating_master", """
SELECT l_orderkey, l_linenumber, l_quantity AS score, p_type AS type FROM lineitem
LEFT JOIN (SELECT * FROM part WHERE p_size % 2 = 0) ON l_partkey = p_partkey""")
def j3(c):
    master = c.table("part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("type"))
    return c.table("lineitem").join(master, "l_partkey", "left").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("score"), "type")


# some cells come twice, so that the check sees what is not one-to-one
TWICE = "SELECT * FROM pipeline_results UNION ALL SELECT * FROM pipeline_results WHERE subject % 7 = 3 AND contrast = 'R'"


@query("j4_side_by_side", f"""
WITH p AS ({TWICE}), s AS (SELECT pipeline, subject, roi, contrast, kind, max(accuracy) AS accuracy, count(*) AS n FROM p GROUP BY ALL)
SELECT subject, roi, contrast, kind, rnd(a.accuracy) AS accuracy_p0, rnd(b.accuracy) AS accuracy_p1,
 rnd(b.accuracy - a.accuracy) AS delta, abs(b.accuracy - a.accuracy) <= 0.0117 AS within_tolerance, a.n = 1 AND b.n = 1 AS one_to_one
FROM (SELECT * FROM s WHERE pipeline='p0') a JOIN (SELECT * FROM s WHERE pipeline='p1') b USING (subject, roi, contrast, kind)""")
def j4(c):
    p = c.sql(TWICE)
    return C.side_by_side(p.filter("pipeline='p0'"), p.filter("pipeline='p1'"),
                          ["subject", "roi", "contrast", "kind"], "accuracy", ("p0", "p1"), 0.0117)


def level_cells(c, line):
    d = c.sql(f"SELECT concat(flag, status) AS contrast, roi, subject, avg(accuracy) AS accuracy FROM acc "
              f"WHERE line % 2 = {line} GROUP BY concat(flag, status), roi, subject")
    g = G.one_sample(d, ["contrast", "roi"], "accuracy", 0.484)
    return g.withColumn("sig", F.col("p") < 0.05)


LEVEL = """(SELECT contrast, roi, mean, tp2(t, (n-1)) < 0.05 AS sig FROM (SELECT *, (mean-0.484)/(sd/sqrt(n)) AS t FROM (
 SELECT contrast, roi, count(*) AS n, avg(a) AS mean, stddev_samp(a) AS sd FROM (SELECT concat(flag, status) AS contrast,
 roi, subject, avg(accuracy) AS a FROM acc WHERE line % 2 = {i} GROUP BY ALL) GROUP BY contrast, roi)))"""


@query("j5_level_agreement", f"""
SELECT contrast, count(*) AS n_cells, count(*) FILTER (a.sig = b.sig) AS n_agree, rnd(avg(abs(a.mean-b.mean))) AS mean_abs_delta,
 count(*) FILTER (a.sig AND NOT b.sig) AS only_a, count(*) FILTER (NOT a.sig AND b.sig) AS only_b, count(*) FILTER (a.sig AND b.sig) AS "both"
FROM {LEVEL.format(i=0)} a JOIN {LEVEL.format(i=1)} b USING (contrast, roi) GROUP BY contrast""")
def j5(c):
    return C.agreement(level_cells(c, 0), level_cells(c, 1), ["contrast", "roi"], "mean", "sig", ["contrast"])


@query("j12_cohort_intersection", """
SELECT DISTINCT subject, status FROM acc WHERE line = 1 AND subject IN (SELECT subject FROM acc WHERE line = 7 AND flag = 'R' AND accuracy > 0.5)""")
def j12(c):
    a = c.view("acc")
    return C.in_both(a.filter("line = 1"), a.filter("line = 7 AND flag = 'R' AND accuracy > 0.5"),
                     ["subject"]).select("subject", "status").distinct()


@query("j14_dense_grid", "WITH " + GRID + """, n AS (SELECT subject, roi, concat(flag, status) AS contrast, count(*) AS n FROM acc
 WHERE accuracy > 0.5 GROUP BY ALL)
SELECT subject, roi, contrast, coalesce(n, 0) AS n FROM grid LEFT JOIN n USING (subject, roi, contrast)""")
def j14(c):
    a = c.view("acc")
    n = a.filter("accuracy > 0.5").groupBy("subject", "roi", F.concat("flag", "status").alias("contrast")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = V.dense_grid(a.select("subject").distinct(), {"roi": ROIS, "contrast": CONTRASTS})
    return V.fill_grid(n, grid, ["subject", "roi", "contrast"], {"n": 0})


@query("t7_key_set_algebra", "WITH " + GRID + """, o AS (SELECT DISTINCT subject, roi, concat(flag, status) AS contrast FROM acc WHERE line = 1)
SELECT subject, roi, contrast, 'missing' AS side FROM (SELECT * FROM grid EXCEPT SELECT * FROM o)
UNION ALL SELECT subject, roi, contrast, 'unexpected' FROM (SELECT * FROM o EXCEPT SELECT * FROM grid)""")
def t7(c):
    a = c.view("acc")
    grid = V.dense_grid(a.select("subject").distinct(), {"roi": ROIS, "contrast": CONTRASTS})
    o = a.filter("line = 1").select("subject", "roi", F.concat("flag", "status").alias("contrast"))
    return C.key_difference(grid, o, ["subject", "roi", "contrast"])


@query("t8_first_of_copies", """
SELECT subject, image, vec_id, run FROM trials QUALIFY row_number() OVER (PARTITION BY subject, image ORDER BY vec_id) = 1""")
def t8(c):
    return C.first_of(c.view("trials").select("subject", "image", "vec_id", "run"), ["subject", "image"], ["vec_id"])


STAGES = ["signup", "view", "click", "purchase", "error"]


@query("a33_stage_status", """
WITH d AS (SELECT subject, stage, arg_max(status, sequence) AS s FROM ledger_body WHERE event='completed' GROUP BY ALL),
w AS (SELECT subject, """ + ",".join(f"coalesce(max(s) FILTER (stage='{s}'), 'pending') AS {s}" for s in STAGES) + """
  FROM (SELECT DISTINCT subject FROM ledger_body) LEFT JOIN d USING (subject) GROUP BY subject)
SELECT *, CASE WHEN """ + " AND ".join(f"{s}='passed'" for s in STAGES) + """ THEN 'complete' ELSE 'incomplete' END AS overall, """ + " OR ".join(
    f"({b} <> 'pending' AND {a} <> 'passed')" for i, a in enumerate(STAGES) for b in STAGES[i + 1:]) + " AS order_violation FROM w")
def a33(c):
    return V.stage_status(c.view("ledger_body"), "subject", STAGES)


# the record as it was hashed, and as it is now (some edits, some cut links, one record lost)
CANON = ("concat('{\"event\":\"', event, '\",\"sequence\":', sequence, ',\"stage\":\"', stage, '\",\"status\":\"', "
         "status, '\",\"subject\":', subject, '}')")
LEDGER = f"""SELECT sequence, event, subject, stage, CASE WHEN sequence % 701 = 3 THEN 'edited' ELSE status END AS status,
  {{sha}} AS event_sha256, sequence % 503 = 9 AS cut, sequence % 1999 = 11 AS lost FROM ledger_body"""


def ledger(c):
    d = c.sql(LEDGER.format(sha=f"sha2({CANON}, 256)"))
    d = V.previous_row(d, [], "sequence", ["event_sha256"])
    return d.select("sequence", "event", "subject", "stage", "status", "event_sha256", "lost", F.when(
        F.col("cut"), "0").otherwise(F.col("prev_event_sha256")).alias("previous_event_sha256")).filter("NOT lost")


@query("w9_ledger_chain", f"""
WITH a AS ({LEDGER.format(sha=f'sha256({CANON})')}),
b AS (SELECT *, CASE WHEN cut THEN '0' ELSE lag(event_sha256) OVER (ORDER BY sequence) END AS previous FROM a),
l AS (SELECT *, lag(event_sha256) OVER (ORDER BY sequence) AS prev, lag(sequence) OVER (ORDER BY sequence) AS pseq FROM b WHERE NOT lost)
SELECT sequence, 'sequence_gap' AS issue FROM l WHERE sequence <> 1 AND pseq IS DISTINCT FROM sequence - 1
UNION ALL SELECT sequence, 'broken_link' FROM l WHERE pseq = sequence - 1 AND previous IS DISTINCT FROM prev
UNION ALL SELECT sequence, 'wrong_hash' FROM l WHERE event_sha256 <> sha256({CANON})""")
def w9(c):
    return V.ledger_issues(ledger(c), F.expr(CANON))
