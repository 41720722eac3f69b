"""Group statistics over result cells, maps and ratings."""

from pyspark.sql import functions as F

from voxtrail.functions.text import star_label
from voxtrail.operators import groupstats as G
from voxtrail.operators.ranks import bh_qvalues
from voxtrail.plans.registry import query

BH = ("least(1, min(p*n/rn) OVER (PARTITION BY {f} ORDER BY rn "
      "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


@query("a5_describe", """
SELECT contrast, roi, count(accuracy) AS n, rnd(avg(accuracy)) AS mean, rnd(stddev_samp(accuracy)) AS sd,
       rnd(min(accuracy)) AS min, rnd(max(accuracy)) AS max, rnd(median(accuracy)) AS median,
       CASE WHEN count(accuracy) >= 2 THEN rnd(stddev_samp(accuracy)/sqrt(count(accuracy))) END AS sem
FROM results GROUP BY contrast, roi""")
def a5(c):
    return G.describe(c.view("results"), ["contrast", "roi"], "accuracy")


@query("a6_collapse_kinds", """
SELECT pipeline, subject, CASE WHEN grouping(kind)=1 THEN 'overall' ELSE kind END AS kind,
       rnd(avg(accuracy)) AS mean, count(accuracy) AS n
FROM pipeline_results GROUP BY GROUPING SETS ((pipeline, subject, kind), (pipeline, subject))""")
def a6(c):
    return G.collapse_kinds(c.view("pipeline_results"), ["pipeline", "subject"], "kind", "accuracy")


TTEST = """
SELECT {keys}, n, rnd(mean) AS mean, rnd(sd) AS sd, rnd(sem) AS sem, rnd(t) AS t, rnd({p}) AS p FROM (
  SELECT *, sd/sqrt(n) AS sem, CASE WHEN n >= 2 AND sd > 0 THEN (mean-{mu})/(sd/sqrt(n)) END AS t FROM (
    SELECT {keys}, count({v}) AS n, avg({v}) AS mean, stddev_samp({v}) AS sd FROM {src} GROUP BY {keys}))"""


@query("a7_ttest_two_sided", TTEST.format(keys="contrast, roi", v="accuracy", mu="0.5", src="results",
                                          p="tp2(t, (n-1))"))
def a7(c):
    return G.one_sample(c.view("results"), ["contrast", "roi"], "accuracy", 0.5)


@query("a8_ttest_greater", TTEST.format(
    keys="contrast, roi", v="accuracy", mu="0.5", src="results",
    p="CASE WHEN t >= 0 THEN tp2(t, (n-1))/2 ELSE 1 - tp2(t, (n-1))/2 END"))
def a8(c):
    return G.one_sample(c.view("results"), ["contrast", "roi"], "accuracy", 0.5, greater=True)


@query("a9_paired_ttest", """
WITH w AS (SELECT roi, subject,
    avg(CASE WHEN contrast='AF' THEN accuracy END) AS a, avg(CASE WHEN contrast='NF' THEN accuracy END) AS b,
    avg(CASE WHEN contrast='RF' THEN accuracy END) AS r FROM results GROUP BY roi, subject),
d AS (SELECT roi, 'AF - NF' AS pair, a-b AS diff FROM w UNION ALL SELECT roi, 'RF - NF', r-b FROM w
      UNION ALL SELECT roi, 'AF - RF', a-r FROM w)
""" + TTEST.format(keys="roi, pair", v="diff", mu="0", src="d", p="tp2(t, (n-1))"))
def a9(c):
    return G.paired_tests(c.view("results"), ["roi"], "subject", "contrast", "accuracy",
                          [("AF", "NF"), ("RF", "NF"), ("AF", "RF")])


TWO = """
SELECT {keys}, avg(CASE WHEN {g} THEN {v} END) AS ma, var_samp(CASE WHEN {g} THEN {v} END) AS va,
  count(CASE WHEN {g} THEN {v} END) AS na, avg(CASE WHEN {h} THEN {v} END) AS mb,
  var_samp(CASE WHEN {h} THEN {v} END) AS vb, count(CASE WHEN {h} THEN {v} END) AS nb
FROM {src} GROUP BY {keys}"""


@query("a10_independent_ttest", "WITH s AS (" + TWO.format(
    keys="emotion", v="value", g="ai=0", h="ai=1",
    src="(SELECT onset_id % 3 AS emotion, ai, value FROM onsets JOIN samples ON onset_id = event_id)") + """)
SELECT emotion, rnd(ma) AS mean_a, rnd(mb) AS mean_b, na, nb, rnd(t) AS t, df, rnd(tp2(t, df)) AS p FROM (
 SELECT *, na+nb-2 AS df, (ma-mb)/sqrt(((na-1)*va+(nb-1)*vb)/(na+nb-2)*(1.0/na+1.0/nb)) AS t FROM s)""")
def a10(c):
    d = c.sql("SELECT emotion, ai, value FROM onsets JOIN samples ON onset_id = event_id")
    return G.independent_test(d.withColumn("emotion", F.col("emotion").cast("bigint")),
                              ["emotion"], "ai", 0, 1, "value")


D = ("CASE WHEN na>=2 AND nb>=2 AND sqrt(((na-1)*va+(nb-1)*vb)/(na+nb-2)) >= 1e-10 "
     "THEN (ma-mb)/sqrt(((na-1)*va+(nb-1)*vb)/(na+nb-2)) END")
EFFECTS = TWO.format(keys="concat('p', line % 3), subject, roi", v="accuracy", g="flag='A'", h="flag='N'",
                     src="acc").replace("SELECT concat('p', line % 3),",
                                        "SELECT concat('p', line % 3) AS pipeline,", 1)


def effects(c):
    d = c.sql("SELECT concat('p', line % 3) AS pipeline, subject, roi, flag, accuracy FROM acc")
    return G.effect_size(d, ["pipeline", "subject", "roi"], "flag", "A", "N", "accuracy")


@query("a11_cohens_d", f"WITH s AS ({EFFECTS}) SELECT pipeline, subject, roi, rnd({D}) AS d FROM s")
def a11(c):
    return effects(c)


@query("a12_compression_ratio", f"""
WITH s AS ({EFFECTS}), e AS (SELECT pipeline, subject, roi, {D} AS d FROM s),
m AS (SELECT subject, roi, abs(x.d) AS f, abs(y.d) AS g, abs(x.d)/nullif(abs(y.d),0) AS ratio
      FROM (SELECT * FROM e WHERE pipeline='p0') x JOIN (SELECT * FROM e WHERE pipeline='p1') y
      USING (subject, roi) WHERE x.d IS NOT NULL AND y.d IS NOT NULL)
SELECT roi, count(*) AS n_cells, rnd(avg(f)) AS mean_abs_first, rnd(avg(g)) AS mean_abs_second,
       rnd(avg(ratio)) AS mean_ratio, rnd(avg(least(ratio, 5.0))) AS mean_clipped_ratio,
       count(*) FILTER (ratio > 5.0) AS n_clipped, rnd(median(ratio)) AS median_ratio
FROM m GROUP BY roi""")
def a12(c):
    return G.compression(effects(c), ["subject", "roi"], ["roi"], "pipeline", "d", "p0", "p1", clip=5.0)


CELLS = """
WITH g AS (SELECT contrast, roi, count(DISTINCT subject) AS n_subjects, count(accuracy) AS k,
    avg(accuracy) AS mean, stddev_samp(accuracy) AS sd FROM results GROUP BY contrast, roi),
h AS (SELECT *, sd/sqrt(k) AS sem, (mean-0.5)/(sd/sqrt(k)) AS t FROM g),
i AS (SELECT *, tp2(t, (k-1)) AS p FROM h),
j AS (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY p) AS rn,
      count(*) OVER (PARTITION BY contrast) AS n FROM i),
cell AS (SELECT *, """ + BH.format(f="contrast") + " AS q FROM j)"


@query("a13_bh_fdr", CELLS + " SELECT contrast, roi, rnd(p) AS p, rnd(q) AS q FROM cell")
def a13(c):
    t = G.one_sample(c.view("results"), ["contrast", "roi"], "accuracy", 0.5)
    return bh_qvalues(t.select("contrast", "roi", "p"), "p", ["contrast"], "q")


@query("a14_group_cells", CELLS + """
SELECT contrast, roi, n_subjects, k AS n, rnd(mean) AS mean, rnd(sd) AS sd, rnd(sem) AS sem, rnd(t) AS t,
       rnd(p) AS p, rnd(q) AS q, q < 0.05 AS significant, n_subjects = 30 AS complete FROM cell""")
def a14(c):
    return G.group_cells(c.view("results"), "contrast", "roi", "subject", "accuracy",
                         expected_subjects=30)


VOX = """
WITH g AS (SELECT {keys}, voxel_id, count(value) AS k, avg(value) AS mean, stddev_samp(value) AS sd
   FROM {src} GROUP BY {keys}, voxel_id HAVING count(value) = {n}),
h AS (SELECT *, sd/sqrt(k) AS sem, CASE WHEN sd > 0 THEN mean/(sd/sqrt(k)) ELSE 0 END AS t FROM g),
i AS (SELECT *, CASE WHEN sd > 0 THEN tp2(t, (k-1)) ELSE 1 END AS p FROM h),
j AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY p) AS rn,
      count(*) OVER (PARTITION BY {keys}) AS n FROM i),
vox AS (SELECT *, """ + BH + """ AS q FROM j)"""
VOX1 = VOX.format(keys="contrast", src="subject_map", n=8, f="contrast")


@query("a15_voxel_group_map", VOX1 + """
SELECT contrast, voxel_id, k AS n, rnd(mean) AS mean, rnd(sd) AS sd, rnd(sem) AS sem, rnd(t) AS t, rnd(p) AS p,
       rnd(q) AS q, rnd(CASE WHEN q < 0.05 THEN t ELSE 0 END) AS t_thresholded FROM vox""")
def a15(c):
    return G.voxel_group_map(c.view("subject_map"), ["contrast"], "voxel_id", "value", 8)


SUMMARY = """count(*) FILTER (q < {q}) AS n_significant, rnd(count(*) FILTER (q < {q})*100.0/count(*)) AS pct_of_mask"""


@query("a15_voxel_map_summary", VOX1 + "SELECT contrast, count(*) AS mask_voxels," + SUMMARY.format(q=0.5) + """,
 count(*) FILTER (q < 0.5 AND t > 0) AS n_positive, count(*) FILTER (q < 0.5 AND t < 0) AS n_negative,
 rnd(max(t)) AS max_t, rnd(min(t)) AS min_t, rnd(min(q)) AS min_q FROM vox GROUP BY contrast""")
def a15_summary(c):
    g = G.voxel_group_map(c.view("subject_map"), ["contrast"], "voxel_id", "value", 8, 0.5)
    return G.voxel_map_summary(g, ["contrast"], 0.5)


@query("a16_group_mean_map", """
SELECT contrast, voxel_id, rnd(avg(value)) AS mean, rnd(stddev_pop(value)) AS sd, count(value) AS n_valid
FROM subject_map GROUP BY contrast, voxel_id""")
def a16(c):
    return G.group_mean_map(c.view("subject_map"), ["contrast", "voxel_id"], "value")


@query("a17_map_difference", """
WITH m AS (SELECT contrast, voxel_id, avg(value) AS v FROM subject_map GROUP BY ALL)
SELECT voxel_id, rnd(y.v - x.v) AS difference FROM (SELECT * FROM m WHERE contrast='F') x
JOIN (SELECT * FROM m WHERE contrast='O') y USING (voxel_id)""")
def a17(c):
    m = G.group_mean_map(c.view("subject_map"), ["contrast", "voxel_id"], "value")
    return G.map_difference(m, ["voxel_id"], "contrast", "F", "O", "mean")


@query("a18_spatial_summary", """
SELECT contrast, subject, count(value) AS n_valid, rnd(avg(value)) AS mean, rnd(stddev_samp(value)) AS sd,
  rnd(median(value)) AS median, rnd(quantile_cont(value,0.05)) AS q05, rnd(quantile_cont(value,0.95)) AS q95,
  rnd(avg(CASE WHEN value > 0.0871 THEN 1.0 ELSE 0.0 END)) AS fraction_above
FROM subject_map GROUP BY contrast, subject""")
def a18(c):
    return G.spatial_summary(c.view("subject_map"), ["contrast", "subject"], "value", 0.0871)


@query("a27_regressor_maxima", """
WITH b AS (SELECT CAST(l_linenumber AS INT) AS subject, l_partkey % 670 AS idx, l_extendedprice AS value FROM lineitem),
d AS (SELECT subject, value, CASE WHEN idx >= 660 THEN concat('Baseline', idx-659)
   WHEN idx % 66 < 60 THEN concat('Run', idx//66+1, '_StimMax')
   ELSE concat('Run', idx//66+1, '_Motion', idx % 66 - 59) END AS category FROM b)
SELECT subject, category, rnd(max(value)) AS value FROM d GROUP BY subject, category""")
def a27(c):
    d = c.sql("SELECT CAST(l_linenumber AS INT) AS subject, l_partkey % 670 AS idx, "
              "l_extendedprice AS value FROM {lineitem}".replace("{lineitem}",
              f"parquet.`{c.sf_dir}/lineitem.parquet`"))
    return (d.withColumn("category", G.regressor_category(F.col("idx")))
            .groupBy("subject", "category").agg(F.max("value").alias("value")))


@query("a30_rating_means", """
SELECT type, modality, dimension, rnd(avg(score)) AS mean, count(score) AS n FROM (
  SELECT type, modality, 'valence' AS dimension, valence AS score FROM ratings
  UNION ALL SELECT type, modality, 'arousal', arousal FROM ratings) GROUP BY ALL""")
def a30(c):
    long = c.view("ratings").unpivot(["picture", "type", "modality"], ["valence", "arousal"],
                                     "dimension", "score")
    return long.groupBy("type", "modality", "dimension").agg(
        F.avg("score").alias("mean"), F.count("score").alias("n"))


@query("a31_pupil_group_means", """
WITH u AS (SELECT emotion, ai, o.subject, avg(value) AS v FROM onsets o JOIN samples ON onset_id = event_id GROUP BY ALL)
SELECT emotion, ai, count(v) AS n, rnd(avg(v)) AS mean, rnd(stddev_samp(v)) AS sd,
       rnd(stddev_samp(v)/sqrt(count(v))) AS sem FROM u GROUP BY emotion, ai""")
def a31(c):
    d = c.sql("SELECT emotion, ai, o.subject, value FROM onsets o JOIN samples ON onset_id = event_id")
    return G.two_level_mean(d, ["emotion", "ai"], "subject", "value")


@query("a32_map_mean_test", """
WITH u AS (SELECT contrast, subject, avg(accuracy) AS v FROM results GROUP BY ALL),
g AS (SELECT contrast, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd, stddev_pop(v)/sqrt(count(v)) AS sem,
      min(v) AS min, max(v) AS max FROM u GROUP BY contrast),
h AS (SELECT *, (mean-0.51)/(sd/sqrt(n)) AS t FROM g), i AS (SELECT *, tp2(t, (n-1)) AS p FROM h)
SELECT contrast, n, rnd(mean) AS mean, rnd(sem) AS sem, rnd(min) AS min, rnd(max) AS max, rnd(t) AS t, rnd(p) AS p,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars FROM i""")
def a32(c):
    return G.map_mean_test(c.view("results"), ["contrast"], "subject", "accuracy", 0.51)


CASES = {"all": list(range(8)), "even": [0, 2, 4, 6], "first": [0, 1, 2, 3, 4]}
IN_CASE = ("(SELECT 'all' AS \"case\", 8 AS size, * FROM subject_map UNION ALL SELECT 'even', 4, * FROM subject_map"
           " WHERE subject % 2 = 0 UNION ALL SELECT 'first', 5, * FROM subject_map WHERE subject < 5)")


@query("a34_subset_cases", VOX.format(keys='"case", contrast', src=IN_CASE, n="max(size)",
                                      f='"case", contrast') + """
SELECT "case", contrast, CAST(max(k) AS INT) AS n_subjects, """ + SUMMARY.format(q=0.5) + """, rnd(max(t)) AS peak_t,
  rnd(min(q)) AS min_q FROM vox GROUP BY "case", contrast""")
def a34(c):
    return G.subset_map_summary(c.view("subject_map"), CASES, "subject", "contrast", "voxel_id",
                                "value", 0.5)


@query("a35_histogram", """
WITH e AS (SELECT subject, contrast, min(value) AS lo, max(value) AS hi, count(value) AS n FROM subject_map GROUP BY ALL),
d AS (SELECT subject, contrast, lo, hi, n, CAST(least(19, floor((value-lo)/((hi-lo)/20))) AS INT) AS bin
      FROM subject_map JOIN e USING (subject, contrast))
SELECT subject, contrast, bin, count(*) AS count, rnd(any_value(lo)+bin*any_value((hi-lo)/20)) AS left_edge,
  rnd(count(*)/(any_value(n)*any_value((hi-lo)/20))) AS density FROM d GROUP BY subject, contrast, bin""")
def a35(c):
    return G.histogram(c.view("subject_map"), ["subject", "contrast"], "value")


@query("a36_win_rate", """
WITH w AS (SELECT subject, roi, contrast, kind, avg(accuracy) FILTER (pipeline='p0') AS a,
   avg(accuracy) FILTER (pipeline='p1') AS b FROM pipeline_results GROUP BY ALL)
SELECT kind, count(a-b) AS n_cells, rnd(avg(a-b)) AS mean_difference, count(*) FILTER (a-b > 0) AS wins,
   rnd(count(*) FILTER (a-b > 0)/count(a-b)) AS win_rate FROM w GROUP BY kind""")
def a36(c):
    return G.win_rate(c.view("pipeline_results"), ["subject", "roi", "contrast", "kind"], ["kind"],
                      "pipeline", "p0", "p1", "accuracy")


@query("a37_baseline_deltas", """
WITH w AS (SELECT subject, roi, contrast, kind, avg(accuracy) FILTER (pipeline='p0') AS a,
   avg(accuracy) FILTER (pipeline='p1') AS b, avg(accuracy) FILTER (pipeline='p2') AS d
   FROM pipeline_results GROUP BY ALL)
SELECT subject, roi, contrast, kind, 'p1' AS pipeline, rnd(b-a) AS delta FROM w UNION ALL
SELECT subject, roi, contrast, kind, 'p2', rnd(d-a) FROM w""")
def a37(c):
    return G.baseline_deltas(c.view("pipeline_results"), ["subject", "roi", "contrast", "kind"],
                             "pipeline", "accuracy", "p0", ["p1", "p2"])


@query("j13_group_mask", """
SELECT contrast, voxel_id FROM subject_map WHERE isfinite(value) GROUP BY ALL HAVING count(DISTINCT subject) = 8""")
def j13(c):
    return G.group_mask(c.view("subject_map"), "voxel_id", "subject", 8, "value", ["contrast"])


@query("g4_star_label", CELLS + """
SELECT contrast, roi, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END
  AS stars FROM cell""")
def g4(c):
    t = G.one_sample(c.view("results"), ["contrast", "roi"], "accuracy", 0.5)
    return t.select("contrast", "roi", star_label(F.col("p")).alias("stars"))
