"""Pattern, normalisation and similarity queries."""

from pyspark.sql import functions as F

from voxtrail.functions import arrays as A
from voxtrail.operators import groupstats as G, patterns as P, report as R, similarity as M
from voxtrail.operators.decode import packed
from voxtrail.plans.registry import query

KEEP = ["vec_id", "subject", "source", "run", "valence", "image", "roi"]


def patterns(c, missing: bool = False):
    """Four regions of 16 features; ``missing`` sets some values to NULL (as view long_x)."""
    t = c.view("trials")
    d = P.slice_regions(t, "embedding", 16)
    if missing:
        d = d.withColumn("features", F.transform("features", lambda x, i: F.when(
            ((F.col("vec_id") % 9 == 4) & (i < 2)) | ((i == 15) & (F.col("vec_id") % 251 == 8)), None).otherwise(x)))
    return d


def long(c, missing=False):
    return P.explode_features(patterns(c, missing), KEEP)


@query("a1_condition_mean", """
SELECT subject, source, valence, roi, pos, rnd(avg(xn)) AS mean, count(xn) AS n FROM long_x GROUP BY ALL""")
def a1(c):
    return P.condition_mean(long(c, True), ["subject", "source", "valence", "roi", "pos"])


WEIGHTS = {"pleasant_vs_neutral": {"pleasant": 1, "neutral": -1}, "unpleasant_vs_neutral": {"unpleasant": 1, "neutral": -1},
           "emotional_vs_neutral": {"pleasant": .5, "unpleasant": .5, "neutral": -1}, "pleasant_vs_unpleasant": {"pleasant": 1, "unpleasant": -1}}


@query("a2_contrast_map", """
WITH m AS (SELECT subject, source, roi, pos, avg(x) FILTER (valence='pleasant') AS p, avg(x) FILTER (valence='unpleasant') AS u,
  avg(x) FILTER (valence='neutral') AS n FROM long_x GROUP BY subject, source, roi, pos)
SELECT subject, source, roi, pos, 'pleasant_vs_neutral' AS contrast, rnd(p-n) AS effect FROM m UNION ALL
SELECT subject, source, roi, pos, 'unpleasant_vs_neutral', rnd(u-n) FROM m UNION ALL
SELECT subject, source, roi, pos, 'emotional_vs_neutral', rnd((p+u)/2-n) FROM m UNION ALL
SELECT subject, source, roi, pos, 'pleasant_vs_unpleasant', rnd(p-u) FROM m""")
def a2(c):
    m = P.condition_mean(long(c), ["subject", "source", "valence", "roi", "pos"])
    return P.contrast_map(m, ["subject", "source", "roi", "pos"], "valence", "mean", WEIGHTS)


@query("a3_repeat_average", """
WITH u AS (SELECT source, roi, image, subject, avg(g) AS v FROM (SELECT vec_id, source, roi, image, subject, avg(x) AS g FROM long_x
  GROUP BY ALL) GROUP BY ALL)
SELECT source, roi, image, count(v) AS n, rnd(avg(v)) AS mean, rnd(stddev_samp(v)) AS sd, rnd(stddev_samp(v)/sqrt(count(v))) AS sem
FROM u GROUP BY source, roi, image""")
def a3(c):
    d = patterns(c).withColumn("g", A.mean(F.col("features")))
    return P.repeat_average(d, ["source", "roi"], "image", "subject", "g")


@query("a4_global_amplitude", "SELECT vec_id, roi, rnd(avg(x)) AS amplitude FROM long_x GROUP BY vec_id, roi")
def a4(c):
    return patterns(c).select("vec_id", "roi", A.mean(F.col("features")).alias("amplitude"))


@query("a28_signal_to_noise", """
WITH w AS (SELECT roi, valence, stddev_pop(x) AS s FROM long_x GROUP BY ALL), b AS (SELECT roi, valence, subject, avg(x) AS m FROM long_x GROUP BY ALL)
SELECT roi, rnd(within_sd) AS within_sd, rnd(between_sd) AS between_sd, rnd(between_sd/within_sd) AS snr FROM
 (SELECT roi, avg(s) AS within_sd FROM w GROUP BY roi) JOIN (SELECT roi, stddev_pop(m) AS between_sd FROM b GROUP BY roi) USING (roi)""")
def a28(c):
    return G.signal_to_noise(long(c), ["roi"], "valence", "subject", "x")


@query("a29_variability", """
WITH u AS (SELECT valence, run, subject, roi, pos, stddev_pop(xn) AS s FROM long_x GROUP BY ALL)
SELECT valence, run, n_values, rnd(mean_sd) AS mean_sd, rnd(overall_sd) AS overall_sd FROM
 (SELECT valence, run, avg(s) AS mean_sd FROM u GROUP BY ALL) JOIN
 (SELECT valence, run, count(xn) AS n_values, stddev_pop(xn) AS overall_sd FROM long_x GROUP BY ALL) USING (valence, run)""")
def a29(c):
    return G.variability(long(c, True), ["valence", "run"], ["subject", "roi", "pos"], "x")


@query("j6_region_membership", """
WITH mem AS (SELECT DISTINCT p_brand AS label, concat('group', CAST(substring(p_brand, 7) AS INT) % 6) AS roi FROM part)
SELECT voxel_id, roi FROM stat_map JOIN mem ON brand = label WHERE b > 0""")
def j6(c):
    m = c.view("stat_map")
    atlas = m.select("voxel_id", F.col("brand").alias("label"))
    members = atlas.select("label").distinct().withColumn(
        "roi", F.concat(F.lit("group"), F.substring("label", 7, 9).cast("int") % 6))
    return P.region_join(m.filter("b > 0").select("voxel_id"), atlas, members)


@query("p6_finite_features", """
SELECT subject, roi, pos FROM long_x GROUP BY ALL HAVING bool_and(xn IS NOT NULL)""")
def p6(c):
    return P.finite_voxels(long(c, True), ["subject", "roi"])


@query("p7_low_variance", """
SELECT subject, roi, h.run AS held, pos, rnd(stddev_pop(x)) AS sd FROM long_x l JOIN (SELECT unnest(range(5)) AS run) h ON l.run <> h.run
GROUP BY subject, roi, h.run, pos HAVING stddev_pop(x) > 0.117""")
def p7(c):
    return P.variable_voxels_outside(long(c), ["subject", "roi"], "run", 0.117, "held")


@query("p8_sphere_status", """
WITH v AS (SELECT subject, roi, pos, bool_and(xn IS NOT NULL) AS ok, var_pop(xn) AS v FROM long_x WHERE valence <> 'neutral' GROUP BY ALL),
g AS (SELECT subject, roi, count(*) FILTER (ok) AS n_finite, count(*) FILTER (ok AND v > 0) AS n_variable FROM v GROUP BY ALL)
SELECT *, CASE WHEN n_finite < 14 THEN 'too_few_finite_voxels' WHEN n_variable < 14 THEN 'too_few_variable_voxels' ELSE 'ok' END AS status FROM g""")
def p8(c):
    return P.sphere_status(long(c, True).filter("valence <> 'neutral'"), ["subject", "roi"], 14)


Z1 = """z1 AS (SELECT *, (x - avg(x) OVER (PARTITION BY vec_id, roi)) / stddev_pop(x) OVER (PARTITION BY vec_id, roi) AS z FROM long_x)"""


@query("v1_pattern_zscore", f"WITH {Z1} SELECT vec_id, roi, pos, rnd(z) AS z FROM z1")
def v1(c):
    return P.explode_features(P.pattern_zscore(patterns(c)), ["vec_id", "roi"]).withColumnRenamed("x", "z")


@query("v2_fold_zscore", """
WITH s AS (SELECT vec_id, roi, pos, x, count(x) OVER a - count(x) OVER r AS n, sum(x) OVER a - sum(x) OVER r AS s, sum(x*x) OVER a - sum(x*x) OVER r AS q
  FROM long_x WINDOW a AS (PARTITION BY subject, roi, pos), r AS (PARTITION BY subject, roi, pos, run))
SELECT vec_id, roi, pos, rnd((x - s/n) / sqrt(q/n - (s/n)*(s/n))) AS z FROM s""")
def v2(c):
    z = P.run_wise_zscore(long(c), ["subject", "roi"], "run")
    return z.select("vec_id", "roi", "pos", F.col("x").alias("z"))


@query("v3_source_zscore", f"""WITH {Z1} SELECT vec_id, roi, pos, rnd((z - avg(z) OVER w)/stddev_pop(z) OVER w) AS z FROM z1
WINDOW w AS (PARTITION BY subject, roi, source, pos)""")
def v3(c):
    z = P.normalise(patterns(c), "voxel_source", KEEP, ["subject", "roi"], "source")
    return z.select("vec_id", "roi", "pos", F.col("x").alias("z"))


@query("v4_normalisation_modes", f"""WITH {Z1}, t AS (SELECT subject, roi, pos, avg(x) FILTER (run < 4) AS m, stddev_pop(x) FILTER (run < 4) AS s,
  avg(z) FILTER (run < 4) AS mz, stddev_pop(z) FILTER (run < 4) AS sz FROM z1 GROUP BY subject, roi, pos),
u AS (SELECT subject, roi, source, pos, avg(z) AS mz2, stddev_pop(z) AS sz2 FROM z1 GROUP BY ALL),
a AS (SELECT * FROM z1 JOIN t USING (subject, roi, pos) JOIN u USING (subject, roi, source, pos))
SELECT 'no' AS mode, vec_id, roi, pos, rnd(x) AS x FROM a UNION ALL SELECT 'voxel', vec_id, roi, pos, rnd(z) FROM a UNION ALL
SELECT 'trial', vec_id, roi, pos, rnd((x-m)/s) FROM a UNION ALL SELECT 'voxel_trial', vec_id, roi, pos, rnd((z-mz)/sz) FROM a UNION ALL
SELECT 'source', vec_id, roi, pos, rnd((z-mz2)/sz2) FROM a UNION ALL SELECT 'voxel_source', vec_id, roi, pos, rnd((z-mz2)/sz2) FROM a""")
def v4(c):
    p, out = patterns(c), None
    for mode in P.MODES:
        d = P.normalise(p, mode, KEEP, ["subject", "roi"], "source", F.col("run") < 4).select(
            F.lit(mode).alias("mode"), "vec_id", "roi", "pos", "x")
        out = d if out is None else out.unionByName(d)
    return out


@query("v5_feature_variants", f"""WITH {Z1}, m AS (SELECT *, avg(x) OVER (PARTITION BY vec_id, roi) AS g FROM z1)
SELECT 'raw' AS kind, vec_id, roi, pos, rnd(x) AS x FROM m UNION ALL SELECT 'centred', vec_id, roi, pos, rnd(x-g) FROM m
UNION ALL SELECT 'patternz', vec_id, roi, pos, rnd(z) FROM m UNION ALL SELECT DISTINCT 'global', vec_id, roi, 0::INT, rnd(g) FROM m""")
def v5(c):
    p = patterns(c)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), P.variant(F.col("features"), k).alias("features"))
                                for k in ("raw", "global", "centred", "patternz")])).alias("k")
    return P.explode_features(p.select("vec_id", "roi", kinds).select("vec_id", "roi", "k.kind", "k.features"),
                              ["kind", "vec_id", "roi"])


@query("v6_pseudo_trials", """
WITH r AS (SELECT vec_id, ntile(3) OVER (PARTITION BY subject, source, valence ORDER BY vec_id) - 1 AS chunk FROM trials)
SELECT subject, source, valence, roi, chunk::INT AS chunk, pos, rnd(avg(x)) AS x, count(x) AS n FROM long_x JOIN r USING (vec_id) GROUP BY ALL""")
def v6(c):
    from voxtrail.operators.folds import chunks
    p = chunks(patterns(c), ["subject", "source", "valence", "roi"], "vec_id", 3)
    d = P.explode_features(p, ["subject", "source", "valence", "roi", "chunk"])
    return P.average_chunks(d, ["subject", "source", "valence", "roi", "chunk"]).drop("q")


RDM = """w AS (SELECT subject, roi, vec_id, pos, x - avg(x) OVER (PARTITION BY vec_id, roi) AS c FROM long_x),
u AS (SELECT subject, roi, vec_id, pos, c / sqrt(sum(c*c) OVER (PARTITION BY vec_id, roi)) AS u FROM w)"""


# the matrix is a result of pairs: it is made of images, a list that the design fixes
IMAGES = """im AS (SELECT subject, roi, image, pos, avg(x) AS x FROM long_x GROUP BY ALL),
wi AS (SELECT subject, roi, image, pos, x - avg(x) OVER (PARTITION BY subject, roi, image) AS c FROM im),
ui AS (SELECT subject, roi, image, pos, c / sqrt(sum(c*c) OVER (PARTITION BY subject, roi, image)) AS u FROM wi)"""


@query("v7_dissimilarity_matrix", f"""WITH {IMAGES}
SELECT a.subject, a.roi, a.image AS a, b.image AS b, rnd(1 - 0.5*(sum(a.u*b.u)+1)) AS dissimilarity FROM ui a JOIN ui b
 ON a.subject=b.subject AND a.roi=b.roi AND a.pos=b.pos AND a.image < b.image GROUP BY ALL""")
def v7(c):
    keys = ["subject", "roi", "image"]
    means = P.explode_features(patterns(c), keys).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    return M.dissimilarity(packed(means, keys, "x", "features"), ["subject", "roi"], "image")


@query("v8_dissimilarity_correlation", f"""WITH {RDM},
d AS (SELECT a.roi, a.vec_id AS a, b.vec_id AS b, 1-0.5*(sum(a.u*b.u)+1) AS d
 FROM u a JOIN u b ON a.roi=b.roi AND a.pos=b.pos AND a.vec_id < b.vec_id GROUP BY ALL)
SELECT x.roi AS region_a, y.roi AS region_b, count(*) AS n_pairs, rnd(corr(x.d, y.d)) AS r FROM d x JOIN d y USING (a, b) WHERE x.roi < y.roi GROUP BY ALL""")
def v8(c):
    """Every pair of the four regions."""
    e = F.col("embedding").cast("array<double>")
    d = c.view("trials").select("vec_id", *[F.slice(e, 16 * k + 1, 16).alias(f"r{k}") for k in range(4)])
    return M.dissimilarity_correlations(d, ["r0", "r1", "r2", "r3"])


@query("v9_matched_correlation", """
WITH m AS (SELECT valence, run, subject, source, roi, pos, avg(x) AS x FROM long_x GROUP BY ALL)
SELECT valence, run, subject, roi, rnd(corr(n.x, a.x)) AS r FROM (SELECT * FROM m WHERE source='natural') n
 JOIN (SELECT * FROM m WHERE source='ai') a USING (valence, run, subject, roi, pos) GROUP BY valence, run, subject, roi""")
def v9(c):
    keys = ["valence", "run", "subject", "roi"]
    m = long(c).groupBy(*keys, "source", "pos").agg(F.avg("x").alias("x"))
    f = m.groupBy(*keys, "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("features"))
    return M.matched_correlation(f.filter("source='natural'"), f.filter("source='ai'"), keys)


PAIRS = """pr AS (SELECT subject, voxel_id, any_value(round(value,9)) FILTER (contrast='F') AS a, any_value(round(value,9)) FILTER (contrast='O') AS b
 FROM subject_map GROUP BY subject, voxel_id)"""


def pairs(c):
    return G.pivot_values(c.view("subject_map"), ["subject", "voxel_id"], "contrast", "value", ["F", "O"]).select(
        "subject", "voxel_id", F.round("F", 9).alias("a"), F.round("O", 9).alias("b"))


@query("v10_map_similarity", f"""WITH {PAIRS}, f AS (SELECT * FROM pr WHERE a IS NOT NULL AND b IS NOT NULL AND (a <> 0 OR b <> 0)),
k AS (SELECT *, rank() OVER (PARTITION BY subject ORDER BY a) + (count(*) OVER (PARTITION BY subject, a) - 1)/2 AS ra,
  rank() OVER (PARTITION BY subject ORDER BY b) + (count(*) OVER (PARTITION BY subject, b) - 1)/2 AS rb FROM f),
g AS (SELECT subject, count(*) AS n, corr(a,b) AS r, corr(ra,rb) AS s, sum(a*b)/sqrt(sum(a*a)*sum(b*b)) AS cs,
  avg(CASE WHEN a*b <> 0 THEN CASE WHEN sign(a)=sign(b) THEN 1.0 ELSE 0.0 END END) AS sg, avg(abs(a-b)) AS mad, sqrt(avg((a-b)*(a-b))) AS rms FROM k GROUP BY subject),
t AS (SELECT *, r*sqrt((n-2)/(1-r*r)) AS tr, s*sqrt((n-2)/(1-s*s)) AS ts FROM g)
SELECT subject, n AS n_voxels, rnd(r) AS pearson_r, rnd(s) AS spearman_r, rnd(cs) AS cosine, rnd(sg) AS sign_agreement, rnd(mad) AS mean_abs_difference,
 rnd(rms) AS rms_difference, rnd(tp2(tr, (n-2))) AS pearson_p, rnd(tp2(ts, (n-2))) AS spearman_p FROM t""")
def v10(c):
    return M.map_similarity(pairs(c), ["subject"], "a", "b")


CORR = f"WITH {PAIRS}, r AS (SELECT subject, voxel_id % 5 AS region, count(*) AS n, corr(a,b) AS r, max(abs(a-b)) AS mx FROM pr WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)"


@query("v11_map_correlation_fisher", CORR + """
SELECT region, count(r) AS n, rnd(tanh(avg(atanh(r)))) AS fisher_mean_r, rnd(avg(r)) AS mean_r, rnd(stddev_samp(atanh(r))/sqrt(count(r))) AS sem_z
FROM r GROUP BY region""")
def v11(c):
    r = M.map_correlation(pairs(c).withColumn("region", F.col("voxel_id") % 5), ["region", "subject"], "a", "b")
    return G.fisher_mean(r, ["region"], "r")


@query("v13_group_weight_map", """
WITH z AS (SELECT contrast, subject, voxel_id, (value - avg(value) OVER w)/stddev_pop(value) OVER w AS z FROM subject_map
 WINDOW w AS (PARTITION BY contrast, subject))
SELECT contrast, voxel_id, rnd(sum(z)) AS total, count(z) AS n, rnd(avg(z)) AS mean FROM z GROUP BY contrast, voxel_id""")
def v13(c):
    return M.group_weight_map(c.view("subject_map"), ["contrast"], "subject", "voxel_id", "value", True)


BRUTE = """u AS (SELECT subject, roi, valence, vec_id, pos, xn FROM long_x),
p AS (SELECT a.subject, a.roi, a.valence AS va, b.valence AS vb, a.vec_id AS ia, b.vec_id AS ib, corr(a.xn, b.xn) AS r, count(*) AS k FROM u a JOIN u b
 ON a.subject=b.subject AND a.roi=b.roi AND a.pos=b.pos AND a.vec_id <> b.vec_id WHERE a.xn IS NOT NULL AND b.xn IS NOT NULL GROUP BY ALL)"""


@query("v15_within_consistency", f"""WITH {BRUTE}
SELECT subject, roi, va AS valence, rnd(avg(r)) AS mean_r, count(*) AS n_pairs FROM p WHERE va=vb AND ia < ib AND k >= 10 GROUP BY ALL""")
def v15(c):
    return M.within_similarity(patterns(c, True), ["subject", "roi", "valence"], 10)


@query("v15_shuffled_consistency", f"""
WITH s AS (SELECT vec_id, subject, row_number() OVER (PARTITION BY subject ORDER BY h32('sort|'||vec_id), vec_id) AS hr FROM trials),
n AS (SELECT subject, valence, row_number() OVER (PARTITION BY subject ORDER BY valence, vec_id) AS hr FROM trials),
lab AS (SELECT vec_id, n.valence AS shuffled FROM s JOIN n USING (subject, hr)),
w AS (SELECT l.subject, roi, shuffled, vec_id, pos, x - avg(x) OVER (PARTITION BY vec_id, roi) AS c FROM long_x l JOIN lab USING (vec_id)),
u AS (SELECT *, c / sqrt(sum(c*c) OVER (PARTITION BY vec_id, roi)) AS u FROM w),
p AS (SELECT a.subject, a.roi, a.shuffled, a.vec_id AS i, b.vec_id AS j, sum(a.u*b.u) AS r FROM u a JOIN u b ON a.subject=b.subject AND a.roi=b.roi
  AND a.pos=b.pos AND a.shuffled=b.shuffled AND a.vec_id < b.vec_id GROUP BY ALL)
SELECT subject, roi, shuffled, rnd(avg(r)) AS mean_r, count(*) AS n_pairs FROM p GROUP BY ALL""")
def v15_shuffled(c):
    from voxtrail.operators.permute import shuffle_labels
    lab = shuffle_labels(c.view("trials").select("vec_id", "subject", "valence"), ["subject"], "valence",
                         "vec_id", [F.lit("sort")], "shuffled").select("vec_id", "shuffled")
    return M.within_similarity(patterns(c).join(lab, "vec_id"), ["subject", "roi", "shuffled"], 10)


@query("v24_cross_condition_similarity", f"""WITH {BRUTE}
SELECT subject, roi, rnd(avg(r)) AS mean_r, count(*) AS n_pairs FROM p WHERE va='pleasant' AND vb='neutral' AND k > 10 GROUP BY subject, roi""")
def v24(c):
    return M.cross_similarity(patterns(c, True), ["subject", "roi"], "valence", "pleasant", "neutral", 11)


@query("v25_top_proportion", f"""WITH {PAIRS}, f AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY abs(a) DESC, voxel_id) AS rn,
  count(*) OVER (PARTITION BY subject) AS n FROM pr WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT subject, count(*) AS n_full, rnd(corr(a,b)) AS full_r, count(*) FILTER (rn <= greatest(3, round_even(n*0.3, 0))) AS n_top,
 rnd(corr(a,b) FILTER (rn <= greatest(3, round_even(n*0.3, 0)))) AS top_r,
 rnd(corr(a,b) FILTER (rn <= greatest(3, round_even(n*0.3, 0))) - corr(a,b)) AS top_minus_full FROM f GROUP BY subject""")
def v25(c):
    return M.top_map_correlation(pairs(c), ["subject"], "voxel_id", "a", "b", 0.3)


@query("v26_group_definitions", CORR + """,
m AS (SELECT voxel_id, avg(a) AS a, avg(b) AS b FROM pr GROUP BY voxel_id), g1 AS (SELECT voxel_id % 5 AS region, corr(a,b) AS g FROM m GROUP BY ALL),
g2 AS (SELECT region, count(r) AS n, avg(r) AS mr, stddev_samp(r) AS sr, avg(atanh(r)) AS mz, stddev_samp(atanh(r)) AS sz FROM r GROUP BY region),
t AS (SELECT *, mr/(sr/sqrt(n)) AS t1, mz/(sz/sqrt(n)) AS t2 FROM g1 JOIN g2 USING (region))
SELECT region, n, rnd(g) AS group_map_r, rnd(mr) AS mean_r, rnd(tanh(mz)) AS fisher_r,
 rnd(CASE WHEN t1 >= 0 THEN tp2(t1, (n-1))/2 ELSE 1-tp2(t1, (n-1))/2 END) AS p_raw,
 rnd(CASE WHEN t2 >= 0 THEN tp2(t2, (n-1))/2 ELSE 1-tp2(t2, (n-1))/2 END) AS p_fisher FROM t""")
def v26(c):
    return M.group_definitions(pairs(c).withColumn("region", F.col("voxel_id") % 5), ["region"], "subject",
                               "voxel_id", "a", "b")


@query("v27_map_stability", CORR + " SELECT subject, region, n, rnd(r) AS r, rnd(mx) AS max_abs_difference FROM r")
def v27(c):
    return M.map_correlation(pairs(c).withColumn("region", F.col("voxel_id") % 5), ["subject", "region"], "a", "b")


AXIS = "SELECT '{a}' AS axis, rnd(avg(m)) AS mean_of_means, rnd(stddev_pop(m)) AS sd_of_means, rnd(avg(s)) AS mean_of_sds, rnd(stddev_pop(s)) AS sd_of_sds, abs(avg(m)) < 0.01 AND abs(avg(s)-1) < 0.1 AS normalised FROM (SELECT {f}, avg(z) AS m, stddev_pop(z) AS s FROM z1 GROUP BY {f})"


@query("v28_normalised_axis", f"WITH {Z1} " + " UNION ALL ".join(AXIS.format(a=a, f=f) for a, f in [
    ("subject", "valence, run, roi, pos"), ("condition", "subject, run, roi, pos"), ("trial", "subject, valence, roi, pos"), ("run", "subject, valence, run, roi, pos"), ("voxel", "vec_id, roi")]))
def v28(c):
    z = P.explode_features(P.pattern_zscore(patterns(c)), KEEP)
    return P.normalised_axis(z, {
        "subject": ["valence", "run", "roi", "pos"], "condition": ["subject", "run", "roi", "pos"],
        "trial": ["subject", "valence", "roi", "pos"], "run": ["subject", "valence", "run", "roi", "pos"],
        "voxel": ["vec_id", "roi"]})


@query("t1_top_features", """
WITH r AS (SELECT subject, contrast, voxel_id, abs(round(value,9)) AS s, row_number() OVER (PARTITION BY subject, contrast ORDER BY abs(round(value,9)) DESC, voxel_id) AS rank,
  count(*) OVER (PARTITION BY subject, contrast) AS n FROM subject_map)
SELECT subject, contrast, voxel_id, rank FROM r WHERE rank <= least(n, greatest(20, ceil(n*0.1)))""")
def t1(c):
    d = c.view("subject_map").withColumn("s", F.abs(F.round("value", 9)))
    return R.top_fraction(d, ["subject", "contrast"], "voxel_id", "s", 0.1, 20).select("subject", "contrast", "voxel_id", "rank")
