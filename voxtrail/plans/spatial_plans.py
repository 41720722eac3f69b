"""Grids, maps, regions."""

from pyspark.sql import functions as F

from voxtrail.functions import text
from voxtrail.operators import groupstats as G, report as R, spatial as S
from voxtrail.plans.registry import query

VM = """vm AS (SELECT voxel_id, avg(value) FILTER (contrast='F') AS f, avg(value) FILTER (contrast='O') AS o FROM subject_map GROUP BY voxel_id),
vv AS (SELECT m.*, i*2.0-9.1 AS x, j*2.0-7.3 AS y, k*2.0-11.7 AS z, f, o FROM stat_map m LEFT JOIN vm USING (voxel_id))"""


def maps(c):
    """Grid voxels with coordinates and two group-mean maps."""
    m = c.view("stat_map").withColumns({"x": F.col("i") * 2.0 - 9.1, "y": F.col("j") * 2.0 - 7.3, "z": F.col("k") * 2.0 - 11.7})
    g = G.pivot_values(c.view("subject_map"), ["voxel_id"], "contrast", "value", ["F", "O"])
    return m.join(g.select("voxel_id", F.col("F").alias("f"), F.col("O").alias("o")), "voxel_id", "left")


@query("j7_nearest_transfer", """
WITH a AS (SELECT voxel_id, CAST(round_even((i*2.0-9.1+9.0)/3.1, 0) AS BIGINT) AS i, CAST(round_even((j*2.0-7.3+7.0)/3.1, 0) AS BIGINT) AS j,
  CAST(round_even((k*2.0-11.7+12.0)/3.1, 0) AS BIGINT) AS k FROM stat_map)
SELECT a.voxel_id, coalesce(m.roi_id, 0) AS roi_id FROM a LEFT JOIN stat_map m USING (i, j, k)""")
def j7(c):
    return S.transfer_nearest(maps(c).select("voxel_id", "x", "y", "z"), c.view("stat_map").select("i", "j", "k", "roi_id"),
                              (-9.0, -7.0, -12.0), (3.1, 3.1, 3.1), "roi_id", 0).select("voxel_id", "roi_id")


@query("j8_atlas_overlay", """
WITH m AS (SELECT voxel_id, CASE WHEN b > 10 THEN parent ELSE brand END AS label, (b > 10)::INT AS layer FROM stat_map)
SELECT voxel_id, label, dense_rank() OVER (ORDER BY layer, label)::INT AS roi_id FROM m""")
def j8(c):
    m = c.view("stat_map")
    return S.overlay(m.select("voxel_id", F.col("brand").alias("label")),
                     m.filter("b > 10").select("voxel_id", F.col("parent").alias("label")), "voxel_id", "label")


@query("j9_radius_join", """
SELECT a.voxel_id AS centre, b.voxel_id FROM stat_map a JOIN stat_map b ON a.k BETWEEN b.k-2 AND b.k+2
 AND (a.i-b.i)*(a.i-b.i)*4+(a.j-b.j)*(a.j-b.j)*4+(a.k-b.k)*(a.k-b.k)*4 <= 16.01""")
def j9(c):
    return S.lattice_neighbours(c.view("stat_map"), "voxel_id", 4.0, (2.0, 2.0, 2.0))


PT = "pt AS (SELECT voxel_id, a * 1.71 AS px, b * 0.613 AS py, k * 1.37 + roi_id * 0.11 AS pz FROM stat_map)"


@query("j9_irregular_points", f"""WITH {PT} SELECT a.voxel_id AS centre, b.voxel_id AS neighbour FROM pt a JOIN pt b
 ON (a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py)+(a.pz-b.pz)*(a.pz-b.pz) <= 6.25""")
def j9_points(c):
    p = c.view("stat_map").select("voxel_id", (F.col("a") * 1.71).alias("px"), (F.col("b") * 0.613).alias("py"),
                                  (F.col("k") * 1.37 + F.col("roi_id") * 0.11).alias("pz"))
    return S.point_neighbours(p, "voxel_id", ["px", "py", "pz"], 2.5)


# sigma = 4.3 / sqrt(8 ln 2) / 2 voxels, weights reach int(4 sigma + 0.5) = 4 voxels
TAPS = """sg AS (SELECT 4.3/sqrt(8*ln(2))/2 AS s), tp AS (SELECT o, exp(-o*o/(2*s*s)) AS e FROM (SELECT unnest(range(-4,5)) AS o), sg),
tw AS (SELECT o, e/(SELECT sum(e) FROM tp) AS g FROM tp)"""


@query("v16_smoothing", f"""WITH {TAPS}, mk AS (SELECT voxel_id, i, j, k, a FROM stat_map WHERE b > -15)
SELECT t.voxel_id, rnd(sum(s.a*x.g*y.g*z.g)/sum(x.g*y.g*z.g)) AS smoothed FROM mk t JOIN mk s ON s.k BETWEEN t.k-4 AND t.k+4 AND s.i BETWEEN t.i-4 AND t.i+4
 AND s.j BETWEEN t.j-4 AND t.j+4 JOIN tw x ON x.o = s.i-t.i JOIN tw y ON y.o = s.j-t.j JOIN tw z ON z.o = s.k-t.k GROUP BY t.voxel_id""")
def v16(c):
    m = c.view("stat_map").filter("b > -15").select("voxel_id", "i", "j", "k", "a")
    return S.smooth(m, [], "a", 4.3, (2.0, 2.0, 2.0)).select("voxel_id", "smoothed")


COMP = """WITH RECURSIVE hot AS (SELECT voxel_id AS v, i, j, k, b FROM stat_map WHERE b > 22),
edge AS (SELECT a.v AS p, b.v AS q FROM hot a JOIN hot b ON abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND abs(a.k-b.k) <= 1),
reach AS (SELECT v AS p, v AS q FROM hot UNION SELECT r.p, e.q FROM reach r JOIN edge e ON r.q = e.p),
lab AS (SELECT p AS voxel_id, min(q) AS label FROM reach GROUP BY p)"""


@query("v17_components", COMP + " SELECT voxel_id, label FROM lab")
def v17(c):
    return S.components(c.view("stat_map").filter("b > 22"), [], "voxel_id")


@query("v17_cluster_table", COMP + """ SELECT label, count(*) AS n_voxels, min(voxel_id) FILTER (b = mx) AS peak_voxel, rnd(max(b)) AS peak_value
FROM (SELECT *, max(b) OVER (PARTITION BY label) AS mx FROM lab JOIN hot ON v = voxel_id) GROUP BY label HAVING count(*) >= 4""")
def v17_table(c):
    hot = c.view("stat_map").filter("b > 22")
    return S.cluster_table(S.components(hot, [], "voxel_id").join(hot.select("voxel_id", "b"), "voxel_id"), [], "voxel_id", "b", 4)


@query("v17_peak_regions", COMP + """ SELECT c.*, m.brand AS peak_region FROM (SELECT label, count(*) AS n_voxels, min(voxel_id) FILTER (b = mx) AS peak_voxel, rnd(max(b)) AS peak_value
FROM (SELECT *, max(b) OVER (PARTITION BY label) AS mx FROM lab JOIN hot ON v = voxel_id) GROUP BY label HAVING count(*) >= 4) c LEFT JOIN stat_map m ON m.voxel_id = peak_voxel""")
def v17_peaks(c):
    return S.label_peaks(v17_table(c), c.view("stat_map"), "voxel_id", "brand")


@query("v18_paint_regions", """
WITH r AS (SELECT CAST(substring(roi, 4) AS INT) AS roi_id, avg(accuracy) AS accuracy FROM results GROUP BY roi)
SELECT voxel_id, m.roi_id, rnd(accuracy) AS accuracy FROM stat_map m LEFT JOIN r USING (roi_id)""")
def v18(c):
    r = c.view("results").groupBy(F.substring("roi", 4, 9).cast("int").alias("roi_id")).agg(F.avg("accuracy").alias("accuracy"))
    return S.paint(c.view("stat_map").select("voxel_id", "roi_id"), r, "roi_id")


@query("t2_map_peak", f"""WITH {VM} SELECT parent, voxel_id, i, j, k, rnd(f) AS f FROM vv WHERE f IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY parent ORDER BY abs(f) DESC, voxel_id) = 1""")
def t2(c):
    return R.peak(maps(c), ["parent"], "f", "voxel_id", ["i", "j", "k"])


@query("a21_volume_similarity", f"""WITH {VM}, e AS (SELECT coalesce(round(f, 1), 0) AS x, coalesce(round(o, 1), 0) AS y FROM vv),
g AS (SELECT 2*count(*) FILTER (x>0 AND y>0)/(count(*) FILTER (x>0)+count(*) FILTER (y>0)) AS d, avg((x=y)::INT) AS m, corr(x,y) AS r FROM e)
SELECT rnd(d) AS dice, rnd(m) AS match_fraction, rnd(r) AS correlation, d >= 0.99 AS dice_pass, m >= 0.99 AS match_pass, r >= 0.99 AS correlation_pass FROM g""")
def a21(c):
    m = maps(c).select("voxel_id", F.round("f", 1).alias("f"), F.round("o", 1).alias("o"))
    left, right = m.filter("f IS NOT NULL").select("voxel_id", "f"), m.select("voxel_id", "o")
    return S.compare_volumes(left.join(right, "voxel_id", "full"), "f", "o")


@query("a22_conjunction", f"""WITH {VM} SELECT parent, count(*) FILTER (f>0) AS n_a, count(*) FILTER (o>0) AS n_b, count(*) FILTER (f>0 AND o>0) AS n_both,
 rnd(2*count(*) FILTER (f>0 AND o>0)/(count(*) FILTER (f>0)+count(*) FILTER (o>0))) AS dice FROM vv GROUP BY parent""")
def a22(c):
    return S.conjunction(maps(c), ["parent"], "f", "o")


OVER = f"""{VM}, sz AS (SELECT brand, count(*) AS roi_voxels FROM vv GROUP BY brand), ov AS (SELECT brand, count(*) AS n, sum((f+o)/2) AS w, sum((f+o)/2*x) AS wx,
 sum((f+o)/2*y) AS wy, sum((f+o)/2*z) AS wz, avg((f+o)/2) AS mp, max((f+o)/2) AS xp, avg(f) AS ma, avg(o) AS mb FROM vv WHERE f>0 AND o>0 GROUP BY brand)"""


@query("a23_region_overlap", f"""WITH {OVER} SELECT brand, n AS overlap_voxels, rnd(wx/w) AS centre_x, rnd(wy/w) AS centre_y, rnd(wz/w) AS centre_z, rnd(mp) AS mean_pair,
 rnd(xp) AS max_pair, rnd(ma) AS mean_a, rnd(mb) AS mean_b, roi_voxels, rnd(n*8e0) AS overlap_volume, rnd(100.0*n/roi_voxels) AS percent_of_roi FROM ov JOIN sz USING (brand)""")
def a23(c):
    return S.region_overlap(maps(c), ["brand"], "f", "o", ["x", "y", "z"], 8.0)


@query("t3_sorted_overlap", f"WITH {OVER} SELECT brand, n AS overlap_voxels, rnd(mp) AS mean_pair, row_number() OVER (ORDER BY n DESC, round(mp, 9) DESC, brand) AS place FROM ov")
def t3(c):
    o = S.region_overlap(maps(c), ["brand"], "f", "o", ["x", "y", "z"], 8.0)
    return R.sorted_table(o.select("brand", "overlap_voxels", "mean_pair"), [F.desc("overlap_voxels"), F.desc(F.round("mean_pair", 9)), F.asc("brand")])


MERGED = f"""{VM}, nm AS (SELECT *, concat(replace(parent, '#', ''), '_', roi_id % 3) AS nm FROM vv), sz AS (SELECT parent AS merged, count(*) AS roi_voxels FROM nm GROUP BY parent),
mg AS (SELECT parent AS merged, string_agg(DISTINCT nm, ', ' ORDER BY nm) AS members, count(*) AS pv, sum(f*x)/sum(f) AS cx, sum(f*y)/sum(f) AS cy, sum(f*z)/sum(f) AS cz,
 avg(f) AS mv, max(f) AS xv FROM nm WHERE f > 0 GROUP BY parent)"""


def merged(c):
    return S.merged_regions(maps(c).withColumn("nm", F.concat("parent", F.lit("_"), (F.col("roi_id") % 3).cast("string"))),
                            "nm", "f", ["x", "y", "z"], 8.0)


@query("a24_merged_regions", f"""WITH {MERGED} SELECT merged, members, pv AS positive_voxels, rnd(cx) AS centre_x, rnd(cy) AS centre_y, rnd(cz) AS centre_z, rnd(mv) AS mean_value,
 rnd(xv) AS max_value, roi_voxels, rnd(pv*8e0) AS positive_volume, rnd(100.0*pv/roi_voxels) AS percent_positive FROM mg JOIN sz USING (merged)""")
def a24(c):
    return merged(c)


NAMES = """CASE roi_id % 8 WHEN 0 THEN 'Calcarine_L' WHEN 1 THEN 'ParaHippocampal_R' WHEN 2 THEN 'Frontal_Sup' WHEN 3 THEN 'Vermis_3' WHEN 4 THEN 'Insula_L'
 WHEN 5 THEN 'Precuneus_L' WHEN 6 THEN 'Thalamus' ELSE 'Unknown' END"""


@query("a25_majority_label", f"""WITH n AS (SELECT concat('k', k) AS region, roi_id - 4 AS lid, {NAMES} AS name FROM stat_map), c AS (SELECT region, lid, name, count(*) AS c FROM n GROUP BY ALL),
t AS (SELECT region, sum(c) AS n FROM c GROUP BY region), b AS (SELECT * FROM c WHERE lid > 0 QUALIFY row_number() OVER (PARTITION BY region ORDER BY c DESC, lid) = 1)
SELECT region, coalesce(name, '') AS label, coalesce(c, 0) AS label_voxels, rnd(coalesce(100.0*c/n, 0)) AS label_percent,
 CASE name WHEN 'Calcarine_L' THEN 'Occipital' WHEN 'ParaHippocampal_R' THEN 'Medial temporal' WHEN 'Frontal_Sup' THEN 'Frontal/Motor' WHEN 'Vermis_3' THEN 'Cerebellum'
 WHEN 'Insula_L' THEN 'Insula' WHEN 'Precuneus_L' THEN 'Occipital' WHEN 'Thalamus' THEN 'Subcortical' ELSE 'Other' END AS lobe FROM t LEFT JOIN b USING (region)""")
def a25(c):
    d = c.view("stat_map").select(F.concat(F.lit("k"), "k").alias("region"), (F.col("roi_id") - 4).alias("lid"), F.expr(NAMES).alias("name"))
    return S.majority_label(d, ["region"], "lid", "name").withColumn("lobe", S.lobe(F.col("label")))


@query("a26_atlas_overlap", f"""WITH {VM}, n AS (SELECT count(*) FILTER (f > 0.1) AS roi_voxels FROM vv), g AS (SELECT brand, count(*) FILTER (f > 0.1) AS overlap, count(*) AS region_voxels FROM vv GROUP BY brand)
SELECT brand, overlap, region_voxels, roi_voxels, rnd(100.0*overlap/roi_voxels) AS percent_of_roi, rnd(100.0*overlap/region_voxels) AS percent_of_region FROM g, n WHERE overlap > 0""")
def a26(c):
    return S.atlas_overlap(maps(c), F.col("f") > 0.1, "brand")


@query("t5_wide_summary", """
WITH r AS (SELECT flag AS c, roi, avg(accuracy) AS a, count(*) AS n FROM acc GROUP BY ALL)
SELECT roi, """ + ", ".join(f"max(format('{{}}, {{}}, {{}}', round(n/10)::INT, round(n/7)::INT, round(a*100)::INT)) FILTER (c='{x}') AS {x}_xyz, max(c||roi) FILTER (c='{x}') AS {x}_members, rnd(max(a) FILTER (c='{x}')) AS {x}_share" for x in "ANR") + " FROM r GROUP BY roi")
def t5(c):
    r = c.view("acc").groupBy(F.col("flag").alias("c"), "roi").agg(F.avg("accuracy").alias("a"), F.count(F.lit(1)).alias("n"))
    r = r.withColumns({"x": F.col("n") / 10, "y": F.col("n") / 7, "z": F.col("a") * 100, "m": F.concat("c", "roi")})
    return R.wide_summary(r, ["roi"], "c", ["A", "N", "R"], "a", ["x", "y", "z"], "m")


@query("t6_long_wide", """
SELECT subject, roi, contrast, rnd(accuracy) AS accuracy FROM results""")
def t6(c):
    names = ["AF", "AO", "NF", "NO", "RF", "RO"]
    wide = R.to_wide(c.view("results"), ["subject", "roi"], "contrast", "accuracy", names)
    return R.to_long(wide, ["subject", "roi"], names, "contrast", "accuracy")


@query("w7_rank_regions", """
WITH m AS (SELECT roi, contrast, avg(accuracy) AS m FROM results GROUP BY ALL), g AS (SELECT roi, avg(m) AS score FROM m GROUP BY roi)
SELECT roi, rnd(score) AS score, row_number() OVER (ORDER BY score DESC NULLS LAST, roi) AS rank FROM g""")
def w7(c):
    return R.rank_regions(c.view("results"), "roi", "contrast", "accuracy")


FOUR = ["within_natural", "within_ai", "natural_to_ai", "ai_to_natural"]
CHANCE, MARGIN, EPS = 0.484, 0.0005, 1e-6


def index_sql(src, keys):
    k = ", ".join(keys)
    return f"""ix0 AS (SELECT {k}, {", ".join(f"avg(accuracy) FILTER (kind='{x}') AS {x}" for x in FOUR)} FROM {src} GROUP BY {k}),
ix1 AS (SELECT *, coalesce((within_natural+within_ai)/2, within_natural, within_ai) AS within_mean, least(within_natural, within_ai) AS within_min,
  coalesce((natural_to_ai+ai_to_natural)/2, natural_to_ai, ai_to_natural) AS cross_mean FROM ix0),
ix AS (SELECT *, CASE WHEN within_mean-{CHANCE} > {EPS} THEN (cross_mean-{CHANCE})/(within_mean-{CHANCE}) END AS cross_generalization,
  CASE WHEN within_min-{CHANCE} > {EPS} THEN (cross_mean-{CHANCE})/(within_min-{CHANCE}) END AS shared_index,
  coalesce(within_natural > {CHANCE} AND within_ai > {CHANCE}, false) AS within_both_above, coalesce(cross_mean > {CHANCE}, false) AS cross_above,
  coalesce(within_natural >= {CHANCE}+{MARGIN} AND within_ai >= {CHANCE}+{MARGIN}, false) AS strong FROM ix1)"""


IXOUT = ", ".join([f"rnd({x}) AS {x}" for x in (*FOUR, "within_mean", "within_min", "cross_mean", "cross_generalization", "shared_index")] + [
    f"rnd(within_mean-{CHANCE}) AS within_mean_signal", f"rnd(within_min-{CHANCE}) AS within_min_signal", f"rnd(cross_mean-{CHANCE}) AS cross_signal",
    "rnd(natural_to_ai-ai_to_natural) AS cross_asymmetry", "rnd(within_natural-within_ai) AS within_asymmetry", "within_both_above", "cross_above",
    "within_both_above AND cross_above AS candidate", "strong AND cross_above AS candidate_margin"])


def indices(c, keys, src=None):
    d = src if src is not None else c.view("cells")
    return R.generalization_indices(G.pivot_values(d, keys, "kind", "accuracy", FOUR), CHANCE, EPS, MARGIN)


@query("g1_generalization_indices", f"WITH {index_sql('cells', ['subject', 'roi', 'positive'])} SELECT subject, roi, positive, {IXOUT} FROM ix")
def g1(c):
    return indices(c, ["subject", "roi", "positive"])


@query("g2_group_generalization", f"""WITH {index_sql('cells', ['roi', 'positive'])},
s0 AS (SELECT subject, roi, positive, {", ".join(f"avg(accuracy) FILTER (kind='{x}') AS {x}" for x in FOUR)} FROM cells GROUP BY ALL),
s1 AS (SELECT roi, positive, CASE WHEN coalesce((within_natural+within_ai)/2, within_natural, within_ai)-{CHANCE} > {EPS} THEN (coalesce((natural_to_ai+ai_to_natural)/2, natural_to_ai, ai_to_natural)-{CHANCE})/(coalesce((within_natural+within_ai)/2, within_natural, within_ai)-{CHANCE}) END AS g FROM s0),
s2 AS (SELECT roi, positive, count(*) AS n_subjects, count(g) AS n_index, avg(g) AS mean_subject_index, stddev_samp(g)/sqrt(count(g)) AS sem_subject_index FROM s1 GROUP BY ALL)
SELECT roi, positive, n_subjects, n_index, rnd(mean_subject_index) AS mean_subject_index, rnd(sem_subject_index) AS sem_subject_index, {IXOUT} FROM ix JOIN s2 USING (roi, positive)""")
def g2(c):
    return R.group_generalization(c.view("cells"), "subject", ["roi", "positive"], "kind", "accuracy", CHANCE, EPS, MARGIN)


@query("w8_candidate_rank", f"""WITH {index_sql('cells', ['roi', 'positive'])} SELECT roi, positive, strong AND cross_above AS candidate_margin, rnd(shared_index) AS shared_index, rnd(cross_mean) AS cross_mean,
 row_number() OVER (ORDER BY strong AND cross_above DESC, shared_index DESC NULLS LAST, cross_mean DESC NULLS LAST, roi, positive) AS rank FROM ix""".replace("strong AND cross_above DESC", "(strong AND cross_above) DESC"))
def w8(c):
    d = indices(c, ["roi", "positive"]).select("roi", "positive", "candidate_margin", "shared_index", "cross_mean")
    return R.candidate_table(d, "candidate_margin", ["shared_index", "cross_mean"], ["roi", "positive"])


SIDED = "sd AS (SELECT subject, flag, concat('region', CAST(substring(roi, 4) AS INT)//2, CASE WHEN roi='roi16' THEN '' WHEN CAST(substring(roi, 4) AS INT) % 2 = 0 THEN '_L' ELSE '_R' END) AS roi, avg(accuracy) AS accuracy FROM acc GROUP BY ALL)"


@query("g3_side_mean", f"WITH {SIDED} SELECT subject, flag, regexp_replace(roi, '_[LR]$', '') AS region, rnd(avg(accuracy)) AS mean, count(accuracy) AS n_sides FROM sd GROUP BY ALL")
def g3(c):
    n = F.substring("roi", 4, 9).cast("int")
    side = F.when(n == 16, "").when(n % 2 == 0, "_L").otherwise("_R")
    d = c.view("acc").groupBy("subject", "flag", F.concat(F.lit("region"), F.floor(n / 2).cast("string"), side).alias("roi")).agg(F.avg("accuracy").alias("accuracy"))
    return R.side_mean(d, ["subject", "flag"], "roi", "accuracy")


@query("g5_safe_name", """
SELECT p_partkey, trim(regexp_replace(concat('(', p_brand, ') ', p_name, ' / ', p_type, '!'), '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS name FROM part""")
def g5(c):
    s = F.concat(F.lit("("), "p_brand", F.lit(") "), "p_name", F.lit(" / "), "p_type", F.lit("!"))
    return c.table("part").select("p_partkey", text.safe_name(s).alias("name"))


@query("g6_readable_names", """
SELECT s_suppkey, code, coalesce(n_name, code) AS full_name FROM (SELECT s_suppkey, concat('N', s_nationkey) AS code FROM supplier)
LEFT JOIN (SELECT concat('N', n_nationkey) AS code, n_name FROM nation WHERE n_nationkey % 4 <> 1) USING (code)""")
def g6(c):
    names = c.table("nation").filter("n_nationkey % 4 <> 1").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("full_name"))
    return R.readable_names(c.table("supplier").select("s_suppkey", F.concat(F.lit("N"), "s_nationkey").alias("code")), names, "code")


SRC = "sr AS (SELECT subject, roi, positive, max(accuracy) FILTER (kind='within_natural') AS a, max(accuracy) FILTER (kind='within_ai') AS b FROM cells GROUP BY ALL)"


@query("g7_source_comparison", f"""WITH {SRC}, s AS (SELECT subject, positive, avg(a) AS a, avg(b) AS b FROM sr GROUP BY ALL),
g AS (SELECT positive, count(a-b) AS n, avg(a) AS ma, avg(b) AS mb, avg(a-b) AS md, stddev_samp(a-b) AS sd, avg(a/b) AS ratio, corr(a, b) AS r FROM s GROUP BY positive),
t AS (SELECT *, md/(sd/sqrt(n)) AS t FROM g)
SELECT positive, n, rnd(ma) AS mean_a, rnd(mb) AS mean_b, rnd(md) AS mean_difference, rnd(ratio) AS mean_ratio, rnd(t) AS t, rnd(tp2(t, (n-1))) AS p, rnd(r) AS r FROM t""")
def g7(c):
    s = c.view("cells").groupBy("subject", "positive", "kind").agg(F.avg("accuracy").alias("accuracy"))
    return G.source_comparison(G.pivot_values(s, ["subject", "positive"], "kind", "accuracy", FOUR), ["positive"], "within_natural", "within_ai")


@query("g8_region_concordance", f"""WITH {SRC}, g AS (SELECT roi, positive, avg(a) AS a, avg(b) AS b FROM sr GROUP BY ALL)
SELECT roi, positive, rnd(a) AS natural, rnd(b) AS ai, rnd(a-b) AS difference, rnd(corr(a, b) OVER (PARTITION BY positive)) AS r FROM g""")
def g8(c):
    w = G.pivot_values(c.view("cells"), ["subject", "roi", "positive"], "kind", "accuracy", FOUR)
    return G.region_concordance(w, ["positive"], "roi", "within_natural", "within_ai")


MAPR = "mr AS (SELECT subject, corr(value, other) AS map_r FROM (SELECT CAST(l_suppkey % 30 AS INT) AS subject, l_partkey, avg(l_quantity) AS value, avg(l_tax) AS other FROM {lineitem} GROUP BY ALL) GROUP BY subject)"


@query("g9_cross_map_audit", "WITH " + MAPR.replace("{lineitem}", "lineitem") + f""", w AS (SELECT subject, positive, {", ".join(f"avg(accuracy) FILTER (kind='{x}') AS {x}" for x in FOUR)} FROM cells GROUP BY ALL),
a AS (SELECT positive, subject, (within_natural+within_ai)/2 AS wm, least(within_natural, within_ai) AS wn, (natural_to_ai+ai_to_natural)/2 AS cm, within_natural AS n, within_ai AS i, map_r FROM w JOIN mr USING (subject)),
l AS (SELECT positive, 'within_mean > chance' AS test, wm - {CHANCE} AS d FROM a UNION ALL SELECT positive, 'cross_mean > chance', cm - {CHANCE} FROM a UNION ALL SELECT positive, 'map_r > 0', atanh(map_r) FROM a
 UNION ALL SELECT positive, 'cross - within_mean', cm-wm FROM a UNION ALL SELECT positive, 'cross - within_min', cm-wn FROM a UNION ALL SELECT positive, 'natural - ai', n-i FROM a),
g AS (SELECT positive, test, count(d) AS n, avg(d) AS mean, avg(d)/(stddev_samp(d)/sqrt(count(d))) AS t FROM l GROUP BY ALL), r AS (SELECT positive, corr(cm, map_r) AS r FROM a GROUP BY positive)
SELECT positive, test, n, rnd(mean) AS mean, rnd(t) AS t, rnd(CASE WHEN contains(test, '>') THEN CASE WHEN t >= 0 THEN tp2(t, (n-1))/2 ELSE 1-tp2(t, (n-1))/2 END ELSE tp2(t, (n-1)) END) AS p,
 rnd(r) AS r_cross_map FROM g JOIN r USING (positive)""")
def g9(c):
    m = c.table("lineitem").groupBy((F.col("l_suppkey") % 30).cast("int").alias("subject"), "l_partkey").agg(
        F.avg("l_quantity").alias("value"), F.avg("l_tax").alias("other"))
    r = m.groupBy("subject").agg(F.corr("value", "other").alias("map_r"))
    w = G.pivot_values(c.view("cells"), ["subject", "positive"], "kind", "accuracy", FOUR)
    return G.cross_map_audit(w.join(r, "subject"), ["positive"], "map_r", CHANCE)
