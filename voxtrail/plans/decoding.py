"""Folds, decoding and permutation queries."""

import re

from pyspark.sql import functions as F

from voxtrail.functions import arrays as A
from voxtrail.operators import averaged as AV, decode as D, folds as K, groupstats as G, patterns as P, permute as N, report as R, spatial as S, svm as SV, units as U
from voxtrail.plans.contracts import sub
from voxtrail.plans.pattern_plans import KEEP, Z1, patterns
from voxtrail.plans.registry import query
from voxtrail.session import cut_lineage

MODEL = ["subject", "contrast", "kind"]
CELL = [*MODEL, "roi"]
CON = "con(contrast, kind, ts, te, positive) AS (VALUES " + ",".join(
    f"('{c.name}','{c.kind}','{c.train_source}','{c.test_source}','{c.positive}')" for c in K.CONTRASTS) + ")"
POOL = CON + """, pool AS (SELECT vec_id, subject, run, image, valence, source, contrast, kind, (valence=positive)::INT AS y, source=ts AS is_train,
  source=te AS is_test FROM trials JOIN con ON source IN (ts, te) AND valence IN (positive, 'neutral'))"""
WITHIN = [c for c in K.CONTRASTS if c.kind == "within"]
CROSS = [c for c in K.CONTRASTS if c.kind == "cross"]


def pool(c, contrasts=K.CONTRASTS):
    return K.contrast_pool(c.view("trials").drop("embedding"), contrasts)


def folded(c, labels, features=None, more=(), unit=None):
    """The units of the patterns with the folds of all contrasts beside them."""
    features = patterns(c) if features is None else features
    unit = unit or ["subject", "roi"]
    return U.units(labels, features.select(*unit, "vec_id", "features"), ["subject"], ["contrast", "kind", *more], unit)


def fold_sql(k, model, extra="", src="pool", where="true", alias="fp"):
    m = ", ".join(model)
    h = "||'|'||".join(["'fold'", *([f"'{extra}'"] if extra else []), *model, "vec_id"])
    return (f"{alias} AS (SELECT *, (row_number() OVER (PARTITION BY {m}, y ORDER BY h32({h}), vec_id) - 1) % {k} AS fold "
            f"FROM {src} WHERE {where})")


def decode_sql(model, rows, scorer="lda", a="0.1", name="acc_f", value="x"):
    """Brute force: the training rows of each fold are joined and averaged directly."""
    m = ", ".join(model)
    den = f"(1-{a})*pooled+{a}" if scorer == "lda" else "1"
    return f"""tf_{name} AS (SELECT DISTINCT {m}, fold FROM {rows} WHERE is_test),
st_{name} AS (SELECT {m}, f.fold, pos, count({value}) FILTER (y=0) AS n0, count({value}) FILTER (y=1) AS n1, avg({value}) FILTER (y=0) AS m0,
  avg({value}) FILTER (y=1) AS m1, var_samp({value}) FILTER (y=0) AS v0, var_samp({value}) FILTER (y=1) AS v1 FROM {rows} r JOIN tf_{name} f USING ({m})
  WHERE is_train AND r.fold <> f.fold GROUP BY {m}, f.fold, pos),
s1_{name} AS (SELECT *, (n0*m0+n1*m1)/(n0+n1) AS m FROM st_{name} WHERE n0 >= 2 AND n1 >= 2),
s2_{name} AS (SELECT *, ((n0-1)*v0+(n1-1)*v1+n0*(m0-m)*(m0-m)+n1*(m1-m)*(m1-m))/(n0+n1-1) AS v FROM s1_{name}),
s3_{name} AS (SELECT *, (m0-m)/sqrt(v) AS z0, (m1-m)/sqrt(v) AS z1, ((n0-1)*v0+(n1-1)*v1)/(n0+n1-2)/v AS pooled FROM s2_{name} WHERE v > 1e-14),
wt_{name} AS (SELECT {m}, fold, pos, (z1-z0)/({den})/sqrt(v) AS w, -0.5*(z1*z1-z0*z0)/({den}) - m*(z1-z0)/({den})/sqrt(v) AS b FROM s3_{name}),
dec_{name} AS (SELECT {m}, fold, trial, y, sum(w*{value}+b) AS decision FROM {rows} LEFT JOIN wt_{name} USING ({m}, fold, pos) WHERE is_test GROUP BY {m}, fold, trial, y),
{name} AS (SELECT {m}, fold, count(*) FILTER ((decision > 0)::INT = y) AS n_correct, count(decision) AS n_scored, count(*) AS n_test,
  avg(CASE WHEN decision > 0 THEN y ELSE CASE WHEN decision IS NOT NULL THEN 1-y END END) AS accuracy FROM dec_{name} GROUP BY {m}, fold)"""




def rows_sql(fp="fp", out="rws", long="long_x", x="x"):
    return f"""{out} AS (SELECT p.*, p.vec_id AS trial, l.roi, l.pos, l.{x} AS x FROM {fp} p JOIN {long} l ON p.vec_id = l.vec_id)"""


def folds_out(keys):
    return f"SELECT {', '.join(keys)}, fold, n_correct, n_scored, n_test, rnd(accuracy) AS accuracy FROM acc_f"


@query("p4_contrast_pool", f"WITH {POOL} SELECT vec_id, contrast, kind, y, is_train, is_test FROM pool")
def p4(c):
    return pool(c).select("vec_id", "contrast", "kind", "y", "is_train", "is_test")


@query("d1_run_folds", f"""WITH {POOL}, h AS (SELECT unnest([0,1,2,4])::BIGINT AS fold)
SELECT subject, contrast, fold, count(*) FILTER (is_train AND run <> fold) AS n_train, count(*) FILTER (is_test AND run = fold) AS n_test
FROM pool, h WHERE run <> 3 GROUP BY subject, contrast, fold""")
def d1(c):
    d = K.run_folds(pool(c), exclude=[3])
    n = d.groupBy("subject", "contrast", "fold").agg(F.count_if("is_train").alias("own"), F.count_if("is_test").alias("n_test"))
    total = d.groupBy("subject", "contrast").agg(F.count_if("is_train").alias("all"))
    return n.join(total, ["subject", "contrast"]).select(
        "subject", "contrast", "fold", (F.col("all") - F.col("own")).alias("n_train"), "n_test")


@query("d2_stratified_folds", f"""WITH {POOL}, rp AS (SELECT *, repeat FROM pool, (SELECT unnest(range(3)) AS repeat) WHERE kind='within'),
{fold_sql(4, ["subject", "contrast", "repeat"], src="rp")} SELECT subject, contrast, repeat::INT AS repeat, vec_id, y, fold FROM fp""")
def d2(c):
    d = K.with_repeats(pool(c, WITHIN), 3)
    return K.stratified_folds(d, ["subject", "contrast", "repeat"], "vec_id", 4).select(
        "subject", "contrast", "repeat", "vec_id", "y", "fold")


IDF = """fam AS (SELECT subject, contrast, image, min(y) AS fy FROM pool GROUP BY ALL),
fr AS (SELECT *, (row_number() OVER (PARTITION BY subject, contrast, fy ORDER BY h32('family|'||image), image) - 1) % 3 AS fold FROM fam),
fp AS (SELECT pool.*, fold FROM pool JOIN fr USING (subject, contrast, image))"""


@query("d3_identity_folds", f"WITH {POOL}, {IDF}, {rows_sql()}, {decode_sql(CELL, 'rws')} {folds_out(CELL)}")
def d3(c):
    return U.cross_validate(folded(c, K.identity_folds(pool(c), ["subject", "contrast"], "image", 3)))


@query("d3_family_leaks", f"""WITH {POOL}, {IDF}, pl AS (SELECT subject, contrast, image, fold, CASE WHEN vec_id % 50 = 7 THEN (fold + 1) % 3 ELSE fold END AS planted FROM fp),
im AS (SELECT subject, contrast, image, count(DISTINCT fold) > 1 AS leaked, count(DISTINCT planted) > 1 AS planted FROM pl GROUP BY ALL)
SELECT subject, contrast, count(*) AS n_families, count(*) FILTER (leaked) AS n_leaked, count(*) FILTER (planted) AS n_planted FROM im GROUP BY ALL""")
def d3_leaks(c):
    """Families on both sides: none in the folds, and those found after some trials were moved to another fold."""
    d = K.identity_folds(pool(c), ["subject", "contrast"], "image", 3)
    keys = ["subject", "contrast"]
    moved = d.withColumn("fold", F.when(F.col("vec_id") % 50 == 7, (F.col("fold") + 1) % 3).otherwise(F.col("fold")))
    out = d.groupBy(*keys).agg(F.count_distinct("image").alias("n_families"))
    for rows, name in ((d, "n_leaked"), (moved, "n_planted")):
        out = out.join(K.leaked_families(rows, keys, "image").groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left")
    return out.fillna(0, ["n_leaked", "n_planted"])


SPLIT = "fp AS (SELECT *, CASE WHEN is_test THEN 0::BIGINT ELSE -1 END AS fold FROM pool WHERE kind='cross')"


@query("d4_cross_single_split", f"WITH {POOL}, {SPLIT}, {rows_sql()}, {decode_sql(CELL, 'rws')} {folds_out(CELL)}")
def d4(c):
    return U.cross_validate(folded(c, K.single_split(pool(c, CROSS))))


@query("d5_cross_paired_folds", f"""WITH {POOL}, rp AS (SELECT *, is_test::INT AS role FROM pool WHERE kind='cross'),
{fold_sql(4, ["subject", "contrast", "role"], src="rp")}, {rows_sql()}, {decode_sql(CELL, 'rws')} {folds_out(CELL)}""")
def d5(c):
    return U.cross_validate(folded(c, K.paired_folds(pool(c, CROSS), ["subject", "contrast"], "vec_id", 4)))


def averaged_sql(model, src, scale_by="", name="av", chunks=True):
    """Chunk means of single trials scaled by single-trial statistics, all by direct joins."""
    m = ", ".join(model)
    sb = f", {scale_by}" if scale_by else ""
    st = "" if scale_by else "WHERE is_train"
    return f"""sst_{name} AS (SELECT {m}{sb}, pos, avg(x) AS mu, stddev_pop(x) AS sd FROM {src} {st} GROUP BY {m}{sb}, pos),
{name} AS (SELECT {m}, is_train, is_test, y, y||'-'||chunk AS trial, pos, CASE WHEN is_train THEN -1 ELSE 0 END AS fold,
  (avg(x) - any_value(mu)) / any_value(sd) AS x FROM {src} JOIN sst_{name} USING ({m}{sb}, pos) GROUP BY {m}, is_train, is_test, y, chunk, pos)"""


def hexpart(i):
    return f"(('0x'||substring(dg,{1 + 8 * i},8))::BIGINT % 2147483647)"


def seeds_sql(name, seed, src):
    """A table of hash coefficients for every row of ``src``, seeded with the text ``seed``."""
    parts = ", ".join(f"{hexpart(i)} AS c{i}" for i in range(4))
    return f"{name} AS MATERIALIZED (SELECT * EXCLUDE (dg), {parts} FROM (SELECT *, md5({seed}) AS dg FROM {src}))"


POLY = "((((c3*vec_id+c2) % 2147483647)*vec_id+c1) % 2147483647*vec_id+c0) % 2147483647"


def within_sql(src, model, tag=""):
    """Folds by seeded hash rank, three training chunks in the order of trials; ``src`` has permutation and repeat."""
    m = ", ".join(model)
    by = "subject, contrast, permutation, repeat"
    return f"""{seeds_sql("sf" + tag, "'fold|'||subject||'|'||contrast||'|'||permutation||'|'||repeat", f"(SELECT DISTINCT {by} FROM {src})")},
fp{tag} AS (SELECT p.*, (row_number() OVER (PARTITION BY {by}, y ORDER BY {POLY}, vec_id) - 1) % 4 AS fold FROM {src} p JOIN sf{tag} USING ({by})),
ef{tag} AS (SELECT p.* EXCLUDE (fold, is_train, is_test), h.fold AS xfold, p.fold = h.fold AS is_test, p.fold <> h.fold AS is_train FROM fp{tag} p, (SELECT unnest(range(4)) AS fold) h),
ch{tag} AS (SELECT *, CASE WHEN is_test THEN 0 ELSE ntile(3) OVER (PARTITION BY {m}, xfold, is_test, y ORDER BY vec_id) - 1 END AS chunk FROM ef{tag})"""


# kind of fold role: k folds, patterns z-scored per trial, 3 training chunks per class, one test mean
D6SQL = f"""{Z1}, pw AS (SELECT *, 0 AS permutation, 0 AS repeat FROM pool WHERE kind='within'), {within_sql('pw', MODEL)},
lg AS (SELECT c.*, l.roi, l.pos, l.z AS x FROM ch c JOIN z1 l ON c.vec_id = l.vec_id)"""
D6M = [*CELL, "xfold"]


def averaged(labels, features, plan, scorer="lda", per_draw=False):
    return AV.decode(labels, features.select("subject", "roi", "vec_id", "features"), ["subject"], ["contrast", "kind"], plan, scorer,
                     per_draw=per_draw)


@query("d6_averaged_within", f"""WITH {POOL}, {D6SQL}, {averaged_sql(D6M, 'lg')}, {decode_sql(D6M, 'av')}
SELECT {', '.join(CELL)}, xfold::INT AS xfold, n_correct, n_scored, n_test, rnd(accuracy) AS accuracy FROM acc_f""")
def d6(c):
    return averaged(pool(c, WITHIN), P.pattern_zscore(patterns(c)), AV.Within(), per_draw=True).select(
        *CELL, F.col("draw").alias("xfold"), "n_correct", "n_scored", "n_test", "accuracy")


def cross_averaged_sql(src, model, name, long="z1", x="z"):
    m = ", ".join(model)
    return f"""{seeds_sql(f"sc_{name}", "'chunk|'||repeat", f"(SELECT DISTINCT repeat FROM {src})")},
c_{name} AS (SELECT s.*, ntile(4) OVER (PARTITION BY {m}, is_test, y ORDER BY {POLY}, vec_id) - 1 AS chunk FROM {src} s JOIN sc_{name} USING (repeat)),
l_{name} AS (SELECT c.*, l.roi, l.pos, l.{x} AS x FROM c_{name} c JOIN {long} l ON c.vec_id = l.vec_id),
{averaged_sql([*model, "roi"], f"l_{name}", "is_test", f"av_{name}")}, {decode_sql([*model, "roi"], f"av_{name}", name=f"acc_{name}")}"""


@query("d7_averaged_cross", f"""WITH {POOL}, {Z1}, pc AS (SELECT *, 0 AS repeat FROM pool WHERE kind='cross'), {cross_averaged_sql('pc', [*MODEL, 'repeat'], 'd7')}
SELECT {', '.join(CELL)}, n_correct, n_scored, n_test, rnd(accuracy) AS accuracy FROM acc_d7""")
def d7(c):
    return averaged(pool(c, CROSS), P.pattern_zscore(patterns(c)), AV.Across(), per_draw=True).drop("draw", "n_draws")


@query("d8_run_wise", f"""WITH {CON}, {Z1}, h AS (SELECT unnest(range(5)) AS held),
s8 AS (SELECT subject, roi, source, held, pos, avg(z) AS mu, stddev_pop(z) AS sd FROM z1 JOIN h ON run <> held GROUP BY ALL),
m8 AS (SELECT subject, roi, source, valence, run, pos, avg(z) AS mz FROM z1 GROUP BY ALL),
r8 AS (SELECT subject, roi, contrast, kind, held, run, pos, (valence=positive)::INT AS y, source=ts AND run<>held AS is_train, source=te AND run=held AS is_test,
  (mz-mu)/sd AS x, (valence=positive)::INT||'-'||run AS trial, CASE WHEN run=held THEN 0 ELSE -1 END AS fold
  FROM m8 JOIN s8 USING (subject, roi, source, pos) JOIN con ON source IN (ts, te) AND valence IN (positive, 'neutral')),
rr AS (SELECT * FROM r8 WHERE is_train OR is_test), {decode_sql([*CELL, 'held'], 'rr')}
SELECT {', '.join(CELL)}, held AS fold, n_correct, n_scored, n_test, rnd(accuracy) AS accuracy FROM acc_f""")
def d8(c):
    z = P.explode_features(P.pattern_zscore(patterns(c)), KEEP)
    rows = D.run_wise_rows(z, ["subject", "roi"], K.CONTRASTS)
    return D.split_validate(rows, [*CELL, "fold"])


IMG = """im AS (SELECT subject, source, valence, roi, image, pos, avg(x) AS x FROM long_x GROUP BY ALL),
ip AS (SELECT DISTINCT subject, contrast, kind, image, y, is_train, is_test, source FROM pool)"""


@query("d9_stimulus_averaged", f"""WITH {POOL}, {IMG},
fi AS (SELECT *, (row_number() OVER (PARTITION BY subject, contrast, y ORDER BY h32('fold|'||subject||'|'||contrast||'|'||image), image) - 1) % 3 AS fold FROM ip WHERE kind='within'
  UNION ALL SELECT *, CASE WHEN is_test THEN 0 ELSE -1 END FROM ip WHERE kind='cross'),
rws AS (SELECT f.*, roi, pos, x, f.source||image AS trial FROM fi f JOIN im USING (subject, source, image)), {decode_sql(CELL, 'rws')} {folds_out(CELL)}""")
def d9(c):
    keys = ["subject", "source", "valence", "image"]
    long = P.explode_features(patterns(c), [*keys, "roi"]).groupBy(*keys, "roi", "pos").agg(F.avg("x").alias("x"))
    p = K.contrast_pool(c.view("trials").select(*keys).distinct())
    w = K.stratified_folds(p.filter("kind='within'"), ["subject", "contrast"], "image", 3)
    f = w.unionByName(K.single_split(p.filter("kind='cross'")))
    rows = f.join(long, keys).withColumn("trial", F.concat("source", F.col("image").cast("string")))
    return D.cross_validate(rows, CELL)


@query("d10_balanced_subset", f"""WITH {POOL}, n AS (SELECT subject, contrast, min(c) AS k FROM (SELECT subject, contrast, y, count(*) AS c FROM pool WHERE kind='within' GROUP BY ALL) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY subject, contrast, y ORDER BY h32('balance|'||subject||'|'||contrast||'|'||vec_id), vec_id) AS rn FROM pool WHERE kind='within')
SELECT subject, contrast, y, vec_id FROM r JOIN n USING (subject, contrast) WHERE rn <= k""")
def d10(c):
    return K.balanced(pool(c, WITHIN), ["subject", "contrast"], "vec_id").select("subject", "contrast", "y", "vec_id")


LORO = "fp AS (SELECT *, run AS fold FROM pool)"


def loro(c, features=None):
    """Units with one run left out per fold."""
    return folded(c, K.run_folds(pool(c)), features)


@query("d11_diagonal_lda", f"WITH {POOL}, {LORO}, {rows_sql()}, {decode_sql(CELL, 'rws')} {folds_out(CELL)}")
def d11(c):
    return U.cross_validate(loro(c))


@query("d12_nearest_centroid", f"WITH {POOL}, {LORO}, {rows_sql()}, {decode_sql(CELL, 'rws', 'centroid')} {folds_out(CELL)}")
def d12(c):
    return U.cross_validate(loro(c), U.Scorer("centroid"))


SVM_GAP = 1e-6


def svm_folds(c, margin=SV.Margin(tolerance=SVM_GAP)):
    features = P.pattern_zscore(patterns(c)).select("subject", "roi", "vec_id", "features")
    return SV.validate(SV.units(K.run_folds(pool(c)), features, ["subject"], ["contrast", "kind"]), margin)


@query("d13_linear_svm")
def d13(c):
    return svm_folds(c).drop("gap", "n_selected")


@query("d13_certificate", f"""WITH {POOL}, r AS (SELECT unnest(['r0','r1','r2','r3']) AS roi)
SELECT {", ".join(CELL)}, run AS fold, count(*) AS n_test, true AS solved FROM pool, r WHERE is_test GROUP BY ALL""")
def d13_certificate(c):
    """Every model of the pool is there, and its duality gap is within the tolerance."""
    return svm_folds(c).select(*CELL, "fold", "n_test", (F.col("gap") <= SVM_GAP).alias("solved"))


# the two selectors that rank by the margin model: by its weights, and by its Haufe pattern
SVM_HALF = {"svm_top50": SV.Margin(select="weight", tolerance=SVM_GAP), "haufe_top50": SV.Margin(select="haufe", tolerance=SVM_GAP)}


@query("d14_svm_top50")
def d14_svm(c):
    return svm_folds(c, SVM_HALF["svm_top50"]).drop("gap", "n_selected")


@query("d14_haufe_top50")
def d14_svm_haufe(c):
    return svm_folds(c, SVM_HALF["haufe_top50"]).drop("gap", "n_selected")


@query("d14_svm_certificate", f"""WITH {POOL}, r AS (SELECT unnest(['r0','r1','r2','r3']) AS roi), s AS (SELECT unnest(['svm_top50','haufe_top50']) AS selector)
SELECT selector, {", ".join(CELL)}, run AS fold, count(*) AS n_test, 8 AS n_selected, true AS solved FROM pool, r, s WHERE is_test GROUP BY ALL""")
def d14_certificate(c):
    """Both selectors keep half of the features of every model, and the refits meet the gap."""
    parts = [svm_folds(c, m).select(F.lit(k).alias("selector"), *CELL, "fold", "n_test", "n_selected", (F.col("gap") <= SVM_GAP).alias("solved"))
             for k, m in SVM_HALF.items()]
    return parts[0].unionByName(parts[1])


SEL = """sel AS (SELECT {m}, fold, pos FROM (SELECT *, row_number() OVER (PARTITION BY {m}, fold ORDER BY {s} DESC, pos) AS rn FROM {src}) WHERE rn <= 5),
dsel AS (SELECT {m}, fold, trial, y, sum(w*x+b) AS decision FROM rws JOIN wt_acc_f USING ({m}, fold, pos) SEMI JOIN sel USING ({m}, fold, pos) WHERE is_test GROUP BY ALL)
SELECT {m}, fold, count(*) FILTER ((decision > 0)::INT = y) AS n_correct, count(decision) AS n_scored, count(*) AS n_test, rnd(avg(((decision > 0)::INT = y)::INT)) AS accuracy FROM dsel GROUP BY ALL"""
CM = ", ".join(CELL)


@query("d14_feature_selection", f"WITH {POOL}, {LORO}, {rows_sql()}, {decode_sql(CELL, 'rws')}, " + SEL.format(m=CM, s="abs(w)", src="wt_acc_f"))
def d14(c):
    return U.cross_validate(loro(c), U.Scorer(select="weight"))


@query("d14_fixed_columns", f"WITH {POOL}, {LORO}, all_rows AS (SELECT * FROM long_x WHERE pos % 3 = 1), {rows_sql(long='all_rows')}, {decode_sql(CELL, 'rws')} {folds_out(CELL)}")
def d14_fixed(c):
    """The same columns in every fold, chosen beforehand."""
    return U.cross_validate(loro(c, patterns(c).withColumn("features", F.filter("features", lambda x, i: i % 3 == 1))))


HAUFE = f"""td AS (SELECT {CM}, w.fold, trial, y, sum(w*x+b) AS decision FROM rws r JOIN wt_acc_f w USING ({CM}, pos) WHERE is_train AND r.fold <> w.fold GROUP BY {CM}, w.fold, trial, y),
hf AS (SELECT {CM}, td.fold, pos, coalesce(regr_slope(x, decision), 0) AS pattern FROM rws r JOIN td USING ({CM}, trial, y) WHERE is_train GROUP BY {CM}, td.fold, pos)"""


@query("d14_haufe_selection", f"WITH {POOL}, {LORO}, {rows_sql()}, {decode_sql(CELL, 'rws')}, {HAUFE}, " + SEL.format(m=CM, s="abs(pattern)", src="hf"))
def d14_haufe(c):
    return U.cross_validate(loro(c), U.Scorer(select="haufe"))


@query("v12_haufe_pattern", f"WITH {POOL}, {LORO}, {rows_sql()}, {decode_sql(CELL, 'rws')}, {HAUFE} SELECT {CM}, fold, pos, rnd(pattern) AS pattern FROM hf")
def v12(c):
    return U.haufe_patterns(loro(c))


@query("v14_selection_frequency", f"""WITH {POOL}, {LORO}, {rows_sql()}, {decode_sql(CELL, 'rws')},
sel AS (SELECT {CM}, fold, pos FROM (SELECT *, row_number() OVER (PARTITION BY {CM}, fold ORDER BY abs(w) DESC, pos) AS rn FROM wt_acc_f) WHERE rn <= 5)
SELECT {CM}, pos, count(*) AS times, rnd(count(*)/5) AS frequency FROM sel GROUP BY {CM}, pos""")
def v14(c):
    from voxtrail.operators.similarity import selection_frequency
    return selection_frequency(U.selected(loro(c), U.Scorer(select="weight")), CELL, "pos", 5)


# the 64 features as a 4 x 4 x 4 grid
WHOLE = "lw AS (SELECT vec_id, 'all' AS roi, (regexp_extract(roi, '[0-9]')::INT*16 + pos)::INT AS pos, x FROM long_x)"


def whole(c):
    return c.view("trials").withColumns({"roi": F.lit("all"), "features": F.col("embedding").cast("array<double>")}).drop("embedding")


def grid_areas(c, radius, least, edge=10):
    pos = whole(c).select(F.posexplode("features").alias("pos", "x")).select("pos").distinct()
    v = pos.select("pos", (F.col("pos") % 4).cast("bigint").alias("i"), (F.floor(F.col("pos") / 4) % 4).alias("j"), F.floor(F.col("pos") / 16).alias("k"))
    return U.sphere_areas(v, S.lattice_neighbours(v, "pos", radius, least=least), edge)


@query("d15_searchlight", f"""WITH {POOL}, {LORO}, {WHOLE}, {rows_sql(long='lw')}, {decode_sql(CELL, 'rws')},
g AS (SELECT p AS pos, p % 4 AS i, p//4 % 4 AS j, p//16 AS k FROM (SELECT unnest(range(64)) AS p)),
sp AS (SELECT a.pos AS centre, b.pos FROM g a JOIN g b ON (a.i-b.i)*(a.i-b.i)+(a.j-b.j)*(a.j-b.j)+(a.k-b.k)*(a.k-b.k) <= 2.25),
ok AS (SELECT centre, pos FROM sp WHERE centre IN (SELECT centre FROM sp GROUP BY centre HAVING count(*) >= 10)),
de AS (SELECT subject, contrast, kind, fold, centre, trial, y, sum(w*x+b) AS decision FROM rws JOIN wt_acc_f USING ({CM}, fold, pos) JOIN ok USING (pos) WHERE is_test GROUP BY ALL)
SELECT subject, contrast, kind, fold, centre::INT AS centre, count(*) FILTER ((decision > 0)::INT = y) AS n_correct, count(*) AS n_scored, count(*) AS n_test,
 rnd(avg(((decision > 0)::INT = y)::INT)) AS accuracy FROM de GROUP BY ALL""")
def d15(c):
    d = U.searchlight(K.run_folds(pool(c)), whole(c), grid_areas(c, 1.5, 10), ["subject"], ["contrast", "kind"], 10)
    return d.withColumn("centre", F.col("centre").cast("int")).drop("roi")


@query("d16_whole_mask", f"WITH {POOL}, {LORO}, {WHOLE}, {rows_sql(long='lw')}, {decode_sql(CELL, 'rws')} {folds_out(CELL)}")
def d16(c):
    return U.cross_validate(loro(c, whole(c)))


@query("d17_roll_up", f"""WITH {POOL}, rp AS (SELECT *, repeat FROM pool, (SELECT unnest(range(3)) AS repeat) WHERE kind='within'),
{fold_sql(4, ["subject", "contrast", "repeat"], src="rp")}, {rows_sql()}, {decode_sql([*CELL, 'repeat'], 'rws')},
g AS (SELECT {CM}, repeat, avg(accuracy) AS a, sum(n_correct) AS c, sum(n_scored) AS n, count(accuracy) AS k FROM acc_f GROUP BY ALL)
SELECT {CM}, rnd(avg(a)) AS accuracy, rnd(stddev_samp(a)) AS sd_repeats, rnd(sum(c)/sum(n)) AS pooled_accuracy, sum(n)::BIGINT AS n_observations, sum(k)::BIGINT AS n_folds FROM g GROUP BY {CM}""")
def d17(c):
    d = K.stratified_folds(K.with_repeats(pool(c, WITHIN), 3), ["subject", "contrast", "repeat"], "vec_id", 4)
    return D.roll_up(U.cross_validate(folded(c, d, more=["repeat"])), CELL, "repeat")


VAR = f"""{Z1}, lv AS (SELECT 'raw' AS variant, vec_id, roi, pos, x FROM long_x UNION ALL SELECT 'patternz', vec_id, roi, pos, z FROM z1
 UNION ALL SELECT 'centred', vec_id, roi, pos, x - avg(x) OVER (PARTITION BY vec_id, roi) FROM long_x
 UNION ALL SELECT DISTINCT 'global', vec_id, roi, 0, avg(x) OVER (PARTITION BY vec_id, roi) FROM long_x)"""
VROWS = "rws AS (SELECT p.*, p.vec_id AS trial, l.variant, l.roi, l.pos, l.x FROM fp p JOIN lv l ON p.vec_id = l.vec_id)"


def variants(c, labels, kinds):
    v = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), P.variant(F.col("features"), k).alias("features")) for k in kinds])).alias("v")
    p = patterns(c).select("subject", "vec_id", "roi", v).select("subject", "vec_id", "roi", "v.variant", "v.features")
    return U.cross_validate(folded(c, labels, p, unit=["subject", "roi", "variant"]))


@query("d18_variant_sweep", f"""WITH {POOL}, {LORO}, {VAR}, {VROWS}, {decode_sql([*CELL, 'variant'], 'rws')},
m AS (SELECT variant, {CM}, avg(accuracy) AS a FROM acc_f GROUP BY ALL) SELECT variant, kind, rnd(avg(a)) AS mean, count(a) AS n FROM m WHERE variant <> 'global' GROUP BY variant, kind""")
def d18(c):
    cell = D.roll_up(variants(c, K.run_folds(pool(c)), ("raw", "patternz", "centred")), [*CELL, "variant"])
    return cell.groupBy("variant", "kind").agg(F.avg("accuracy").alias("mean"), F.count("accuracy").alias("n"))


@query("d19_global_vs_pattern", f"""WITH {POOL}, {fold_sql(5, ["subject", "contrast"], where="kind='within'", alias="fpw")},
fp AS (SELECT * FROM fpw UNION ALL SELECT *, CASE WHEN is_test THEN 0 ELSE -1 END AS fold FROM pool WHERE kind='cross'), {VAR}, {VROWS}, {decode_sql([*CELL, 'variant'], 'rws')},
m AS (SELECT variant, {CM}, avg(accuracy) AS a FROM acc_f GROUP BY ALL),
ge AS (SELECT {CM}, avg(x) FILTER (y=1) AS ma, var_samp(x) FILTER (y=1) AS va, count(*) FILTER (y=1) AS na, avg(x) FILTER (y=0) AS mb, var_samp(x) FILTER (y=0) AS vb, count(*) FILTER (y=0) AS nb
  FROM rws WHERE variant='global' GROUP BY {CM})
SELECT {CM}, rnd(max(a) FILTER (variant='raw')) AS raw, rnd(max(a) FILTER (variant='global')) AS "global", rnd(max(a) FILTER (variant='centred')) AS centred,
 rnd(max(a) FILTER (variant='patternz')) AS patternz, rnd(any_value((ma-mb)/sqrt(((na-1)*va+(nb-1)*vb)/(na+nb-2)))) AS d FROM m JOIN ge USING ({CM}) GROUP BY {CM}""")
def d19(c):
    kinds = ["raw", "global", "centred", "patternz"]
    f = K.stratified_folds(pool(c, WITHIN), ["subject", "contrast"], "vec_id", 5).unionByName(K.single_split(pool(c, CROSS)))
    cell = D.roll_up(variants(c, f, kinds), [*CELL, "variant"])
    wide = G.pivot_values(cell, CELL, "variant", "accuracy", kinds)
    g = f.join(patterns(c).select("vec_id", "roi", A.mean(F.col("features")).alias("g")), "vec_id")
    return wide.join(G.effect_size(g, CELL, "y", 1, 0, "g"), CELL)


# ---- permutations ----------------------------------------------------------------------

NP = 100      # shuffles
REPEATS = 2   # random partitions into folds and chunks of each shuffle, where check SQL repeats them all
FULL = 30     # the same for the full null model
PERM = f"""pm AS (SELECT *, permutation FROM pool, (SELECT unnest(range({NP + 1})) AS permutation)),
sh AS (SELECT *, row_number() OVER w AS hr, count(*) FILTER (y=0) OVER (PARTITION BY {{k}}, permutation) AS n0 FROM pm
  WINDOW w AS (PARTITION BY {{k}}, permutation ORDER BY h32('null|'||permutation||'|'||contrast||'|'||vec_id), vec_id)),
ps AS (SELECT * REPLACE (CASE WHEN permutation = 0 THEN y ELSE (hr > n0)::INT END AS y) FROM sh)"""


def permuted(d, keys):
    """Permutation 0 keeps its labels; the others are shuffled inside ``keys``."""
    d = N.with_permutations(d, NP)
    s = N.shuffle_labels(d, [*keys, "permutation"], "y", "vec_id", [F.lit("null"), F.col("permutation"), F.col("contrast")], "__y")
    return s.withColumn("y", F.when(F.col("permutation") == 0, F.col("y")).otherwise(F.col("__y"))).drop("__y")


PW = PERM.format(k="subject, contrast")
PX = PERM.format(k="subject, contrast, is_test")


@query("n1_label_shuffle", f"WITH {POOL}, {PW} SELECT subject, contrast, permutation::INT AS permutation, vec_id, y FROM ps WHERE kind='within'")
def n1(c):
    return permuted(pool(c, WITHIN), ["subject", "contrast"]).select("subject", "contrast", "permutation", "vec_id", "y")


@query("n2_cross_shuffle", f"WITH {POOL}, {PX} SELECT subject, contrast, is_test, permutation::INT AS permutation, vec_id, y FROM ps WHERE kind='cross'")
def n2(c):
    return permuted(pool(c, CROSS), ["subject", "contrast", "is_test"]).select("subject", "contrast", "is_test", "permutation", "vec_id", "y")


# observed and shuffled labels, repeats, folds: every combination is a draw of the same few sums
WMODEL = [*MODEL, "permutation", "repeat"]
ZS = """zz AS (SELECT vec_id, subject, roi, source, pos, (z - avg(z) OVER w)/stddev_pop(z) OVER w AS x FROM z1 WINDOW w AS (PARTITION BY subject, roi, source, pos)),
lz AS (SELECT vec_id, roi, pos, (x - avg(x) OVER v)/stddev_pop(x) OVER v AS z FROM zz WINDOW v AS (PARTITION BY vec_id, roi))"""


def null_sql(long):
    """Draws within and across sources, each from the pool shuffled in its own way."""
    def shuffled(kind, tag, keys):
        by = "subject, contrast, permutation"
        return f"""{seeds_sql("sn" + tag, "'null|'||permutation||'|'||subject||'|'||contrast", f"(SELECT DISTINCT subject, contrast, permutation FROM pool, (SELECT unnest(range({NP + 1})) AS permutation) WHERE kind='{kind}')")},
sh{tag} AS (SELECT p.*, permutation, row_number() OVER (PARTITION BY {keys} ORDER BY {POLY}, vec_id) AS hr, row_number() OVER (PARTITION BY {keys} ORDER BY y, vec_id) AS yr
  FROM pool p JOIN sn{tag} USING (subject, contrast)),
ps{tag} AS (SELECT a.* REPLACE (CASE WHEN a.permutation = 0 THEN a.y ELSE b.y END AS y) FROM sh{tag} a JOIN (SELECT {keys}, yr AS hr, y FROM sh{tag}) b USING ({keys}, hr)),
r{tag} AS (SELECT *, repeat FROM ps{tag}, (SELECT unnest(range({REPEATS})) AS repeat))"""

    wx = [*WMODEL, "roi", "xfold"]
    return f"""{shuffled("within", "_w", "subject, contrast, permutation")}, {shuffled("cross", "_c", "subject, contrast, is_test, permutation")}, {within_sql("r_w", WMODEL, "_w")},
lw AS (SELECT c.*, l.roi, l.pos, l.z AS x FROM ch_w c JOIN {long} l ON c.vec_id = l.vec_id),
{averaged_sql(wx, 'lw', name='av_w')}, {decode_sql(wx, 'av_w', name='acc_w')}, {cross_averaged_sql('r_c', WMODEL, 'x', long)},
nul AS (SELECT {CM}, permutation, sum(n_correct) AS n_correct, sum(n_scored) AS n_scored, avg(accuracy) AS accuracy FROM
  (SELECT {CM}, permutation, n_correct, n_scored, accuracy FROM acc_w UNION ALL SELECT {CM}, permutation, n_correct, n_scored, accuracy FROM acc_x) GROUP BY {CM}, permutation)"""


def null_decode(c, features, repeats=REPEATS, scorer="lda"):
    """Accuracy of every cell and permutation, within and across sources, mean over its draws."""
    features = cut_lineage(features.select("subject", "roi", "vec_id", "features"))
    return averaged(pool(c, WITHIN), features, AV.Within(NP, repeats), scorer).unionByName(
        averaged(pool(c, CROSS), features, AV.Across(NP, repeats), scorer)).drop("n_test")


def source_scaled(c):
    """Patterns after the source z-score, which no shuffle of labels changes, z-scored once more."""
    z = P.normalise(patterns(c), "voxel_source", ["vec_id", "subject", "source", "roi"], ["subject", "roi"], "source")
    return P.pattern_zscore(D.packed(z, ["subject", "vec_id", "roi"], "x", "features"))


@query("n3_shuffle_before_averaging", f"""WITH {POOL}, {Z1}, {null_sql('z1')}
SELECT {CM}, permutation::INT AS permutation, n_correct::BIGINT AS n_correct, n_scored::BIGINT AS n_scored, rnd(accuracy) AS accuracy FROM nul""")
def n3(c):
    return null_decode(c, P.pattern_zscore(patterns(c))).drop("n_draws")


N4SQL = f"{POOL}, {Z1}, {ZS}, {null_sql('lz')}"


@query("n4_observed_and_null", f"WITH {N4SQL} SELECT {CM}, permutation::INT AS permutation, rnd(accuracy) AS accuracy FROM nul")
def n4(c):
    return null_decode(c, source_scaled(c)).select(*CELL, "permutation", "accuracy")


@query("n4_full_null")
def n4_full(c):
    """The observed accuracy and 100 shuffles with 30 repeats each; the draws are too many for check SQL,
    tests hold the kernel against loops over single draws."""
    return null_decode(c, source_scaled(c), FULL).select(*CELL, "permutation", "accuracy", "n_draws")


@query("n11_cell_null_check", f"""WITH {N4SQL} SELECT {CM}, rnd(max(accuracy) FILTER (permutation=0)) AS observed, rnd(avg(accuracy) FILTER (permutation>0)) AS null_mean,
  rnd(stddev_samp(accuracy) FILTER (permutation>0)) AS null_sd FROM nul GROUP BY {CM}""")
def n11(c):
    a, p = F.col("accuracy"), F.col("permutation")
    return null_decode(c, source_scaled(c)).groupBy(*CELL).agg(
        F.max(F.when(p == 0, a)).alias("observed"), F.avg(F.when(p > 0, a)).alias("null_mean"),
        F.stddev_samp(F.when(p > 0, a)).alias("null_sd"))


# group level, on the result cells: every order line of a cell is one null value
NULLS = """SELECT subject, roi, concat(flag, status) AS contrast, row_number() OVER (PARTITION BY subject, roi, concat(flag, status)
  ORDER BY l_orderkey, line) - 1 AS permutation, accuracy FROM (SELECT CAST(o_custkey % 30 AS INT) AS subject, concat('roi', CAST(l_partkey % 17 AS INT)) AS roi,
  l_returnflag AS flag, l_linestatus AS status, CAST(l_linenumber AS INT) AS line, l_orderkey, l_partkey,
  0.43 + l_discount * 0.9173051 + l_tax * 0.3137 AS accuracy FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey)"""
NULLS = NULLS.replace("ORDER BY l_orderkey, line", "ORDER BY l_orderkey, line, l_partkey, accuracy")
NULLSQL = "npool AS (" + NULLS.replace("{lineitem}", "lineitem").replace("{orders}", "orders") + ")"
DRAWS = 10_000  # for p-values and thresholds
SHOWN = 400     # where the draws themselves are the result


def null_pool(c):
    return c.spark.sql(sub(c, NULLS))


def draws(c, n=DRAWS):
    return N.resample_group(null_pool(c), ["contrast", "roi"], "subject", "permutation", "accuracy", n, "draw")


DRAWSQL = f"""{NULLSQL}, dn AS (SELECT contrast, roi, subject, count(*) AS n, md5('draw|'||contrast||'|'||roi||'|'||subject) AS dg FROM npool GROUP BY ALL),
dd AS (SELECT contrast, roi, subject, n, {hexpart(0)} AS c0, {hexpart(1)} AS c1, {hexpart(2)} AS c2, {hexpart(3)} AS c3, draw FROM dn, (SELECT unnest(range({DRAWS})) AS draw)),
di AS (SELECT contrast, roi, subject, draw, ((((c3*draw+c2) % 2147483647)*draw+c1) % 2147483647*draw+c0) % 2147483647 % n AS permutation FROM dd),
drw AS (SELECT contrast, roi, draw, avg(accuracy) AS null_mean, count(accuracy) AS n_subjects FROM di JOIN npool USING (contrast, roi, subject, permutation) GROUP BY ALL)"""
EMP = f"""{DRAWSQL}, ob AS (SELECT contrast, roi, avg(accuracy) + 0.0031 AS observed FROM results GROUP BY contrast, roi),
em AS (SELECT contrast, roi, max(observed) AS observed, count(*) AS n_draws, avg(null_mean) AS null_mean, stddev_samp(null_mean) AS null_sd,
  (count(*) FILTER (null_mean >= observed)+1)/(count(*)+1) AS p FROM drw JOIN ob USING (contrast, roi) GROUP BY contrast, roi)"""


def empirical(c):
    ob = c.view("results").groupBy("contrast", "roi").agg((F.avg("accuracy") + 0.0031).alias("accuracy"))
    return N.empirical_p(draws(c), ob, ["contrast", "roi"], "accuracy")


@query("n5_null_pool_gate", f"""WITH {NULLSQL} SELECT contrast, roi, subject, count(*) AS n_null, count(DISTINCT permutation) AS n_distinct FROM npool GROUP BY ALL
HAVING count(*) <> 20 OR count(DISTINCT permutation) <> 20""")
def n5(c):
    return N.null_counts(null_pool(c), ["contrast", "roi", "subject"], 20)


@query("n6_group_resampling", f"WITH {DRAWSQL} SELECT contrast, roi, draw::INT AS draw, rnd(null_mean) AS null_mean, n_subjects FROM drw".replace(f"range({DRAWS})", f"range({SHOWN})"))
def n6(c):
    return draws(c, SHOWN)


@query("n7_empirical_p", f"WITH {EMP} SELECT contrast, roi, rnd(observed) AS observed, n_draws, rnd(null_mean) AS null_mean, rnd(null_sd) AS null_sd, rnd(p) AS p FROM em")
def n7(c):
    return empirical(c)


@query("n8_null_thresholds", f"""WITH {DRAWSQL}, sg AS (SELECT contrast, roi, avg(accuracy) AS single_mean, stddev_samp(accuracy) AS single_sd FROM npool GROUP BY ALL)
SELECT contrast, roi, rnd(quantile_cont(null_mean, 0.95)) AS q95, rnd(quantile_cont(null_mean, 0.99)) AS q99, rnd(quantile_cont(null_mean, 0.999)) AS q999,
 rnd(any_value(single_mean)) AS single_mean, rnd(any_value(single_sd)) AS single_sd FROM drw JOIN sg USING (contrast, roi) GROUP BY contrast, roi""")
def n8(c):
    single = null_pool(c).groupBy("contrast", "roi").agg(F.avg("accuracy").alias("single_mean"), F.stddev_samp("accuracy").alias("single_sd"))
    return N.null_thresholds(draws(c), ["contrast", "roi"]).join(single, ["contrast", "roi"])


FLAGS = f"""{EMP}, rk AS (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY p) AS rn, count(*) OVER (PARTITION BY contrast) AS n FROM em),
fl AS (SELECT *, least(1, min(p*n/rn) OVER (PARTITION BY contrast ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM rk)"""


@query("n9_significance_flags", f"""WITH {FLAGS} SELECT contrast, roi, rnd(p) AS p, rnd(q) AS q, p<0.05 AS p_05, p<0.01 AS p_01, p<0.001 AS p_001, q<0.05 AS q_05, q<0.01 AS q_01, q<0.001 AS q_001 FROM fl""")
def n9(c):
    return N.significance_flags(empirical(c).select("contrast", "roi", "p"), ["contrast"])


@query("n10_null_calibration", f"WITH {EMP} SELECT rnd(max(abs(null_mean-0.485))) AS max_offset, count(*) AS n_cells FROM em")
def n10(c):
    return N.calibration(empirical(c), 0.485)


@query("n12_label_scramble", """
WITH a AS (SELECT subject, roi, pos, vec_id, valence, x, row_number() OVER (PARTITION BY subject, roi, pos ORDER BY h32('scramble|'||roi||'|'||pos||'|'||vec_id), vec_id) AS hr,
  row_number() OVER (PARTITION BY subject, roi, pos ORDER BY valence, vec_id) AS vr FROM long_x),
s AS (SELECT a.*, b.valence AS scrambled FROM a JOIN (SELECT subject, roi, pos, vr AS hr, valence FROM a) b USING (subject, roi, pos, hr))
SELECT subject, roi, pos, scrambled, count(*) AS n, rnd(avg(x)) AS mean FROM s GROUP BY ALL""")
def n12(c):
    long = P.explode_features(patterns(c), ["vec_id", "subject", "valence", "roi"])
    s = N.shuffle_labels(long, ["subject", "roi", "pos"], "valence", "vec_id", [F.lit("scramble"), F.col("roi"), F.col("pos")], "scrambled")
    return s.groupBy("subject", "roi", "pos", "scrambled").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))


@query("t4_significance_table", f"""WITH {FLAGS}, w AS (SELECT roi, {", ".join(f"bool_or(q < 0.2) FILTER (contrast='{x}') AS {x}" for x in ("AF", "AO", "NF", "NO", "RF", "RO"))},
  count(*) FILTER (q < 0.2) AS n_significant FROM fl GROUP BY roi)
SELECT *, CASE WHEN n_significant=6 THEN 'shared' WHEN n_significant=1 THEN 'specific' ELSE 'other' END AS "group" FROM w""")
def t4(c):
    d = N.significance_flags(empirical(c), ["contrast"]).withColumn("sig", F.col("q") < 0.2)
    return R.significance_table(d, "roi", "contrast", "sig", SIX)


SIX = ["AF", "AO", "NF", "NO", "RF", "RO"]


@query("t4_count_histogram", f"""WITH {FLAGS}, w AS (SELECT roi, count(*) FILTER (q < 0.2) AS n FROM fl GROUP BY roi)
SELECT k AS n_significant, (SELECT count(*) FROM w WHERE n = k) AS n_regions FROM (SELECT unnest(range(7)) AS k)""")
def t4_histogram(c):
    return R.count_histogram(t4(c), len(SIX))


@query("t4_accuracy_pivot", f"""WITH {EMP} SELECT roi, {", ".join(f"rnd(max(observed) FILTER (contrast='{x}')) AS {x}" for x in ("AF", "AO", "NF", "NO", "RF", "RO"))}
FROM em GROUP BY roi""")
def t4_accuracies(c):
    return R.accuracy_pivot(empirical(c), "roi", "contrast", "observed", SIX)
