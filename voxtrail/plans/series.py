"""Event-locked series, run quality and linear models."""

from pyspark.sql import functions as F

from voxtrail.operators import decode as D, folds as K, glm as GL, leakage as W, linmodel as L, patterns as P, timeseries as T, units as U
from voxtrail.plans.decoding import CELL, POOL, WITHIN, decode_sql, fold_sql, pool, rows_sql
from voxtrail.plans.pattern_plans import patterns
from voxtrail.plans.registry import query
from voxtrail.session import cut_lineage

H = 3600000
DAY = 24 * H
EPOCH = f"""ep AS (SELECT o.subject, onset_id, emotion, ai, s.event_id, s.t_ms - onset_ms AS rel, value FROM onsets o JOIN samples s ON o.subject = s.subject
 AND s.t_ms >= onset_ms - {6 * H} AND s.t_ms < onset_ms + {18 * H})"""


@query("j10_event_window", f"WITH {EPOCH} SELECT onset_id, event_id, rel, rnd(value) AS value FROM ep")
def j10(c):
    return T.epochs(c.view("onsets"), c.view("samples").select("subject", "event_id", "t_ms", "value"), ["subject"],
                    "onset_ms", "t_ms", 6 * H, 18 * H, 6 * H).select("onset_id", "event_id", "rel", "value")


NEAR = """SELECT onset_id, subject, onset_ms, max(s.t_ms) FILTER (s.t_ms <= onset_ms) AS t0, arg_max(s.value, s.t_ms) FILTER (s.t_ms <= onset_ms) AS v0,
 min(s.t_ms) FILTER (s.t_ms >= onset_ms) AS t1, arg_min(s.value, s.t_ms) FILTER (s.t_ms >= onset_ms) AS v1
 FROM probes LEFT JOIN samples s USING (subject) WHERE s.value IS NOT NULL GROUP BY ALL"""
# probes lie one and a half hours after an onset
PROBES = f"probes AS (SELECT subject, onset_id, onset_ms + {H + H // 2} AS onset_ms FROM onsets)"


def probes(c):
    return c.view("onsets").select("subject", "onset_id", (F.col("onset_ms") + (H + H // 2)).alias("onset_ms"))


@query("j11_nearest_sample", f"""WITH {PROBES}, n AS ({NEAR})
SELECT subject, onset_id, CASE WHEN t1 IS NULL OR onset_ms-t0 <= t1-onset_ms THEN t0 ELSE t1 END AS nearest_t,
 rnd(CASE WHEN t1 IS NULL OR onset_ms-t0 <= t1-onset_ms THEN v0 ELSE v1 END) AS nearest FROM n""")
def j11(c):
    return T.nearest_value(probes(c), c.view("samples"), ["subject"], "onset_id", "onset_ms", "t_ms", "value", DAY)


@query("w1_moving_mean", """
SELECT event_id, subject, rnd(avg(value) OVER (PARTITION BY subject ORDER BY t_ms, event_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)) AS moving_mean FROM samples""")
def w1(c):
    return T.moving_mean(c.view("samples"), ["subject"], "t_ms", "value", 10, ["event_id"], DAY).select(
        "event_id", "subject", "moving_mean")


@query("w2_local_extrema", """
WITH s AS (SELECT subject, t_ms, event_id, floor(value / 20) AS level FROM samples WHERE value IS NOT NULL),
a AS (SELECT *, lag(level) OVER w AS p FROM s WINDOW w AS (PARTITION BY subject ORDER BY t_ms, event_id)),
r AS (SELECT * FROM a WHERE p IS NULL OR p <> level), b AS (SELECT *, lag(level) OVER w AS q, lead(level) OVER w AS n FROM r WINDOW w AS (PARTITION BY subject ORDER BY t_ms, event_id))
SELECT subject, event_id, level::DOUBLE AS level, CASE WHEN level > q THEN 'max' ELSE 'min' END AS kind FROM b WHERE (level > q AND level > n) OR (level < q AND level < n)""")
def w2(c):
    s = c.view("samples").withColumn("level", F.floor(F.col("value") / 20).cast("double"))
    return T.extrema(s, ["subject"], "t_ms", "level", ["event_id"], DAY).select("subject", "event_id", "level", "kind")


@query("w3_interpolation", f"""WITH {PROBES}, n AS ({NEAR})
SELECT subject, onset_id, rnd(CASE WHEN t0=t1 THEN v0 ELSE v0+(v1-v0)*(onset_ms-t0)/(t1-t0) END) AS interpolated FROM n""")
def w3(c):
    return T.interpolate(probes(c), c.view("samples"), ["subject"], "onset_id", "onset_ms", "t_ms", "value", DAY)


@query("w4_align_to_end", """
SELECT onset_id, subject, (SELECT max(t_ms) FROM samples s WHERE s.subject=o.subject) - (max(onset_ms) OVER (PARTITION BY subject) - onset_ms) AS aligned FROM onsets o""")
def w4(c):
    return T.align_to_end(c.view("onsets"), c.view("samples"), ["subject"], "onset_ms", "t_ms").select("onset_id", "subject", "aligned")


@query("w5_time_course", f"""WITH {EPOCH}, b AS (SELECT onset_id, avg(value) AS b FROM ep WHERE rel < 0 GROUP BY onset_id HAVING avg(value) IS NOT NULL)
SELECT emotion, ai, CAST(floor(rel/{2 * H}) AS BIGINT) AS bin, count(value-b) AS n, rnd(avg(value-b)) AS mean,
 CASE WHEN count(value-b) >= 2 THEN rnd(stddev_samp(value-b)/sqrt(count(value-b))) END AS sem FROM ep JOIN b USING (onset_id) GROUP BY ALL""")
def w5(c):
    e = T.epochs(c.view("onsets"), c.view("samples").select("subject", "t_ms", "value"), ["subject"], "onset_ms",
                 "t_ms", 6 * H, 18 * H, 6 * H)
    return T.time_course(e, ["onset_id"], ["emotion", "ai"], "value", 0, 2 * H)


@query("w6_epoch_mean", f"""WITH {PROBES}, n AS ({NEAR}),
m AS (SELECT onset_id, avg(value) AS m FROM probes p JOIN samples s ON p.subject=s.subject AND s.t_ms >= onset_ms - {H} AND s.t_ms < onset_ms + {3 * H} GROUP BY onset_id)
SELECT subject, onset_id, m IS NULL AS fallback, rnd(coalesce(m, CASE WHEN t1 IS NULL OR onset_ms-t0 <= t1-onset_ms THEN v0 ELSE v1 END)) AS epoch_mean FROM n LEFT JOIN m USING (onset_id)""")
def w6(c):
    return T.epoch_means(probes(c), c.view("samples"), ["subject"], "onset_id", "onset_ms", "t_ms", "value", H, 3 * H, 6 * H, DAY)


TSNR = """ts AS (SELECT run, voxel_id, count(*) AS n, count(value) AS n_finite, avg(value) AS mean, stddev_samp(value) AS sd FROM bold GROUP BY ALL),
tv AS (SELECT *, CASE WHEN n = n_finite AND mean > 0 AND sd > 1e-8 THEN mean/sd END AS tsnr FROM ts)"""


@query("a19_temporal_snr", f"WITH {TSNR} SELECT run, voxel_id, n, n_finite, rnd(mean) AS mean, rnd(sd) AS sd, rnd(tsnr) AS tsnr FROM tv")
def a19(c):
    return T.temporal_snr(c.view("bold"), "run", "voxel_id", "value")


@query("a19_tsnr_summary", f"""WITH {TSNR} SELECT run, count(*) AS n_voxels, count(tsnr) AS n_valid, rnd(avg(tsnr)) AS mean_tsnr,
 {', '.join(f"rnd(quantile_cont(tsnr, {q})) AS {n}" for n, q in (("p05", .05), ("p25", .25), ("p50", .5), ("p75", .75), ("p95", .95)))} FROM tv GROUP BY run""")
def a19_summary(c):
    return T.tsnr_summary(T.temporal_snr(c.view("bold"), "run", "voxel_id", "value"), "run")


@query("a19_tsnr_coverage", f"""WITH {TSNR}, v AS (SELECT voxel_id, avg(tsnr) AS m, count(tsnr) AS k FROM tv GROUP BY voxel_id)
SELECT count(*) AS any_mask, count(*) FILTER (k > 0) AS any_run, count(*) FILTER (k = 3) AS all_runs, rnd(avg(m)) AS equal_run_mean FROM v""")
def a19_coverage(c):
    t = T.temporal_snr(c.view("bold"), "run", "voxel_id", "value")
    return T.tsnr_coverage(T.tsnr_by_voxel(t, "voxel_id", 3), 3)


@query("a20_motion_quality", """
SELECT run, count(fd) AS n_frames, count(*) FILTER (fd > 0.5) AS n_high, rnd(count(*) FILTER (fd > 0.5)/count(fd)) AS fraction_high, rnd(avg(fd)) AS mean_fd,
 rnd(max(fd)) AS max_fd, rnd(median(fd)) AS median_fd FROM motion GROUP BY run""")
def a20(c):
    return T.motion_quality(c.view("motion"), ["run"], "fd")


@query("w10_spikes", "SELECT run, t, row_number() OVER (PARTITION BY run ORDER BY t) AS spike FROM motion WHERE fd > 0.5")
def w10(c):
    return T.spikes(c.view("motion"), ["run"], "t", "fd", 4096)


@query("v22_nuisance", """
WITH l AS (SELECT run, t, 'trans_x' AS name, trans_x AS v FROM motion UNION ALL SELECT run, t, 'trans_y', trans_y FROM motion UNION ALL SELECT run, t, 'rot_x', rot_x FROM motion),
z AS (SELECT run, t, name, v, avg(v) OVER (PARTITION BY run, name) AS m, stddev_pop(v) OVER (PARTITION BY run, name) AS s FROM l)
SELECT run, t, name, rnd((v-m)/s) AS value FROM z WHERE s > 0
UNION ALL SELECT run, t, 'spike'||row_number() OVER (PARTITION BY run ORDER BY t), 1.0 FROM motion WHERE fd > 0.5""")
def v22(c):
    return T.nuisance(c.view("motion"), ["run"], "t", ["trans_x", "trans_y", "rot_x"], "fd", 4096)


@query("v23_onset_bins", """
WITH f AS (SELECT onset_id, subject, CAST(round_even((onset_ms/1000.0 - 12.5)/5400, 0) AS BIGINT) AS frame FROM onsets)
SELECT *, count(*) OVER (PARTITION BY subject, frame) AS n_onsets, count(*) OVER (PARTITION BY subject, frame) > 1 AS collision FROM f""")
def v23(c):
    o = c.view("onsets").select("onset_id", "subject", (F.col("onset_ms") / 1000.0).alias("onset_s"))
    return T.onset_bins(o, ["subject"], "onset_s", 12.5, 5400.0).drop("onset_s")


SLOPE = [0.0, 1.0]


def design(c):
    return c.view("glm_x").select("t", F.array(F.lit(1.0), F.col("x")).alias("features"))


GLM = """j AS (SELECT voxel_id, t, y, x FROM glm_y JOIN glm_x USING (t)),
g AS (SELECT voxel_id, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, count(*) AS n, regr_syy(y, x) - regr_slope(y, x)*regr_sxy(y, x) AS sse, regr_sxx(y, x) AS sxx FROM j GROUP BY voxel_id)"""


def glm(c):
    y, d = cut_lineage(c.view("glm_y")), cut_lineage(design(c))
    return y, d, GL.dealt(y, d, ["voxel_id"], "t", "y")


@query("v20_linear_model", f"WITH {GLM} SELECT voxel_id, rnd(b1) AS effect, rnd(sqrt(sse/(n-2)/sxx)) AS se, rnd(b1/sqrt(sse/(n-2)/sxx)) AS t, n-2 AS df FROM g")
def v20(c):
    return L.contrast(GL.fit(glm(c)[2], [SLOPE]), ["voxel_id"], SLOPE)


RES = f"{GLM}, e AS (SELECT voxel_id, t, y - b0 - b1*x AS e FROM j JOIN g USING (voxel_id))"


@query("v20_residuals", f"WITH {RES} SELECT voxel_id, t, rnd(e) AS residual FROM e")
def v20_residuals(c):
    blocks = glm(c)[2]
    return GL.residuals(blocks, cut_lineage(GL.weights(blocks)))


RHO = f"""{RES}, el AS (SELECT voxel_id, t, e, CASE WHEN lag(t) OVER w = t-1 THEN lag(e) OVER w END AS p FROM e WINDOW w AS (PARTITION BY voxel_id ORDER BY t)),
r AS (SELECT voxel_id, sum(e*p)/sum(p*p) AS rho FROM el GROUP BY voxel_id)"""


def autocorrelation(c):
    y, d, blocks = glm(c)
    return y, d, GL.fit(blocks).select("voxel_id", "rho")


@query("v21_autocorrelation", f"WITH {RHO} SELECT voxel_id, rnd(rho) AS rho FROM r")
def v21(c):
    return autocorrelation(c)[2]


@query("v21_prais_winsten", f"""WITH {RHO}, m AS (SELECT greatest(-0.9, least(0.9, median(rho))) AS rho FROM r),
l AS (SELECT voxel_id, t, y, CASE WHEN lag(t) OVER w = t-1 THEN lag(y) OVER w END AS p FROM glm_y WINDOW w AS (PARTITION BY voxel_id ORDER BY t))
SELECT voxel_id, t, rnd(CASE WHEN p IS NULL THEN y*sqrt(1-rho*rho) ELSE y - rho*p END) AS whitened FROM l, m""")
def v21_whitened(c):
    y, _, rho = autocorrelation(c)
    return L.prais_winsten(y, L.pooled_ar1(rho), ["voxel_id"], "t", "y")


WHITE = f"""{RHO}, m AS (SELECT greatest(-0.9, least(0.9, median(rho))) AS rho FROM r),
ly AS (SELECT voxel_id, t, y, CASE WHEN lag(t) OVER w = t-1 THEN lag(y) OVER w END AS p FROM glm_y WINDOW w AS (PARTITION BY voxel_id ORDER BY t)),
wy AS (SELECT voxel_id, t, CASE WHEN p IS NULL THEN y*sqrt(1-rho*rho) ELSE y - rho*p END AS y FROM ly, m),
lx AS (SELECT t, x, CASE WHEN lag(t) OVER (ORDER BY t) = t-1 THEN lag(x) OVER (ORDER BY t) END AS p FROM glm_x),
wx AS (SELECT t, CASE WHEN p IS NULL THEN sqrt(1-rho*rho) ELSE 1-rho END AS a, CASE WHEN p IS NULL THEN x*sqrt(1-rho*rho) ELSE x - rho*p END AS b FROM lx, m),
ne AS (SELECT voxel_id, count(*) AS n, sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*y) AS ay, sum(b*y) AS byy, sum(y*y) AS yy FROM wy JOIN wx USING (t) GROUP BY voxel_id),
so AS (SELECT *, (bb*ay - ab*byy)/(aa*bb-ab*ab) AS b0, (aa*byy - ab*ay)/(aa*bb-ab*ab) AS b1 FROM ne),
sg AS (SELECT *, (yy - b0*ay - b1*byy)/(n-2) * aa/(aa*bb-ab*ab) AS var FROM so)"""


@query("v21_refit", f"WITH {WHITE} SELECT voxel_id, rnd(b1) AS effect, rnd(sqrt(var)) AS se, rnd(b1/sqrt(var)) AS t, (n-2)::INT AS df FROM sg")
def v21_refit(c):
    y, d, rho = autocorrelation(c)
    rho = L.pooled_ar1(rho)
    w = cut_lineage(L.prais_winsten(y, rho, ["voxel_id"], "t", "y"))
    f = GL.fit(GL.dealt(w, cut_lineage(L.prais_winsten_design(d, rho, "t")), ["voxel_id"], "t", "whitened"), [SLOPE])
    return L.contrast(f, ["voxel_id"], SLOPE)


@query("v19_covariance", """
WITH r AS (SELECT subject, roi, vec_id, pos, x - avg(x) OVER (PARTITION BY subject, roi, valence, pos) AS r FROM long_x),
g AS (SELECT a.subject, a.roi, a.pos AS i, b.pos AS j, sum(a.r*b.r) AS v FROM r a JOIN r b USING (subject, roi, vec_id) GROUP BY ALL),
q AS (SELECT subject, roi, count(*) AS n, sum(q) AS trace, sum(q*q) AS fourth FROM (SELECT subject, roi, vec_id, sum(r*r) AS q FROM r GROUP BY ALL) GROUP BY ALL),
s AS (SELECT subject, roi, n, trace/n/16 AS mu, trace/n AS tr, fourth, ss/(n*n) AS d_ FROM q JOIN (SELECT subject, roi, sum(v*v) AS ss FROM g GROUP BY ALL) USING (subject, roi)),
k AS (SELECT *, least((fourth/n - d_)/(16*n), (d_ - 2*mu*tr + 16*mu*mu)/16)/((d_ - 2*mu*tr + 16*mu*mu)/16) AS sh FROM s)
SELECT subject, roi, i, j, rnd(sh) AS shrinkage, rnd((1-sh)*v/n + CASE WHEN i=j THEN sh*mu ELSE 0 END) AS cov FROM g JOIN k USING (subject, roi)""")
def v19(c):
    return L.shrunk_covariance(patterns(c), ["subject", "roi"], "valence")


@query("v19_whitened_patterns")
def v19_whitened(c):
    p = patterns(c).select("vec_id", "subject", "roi", "valence", "features")
    return P.explode_features(L.whitened(p, ["subject", "roi"], "valence", "vec_id"), ["vec_id", "roi"])


@query("d20_whitening_leakage")
def d20(c):
    """Accuracy without whitening, with whitening from all trials of the subject (leaks), and from the
    training folds only, on the same folds."""
    p = patterns(c).select("vec_id", "subject", "roi", F.concat_ws("_", "source", "valence").alias("condition"), "features")
    f = K.stratified_folds(pool(c, WITHIN), ["subject", "contrast"], "vec_id", 3)
    u = U.units(f, p, ["subject"], ["contrast", "kind"], block=W.BLOCK, carry=("condition",))
    return D.roll_up(W.arms(u), ["arm", *CELL]).select("arm", *CELL, "accuracy")


@query("v19_whitening_certificate", """
SELECT subject, roi, i::INT AS i, j::INT AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM (SELECT DISTINCT subject FROM trials),
 (SELECT unnest(['r0','r1','r2','r3']) AS roi), (SELECT unnest(range(16)) AS i), (SELECT unnest(range(16)) AS j)""")
def v19_certificate(c):
    """The root times the covariance times the root is the identity."""
    key = ["subject", "roi"]
    cov = cut_lineage(L.shrunk_covariance(patterns(c), key, "valence").select(*key, "i", "j", "cov"))
    root = cut_lineage(L.inverse_root(cov, key).select(*key, "i", F.posexplode("row").alias("j", "w")))
    half = root.select(*key, "i", F.col("j").alias("k"), "w").join(
        cov.select(*key, F.col("i").alias("k"), "j", "cov"), [*key, "k"]).groupBy(*key, "i", "j").agg(F.sum(F.col("w") * F.col("cov")).alias("h"))
    return half.select(*key, "i", F.col("j").alias("k"), "h").join(
        root.select(*key, F.col("i").alias("k"), "j", "w"), [*key, "k"]).groupBy(*key, "i", "j").agg(F.sum(F.col("h") * F.col("w")).alias("v"))


@query("d20_unwhitened_arm", f"""WITH {POOL}, {fold_sql(3, ["subject", "contrast"], where="kind='within'")}, {rows_sql()}, {decode_sql(CELL, 'rws')}
SELECT 'none' AS arm, {", ".join(CELL)}, rnd(avg(accuracy)) AS accuracy FROM acc_f GROUP BY {", ".join(CELL)}""")
def d20_none(c):
    return d20(c).filter("arm = 'none'")
