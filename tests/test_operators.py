"""Known answers, brute force on small fixtures, invariants, empty input and heavy keys."""

import hashlib
import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxtrail.functions import arrays as A, stats, text
from voxtrail.functions.hashing import PRIME, hash32, poly_hash, poly_seed
from voxtrail.operators import (averaged as AV, compare as C, decode as D, folds as K, glm as GL, groupstats as G, leakage as W, linmodel as L, patterns as P,
                                permute as N, ranks as R, report as O, similarity as M, spatial as S, svm as SV, timeseries as T,
                                units as U, validate as V)
from voxtrail.session import scratch_path
from voxtrail.sources import tables


@pytest.fixture(scope="module")
def heavy(spark):
    """Two thirds of all rows share one key; half of its values are equal."""
    rng = np.random.default_rng(1)
    k = np.where(rng.random(6000) < 0.66, "hot", rng.choice(list("abcdef"), 6000))
    v = np.round(rng.lognormal(0, 3, 6000), 3) * rng.choice([-1, 1], 6000)
    v[(k == "hot") & (rng.random(6000) < 0.5)] = 1.25
    pdf = pd.DataFrame({"k": k, "id": np.arange(6000), "v": v})
    return pdf, spark.createDataFrame(pdf).repartition(8)


# ---- statistics ------------------------------------------------------------------------

def test_t_tail_known_values(spark):
    d = spark.createDataFrame([(1.0, 1), (2.0, 3), (2.5, 29), (0.0, 7), (-2.0, 3)], "t double, n int")
    p = [r[0] for r in d.select(stats.t_two_sided(F.col("t"), F.col("n"))).collect()]
    assert np.allclose(p, [0.5, 0.139326, 0.018325, 1.0, 0.139326], atol=1e-6)
    one = [r[0] for r in d.select(stats.t_greater(F.col("t"), F.col("n"))).collect()]
    assert np.allclose(one, [0.25, 0.069663, 0.0091627, 0.5, 1 - 0.069663], atol=1e-6)


def test_t_tail_large_df_is_normal(spark):
    d = spark.createDataFrame([(1.959964, 10 ** 7)], "t double, n long")
    assert abs(d.select(stats.t_two_sided(F.col("t"), F.col("n"))).first()[0] - 0.05) < 1e-6


def test_bh_known_and_monotone(spark, heavy):
    d = spark.createDataFrame([("f", x) for x in (0.01, 0.02, 0.03, 0.04)] + [("g", None), ("g", 0.2)], "f string, p double")
    q = {(r.f, r.p): r.q for r in R.bh_qvalues(d, "p", ["f"], "q").collect()}
    assert all(abs(q["f", x] - 0.04) < 1e-12 for x in (0.01, 0.02, 0.03, 0.04)) and q["g", None] is None and q["g", 0.2] == 0.2
    pdf = heavy[0].assign(p=lambda x: np.abs(np.tanh(x.v)) ** 2)
    got = R.bh_qvalues(spark.createDataFrame(pdf[["k", "id", "p"]]), "p", ["k"], "q").toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values("p")
        n = len(g)
        raw = g.p.to_numpy() * n / np.arange(1, n + 1)
        assert np.allclose(g.q, np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1]))


def test_quantiles_with_heavy_key(heavy):
    pdf, df = heavy
    got = R.exact_quantiles(df, ["k"], "v", {"q05": .05, "med": .5, "q99": .99}).toPandas().set_index("k")
    want = pdf.groupby("k").v.quantile([.05, .5, .99]).unstack()
    assert np.allclose(got.loc[want.index, ["q05", "med", "q99"]], want)


def test_row_numbers_and_ranks_with_heavy_key(heavy):
    pdf, df = heavy
    got = R.value_row_number(df, ["k"], "v", ["id"], "rn", descending=True, total="n").toPandas().set_index("id").sort_index()
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("k").cumcount().sort_index() + 1
    assert (got.rn == want).all() and (got.n == pdf.groupby("k").id.transform("count").to_numpy()).all()
    avg = R.average_ranks(df, ["k"], "v", "r").toPandas().set_index("id").sort_index()
    assert np.allclose(avg.r, pdf.groupby("k").v.rank())


def test_hash_order_is_a_permutation(heavy):
    _, df = heavy
    got = R.hash_row_number(df, ["k"], [F.lit("s")], ["id"], "rn").toPandas()
    for _, g in got.groupby("k"):
        assert sorted(g.rn) == list(range(1, len(g) + 1))
        assert abs(np.corrcoef(g.rn, g.id)[0, 1]) < 0.3


def test_group_tests_against_pandas(spark, heavy):
    pdf, df = heavy
    d = G.describe(df, ["k"], "v").toPandas().set_index("k")
    assert np.allclose(d["sd"], pdf.groupby("k").v.std().loc[d.index]) and np.allclose(d["median"], pdf.groupby("k").v.median().loc[d.index])
    w = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 2.0), (2, "b", 4.0), (3, "a", 0.0), (3, "b", 3.0)], "u int, c string, v double")
    t = G.paired_tests(w, [], "u", "c", "v", [("b", "a")]).first()
    assert abs(t.mean - 2) < 1e-12 and abs(t.t - 2 / (1 / np.sqrt(3))) < 1e-9


def test_flat_cell_and_tiny_groups(spark):
    d = spark.createDataFrame([("x", 1.0), ("x", 1.0), ("y", 2.0)], "k string, v double")
    r = {x.k: x for x in G.one_sample(d, ["k"], "v", 0.0).collect()}
    assert r["x"].t is None and r["x"].p is None and r["y"].sem is None
    f = {x.k: x for x in G.one_sample(d, ["k"], "v", 0.0, flat=(0.0, 1.0)).collect()}
    assert (f["x"].t, f["x"].p) == (0.0, 1.0)


def test_histogram_density_sums_to_one(heavy):
    pdf, df = heavy
    h = G.histogram(df, ["k"], "v").toPandas()
    for k, g in h.groupby("k"):
        v = pdf[pdf.k == k].v
        assert g["count"].sum() == len(v) and abs((g.density * (v.max() - v.min()) / 20).sum() - 1) < 1e-9


# ---- text, files, contracts ------------------------------------------------------------

def test_text_rules(spark):
    d = spark.createDataFrame([("2900.1",), ("2900.1_1.jpg",), ("a/b/2045_2.NII.GZ",), ("x_3_y",)], "s string")
    assert [r[0] for r in d.select(text.base_identity(F.col("s"))).collect()] == ["2900.1", "2900.1", "2045", "x_3_y"]
    n = spark.createDataFrame([("sub-07_run2",), ("none",)], "s string")
    assert [tuple(r) for r in n.select(text.subject_number(F.col("s")), text.subject_number(F.col("s"), True)).collect()] == [(7, 72 + 0), (None, None)]
    assert d.select(text.safe_name(F.lit("(a b)/c.d"))).first()[0] == "a_b_c.d"


def test_label_file(spark):
    path = scratch_path(spark, "labels")
    spark.createDataFrame([("﻿1 V1 x",), ("2.0 V2",), ("0 zero",), ("-3 neg",), ("4",), ("5 *.*.*.*.*",), ("name only",)], "value string").coalesce(1).write.text(path)
    assert sorted(map(tuple, tables.scan_labels(spark, path).collect())) == [(1, "V1"), (2, "V2")]


def test_missing_spellings(spark):
    d = spark.createDataFrame([("n/a",), ("NaN",), ("",), (" NA ",), ("0.5",)], "s string")
    assert [r[0] for r in d.select(tables.as_number(F.col("s"))).collect()] == [None] * 4 + [0.5]


def test_results_are_not_overwritten(spark):
    path = scratch_path(spark, "results")
    d = spark.range(2)
    tables.write_results(d, d, path)
    with pytest.raises(Exception):
        tables.write_results(d, d, path)


def _ledger():
    rows, prev = [], None
    for i in range(1, 9):
        body = {"event": "completed", "previous": prev, "sequence": i, "stage": f"s{i % 3}"}
        h = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
        rows.append((i, "completed", f"s{i % 3}", prev, h, json.dumps(body, sort_keys=True)))
        prev = h
    return rows


SCHEMA = "sequence long, event string, stage string, previous_event_sha256 string, event_sha256 string, canonical string"


def test_ledger_copies_in_one_pass(spark):
    rows = _ledger()
    d = spark.createDataFrame([*rows, *[rows[i] for i in (3, 4, 4)]], SCHEMA)  # copies of a row and of its successor
    found = V.ledger_issues(d, F.col("canonical"))
    assert sorted(map(tuple, found.collect())) == [(rows[i][0], "duplicate_sequence") for i in (3, 4)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Union" not in plan


def test_ledger_is_not_broadcast(spark):
    path = scratch_path(spark, "ledger")  # a file: small enough for a broadcast by its own size
    spark.createDataFrame(_ledger(), SCHEMA).write.parquet(path)
    d = V.ledger_issues(spark.read.parquet(path), F.col("canonical"))
    assert d.count() == 0 and "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_constant_in_many_parts_has_no_deviation(spark):
    d = spark.range(0, 490, 1, 10).select(F.lit(1).alias("run"), F.col("id").alias("t"), F.lit(1.0).alias("rot"),  # 49 rows a part: 1 / 49 * 49 < 1
                                          (F.col("id") * 0.1).alias("trans"), F.lit(0.0).alias("fd"))
    got = T.nuisance(d, ["run"], "t", ["rot", "trans"], "fd", 64).groupBy("name").count().collect()
    assert {tuple(r) for r in got} == {("trans", 490)}


def test_ledger_chain(spark):
    rows = _ledger()
    good = spark.createDataFrame(rows, SCHEMA)
    assert V.ledger_issues(good, F.col("canonical")).count() == 0
    V.require_none(V.ledger_issues(good, F.col("canonical")), "ledger")
    bad = [r if r[0] != 4 else (*r[:5], r[5].replace("s1", "s2")) for r in rows if r[0] != 6]
    got = {tuple(r) for r in V.ledger_issues(spark.createDataFrame(bad, SCHEMA), F.col("canonical")).collect()}
    assert got == {(4, "wrong_hash"), (7, "sequence_gap")}
    with pytest.raises(ValueError):
        V.require_none(V.ledger_issues(spark.createDataFrame(bad, SCHEMA), F.col("canonical")), "ledger")


def test_key_issues(spark):
    exp = V.dense_grid(spark.createDataFrame([(1,), (2,)], "s int"), {"r": ["a", "b"]})
    obs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (2, "a")], "s int, r string")
    got = {(r.s, r.r, r.issue) for r in V.key_issues(obs, exp, ["s", "r"]).collect()}
    assert got == {(1, "a", "duplicate"), (1, "b", "missing"), (2, "c", "unexpected")}


def test_excluded_runs(spark):
    d = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "s int, run int")
    assert [r.s for r in V.excluded_run_issues(d, "s", "run", [2]).collect()] == [2]
    with pytest.raises(ValueError):
        V.excluded_run_issues(d, "s", "run", [2, 2])


def test_stage_order_violation(spark):
    rows = [(1, "completed", 1, "a", "passed"), (2, "completed", 1, "b", "passed"), (3, "completed", 2, "b", "passed"), (4, "started", 3, "a", "x")]
    d = spark.createDataFrame(rows, "sequence long, event string, subject int, stage string, status string")
    got = {r.subject: (r.overall, r.order_violation) for r in V.stage_status(d, "subject", ["a", "b"]).collect()}
    assert got == {1: ("complete", False), 2: ("incomplete", True), 3: ("incomplete", False)}


# ---- patterns --------------------------------------------------------------------------

def test_array_functions(spark):
    d = spark.createDataFrame([([1.0, 2.0, 4.0], [2.0, 1.0, 7.0]), ([3.0, 3.0, 3.0], [1.0, None, 2.0])], "a array<double>, b array<double>")
    r = d.select(A.zscore(F.col("a")).alias("z"), A.corr(F.col("a"), F.col("b")).alias("r"), A.unit(F.col("a")).alias("u")).collect()
    x = np.array([1, 2, 4.0])
    assert np.allclose(r[0].z, (x - x.mean()) / x.std()) and r[1].z == [0, 0, 0] and r[1].u is None
    assert abs(r[0].r - np.corrcoef([1, 2, 4], [2, 1, 7])[0, 1]) < 1e-12 and r[1].r is None


def test_chunks_match_array_split(spark):
    for n, k in ((10, 3), (4, 4), (7, 2), (2, 3)):
        d = spark.range(n).select(P.chunk_of(F.col("id"), F.lit(n), k).alias("c"))
        want = np.concatenate([np.full(len(c), i) for i, c in enumerate(np.array_split(np.arange(n), k))])
        assert [r.c for r in d.collect()] == want.tolist()


def test_run_wise_scaling_uses_other_runs(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": 1, "run": np.repeat([0, 1, 2], 4), "pos": 0, "x": rng.normal(1e6, 1, 12)})
    got = P.run_wise_zscore(spark.createDataFrame(pdf), ["g"], "run").toPandas().sort_values("run").x.to_numpy()
    want = np.concatenate([(pdf.x[pdf.run == r] - pdf.x[pdf.run != r].mean()) / pdf.x[pdf.run != r].std(ddof=0) for r in (0, 1, 2)])
    assert np.allclose(sorted(got), sorted(want), atol=1e-4)


def test_pairs_with_many_masks(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(24):
        x = rng.normal(size=8)
        x = [None if rng.random() < 0.2 else float(v) for v in x]
        rows.append((i % 2, "ab"[i // 2 % 2], i, x))
    d = spark.createDataFrame(rows, "k int, c string, id int, features array<double>")
    got = {r.k: (r.mean_r, r.n_pairs) for r in M.cross_similarity(d, ["k"], "c", "a", "b", 4).collect()}
    for k in (0, 1):
        rs = []
        for p, q in itertools.product([r[3] for r in rows if r[:2] == (k, "a")], [r[3] for r in rows if r[:2] == (k, "b")]):
            ok = [(x, y) for x, y in zip(p, q) if x is not None and y is not None]
            if len(ok) >= 4:
                rs.append(np.corrcoef(*np.array(ok).T)[0, 1])
        assert got[k][1] == len(rs) and abs(got[k][0] - np.mean(rs)) < 1e-9


def test_dissimilarity_blocks_agree(spark):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(0, i, [float(v) for v in rng.normal(size=5)]) for i in range(30)], "k int, id int, features array<double>")
    one = {(r.a, r.b): r.dissimilarity for r in M.dissimilarity(d, ["k"], "id").collect()}
    many = {(r.a, r.b): r.dissimilarity for r in M.dissimilarity(d, ["k"], "id", rows_per_block=7).collect()}
    assert len(one) == 435 and one.keys() == many.keys() and all(abs(one[p] - many[p]) < 1e-12 for p in one)


# ---- folds, decoding -------------------------------------------------------------------

@pytest.fixture(scope="module")
def planted(spark):
    """7 x 7 x 7 grid, 5 runs, 2 sources x 3 valences x 4 images; emotional trials gain 1.25 in
    the central 3 x 3 x 3 block."""
    rng = np.random.default_rng(5)
    grid = np.array(list(itertools.product(range(7), repeat=3)))
    centre = np.all((grid >= 2) & (grid <= 4), axis=1)
    rows, t = [], 0
    for run, src, val, image in itertools.product(range(5), ("natural", "ai"), ("pleasant", "neutral", "unpleasant"), range(4)):
        x = rng.normal(size=343) + (1.25 * centre if val != "neutral" else 0)
        rows.append((t, 1, src, run, val, f"{val}{image}", "all", [float(v) for v in x]))
        t += 1
    p = spark.createDataFrame(rows, "vec_id int, subject int, source string, run int, valence string, image string, roi string, features array<double>")
    v = spark.createDataFrame([(n, *map(int, g)) for n, g in enumerate(grid)], "pos int, i long, j long, k long")
    return p, v


KEYS = ["subject", "contrast", "kind"]


@pytest.mark.parametrize("scorer", ["lda", "centroid"])
@pytest.mark.parametrize("cv", ["run", "identity"])
def test_planted_signal(planted, scorer, cv):
    p, v = planted
    pool = K.contrast_pool(p.drop("features", "roi"))
    f = K.run_folds(pool) if cv == "run" else K.identity_folds(pool, ["subject", "contrast"], "image", 4)
    assert cv == "run" or K.leaked_families(f, ["subject", "contrast"], "image").count() == 0
    rows = D.attach(f, p, "vec_id", KEYS)
    model = [*KEYS, "roi"]
    keys = [*model, "fold"]
    w = D.linear_weights(D.fold_statistics(rows, model), keys, scorer)
    acc = D.fold_accuracy(D.decisions(rows, w, keys), keys).toPandas().accuracy
    assert acc.between(0, 1).all() and acc.mean() > 0.8
    sl = D.searchlight(D.evidence(rows, w, keys), S.lattice_neighbours(v, "pos", 1.0, least=4), keys, 4).toPandas()
    m = sl.groupby("centre").accuracy.mean()
    assert m.loc[171] > 0.75 and m.loc[171] > m.loc[0] + 0.15


def test_fold_weights_against_numpy(planted):
    p, _ = planted
    pool = K.contrast_pool(p.drop("features", "roi"), K.CONTRASTS[:1])
    rows = D.attach(K.run_folds(pool), p, "vec_id", KEYS)
    model = [*KEYS, "roi"]
    got = D.cross_validate(rows, model).toPandas().set_index("fold").accuracy
    pdf = p.toPandas()
    pdf = pdf[(pdf.source == "natural") & pdf.valence.isin(["pleasant", "neutral"])]
    x, y = np.stack(pdf.features), (pdf.valence == "pleasant").to_numpy().astype(int)
    for fold in range(5):
        tr, te = (pdf.run != fold).to_numpy(), (pdf.run == fold).to_numpy()
        mu, sd = x[tr].mean(0), x[tr].std(0, ddof=1)
        z = (x - mu) / sd
        m0, m1 = z[tr & (y == 0)].mean(0), z[tr & (y == 1)].mean(0)
        n0, n1 = (tr & (y == 0)).sum(), (tr & (y == 1)).sum()
        pooled = ((n0 - 1) * z[tr & (y == 0)].var(0, ddof=1) + (n1 - 1) * z[tr & (y == 1)].var(0, ddof=1)) / (n0 + n1 - 2)
        den = 0.9 * pooled + 0.1
        score = z[te] @ ((m1 - m0) / den) - 0.5 * ((m1 ** 2 - m0 ** 2) / den).sum()
        assert abs(got[fold] - np.mean((score > 0) == y[te])) < 1e-12


def test_identical_classes_and_missing_class(spark):
    rows = [(m, f, f"{f}{y}{i}", y, True, True, 0, float(i)) for m in (1,) for f in range(3) for y in (0, 1) for i in range(4)]
    rows += [(2, f, f"{f}{i}", 1, True, True, 0, float(i)) for f in range(3) for i in range(4)]
    d = spark.createDataFrame(rows, "m int, fold int, trial string, y int, is_train boolean, is_test boolean, pos int, x double")
    got = D.cross_validate(d, ["m"]).toPandas()
    assert np.allclose(got[got.m == 1].accuracy, 0.5)
    assert got[got.m == 2].accuracy.isna().all() and (got[got.m == 2].n_test == 4).all()


def test_svm_on_planted_signal(planted):
    p, _ = planted
    f = K.run_folds(K.contrast_pool(p.drop("features", "roi"), K.CONTRASTS[:2]))
    d = f.join(P.pattern_zscore(p).select("vec_id", "roi", "features"), "vec_id").withColumnRenamed("vec_id", "trial")
    acc = D.hinge_validate(d, [*KEYS, "roi"]).toPandas()
    rows = P.explode_features(d, [*KEYS, "roi", "fold", "trial", "y", "is_train", "is_test"])
    centroid = D.cross_validate(rows, [*KEYS, "roi"], "centroid").toPandas()
    assert len(acc) == 10 and acc.accuracy.mean() > max(0.65, centroid.accuracy.mean() - 0.1)


def test_svm_objective_close_to_optimum(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(60, 2)), np.repeat([0, 1], 30)
    x[y == 1] += 1.5
    rows = [(1, int(i % 3), int(i), int(y[i]), True, True, [float(v) for v in x[i]]) for i in range(60)]
    d = spark.createDataFrame(rows, "m int, fold int, trial int, y int, is_train boolean, is_test boolean, features array<double>")
    w = {r.fold: np.array([*r.w, r.offset]) for r in D.hinge_models(d, ["m"]).collect()}

    def loss(v, f):
        tr = np.arange(60) % 3 != f
        s = 2 * y[tr] - 1
        return 0.5 * v[:2] @ v[:2] + np.maximum(0, 1 - s * (np.c_[x[tr], np.ones(tr.sum())] @ v)).sum()
    for f in range(3):
        v = np.zeros(3)
        for step in range(1, 20001):
            tr = np.arange(60) % 3 != f
            s, z = 2 * y[tr] - 1, np.c_[x[tr], np.ones(tr.sum())]
            v = v * (1 - 1 / step) + (s[:, None] * z)[s * (z @ v) < 1].sum(0) / step
        assert loss(w[f], f) < loss(v, f) * 1.005 + 0.01


def test_balanced_keeps_all_of_the_smaller_class(spark):
    d = spark.createDataFrame([(1, i, int(i < 5)) for i in range(30)], "m int, t int, y int")
    got = K.balanced(d, ["m"], "t").groupBy("y").count().collect()
    assert {(r.y, r["count"]) for r in got} == {(0, 5), (1, 5)}


def test_folds_partition_the_pool(heavy):
    _, df = heavy
    d = df.withColumn("y", (F.col("v") > 1.25).cast("int"))
    got = K.stratified_folds(d, ["k"], "id", 5).toPandas()
    n = got.groupby(["k", "y", "fold"]).size().unstack()
    assert len(got) == 6000 and (n.max(axis=1) - n.min(axis=1) <= 1).all()


# ---- permutation -----------------------------------------------------------------------

def test_shuffles_keep_counts_and_differ(heavy):
    _, df = heavy
    d = N.with_permutations(df.withColumn("y", (F.col("id") % 3).cast("int")), 3, observed=False)
    got = N.shuffle_labels(d, ["k", "permutation"], "y", "id", [F.col("permutation")], "s").toPandas()
    assert (got.groupby(["k", "permutation", "y"]).size() == got.groupby(["k", "permutation", "s"]).size().rename_axis(["k", "permutation", "y"])).all()
    hot = got[got.k == "hot"].pivot(index="id", columns="permutation", values="s")
    assert (hot[1] != hot[2]).mean() > 0.5 and abs(np.corrcoef(hot[1], hot[2])[0, 1]) < 0.1


def test_resampling_distribution(spark):
    rng = np.random.default_rng(7)
    rows = [("c", s, i, float(v)) for s in range(10) for i, v in enumerate(rng.normal(0.5, 0.1, 50))]
    pool = spark.createDataFrame(rows, "cell string, s int, permutation int, v double")
    d = N.resample_group(pool, ["cell"], "s", "permutation", "v", 4000, "x").toPandas()
    means = np.array([np.mean([r[3] for r in rows if r[1] == s]) for s in range(10)])
    sds = np.array([np.std([r[3] for r in rows if r[1] == s]) for s in range(10)])
    assert len(d) == 4000 and (d.n_subjects == 10).all()
    assert abs(d.null_mean.mean() - means.mean()) < 0.002 and abs(d.null_mean.std() - np.sqrt((sds ** 2).sum()) / 10) < 0.002


def test_poly_hash_is_uniform(spark):
    d = spark.range(20000).select((poly_hash(poly_seed(F.lit("a"), F.lit(1)), F.col("id")) % 7).alias("h"))
    n = [r["count"] for r in d.groupBy("h").count().collect()]
    assert len(n) == 7 and max(n) < 3200 and min(n) > 2500
    assert spark.range(1).select(hash32(F.lit("a"), F.lit(1))).first()[0] == int(hashlib.md5(b"a|1").hexdigest()[:8], 16)


def test_empirical_p_counts(spark):
    draws = spark.createDataFrame([("c", i, float(i)) for i in range(10)], "cell string, draw int, null_mean double")
    obs = spark.createDataFrame([("c", 7.0)], "cell string, v double")
    assert abs(N.empirical_p(draws, obs, ["cell"], "v").first().p - 4 / 11) < 1e-12


# ---- space -----------------------------------------------------------------------------

def _grid(spark, points):
    return spark.createDataFrame([(n, *map(int, p)) for n, p in enumerate(points)], "voxel_id long, i long, j long, k long")


def test_smoothing_keeps_a_constant(spark):
    g = _grid(spark, [p for p in itertools.product(range(5), repeat=3) if sum(p) % 4]).withColumn("v", F.lit(1.0))
    got = S.smooth(g, [], "v", 5.0, (2.0, 2.0, 2.0)).toPandas()
    assert len(got) == g.count() and np.allclose(got.smoothed, 1.0)


def test_components_touching_corners(spark):
    g = _grid(spark, [(0, 0, 0), (1, 1, 1), (5, 5, 5), (7, 5, 5)])
    assert {r.voxel_id: r.label for r in S.components(g, [], "voxel_id").collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_components_long_chain(spark):
    order = np.random.default_rng(8).permutation(200)
    g = spark.createDataFrame([(int(order[n]), n, 0, 0) for n in range(200)], "voxel_id long, i long, j long, k long")
    assert {r.label for r in S.components(g, [], "voxel_id").collect()} == {0}


def test_lattice_and_points_agree(spark):
    g = _grid(spark, list(itertools.product(range(4), repeat=3)))
    a = {tuple(r) for r in S.lattice_neighbours(g, "voxel_id", 3.0, (2.0, 2.0, 2.0)).collect()}
    xyz = g.select("voxel_id", *[(F.col(c) * 2.0).alias(n) for c, n in zip("ijk", "xyz")])
    assert a == {tuple(r) for r in S.point_neighbours(xyz, "voxel_id", ["x", "y", "z"], 3.0).collect()}


def test_exploded_neighbours_are_not_broadcast(spark):
    path = scratch_path(spark, "grid")  # a file: small enough for a broadcast by its own size
    _grid(spark, list(itertools.product(range(4), repeat=3))).withColumn("v", F.lit(1.0)).write.parquet(path)
    g = spark.read.parquet(path)
    for d in (S.lattice_neighbours(g, "voxel_id", 4.0, (2.0, 2.0, 2.0)), S.smooth(g, [], "v", 4.3, (2.0, 2.0, 2.0))):
        assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_centroid_falls_back(spark):
    d = spark.createDataFrame([("r", 1.0, 1.0, 0.0), ("r", 1.0, float("inf"), 4.0)], "roi string, a double, b double, x double")
    assert S.region_overlap(d, ["roi"], "a", "b", ["x"], 8.0).first().centre_x == 2.0


def test_lobes(spark):
    names = [("Cuneus_L", "Occipital"), ("ParaHippocampal_R", "Medial temporal"), ("Temporal_Mid", "Temporal"), ("Nothing", "Other")]
    d = spark.createDataFrame(names, "n string, want string")
    assert d.filter(S.lobe(F.col("n")) != F.col("want")).count() == 0


# ---- time ------------------------------------------------------------------------------

def test_moving_mean_over_block_edges(spark):
    rng = np.random.default_rng(9)
    v = [None if rng.random() < 0.1 else float(x) for x in rng.normal(size=9000)]
    d = spark.createDataFrame([(0, i, v[i]) for i in range(9000)], "k int, t long, v double")
    got = T.moving_mean(d, ["k"], "t", "v", 6, [], 500.0).toPandas().sort_values("t").moving_mean
    s = pd.Series(v, dtype=float)
    want = [s[max(0, i - 3):i + 3].mean() for i in range(9000)]
    assert np.allclose(got, want, equal_nan=True)


def test_plateau_peak_takes_first_row(spark):
    d = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate([0, 1, 2, 2, 2, 1, 0, 0, 3])], "k int, t long, v double")
    got = {(r.t, r.kind) for r in T.extrema(d, ["k"], "t", "v", [], 3.0).collect()}
    assert got == {(2, "max"), (6, "min")}


def test_nearest_across_blocks(spark):
    s = spark.createDataFrame([(0, 0, 1.0), (0, 50, None), (0, 100, 3.0), (0, 1000, 4.0)], "k int, t long, v double")
    p = spark.createDataFrame([(0, 1, 50), (0, 2, 700), (0, 3, 5000), (0, 4, -10), (0, 5, 100)], "k int, id long, at long")
    got = {r.id: (r.nearest_t, r.nearest) for r in T.nearest_value(p, s, ["k"], "id", "at", "t", "v", 10.0).collect()}
    assert got == {1: (0, 1.0), 2: (1000, 4.0), 3: (1000, 4.0), 4: (0, 1.0), 5: (100, 3.0)}
    line = {r.id: r.interpolated for r in T.interpolate(p, s, ["k"], "id", "at", "t", "v", 10.0).collect()}
    assert line[1] == 2.0 and line[3] is None and line[5] == 3.0


def test_tsnr_fixture(spark):
    rng = np.random.default_rng(10)
    rows = []
    for run, n in ((1, 5), (2, 7)):
        for voxel in range(4):
            if voxel == 3 and run == 2:
                continue  # covered in the first run only
            for t in range(n):
                v = 100 + float(rng.normal())
                rows.append((run, voxel, t, 5.0 if voxel == 1 else None if (voxel == 2 and t == 1) else v))
    d = spark.createDataFrame(rows, "run int, voxel int, t int, v double")
    t = T.temporal_snr(d, "run", "voxel", "v")
    ok = {(r.run, r.voxel) for r in t.filter("tsnr IS NOT NULL").collect()}
    assert ok == {(1, 0), (1, 3), (2, 0)}
    cov = T.tsnr_coverage(T.tsnr_by_voxel(t, "voxel", 2), 2).first()
    assert (cov.any_mask, cov.any_run, cov.all_runs) == (4, 2, 1)


def _glm(spark, drop=()):
    rng = np.random.default_rng(11)
    x = np.c_[np.ones(30), rng.normal(size=(30, 2))]
    y = x @ np.array([[2.0, 1.0], [0.5, -1.0], [0.0, 3.0]]) + rng.normal(size=(30, 2))
    rows = [(v, t, float(y[t, v])) for v in (0, 1) for t in range(30) if (v, t) not in drop]
    return x, y, spark.createDataFrame(rows, "v int, t int, y double"), spark.createDataFrame(
        [(t, [float(a) for a in x[t]]) for t in range(30)], "t int, features array<double>")


def test_linear_model_with_a_gap(spark):
    x, y, yd, xd = _glm(spark, drop={(1, 4), (1, 9)})
    f = GL.fit(GL.dealt(yd, xd, ["v"], "t", "y")).toPandas().set_index("v")
    keep = [t for t in range(30) if t not in (4, 9)]
    for v, rows in ((0, list(range(30))), (1, keep)):
        beta, sse, *_ = np.linalg.lstsq(x[rows], y[rows, v], rcond=None)
        assert np.allclose(f.loc[v, "beta"], beta) and abs(f.loc[v, "sigma2"] - sse[0] / (len(rows) - 3)) < 1e-9
    assert [r.v for r in L.incomplete_units(yd, xd, ["v"], "t", "y").collect()] == [1]


@pytest.mark.parametrize("span,chunks", [(None, None), (7, 2), (1, 3), (4, 1)])
def test_linear_model_in_time_blocks(spark, span, chunks):
    rng = np.random.default_rng(14)
    x = np.c_[np.ones(40), rng.normal(size=(40, 2))]
    y = {(f"u{v}", v): x @ rng.normal(size=3) + np.cumsum(rng.normal(size=40)) for v in range(5)}
    gone = {("u1", t) for t in (6, 7, 20)} | {("u2", t) for t in range(13)} | {("u3", t) for t in range(40) if t != 9}
    rows = [(a, b, t, float(v[t])) for (a, b), v in y.items() for t in range(40) if (a, t) not in gone]
    rows += [("u0", 0, 99, 5.0), ("u4", 4, -3, 1.0), ("u1", 1, 6, None), ("u1", 1, 7, float("nan"))]
    yd = spark.createDataFrame(rows, "a string, b int, t int, y double").repartition(3)
    xd = spark.createDataFrame([(t, r.tolist()) for t, r in enumerate(x)], "t int, features array<double>")
    blocks = GL.dealt(yd, xd, ["a", "b"], "t", "y", span, chunks)
    f = {r.a: r for r in GL.fit(blocks, [[0.0, 1.0, 0.0]]).collect()}
    e = {(r.a, r.t): r.residual for r in GL.residuals(blocks, GL.weights(blocks)).collect()}
    assert len(f) == 5 and len(e) == sum(1 for r in rows if r[3] == r[3] and r[3] is not None and 0 <= r[2] < 40)
    for (a, _), v in y.items():
        keep = [t for t in range(40) if (a, t) not in gone]
        beta = np.linalg.pinv(x[keep]) @ v[keep]
        rest = dict(zip(keep, v[keep] - x[keep] @ beta))
        assert np.allclose(f[a].beta, beta, atol=1e-8) and all(abs(e[a, t] - r) < 1e-8 for t, r in rest.items())
        rank = np.linalg.matrix_rank(x[keep])
        assert f[a].df == len(keep) - rank and (f[a].sigma2 is None) == (len(keep) == rank)
        if len(keep) > 3:
            pairs = [(rest[t], rest[t - 1]) for t in keep if t - 1 in rest]
            assert abs(f[a].sigma2 - sum(r * r for r in rest.values()) / (len(keep) - rank)) < 1e-9
            assert abs(f[a].rho - sum(p * q for p, q in pairs) / sum(q * q for _, q in pairs)) < 1e-9
            assert abs(f[a].scale[0] - np.linalg.inv(x[keep].T @ x[keep])[1, 1]) < 1e-9


def test_prewhitened_refit(spark):
    x, y, yd, xd = _glm(spark)
    rho = 0.4
    w = L.prais_winsten(yd, rho, ["v"], "t", "y")
    f = GL.fit(GL.dealt(w, L.prais_winsten_design(xd, rho, "t"), ["v"], "t", "whitened")).toPandas().set_index("v")

    def white(m):
        return np.r_[m[:1] * np.sqrt(1 - rho ** 2), m[1:] - rho * m[:-1]]
    for v in (0, 1):
        assert np.allclose(f.loc[v, "beta"], np.linalg.lstsq(white(x), white(y[:, v]), rcond=None)[0])


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(12)
    mix = rng.normal(size=(4, 4))
    x = rng.normal(size=(80, 4)) @ mix
    cond = np.repeat(["a", "b"], 40)
    d = spark.createDataFrame([(1, i, str(cond[i]), [float(v) for v in x[i]]) for i in range(80)], "k int, id int, c string, features array<double>")
    cov = L.shrunk_covariance(d, ["k"], "c")
    r = np.concatenate([x[cond == c] - x[cond == c].mean(0) for c in "ab"])
    emp = r.T @ r / 80
    mu = np.trace(emp) / 4
    delta = ((emp - mu * np.eye(4)) ** 2).sum() / 4
    beta = sum(((np.outer(v, v) - emp) ** 2).sum() for v in r) / 80 / 80 / 4
    s = min(beta, delta) / delta
    want = (1 - s) * emp + s * mu * np.eye(4)
    got = np.zeros((4, 4))
    for c in cov.collect():
        got[c.i, c.j] = c["cov"]
    assert np.allclose(got, want)
    val, vec = np.linalg.eigh(want)
    w = L.whiten(d, L.inverse_root(cov, ["k"]), ["k"], "id", ["c"], rows_per_block=16).toPandas().sort_values("id")
    assert np.allclose(np.stack(w.features), x @ ((vec * val ** -0.5) @ vec.T))


# ---- empty input -----------------------------------------------------------------------

def test_empty_inputs(spark):
    e = spark.createDataFrame([], "contrast string, roi string, subject int, accuracy double")
    assert G.group_cells(e, "contrast", "roi", "subject", "accuracy").count() == 0
    assert R.exact_quantiles(e, ["roi"], "accuracy", {"m": .5}).count() == 0
    v = spark.createDataFrame([], "voxel_id long, i long, j long, k long, v double")
    assert S.components(v, [], "voxel_id").count() == 0 and S.smooth(v, [], "v", 4.0, (2.0, 2.0, 2.0)).count() == 0
    assert S.region_overlap(v.withColumn("roi", F.lit("r")), ["roi"], "v", "v", ["v"], 8.0).count() == 0
    s = spark.createDataFrame([], "k int, t long, v double")
    assert T.moving_mean(s, ["k"], "t", "v", 4, [], 10.0).count() == 0 and T.extrema(s, ["k"], "t", "v", [], 10.0).count() == 0
    f = spark.createDataFrame([], "k int, id int, features array<double>")
    assert M.dissimilarity(f, ["k"], "id").count() == 0 and M.within_similarity(f, ["k"], 2).count() == 0
    assert O.top_fraction(s, ["k"], "t", "v", 0.5, 3).count() == 0 and C.first_of(s, ["k"], ["t"]).count() == 0


def test_wide_design(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 670))
    y = x[:, :2] @ np.array([[1.0, 0.0], [2.0, -1.0]]) + 0.1 * rng.normal(size=(700, 2))
    yd = spark.createDataFrame([(v, t, float(y[t, v])) for v in (0, 1) for t in range(700)], "v int, t int, y double")
    xd = spark.createDataFrame([(t, x[t].tolist()) for t in range(700)], "t int, features array<double>")
    f = GL.fit(GL.dealt(yd, xd, ["v"], "t", "y", span=300), [[1.0] + [0.0] * 669]).toPandas().set_index("v")
    for v in (0, 1):
        assert np.allclose(f.loc[v, "beta"], np.linalg.lstsq(x, y[:, v], rcond=None)[0], atol=1e-8) and f.loc[v, "df"] == 30
    assert np.isclose(f.loc[0, "scale"][0], np.linalg.inv(x.T @ x)[0, 0])


def test_similarity_of_many_masks(spark, monkeypatch):
    """Missing values scattered anywhere: every row has its own mask."""
    rng = np.random.default_rng(41)
    x = rng.normal(size=(150, 9)) + rng.normal(size=9)
    x[rng.random(x.shape) < 0.25] = np.nan
    x[7] = 2.0
    rows = [("k" if i < 130 else "l", "ab"[i % 2], [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    d = spark.createDataFrame(rows, "k string, c string, features array<double>")

    def brute(a, b):
        both = np.isfinite(x[a]) & np.isfinite(x[b])
        if both.sum() < 5 or np.ptp(x[a][both]) == 0 or np.ptp(x[b][both]) == 0:
            return None
        return np.corrcoef(x[a][both], x[b][both])[0, 1]

    monkeypatch.setattr(M, "TILE_ROWS", 20)
    for key, ids in (("k", range(130)), ("l", range(130, 150))):
        cross = [r for a in ids for b in ids if a % 2 == 0 and b % 2 == 1 and (r := brute(a, b)) is not None]
        within = [r for a in ids for b in ids if a < b and (r := brute(a, b)) is not None]
        got = {r.k: r for r in M.cross_similarity(d, ["k"], "c", "a", "b", 5).collect()}[key]
        own = {r.k: r for r in M.within_similarity(d, ["k"], 5).collect()}[key]
        assert got.n_pairs == len(cross) and abs(got.mean_r - np.mean(cross)) < 1e-9
        assert own.n_pairs == len(within) and abs(own.mean_r - np.mean(within)) < 1e-9


def test_dissimilarity_correlations_of_regions(spark):
    rng = np.random.default_rng(43)
    x = {"p": rng.normal(size=(20, 5)), "q": rng.normal(size=(20, 7)), "s": rng.normal(size=(20, 4))}
    x["q"][3] = 1.0  # does not vary there
    d = spark.createDataFrame([(i, *[x[k][i].tolist() for k in x]) for i in range(20)], "id int, p array<double>, q array<double>, s array<double>")
    got = {(r.region_a, r.region_b): r for r in M.dissimilarity_correlations(d, ["p", "q", "s"]).collect()}
    for a, b in itertools.combinations(x, 2):
        items = [i for i in range(20) if not ("q" in (a, b) and i == 3)]
        up = np.triu_indices(len(items), 1)
        want = np.corrcoef(np.corrcoef(x[a][items])[up], np.corrcoef(x[b][items])[up])[0, 1]
        assert got[a, b].n_pairs == len(up[0]) and abs(got[a, b].r - want) < 1e-9


def test_neighbours_in_a_crowded_cell(spark):
    rng = np.random.default_rng(42)
    p = np.concatenate([rng.random((300, 3)), rng.random((300, 3)) * 6])  # half of all points in one cell
    d = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id int, x double, y double, z double")
    d2 = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(d2 <= 1.0))}
    found = S.point_neighbours(d, "id", ["x", "y", "z"], 1.0, crowded=25)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_small_svm_is_a_minimum():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.normal(size=(8, 5)), np.repeat([-1.0, 1.0], 4)
        w, b = AV.small_svm(x, y, 1.0)

        def loss(w, b):
            return w @ w / 2 + np.maximum(0, 1 - y * (x @ w + b)).sum()
        for scale in (1e-3, 1e-1):
            for _ in range(50):
                assert loss(w + scale * rng.normal(size=5), b + scale * rng.normal()) >= loss(w, b) - 1e-6


# ---- decoding in units -----------------------------------------------------------------

@pytest.fixture(scope="module")
def unit_tables(spark):
    """Trials of two subjects with missing values; two contrasts, one with training-only rows."""
    rng = np.random.default_rng(12)
    pats, labels = [], []
    for t in range(240):
        x = rng.normal(size=12) + 0.7 * (t // 2 % 2) * (np.arange(12) < 4)
        x = [None if rng.random() < 0.03 else float(v) for v in x]
        x[11] = 1.5  # without variance
        pats.append((t % 2, "r", t, x))
        labels.append((t % 2, "a", "within", t, t // 2 % 2, t // 4 % 4, True, True))
        labels.append((t % 2, "b", "cross", t, t // 4 % 2, 0 if t % 3 == 0 else -1, t % 3 != 0, t % 3 == 0))
        if t % 5 == 0:  # one class in one fold
            labels.append((t % 2, "c", "within", t, 0, t // 20 % 2, True, True))
    return (spark.createDataFrame(labels, "subject int, contrast string, kind string, vec_id int, y int, fold long, is_train boolean, is_test boolean"),
            spark.createDataFrame(pats, "subject int, roi string, vec_id int, features array<double>").repartition(4))


UNIT = ["subject", "roi", "contrast", "kind"]


def rows_of(df):
    return sorted((tuple(-9 if v is None else round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("scorer", ["lda", "centroid"])
def test_units_equal_long_rows(unit_tables, scorer):
    labels, pats = unit_tables
    long = P.explode_features(labels.join(pats.drop("subject"), "vec_id").withColumnRenamed("vec_id", "trial"),
                              [*UNIT, "fold", "trial", "y", "is_train", "is_test"])
    want = rows_of(D.cross_validate(long, UNIT, scorer).fillna(0, ["n_correct"]).select(*UNIT, "fold", *U.COUNTS, "accuracy"))
    for block in (1 << 24, 1500):
        u = U.units(labels, pats, ["subject"], ["contrast", "kind"], block=block)
        assert u.cut == (block == 1500)
        assert rows_of(U.cross_validate(u, U.Scorer(scorer))) == want and len(want) > 10


@pytest.mark.parametrize("select", ["weight", "haufe"])
def test_selection_in_cut_units(unit_tables, select):
    labels, pats = unit_tables
    one, cut = (U.units(labels, pats, ["subject"], ["contrast", "kind"], block=b) for b in (1 << 24, 1500))
    s = U.Scorer(select=select, fraction=0.25, least=2)
    assert rows_of(U.selected(one, s)) == rows_of(U.selected(cut, s))
    assert rows_of(U.cross_validate(one, s)) == rows_of(U.cross_validate(cut, s))
    assert rows_of(U.haufe_patterns(one)) == rows_of(U.haufe_patterns(cut))
    picked = U.selected(one, s).groupBy(*UNIT, "fold").agg(F.count("pos").alias("n"), F.max("pos").alias("last")).collect()
    assert {r.n for r in picked} == {3} and all(r["last"] < 11 for r in picked)
    with pytest.raises(ValueError):
        U.Scorer(select="other").chosen(np.ones((1, 2)), None)


def test_units_of_nothing(unit_tables):
    labels, pats = unit_tables
    for a, b in ((labels.limit(0), pats), (labels, pats.limit(0))):
        assert U.cross_validate(U.units(a, b, ["subject"], ["contrast", "kind"])).count() == 0


@pytest.mark.parametrize("n,p", [(40, 15), (14, 33)])
def test_whitening_by_trials_equals_the_covariance(spark, n, p):
    rng = np.random.default_rng(n)
    mix = rng.normal(size=(p, p)) / 3 + np.eye(p)
    rows = [(k, i, "ab"[i % 2], 7 * i, (rng.normal(size=p) @ mix + i % 2).tolist()) for k in ("u", "v") for i in range(n)]
    d = spark.createDataFrame(rows, "k string, id int, c string, z int, features array<double>")
    want = L.whiten(d, L.inverse_root(L.shrunk_covariance(d, ["k"], "c"), ["k"]), ["k"], "id", ["z"])
    for tile in (4, 1000):
        got = L.whitened(d, ["k"], "c", "id", ["z"], tile).select(*want.columns)
        for a, b in zip(sorted(want.collect(), key=lambda r: r[:2]), sorted(got.collect(), key=lambda r: r[:2])):
            assert a[:3] == b[:3] and np.allclose(a.features, b.features, atol=1e-8)


def test_whitening_of_twenty_thousand_features(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(24, 20_000)) + np.repeat(rng.normal(size=(2, 20_000)), 12, axis=0)
    d = spark.createDataFrame([("u", i, "ab"[i // 12], v.tolist()) for i, v in enumerate(x)], "k string, id int, c string, features array<double>")
    got = np.array([r.features for r in L.whitened(d, ["k"], "c", "id").orderBy("id").collect()])
    r = L.residual_rows(x, np.repeat(["a", "b"], 12))
    scale, inner, shrinkage = L.root_factors(r @ r.T, 20_000)
    # the covariance times the root twice is the identity, seen from the rows
    mu = np.trace(r @ r.T) / 24 / 20_000
    once = scale * got + ((got @ r.T) @ inner) @ r
    back = shrinkage * mu * once + (1 - shrinkage) / 24 * (once @ r.T) @ r
    assert np.allclose(back, x, atol=1e-8) and 0 < shrinkage < 1


def test_whitening_without_shrinkage_keeps_the_floor():
    r = L.residual_rows(np.random.default_rng(1).normal(size=(400, 3)), np.zeros(400))
    scale, inner, shrinkage = L.root_factors(r @ r.T, 3)
    w = scale * np.eye(3) + r.T @ inner @ r
    cov = (1 - shrinkage) * r.T @ r / 400 + shrinkage * np.trace(r.T @ r) / 1200 * np.eye(3)
    assert np.allclose(w @ cov @ w, np.eye(3), atol=1e-9)


@pytest.mark.parametrize("p", [5, 60])
def test_leakage_arms_equal_whitened_patterns(spark, p):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(48, p)) @ (np.eye(p) + rng.normal(size=(p, p)) / 4) + 0.4 * (np.arange(48) % 2)[:, None]
    cond = np.array([f"{'ab'[t // 32]}{t % 2}" for t in range(48)])
    lab = [(1, "c", "within", t, t % 2, t // 2 % 3, True, True) for t in range(32)]  # the contrast sees two thirds of the trials
    u = U.units(spark.createDataFrame(lab, "subject int, contrast string, kind string, vec_id int, y int, fold long, is_train boolean, is_test boolean"),
                spark.createDataFrame([(1, "r", t, cond[t], v.tolist()) for t, v in enumerate(x)], "subject int, roi string, vec_id int, condition string, features array<double>"),
                ["subject"], ["contrast", "kind"], block=W.BLOCK, carry=("condition",))
    got = {(r.arm, r.fold): r.n_correct for r in W.arms(u).collect()}

    def root(rows):
        return W.root_matrix(L.residual_rows(x[rows], cond[rows]))

    every = root(np.arange(48))
    for f in range(3):
        tr, te = (np.array([t for t in range(32) if (t // 2 % 3 == f) == held]) for held in (False, True))
        for arm, m in (("none", np.eye(p)), ("all_trials", every), ("train_only", root(tr))):
            z, y = x @ m, np.arange(48) % 2
            mean = [z[tr[y[tr] == k]].mean(0) for k in (0, 1)]
            mu, v = z[tr].mean(0), z[tr].var(0, ddof=1)
            pooled = sum(((z[tr[y[tr] == k]] - mean[k]) ** 2).sum(0) for k in (0, 1)) / (len(tr) - 2) / v
            a, b = ((k - mu) / np.sqrt(v) for k in mean)
            score = ((b - a) / (0.9 * pooled + 0.1) * ((z[te] - mu) / np.sqrt(v) - (a + b) / 2)).sum(axis=1)
            assert got[arm, f] == ((score > 0) == y[te]).sum()


def exact_margin(x, y, c=1.0, sweeps=20_000):
    """Weights and offset of a small model by plain coordinate ascent to the end."""
    z, s = np.c_[x - x.mean(axis=0), np.ones(len(x))], 2.0 * y - 1
    q = (z * s[:, None]) @ (z * s[:, None]).T
    a, g = np.zeros(len(y)), np.ones(len(y))
    for _ in range(sweeps):
        for i in range(len(y)):
            step = min(max(a[i] + g[i] / q[i, i], 0), c) - a[i]
            a[i] += step
            g -= step * q[:, i]
        v = (a * s) @ z
        primal = v @ v / 2 + c * np.maximum(0, 1 - s * (z @ v)).sum()
        if primal - a.sum() + v @ v / 2 < 1e-10 * primal:
            break
    return v[:-1], v[-1] - v[:-1] @ x.mean(axis=0)


@pytest.fixture(scope="module")
def margin_tables(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(72, 6)) + 0.8 * (np.arange(72) % 2)[:, None] * (np.arange(6) < 2)
    labels = [(1, n, "within", t, (t + (n == "b") * (t // 9)) % 2, t // 18, True, True) for n in ("a", "b") for t in range(72)]
    return x, labels, (
        spark.createDataFrame(labels, "subject int, contrast string, kind string, vec_id int, y int, fold long, is_train boolean, is_test boolean"),
        spark.createDataFrame([(1, "r", t, v.tolist()) for t, v in enumerate(x)], "subject int, roi string, vec_id int, features array<double>"))


@pytest.mark.parametrize("select", ["none", "weight", "haufe"])
@pytest.mark.parametrize("wide", [False, True])
def test_margin_models_equal_exact_ones(margin_tables, select, wide, spark):
    x, labels, (lab, pats) = margin_tables
    if wide:  # more features than rows: the shared Gram matrix
        x = np.c_[x, np.random.default_rng(22).normal(size=(72, 90))]
        pats = spark.createDataFrame([(1, "r", t, v.tolist()) for t, v in enumerate(x)], "subject int, roi string, vec_id int, features array<double>")
    u = SV.units(lab, pats, ["subject"], ["contrast", "kind"])
    got = {(r.contrast, r.fold): r for r in SV.validate(u, SV.Margin(select=select, tolerance=1e-9, fraction=0.5, least=2)).collect()}
    assert len(got) == 8
    for name in ("a", "b"):
        y, fold = (np.array([r[i] for r in labels if r[1] == name]) for i in (4, 5))
        for f in range(4):
            tr, te = fold != f, fold == f
            columns = np.arange(x.shape[1])
            w, b = exact_margin(x[tr], y[tr])
            if select != "none":
                d = x[tr] @ w + b
                score = np.abs(w) if select == "weight" else np.abs(((x[tr] - x[tr].mean(0)).T @ (d - d.mean())) / ((d - d.mean()) ** 2).sum())
                columns = np.sort(np.argsort(-score, kind="stable")[:x.shape[1] // 2])
                w, b = exact_margin(x[tr][:, columns], y[tr])
            d = x[te][:, columns] @ w + b
            assert np.abs(d).min() > 1e-4  # no test row on the border
            assert got[name, f].n_correct == ((d > 0) == y[te]).sum() and got[name, f].n_selected == len(columns) and got[name, f].gap <= 1e-9


def test_margin_models_of_many_trials_go_in_rounds(margin_tables):
    _, _, (lab, pats) = margin_tables
    keys = ["subject", "roi", "contrast", "kind", "fold"]
    whole, cut = ({tuple(r[k] for k in keys): r for r in SV.validate(SV.units(lab, pats, ["subject"], ["contrast", "kind"], most=m)).collect()} for m in (4096, 40))
    assert set(whole) == set(cut) and max(r.gap for r in cut.values()) <= 1e-3
    assert sum(abs(whole[k].n_correct - cut[k].n_correct) for k in whole) <= 2
    with pytest.raises(ValueError):
        SV.validate(SV.units(lab, pats, ["subject"], ["contrast", "kind"], most=40), SV.Margin(select="weight"))


@pytest.mark.parametrize("wide", [False, True])
def test_margin_models_do_not_depend_on_blocks(margin_tables, wide, spark, monkeypatch):
    """The same gap, hits and counts whether a unit is cut or not; also of cut units whose matrices would be too wide."""
    x, _, (lab, _) = margin_tables
    lone = lab.filter("contrast = 'a'").withColumn("contrast", F.lit("lone")).withColumn("is_train", F.col("fold") == 1)  # fold 1 has no model
    rows = [(1, "r", t, [None if t % 7 == 3 and j < 2 else float("nan") if t % 11 == 5 and j == 4 else float(e) + 3 for j, e in enumerate(v)]) for t, v in enumerate(x)]
    pats = spark.createDataFrame(rows, "subject int, roi string, vec_id int, features array<double>")
    monkeypatch.setattr(SV, "WIDE", 5 if wide else SV.WIDE)
    keys = ["subject", "roi", "contrast", "kind", "fold"]

    def got(block):
        u = SV.units(lab.unionByName(lone), pats, ["subject"], ["contrast", "kind"], block=block)
        d = SV.validate(u)
        return u.cut, {tuple(r[k] for k in keys): r for r in d.collect()}, d.dtypes

    (_, whole, kinds), (is_cut, cut, cut_kinds) = got(SV.BLOCK), got(1000)
    assert is_cut and set(whole) == set(cut) and len(cut) == 12 and kinds == cut_kinds
    for k, r in whole.items():
        if r.gap is None:
            assert k[2] == "lone" and k[4] == 1 and cut[k] == r
            continue
        assert r.gap <= 1e-6 and cut[k].gap <= 1e-6 and (wide or abs(r.gap - cut[k].gap) < 1e-9)
        assert all(r[f] == cut[k][f] for f in ("n_correct", "n_scored", "n_test", "n_selected", "accuracy"))


@pytest.mark.parametrize("select", ["none", "weight", "haufe"])
def test_margin_models_of_thousands_of_trials_are_exact(spark, select):
    n = 5000
    x = np.random.default_rng(23).normal(size=(n, 4))
    y = (x @ [1.0, 0.5, 0.1, 0.0] + np.random.default_rng(24).normal(size=n) > 0).astype(int)
    lab = spark.createDataFrame(pd.DataFrame({"subject": 1, "contrast": "a", "kind": "within", "vec_id": np.arange(n), "y": y, "fold": np.arange(n) % 2,
                                              "is_train": True, "is_test": True}))
    pats = spark.createDataFrame(pd.DataFrame({"subject": 1, "roi": "r", "vec_id": np.arange(n), "features": x.tolist()}))
    u = SV.units(lab, pats, ["subject"], ["contrast", "kind"])
    got = SV.validate(u, SV.Margin(select=select, least=2)).collect()
    assert not u.cut and len(got) == 2 and max(r.gap for r in got) <= 1e-6
    assert {(r.n_test, r.n_scored, r.n_selected) for r in got} == {(n // 2, n // 2, 4 if select == "none" else 2)} and min(r.accuracy for r in got) > 0.7


def test_searchlight_in_areas(spark, unit_tables):
    labels, pats = unit_tables
    v = spark.createDataFrame([(p, p % 3, p // 3 % 2, p // 6) for p in range(12)], "pos int, i long, j long, k long")
    near = S.lattice_neighbours(v, "pos", 1.0, least=4)
    long = P.explode_features(labels.join(pats.drop("subject"), "vec_id").withColumnRenamed("vec_id", "trial"),
                              [*UNIT, "fold", "trial", "y", "is_train", "is_test"])
    keys = [*UNIT, "fold"]
    ev = D.evidence(long, D.linear_weights(D.fold_statistics(long, UNIT), keys), keys)
    want = rows_of(D.searchlight(ev, near, keys, 3).fillna(0, ["n_correct"]).select(*UNIT, "fold", "centre", *U.COUNTS, "accuracy"))
    for edge, block in ((10, 1 << 24), (2, 1 << 24), (1, 700)):
        got = U.searchlight(labels, pats, U.sphere_areas(v, near, edge), ["subject"], ["contrast", "kind"], 3, block=block)
        assert rows_of(got.select(*UNIT, "fold", "centre", *U.COUNTS, "accuracy")) == want and len(want) > 50


def test_searchlight_of_a_hundred_thousand_voxels(spark):
    n = (50, 50, 40)
    v = spark.range(n[0] * n[1] * n[2]).select(F.col("id").cast("int").alias("pos"), (F.col("id") % n[0]).alias("i"),
                                                F.floor(F.col("id") / n[0]).alias("jk")).select(
        "pos", "i", (F.col("jk") % n[1]).alias("j"), F.floor(F.col("jk") / n[1]).alias("k"))
    trials = spark.range(24).select(F.lit(1).alias("subject"), F.lit("all").alias("roi"), F.col("id").cast("int").alias("vec_id"))
    signal = F.when((F.col("vec_id") % 2 == 1) & (F.col("p") < 25_000), 2.0).otherwise(0.0)
    pats = trials.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n[0] * n[1] * n[2] - 1)))).groupBy("subject", "roi", "vec_id").agg(
        F.array_sort(F.collect_list(F.struct("p", (signal + F.xxhash64("vec_id", "p") % 1000 / 1000.0).alias("x")))).alias("f")).select(
        "subject", "roi", "vec_id", F.col("f.x").alias("features"))
    labels = trials.drop("roi").select("subject", F.lit("a").alias("contrast"), F.lit("within").alias("kind"), "vec_id", (F.col("vec_id") % 2).alias("y"),
                                       F.floor(F.col("vec_id") / 8).alias("fold"), F.lit(True).alias("is_train"), F.lit(True).alias("is_test"))
    areas = U.sphere_areas(v, S.lattice_neighbours(v, "pos", 1.0), 10)
    got = U.searchlight(labels, pats, areas, ["subject"], ["contrast", "kind"], 1).groupBy("centre").agg(F.avg("accuracy").alias("a")).toPandas()
    assert len(got) == 100_000 and got[got.centre < 20_000].a.min() == 1 and got[got.centre >= 30_000].a.mean() < 0.6


def naive_hash(seed, trial):
    d = hashlib.md5(seed.encode()).hexdigest()
    c = [int(d[8 * i:8 * i + 8], 16) % PRIME for i in range(4)]
    return sum(k * trial ** i for i, k in enumerate(c)) % PRIME


def naive_chunks(trials, k):
    size, extra, out, at = len(trials) // k, len(trials) % k, {}, 0
    for i in range(k):
        for t in trials[at:at + size + (i < extra)]:
            out[t] = i
        at += size + (i < extra)
    return out


def naive_shuffle(y, seed):
    order = sorted(y, key=lambda t: (naive_hash(seed, t), t))
    return dict(zip(order, sorted(y.values())))


def naive_score(x, groups, train, test, own_scale):
    """One draw: ``groups`` maps a trial to its group."""
    at = lambda g: [x[t] for t in sorted(groups) if groups[t] == g]
    side = [np.array([x[t] for t in groups if (groups[t] < 2 * train) == first]) for first in (True, False)]
    by = [side[0], side[1] if own_scale else side[0]]
    scale = [(b.mean(axis=0), b.std(axis=0)) for b in by]
    means = {g: (np.mean(at(g), axis=0) - scale[g >= 2 * train][0]) / scale[g >= 2 * train][1] for g in set(groups.values())}
    x0, x1 = ([means[g] for g in range(c * train, (c + 1) * train) if g in means] for c in (0, 1))
    every = np.array(x0 + x1)
    m, v = every.mean(axis=0), every.var(axis=0, ddof=1)
    z0, z1 = (np.array(x0) - m) / np.sqrt(v), (np.array(x1) - m) / np.sqrt(v)
    pooled = (z0.var(axis=0) * len(x0) + z1.var(axis=0) * len(x1)) / (len(x0) + len(x1) - 2)
    a, b, den = z0.mean(axis=0), z1.mean(axis=0), 0.9 * pooled + 0.1
    hits = [(((b - a) * ((z - m) / np.sqrt(v) - (a + b) / 2) / den).sum() > 0) == ((g - 2 * train) // test == 1) for g, z in means.items() if g >= 2 * train]
    return sum(hits), len(hits)


def test_averaged_draws_equal_loops(spark):
    rng = np.random.default_rng(2)
    x = {t: rng.normal(size=5) for t in range(100, 148)}
    y = {t: int(rng.random() < 0.4) for t in x}
    pats = spark.createDataFrame([("s", "r", t, v.tolist()) for t, v in x.items()], "subject string, roi string, vec_id int, features array<double>").repartition(3)
    within = spark.createDataFrame([("s", "c", "within", t, y[t], True, True) for t in x],
                                   "subject string, contrast string, kind string, vec_id int, y int, is_train boolean, is_test boolean")
    across = within.withColumn("is_train", F.col("vec_id") % 2 == 0).withColumn("is_test", F.col("vec_id") % 2 == 1)

    def got(labels, plan, **more):
        d = AV.decode(labels, pats, ["subject"], ["contrast", "kind"], plan, per_draw=True, **more)
        return {r.draw: (r.n_correct, r.n_scored) for r in d.collect()}

    want = {}
    for p in range(3):
        yy = y if p == 0 else naive_shuffle(y, f"null|{p}|s|c")
        for r in range(2):
            fold = {}
            for c in (0, 1):
                order = sorted((t for t in x if yy[t] == c), key=lambda t: (naive_hash(f"fold|s|c|{p}|{r}", t), t))
                fold |= {t: i % 4 for i, t in enumerate(order)}
            for f in range(4):
                groups = {t: 6 + yy[t] for t in x if fold[t] == f}
                for c in (0, 1):
                    groups |= {t: c * 3 + k for t, k in naive_chunks([t for t in sorted(x) if fold[t] != f and yy[t] == c], 3).items()}
                want[(p * 2 + r) * 4 + f] = naive_score(x, groups, 3, 1, False)
    assert got(within, AV.Within(2, 2)) == want
    assert got(within, AV.Within(2, 2), block=400) == want  # five blocks

    want = {}
    for p in range(3):
        for r in range(2):
            groups = {}
            for side, base in ((0, 0), (1, 8)):
                own = {t: y[t] for t in x if t % 2 == side}
                own = own if p == 0 else naive_shuffle(own, f"null|{p}|s|c")
                for c in (0, 1):
                    order = sorted((t for t in own if own[t] == c), key=lambda t: (naive_hash(f"chunk|{r}", t), t))
                    groups |= {t: base + c * 4 + k for t, k in naive_chunks(order, 4).items()}
            want[p * 2 + r] = naive_score(x, groups, 4, 4, True)
    assert got(across, AV.Across(2, 2)) == want == got(across, AV.Across(2, 2), block=400)


def test_averaged_draws_are_made_once_for_all_regions():
    class Counted(AV.Within):
        def slots(self, some, *more):
            made.extend(some)
            return super().slots(some, *more)

    rng = np.random.default_rng(25)
    left = pd.DataFrame([(roi, t, rng.normal(size=3 + (roi == "c"))) for roi in "abc" for t in range(40) if roi != "b" or t % 5],
                        columns=["roi", "t", "features"]).sample(frac=1, random_state=1)  # b lacks trials, c is wider
    cell = {"t": np.arange(40), "y": np.arange(40) % 2, "is_train": np.ones(40, bool), "is_test": np.ones(40, bool), "__k": 1}
    plan = Counted(14, 2)

    def found(rows):
        return {roi: pd.concat([dict(AV._cell_draws(AV._regions(rows), cell | {"__p": p}, plan, "lda", False, "1|a"))[roi] for p in range(AV.SHARES)])[
            ["number", *AV.COUNTS, "share"]].to_numpy(float).tolist() for roi in rows["roi"].unique()}

    made: list[int] = []
    every = found(left[left["roi"] == "a"]) | found(left[left["roi"] == "b"]) | found(left[left["roi"] == "c"])
    made.clear()
    regions, parts = AV._regions(left), []
    for p in range(AV.SHARES):
        parts += AV._cell_draws(regions, cell | {"__p": p}, plan, "lda", False, "1|a")
    assert made == list(range(15))  # each permutation once, in one share, whatever the regions
    for roi in "abc":
        assert np.allclose(pd.concat([d for r, d in parts if r == roi])[["number", *AV.COUNTS, "share"]].to_numpy(float), every[roi])


def test_averaged_permutations_add_up(spark):
    rng = np.random.default_rng(3)
    pats = spark.createDataFrame([(i % 2, f"r{i % 3}", i, rng.normal(size=4).tolist()) for i in range(300)],
                                 "subject int, roi string, vec_id int, features array<double>")
    labels = spark.createDataFrame([(i % 2, "c", "within", i, i // 2 % 2, True, True) for i in range(0, 300, 1)],
                                   "subject int, contrast string, kind string, vec_id int, y int, is_train boolean, is_test boolean")
    for scorer in ("lda", "centroid", "svm"):
        args = (labels, pats, ["subject"], ["contrast", "kind"], AV.Within(3, 2), scorer)
        one, cut = (sorted(map(tuple, AV.decode(*args, block=b).collect())) for b in (1 << 24, 200))
        draws = AV.decode(*args, per_draw=True).groupBy("subject", "roi", "contrast", "kind", F.floor(F.col("draw") / 8).cast("int").alias("permutation")).agg(
            *[F.sum(c).alias(c) for c in ("n_correct", "n_scored", "n_test")], F.avg("accuracy").alias("accuracy"), F.count("accuracy").alias("n_draws"))
        close = lambda a, b: all(u == v or abs(u - v) < 1e-12 for u, v in zip(a, b))
        assert len(one) == 6 * 4 and all(map(close, one, cut)) and all(map(close, one, sorted(map(tuple, draws.collect()))))
    empty = AV.decode(labels.limit(0), pats, ["subject"], ["contrast", "kind"], AV.Within())
    assert empty.count() == 0 == AV.decode(labels, pats.limit(0), ["subject"], ["contrast", "kind"], AV.Within()).count()


def test_shuffles_keep_class_counts():
    y = np.array([0, 1, 1, 0, 1] * 7)
    out = AV.shuffles(range(50), "s|c", np.arange(35), y)
    assert (out.sum(axis=1) == y.sum()).all() and (out[0] == y).all() and len(np.unique(out, axis=0)) == 50


def test_nan_is_read_as_null(spark, tmp_path):
    from voxtrail.plans.registry import Context
    spark.createDataFrame([(1, float("nan"), [1.0, float("nan")]), (2, 2.0, [3.0, 4.0])], "event_id int, value double, v array<double>").write.parquet(f"{tmp_path}/events.parquet")
    rows = {r.event_id: r for r in Context(spark, str(tmp_path)).table("events").collect()}
    assert rows[1].value is None and rows[1].v == [1.0, None] and rows[2].value == 2.0
    d = spark.createDataFrame([(1, 1, 1.0), (1, 2, float("nan")), (2, 1, 1.0), (2, 2, 1.0)], "voxel int, subject int, value double")
    assert [r.voxel for r in G.group_mask(d, "voxel", "subject", 2, "value").collect()] == [2]


def test_svm_blocks_reach_the_same_gap():
    """The rounds of two blocks of one model, without Spark."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(60, 2)), np.repeat([0, 1], 30)
    x[y == 1] += 1.5
    mu = [x[np.arange(60) % 3 != f].mean(axis=0) for f in range(3)]
    parts = [np.arange(0, 60, 2), np.arange(1, 60, 2)]
    state = pd.DataFrame([{"blocks": 2, "block": b, "x": list(x[at]), "y": y[at], "own": at % 3, "folds": [0, 1, 2], "mu": mu,
                           "a": np.empty(0), "w": np.empty(0)} for b, at in enumerate(parts)])
    for _ in range(200):
        out = next(D._ascend(1.0, 1e-3)(iter([state.copy()])))
        w, stat = out["w"].iloc[0].reshape(3, 3), sum(out["stat"])
        primal = (w * w).sum(axis=1) / 2 + stat[:3]
        gap = primal - stat[3:] + (w * w).sum(axis=1) / 2
        if (gap <= 1e-3 * primal).all():
            break
        state = out.drop(columns=["d", "stat"])
        state["w"] = [out["w"].iloc[0] + sum(out["d"])] * 2
    else:
        raise AssertionError(gap / primal)
