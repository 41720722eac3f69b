"""Cross-validated decoding of many models at once.

Rows are long: model keys, ``fold``, ``trial``, ``y`` (0/1), ``is_train``, ``is_test``, ``pos``,
``x``. A training row belongs to every fold but its own; the model of fold f is trained on
the sums of all other folds, so rows are never copied per fold. All models of a table
share the same few aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from voxtrail.functions import arrays as A
from voxtrail.operators.folds import contrast_pool
from voxtrail.operators.patterns import explode_features, leave_out_totals
from voxtrail.operators.report import top_fraction
from voxtrail.operators.similarity import haufe
from voxtrail.session import cut_lineage


def attach(pool: DataFrame, patterns: DataFrame | None, trial: str, keep: Sequence[str]) -> DataFrame:
    """Joins the narrow pool (labels, folds) to the pattern arrays and goes long.

    Where labels and folds follow from the trial's own columns (runs, families, single split)
    the pool can be built on the pattern rows themselves: without ``patterns`` nothing is joined
    and the features are not shuffled for it."""
    j = pool if patterns is None else pool.join(patterns.select(trial, "roi", "features"), trial)
    return explode_features(j.withColumnRenamed(trial, "trial"),
                            [*keep, "roi", "fold", "trial", "y", "is_train", "is_test"])


def _moments(is_train: Column) -> list[Column]:
    out = []
    for c in (0, 1):
        x = F.when(is_train & (F.col("y") == c), F.col("x"))
        out += [F.count(x).alias(f"n{c}"), F.avg(x).alias(f"m{c}"), (F.var_pop(x) * F.count(x)).alias(f"q{c}")]
    return out


def fold_statistics(rows: DataFrame, model: list[str]) -> DataFrame:
    """Class counts, means and squared deviations of all rows outside each fold."""
    per = rows.groupBy(*model, "pos", "fold").agg(*_moments(F.col("is_train")))
    return leave_out_totals(per, [*model, "pos"], "fold", ["0", "1"])


def split_statistics(rows: DataFrame, model: list[str]) -> DataFrame:
    """The same where the fold is already part of the model and the rows carry their role."""
    return rows.groupBy(*model, "pos").agg(*_moments(F.col("is_train")))


def linear_weights(stats: DataFrame, keys: list[str], scorer: str = "lda", shrinkage: float = 0.1,
                   floor: float = 1e-7) -> DataFrame:
    """Weight and offset per voxel in raw units. ``lda`` divides by the shrunken within-class
    variance, ``centroid`` does not. Voxels without variance and models with fewer than two
    rows in a class get none."""
    if scorer not in ("lda", "centroid"):
        raise ValueError(scorer)
    n0, n1, m0, m1 = (F.col(c) for c in ("n0", "n1", "m0", "m1"))
    d = stats.filter((n0 >= 2) & (n1 >= 2))
    d = d.withColumn("__m", (n0 * m0 + n1 * m1) / (n0 + n1))
    m = F.col("__m")
    d = d.withColumn("__v", (F.col("q0") + F.col("q1") + n0 * (m0 - m) * (m0 - m) + n1 * (m1 - m) * (m1 - m))
                     / (n0 + n1 - 1)).filter(F.col("__v") > floor * floor)
    v = F.col("__v")
    pooled = (F.col("q0") + F.col("q1")) / (n0 + n1 - 2) / v
    den = (1 - shrinkage) * pooled + shrinkage if scorer == "lda" else F.lit(1.0)
    d = d.withColumn("__z0", (m0 - m) / F.sqrt(v)).withColumn("__z1", (m1 - m) / F.sqrt(v)).withColumn("__den", den)
    z0, z1 = F.col("__z0"), F.col("__z1")
    d = d.filter(F.col("__den") > 0).withColumn("w", (z1 - z0) / F.col("__den") / F.sqrt(v))
    return d.select(*keys, "pos", "w", (-0.5 * (z1 * z1 - z0 * z0) / F.col("__den") - m * F.col("w")).alias("b"))


def decisions(rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Score of every test row; NULL where its model has no weights."""
    j = rows.filter("is_test").join(weights, [*keys, "pos"], "left")
    return j.groupBy(*keys, "trial", "y").agg(F.sum(F.col("w") * F.col("x") + F.col("b")).alias("decision"))


def fold_accuracy(dec: DataFrame, keys: list[str]) -> DataFrame:
    hit = ((F.col("decision") > 0).cast("int") == F.col("y")).cast("double")
    return dec.groupBy(*keys).agg(F.sum(hit).cast("bigint").alias("n_correct"), F.count("decision").alias("n_scored"),
                                  F.count(F.lit(1)).alias("n_test"), F.avg(hit).alias("accuracy"))


def cross_validate(rows: DataFrame, model: list[str], scorer: str = "lda",
                   shrinkage: float = 0.1) -> DataFrame:
    """Accuracy per model and fold."""
    keys = [*model, "fold"]
    w = linear_weights(fold_statistics(rows, model), keys, scorer, shrinkage)
    return fold_accuracy(decisions(rows, w, keys), keys)


def split_validate(rows: DataFrame, model: list[str], scorer: str = "lda",
                   shrinkage: float = 0.1) -> DataFrame:
    """Accuracy per model of rows that carry their role."""
    w = linear_weights(split_statistics(rows, model), model, scorer, shrinkage)
    return fold_accuracy(decisions(rows, w, model), model)


def roll_up(folds: DataFrame, keys: list[str], repeat: str | None = None) -> DataFrame:
    """Mean of fold accuracies (per repeat, then over repeats), pooled hits, SD over repeats."""
    inner = [*keys, repeat] if repeat else keys
    g = folds.groupBy(*inner).agg(F.avg("accuracy").alias("a"), F.sum("n_correct").alias("c"),
                                  F.sum("n_scored").alias("n"), F.count("accuracy").alias("k"))
    return g.groupBy(*keys).agg(
        F.avg("a").alias("accuracy"), F.stddev_samp("a").alias("sd_repeats"),
        (F.sum("c") / F.sum("n")).alias("pooled_accuracy"), F.sum("n").alias("n_observations"),
        F.sum("k").alias("n_folds"))


# ---- averaged pseudo-trials ------------------------------------------------------------

def expand_folds(pool: DataFrame, k: int) -> DataFrame:
    """Repeats the narrow pool once per fold with its role there (needed where the averages
    depend on the fold); patterns are joined afterwards."""
    d = pool.withColumnRenamed("fold", "__own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    test = F.col("__own") == F.col("fold")
    return d.withColumn("is_test", test).withColumn("is_train", ~test).drop("__own")


def averaged_rows(long: DataFrame, model: list[str], scale_by: list[str] | None = None) -> DataFrame:
    """Mean pattern per (model, role, class, chunk), scaled per voxel by the mean and SD
    (ddof=0) of the single training trials, or of each role's own trials if ``scale_by``
    names it. Scaling and averaging commute, so both come from one aggregate of the trials."""
    g = long.groupBy(*model, "is_train", "is_test", "y", "chunk", "pos").agg(
        F.avg("x").alias("mx"), F.count("x").alias("n"), (F.var_pop("x") * F.count("x")).alias("q"))
    by = [*model, *(scale_by or []), "pos"]
    src = g if scale_by else g.filter("is_train")
    n = F.sum("n")
    st = src.groupBy(*by).agg(
        (F.sum(F.col("n") * F.col("mx")) / n).alias("__m"), n.alias("__n"),
        F.sum("q").alias("__q"), F.sum(F.col("n") * F.col("mx") * F.col("mx")).alias("__mm"))
    var = (F.col("__q") + F.col("__mm")) / F.col("__n") - F.col("__m") * F.col("__m")
    d = g.join(st, by).withColumn("__s", F.sqrt(F.greatest(F.lit(0.0), var)))
    x = (F.col("mx") - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    return d.select(*model, "is_train", "is_test", "y",
                    F.concat_ws("-", "y", "chunk").alias("trial"), "pos", x.alias("x"))


def run_wise_rows(long: DataFrame, unit: list[str], contrasts) -> DataFrame:
    """Condition means per run; each held run's data are scaled, per source, by the trials of
    the other runs. Returns rows with roles for every contrast and held run."""
    per = long.groupBy(*unit, "source", "run", "pos").agg(
        F.count("x").alias("n_"), F.avg("x").alias("m_"), (F.var_pop("x") * F.count("x")).alias("q_"))
    st = leave_out_totals(per, [*unit, "source", "pos"], "run", ["_"]).withColumnRenamed("run", "fold")
    mean = long.groupBy(*unit, "source", "valence", "run", "pos").agg(F.avg("x").alias("mx"))
    j = mean.join(st, [*unit, "source", "pos"])
    sd = F.sqrt(F.col("q_") / F.col("n_"))
    j = j.withColumn("x", (F.col("mx") - F.col("m_")) / F.when(sd > 0, sd).otherwise(1.0))
    held = F.col("run") == F.col("fold")
    d = contrast_pool(j.select(*unit, "source", "valence", "run", "fold", "pos", "x"), contrasts)
    d = d.withColumn("is_train", F.col("is_train") & ~held).withColumn("is_test", F.col("is_test") & held)
    return d.filter("is_train OR is_test").withColumn("trial", F.concat_ws("-", "y", "run"))


# ---- selection, evidence ---------------------------------------------------------------

def training_decisions(rows: DataFrame, weights: DataFrame, model: list[str]) -> DataFrame:
    """Score of the training rows under the model of each fold they train."""
    t = rows.filter("is_train").withColumnRenamed("fold", "__own")
    j = t.join(weights, [*model, "pos"]).filter(F.col("__own") != F.col("fold"))
    return j.groupBy(*model, "fold", "trial", "y").agg(
        F.sum(F.col("w") * F.col("x") + F.col("b")).alias("decision"))


def haufe_patterns(rows: DataFrame, weights: DataFrame, model: list[str]) -> DataFrame:
    """cov(x, score) / var(score) over the training rows of every fold and voxel."""
    d = training_decisions(rows, weights, model)
    t = rows.filter("is_train").select(*model, "trial", "y", "pos", "x")
    return haufe(t.join(d, [*model, "trial", "y"]), [*model, "fold", "pos"], "x", "decision")


def selected_features(rows: DataFrame, model: list[str], selector: str, fraction: float, least: int,
                      shrinkage: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(weights, selected voxels): strongest |weight| or |Haufe pattern| inside each fold."""
    keys = [*model, "fold"]
    w = cut_lineage(linear_weights(fold_statistics(rows, model), keys, "lda", shrinkage))
    if selector == "weight":
        s = w.withColumn("score", F.abs("w"))
    elif selector == "haufe":
        s = cut_lineage(haufe_patterns(rows, w, model).withColumn("score", F.abs("pattern")))
    else:
        raise ValueError(selector)
    return w, top_fraction(s, keys, "pos", "score", fraction, least, settled=True).select(*keys, "pos")


def select_and_validate(rows: DataFrame, model: list[str], selector: str, fraction: float,
                        least: int) -> DataFrame:
    """Selection inside the fold and refit on the selected voxels. The scorer is separable per
    voxel, so the refit weights are the fitted ones restricted to the selection."""
    w, chosen = selected_features(rows, model, selector, fraction, least)
    keys = [*model, "fold"]
    return fold_accuracy(decisions(rows, w.join(chosen, [*keys, "pos"], "left_semi"), keys), keys)


def validate_on_columns(rows: DataFrame, model: list[str], columns: DataFrame, by: list[str]) -> DataFrame:
    """Decoding on columns that are fixed beforehand; ``columns`` lists them per ``by``."""
    return cross_validate(rows.join(columns.select(*by), by, "left_semi"), model)


def evidence(rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Contribution of every voxel to every test row's score."""
    j = rows.filter("is_test").join(weights, [*keys, "pos"])
    return j.select(*keys, "trial", "y", "pos", (F.col("w") * F.col("x") + F.col("b")).alias("e"))


def searchlight(ev: DataFrame, spheres: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Accuracy per sphere centre and fold: the evidence of the neighbourhood is summed, no
    model is fitted per sphere. ``spheres``: centre, pos."""
    d = ev.join(spheres, "pos").groupBy(*keys, "centre", "trial", "y").agg(
        F.sum("e").alias("decision"), F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    return fold_accuracy(d, [*keys, "centre"])


# ---- linear support vector machine -----------------------------------------------------

def packed(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """One array per key from rows (pos, value); its length is the pattern width."""
    return df.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("__v")))), lambda e: e["__v"]).alias(out))


def hinge_models(rows: DataFrame, model: list[str], c: float = 1.0, tolerance: float = 1e-3,
                 rounds: int = 200, block_rows: int = 1024) -> DataFrame:
    """Soft-margin linear models of all (model, fold) at once: 1/2 |w|^2 + C sum(hinge).

    Solved in the dual until the duality gap of every model is at most ``tolerance`` of its
    objective. A model's training rows lie in blocks of about ``block_rows``. In a round every block
    raises its own multipliers by coordinate ascent against the shared weights (all folds in one
    pass over its rows), and the weight changes of a model's blocks are added; with K blocks a
    change counts K-fold inside its block, so that the sum never overshoots (Ma et al. 2015).
    A model with one block is solved in its first round. Solved models drop out; a model that is
    left after ``rounds`` raises. Features are centred on the training mean of the fold, which is
    folded into the offset. ``rows``: model keys, fold, trial, y, is_train, is_test, features.

    Returns model, fold, w, offset, gap (of the objective)."""
    keys = [*model, "fold"]
    train = F.col("is_train")
    long = rows.select(*model, "fold", "is_train", F.posexplode("features").alias("pos", "x"))
    x = F.when(train, F.col("x"))
    per = long.groupBy(*model, "pos", "fold").agg(F.count(x).alias("n_"), F.avg(x).alias("m_"),
                                                  (F.var_pop(x) * F.count(x)).alias("q_"))
    mu = packed(leave_out_totals(per, [*model, "pos"], "fold", ["_"]).filter("n_ > 0"), keys, "m_", "mu")
    mu = mu.join(rows.filter("is_test").select(*keys).distinct(), keys, "left_semi")
    folds = mu.groupBy(*model).agg(F.array_sort(F.collect_list(F.struct(F.col("fold").cast("bigint").alias("fold"), "mu"))).alias("__m"))
    size = rows.filter(train).groupBy(*model).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    blocks = (rows.filter(train).join(size, model)
              .groupBy(*model, "blocks", F.pmod(F.xxhash64("trial"), F.col("blocks")).cast("int").alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("trial", F.col("fold").cast("bigint").alias("own"), "y", "features"))).alias("__r")))
    none = F.array().cast("array<double>")
    state = cut_lineage(blocks.join(folds, model).select(
        *model, "blocks", "block", F.transform("__r", lambda r: r["features"]).alias("x"),
        F.transform("__r", lambda r: r["y"].cast("int")).alias("y"), F.transform("__r", lambda r: r["own"]).alias("own"),
        F.transform("__m", lambda m: m["fold"]).alias("folds"), F.transform("__m", lambda m: m["mu"]).alias("mu"),
        none.alias("a"), none.alias("w")))
    number = T.ArrayType(T.DoubleType())
    moved_schema = T.StructType([*state.schema.fields, T.StructField("d", number), T.StructField("stat", number)])
    fixed = ["blocks", "block", "x", "y", "own", "folds", "mu"]
    solved = None
    for _ in range(rounds):
        moved = cut_lineage(state.mapInPandas(_ascend(c, tolerance), moved_schema))
        total = moved.filter("block = 0 OR blocks = 1").select(*model, "folds", "mu", "w").join(
            _added(moved, model, "d"), model).join(_added(moved, model, "stat"), model)
        total = cut_lineage(total.withColumn("gaps", _gaps(F.col("w"), F.col("stat"), F.size("folds"), c)))
        left = F.exists("gaps", lambda g: g > tolerance)
        out = total.filter(~left).select(*model, F.explode(F.arrays_zip("folds", "mu", "gaps")).alias("f"), "w", F.col("folds").alias("all"))
        p = F.size("f.mu")
        at = (F.array_position("all", F.col("f.folds")) - 1).cast("int") * (p + 1)
        w = F.slice("w", at + 1, p)
        out = out.select(*model, F.col("f.folds").alias("fold"), w.alias("w"),
                         (F.get("w", at + p) - A.dot(F.col("f.mu"), w)).alias("offset"), F.col("f.gaps").alias("gap"))
        solved = out if solved is None else solved.unionByName(out)
        rest = total.filter(left).select(*model, F.zip_with("w", "d", lambda u, v: u + v).alias("w"))
        state = moved.select(*model, *fixed, "a").join(rest, model).select(*model, *fixed, "a", "w")
        if not rest.take(1):
            return solved
    raise RuntimeError(f"models above a gap of {tolerance} after {rounds} rounds")


def _added(moved: DataFrame, model: list[str], column: str) -> DataFrame:
    """Arrays of a model's blocks, added up."""
    g = moved.select(*model, F.posexplode(column).alias("pos", "v")).groupBy(*model, "pos").agg(F.sum("v").alias("s"))
    return packed(g, model, "s", column)


def _gaps(w: Column, stat: Column, folds: Column, c: float) -> Column:
    """Relative duality gap per fold; ``stat`` holds the hinge losses, then the sums of multipliers."""
    width = F.floor(F.size(w) / folds).cast("int")

    def one(i: Column) -> Column:
        ww = A.sum_squares(F.slice(w, i * width + 1, width))
        primal = ww / 2 + c * F.get(stat, i)
        return (primal - F.get(stat, i + folds) + ww / 2) / F.greatest(primal, F.lit(1e-12))

    return F.transform(F.sequence(F.lit(0), folds - 1), one)


def _ascend(c: float, tolerance: float, sweeps: int = 500):
    """Raises the multipliers of each block; ``d`` is the change of the weights, ``stat`` that of
    the point the block started from."""
    def block(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x, s, mu = np.stack(r.x), 2.0 * np.asarray(r.y) - 1, np.stack(r.mu)
        n, p, k = len(x), x.shape[1], len(mu)
        member = np.asarray(r.own)[None, :] != np.asarray(r.folds)[:, None]
        a = np.array(r.a, dtype=np.float64).reshape(k, n) if len(r.a) else np.zeros((k, n))
        w = np.asarray(r.w, dtype=np.float64).reshape(k, p + 1) if len(r.w) else np.zeros((k, p + 1))
        score = w[:, :p] @ x.T + (w[:, p] - (w[:, :p] * mu).sum(axis=1))[:, None]
        stat = np.concatenate([(np.maximum(0, 1 - s * score) * member).sum(axis=1), a.sum(axis=1)])
        start, own = a.copy(), (w * w).sum(axis=1)
        # products of the centred rows, with the constant feature; a change counts ``blocks``-fold
        centred = x @ mu.T
        products = r.blocks * ((x @ x.T)[None] - centred.T[:, :, None] - centred.T[:, None, :]
                               + (mu * mu).sum(axis=1)[:, None, None] + 1) * s[None, :, None] * s[None, None, :]
        length = np.maximum(np.diagonal(products, axis1=1, axis2=2), 1e-12).T.copy()
        slack = 1 - s * score
        free = np.where(member.T, c, 0.0)
        rng = np.random.default_rng(n)
        for _ in range(sweeps):
            for i in rng.permutation(n):
                old = a[:, i]
                step = np.minimum(np.maximum(old + slack[:, i] / length[i], 0), free[i]) - old
                if step.any():
                    a[:, i] += step
                    slack -= step[:, None] * products[:, i]
            # gap of the block's own problem: exact where the block is the model
            moved = ((a - start) * (products @ (a - start)[:, :, None])[:, :, 0]).sum(axis=1) / r.blocks
            ww = own + 2 * ((a - start) * s * score).sum(axis=1) + moved
            primal = ww / 2 + c * (np.maximum(0, slack) * member).sum(axis=1)
            if ((primal - a.sum(axis=1) + ww / 2) <= tolerance / 2 * np.maximum(primal, 1e-12)).all():
                break
        change = (a - start) * s
        d = np.concatenate([change @ x - change.sum(axis=1)[:, None] * mu, change.sum(axis=1)[:, None]], axis=1)
        return a.ravel(), w.ravel(), d.ravel(), stat

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [block(r) for r in b.itertuples()]
            for i, name in enumerate(("a", "w", "d", "stat")):
                b[name] = [m[i] for m in made]
            yield b

    return run


def hinge_validate(rows: DataFrame, model: list[str], c: float = 1.0, tolerance: float = 1e-3) -> DataFrame:
    """Accuracy per model and fold, with the relative duality gap of its model."""
    keys = [*model, "fold"]
    w = cut_lineage(hinge_models(rows, model, c, tolerance))
    dec = rows.filter("is_test").join(w.drop("gap"), keys, "left").select(
        *keys, "trial", "y", (A.dot(F.col("features"), F.col("w")) + F.col("offset")).alias("decision"))
    return fold_accuracy(dec, keys).join(w.select(*keys, "gap"), keys, "left")
