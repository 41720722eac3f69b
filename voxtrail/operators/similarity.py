"""Correlations between patterns and maps.

Means over all pairs of trials never build the pairs: with unit vectors u the sum of
correlations over pairs is a product of summed vectors, so the cost is linear in trials.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from voxtrail.functions import arrays as A
from voxtrail.functions.stats import fisher_z, pearson_p, sd_pop, t_greater
from voxtrail.operators.ranks import average_ranks
from voxtrail.operators.report import top_fraction
from voxtrail.session import cut_lineage


# ---- pairs of trials -------------------------------------------------------------------

def _masked_sums(side: DataFrame, masks: DataFrame, keys: list[str], mine: str, other: str) -> DataFrame:
    """Summed unit vectors of one side, for each pair of missing-value masks."""
    j = side.withColumnRenamed("mask", mine).join(masks.withColumnRenamed("mask", other), keys)
    valid = F.zip_with(F.col(mine), F.col(other), lambda a, b: a & b)
    x = F.zip_with("features", valid, lambda v, ok: F.when(ok, v))
    j = j.withColumn("__x", x)
    u = A.let(F.filter("__x", lambda v: v.isNotNull()), lambda k: A.let(
        F.struct(A.mean(k).alias("m"), A.norm(A.centre(k)).alias("n")), lambda c: F.when(
            c["n"] > 0, F.transform("__x", lambda v: (v - c["m"]) / c["n"]))))
    d = j.select(*keys, mine, other, F.posexplode(u).alias("pos", "__u")).filter("__u IS NOT NULL")
    return d.groupBy(*keys, mine, other, "pos").agg(F.sum("__u").alias("__s"), F.count(F.lit(1)).alias("__n"))


FEW_MASKS = 64  # up to here the work is linear in the rows
TILE_ROWS = 1024


def pair_similarity(a: DataFrame, b: DataFrame, keys: list[str], min_valid: int) -> DataFrame:
    """Sum and number of Pearson correlations over all pairs (row of a, row of b) of a key.

    Both sides have ``keys`` and ``features`` (NULL where missing). Each pair uses the
    positions valid in both rows, at least ``min_valid``. Keys with few distinct masks of missing values
    take summed unit vectors per pair of masks; those with more take tiles of rows, whose
    correlations come from products of values, squares and masks and are summed where they arise."""
    def masked(df):
        return df.select(*keys, "features", F.transform("features", A.finite).alias("mask"))
    a, b = masked(a), masked(b)
    ma, mb = (cut_lineage(d.select(*keys, "mask").distinct()) for d in (a, b))
    many = cut_lineage(ma.groupBy(*keys).count().unionByName(mb.groupBy(*keys).count())
                       .filter(F.col("count") > FEW_MASKS).select(*keys).distinct())
    if many.take(1):
        few = [d.join(many, keys, "left_anti") for d in (a, b, ma, mb)]
        return _by_masks(*few, keys, min_valid).unionByName(
            _by_tiles(a.join(many, keys, "left_semi"), b.join(many, keys, "left_semi"), keys, min_valid))
    return _by_masks(a, b, ma, mb, keys, min_valid)


def _by_masks(a: DataFrame, b: DataFrame, ma: DataFrame, mb: DataFrame, keys: list[str], min_valid: int) -> DataFrame:
    sa = _masked_sums(a, mb, keys, "mask_a", "mask_b")
    sb = _masked_sums(b, ma, keys, "mask_b", "mask_a").select(
        *keys, "mask_a", "mask_b", "pos", F.col("__s").alias("__t"), F.col("__n").alias("__k"))
    g = sa.join(sb, [*keys, "mask_a", "mask_b", "pos"]).groupBy(*keys, "mask_a", "mask_b").agg(
        F.sum(F.col("__s") * F.col("__t")).alias("__r"), F.max(F.col("__n") * F.col("__k")).alias("__p"),
        F.count(F.lit(1)).alias("__valid"))
    return g.filter(F.col("__valid") >= min_valid).groupBy(*keys).agg(
        F.sum("__r").alias("sum_r"), F.sum("__p").alias("n_pairs"))


def tile_correlations(x: np.ndarray, y: np.ndarray, min_valid: int) -> tuple[float, int]:
    """Sum and number of pairwise-complete correlations of the rows of x and y (NaN where missing)."""
    def parts(m):
        there = np.isfinite(m)
        mean = np.where(there, m, 0.0).sum(axis=1) / np.maximum(there.sum(axis=1), 1)
        v = np.where(there, m - mean[:, None], 0.0)
        return there.astype(np.float64), v, v * v
    (mx, vx, qx), (my, vy, qy) = parts(x), parts(y)
    n = np.maximum(mx @ my.T, 1)
    sx, sy = vx @ my.T, mx @ vy.T
    var_x, var_y = qx @ my.T - sx * sx / n, mx @ qy.T - sy * sy / n
    ok = (mx @ my.T >= min_valid) & (var_x > 1e-12 * (qx @ my.T)) & (var_y > 1e-12 * (mx @ qy.T))
    r = np.where(ok, (vx @ vy.T - sx * sy / n) / np.sqrt(np.where(ok, var_x * var_y, 1.0)), 0.0)
    return float(r.sum()), int(ok.sum())


def _by_tiles(a: DataFrame, b: DataFrame, keys: list[str], min_valid: int) -> DataFrame:
    """Every pair of row blocks of a key is one task's products; only two numbers leave it."""
    largest = a.select(*keys).unionByName(b.select(*keys)).groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    blocks = -(-largest // TILE_ROWS)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    block = F.pmod(F.xxhash64("features"), F.lit(blocks)).cast("int")
    left = a.select(*keys, "features", block.alias("__x")).withColumn("__y", every)
    right = b.select(*keys, "features", block.alias("__y")).withColumn("__x", every)
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    group = [*keys, "__x", "__y"]
    schema = ", ".join([f"`{k}` {t}" for k, t in a.select(*keys).dtypes] + ["r double", "n bigint"])

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame(columns=[*keys, "r", "n"])
        r, n = tile_correlations(*(np.array(d["features"].tolist(), dtype=np.float64) for d in (x, y)), min_valid)
        return x[keys].iloc[:1].assign(r=r, n=n)
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(product, schema)
    return found.groupBy(*keys).agg(F.sum("r").alias("sum_r"), F.sum("n").alias("n_pairs")).filter("n_pairs > 0")


def cross_similarity(df: DataFrame, keys: list[str], condition: str, a: str, b: str,
                     min_valid: int) -> DataFrame:
    """Mean correlation between the trials of two conditions."""
    s = pair_similarity(df.filter(F.col(condition) == a), df.filter(F.col(condition) == b), keys, min_valid)
    return s.select(*keys, (F.col("sum_r") / F.col("n_pairs")).alias("mean_r"), "n_pairs")


def within_similarity(df: DataFrame, keys: list[str], min_valid: int) -> DataFrame:
    """Mean correlation over pairs of different trials of a key."""
    def self_pair(f):
        return (F.size(f) >= min_valid) & (A.norm(A.centre(f)) > 0)
    usable = df.filter(A.let(F.filter("features", A.finite), self_pair))
    s = pair_similarity(df, df, keys, min_valid)
    n = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("__self"))
    j = s.join(n, keys)
    pairs = F.col("n_pairs") - F.col("__self")
    return j.select(*keys, F.when(pairs > 0, (F.col("sum_r") - F.col("__self")) / pairs).alias("mean_r"),
                    (pairs / 2).cast("bigint").alias("n_pairs"))


# ---- dissimilarity matrices ------------------------------------------------------------

def dissimilarity(df: DataFrame, keys: list[str], item: str, rows_per_block: int = 1024) -> DataFrame:
    """All pairs a < b of a set with 1 - (r + 1) / 2; the pairs are the result.

    Unit vectors are cut into hash blocks; every pair of blocks is one bounded matrix product
    in a task of its own, so a set that holds most items spreads over all of them. The number
    of blocks follows from the largest set (one counted number)."""
    u = df.select(*keys, F.col(item), A.unit(A.as_double(F.col("features"))).alias("u")).filter("u IS NOT NULL")
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    blocks = -(-largest // rows_per_block)
    u = u.withColumn("__b", F.pmod(F.hash(item), F.lit(blocks)))
    # block b is the left side of (b, b..last) and the right side of (0..b, b)
    left = u.withColumn("__x", F.col("__b")).withColumn("__y", F.explode(F.sequence(F.col("__b"), F.lit(blocks - 1))))
    right = u.withColumn("__y", F.col("__b")).withColumn("__x", F.explode(F.sequence(F.lit(0), F.col("__b"))))
    group = [*keys, "__x", "__y"]
    fields = [*[f for f in df.schema if f.name in keys]]
    ident = df.schema[item].dataType
    schema = T.StructType([*fields, T.StructField("a", ident), T.StructField("b", ident),
                           T.StructField("dissimilarity", T.DoubleType())])

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        r = np.stack(x["u"].to_numpy()) @ np.stack(y["v"].to_numpy()).T
        p, q = x["a"].to_numpy(), y["b"].to_numpy()
        same = x["__x"].iloc[0] == x["__y"].iloc[0]
        i, j = np.nonzero(p[:, None] < q[None, :]) if same else [v.ravel() for v in np.indices(r.shape)]
        out = {k: x[k].iloc[0] for k in keys}
        first, second = p[i], q[j]
        swap = second < first
        out.update(a=np.where(swap, second, first), b=np.where(swap, first, second),
                   dissimilarity=1 - 0.5 * (r[i, j] + 1))
        return pd.DataFrame(out)[[f.name for f in schema]]
    left = left.select(*group, F.col(item).alias("a"), "u")
    right = right.select(*group, F.col(item).alias("b"), F.col("u").alias("v"))
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(product, schema)


def gram(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Sum over rows of left_i * right_j per key: partial products per Arrow batch (NumPy),
    then a Spark aggregate over (key, i, j)."""
    schema = df.select(*keys).schema.simpleString()[7:-1].replace(":", " ")
    out = (schema + ", " if keys else "") + "i int, row array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            groups = b.groupby(keys, sort=False, dropna=False) if keys else [((), b)]
            for key, g in groups:
                m = np.stack(g[left].to_numpy()).T @ np.stack(g[right].to_numpy())
                o = pd.DataFrame({"i": np.arange(len(m), dtype="int32"), "row": list(m)})
                for k, v in zip(keys, key):
                    o[k] = v
                yield o[[*keys, "i", "row"]]

    d = df.select(*keys, *dict.fromkeys([left, right]))
    d = d.sortWithinPartitions(*keys) if keys else d
    p = d.mapInPandas(partial, out).select(*keys, "i", F.posexplode("row").alias("j", "v"))
    return p.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def dissimilarity_correlations(df: DataFrame, regions: list[str]) -> DataFrame:
    """Correlation of the upper triangles of the dissimilarity matrices of every pair of regions (columns of patterns).

    The needed sums over pairs of items come from products of features: the sum of r over all pairs is
    |sum u|^2, the sum of r * r' is the squared norm of U'V. All regions are stacked behind a one, so that a
    single product holds the count, the sums and the products of all pairs; no pair of items is built. A pair
    of regions counts the items that vary in both, so products are kept apart by which regions vary."""
    widths = df.agg(*[F.coalesce(F.max(F.size(r)), F.lit(0)) for r in regions]).first()
    d = df.select(*[A.unit(A.as_double(F.col(r))).alias(f"u{i}") for i, r in enumerate(regions)])
    there = F.concat(*[F.when(F.col(f"u{i}").isNull(), "0").otherwise("1") for i in range(len(regions))])
    x = F.flatten(F.array(F.array(F.lit(1.0)), *[F.coalesce(F.col(f"u{i}"), F.array_repeat(F.lit(0.0), w)) for i, w in enumerate(widths)]))
    g = gram(d.select(there.alias("there"), x.alias("x")), ["there"], "x", "x")
    owner = F.array(*[F.lit(k) for k in [-1, *[i for i, w in enumerate(widths) for _ in range(w)]]])
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(k).alias("b")) for i in range(len(regions)) for k in range(i + 1, len(regions))]))
    e = g.select("there", "i", "j", "v", F.get(owner, F.col("i")).alias("oi"), F.get(owner, F.col("j")).alias("oj"), pairs.alias("p")).select(
        "there", "i", "j", "v", "oi", "oj", "p.a", "p.b")
    used = [(F.substring("there", F.col(c) + 1, F.lit(1)) == "1") for c in ("a", "b")]
    e = e.filter(used[0] & used[1]).groupBy("a", "b", "i", "j", "oi", "oj").agg(F.sum("v").alias("v"))
    oi, oj, square = F.col("oi"), F.col("oj"), F.col("v") * F.col("v")
    one = e.groupBy("a", "b").agg(
        F.max(F.when((oi == -1) & (oj == -1), F.col("v"))).alias("n"),
        *[F.sum(F.when((oi == -1) & (oj == F.col(c)), square)).alias(f"s_{c}") for c in ("a", "b")],
        *[F.sum(F.when((oi == F.col(c)) & (oj == F.col(k)), square)).alias(f"q_{c}{k}") for c, k in (("a", "a"), ("b", "b"), ("a", "b"))])
    k = F.col("n") * (F.col("n") - 1) / 2

    def half(c):
        return (F.col(c) - F.col("n")) / 2
    ma, mb = half("s_a") / k, half("s_b") / k
    cov = half("q_ab") / k - ma * mb
    r = cov / F.sqrt((half("q_aa") / k - ma * ma) * (half("q_bb") / k - mb * mb))
    names = F.array(*[F.lit(x) for x in regions])
    return one.select(F.get(names, F.col("a")).alias("region_a"), F.get(names, F.col("b")).alias("region_b"), k.cast("bigint").alias("n_pairs"), r.alias("r"))


def matched_correlation(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of the two patterns with the same key."""
    j = left.select(*keys, F.col("features").alias("a")).join(
        right.select(*keys, F.col("features").alias("b")), keys)
    return j.select(*keys, A.corr(F.col("a"), F.col("b")).alias("r"))


# ---- maps ------------------------------------------------------------------------------

def _informative(a: str, b: str) -> Column:
    x, y = F.col(a), F.col(b)
    return A.finite(x) & A.finite(y) & ((x != 0) | (y != 0))


def map_similarity(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pearson, Spearman, cosine, sign agreement and differences of two maps, over voxels
    finite in both and not zero in both. NULL below three voxels."""
    d = cut_lineage(pairs.filter(_informative(a, b)).select(*keys, F.col(a).alias("a"), F.col(b).alias("b")))
    d = average_ranks(average_ranks(d, keys, "a", "ra"), keys, "b", "rb")
    x, y = F.col("a"), F.col("b")
    signed = (x != 0) & (y != 0)
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_voxels"), F.corr("a", "b").alias("pearson_r"),
        F.corr("ra", "rb").alias("spearman_r"),
        (F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine"),
        F.avg(F.when(signed, (F.signum(x) == F.signum(y)).cast("double"))).alias("sign_agreement"),
        F.avg(F.abs(x - y)).alias("mean_abs_difference"),
        F.sqrt(F.avg((x - y) * (x - y))).alias("rms_difference"))
    enough = F.col("n_voxels") >= 3
    return g.select(*keys, "n_voxels", *[F.when(enough, F.col(c)).alias(c) for c in g.columns if c not in (*keys, "n_voxels")],
                    F.when(enough, pearson_p(F.col("pearson_r"), F.col("n_voxels"))).alias("pearson_p"),
                    F.when(enough, pearson_p(F.col("spearman_r"), F.col("n_voxels"))).alias("spearman_p"))


def map_correlation(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    ok = A.finite(F.col(a)) & A.finite(F.col(b))
    return pairs.filter(ok).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r"), F.max(F.abs(F.col(a) - F.col(b))).alias("max_abs_difference"))


def group_weight_map(maps: DataFrame, keys: list[str], subject: str, voxel: str, value: str,
                     scale: bool) -> DataFrame:
    """Sum, count and mean over subjects; with ``scale`` each subject's map is z-scored first."""
    v = F.col(value)
    if scale:
        st = maps.groupBy(*keys, subject).agg(F.avg(value).alias("__m"), sd_pop(v).alias("__s"))
        maps = maps.join(st, [*keys, subject])
        v = F.when(F.col("__s") > 0, (v - F.col("__m")) / F.col("__s")).otherwise(0.0)
    g = maps.groupBy(*keys, voxel).agg(F.sum(v).alias("total"), F.count(value).alias("n"))
    return g.withColumn("mean", F.col("total") / F.col("n"))


def top_map_correlation(pairs: DataFrame, keys: list[str], voxel: str, a: str, b: str,
                        proportion: float) -> DataFrame:
    """Correlation on the strongest voxels of map ``a`` against the one on all voxels."""
    d = cut_lineage(pairs.filter(A.finite(F.col(a)) & A.finite(F.col(b))).withColumn("__s", F.abs(a)))
    full = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_full"), F.corr(a, b).alias("full_r"))
    top = top_fraction(d, keys, voxel, "__s", proportion, 3, settled=True, nearest=True)
    t = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_top"), F.corr(a, b).alias("top_r"))
    return full.join(t, keys).withColumn("top_minus_full", F.col("top_r") - F.col("full_r"))


def group_definitions(pairs: DataFrame, keys: list[str], subject: str, voxel: str, a: str,
                      b: str) -> DataFrame:
    """Correlation of the mean maps next to the mean of the subjects' correlations, with
    one-sided tests (> 0) of the latter on the raw and the Fisher scale."""
    means = pairs.groupBy(*keys, voxel).agg(F.avg(a).alias("a"), F.avg(b).alias("b"))
    g1 = means.groupBy(*keys).agg(F.corr("a", "b").alias("group_map_r"))
    r = map_correlation(pairs, [*keys, subject], a, b)
    z = fisher_z(F.col("r"))
    g2 = r.groupBy(*keys).agg(F.count("r").alias("n"), F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("sd_r"),
                              F.avg(z).alias("mz"), F.stddev_samp(z).alias("sz"))
    n = F.col("n")
    return g1.join(g2, keys).select(
        *keys, "n", "group_map_r", "mean_r", F.tanh("mz").alias("fisher_r"),
        t_greater(F.col("mean_r") / (F.col("sd_r") / F.sqrt(n)), n - 1).alias("p_raw"),
        t_greater(F.col("mz") / (F.col("sz") / F.sqrt(n)), n - 1).alias("p_fisher"))


def haufe(scores: DataFrame, keys: list[str], x: str, decision: str) -> DataFrame:
    """cov(x, decision) / var(decision) per feature; zero without variance."""
    g = scores.groupBy(*keys).agg(F.covar_samp(x, decision).alias("__c"), F.var_samp(decision).alias("__v"))
    return g.select(*keys, F.when(F.col("__v") > 0, F.col("__c") / F.col("__v")).otherwise(0.0).alias("pattern"))


def selection_frequency(selected: DataFrame, keys: list[str], feature: str, n_folds: int) -> DataFrame:
    return selected.groupBy(*keys, feature).agg(F.count(F.lit(1)).alias("times")).withColumn(
        "frequency", F.col("times") / n_folds)
