"""Trial patterns: layout, normalisation, averaging.

Arrays hold one pattern per row for row-wise work; ``explode_features`` gives the long
layout for statistics per voxel. Column names: ``features``, ``pos``, ``x``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtrail.functions import arrays as A
from voxtrail.functions.stats import sd_pop, sem


def slice_regions(df: DataFrame, embedding: str, width: int, n: int = 4) -> DataFrame:
    """One row per trial and region of ``width`` neighbouring features."""
    whole = F.col(embedding).cast("array<double>")
    parts = F.array(*[F.struct(F.lit(f"r{i}").alias("roi"),
                               F.slice(whole, 1 + i * width, width).alias("features"))
                      for i in range(n)])
    keep = [c for c in df.columns if c != embedding]
    return df.select(*keep, F.explode(parts).alias("__p")).select(*keep, "__p.roi", "__p.features")


def explode_features(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.posexplode("features").alias("pos", "x"))


def region_join(voxels: DataFrame, atlas: DataFrame, members: DataFrame) -> DataFrame:
    """Voxel x region membership: analysis voxels whose label belongs to the region's group."""
    return voxels.join(atlas, "voxel_id").join(members, "label").select(*voxels.columns, "roi")


def condition_mean(long: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    return long.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def contrast_map(means: DataFrame, keys: list[str], condition: str, value: str,
                 weights: dict[str, dict[str, float]]) -> DataFrame:
    """Weighted sum of condition means per contrast; contrasts with a missing condition are
    left out. The weights are a small design table and ride along as literals."""
    terms = F.array(*[F.when(F.col(condition) == cond, F.struct(
        F.lit(name).alias("contrast"), F.lit(float(w)).alias("w"), F.lit(len(spec)).alias("k")))
        for name, spec in weights.items() for cond, w in spec.items()])
    d = means.withColumn("__t", F.explode(F.filter(terms, lambda t: t.isNotNull())))
    g = d.groupBy(*keys, "__t.contrast").agg(
        F.sum(F.col("__t.w") * F.col(value)).alias("effect"), F.count(value).alias("__n"),
        F.max("__t.k").alias("__k"))
    return g.filter("__n = __k").drop("__n", "__k")


def repeat_average(df: DataFrame, keys: list[str], image: str, subject: str, value: str) -> DataFrame:
    """Repeats of an image averaged per subject, then mean, SD and SEM over subjects."""
    u = df.groupBy(*keys, image, subject).agg(F.avg(value).alias("__v"))
    return u.groupBy(*keys, image).agg(
        F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("sd")
    ).withColumn("sem", sem(F.col("sd"), F.col("n")))


# ---- normalisation ---------------------------------------------------------------------

def pattern_zscore(df: DataFrame) -> DataFrame:
    """Across the features of a trial, ddof=0; a constant pattern becomes zero."""
    return df.withColumn("features", A.zscore(F.col("features")))


def variant(features: Column, kind: str) -> Column:
    """raw, global (one mean), centred, or pattern-z."""
    if kind == "raw":
        return features
    if kind == "global":
        return F.array(A.mean(features))
    if kind == "centred":
        return A.centre(features)
    if kind == "patternz":
        return A.zscore(features)
    raise ValueError(kind)


def voxel_zscore(long: DataFrame, group: list[str], train: Column | None = None) -> DataFrame:
    """Per voxel, mean and SD (ddof=0) of the training rows; an SD of zero counts as one.

    A join on (group, pos) rather than a window: the statistics are tiny, the rows of a
    voxel never have to meet in one task."""
    v = F.col("x") if train is None else F.when(train, F.col("x"))
    st = long.groupBy(*group, "pos").agg(F.avg(v).alias("__m"), sd_pop(v).alias("__s"))
    st = st.withColumn("__s", F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0))
    return long.join(st, [*group, "pos"]).withColumn(
        "x", (F.col("x") - F.col("__m")) / F.col("__s")).drop("__m", "__s")


def leave_out_totals(per_unit: DataFrame, group: list[str], unit: str,
                     classes: list[str]) -> DataFrame:
    """Turns (n, mean, M2) per unit into those of all other units of the group.

    For each class tag c the columns are n{c}, m{c}, q{c}. Only one row per unit meets in the
    window. Sums are taken about the group mean, so nothing cancels badly."""
    w = Window.partitionBy(*group)
    d = per_unit
    for c in classes:
        d = d.withColumn(f"__N{c}", F.sum(f"n{c}").over(w)).withColumn(
            f"__C{c}", F.sum(F.col(f"n{c}") * F.coalesce(f"m{c}", F.lit(0.0))).over(w) / F.nullif(F.col(f"__N{c}"), F.lit(0)))
    for c in classes:
        dev = F.coalesce(F.col(f"m{c}") - F.col(f"__C{c}"), F.lit(0.0))
        d = d.withColumn(f"__D{c}", dev).withColumn(
            f"__Q{c}", F.sum(F.coalesce(f"q{c}", F.lit(0.0)) + F.col(f"n{c}") * dev * dev).over(w))
    outs = []
    for c in classes:
        n = F.col(f"__N{c}") - F.col(f"n{c}")
        shift = -F.col(f"n{c}") * F.col(f"__D{c}") / F.nullif(n, F.lit(0))  # new mean minus group mean
        own = F.coalesce(f"q{c}", F.lit(0.0)) + F.col(f"n{c}") * F.col(f"__D{c}") * F.col(f"__D{c}")
        outs += [n.alias(f"n{c}"), (F.col(f"__C{c}") + shift).alias(f"m{c}"),
                 F.greatest(F.lit(0.0), F.col(f"__Q{c}") - own - n * shift * shift).alias(f"q{c}")]
    return d.select(*group, unit, *outs)


def run_wise_zscore(long: DataFrame, group: list[str], run: str) -> DataFrame:
    """Every row scaled by the statistics of all runs but its own."""
    per = long.groupBy(*group, "pos", run).agg(
        F.count("x").alias("n_"), F.avg("x").alias("m_"), (F.var_pop("x") * F.count("x")).alias("q_"))
    st = leave_out_totals(per, [*group, "pos"], run, ["_"])
    sd = F.sqrt(F.col("q_") / F.col("n_"))
    return long.join(st, [*group, "pos", run]).withColumn(
        "x", (F.col("x") - F.col("m_")) / F.when(sd > 0, sd).otherwise(1.0)).drop("n_", "m_", "q_")


MODES = ("no", "voxel", "trial", "voxel_trial", "source", "voxel_source")


def normalise(df: DataFrame, mode: str, keep: list[str], group: list[str], source: str,
              train: Column | None = None) -> DataFrame:
    """Long table under one of six modes. ``voxel`` scales inside a trial, ``trial`` scales a
    voxel over the training rows of the group, ``source`` over all rows of the source."""
    if mode not in MODES:
        raise ValueError(mode)
    if mode not in ("no", "trial"):
        df = pattern_zscore(df)
    long = explode_features(df, keep)
    if mode in ("trial", "voxel_trial"):
        return voxel_zscore(long, group, train)
    if mode in ("source", "voxel_source"):
        return voxel_zscore(long, [*group, source])
    return long


# ---- filters ---------------------------------------------------------------------------

def finite_voxels(long: DataFrame, keys: list[str]) -> DataFrame:
    """Voxels finite in every trial."""
    return (long.groupBy(*keys, "pos").agg(F.min(A.finite(F.col("x"))).alias("__ok"))
            .filter("__ok").drop("__ok"))


def too_few(kept: DataFrame, keys: list[str], all_keys: DataFrame, least: int) -> DataFrame:
    """Groups with fewer than ``least`` voxels left."""
    n = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    return all_keys.join(n, keys, "left").fillna(0, ["n_left"]).filter(F.col("n_left") < least)


def variable_voxels(long: DataFrame, keys: list[str], train: Column, least_sd: float) -> DataFrame:
    """Voxels whose SD over the training rows exceeds the limit."""
    return (long.groupBy(*keys, "pos").agg(sd_pop(F.when(train, F.col("x"))).alias("sd"))
            .filter(F.col("sd") > least_sd))


def variable_voxels_outside(long: DataFrame, keys: list[str], unit: str, least_sd: float, out: str) -> DataFrame:
    """The same with each ``unit`` (a run) left out in turn, named ``out``: from the sums of the others, no row is copied."""
    per = long.groupBy(*keys, "pos", unit).agg(
        F.count("x").alias("n_"), F.avg("x").alias("m_"), (F.var_pop("x") * F.count("x")).alias("q_"))
    d = leave_out_totals(per, [*keys, "pos"], unit, ["_"])
    return d.select(*keys, F.col(unit).alias(out), "pos", F.sqrt(F.col("q_") / F.col("n_")).alias("sd")).filter(F.col("sd") > least_sd)


def sphere_status(long: DataFrame, sphere: list[str], least: int) -> DataFrame:
    """Per sphere: voxels finite in all conditions, of those with variance, and a status."""
    v = long.groupBy(*sphere, "pos").agg(F.min(A.finite(F.col("x"))).alias("__ok"),
                                         sd_pop(F.col("x")).alias("__v"))
    g = v.groupBy(*sphere).agg(F.count_if("__ok").alias("n_finite"),
                               F.count_if(F.col("__ok") & (F.col("__v") > 0)).alias("n_variable"))
    return g.withColumn("status", F.when(F.col("n_finite") < least, "too_few_finite_voxels")
                        .when(F.col("n_variable") < least, "too_few_variable_voxels").otherwise("ok"))


# ---- pseudo-trials ---------------------------------------------------------------------

def chunk_of(rank0: Column, n: Column, k: int) -> Column:
    """Chunk of a 0-based rank when n rows are split into k runs of nearly equal length; the
    first n % k chunks hold one row more."""
    size, extra = F.floor(n / k), n % k
    head = extra * (size + 1)
    return (F.when(rank0 < head, F.floor(rank0 / (size + 1)))
            .otherwise(extra + F.floor((rank0 - head) / F.greatest(size, F.lit(1)))).cast("int"))


def average_chunks(long: DataFrame, keys: list[str]) -> DataFrame:
    """Mean pattern per chunk, with the count and spread needed to combine chunks later."""
    return long.groupBy(*keys, "pos").agg(
        F.avg("x").alias("x"), F.count("x").alias("n"), (F.var_pop("x") * F.count("x")).alias("q"))


def normalised_axis(long: DataFrame, axes: dict[str, list[str]]) -> DataFrame:
    """For each axis: mean of means and mean of SDs over the groups that fix the other axes,
    and whether the data look normalised along it. One pass per axis over pre-summed groups."""
    parts = []
    for name, fixed in axes.items():
        u = long.groupBy(*fixed).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
        parts.append(u.agg(F.avg("m").alias("mean_of_means"), F.stddev_pop("m").alias("sd_of_means"),
                           F.avg("s").alias("mean_of_sds"), F.stddev_pop("s").alias("sd_of_sds"))
                     .select(F.lit(name).alias("axis"), "*"))
    d = reduce(DataFrame.unionByName, parts)
    return d.withColumn("normalised", (F.abs("mean_of_means") < 0.01) & (F.abs(F.col("mean_of_sds") - 1) < 0.1))
