"""Group statistics: summaries, t-tests, effect sizes and false-discovery control.

Everything is a grouped aggregate with partial (map-side) sums; order statistics and
q-values go through ``ranks`` so that no group is sorted whole in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from voxtrail.functions.arrays import finite
from voxtrail.functions.stats import (cohens_d, fisher_z, one_sample_t, pooled_t, sem, t_greater,
                                      t_two_sided)
from voxtrail.functions.text import star_label
from voxtrail.operators.ranks import bh_qvalues, exact_quantiles


def join_all(frames: list[DataFrame], keys: list[str], how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, how), frames)


def describe(df: DataFrame, keys: list[str], value: str, median: bool = True) -> DataFrame:
    """n, mean, sd (ddof=1), sem (missing below two rows), min, max and median."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    base = base.withColumn("sem", sem(F.col("sd"), F.col("n")))
    if not median:
        return base
    return base.join(exact_quantiles(df, keys, value, {"median": 0.5}), keys)


def collapse_kinds(df: DataFrame, keys: list[str], kind: str, value: str) -> DataFrame:
    """Mean per kind and over all kinds; each cell weighs the same in the overall row."""
    cols = [F.col(k) for k in keys]
    return (df.groupingSets([[*cols, F.col(kind)], cols], *cols, F.col(kind))
            .agg(F.avg(value).alias("mean"), F.count(value).alias("n"),
                 F.grouping(kind).alias("__all"))
            .withColumn(kind, F.when(F.col("__all") == 1, F.lit("overall")).otherwise(F.col(kind)))
            .drop("__all"))


def one_sample(df: DataFrame, keys: list[str], value: str, mu: float,
               greater: bool = False, flat: tuple[float, float] | None = None) -> DataFrame:
    """One-sample t-test against ``mu``; ``flat`` is the (t, p) of a cell without variance."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                              F.stddev_samp(value).alias("sd"))
    g = g.withColumn("sem", sem(F.col("sd"), F.col("n")))
    return with_t(g, mu, greater, flat)


def with_t(g: DataFrame, mu: float, greater: bool = False,
           flat: tuple[float, float] | None = None) -> DataFrame:
    """t and p from columns n, mean and sd."""
    tail = t_greater if greater else t_two_sided
    g = g.withColumn("t", one_sample_t(F.col("mean"), F.col("sd"), F.col("n"), mu))
    g = g.withColumn("p", tail(F.col("t"), F.col("n") - 1))
    if flat:
        g = (g.withColumn("t", F.coalesce("t", F.lit(flat[0])))
             .withColumn("p", F.coalesce("p", F.lit(flat[1]))))
    return g


def pivot_values(df: DataFrame, keys: list[str], name: str, value: str,
                 wanted: list[str]) -> DataFrame:
    """One column per wanted name (mean over copies); a fixed list keeps it one aggregate."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(F.col(name) == w, F.col(value))).alias(w)
                                   for w in wanted])


def paired_tests(df: DataFrame, keys: list[str], unit: str, name: str, value: str,
                 pairs: list[tuple[str, str]], mu: float = 0.0) -> DataFrame:
    """Paired t-test over units for each pair of conditions, complete pairs only."""
    wanted = sorted({c for p in pairs for c in p})
    wide = pivot_values(df, [*keys, unit], name, value, wanted)
    diffs = F.explode(F.array(*[
        F.struct(F.lit(f"{a} - {b}").alias("pair"), (F.col(a) - F.col(b)).alias("diff"))
        for a, b in pairs])).alias("d")
    long = wide.select(*keys, unit, diffs).select(*keys, "d.pair", "d.diff")
    return one_sample(long, [*keys, "pair"], "diff", mu)


def _two_sample(df, keys, group, a, b, value):
    def side(label, tag):
        v = F.when(F.col(group) == label, F.col(value))
        return [F.avg(v).alias("m" + tag), F.var_samp(v).alias("v" + tag), F.count(v).alias("n" + tag)]
    return df.groupBy(*keys).agg(*side(a, "a"), *side(b, "b"))


_SIDES = ["ma", "va", "na", "mb", "vb", "nb"]


def independent_test(df: DataFrame, keys: list[str], group: str, a: str, b: str,
                     value: str) -> DataFrame:
    """Equal-variance t-test between two unrelated groups."""
    g = _two_sample(df, keys, group, a, b, value)
    g = g.withColumn("t", pooled_t(*[F.col(c) for c in _SIDES])).withColumn(
        "df", F.col("na") + F.col("nb") - 2)
    return g.withColumn("p", t_two_sided(F.col("t"), F.col("df"))).select(
        *keys, F.col("ma").alias("mean_a"), F.col("mb").alias("mean_b"), "na", "nb", "t", "df", "p")


def effect_size(df: DataFrame, keys: list[str], group: str, a: str, b: str, value: str,
                out: str = "d") -> DataFrame:
    g = _two_sample(df, keys, group, a, b, value)
    return g.select(*keys, cohens_d(*[F.col(c) for c in _SIDES]).alias(out))


def compression(effects: DataFrame, keys: list[str], by: list[str], pipeline: str,
                effect: str, first: str, second: str, clip: float | None = None) -> DataFrame:
    """|effect| of two pipelines on shared cells and their ratio, averaged per condition.

    With ``clip``, also the mean of the ratios cut there and the number of cells that were cut."""
    wide = pivot_values(effects, keys, pipeline, effect, [first, second]).filter(
        F.col(first).isNotNull() & F.col(second).isNotNull())
    wide = wide.withColumn("ratio", F.when(F.col(second) != 0, F.abs(first) / F.abs(second)))
    cut = [] if clip is None else [F.avg(F.least("ratio", F.lit(clip))).alias("mean_clipped_ratio"),
                                   F.count_if(F.col("ratio") > clip).alias("n_clipped")]
    base = wide.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg(F.abs(first)).alias("mean_abs_first"),
        F.avg(F.abs(second)).alias("mean_abs_second"), F.avg("ratio").alias("mean_ratio"), *cut)
    return base.join(exact_quantiles(wide, by, "ratio", {"median_ratio": 0.5}), by)


def group_cells(df: DataFrame, contrast: str, roi: str, subject: str, value: str,
                chance: float = 0.5, alpha: float = 0.05,
                expected_subjects: int | None = None) -> DataFrame:
    """Contrast x region cells: mean, sem, t against chance, q within the contrast."""
    g = df.groupBy(contrast, roi).agg(
        F.count_distinct(subject).alias("n_subjects"), F.count(value).alias("n"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    g = with_t(g.withColumn("sem", sem(F.col("sd"), F.col("n"))), chance)
    g = bh_qvalues(g, "p", [contrast], "q").withColumn("significant", F.col("q") < alpha)
    if expected_subjects is not None:
        g = g.withColumn("complete", F.col("n_subjects") == expected_subjects)
    return g


def group_mask(df: DataFrame, voxel: str, subject: str, n_subjects: int, value: str,
               keys: list[str] | None = None) -> DataFrame:
    """Voxels with a finite value in every subject."""
    return (df.filter(finite(F.col(value))).groupBy(*(keys or []), voxel)
            .agg(F.count_distinct(subject).alias("__n"))
            .filter(F.col("__n") == n_subjects).drop("__n"))


def voxel_group_map(df: DataFrame, keys: list[str], voxel: str, value: str,
                    n_subjects: int | Column, q_limit: float = 0.05) -> DataFrame:
    """Per voxel seen in all subjects: mean, t, p, q (family = keys), thresholded t.

    One row per subject and voxel is the contract, so the mask is ``n == n_subjects`` of
    the aggregate that is needed anyway."""
    g = one_sample(df, [*keys, voxel], value, 0.0, flat=(0.0, 1.0)).filter(
        F.col("n") == n_subjects)
    g = bh_qvalues(g, "p", keys, "q")
    return g.withColumn("t_thresholded", F.when(F.col("q") < q_limit, F.col("t")).otherwise(0.0))


def voxel_map_summary(g: DataFrame, keys: list[str], q_limit: float = 0.05) -> DataFrame:
    sig = F.col("q") < q_limit
    return g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mask_voxels"),
        F.count_if(sig).alias("n_significant"),
        F.count_if(sig & (F.col("t") > 0)).alias("n_positive"),
        F.count_if(sig & (F.col("t") < 0)).alias("n_negative"),
        F.max("t").alias("max_t"), F.min("t").alias("min_t"), F.min("q").alias("min_q"),
        (F.count_if(sig) * 100.0 / F.count(F.lit(1))).alias("pct_of_mask"))


def group_mean_map(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, SD (ddof=0) and number of finite values; missing outside the support."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"),
                                 F.count(value).alias("n_valid"))


def map_difference(df: DataFrame, keys: list[str], branch: str, a: str, b: str,
                   value: str) -> DataFrame:
    """b minus a of the group means where both branches have a value."""
    wide = pivot_values(df, keys, branch, value, [a, b])
    return wide.select(*keys, (F.col(b) - F.col(a)).alias("difference")).filter(
        F.col("difference").isNotNull())


def spatial_summary(df: DataFrame, keys: list[str], value: str, chance: float) -> DataFrame:
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n_valid"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"),
        F.avg(F.when(F.col(value).isNotNull(), (F.col(value) > chance).cast("double")))
        .alias("fraction_above"))
    q = exact_quantiles(df, keys, value, {"median": 0.5, "q05": 0.05, "q95": 0.95})
    return base.join(q, keys)


def regressor_category(index: Column, n_runs: int = 10, stimuli: int = 60,
                       motion: int = 6) -> Column:
    """Category of a 0-based regressor position: per run stimuli then motion terms, at the
    end one baseline per run; NULL past the end."""
    block = stimuli + motion
    run, at = F.floor(index / block) + 1, index % block
    return (F.when(index >= n_runs * block + n_runs, None)
            .when(index >= n_runs * block, F.concat(F.lit("Baseline"), index - n_runs * block + 1))
            .when(at < stimuli, F.concat(F.lit("Run"), run, F.lit("_StimMax")))
            .otherwise(F.concat(F.lit("Run"), run, F.lit("_Motion"), at - stimuli + 1)))


def signal_to_noise(df: DataFrame, keys: list[str], condition: str, subject: str,
                    value: str) -> DataFrame:
    """SD of the condition means over SD inside conditions (both ddof=0)."""
    within = df.groupBy(*keys, condition).agg(F.stddev_pop(value).alias("__s"))
    between = df.groupBy(*keys, condition, subject).agg(F.avg(value).alias("__m"))
    # both aggregate again to one row per key
    w = within.groupBy(*keys).agg(F.avg("__s").alias("within_sd"))
    b = between.groupBy(*keys).agg(F.stddev_pop("__m").alias("between_sd"))
    return w.join(b, keys).withColumn("snr", F.col("between_sd") / F.col("within_sd"))


def variability(df: DataFrame, keys: list[str], unit: list[str], value: str) -> DataFrame:
    """Mean over units (subject, voxel) of the SD over trials, and the SD of all values.

    The overall SD follows from the unit sums, so the long table is read once."""
    v = F.col(value)
    u = df.groupBy(*keys, *unit).agg(F.count(v).alias("__n"), F.sum(v).alias("__s"),
                                     F.sum(v * v).alias("__q"), F.stddev_pop(v).alias("__sd"))
    n, s, q = F.sum("__n"), F.sum("__s"), F.sum("__q")
    return u.groupBy(*keys).agg(n.alias("n_values"), F.avg("__sd").alias("mean_sd"),
                                F.sqrt(q / n - (s / n) * (s / n)).alias("overall_sd"))


def two_level_mean(df: DataFrame, keys: list[str], unit: str, value: str) -> DataFrame:
    """Mean per unit first, then mean, SD, SEM and number of units."""
    u = df.groupBy(*keys, unit).agg(F.avg(value).alias("__v"))
    return u.groupBy(*keys).agg(
        F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("sd")
    ).withColumn("sem", sem(F.col("sd"), F.col("n")))


def map_mean_test(df: DataFrame, keys: list[str], unit: str, value: str, mu: float) -> DataFrame:
    """Whole-map mean per unit, then group mean, SEM with ddof=0, range, t and stars."""
    u = df.groupBy(*keys, unit).agg(F.avg(value).alias("__v"))
    g = u.groupBy(*keys).agg(
        F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("sd"),
        (F.stddev_pop("__v") / F.sqrt(F.count("__v"))).alias("sem"),
        F.min("__v").alias("min"), F.max("__v").alias("max"))
    return with_t(g, mu).withColumn("stars", star_label(F.col("p"))).drop("sd")


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from the group's own range, count and density; all values are used."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"),
                                 F.count(value).alias("__n"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("__lo")) / width))
    d = df.filter(F.col(value).isNotNull()).join(ends, keys).withColumn(
        "bin", F.when(width > 0, at).otherwise(F.lit(0)).cast("int"))
    # the group's range rides along as a key, so one aggregate yields the density
    g = d.groupBy(*keys, "bin", "__lo", "__hi", "__n").agg(F.count(F.lit(1)).alias("count"))
    return g.select(*keys, "bin", "count", (F.col("__lo") + F.col("bin") * width).alias("left_edge"),
                    F.when(width > 0, F.col("count") / (F.col("__n") * width)).alias("density"))


def win_rate(df: DataFrame, keys: list[str], by: list[str], variant: str, a: str, b: str,
             value: str) -> DataFrame:
    """Mean difference a - b over shared cells and the share of cells that a wins."""
    wide = pivot_values(df, keys, variant, value, [a, b])
    d = F.col(a) - F.col(b)
    return wide.groupBy(*by).agg(
        F.count(d).alias("n_cells"), F.avg(d).alias("mean_difference"),
        F.count_if(d > 0).alias("wins"),
        (F.count_if(d > 0) / F.count(d)).alias("win_rate"))


def baseline_deltas(df: DataFrame, keys: list[str], pipeline: str, value: str, baseline: str,
                    others: list[str]) -> DataFrame:
    """One row per cell and other pipeline: value minus the baseline's value."""
    wide = pivot_values(df, keys, pipeline, value, [baseline, *others])
    rows = F.explode(F.array(*[F.struct(F.lit(o).alias("pipeline"), (F.col(o) - F.col(baseline))
                                        .alias("delta")) for o in others])).alias("r")
    return wide.select(*keys, rows).select(*keys, "r.pipeline", "r.delta")


def subset_cases(df: DataFrame, subject: str, cases: dict[str, list[int]], out: str = "case") -> DataFrame:
    """Repeats each row once per subject list that holds its subject (lists are parameters)."""
    named = F.array(*[F.when(F.col(subject).isin(members), F.lit(name))
                      for name, members in cases.items()])
    return df.withColumn(out, F.explode(F.filter(named, lambda c: c.isNotNull())))


def subset_map_summary(df: DataFrame, cases: dict[str, list[int]], subject: str, contrast: str,
                       voxel: str, value: str, q_limit: float = 0.05) -> DataFrame:
    """Voxel map summary for every subject list, all lists in one pass."""
    size = F.lit(None).cast("int")
    for name, members in cases.items():
        size = F.when(F.col("case") == name, len(members)).otherwise(size)
    keys = ["case", contrast]
    g = voxel_group_map(subset_cases(df, subject, cases), keys, voxel, value, size, q_limit)
    return voxel_map_summary(g, keys, q_limit).select(
        *keys, size.alias("n_subjects"), "n_significant", "pct_of_mask",
        F.col("max_t").alias("peak_t"), "min_q")


def fisher_mean(df: DataFrame, keys: list[str], r: str) -> DataFrame:
    """Group mean of correlations in Fisher-z space, and SEM of the z values."""
    z = fisher_z(F.col(r))
    return df.groupBy(*keys).agg(
        F.count(r).alias("n"), F.tanh(F.avg(z)).alias("fisher_mean_r"), F.avg(r).alias("mean_r"),
        F.when(F.count(r) >= 2, F.stddev_samp(z) / F.sqrt(F.count(r))).alias("sem_z"))


def source_comparison(wide: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Two accuracies per subject: means, difference, ratio, paired t and correlation."""
    d = F.col(a) - F.col(b)
    g = wide.groupBy(*keys).agg(
        F.count(d).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(d).alias("mean"),
        F.stddev_samp(d).alias("sd"), F.avg(F.col(a) / F.nullif(F.col(b), F.lit(0.0))).alias("mean_ratio"),
        F.corr(a, b).alias("r"))
    return with_t(g, 0.0).withColumnRenamed("mean", "mean_difference").drop("sd")


def region_concordance(wide: DataFrame, keys: list[str], roi: str, a: str, b: str) -> DataFrame:
    """Mean accuracies per region, their difference, and r across regions within the keys."""
    m = wide.groupBy(*keys, roi).agg(F.avg(a).alias("natural"), F.avg(b).alias("ai"))
    r = m.groupBy(*keys).agg(F.corr("natural", "ai").alias("r"))
    return m.join(r, keys).withColumn("difference", F.col("natural") - F.col("ai"))


def cross_map_audit(wide: DataFrame, keys: list[str], map_r: str, chance: float) -> DataFrame:
    """One-sided tests of within, cross and map correlation, three paired tests, and the
    correlation across subjects of cross accuracy and map similarity."""
    wn, wa = F.col("within_natural"), F.col("within_ai")
    d = wide.withColumn("wm", (wn + wa) / 2).withColumn(
        "cm", (F.col("natural_to_ai") + F.col("ai_to_natural")) / 2)
    tests = {"within_mean > chance": F.col("wm") - chance, "cross_mean > chance": F.col("cm") - chance,
             "map_r > 0": fisher_z(F.col(map_r)), "cross - within_mean": F.col("cm") - F.col("wm"),
             "cross - within_min": F.col("cm") - F.least(wn, wa), "natural - ai": wn - wa}
    long = d.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("test"), x.alias("d"))
                                               for n, x in tests.items()])).alias("e"))
    g = long.groupBy(*keys, "e.test").agg(F.count("e.d").alias("n"), F.avg("e.d").alias("mean"), F.stddev_samp("e.d").alias("sd"))
    t = one_sample_t(F.col("mean"), F.col("sd"), F.col("n"))
    g = g.withColumn("t", t)
    p = F.when(F.col("test").contains(">"), t_greater(F.col("t"), F.col("n") - 1)).otherwise(t_two_sided(F.col("t"), F.col("n") - 1))
    r = d.groupBy(*keys).agg(F.corr("cm", map_r).alias("r_cross_map"))
    return g.withColumn("p", p).drop("sd").join(r, keys)
