"""Result tables: ranks, pivots, reshaping and cross-generalisation indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtrail.functions.text import unsided
from voxtrail.operators.ranks import value_row_number


def to_wide(df: DataFrame, keys: list[str], name: str, value: str, wanted: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot(name, wanted).agg(F.first(value, True))


def to_long(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, columns, name, value).filter(F.col(value).isNotNull())


def top_fraction(df: DataFrame, keys: list[str], feature: str, score: str, fraction: float,
                 least: int, settled: bool = False, nearest: bool = False) -> DataFrame:
    """The best ``max(least, ceil(n * fraction))`` features of each model, ties by feature;
    ``nearest`` rounds (halves to even) instead of taking the ceiling."""
    d = value_row_number(df, keys, score, [feature], "__rn", descending=True, total="__n",
                         settled=settled)
    size = (F.rint if nearest else F.ceil)(F.col("__n") * fraction)
    k = F.least(F.col("__n"), F.greatest(F.lit(least), size.cast("bigint")))
    return d.filter(F.col("__rn") <= k).withColumnRenamed("__rn", "rank").drop("__n")


def peak(df: DataFrame, keys: list[str], value: str, voxel: str, coords: list[str],
         absolute: bool = True) -> DataFrame:
    """Extreme of each map with its place; ties go to the smallest voxel id."""
    size = F.abs(value) if absolute else F.col(value)
    best = F.max_by(F.struct(voxel, *coords, value), F.struct(size, -F.col(voxel))).alias("__p")
    g = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(best)
    return g.select(*keys, *[F.col("__p")[c].alias(c) for c in (voxel, *coords, value)])


def rank_regions(df: DataFrame, roi: str, contrast: str, value: str) -> DataFrame:
    """Regions by the mean over contrasts of the contrast means; missing last, ties by name.
    The final window sees one row per region of the atlas."""
    m = df.groupBy(roi, contrast).agg(F.avg(value).alias("__m"))
    g = m.groupBy(roi).agg(F.avg("__m").alias("score"))
    w = Window.orderBy(F.desc_nulls_last("score"), roi)
    return g.withColumn("rank", F.row_number().over(w).cast("bigint"))


def candidate_table(df: DataFrame, flag: str, by: list[str], ties: list[str]) -> DataFrame:
    """Ranked summary table, candidates first; one row per region and contrast."""
    w = Window.orderBy(F.desc(flag), *[F.desc_nulls_last(b) for b in by], *ties)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint"))


def significance_table(df: DataFrame, roi: str, contrast: str, flag: str,
                       contrasts: list[str]) -> DataFrame:
    wide = df.groupBy(roi).pivot(contrast, contrasts).agg(F.max(flag))
    n = sum((F.coalesce(F.col(x), F.lit(False)).cast("bigint") for x in contrasts), F.lit(0).cast("bigint"))
    return wide.withColumn("n_significant", n).withColumn(
        "group", F.when(n == len(contrasts), "shared").when(n == 1, "specific").otherwise("other"))


def accuracy_pivot(df: DataFrame, roi: str, contrast: str, value: str, contrasts: list[str]) -> DataFrame:
    """Accuracy per region, one column per contrast."""
    return df.groupBy(roi).pivot(contrast, contrasts).agg(F.max(value))


def count_histogram(table: DataFrame, n: int) -> DataFrame:
    """Regions by the number of contrasts in which they are significant, 0 to ``n``; from the
    significance table."""
    counts = table.groupBy("n_significant").agg(F.count(F.lit(1)).alias("n_regions"))
    every = table.sparkSession.range(0, n + 1).withColumnRenamed("id", "n_significant")
    return every.join(counts, "n_significant", "left").fillna(0, ["n_regions"])


def wide_summary(df: DataFrame, keys: list[str], contrast: str, contrasts: list[str],
                 share: str, coords: list[str], members: str) -> DataFrame:
    """Per contrast: coordinate text, member names and share, side by side."""
    xyz = F.format_string("%d, %d, %d", *[F.round(c).cast("int") for c in coords])
    return df.groupBy(*keys).pivot(contrast, contrasts).agg(
        F.first(xyz, True).alias("xyz"), F.first(members, True).alias("members"),
        F.first(share, True).alias("share"))


def side_mean(df: DataFrame, keys: list[str], roi: str, value: str) -> DataFrame:
    """Mean of a left/right pair of regions, missing sides ignored."""
    return df.groupBy(*keys, unsided(F.col(roi)).alias("region")).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n_sides"))


def readable_names(df: DataFrame, names: DataFrame, code: str) -> DataFrame:
    j = df.join(names, code, "left")
    return j.withColumn("full_name", F.coalesce("full_name", F.col(code)))


def _ratio(a: Column, b: Column, eps: float) -> Column:
    return F.when(b > eps, a / b)


def generalization_indices(d: DataFrame, chance: float = 0.5, eps: float = 1e-6,
                           margin: float = 0.03) -> DataFrame:
    """Indices from columns within_natural, within_ai, natural_to_ai, ai_to_natural."""
    wn, wa, na, an = (F.col(x) for x in ("within_natural", "within_ai", "natural_to_ai", "ai_to_natural"))

    def mean2(x, y):
        return F.when(x.isNull(), y).when(y.isNull(), x).otherwise((x + y) / 2)
    d = (d.withColumn("within_mean", mean2(wn, wa)).withColumn("within_min", F.least(wn, wa))
         .withColumn("cross_mean", mean2(na, an)))
    cm = F.col("cross_mean") - chance
    both = F.coalesce((wn > chance) & (wa > chance), F.lit(False))
    above = F.coalesce(F.col("cross_mean") > chance, F.lit(False))
    strong = F.coalesce((wn >= chance + margin) & (wa >= chance + margin), F.lit(False))
    return (d.withColumn("within_mean_signal", F.col("within_mean") - chance)
            .withColumn("within_min_signal", F.col("within_min") - chance)
            .withColumn("cross_signal", cm)
            .withColumn("cross_generalization", _ratio(cm, F.col("within_mean") - chance, eps))
            .withColumn("shared_index", _ratio(cm, F.col("within_min") - chance, eps))
            .withColumn("cross_asymmetry", na - an).withColumn("within_asymmetry", wn - wa)
            .withColumn("within_both_above", both).withColumn("cross_above", above)
            .withColumn("candidate", both & above).withColumn("candidate_margin", strong & above))


def group_generalization(df: DataFrame, subject: str, keys: list[str], kind: str, value: str,
                         chance: float, eps: float, margin: float) -> DataFrame:
    """Accuracies averaged over subjects first, then the indices; next to them mean and SEM of the
    subjects' own cross-generalisation index. One aggregate per level."""
    kinds = ["within_natural", "within_ai", "natural_to_ai", "ai_to_natural"]
    per = df.groupBy(*keys, subject).agg(*[F.avg(F.when(F.col(kind) == k, F.col(value))).alias(k) for k in kinds])
    own = generalization_indices(per, chance, eps, margin)
    g = own.groupBy(*keys).agg(
        *[F.avg(k).alias(k) for k in kinds], F.count(F.lit(1)).alias("n_subjects"),
        F.count("cross_generalization").alias("n_index"), F.avg("cross_generalization").alias("mean_subject_index"),
        (F.stddev_samp("cross_generalization") / F.sqrt(F.count("cross_generalization"))).alias("sem_subject_index"))
    return generalization_indices(g, chance, eps, margin)


def sorted_table(df: DataFrame, order: list[Column]) -> DataFrame:
    """Summary table in report order with its place; one row per region."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint")).orderBy(*order)
