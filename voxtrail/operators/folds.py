"""Contrast pools and folds as key columns.

A trial gets its fold from a hash rank, so folds and repeats need no stored random state
and every engine can repeat them. All folds, repeats and contrasts are rows of one table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from voxtrail.operators.patterns import chunk_of
from voxtrail.operators.ranks import bucketed_row_number, hash_row_number


@dataclass(frozen=True)
class Contrast:
    name: str
    kind: str
    train_source: str
    test_source: str
    positive: str


# The four contrasts inside a source and the four across sources.
CONTRASTS = tuple(
    Contrast(f"within_{s}_{p}", "within", s, s, p) for s in ("natural", "ai") for p in ("pleasant", "unpleasant")
) + tuple(
    Contrast(f"{a}_to_{b}_{p}", "cross", a, b, p)
    for a, b in (("natural", "ai"), ("ai", "natural")) for p in ("pleasant", "unpleasant"))


def contrast_pool(trials: DataFrame, contrasts=CONTRASTS, neutral: str = "neutral") -> DataFrame:
    """One row per trial and contrast it takes part in, with its label and roles. The contrast
    list is a parameter, so this is a projection and not a join."""
    def entry(c: Contrast):
        src = F.col("source")
        used = src.isin(c.train_source, c.test_source) & F.col("valence").isin(c.positive, neutral)
        return F.when(used, F.struct(
            F.lit(c.name).alias("contrast"), F.lit(c.kind).alias("kind"),
            (F.col("valence") == c.positive).cast("int").alias("y"),
            (src == c.train_source).alias("is_train"), (src == c.test_source).alias("is_test")))
    rows = F.filter(F.array(*[entry(c) for c in contrasts]), lambda e: e.isNotNull())
    return trials.select(*trials.columns, F.explode(rows).alias("__e")).select(
        *trials.columns, "__e.contrast", "__e.kind", "__e.y", "__e.is_train", "__e.is_test")


def run_folds(pool: DataFrame, run: str = "run", exclude: list[int] | None = None) -> DataFrame:
    """Leave one run out: train on the other runs of the training source."""
    d = pool if not exclude else pool.filter(~F.col(run).isin(exclude))
    return d.withColumn("fold", F.col(run).cast("bigint"))


def with_repeats(pool: DataFrame, n: int) -> DataFrame:
    return pool.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def stratified_folds(pool: DataFrame, model: list[str], trial: str, k: int,
                     salt: list | None = None) -> DataFrame:
    """k folds with the classes spread evenly: hash rank inside model and class, modulo k."""
    d = hash_row_number(pool, [*model, "y"], [F.lit("fold"), *(salt or []), *[F.col(m) for m in model]],
                        [trial], "__rn")
    return d.withColumn("fold", (F.col("__rn") - 1) % k).drop("__rn")


def identity_folds(pool: DataFrame, model: list[str], family: str, k: int) -> DataFrame:
    """No family on both sides: families are ranked by hash inside their class. The rank is
    over distinct families, a table much smaller than the trials."""
    fam = pool.groupBy(*model, family).agg(F.min("y").alias("__fy"))
    fam = hash_row_number(fam, [*model, "__fy"], [F.lit("family")], [family], "__rn")
    fam = fam.select(*model, family, ((F.col("__rn") - 1) % k).alias("fold"))
    return pool.join(fam, [*model, family])


def leaked_families(rows: DataFrame, model: list[str], family: str) -> DataFrame:
    """Families that occur in more than one fold of a model."""
    return rows.groupBy(*model, family).agg(F.count_distinct("fold").alias("n")).filter("n > 1")


def single_split(pool: DataFrame) -> DataFrame:
    """Train on one source, test on the other: training rows are never held out."""
    return pool.withColumn("fold", F.when(F.col("is_test"), F.lit(0)).otherwise(-1).cast("bigint"))


def paired_folds(pool: DataFrame, model: list[str], trial: str, k: int) -> DataFrame:
    """Fold i trains on the complement of fold i in the training source and tests on fold i of
    the other; both sources are folded on their own."""
    return stratified_folds(pool.withColumn("__role", F.col("is_test").cast("int")),
                            [*model, "__role"], trial, k).drop("__role")


def balanced(pool: DataFrame, model: list[str], trial: str) -> DataFrame:
    """A random subset of the larger class, as large as the smaller one."""
    d = hash_row_number(pool, [*model, "y"], [F.lit("balance"), *[F.col(m) for m in model]], [trial], "__rn")
    n = pool.groupBy(*model, "y").agg(F.count(F.lit(1)).alias("__c")).groupBy(*model).agg(F.min("__c").alias("__k"))
    return d.join(n, model).filter(F.col("__rn") <= F.col("__k")).drop("__rn", "__k")


def chunks(df: DataFrame, keys: list[str], trial: str, k: int, width: int = 1 << 20) -> DataFrame:
    """Chunk 0..k-1 by trial order, sizes differing by at most one."""
    d = bucketed_row_number(df, keys, F.floor(F.col(trial) / width), [trial], "__rn", total="__n")
    return d.withColumn("chunk", chunk_of(F.col("__rn") - 1, F.col("__n"), k)).drop("__rn", "__n")


def random_chunks(df: DataFrame, keys: list[str], trial: str, k: int, salt: list) -> DataFrame:
    d = hash_row_number(df, keys, salt, [trial], "__rn", total="__n")
    return d.withColumn("chunk", chunk_of(F.col("__rn") - 1, F.col("__n"), k)).drop("__rn", "__n")
