"""Permutation inference: the permutation is a key column, never a loop."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from voxtrail.functions.hashing import PRIME, poly_seed
from voxtrail.operators.ranks import bh_qvalues, exact_quantiles, hash_row_number


SUBJECTS, DRAWS = 256, 10_000  # of one block


def with_permutations(df: DataFrame, n: int, observed: bool = True) -> DataFrame:
    """Repeats the (narrow) label table; permutation 0 is the observed order."""
    return df.withColumn("permutation", F.explode(F.sequence(F.lit(0 if observed else 1), F.lit(n))))


def shuffle_labels(df: DataFrame, pool: list[str], label: str, trial: str, salt: list,
                   out: str) -> DataFrame:
    """Shuffled labels with the class counts of the pool kept.

    Trials are put in hash order; the first n1 get the first label, the next n2 the second and
    so on. That is a uniform shuffle and needs the class counts only, not a second ranking."""
    counts = df.groupBy(*pool, label).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*pool).orderBy(label).rowsBetween(Window.unboundedPreceding, 0)
    edges = counts.withColumn("__to", F.sum("__c").over(w)).groupBy(*pool).agg(
        F.array_sort(F.collect_list(F.struct("__to", F.col(label).alias("l")))).alias("__edges"))
    d = hash_row_number(df, pool, salt, [trial], "__rn").join(edges, pool)
    hit = F.filter("__edges", lambda e: e["__to"] >= F.col("__rn"))
    return d.withColumn(out, F.get(hit, F.lit(0))["l"]).drop("__rn", "__edges")


def null_counts(pool: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Cells of the null pool whose number of shuffles is not the expected one."""
    return pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_null"),
                                   F.count_distinct("permutation").alias("n_distinct")).filter(
        (F.col("n_null") != expected) | (F.col("n_distinct") != expected))


def resample_group(pool: DataFrame, cell: list[str], subject: str, index: str, value: str,
                   n_draws: int, salt: str) -> DataFrame:
    """Group null: each draw takes one null value of every subject and averages them.

    ``index`` numbers the shuffles of a cell and subject from 0. The drawn index is a hash of
    (cell, subject, draw). A subject's null values of a cell are one array (its shuffles, a parameter
    of the first level); blocks of SUBJECTS subjects times DRAWS draws are summed in one task, and
    the sums of a cell's blocks are added up, so a cell with many subjects is many tasks."""
    seed = poly_seed(F.lit(salt), *[F.col(c) for c in cell], F.col(subject))
    nulls = pool.groupBy(*cell, subject).agg(F.array_sort(F.collect_list(F.struct(
        F.col(index).cast("bigint").alias("i"), F.col(value).cast("double").alias("v")))).alias("__v")).withColumn("__seed", seed)
    size = nulls.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / SUBJECTS).alias("__k"))
    starts = F.sequence(F.lit(0), F.lit(max(0, n_draws - 1)), F.lit(DRAWS))
    d = nulls.join(size, cell).select(
        *cell, F.pmod(F.xxhash64(subject), F.col("__k")).alias("__b"), F.explode(starts).alias("__first"),
        F.transform("__v", lambda e: e["v"]).alias("v"), F.col("__seed").alias("seed"))
    schema = d.select(*cell).schema.simpleString()[7:-1].replace(":", " ") + ", draw int, total double, n bigint"

    def drawn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[-1])
        x = np.arange(first, min(first + DRAWS, n_draws), dtype=np.int64)
        total, n = np.zeros(len(x)), np.zeros(len(x), dtype=np.int64)
        for values, coefficients in zip(pdf["v"], pdf["seed"]):
            acc = np.full(len(x), coefficients[3], dtype=np.int64)
            for i in (2, 1, 0):
                acc = (acc * x + coefficients[i]) % PRIME
            v = np.array(values, dtype=np.float64)[acc % len(values)]
            total += np.nan_to_num(v)
            n += ~np.isnan(v)
        out = pd.DataFrame({"draw": x.astype(np.int32), "total": total, "n": n})
        for name, k in zip(cell, key):
            out[name] = k
        return out[[*cell, "draw", "total", "n"]]

    sums = d.groupBy(*cell, "__b", "__first").applyInPandas(drawn, schema)
    return sums.groupBy(*cell, "draw").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("null_mean"),
                                           F.sum("n").alias("n_subjects"))


def empirical_p(draws: DataFrame, observed: DataFrame, cell: list[str], value: str) -> DataFrame:
    """(1 + draws at least as large as observed) / (1 + draws), with null mean and SD."""
    j = draws.join(observed.select(*cell, F.col(value).alias("observed")), cell)
    ge = F.count_if(F.col("null_mean") >= F.col("observed"))
    return j.groupBy(*cell).agg(
        F.max("observed").alias("observed"), F.count(F.lit(1)).alias("n_draws"),
        F.avg("null_mean").alias("null_mean"), F.stddev_samp("null_mean").alias("null_sd"),
        ((ge + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def null_thresholds(draws: DataFrame, cell: list[str]) -> DataFrame:
    return exact_quantiles(draws, cell, "null_mean", {"q95": 0.95, "q99": 0.99, "q999": 0.999})


def significance_flags(cells: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """q inside the family and six flags: p and q at 0.05, 0.01 and 0.001."""
    d = bh_qvalues(cells, p, family, "q")
    for col in (p, "q"):
        for name, a in (("05", 0.05), ("01", 0.01), ("001", 0.001)):
            d = d.withColumn(f"{col}_{name}", F.col(col) < a)
    return d


def calibration(cells: DataFrame, chance: float = 0.5) -> DataFrame:
    return cells.agg(F.max(F.abs(F.col("null_mean") - chance)).alias("max_offset"),
                     F.count(F.lit(1)).alias("n_cells"))
