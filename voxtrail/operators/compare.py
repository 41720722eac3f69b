"""Relational comparisons: lookups, side-by-side tables, set algebra on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def lookup(df: DataFrame, dim: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with the dimension's columns, and the rows whose key it does not know.

    Whether the dimension is broadcast is left to its measured size."""
    return df.join(dim, on, "inner"), df.join(dim.select(*on), on, "left_anti")


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str], value: str,
                 names: tuple[str, str], tolerance: float) -> DataFrame:
    """One-to-one comparison of a value on shared cells; a repeated cell is flagged."""
    def one(df, name):
        return df.groupBy(*keys).agg(F.first(value, True).alias(f"{value}_{name}"),
                                     F.count(F.lit(1)).alias(f"__n_{name}"))
    a, b = names
    j = one(left, a).join(one(right, b), keys)
    d = F.col(f"{value}_{b}") - F.col(f"{value}_{a}")
    return j.select(*keys, f"{value}_{a}", f"{value}_{b}", d.alias("delta"),
                    (F.abs(d) <= tolerance).alias("within_tolerance"),
                    ((F.col(f"__n_{a}") == 1) & (F.col(f"__n_{b}") == 1)).alias("one_to_one"))


def agreement(left: DataFrame, right: DataFrame, keys: list[str], value: str, flag: str,
              by: list[str]) -> DataFrame:
    """How two levels agree on significance, and the mean absolute change of the value."""
    j = (left.select(*keys, F.col(value).alias("a"), F.col(flag).alias("fa"))
         .join(right.select(*keys, F.col(value).alias("b"), F.col(flag).alias("fb")), keys))
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("fa") == F.col("fb")).alias("n_agree"),
        F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_delta"),
        F.count_if(F.col("fa") & ~F.col("fb")).alias("only_a"),
        F.count_if(~F.col("fa") & F.col("fb")).alias("only_b"),
        F.count_if(F.col("fa") & F.col("fb")).alias("both"))


def in_both(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the other side knows too."""
    return df.join(other.select(*keys), keys, "left_semi")


def key_difference(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    e, o = expected.select(*keys), observed.select(*keys)
    return (e.subtract(o).withColumn("side", F.lit("missing"))
            .unionByName(o.subtract(e).withColumn("side", F.lit("unexpected"))))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Drops copies, keeping the first by ``order``: an aggregate, not a sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return g.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.select(*keys), keys, "left_anti")


def merge_trees(within: DataFrame, cross: DataFrame, kind: str, unit: str, expected: int) -> DataFrame:
    """Within rows from one result tree and cross rows from the other, with a count gate."""
    m = within.filter(F.col(kind) == "within").unionByName(cross.filter(F.col(kind) == "cross"))
    n = m.groupBy(unit).agg(F.count(F.lit(1)).alias("n_rows"))
    return m.join(n, unit).withColumn("complete", F.col("n_rows") == expected)
