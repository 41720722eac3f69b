"""Order statistics that stay distributed when one group holds most rows.

A plain ``row_number`` or exact ``percentile`` sends a whole group to one task.
Here a group is cut into ordered buckets by a deterministic, monotone function of
the order key. Buckets are counted (partial aggregation), the few counts per group
are summed up in order, and only the rows of one bucket meet in one task. Results
are exact whatever the buckets hold.

The values are read by two branches of a plan (count, then rank). A value that is
itself a floating-point aggregate may differ in its last bit when a branch is
computed again, so such inputs are checkpointed first (``settled=False``). Columns
that come straight from files, and hashes, need no checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtrail.functions.hashing import hash32
from voxtrail.session import cut_lineage

B = "__bucket"


def hash_splits(df: DataFrame) -> int:
    """Buckets of a hashed order: four for every shuffle partition the session is set up for."""
    return max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def value_bucket(x: Column, lo: Column, hi: Column) -> Column:
    """Monotone in x: a linear cell between lo and hi, refined by a signed log cell."""
    linear = F.when(hi > lo, F.floor((x - lo) / (hi - lo) * 1023)).otherwise(F.lit(0))
    log = F.when(x == 0, F.lit(0)).otherwise(
        F.signum(x).cast("bigint") * (F.floor(F.log2(F.abs(x)) * 16) + 20000))
    return F.struct(linear.cast("bigint").alias("a"), log.cast("bigint").alias("b"))


def _key(keys):
    return list(keys) if keys else [F.lit(0)]


def with_bucket_offsets(df: DataFrame, keys: list[str], count: Column) -> DataFrame:
    """Rows of the group in earlier buckets (``__before``) and in all (``__n``).

    ``df`` already has a ``__bucket`` column."""
    per = df.groupBy(*keys, B).agg(count.alias("__c"))
    group = Window.partitionBy(*_key(keys))
    off = per.select(
        *keys, B,
        F.coalesce(F.sum("__c").over(
            group.orderBy(B).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__c").over(group).alias("__n"))
    return df.join(off, [*keys, B])


def bucketed_row_number(df: DataFrame, keys: list[str], bucket: Column, order: list,
                        out: str, total: str | None = None) -> DataFrame:
    """1-based row number in each group; ``bucket`` must be monotone in ``order``."""
    d = with_bucket_offsets(df.withColumn(B, bucket), keys, F.count(F.lit(1)))
    w = Window.partitionBy(*keys, B).orderBy(*order)
    d = d.withColumn(out, F.row_number().over(w) + F.col("__before"))
    if total:
        d = d.withColumnRenamed("__n", total)
    return d.drop(B, "__before", *([] if total else ["__n"]))


def hash_row_number(df: DataFrame, keys: list[str], salt: list, ids: list[str], out: str,
                    total: str | None = None) -> DataFrame:
    """Row number by hash(salt, ids), ties by ids: a repeatable random order."""
    d = df.withColumn("__h", hash32(*salt, *[F.col(c) for c in ids]))
    d = bucketed_row_number(d, keys, F.floor(F.col("__h") * hash_splits(df) / 2 ** 32),
                            ["__h", *ids], out, total)
    return d.drop("__h")


def value_row_number(df: DataFrame, keys: list[str], value: str, ties: list[str], out: str,
                     descending: bool = False, total: str | None = None,
                     span: tuple[float, float] | None = None, settled: bool = False) -> DataFrame:
    """Row number by value, ties by ``ties`` ascending; rows without a value are left out."""
    sign = -1.0 if descending else 1.0
    df = df if settled else cut_lineage(df)
    d = df.filter(F.col(value).isNotNull()).withColumn("__v", F.col(value) * sign)
    d = _with_span(d, keys, "__v", tuple(sorted(sign * s for s in span)) if span else None)
    d = bucketed_row_number(d, keys, value_bucket(F.col("__v"), F.col("__lo"), F.col("__hi")),
                            ["__v", *ties], out, total)
    return d.drop("__v", "__lo", "__hi")


def time_index(df: DataFrame, keys: list[str], t: str, width: float, ties: list[str],
               out: str, total: str | None = None) -> DataFrame:
    """Position in the series; ``width`` is the length of a time bucket."""
    return bucketed_row_number(df, keys, F.floor(F.col(t) / width), [t, *ties], out, total)


def _with_span(df, keys, value, span):
    if span:
        return df.withColumn("__lo", F.lit(span[0])).withColumn("__hi", F.lit(span[1]))
    ends = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    if keys:
        return df.join(ends, keys)
    lo, hi = ends.first()  # two numbers
    return df.withColumn("__lo", F.lit(lo)).withColumn("__hi", F.lit(hi))


def distinct_ranks(df: DataFrame, keys: list[str], value: str,
                   span: tuple[float, float] | None = None, settled: bool = False) -> DataFrame:
    """One row per group and distinct value: ``__cnt``, ``__below`` (smaller rows), ``__n``.

    Copies collapse before the first shuffle, so tied values cost nothing."""
    d = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
         .agg(F.count(F.lit(1)).alias("__cnt")))
    d = d if settled else cut_lineage(d)
    d = _with_span(d, keys, value, span)
    d = d.withColumn(B, value_bucket(F.col(value), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    d = with_bucket_offsets(d, keys, F.sum("__cnt"))
    w = Window.partitionBy(*keys, B).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return d.select(*keys, value, B, "__cnt", "__n",
                    (F.col("__before") + F.coalesce(F.sum("__cnt").over(w), F.lit(0))).alias("__below"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str,
                    probs: dict[str, float], settled: bool = False) -> DataFrame:
    """Linear-interpolation quantiles per group, from ranks instead of one sorted list."""
    d = distinct_ranks(df, keys, value, settled=settled)
    aggs, outs = [], []
    for i, (name, q) in enumerate(probs.items()):
        h = (F.col("__n") - 1) * F.lit(float(q))
        for side, pos in (("l", F.floor(h)), ("u", F.ceil(h))):
            hit = (F.col("__below") <= pos) & (pos < F.col("__below") + F.col("__cnt"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"__{side}{i}"))
        hh = (F.col("__tot") - 1) * F.lit(float(q))
        lo, up = F.col(f"__l{i}"), F.col(f"__u{i}")
        outs.append((lo + (hh - F.floor(hh)) * (up - lo)).alias(name))
    return d.groupBy(*keys).agg(F.max("__n").alias("__tot"), *aggs).select(*keys, *outs)


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds the 1-based rank, ties sharing their mean rank. The values must be settled."""
    r = distinct_ranks(df, keys, value, settled=True).select(
        *keys, value, (F.col("__below") + (F.col("__cnt") + 1) / 2).alias(out))
    return df.join(r, [*keys, value])


def bh_qvalues(df: DataFrame, p: str, family: list[str], out: str) -> DataFrame:
    """Benjamini-Hochberg q-values inside each family; a missing p keeps a missing q.

    q depends on p alone, so it is computed once per distinct p: p * n / (largest rank),
    then the smallest such value among all p at least as large (inside the bucket by a
    window, over later buckets by their minima)."""
    df = cut_lineage(df)
    r = distinct_ranks(df, family, p, span=(0.0, 1.0), settled=True).withColumn(
        "__q", F.col(p) * F.col("__n") / (F.col("__below") + F.col("__cnt")))
    later = Window.partitionBy(*_key(family)).orderBy(B).rowsBetween(1, Window.unboundedFollowing)
    ends = r.groupBy(*family, B).agg(F.min("__q").alias("__m")).select(
        *family, B, F.min("__m").over(later).alias("__later"))
    inside = Window.partitionBy(*family, B).orderBy(p).rowsBetween(0, Window.unboundedFollowing)
    q = r.join(ends, [*family, B]).select(
        *family, p, F.least(F.lit(1.0), F.min("__q").over(inside), F.col("__later")).alias(out))
    return df.join(q, [*family, p], "left")
