"""Event-locked series, as-of joins and windows over long series.

A series may hold a third of all samples, so no window spans a whole series: rows are cut
into blocks of positions or time. A block window sees its own rows plus the few neighbouring
rows it needs (halo), and values carried across blocks come from one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from voxtrail.functions.stats import sd_pop
from voxtrail.operators.ranks import exact_quantiles, time_index

BLOCK = "__block"


def with_halo(df: DataFrame, keys: list[str], index: str, before: int, after: int,
              size: int) -> tuple[DataFrame, Window]:
    """Copies each row into the blocks whose rows look at it. Returns the rows with ``__own``
    and the window of a block ordered by ``index`` (a gapless position)."""
    lo = F.floor((F.col(index) - after) / size)
    hi = F.floor((F.col(index) + before) / size)
    d = df.withColumn(BLOCK, F.explode(F.sequence(lo, hi))).withColumn(
        "__own", F.floor(F.col(index) / size) == F.col(BLOCK))
    return d, Window.partitionBy(*keys, BLOCK).orderBy(index)


def moving_mean(df: DataFrame, keys: list[str], t: str, value: str, k: int, ties: list[str],
                width: float, out: str = "moving_mean") -> DataFrame:
    """Centred mean of k rows ignoring missing values; an even k looks k/2 back and k/2-1 ahead."""
    before = k // 2
    after = k // 2 - 1 if k % 2 == 0 else k // 2
    d = time_index(df, keys, t, width, ties, "__i")
    d, w = with_halo(d, keys, "__i", before, after, max(8 * k, 4096))
    d = d.withColumn(out, F.avg(value).over(w.rowsBetween(-before, after)))
    return d.filter("__own").drop("__i", BLOCK, "__own")


def extrema(df: DataFrame, keys: list[str], t: str, value: str, ties: list[str], width: float) -> DataFrame:
    """Local maxima and minima of the non-missing values; a plateau counts at its first row and
    the ends do not count."""
    d = time_index(df.filter(F.col(value).isNotNull()), keys, t, width, ties, "__i")
    d, w = with_halo(d, keys, "__i", 1, 0, 4096)
    d = d.withColumn("__p", F.lag(value).over(w)).filter("__own").drop(BLOCK, "__own")
    runs = d.filter(F.col("__p").isNull() | (F.col("__p") != F.col(value))).drop("__i", "__p")
    d = time_index(runs, keys, t, width, ties, "__i")
    d, w = with_halo(d, keys, "__i", 1, 1, 4096)
    prev, nxt = F.lag(value).over(w), F.lead(value).over(w)
    kind = F.when((F.col(value) > prev) & (F.col(value) > nxt), "max").when(
        (F.col(value) < prev) & (F.col(value) < nxt), "min")
    return d.withColumn("kind", kind).filter("__own AND kind IS NOT NULL").drop("__i", BLOCK, "__own")


def surrounding(points: DataFrame, samples: DataFrame, keys: list[str], ident: str, point_t: str,
                t: str, value: str, width: float) -> DataFrame:
    """For each point the last non-missing sample at or before it and the first at or after it:
    ``prev`` and ``next`` as struct(t, v)."""
    s = samples.filter(F.col(value).isNotNull()).select(
        *keys, F.col(t).alias("__t"), F.lit(None).cast(dict(points.dtypes)[ident]).alias(ident),
        F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("__s"))
    p = points.select(*keys, F.col(point_t).alias("__t"), ident,
                      F.lit(None).cast(dict(s.dtypes)["__s"]).alias("__s"))
    d = s.unionByName(p).withColumn(BLOCK, F.floor(F.col("__t") / width))
    summary = d.groupBy(*keys, BLOCK).agg(F.max("__s").alias("__last"), F.min("__s").alias("__first"))
    series = Window.partitionBy(*keys).orderBy(BLOCK)
    summary = summary.select(
        *keys, BLOCK,
        F.last("__last", True).over(series.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.first("__first", True).over(series.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    is_point = F.col(ident).isNotNull()
    blk = Window.partitionBy(*keys, BLOCK)
    fwd = blk.orderBy("__t", is_point).rowsBetween(Window.unboundedPreceding, 0)
    bwd = blk.orderBy(F.desc("__t"), is_point).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select(*keys, BLOCK, ident, "__t", F.last("__s", True).over(fwd).alias("prev"),
                 F.last("__s", True).over(bwd).alias("next")).filter(is_point)
    return d.join(summary, [*keys, BLOCK]).select(
        *keys, ident, F.col("__t").alias(point_t), F.coalesce("prev", "__before").alias("prev"),
        F.coalesce("next", "__after").alias("next"))


def nearest_value(points, samples, keys, ident, point_t, t, value, width) -> DataFrame:
    """Nearest non-missing sample; ties go to the earlier one."""
    d = surrounding(points, samples, keys, ident, point_t, t, value, width)
    left = F.col(point_t) - F.col("prev")["t"]
    right = F.col("next")["t"] - F.col(point_t)
    pick = F.when(F.col("next").isNull() | (left <= right), F.col("prev")).otherwise(F.col("next"))
    return d.withColumn("__n", pick).select(*keys, ident, F.col("__n")["t"].alias("nearest_t"), F.col("__n")["v"].alias("nearest"))


def interpolate(points, samples, keys, ident, point_t, t, value, width) -> DataFrame:
    """Linear interpolation at each point; missing outside the series."""
    d = surrounding(points, samples, keys, ident, point_t, t, value, width)
    t0, v0, t1, v1 = (F.col(c)[f] for c in ("prev", "next") for f in ("t", "v"))
    line = v0 + (v1 - v0) * (F.col(point_t) - t0) / F.nullif(t1 - t0, F.lit(0))
    return d.select(*keys, ident, F.when(t0 == t1, v0).otherwise(line).alias("interpolated"))


def epochs(onsets: DataFrame, samples: DataFrame, keys: list[str], onset: str, t: str, before: int,
           after: int, bucket: int) -> DataFrame:
    """Samples in [onset - before, onset + after): the window is cut into buckets, joined on the
    bucket, then filtered exactly."""
    lo, hi = F.col(onset) - before, F.col(onset) + after
    o = onsets.withColumn("__b", F.explode(F.sequence(F.floor(lo / bucket), F.floor((hi - 1) / bucket))))
    s = samples.withColumn("__b", F.floor(F.col(t) / bucket))
    return o.join(s, [*keys, "__b"]).filter((F.col(t) >= lo) & (F.col(t) < hi)).withColumn(
        "rel", F.col(t) - F.col(onset)).drop("__b")


def align_to_end(onsets: DataFrame, samples: DataFrame, keys: list[str], onset: str, t: str) -> DataFrame:
    """Onsets moved so that the last one falls on the end of the recording."""
    end = samples.groupBy(*keys).agg(F.max(t).alias("__end"))
    last = onsets.groupBy(*keys).agg(F.max(onset).alias("__last"))
    return onsets.join(last, keys).join(end, keys).withColumn(
        "aligned", F.col("__end") - (F.col("__last") - F.col(onset))).drop("__end", "__last")


def time_course(ep: DataFrame, epoch: list[str], condition: list[str], value: str, baseline_end: int,
                step: int) -> DataFrame:
    """Baseline-corrected mean and SEM per condition and time bin. The baseline is the epoch's
    mean before ``baseline_end``; epochs without one are left out. Short epochs add nothing
    where they have no samples."""
    base = ep.filter(F.col("rel") < baseline_end).groupBy(*epoch).agg(F.avg(value).alias("__b"))
    d = ep.join(base.filter("__b IS NOT NULL"), epoch).withColumn("bin", F.floor(F.col("rel") / step))
    v = F.col(value) - F.col("__b")
    return d.groupBy(*condition, "bin").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"),
        F.when(F.count(v) >= 2, F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"))


def epoch_means(onsets, samples, keys, ident, onset, t, value, before, after, bucket, width) -> DataFrame:
    """Mean of each epoch; one without samples takes the nearest non-missing sample."""
    e = epochs(onsets.select(*keys, ident, onset), samples.select(*keys, t, value), keys, onset, t,
               before, after, bucket).groupBy(*keys, ident).agg(F.avg(value).alias("__m"))
    near = nearest_value(onsets, samples, keys, ident, onset, t, value, width)
    return near.join(e, [*keys, ident], "left").select(
        *keys, ident, F.coalesce("__m", "nearest").alias("epoch_mean"), F.col("__m").isNull().alias("fallback"))


# ---- run quality -----------------------------------------------------------------------

def temporal_snr(df: DataFrame, run: str, voxel: str, value: str, eps: float = 1e-8) -> DataFrame:
    """Mean over SD (ddof=1) in time; valid if all samples are finite, mean > 0 and SD > eps."""
    g = df.groupBy(run, voxel).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_finite"),
                                   F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    ok = (F.col("n") == F.col("n_finite")) & (F.col("mean") > 0) & (F.col("sd") > eps)
    return g.withColumn("tsnr", F.when(ok, F.col("mean") / F.col("sd")))


def tsnr_summary(t: DataFrame, run: str) -> DataFrame:
    base = t.groupBy(run).agg(F.count(F.lit(1)).alias("n_voxels"), F.count("tsnr").alias("n_valid"),
                              F.avg("tsnr").alias("mean_tsnr"))
    q = exact_quantiles(t, [run], "tsnr", {"p05": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95})
    return base.join(q, run)


def tsnr_by_voxel(t: DataFrame, voxel: str, n_runs: int) -> DataFrame:
    """Mean over the runs in which the voxel is valid (every run weighs the same) and the share
    of runs that cover it."""
    return t.groupBy(voxel).agg(F.avg("tsnr").alias("mean_tsnr"), F.count("tsnr").alias("n_valid_runs"),
                                (F.count(F.lit(1)) / n_runs).alias("mask_coverage"),
                                (F.count("tsnr") / n_runs).alias("valid_coverage"))


def tsnr_coverage(by_voxel: DataFrame, n_runs: int) -> DataFrame:
    n = F.col("n_valid_runs")
    return by_voxel.agg(F.count(F.lit(1)).alias("any_mask"), F.count_if(n > 0).alias("any_run"),
                        F.count_if(n == n_runs).alias("all_runs"), F.avg("mean_tsnr").alias("equal_run_mean"))


def motion_quality(df: DataFrame, keys: list[str], fd: str, limit: float = 0.5) -> DataFrame:
    v = F.col(fd)
    g = df.groupBy(*keys).agg(
        F.count(v).alias("n_frames"), F.count_if(v > limit).alias("n_high"),
        F.coalesce(F.count_if(v > limit) / F.nullif(F.count(v), F.lit(0)), F.lit(0.0)).alias("fraction_high"),
        F.avg(v).alias("mean_fd"), F.max(v).alias("max_fd"))
    return g.join(exact_quantiles(df, keys, fd, {"median_fd": 0.5}), keys, "left")


def spikes(df: DataFrame, keys: list[str], t: str, fd: str, width: float, limit: float = 0.5) -> DataFrame:
    """One indicator regressor per frame above the limit, numbered in time order."""
    return time_index(df.filter(F.col(fd) > limit), keys, t, width, [], "spike").select(*keys, t, "spike")


def nuisance(df: DataFrame, keys: list[str], t: str, terms: list[str], fd: str, width: float) -> DataFrame:
    """Motion terms z-scored per run without the constant ones, then the spikes; long form."""
    long = df.select(*keys, t, *[F.col(c).cast("double").alias(c) for c in terms]).unpivot(
        [*keys, t], terms, "name", "v")
    st = long.groupBy(*keys, "name").agg(F.avg("v").alias("m"), sd_pop(F.col("v")).alias("s")).filter("s > 0")
    z = long.join(st, [*keys, "name"]).select(*keys, t, "name", ((F.col("v") - F.col("m")) / F.col("s")).alias("value"))
    sp = spikes(df, keys, t, fd, width).select(
        *keys, t, F.concat(F.lit("spike"), F.col("spike").cast("string")).alias("name"), F.lit(1.0).alias("value"))
    return z.unionByName(sp)


def onset_bins(df: DataFrame, keys: list[str], onset: str, start: float, tr: float) -> DataFrame:
    """Frame of every onset (half to even) and whether another onset of the run shares it."""
    d = df.withColumn("frame", F.rint((F.col(onset) - start) / tr).cast("bigint"))
    n = d.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("n_onsets"))
    return d.join(n, [*keys, "frame"]).withColumn("collision", F.col("n_onsets") > 1)
