"""Linear models of many series with one shared design, in blocks of time and units.

Samples are dealt to (time block, chunk of units), the design's rows to its time blocks. A block gives the
normal-equation sums of its units as one product; those of a unit are added over its blocks and solved in
one matrix equation for all units that have every time point. A second pass deals the weights beside the blocks
and yields residuals, or residual sums with the lag-one products. No series is ever one list,
no sample carries a row of the design, and neither side is sent to the driver or broadcast.

A unit that lacks time points takes the rows it lacks off the shared matrix, so every unit is fitted on
its own samples. Samples at times outside the design count nowhere; of repeated samples the last in order of
value counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxtrail.session import cut_lineage

CELLS = 1 << 20         # samples of a block
DESIGN_CELLS = 1 << 23  # values of the design in a block


@dataclass
class Blocks:
    """Dealt samples (unit, t, v, __tb, __ub, __halo) and design rows (t, features, __tb, __halo)."""

    samples: DataFrame
    design: DataFrame
    unit: list[str]
    t: str
    chunks: int
    width: int
    head: str


def dealt(y: DataFrame, design: DataFrame, unit: list[str], t: str, value: str, span: int | None = None, chunks: int | None = None) -> Blocks:
    """``design``: t, features (one array per time point). ``span`` (time units) and ``chunks`` follow from the
    sizes of both tables; each block also gets the time point before it (the halo)."""
    n, p, first, last = design.agg(F.count(F.lit(1)), F.max(F.size("features")), F.min(t), F.max(t)).first()
    p = p or 1
    if span is None:  # as many rows as keep a block of the design small
        span = max(1, int((float(last) - float(first) + 1) * min(1.0, DESIGN_CELLS / max(1, n * p)))) if n else 1
    if chunks is None:
        blocks = max(1.0, (float(last) - float(first) + 1) / span) if n else 1.0
        chunks = int(y.count() / blocks / CELLS) + 1
    home = F.floor(F.col(t) / span).cast("bigint")

    def placed(df: DataFrame) -> DataFrame:
        # the last time point of a block is the halo of the next one
        d = df.withColumn("__e", F.explode(F.array(F.struct(home.alias("tb"), F.lit(False).alias("halo")), F.struct(
            F.when(F.floor((F.col(t) + 1) / span).cast("bigint") != home, home + 1).alias("tb"), F.lit(True).alias("halo")))))
        return d.select(*df.columns, F.col("__e.tb").alias("__tb"), F.col("__e.halo").alias("__halo")).filter("__tb IS NOT NULL")

    v = F.col(value).cast("double")
    samples = placed(y.filter(v.isNotNull() & ~F.isnan(v)).select(*unit, F.col(t).cast("double").alias("__t"), F.col(t), v.alias("__v"))).withColumn(
        "__ub", F.pmod(F.xxhash64(*unit), F.lit(chunks)).cast("int"))
    rows = placed(design.select(F.col(t), F.col(t).cast("double").alias("__t"), "features")).select("__t", "features", "__tb", "__halo")
    return Blocks(samples.select(*unit, "__t", t, "__v", "__tb", "__ub", "__halo"), cut_lineage(rows), unit, t, chunks, p,
                  y.select(*unit).schema.simpleString()[7:-1].replace(":", " "))


def _matrix(left: pd.DataFrame, unit: list[str], at: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """The block's units, and their samples as units x design rows with NaN where there is none."""
    left = left.sort_values("__v", kind="stable")
    row = np.minimum(np.searchsorted(at, left["__t"].to_numpy()), max(0, len(at) - 1))
    left = left[at[row] == left["__t"].to_numpy()] if len(at) else left.iloc[:0]
    number = left.groupby(unit, sort=False, dropna=False).ngroup().to_numpy()
    ids = left[unit].iloc[np.unique(number, return_index=True)[1]].reset_index(drop=True) if len(left) else left[unit]
    m = np.full((len(ids), len(at)), np.nan)
    m[number, np.searchsorted(at, left["__t"].to_numpy())] = left["__v"].to_numpy()
    return ids, m


def _opened(right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    right = right.sort_values("__t")
    return right["__t"].to_numpy(), np.array(right["features"].tolist(), dtype=np.float64)


def _beside(b: Blocks, table: DataFrame) -> DataFrame:
    d = table.withColumn("__ub", F.explode(F.sequence(F.lit(0), F.lit(b.chunks - 1))))
    return d.select(*[F.col(c).alias(c) for c in d.columns])


def _sums(b: Blocks) -> DataFrame:
    """Per unit and time block: samples, X'y, and X'X of the rows it lacks (null if none)."""
    unit = b.unit

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=[*unit, "__ub", "__tb", "n", "xy", "lack"])
        if left.empty or right.empty:
            return empty
        at, x = _opened(right)
        ids, m = _matrix(left, unit, at)
        if not len(ids):
            return empty
        known = ~np.isnan(m)
        out = ids.copy()
        out["__ub"], out["__tb"] = left["__ub"].iloc[0], left["__tb"].iloc[0]
        out["n"], out["xy"] = known.sum(axis=1), list(np.where(known, m, 0.0) @ x)
        out["lack"] = [None if k.all() else (x[~k].T @ x[~k]).ravel() for k in known]
        return out[empty.columns]

    rows = _beside(b, b.design.filter("NOT __halo").drop("__halo"))
    return b.samples.filter("NOT __halo").groupBy("__tb", "__ub").cogroup(rows.groupBy("__tb", "__ub")).applyInPandas(
        run, f"{b.head}, __ub int, __tb bigint, n bigint, xy array<double>, lack array<double>")


def _products(b: Blocks) -> DataFrame:
    """X'X and the number of rows per time block of the design."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, x = _opened(pdf)
        return pd.DataFrame({"__tb": pdf["__tb"].iloc[:1].to_numpy(), "n": [len(x)], "xx": [(x.T @ x).ravel()]})

    return b.design.filter("NOT __halo").groupBy("__tb").applyInPandas(run, "__tb bigint, n bigint, xx array<double>")


def weights(b: Blocks, contrasts: Sequence[Sequence[float]] = ()) -> DataFrame:
    """Per unit: ``beta``, ``df``, and for each of ``contrasts`` the factor ``scale`` of its variance."""
    unit, p = b.unit, b.width
    w = np.array(contrasts, dtype=np.float64).reshape(len(contrasts), p if len(contrasts) else 0)
    columns = [*unit, "__ub", "beta", "df", "scale"]

    def inverted(xx: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        val, vec = np.linalg.eigh(xx)
        keep = val > max(val[-1], 0.0) * p * np.finfo(float).eps
        inv = (vec[:, keep] / val[keep]) @ vec[:, keep].T
        return inv, int(keep.sum()), np.einsum("ki,ij,kj->k", w, inv, w) if len(w) else np.empty(0)

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=columns)
        xx = {tb: np.reshape(v, (p, p)) for tb, v in zip(right["__tb"], right["xx"])}
        total, every = sum(xx.values()), set(xx)
        shared = inverted(total)
        number = left.groupby(unit, sort=False, dropna=False).ngroup().to_numpy()
        ids = left[unit].iloc[np.unique(number, return_index=True)[1]].reset_index(drop=True)
        xy = np.zeros((len(ids), p))
        np.add.at(xy, number, np.stack(left["xy"].to_numpy()))
        n = np.bincount(number, weights=left["n"].to_numpy()).astype(np.int64)
        beta, df, scale = xy @ shared[0], n - shared[1], [shared[2]] * len(ids)
        seen = np.bincount(number, minlength=len(ids))
        lacks = np.bincount(number, weights=left["lack"].notna().to_numpy(), minlength=len(ids)) > 0
        for i in np.flatnonzero(lacks | (seen < len(every))).tolist():
            own = left[number == i]
            mine = sum((xx[tb] for tb in own["__tb"]), np.zeros((p, p))) - sum((np.reshape(v, (p, p)) for v in own["lack"] if v is not None), np.zeros((p, p)))
            inv, rank, scale[i] = inverted(mine)
            beta[i], df[i] = inv @ xy[i], n[i] - rank
        out = ids.copy()
        out["__ub"], out["beta"], out["df"], out["scale"] = left["__ub"].iloc[0], list(beta), df.astype(np.int32), list(scale)
        return out[columns]

    return _sums(b).groupBy("__ub").cogroup(_beside(b, _products(b)).groupBy("__ub")).applyInPandas(
        solve, f"{b.head}, __ub int, beta array<double>, df int, scale array<double>")


def _second_pass(b: Blocks, fitted: DataFrame, work, more: str) -> DataFrame:
    """``work(units, their betas, times, residuals, halo)`` per block; residuals are NaN where there is no sample."""
    unit = b.unit
    columns = [*unit, *[p.split()[0] for p in more.split(", ")]]
    design = _beside(b, b.design.withColumn("beta", F.lit(None).cast("array<double>")))
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=columns)
        rows = right[right["features"].notna()]
        if left.empty or rows.empty:
            return empty
        at, x = _opened(rows)
        halo = rows.sort_values("__t")["__halo"].to_numpy()
        ids, m = _matrix(left, unit, at)
        if not len(ids):
            return empty
        own = ids.merge(right[right["beta"].notna()][[*unit, "beta"]], on=unit, how="left")
        found = work(ids, at, m - np.stack(own["beta"].to_numpy()) @ x.T, halo)
        return found[columns] if len(found) else empty

    places = b.samples.select(*unit, "__ub", "__tb").distinct()
    near = places.join(fitted.select(*unit, "beta"), unit).select(*unit, "__ub", "__tb", "beta", F.lit(None).cast("array<double>").alias("features"),
                                                                 F.lit(None).cast("double").alias("__t"), F.lit(None).cast("boolean").alias("__halo"))
    both = design.select(*[F.lit(None).cast(dict(fitted.dtypes)[c]).alias(c) for c in unit], "__ub", "__tb", "beta", "features", "__t", "__halo").unionByName(near)
    both = both.select(*[F.col(c).alias(c) for c in both.columns])
    return b.samples.groupBy("__tb", "__ub").cogroup(both.groupBy("__tb", "__ub")).applyInPandas(run, f"{b.head}, {more}")


def residuals(b: Blocks, fitted: DataFrame) -> DataFrame:
    """unit, t, residual: one row per sample inside the design."""
    unit, kind = b.unit, dict(b.samples.dtypes)[b.t]

    def work(ids, at, e, halo):
        u, r = np.nonzero(~np.isnan(e) & ~halo[None, :])
        out = ids.iloc[u].reset_index(drop=True)
        out["__t"], out["residual"] = at[r], e[u, r]
        return out

    return _second_pass(b, fitted, work, "__t double, residual double").select(*unit, F.col("__t").cast(kind).alias(b.t), "residual")


def fit(b: Blocks, contrasts: Sequence[Sequence[float]] = ()) -> DataFrame:
    """Per unit: ``beta``, residual variance ``sigma2``, ``df``, ``scale``, and ``rho``, the lag-one autocorrelation of
    the residuals over pairs of whole-numbered neighbours in time."""
    unit = b.unit
    fitted = cut_lineage(weights(b, contrasts))

    def work(ids, at, e, halo):
        now, before = e[:, 1:], e[:, :-1]
        pair = ~np.isnan(now) & ~np.isnan(before) & ~halo[None, 1:] & (np.diff(at) == 1)[None, :]
        out = ids.copy()
        own = np.where(np.isnan(e) | halo[None, :], 0.0, e)
        out["rss"] = (own * own).sum(axis=1)
        out["cross"] = np.where(pair, now * before, 0.0).sum(axis=1)
        out["square"] = np.where(pair, before * before, 0.0).sum(axis=1)
        return out

    sums = _second_pass(b, fitted, work, "rss double, cross double, square double").groupBy(*unit).agg(
        *[F.sum(c).alias(c) for c in ("rss", "cross", "square")])
    return fitted.drop("__ub").join(sums, unit).select(
        *unit, "beta", F.when(F.col("df") > 0, F.col("rss") / F.col("df")).alias("sigma2"), "df", "scale",
        F.when(F.col("square") > 1e-8, F.col("cross") / F.col("square")).alias("rho"))
