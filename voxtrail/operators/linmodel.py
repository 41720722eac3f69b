"""Linear models with a shared design, autocorrelation, and noise whitening."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxtrail.functions import arrays as A
from voxtrail.operators.ranks import exact_quantiles
from voxtrail.operators.similarity import gram
from voxtrail.session import cut_lineage

def incomplete_units(y: DataFrame, design: DataFrame, unit: list[str], t: str, value: str) -> DataFrame:
    """Units that lack a value at some time point of the design."""
    n_design = design.agg(F.count_distinct(t)).first()[0]
    g = y.filter(F.col(value).isNotNull()).groupBy(*unit).agg(F.count_distinct(t).alias("n"))
    return g.filter(F.col("n") != n_design)


def contrast(fitted: DataFrame, unit: list[str], weights: list[float], k: int = 0) -> DataFrame:
    """Effect, standard error and t of the weighted sum of betas that was ``contrasts[k]`` of the fit."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    effect = A.dot(w, F.col("beta"))
    var = F.col("sigma2") * F.get("scale", F.lit(k))
    return fitted.select(*unit, effect.alias("effect"), F.sqrt(var).alias("se"),
                         F.when(var > 0, effect / F.sqrt(var)).alias("t"), "df")


def lagged(df: DataFrame, unit: list[str], t: str, value: str) -> DataFrame:
    """Value at t - 1 next to the value at t (whole-numbered t), by an equi-join."""
    prev = df.select(*unit, (F.col(t) + 1).alias(t), F.col(value).alias("__prev"))
    return df.join(prev, [*unit, t], "left")


def pooled_ar1(rho: DataFrame, limit: float = 0.9) -> float:
    """Median over units, clipped."""
    m = exact_quantiles(rho, [], "rho", {"rho": 0.5}).first()["rho"]
    return max(-limit, min(limit, m))


def prais_winsten(y: DataFrame, rho: float, unit: list[str], t: str, value: str) -> DataFrame:
    """y_t - rho * y_(t-1); the first row, and one after a gap, is scaled by sqrt(1 - rho^2)."""
    d = lagged(y, unit, t, value)
    r, v = F.lit(rho), F.col(value)
    return d.select(*unit, t, F.when(F.col("__prev").isNull(), v * F.sqrt(1 - r * r))
                    .otherwise(v - r * F.col("__prev")).alias("whitened"))


def prais_winsten_design(design: DataFrame, rho: float, t: str) -> DataFrame:
    """The same for the rows of the design."""
    prev = design.select((F.col(t) + 1).alias(t), F.col("features").alias("__prev"))
    d = design.join(prev, t, "left")
    r = F.lit(rho)
    return d.select(t, F.when(F.col("__prev").isNull(), F.transform("features", lambda x: x * F.sqrt(1 - r * r)))
                    .otherwise(F.zip_with("features", "__prev", lambda x, p: x - r * p)).alias("features"))


MAX_WIDTH = 8192  # 512 MB a matrix


# ---- noise covariance ------------------------------------------------------------------

def demeaned(df: DataFrame, keys: list[str], condition: str) -> DataFrame:
    """Patterns minus the mean pattern of their condition."""
    m = df.select(*keys, condition, F.posexplode("features").alias("pos", "x")).groupBy(*keys, condition, "pos").agg(
        F.avg("x").alias("m"))
    m = m.groupBy(*keys, condition).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("__mean"))
    return df.join(m, [*keys, condition]).withColumn(
        "features", F.zip_with("features", "__mean", lambda x, y: x - y)).drop("__mean")


def shrunk_covariance(df: DataFrame, keys: list[str], condition: str) -> DataFrame:
    """Residual covariance shrunk toward a scaled identity (Ledoit and Wolf 2004), long form.

    Needs the products x_i x_j and per trial the squared length only: the expected squared
    error of the covariance is a sum of fourth powers of lengths."""
    r = demeaned(df, keys, condition)
    q = A.sum_squares(F.col("features"))
    st = r.select(*keys, F.size("features").alias("p"), q.alias("q")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("p").alias("p"), F.sum("q").alias("trace"),
        F.sum(F.col("q") * F.col("q")).alias("fourth"))
    g = gram(r, keys, "features", "features")
    ss = g.groupBy(*keys).agg(F.sum(F.col("v") * F.col("v")).alias("ss"))
    n, p = F.col("n"), F.col("p")
    mu = F.col("trace") / n / p
    delta_ = F.col("ss") / (n * n)
    beta = (F.col("fourth") / n - delta_) / (p * n)
    delta = (delta_ - 2 * mu * F.col("trace") / n + p * mu * mu) / p
    st = st.join(ss, keys).select(*keys, "n", mu.alias("mu"), F.when(delta > 0, F.greatest(
        F.lit(0.0), F.least(beta, delta) / delta)).otherwise(0.0).alias("shrinkage"))
    return g.join(st, keys).select(*keys, "i", "j", "shrinkage", (
        (1 - F.col("shrinkage")) * F.col("v") / F.col("n")
        + F.when(F.col("i") == F.col("j"), F.col("shrinkage") * F.col("mu")).otherwise(0.0)).alias("cov"))


def inverse_root(cov: DataFrame, keys: list[str], floor: float = 1e-8) -> DataFrame:
    """Symmetric inverse square root of each covariance, one row per matrix row. A group is one
    p x p matrix; a region of more than MAX_WIDTH features fails loudly."""
    schema = cov.select(*keys).schema.simpleString()[7:-1].replace(":", " ") + ", i int, row array<double>"

    def root(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = int(pdf["i"].max()) + 1
        if p > MAX_WIDTH:
            raise ValueError(f"a covariance of {p} features, at most {MAX_WIDTH}")
        m = np.zeros((p, p))
        m[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["cov"].to_numpy()
        val, vec = np.linalg.eigh(m)
        w = (vec * np.clip(val, floor, None) ** -0.5) @ vec.T
        out = pd.DataFrame({"i": np.arange(p, dtype="int32"), "row": list(w)})
        for k, v in zip(keys, key):
            out[k] = v
        return out[[*keys, "i", "row"]]
    return cov.groupBy(*keys).applyInPandas(root, schema)


def whiten(df: DataFrame, roots: DataFrame, keys: list[str], trial: str, keep: list[str],
           rows_per_block: int = 4096) -> DataFrame:
    """Patterns times the inverse root. Trials of a key are cut into hash blocks that meet a copy
    of its matrix, so a heavy key becomes many bounded NumPy products. The number of blocks
    follows from the largest key (one counted number)."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    blocks = -(-largest // rows_per_block)
    d = df.select(*keys, trial, *keep, "features", F.pmod(F.hash(trial), F.lit(blocks)).alias("__b"))
    m = roots.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    out_cols = [*keys, trial, *keep, "features"]
    schema = df.select(*out_cols).schema

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left.iloc[:0][out_cols]
        w = np.stack(right.sort_values("i")["row"].to_numpy())
        left = left.copy()
        left["features"] = list(np.stack(left["features"].to_numpy()) @ w)
        return left[out_cols]
    return d.groupBy(*keys, "__b").cogroup(m.groupBy(*keys, "__b")).applyInPandas(product, schema)


# ---- whitening by trials ---------------------------------------------------------------

MOST_TRIALS = 4096  # of a key: matrices of trials x trials meet in one task
TILE = 2048         # features of a task


def root_factors(k: np.ndarray, width: int, floor: float = 1e-8) -> tuple[float, np.ndarray, float]:
    """Inverse root of the shrunk covariance of residual rows R, from K = R R' alone.

    The covariance is a scaled identity plus R'R, so its inverse root is ``scale`` I + R' M R with M as wide as the
    trials. Trace, squared norm and the fourth powers that the shrinkage needs are in K too.
    Returns scale, M and the shrinkage."""
    n, trace = len(k), float(np.trace(k))
    mu, norm = trace / n / width, float((k * k).sum()) / (n * n)
    beta = (float((np.diag(k) ** 2).sum()) / n - norm) / (width * n)
    delta = (norm - 2 * mu * trace / n + width * mu * mu) / width
    shrinkage = max(0.0, min(beta, delta) / delta) if delta > 0 else 0.0
    val, vec = np.linalg.eigh(k)
    val = np.maximum(val, 0.0)
    rest = max(shrinkage * mu, floor)                     # where no residual reaches
    own = np.maximum(shrinkage * mu + (1 - shrinkage) / n * val, floor)
    rise = np.where(own > rest, own - rest, 0.0)
    known = val > 1e-12 * max(val[-1], 1e-300)
    inner = np.where(known, -rise / np.where(known, val, 1.0) / (np.sqrt(own * rest) * (np.sqrt(own) + np.sqrt(rest))), 0.0)
    return rest ** -0.5, (vec * inner) @ vec.T, shrinkage


def residual_rows(x: np.ndarray, condition: np.ndarray) -> np.ndarray:
    """Rows minus the mean of their condition."""
    _, of = np.unique(condition, return_inverse=True)
    ind = np.eye(of.max() + 1)[of] if len(of) else np.zeros((0, 0))
    return x - ind @ ((ind.T @ x) / np.maximum(ind.sum(axis=0), 1)[:, None])


def whitened(df: DataFrame, keys: list[str], condition: str, trial: str, keep: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Patterns times the inverse root of their key's shrunk residual covariance, for any number of features.

    No matrix of features x features is made. Features are cut into tiles; each tile gives its share of R R'
    and X R' (trials x trials), the sums of a key give B = X R' M, and each tile's patterns become
    scale X + B R. A key of more than MOST_TRIALS trials goes by its covariance (``inverse_root``)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    many = cut_lineage(sizes.filter(F.col("n") > MOST_TRIALS).select(*keys))
    if many.take(1):
        few, big = df.join(many, keys, "left_anti"), df.join(many, keys, "left_semi")
        roots = inverse_root(shrunk_covariance(big, keys, condition), keys)
        return _by_tiles(few, keys, condition, trial, keep, tile).unionByName(whiten(big, roots, keys, trial, list(keep)))
    return _by_tiles(df, keys, condition, trial, keep, tile)


def _by_tiles(df: DataFrame, keys: list[str], condition: str, trial: str, keep: Sequence[str], tile: int) -> DataFrame:
    width = F.size("features")
    parts = F.transform(F.sequence(F.lit(0), F.floor((width - 1) / tile)), lambda i: F.struct(
        i.cast("int").alias("__tile"), F.slice("features", (i * tile + 1).cast("int"), F.lit(tile)).alias("x")))
    tiles = cut_lineage(df.select(*keys, trial, condition, width.alias("__p"), F.explode(parts).alias("__t"))
                        .select(*keys, trial, condition, "__p", "__t.__tile", F.col("__t.x").alias("features")))
    head = tiles.select(*keys).schema.simpleString()[7:-1].replace(":", " ")

    def opened(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values(trial, kind="stable")
        x = np.array(pdf["features"].tolist(), dtype=np.float64)
        return pdf, x, residual_rows(x, pdf[condition].to_numpy())

    def with_keys(key: tuple, out: pd.DataFrame) -> pd.DataFrame:
        for c, v in zip(keys, key):
            out[c] = v
        return out

    def share(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, r = opened(pdf)
        out = pd.DataFrame({"__row": np.arange(len(x), dtype=np.int32), "__k": list(r @ r.T), "__xr": list(x @ r.T), "__p": int(pdf["__p"].iloc[0])})
        return with_keys(key, out)[[*keys, "__row", "__k", "__xr", "__p"]]

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"__row": [key[-1]], "__p": pdf["__p"].iloc[:1].to_numpy(), "__k": [np.sum(pdf["__k"].to_numpy())], "__xr": [np.sum(pdf["__xr"].to_numpy())]})
        return with_keys(key, out)[[*keys, "__row", "__k", "__xr", "__p"]]

    def mix(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__row")
        scale, inner, _ = root_factors(np.stack(pdf["__k"].to_numpy()), int(pdf["__p"].iloc[0]))
        out = pd.DataFrame({"__row": pdf["__row"].to_numpy(), "__b": list(np.stack(pdf["__xr"].to_numpy()) @ inner), "__scale": scale})
        return with_keys(key, out)[[*keys, "__row", "__b", "__scale"]]

    sums = f"{head}, __row int, __k array<double>, __xr array<double>, __p int"
    shares = tiles.groupBy(*keys, "__tile").applyInPandas(share, sums)
    mixed = cut_lineage(shares.groupBy(*keys, "__row").applyInPandas(add, sums).groupBy(*keys).applyInPandas(
        mix, f"{head}, __row int, __b array<double>, __scale double"))
    beside = mixed.join(tiles.select(*keys, "__tile").distinct(), keys)
    beside = beside.select(*[F.col(c).alias(c) for c in beside.columns])

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left.iloc[:0][[*keys, trial, "__tile", "features"]]
        pdf, x, r = opened(left)
        right = right.sort_values("__row")
        pdf = pdf.copy()
        pdf["features"] = list(right["__scale"].iloc[0] * x + np.stack(right["__b"].to_numpy()) @ r)
        return pdf[[*keys, trial, "__tile", "features"]]

    out = tiles.groupBy(*keys, "__tile").cogroup(beside.groupBy(*keys, "__tile")).applyInPandas(
        product, tiles.select(*keys, trial, "__tile", "features").schema)
    whole = out.groupBy(*keys, trial).agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("__tile", "features"))), lambda e: e["features"])).alias("features"))
    return whole.join(df.select(*keys, trial, *keep), [*keys, trial]) if keep else whole
