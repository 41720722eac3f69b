"""Cross-validated decoding of single trials where their patterns lie.

A unit (subject, region, variant ...) brings its patterns once, as arrays, and the short label lists of all its
contrasts beside them. Contrast, fold and class are rows of an indicator; its product with the
pattern matrix gives counts, means and squared deviations of every (contrast, fold, class), those of all other
folds follow by subtraction, and weights of all folds score the test rows in one product. Nothing is copied
per contrast or fold, and no join has a model or a voxel as its key.

A unit above BLOCK bytes is cut into blocks of trials: their statistics are merged per contrast,
the packed weights (one array per contrast) go back beside the blocks, and hits are added up.

Missing features count nowhere: statistics are per voxel, and a score sums the voxels that are there."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxtrail.session import cut_lineage

BLOCK = 1 << 24   # bytes of patterns
COLUMNS = ["t", "y", "fold", "is_train", "is_test"]
COUNTS = ["n_correct", "n_scored", "n_test"]


# ---- label lists beside pattern blocks -------------------------------------------------

@dataclass
class Units:
    """Pattern rows dealt to blocks of units, and the label lists of each block's cells."""

    rows: DataFrame      # unit, __b, t, features
    beside: DataFrame    # unit, __b, __k, names, one list per label column
    unit: list[str]
    names: list[str]
    types: dict[str, str]
    cut: bool            # some unit has more than one block

    @property
    def cell(self) -> list[str]:
        return [*self.unit, *self.names]

    def schema(self, *more: str) -> str:
        return ", ".join([f"`{c}` {self.types[c]}" for c in self.cell] + list(more))

    def run(self, work: Callable[[pd.DataFrame, dict], pd.DataFrame | None], schema: str, beside: DataFrame | None = None) -> DataFrame:
        """``work(patterns, cell)`` for every block and cell; its rows get the cell's keys."""
        cell, names = self.cell, [p.split()[0].strip("`") for p in schema.split(", ")]

        def each(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            for r in right.to_dict("records") if len(left) else []:
                found = work(left, r)
                if found is not None and len(found):
                    for c in cell:
                        found[c] = r[c]
                    out.append(found.reindex(columns=names))
            return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

        keys = [*self.unit, "__b"]
        right = self.beside if beside is None else beside
        return self.rows.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(each, schema)


def units(labels: DataFrame, patterns: DataFrame, shared: list[str], names: list[str], unit: list[str] | None = None,
          trial: str = "vec_id", block: int = BLOCK, most: int = 1 << 20, carry: tuple[str, ...] = ()) -> Units:
    """Blocks of at most about ``block`` bytes and ``most`` trials; ``carry``: further columns of the patterns.

    ``labels``: shared keys, names, trial (whole number), y, fold, is_train, is_test.
    ``patterns``: the unit's keys (``shared`` among them), trial, features."""
    unit = unit or [*shared, "roi"]
    kinds = {"t": "bigint", "y": "tinyint", "fold": "bigint", "is_train": "boolean", "is_test": "boolean"}
    cells = labels.groupBy(*shared, *names).agg(F.array_sort(F.collect_list(F.struct(
        *[F.col(trial if c == "t" else c).cast(kinds[c]).alias(c) for c in COLUMNS]))).alias("__l")).select(
        *shared, *names, *[F.col(f"__l.{c}").alias(c) for c in COLUMNS])
    size = cut_lineage(patterns.groupBy(*unit).agg(F.greatest(
        F.ceil(F.sum(F.size("features") * F.lit(8.0)) / block), F.ceil(F.count(F.lit(1)) / most)).cast("int").alias("__k")))
    rows = patterns.join(size, unit).select(*unit, F.pmod(F.xxhash64(trial), F.col("__k")).cast("int").alias("__b"),
                                            F.col(trial).cast("bigint").alias("t"), "features", *carry)
    beside = size.join(cells, shared).withColumn("__b", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    beside = beside.select(*[F.col(c).alias(c) for c in beside.columns])  # columns of its own: both sides stem from the patterns
    types = dict(patterns.dtypes) | dict(labels.dtypes)
    return Units(rows, beside, unit, names, types, bool(size.filter("__k > 1").take(1)))


@dataclass
class Cell:
    """The rows of a contrast in a block: matrices with 0 for missing values, and their labels."""

    x: np.ndarray        # centred about ``centre``
    there: np.ndarray    # 1 where a value is there
    centre: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    is_train: np.ndarray
    is_test: np.ndarray
    folds: np.ndarray    # of test rows, over the whole cell
    every: np.ndarray    # of all rows, over the whole cell
    rows: np.ndarray     # places among the block's patterns


def opened(left: pd.DataFrame, r: dict) -> Cell:
    """The cell's rows in this block; label lists may name trials of other blocks."""
    raw = getattr(left, "_matrix", None)
    if raw is None:
        x = np.array(left["features"].tolist(), dtype=np.float64)
        there = np.isfinite(x)
        centre = np.where(there, x, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
        raw = (np.where(there, x - centre, 0.0), there.astype(np.float64), centre, np.argsort(left["t"].to_numpy()))
        object.__setattr__(left, "_matrix", raw)  # once for all contrasts of the unit
    x, there, centre, order = raw
    own = left["t"].to_numpy()[order]
    t, y, fold = (np.asarray(r[c], dtype=np.int64) for c in ("t", "y", "fold"))
    is_train, is_test = (np.asarray(r[c], dtype=bool) for c in ("is_train", "is_test"))
    at = np.minimum(np.searchsorted(own, t), len(own) - 1)
    here = own[at] == t
    rows = order[at[here]]
    return Cell(x[rows], there[rows], centre, y[here], fold[here], is_train[here], is_test[here],
                np.unique(fold[is_test]), np.unique(fold), rows)


# ---- statistics and weights ------------------------------------------------------------

def statistics(c: Cell) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and squared deviations of the training rows per (fold, class, voxel)."""
    k = 2 * np.searchsorted(c.every, c.fold) + c.y
    ind = ((k[None, :] == np.arange(2 * len(c.every))[:, None]) & c.is_train[None, :]).astype(np.float64)
    n, s, q = ind @ c.there, ind @ c.x, ind @ (c.x * c.x)
    mean = s / np.maximum(n, 1)
    shape = (len(c.every), 2, -1)
    return n.reshape(shape), (mean + c.centre).reshape(shape), np.maximum(0.0, q - n * mean * mean).reshape(shape)


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics of blocks as those of all their rows."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / np.maximum(n, 1)
    return n, mean, sum(p[2] + p[0] * (p[1] - mean) ** 2 for p in parts)


def outside(every: np.ndarray, folds: np.ndarray, n: np.ndarray, mean: np.ndarray, q: np.ndarray):
    """Statistics of all rows outside each of ``folds``, per class and voxel."""
    total = n.sum(axis=0)
    centre = (n * mean).sum(axis=0) / np.maximum(total, 1)
    dev = mean - centre
    at = np.searchsorted(every, folds)
    own = q + n * dev * dev
    left = total - n[at]
    shift = -n[at] * dev[at] / np.maximum(left, 1)
    return left, centre + shift, np.maximum(0.0, own.sum(axis=0) - own[at] - left * shift * shift)


def weights(n: np.ndarray, mean: np.ndarray, q: np.ndarray, scorer: str = "lda", shrinkage: float = 0.1,
            floor: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Weight and offset per fold and voxel in raw units, NaN for a voxel without variance or with
    under two rows in a class. ``lda`` divides by the shrunken within-class variance, ``centroid`` does not."""
    if scorer not in ("lda", "centroid"):
        raise ValueError(scorer)
    (n0, n1), (m0, m1) = (np.moveaxis(a, 1, 0) for a in (n, mean))
    with np.errstate(divide="ignore", invalid="ignore"):
        m = (n0 * m0 + n1 * m1) / (n0 + n1)
        inner = q.sum(axis=1)
        v = (inner + n0 * (m0 - m) ** 2 + n1 * (m1 - m) ** 2) / (n0 + n1 - 1)
        den = (1 - shrinkage) * inner / (n0 + n1 - 2) / v + shrinkage if scorer == "lda" else np.ones_like(v)
        z0, z1 = (m0 - m) / np.sqrt(v), (m1 - m) / np.sqrt(v)
        w = (z1 - z0) / den / np.sqrt(v)
        b = -0.5 * (z1 * z1 - z0 * z0) / den - m * w
    ok = (n0 >= 2) & (n1 >= 2) & (v > floor * floor) & (den > 0)
    return np.where(ok, w, np.nan), np.where(ok, b, np.nan)


def decided(c: Cell, rows: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Score of the rows under every fold's model (rows x folds); NaN where no voxel counts."""
    used = np.isfinite(w)
    w0, b0 = np.where(used, w, 0.0), np.where(used, b, 0.0)
    there = c.there[rows]
    out = c.x[rows] @ w0.T + there @ (b0 + w0 * c.centre).T
    return np.where(there @ used.T.astype(np.float64) > 0, out, np.nan)


def hits(c: Cell, w: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Hits, scored and all test rows per fold."""
    rows = np.flatnonzero(c.is_test)
    at = np.searchsorted(c.folds, c.fold[rows])
    score = decided(c, rows, w, b)[np.arange(len(rows)), at]
    return counted(c.folds, at, score, c.y[rows])


def counted(folds: np.ndarray, at: np.ndarray, score: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    known = np.isfinite(score)
    k = len(folds)
    return pd.DataFrame({"fold": folds, "n_correct": np.bincount(at, ((score > 0) == y) & known, k).astype(np.int64),
                         "n_scored": np.bincount(at, known, k).astype(np.int64), "n_test": np.bincount(at, minlength=k)})


def pattern_sums(c: Cell, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per fold over its training rows: sums that make the covariance of voxels and scores."""
    rows = np.flatnonzero(c.is_train)
    d = decided(c, rows, w, b)
    d = np.where((c.fold[rows][:, None] != c.folds[None, :]) & np.isfinite(d), d, np.nan)
    inside = np.isfinite(d).astype(np.float64)
    d0 = np.where(inside > 0, d, 0.0)
    x, there = c.x[rows], c.there[rows]
    return inside.T @ there, d0.T @ there, (d0 * d0).T @ there, inside.T @ x + (inside.T @ there) * c.centre, d0.T @ x + (d0.T @ there) * c.centre


def pattern(n: np.ndarray, d: np.ndarray, dd: np.ndarray, x: np.ndarray, xd: np.ndarray) -> np.ndarray:
    """cov(x, score) / var(score) per fold and voxel; zero without variance, NaN without rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        var, cov = dd - d * d / n, xd - x * d / n
        out = np.where(var > 1e-12 * dd, cov / var, 0.0)
    return np.where(n > 1, out, np.nan)


def best(score: np.ndarray, fraction: float, least: int) -> np.ndarray:
    """True for the best ``max(least, ceil(n * fraction))`` voxels of each fold, ties by place."""
    out = np.zeros(score.shape, dtype=bool)
    for i, s in enumerate(score):
        known = np.flatnonzero(np.isfinite(s))
        k = min(len(known), max(least, int(np.ceil(len(known) * fraction))))
        out[i, known[np.argsort(-s[known], kind="stable")[:k]]] = True
    return out


# ---- decoding --------------------------------------------------------------------------

@dataclass(frozen=True)
class Scorer:
    """``select``: none, weight or haufe (the strongest voxels inside each fold, refit on them; the scorer is
    separable per voxel, so that is the fit restricted to them)."""

    kind: str = "lda"
    shrinkage: float = 0.1
    select: str = "none"
    fraction: float = 0.3
    least: int = 4

    def fit(self, every, folds, n, mean, q) -> tuple[np.ndarray, np.ndarray]:
        return weights(*outside(every, folds, n, mean, q), self.kind, self.shrinkage)

    def chosen(self, w: np.ndarray, found: np.ndarray | None) -> np.ndarray:
        if self.select not in ("none", "weight", "haufe"):
            raise ValueError(self.select)
        if self.select == "none":
            return np.isfinite(w)
        score = np.abs(w) if self.select == "weight" else np.where(np.isfinite(w), np.abs(found), np.nan)
        return best(score, self.fraction, self.least)


def _masked(w: np.ndarray, b: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(keep, w, np.nan), np.where(keep, b, np.nan)


def _packed(**arrays: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({k: [np.asarray(v).ravel()] for k, v in arrays.items()})


def _result(u: Units, cell_rows: DataFrame, keys: list[str]) -> DataFrame:
    d = cell_rows.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTS]) if u.cut else cell_rows
    return d.select(*keys, *COUNTS, (F.col("n_correct") / F.nullif(F.col("n_scored"), F.lit(0))).alias("accuracy"))


def _whole(c: Cell, scorer: Scorer) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Weights of a cell whose rows are all here, restricted to the selection, and the Haufe patterns."""
    w, b = scorer.fit(c.every, c.folds, *statistics(c))
    found = pattern(*pattern_sums(c, w, b)) if scorer.select == "haufe" else None
    return *_masked(w, b, scorer.chosen(w, found)), found


def models(u: Units, scorer: Scorer) -> DataFrame:
    """Packed weights ``w`` and ``b`` (folds x voxels, NaN where a voxel is out) per cell of a cut unit."""
    def part(left: pd.DataFrame, r: dict) -> pd.DataFrame | None:
        if r["__k"] == 1:
            return None
        c = opened(left, r)
        n, mean, q = statistics(c)
        return _packed(every=c.every, folds=c.folds, n=n, mean=mean, q=q)

    lists = ["every array<bigint>", "folds array<bigint>", "n array<double>", "mean array<double>", "q array<double>"]
    sums, cell = u.run(part, u.schema(*lists)), u.cell

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        every, folds = (np.asarray(pdf[c].iloc[0]) for c in ("every", "folds"))
        parts = [tuple(np.asarray(r[c]).reshape(len(every), 2, -1) for c in ("n", "mean", "q")) for r in pdf.to_dict("records")]
        w, b = scorer.fit(every, folds, *merged(parts))
        keep = np.isfinite(w) if scorer.select == "haufe" else scorer.chosen(w, None)
        return _keyed(cell, key, _packed(**dict(zip(("w", "b"), _masked(w, b, keep)))))

    out = cut_lineage(sums.groupBy(*u.cell).applyInPandas(fit, u.schema("w array<double>", "b array<double>")))
    if scorer.select != "haufe":
        return out
    found = haufe_of(u, out)

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        found = np.asarray(r["pattern"]).reshape(int(r["n_folds"]), -1)
        w, b = (np.asarray(r[c]).reshape(found.shape) for c in ("w", "b"))
        return _keyed(cell, key, _packed(**dict(zip(("w", "b"), _masked(w, b, scorer.chosen(w, found))))))

    return cut_lineage(out.join(found, u.cell).groupBy(*u.cell).applyInPandas(choose, u.schema("w array<double>", "b array<double>")))


def _keyed(cell: list[str], key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    own = list(pdf.columns)
    for c, v in zip(cell, key):
        pdf[c] = v
    return pdf[[*cell, *own]]


def _with_models(u: Units, packed: DataFrame) -> DataFrame:
    right = u.beside.join(packed, u.cell)
    return right.select(*[F.col(c).alias(c) for c in right.columns])


def _weights_of(c: Cell, r: dict) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.asarray(r[k], dtype=np.float64).reshape(len(c.folds), -1) for k in ("w", "b"))


def haufe_of(u: Units, packed: DataFrame) -> DataFrame:
    """Haufe patterns (folds x voxels, packed) of cut units under packed weights."""
    parts = ["n", "d", "dd", "x", "xd"]

    def part(left: pd.DataFrame, r: dict) -> pd.DataFrame:
        c = opened(left, r)
        return _packed(folds=c.folds, **dict(zip(parts, pattern_sums(c, *_weights_of(c, r)))))

    sums = u.run(part, u.schema("folds array<bigint>", *[f"{p} array<double>" for p in parts]), _with_models(u, packed))
    cell = u.cell

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        folds = np.asarray(pdf["folds"].iloc[0])
        out = pattern(*(np.sum(np.stack(pdf[p].to_numpy()), axis=0).reshape(len(folds), -1) for p in parts))
        made = _packed(pattern=out, folds=folds)
        made["n_folds"] = len(folds)
        return _keyed(cell, key, made)

    return cut_lineage(sums.groupBy(*u.cell).applyInPandas(join, u.schema("pattern array<double>", "folds array<bigint>", "n_folds int")))


def cross_validate(u: Units, scorer: Scorer = Scorer()) -> DataFrame:
    """Hits, scored and all test rows and the accuracy per cell and fold."""
    def whole(left: pd.DataFrame, r: dict) -> pd.DataFrame | None:
        if r["__k"] > 1:
            return None
        c = opened(left, r)
        w, b, _ = _whole(c, scorer)
        return hits(c, w, b)

    schema = u.schema("fold bigint", *[f"{c} bigint" for c in COUNTS])
    found = u.run(whole, schema)
    if u.cut:
        found = found.unionByName(u.run(lambda left, r: (lambda c: hits(c, *_weights_of(c, r)))(opened(left, r)), schema,
                                        _with_models(u, models(u, scorer))))
    return _result(u, found, [*u.cell, "fold"])


def haufe_patterns(u: Units, scorer: Scorer = Scorer()) -> DataFrame:
    """cov(x, score) / var(score) over the training rows of every fold: cell, fold, pos, pattern."""
    def whole(left: pd.DataFrame, r: dict) -> pd.DataFrame | None:
        if r["__k"] > 1:
            return None
        c = opened(left, r)
        w, b, _ = _whole(c, scorer)
        return pd.DataFrame({"fold": c.folds, "pattern": list(pattern(*pattern_sums(c, w, b)))})

    found = u.run(whole, u.schema("fold bigint", "pattern array<double>"))
    if u.cut:
        cut = haufe_of(u, models(u, scorer)).select(*u.cell, "folds", "pattern", F.posexplode("folds").alias("i", "fold"))
        width = (F.size("pattern") / F.size("folds")).cast("int")
        found = found.unionByName(cut.select(*u.cell, "fold", F.slice("pattern", F.col("i") * width + 1, width).alias("pattern")))
    return found.select(*u.cell, "fold", F.posexplode("pattern").alias("pos", "pattern")).filter(~F.isnan("pattern"))


def selected(u: Units, scorer: Scorer) -> DataFrame:
    """The voxels that each fold selects: cell, fold, pos."""
    def whole(left: pd.DataFrame, r: dict) -> pd.DataFrame | None:
        if r["__k"] > 1:
            return None
        c = opened(left, r)
        i, pos = np.nonzero(np.isfinite(_whole(c, scorer)[0]))
        return pd.DataFrame({"fold": c.folds[i], "pos": pos.astype(np.int32)})

    found = u.run(whole, u.schema("fold bigint", "pos int"))
    if u.cut:
        def listed(left: pd.DataFrame, r: dict) -> pd.DataFrame | None:
            folds = np.unique(np.asarray(r["fold"], dtype=np.int64)[np.asarray(r["is_test"], dtype=bool)])
            i, pos = np.nonzero(np.isfinite(np.asarray(r["w"], dtype=np.float64).reshape(len(folds), -1)))
            return pd.DataFrame({"fold": folds[i], "pos": pos.astype(np.int32)}) if r["__b"] == 0 else None
        found = found.unionByName(u.run(listed, u.schema("fold bigint", "pos int"), _with_models(u, models(u, scorer))))
    return found


# ---- searchlight -----------------------------------------------------------------------

def sphere_areas(voxels: DataFrame, spheres: DataFrame, edge: int = 10, voxel: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Cubes of ``edge`` centres a side, with the voxels their spheres reach (the halo).

    ``voxels``: voxel and lattice indices i, j, k; ``spheres``: centre, voxel. Returns (voxel, area) for cube and
    halo, and per area its voxels ``held``, its ``centres``, and their voxels (``member``) end to end with their ``sizes``."""
    cube = F.concat_ws("-", *[F.floor(F.col(c) / edge).cast("int") for c in "ijk"])
    near = cut_lineage(spheres.join(voxels.select(F.col(voxel).alias("centre"), cube.alias("area")), "centre"))
    halo = near.select(voxel, "area").distinct()
    own = near.groupBy("area", "centre").agg(F.array_sort(F.collect_list(voxel)).alias("own"))  # one sphere
    lists = own.groupBy("area").agg(F.array_sort(F.collect_list(F.struct("centre", "own"))).alias("s")).select(  # edge**3 at most
        "area", F.col("s.centre").alias("centres"), F.transform("s", lambda e: F.size(e["own"])).alias("sizes"), F.flatten("s.own").alias("member"))
    held = halo.groupBy("area").agg(F.array_sort(F.collect_list(voxel)).alias("held"))
    return halo, lists.join(held, "area")


def searchlight(labels: DataFrame, patterns: DataFrame, areas: tuple[DataFrame, DataFrame], shared: list[str], names: list[str], least: int,
                scorer: Scorer = Scorer(), trial: str = "vec_id", voxel: str = "pos", block: int = BLOCK) -> DataFrame:
    """Accuracy per sphere centre and fold: a test row's evidence is summed over the sphere, no model is
    fitted per sphere. Spheres with fewer than ``least`` voxels in use are left out.

    Patterns are dealt to the cubes once, before any label: a unit is (shared keys, roi, cube). There the evidence of a
    fold's test rows is a matrix, and the spheres of the cube are one sparse product with it."""
    halo, lists = areas
    keep = [*shared, "roi", trial]
    local = patterns.select(*keep, F.posexplode("features").alias(voxel, "x")).join(halo, voxel).groupBy(*keep, "area").agg(
        F.array_sort(F.collect_list(F.struct(voxel, "x"))).alias("__v")).select(*keep, "area", F.col("__v.x").alias("features"))
    u = units(labels, cut_lineage(local), shared, names, [*shared, "roi", "area"], trial, block)
    u.beside = u.beside.join(lists, "area")
    schema = u.schema("fold bigint", "centre bigint", *[f"{c} bigint" for c in COUNTS])

    def whole(left: pd.DataFrame, r: dict) -> pd.DataFrame | None:
        if r["__k"] > 1:
            return None
        c = opened(left, r)
        return spheres(c, r, *_whole(c, scorer)[:2], least)

    found = u.run(whole, schema)
    if u.cut:
        found = found.unionByName(u.run(lambda left, r: (lambda c: spheres(c, r, *_weights_of(c, r), least))(opened(left, r)), schema,
                                        _with_models(u, models(u, scorer))))
    return _result(u, found, [*[c for c in u.cell if c != "area"], "fold", "centre"])


def spheres(c: Cell, r: dict, w: np.ndarray, b: np.ndarray, least: int, cells: int = 1 << 22) -> pd.DataFrame:
    """Hits, scored and all test rows per fold and sphere of an area."""
    centres, sizes = np.asarray(r["centres"], dtype=np.int64), np.asarray(r["sizes"], dtype=np.int64)
    member = np.searchsorted(np.asarray(r["held"]), np.asarray(r["member"]))
    first = np.cumsum(sizes) - sizes
    used = np.isfinite(w)
    out = []
    for f, fold in enumerate(c.folds):
        rows = np.flatnonzero(c.is_test & (c.fold == fold))
        there = c.there[rows] * used[f]
        wf = np.where(used[f], w[f], 0.0)
        e = (c.x[rows] * wf) + there * (wf * c.centre + np.where(used[f], b[f], 0.0))
        enough = np.add.reduceat(used[f][member].astype(np.int64), first) >= least
        step = max(1, cells // max(1, len(rows) * int(sizes.max())))
        for s in range(0, len(centres), step):
            part = slice(first[s], first[min(s + step, len(first)) - 1] + sizes[min(s + step, len(first)) - 1])
            at = first[s:s + step] - first[s]
            score = np.add.reduceat(e[:, member[part]], at, axis=1)
            known = np.add.reduceat(there[:, member[part]], at, axis=1) > 0
            hit = ((score > 0) == (c.y[rows] == 1)[:, None]) & known
            ok = enough[s:s + step]
            out.append(pd.DataFrame({"fold": fold, "centre": centres[s:s + step][ok], "n_correct": hit.sum(axis=0)[ok],
                                     "n_scored": known.sum(axis=0)[ok], "n_test": len(rows)}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["fold", "centre", *COUNTS])
