"""Soft-margin linear models of units: 1/2 |w|^2 + C sum(hinge), offset penalised as one more weight.

A unit's patterns and label lists lie in one task (see ``units``). All its contrasts and folds share
one Gram matrix, from which that of a fold's centred training rows follows by subtraction; where a unit has fewer
features than rows, the features themselves are the smaller factor. Each model is a quadratic program in a box
and is solved by a primal-dual interior point method, in about fifteen steps of linear algebra, until its
relative duality gap is at most ``tolerance``; the gap is returned as a certificate.

The number of trials is no limit: a model of many rows and few features works on matrices as wide as
the features, and a Gram matrix is made for at most MOST trials. Units above BLOCK bytes of patterns are cut: their
models take the same steps to the same gap, with sums over all blocks in place of those over the rows. Only a cut
unit of more than WIDE features goes in rounds of ascent (``decode.hinge_models``), to the same gap too. A missing
feature is read as the unit's mean."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxtrail.functions import arrays as A
from voxtrail.operators import decode as D, units as U
from voxtrail.session import cut_lineage

MOST = 4096       # trials of a shared Gram matrix
BLOCK = 1 << 26   # bytes of patterns
WIDE = 2048       # features of a cut unit whose matrices are made
PARTS = 16        # parts of a block of a cut unit
SLICE = 1 << 16   # numbers in a row of sums
STEPS = 100


@dataclass(frozen=True)
class Margin:
    """``select``: none, weight or haufe: refit on the strongest |weight| or |Haufe pattern| of the model inside each fold."""

    c: float = 1.0
    tolerance: float = 1e-6
    select: str = "none"
    fraction: float = 0.5
    least: int = 4


def units(labels: DataFrame, patterns: DataFrame, shared: list[str], names: list[str], block: int = BLOCK, **more) -> U.Units:
    return U.units(labels, patterns, shared, names, block=block, **more)


# ---- one model -------------------------------------------------------------------------

def solve(z: np.ndarray, s: np.ndarray, c: float, tolerance: float, gram: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Multipliers and relative duality gap. ``z``: centred rows with a last column of ones; ``s``: -1 or 1;
    ``gram``: products of the rows of ``z``, where that is the smaller matrix."""
    n = len(z)
    zs = z * s[:, None]
    q = None if gram is None else gram * s[:, None] * s[None, :]

    def times(v: np.ndarray) -> np.ndarray:
        return zs @ (zs.T @ v) if q is None else q @ v

    def factor(d: np.ndarray):
        if q is not None:
            inverse = np.linalg.inv(q + np.diag(d))
            return lambda r: inverse @ r
        y = zs / d[:, None]
        inner = np.linalg.inv(np.eye(z.shape[1]) + zs.T @ y)
        return lambda r: r / d - y @ (inner @ (y.T @ r))

    a = np.full(n, c / 2)
    room = a.copy()  # c - a, which rounds to zero near c
    qa = times(a)
    low, high = np.maximum(qa - 1, 0) + 1, np.maximum(1 - qa, 0) + 1  # multipliers of a >= 0 and of a <= c
    for _ in range(STEPS):
        value = a @ qa
        primal = value / 2 + c * np.maximum(0, 1 - qa).sum()
        gap = (primal - a.sum() + value / 2) / max(primal, 1e-12)
        if gap <= tolerance:
            return a, gap
        mu = (low @ a + high @ room) / (2 * n)
        step = factor(low / a + high / room)

        def direction(p: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            da = step(p / a - low - r / room + high)
            return da, p / a - low - low / a * da, r / room - high + high / room * da

        da, dl, dh = direction(np.zeros(n), np.zeros(n))
        t = _longest((a, da), (room, -da), (low, dl), (high, dh))
        ahead = ((low + t * dl) @ (a + t * da) + (high + t * dh) @ (room - t * da)) / (2 * n)
        target = mu * (ahead / mu) ** 3
        da, dl, dh = direction(target - dl * da, target + dh * da)
        t = 0.995 * _longest((a, da), (room, -da), (low, dl), (high, dh))
        a, room, low, high = a + t * da, room - t * da, low + t * dl, high + t * dh
        qa = times(a)
    raise RuntimeError(f"a model is above a gap of {tolerance} after {STEPS} steps: {gap}")


def _longest(*moves: tuple[np.ndarray, np.ndarray]) -> float:
    """The longest step, up to 1, that takes no value of (values, change) below zero."""
    with np.errstate(divide="ignore"):
        return min(1.0, *(float(np.min(np.where(d < 0, -v / np.where(d < 0, d, -1.0), np.inf), initial=np.inf)) for v, d in moves))


def fitted(c: U.Cell, gram: np.ndarray | None, m: Margin) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per fold: weights (NaN where a voxel is out), offsets, gaps, and whether there is a model."""
    w, offset = np.full((len(c.folds), c.x.shape[1]), np.nan), np.zeros(len(c.folds))
    gaps, ok = np.full(len(c.folds), np.nan), np.zeros(len(c.folds), dtype=bool)
    for f, fold in enumerate(c.folds):
        rows = np.flatnonzero(c.is_train & (c.fold != fold))
        if not len(rows):
            continue
        ok[f] = True
        w[f], offset[f], gaps[f] = _model(c, rows, np.arange(c.x.shape[1]), gram, m)
    if m.select == "none" or not ok.any():
        return w, offset, gaps, ok
    score = np.abs(w) if m.select == "weight" else np.abs(U.pattern(*U.pattern_sums(c, w, _spread(w, offset))))
    keep = U.best(score, m.fraction, m.least)
    for f, fold in enumerate(c.folds):
        if ok[f]:
            columns, rows = np.flatnonzero(keep[f]), np.flatnonzero(c.is_train & (c.fold != fold))
            w[f] = np.nan
            w[f, columns], offset[f], gaps[f] = _model(c, rows, columns, None, m)
    return w, offset, gaps, ok


def _spread(w: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The offset dealt to the voxels in use."""
    used = np.isfinite(w)
    return np.where(used, (offset / np.maximum(used.sum(axis=1), 1))[:, None], np.nan)


def _model(c: U.Cell, rows: np.ndarray, columns: np.ndarray, gram: np.ndarray | None, m: Margin) -> tuple[np.ndarray, float, float]:
    x = c.x[rows][:, columns]
    mean = x.mean(axis=0)
    z = np.concatenate([x - mean, np.ones((len(x), 1))], axis=1)
    products = None
    if 2 * z.shape[1] > len(x):
        if gram is None:
            products = z @ z.T
        else:
            shift = x @ mean
            at = c.rows[rows]
            products = gram[np.ix_(at, at)] - shift[:, None] - shift[None, :] + mean @ mean + 1
    s = 2.0 * c.y[rows] - 1
    a, gap = solve(z, s, m.c, m.tolerance, products)
    v = (a * s) @ z
    return v[:-1], float(v[-1] - v[:-1] @ (mean + c.centre[columns])), gap


# ---- all models ------------------------------------------------------------------------

def _filled(left: pd.DataFrame, r: dict) -> tuple[U.Cell, np.ndarray | None]:
    """The cell with its missing values at the mean, and the unit's Gram matrix where it is worth its size."""
    c = U.opened(left, r)
    c.there[:] = 1
    gram = getattr(left, "_gram", None)
    x = left._matrix[0]
    if gram is None and len(x) <= MOST and 2 * x.shape[1] > len(x) / 4:
        gram = x @ x.T
        object.__setattr__(left, "_gram", gram)
    return c, gram


def validate(u: U.Units, m: Margin = Margin()) -> DataFrame:
    """Hits, scored and all test rows, accuracy, voxels in use and duality gap per cell and fold."""
    schema = u.schema("fold bigint", *[f"{x} bigint" for x in U.COUNTS], "n_selected int", "gap double")

    def whole(left: pd.DataFrame, r: dict) -> pd.DataFrame | None:
        if r["__k"] > 1:
            return None
        c, gram = _filled(left, r)
        w, offset, gaps, ok = fitted(c, gram, m)
        out = U.hits(c, w, _spread(w, offset))
        out["n_selected"], out["gap"] = np.isfinite(w).sum(axis=1).astype(np.int32), gaps
        return out

    found = u.run(whole, schema)
    if u.cut:
        if m.select != "none":
            raise ValueError("selection by margin needs units in one block")
        found = found.unionByName(_in_blocks(u, m, schema))
    return found.withColumn("accuracy", F.col("n_correct") / F.nullif(F.col("n_scored"), F.lit(0)))


# ---- cut units -------------------------------------------------------------------------

def _in_blocks(u: U.Units, m: Margin, schema: str) -> DataFrame:
    """Cut units, about the mean of all their blocks."""
    several = u.beside.filter("__k > 1")
    rows = u.rows.join(several.select(*u.unit).distinct(), u.unit, "left_semi")

    def there(x):
        return F.when(F.abs(x) < F.lit(float("inf")), x.cast("double"))

    centre = rows.select(*u.unit, F.posexplode("features").alias("pos", "x")).groupBy(*u.unit, "pos").agg(
        F.coalesce(F.avg(there(F.col("x"))), F.lit(0.0)).alias("m"))
    centre = cut_lineage(D.packed(centre, u.unit, "m", "__c"))
    parts = []
    for wide, solved in ((False, _in_steps), (True, _in_rounds)):
        own = centre.filter((F.size("__c") > WIDE) == F.lit(wide))
        if own.take(1):
            mine = cut_lineage(rows.join(own, u.unit).select(*u.unit, "__b", "t", F.zip_with(
                "features", "__c", lambda x, mean: F.coalesce(there(x) - mean, F.lit(0.0))).alias("features")))
            beside = several.join(own.select(*u.unit, F.size("__c").alias("__p")), u.unit)
            parts.append(solved(replace(u, rows=mine, beside=beside), m, schema))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _in_rounds(u: U.Units, m: Margin, schema: str) -> DataFrame:
    """Units too wide for matrices of their features: rounds of ascent over blocks."""
    lists = u.beside.filter("__b = 0").select(*u.cell, "__p", F.explode(F.arrays_zip(*U.COLUMNS)).alias("e")).select(*u.cell, "__p", "e.*")
    rows = cut_lineage(lists.join(u.rows.drop("__b"), [*u.unit, "t"]).withColumnRenamed("t", "trial"))
    found = D.hinge_validate(rows, u.cell, m.c, m.tolerance).join(rows.select(*u.unit, "__p").distinct(), u.unit)
    return found.select(*u.cell, "fold", F.coalesce("n_correct", F.lit(0)).alias("n_correct"), "n_scored", "n_test",
                        F.when(F.col("gap").isNotNull(), F.col("__p")).otherwise(0).alias("n_selected"), "gap")


def _in_steps(u: U.Units, m: Margin, schema: str) -> DataFrame:
    """The steps of ``solve``, three passes over PARTS parts of each block. A pass brings no rows of multipliers along: a
    part repeats its steps from the short answers so far."""
    def listed(left: pd.DataFrame, r: dict) -> pd.DataFrame:
        lists = {k: np.asarray(r[k], dtype=bool if k.startswith("is") else np.int64) for k in U.COLUMNS}
        part = pd.Series(left["__s"].to_numpy(), left["t"].to_numpy())
        part = part[~part.index.duplicated()].reindex(lists["t"]).fillna(-1).to_numpy()
        out = [{k: v[part == i] for k, v in lists.items()} | {"__b": r["__b"] * PARTS + i} for i in np.unique(left["__s"])]
        return pd.DataFrame(out).assign(folds=[np.unique(lists["fold"][lists["is_test"]])] * len(out))

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf["t"].to_numpy(), kind="stable")
        out = pdf[block].iloc[:1].copy()
        out["t"], out["features"] = [pdf["t"].to_numpy()[order]], [np.concatenate(pdf["features"].to_numpy()[order])]
        return out

    kinds = ["t array<bigint>", "y array<tinyint>", "fold array<bigint>", "is_train array<boolean>", "is_test array<boolean>"]
    block = [*u.unit, "__b"]
    rows = u.rows.withColumn("__s", F.pmod(F.hash("t"), F.lit(PARTS)))
    lists = cut_lineage(replace(u, rows=_dealt(rows.drop("features"), block)).run(
        listed, u.schema("__b int", *kinds, "folds array<bigint>"), _dealt(u.beside, block)))
    rows = _dealt(rows.withColumn("__b", F.col("__b") * PARTS + F.col("__s")), block).groupBy(*block).applyInPandas(
        packed, ", ".join([*[f"`{k}` {u.types[k]}" for k in u.unit], "`__b` int", "t array<bigint>", "features array<double>"]))
    dealt = replace(u, rows=_dealt(cut_lineage(rows), block))
    none = F.array().cast("array<double>")
    state = cut_lineage(lists.groupBy(*u.cell).agg(F.first("folds").alias("folds")).select(
        *u.cell, "folds", F.transform("folds", lambda f: F.lit(True)).alias("live"), none.alias("said"), none.alias("own"),
        F.transform("folds", lambda f: F.lit(None).cast("double")).alias("gaps"), none.alias("w")))
    lists = lists.drop("folds")
    for step in range(3 * STEPS + 1):
        if step % 3 == 0 and not state.filter(F.exists("live", lambda x: x)).take(1):
            beside = lists.join(state.select(*u.cell, "folds", "gaps", "w").filter("size(folds) > 0"), u.cell)
            found = dealt.run(_scored, schema, _dealt(beside, block))
            return found.groupBy(*u.cell, "fold").agg(*[F.sum(x).alias(x) for x in U.COUNTS], F.max("n_selected").alias("n_selected"), F.max("gap").alias("gap"))
        beside = lists.join(state.filter(F.exists("live", lambda x: x)).select(*u.cell, "folds", "live", "said"), u.cell)
        sums = dealt.run(_summed(m, step), u.schema("__b int", "i int", "part array<double>"), _dealt(beside, block))
        # a union: the size that Spark expects of a cogroup would be squared in every pass
        both = _dealt(state.unionByName(_joined(sums, u.cell), allowMissingColumns=True), u.cell)
        state = cut_lineage(both.groupBy(*u.cell).applyInPandas(_answered(m, step), state.schema))
    raise RuntimeError(f"a model of a cut unit is above a gap of {m.tolerance} after {STEPS} steps")


def _rows(left: pd.DataFrame, r: dict) -> tuple[np.ndarray, ...]:
    raw = getattr(left, "_rows", None)
    if raw is None:
        own = np.asarray(left["t"].iloc[0], dtype=np.int64)
        raw = _array(left["features"].iloc[0]).reshape(len(own), -1), own
        object.__setattr__(left, "_rows", raw)  # once for all contrasts of the unit
    x, own = raw
    at = np.searchsorted(own, np.asarray(r["t"], dtype=np.int64))
    return x[at], *(np.asarray(r[k], dtype=kind) for k, kind in (("y", np.int64), ("fold", np.int64), ("is_train", bool), ("is_test", bool)))


def _block(x: np.ndarray, s: np.ndarray, c: float):
    """A block's side of ``solve``: yields how to make a least value and sums over its rows, and is sent a number and a
    vector that follow from those of all blocks (``_answer``)."""
    mean = (yield lambda: (np.inf, [len(x), x.sum(axis=0)]))[1:-1]
    zs = np.concatenate([x - mean, np.ones((len(x), 1))], axis=1) * s[:, None]
    a, room = np.full(len(x), c / 2), np.full(len(x), c / 2)
    v = (yield lambda: (np.inf, [zs.T @ a]))[1:]
    qa = zs @ v
    low, high = np.maximum(qa - 1, 0) + 1, np.maximum(1 - qa, 0) + 1
    while True:
        rest = high - low
        d = low / a + high / room
        u = (yield lambda: (np.inf, [np.maximum(0, 1 - zs @ v).sum(), a.sum(), low @ a + high @ room,
                                     zs.T @ (rest / d), zs.T @ (zs / d[:, None])]))[1:]
        da = (rest - zs @ u) / d
        dl, dh = -low - low / a * da, -high + high / room * da
        told = yield lambda: (_longest((a, da), (room, -da), (low, dl), (high, dh)),
                              [dl @ da - dh @ da, zs.T @ ((1 / a - 1 / room) / d), zs.T @ ((rest - dl * da / a - dh * da / room) / d)])
        up, down = told[0] - dl * da, told[0] + dh * da
        da = (up / a - low - down / room + high - zs @ told[1:]) / d
        dl, dh = up / a - low - low / a * da, down / room - high + high / room * da
        told = yield lambda: (_longest((a, da), (room, -da), (low, dl), (high, dh)), [zs.T @ a, zs.T @ da])
        a, room = a + told[0] * da, room - told[0] * da
        low, high, v = low + told[0] * dl, high + told[0] * dh, told[1:]


def _answer(m: Margin, step: int, said: np.ndarray, own: np.ndarray, least: float, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """What the blocks are sent after a pass, numbers to keep, and the gap once it is small enough."""
    if step == 0:
        return np.array([q[0], *(q[1:] / max(q[0], 1)), 0.0]), own, np.nan
    if step == 1:
        return np.array([0.0, *q]), own, np.nan
    n, k = said[0, 0], said.shape[1] - 1
    if step % 3 == 2:
        v = said[-1, 1:]
        value = v @ v
        primal = value / 2 + m.c * q[0]
        gap = (primal - q[1] + value / 2) / max(primal, 1e-12)
        inner = np.linalg.inv(np.eye(k) + q[3 + k:].reshape(k, k))
        return np.array([0.0, *(inner @ q[3:3 + k])]), np.array([q[2], *inner.ravel()]), gap if gap <= m.tolerance else np.nan
    if step % 3 == 0:
        mu, t, inner = own[0] / (2 * n), min(1.0, least), own[1:].reshape(k, k)
        ahead = (own[0] * (1 - t) + t * t * q[0]) / (2 * n)
        target = mu * (ahead / mu) ** 3
        return np.array([target, *(inner @ (target * q[1:1 + k] + q[1 + k:]))]), own, np.nan
    t = 0.995 * min(1.0, least)
    return np.array([t, *(q[:k] + t * q[k:])]), own, np.nan


def _array(v) -> np.ndarray:
    return np.asarray(v, dtype=np.float64)


def _summed(m: Margin, step: int):
    """Sums of a block for its unsolved folds, in slices; slice -1 has the least values."""
    def work(left: pd.DataFrame, r: dict) -> pd.DataFrame:
        x, y, fold, is_train, _ = _rows(left, r)
        folds, live = np.asarray(r["folds"]), np.flatnonzero(np.asarray(r["live"], dtype=bool))
        said = _array(r["said"]).reshape(step, len(folds), -1) if step else None
        least, sums = [], []
        for f in live:
            rows = np.flatnonzero(is_train & (fold != folds[f]))
            block = _block(x[rows], 2.0 * y[rows] - 1, m.c)
            made = next(block)
            for k in range(step):
                made = block.send(said[k, f])
            low, parts = made()
            least.append(low)
            sums += [np.ravel(p) for p in parts]
        sums = np.concatenate(sums)
        cuts = range(0, len(sums), SLICE)
        return pd.DataFrame({"__b": r["__b"], "i": [-1, *range(len(cuts))], "part": [np.array(least), *[sums[i:i + SLICE] for i in cuts]]})

    return work


def _joined(sums: DataFrame, cell: list[str]) -> DataFrame:
    """Slices of all blocks as one."""
    def both(x, y):
        return F.when(F.col("i") < 0, F.least(x, y)).otherwise(x + y)

    parts = sums.groupBy(*cell, "i").agg(F.array_sort(F.collect_list(F.struct("__b", "part"))).alias("__p"))
    return parts.select(*cell, "i", F.aggregate(F.expr("slice(__p, 2, size(__p))"), F.col("__p")[0]["part"],
                                                lambda a, b: F.zip_with(a, b["part"], both)).alias("part"))


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """In as many tasks as the session shuffles to: the work is more than its bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _answered(m: Margin, step: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["i"].isna()].drop(columns=["i", "part"]), pdf[pdf["i"].notna()].sort_values("i")
        if not len(right):
            return left
        r = left.iloc[0]
        live, gaps = np.array(r["live"], dtype=bool), np.array(_array(r["gaps"]))
        at = np.flatnonzero(live)
        least, sums = _array(right["part"].iloc[0]), np.concatenate([_array(p) for p in right["part"].iloc[1:]]).reshape(len(at), -1)
        width = sums.shape[1] + 1 if step == 0 else len(r["said"]) // (step * len(live))
        said = _array(r["said"]).reshape(step, len(live), width)
        own = _array(r["own"]).reshape(len(at), -1) if len(r["own"]) else [np.zeros(0)] * len(at)
        w = _array(r["w"]).reshape(len(live), -1).copy() if step else np.full((len(live), width - 1), np.nan)
        answer, kept = np.full((1, len(live), width), np.nan), []
        for j, f in enumerate(at):
            answer[0, f], keep, gaps[f] = _answer(m, step, said[:, f], own[j], least[j], sums[j])
            live[f] = np.isnan(gaps[f]) and (step > 0 or sums[j][0] > 0)
            if live[f]:
                kept.append(keep)
            elif step:
                v, mean = said[-1, f, 1:], said[0, f, 1:-1]
                w[f] = [*v[:-1], v[-1] - v[:-1] @ mean]
        out = left.copy()
        out["live"], out["gaps"], out["w"] = [live], [gaps], [w.ravel()]
        out["said"], out["own"] = [np.concatenate([said, answer]).ravel()], [np.concatenate([*kept, np.zeros(0)])]
        return out

    return work


def _scored(left: pd.DataFrame, r: dict) -> pd.DataFrame:
    x, y, fold, _, is_test = _rows(left, r)
    folds, rows = np.asarray(r["folds"]), np.flatnonzero(is_test)
    w = _array(r["w"]).reshape(len(folds), -1)
    at = np.searchsorted(folds, fold[rows])
    out = U.counted(folds, at, (x[rows] @ w[:, :-1].T + w[:, -1])[np.arange(len(rows)), at], y[rows])
    out["n_selected"], out["gap"] = np.isfinite(w[:, :-1]).sum(axis=1).astype(np.int32), _array(r["gaps"])
    return out
