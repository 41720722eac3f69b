"""Decoding of averaged pseudo-trials under many draws, drawn where the patterns lie.

A draw is one (permutation, repeat) and, inside a source, one fold of it. In each draw a trial belongs
to one group: a training chunk of a class, a test chunk of a class, or none. No row exists per trial and draw:
a unit (subject) has the patterns of all its regions, gets the short label lists of all its contrasts beside them,
and makes permutation, fold and chunk of every trial from hashes of (permutation, repeat) and the trial, so
that any task, and any other engine, makes the same ones. The permutations of a unit are dealt to SHARES tasks. The sums of all groups of all draws are the product of
their indicator with the pattern matrix; what is left per draw is a handful of mean patterns, which
are scaled, fitted and scored for thousands of draws together.

A unit with a region above BLOCK bytes is cut into blocks of trials. Each makes its share of the sums, and these are added
up per draw before scoring. The label lists (about 20 bytes a trial) are whole for each block, as
ranks inside a class need all its trials.

Groups: y * train + chunk for training, 2 * train + y * test + chunk for test, -1 for none."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxtrail.functions.hashing import PRIME
from voxtrail.session import cut_lineage

BLOCK = 1 << 24   # bytes of patterns
STEP = 1 << 22    # indicator cells of one product
TOGETHER = 64     # draws whose blocks are added up in one task
SHARES = 12       # tasks of a block, each with its share of the permutations


# ---- draws -----------------------------------------------------------------------------

def keyed(seeds: Sequence[str], trial: np.ndarray) -> np.ndarray:
    """Hash of every trial under every seed, as ``poly_hash`` makes it."""
    digests = [hashlib.md5(s.encode()).hexdigest() for s in seeds]
    c = np.array([[int(d[8 * i:8 * i + 8], 16) % PRIME for i in range(4)] for d in digests], dtype=np.int64).reshape(-1, 4)
    x = trial.astype(np.int64) % PRIME
    acc = np.repeat(c[:, 3:], len(x), axis=1)
    for i in (2, 1, 0):
        acc = (acc * x + c[:, i:i + 1]) % PRIME
    return acc


def spread(rank: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Chunk of a rank when n rows are split into k runs of nearly equal length, longer ones first."""
    size, extra = n // k, n % k
    head = extra * (size + 1)
    return np.where(rank < head, rank // (size + 1), extra + (rank - head) // np.maximum(size, 1))


def _class_rank(y: np.ndarray) -> np.ndarray:
    """Rank of each entry among those of its class before it, along the last axis."""
    ones = np.cumsum(y, axis=-1)
    return np.where(y == 1, ones - 1, np.arange(y.shape[-1]) - ones)


def shuffles(permutations: Sequence[int], where: str, trial: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels under each permutation, class counts kept; permutation 0 is the observed order."""
    order = np.argsort(keyed([f"null|{p}|{where}" for p in permutations], trial), axis=1, kind="stable")
    out = np.empty(order.shape, dtype=np.int8)
    np.put_along_axis(out, order, np.broadcast_to(np.sort(y).astype(np.int8), order.shape), axis=1)
    out[np.asarray(permutations) == 0] = y
    return out


@dataclass(frozen=True)
class Within:
    """k folds inside a source, by hash rank inside the class; ``train`` training chunks per class in the
    order of trials, one test mean per class; scaled by the single training trials."""

    permutations: int = 0
    repeats: int = 1
    folds: int = 4
    train: int = 3
    test: int = 1
    own_scale: bool = False

    @property
    def each(self) -> int:  # draws of a permutation
        return self.repeats * self.folds

    def slots(self, permutations: Sequence[int], where: str, trial, y, is_train, is_test) -> np.ndarray:
        """Group of every trial (in order) in every draw of the permutations."""
        yy = np.repeat(shuffles(permutations, where, trial, y), self.repeats, axis=0)
        seeds = [f"fold|{where}|{p}|{r}" for p in permutations for r in range(self.repeats)]
        order = np.argsort(keyed(seeds, trial), axis=1, kind="stable")
        fold = np.empty(order.shape, dtype=np.int64)
        np.put_along_axis(fold, order, _class_rank(np.take_along_axis(yy, order, axis=1)) % self.folds, axis=1)
        out = np.empty((len(seeds), self.folds, len(trial)), dtype=np.int8)
        for f in range(self.folds):
            out[:, f] = 2 * self.train + yy
            for c in (0, 1):
                mine = (fold != f) & (yy == c)
                chunk = spread(np.cumsum(mine, axis=1) - 1, mine.sum(axis=1, keepdims=True), self.train)
                out[:, f][mine] = (c * self.train + chunk)[mine]
        return out.reshape(-1, len(trial))


@dataclass(frozen=True)
class Across:
    """Train on one source, test on the other: random chunks per class on both sides, the same for
    every permutation of a repeat; each side is shuffled by itself and scaled by its own trials."""

    permutations: int = 0
    repeats: int = 1
    train: int = 4
    test: int = 4
    own_scale: bool = True

    @property
    def each(self) -> int:
        return self.repeats

    def slots(self, permutations: Sequence[int], where: str, trial, y, is_train, is_test) -> np.ndarray:
        out = np.full((len(permutations), self.repeats, len(trial)), -1, dtype=np.int8)
        for side, base, k in ((is_train, 0, self.train), (is_test, 2 * self.train, self.test)):
            at = np.flatnonzero(side)
            order = np.argsort(keyed([f"chunk|{r}" for r in range(self.repeats)], trial[at]), axis=1, kind="stable")
            ys = shuffles(permutations, where, trial[at], y[at])[:, order]  # permutations x repeats x places
            n1 = ys.sum(axis=2, keepdims=True, dtype=np.int64)
            group = base + ys * k + spread(_class_rank(ys.astype(np.int64)), np.where(ys == 1, n1, len(at) - n1), k)
            mine = np.empty(group.shape, dtype=np.int8)
            np.put_along_axis(mine, np.broadcast_to(order, group.shape), group.astype(np.int8), axis=2)
            out[:, :, at] = mine
        return out.reshape(-1, len(trial))


# ---- sums and scores -------------------------------------------------------------------

def group_sums(slots: np.ndarray, x: np.ndarray, train: int, test: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per draw: count and sum of each group, and the sums of squares of the training and of the test trials."""
    groups, draws, xx = 2 * train + 2 * test, len(slots), x * x
    n, s, q = np.zeros((draws, groups), dtype=np.int64), np.zeros((draws, groups, x.shape[1])), np.zeros((draws, 2, x.shape[1]))
    step = max(1, STEP // max(1, groups * slots.shape[1]))
    for first in range(0, draws, step):
        part, k = slice(first, first + step), len(slots[first:first + step])
        mine = slots[part]
        inside = mine[:, None, :] == np.arange(groups, dtype=np.int8)[None, :, None]
        n[part] = np.count_nonzero(inside, axis=2)
        s[part] = (inside.reshape(k * groups, -1).astype(np.float64) @ x).reshape(k, groups, -1)
        role = np.stack([(mine >= 0) & (mine < 2 * train), mine >= 2 * train], axis=1)
        q[part] = (role.reshape(k * 2, -1).astype(np.float64) @ xx).reshape(k, 2, -1)
    return n, s, q


def score(n: np.ndarray, s: np.ndarray, q: np.ndarray, plan: Within | Across, scorer: str = "lda", shrinkage: float = 0.1,
          c: float = 1.0) -> np.ndarray:
    """Per draw: hits, scored and all test means.

    Groups are averaged and scaled per voxel by the mean and SD (ddof=0) of the single training trials,
    or with ``own_scale`` each side by its own. ``scorer``: lda, centroid or svm (soft margin,
    C = ``c``). A draw with under two training means in a class scores nothing."""
    if scorer not in ("lda", "centroid", "svm"):
        raise ValueError(scorer)
    t = 2 * plan.train
    tr, te = n[:, :t] > 0, n[:, t:] > 0
    y, yt = np.repeat([0, 1], plan.train), np.repeat([0, 1], plan.test)

    def scaled(part: slice, side: int, by: slice) -> np.ndarray:
        size = np.maximum(n[:, by].sum(axis=1), 1)[:, None]
        mean = s[:, by].sum(axis=1) / size
        sd = np.sqrt(np.maximum(0.0, q[:, side] / size - mean * mean))
        return (s[:, part] / np.maximum(n[:, part], 1)[:, :, None] - mean[:, None]) / np.where(sd > 0, sd, 1.0)[:, None]

    left, right = slice(0, t), slice(t, None)
    x = scaled(left, 0, left)
    z = scaled(right, 1, right) if plan.own_scale else scaled(right, 0, left)
    ok = (np.minimum(tr[:, y == 0].sum(axis=1), tr[:, y == 1].sum(axis=1)) >= 2) & te.any(axis=1)
    if scorer == "svm":
        w, b = np.zeros((len(n), x.shape[2])), np.zeros(len(n))
        for d in np.flatnonzero(ok).tolist():
            w[d], b[d] = small_svm(x[d][tr[d]], 2.0 * y[tr[d]] - 1, c)
    else:
        w, b, some = _linear(x, tr, plan.train, scorer, shrinkage)
        ok &= some
    hit = ((np.einsum("dgp,dp->dg", z, w) + b[:, None] > 0) == yt) & te & ok[:, None]
    found = te.sum(axis=1)
    return np.stack([hit.sum(axis=1), np.where(ok, found, 0), found], axis=1)


def _linear(x: np.ndarray, used: np.ndarray, train: int, scorer: str, shrinkage: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The separable scorer of single trials on a few rows a draw; False without a voxel that varies."""
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [(x[:, i * train:(i + 1) * train], used[:, i * train:(i + 1) * train, None]) for i in (0, 1)]
        k = [u.sum(axis=1) for _, u in parts]
        mean = [np.where(u, p, 0.0).sum(axis=1) / kk for (p, u), kk in zip(parts, k)]
        every = k[0] + k[1]
        m = (k[0] * mean[0] + k[1] * mean[1]) / every
        inner = sum(np.where(u, (p - mm[:, None]) ** 2, 0.0).sum(axis=1) for (p, u), mm in zip(parts, mean))
        v = sum(np.where(u, (p - m[:, None]) ** 2, 0.0).sum(axis=1) for p, u in parts) / (every - 1)
        use = v > 1e-14
        v = np.where(use, v, 1.0)
        den = (1 - shrinkage) * inner / (every - 2) / v + shrinkage if scorer == "lda" else np.ones_like(v)
        use &= den > 0
        den = np.where(use, den, 1.0)
        z0, z1 = (mean[0] - m) / np.sqrt(v), (mean[1] - m) / np.sqrt(v)
        w = np.where(use, (z1 - z0) / den / np.sqrt(v), 0.0)
        return w, np.where(use, -0.5 * (z1 * z1 - z0 * z0) / den - m * w, 0.0).sum(axis=1), use.any(axis=1)


def small_svm(x: np.ndarray, y: np.ndarray, c: float, tolerance: float = 1e-6, sweeps: int = 10_000) -> tuple[np.ndarray, float]:
    """Soft-margin model of a few rows: pairwise exact steps in the dual (bias not penalised)."""
    k = x @ x.T
    a, g = np.zeros(len(y)), np.ones(len(y))  # multipliers and gradient
    for _ in range(sweeps):
        up = np.where((y > 0) & (a < c) | (y < 0) & (a > 0), y * g, -np.inf)
        low = np.where((y > 0) & (a > 0) | (y < 0) & (a < c), y * g, np.inf)
        i, j = int(up.argmax()), int(low.argmin())
        if up[i] - low[j] < tolerance:
            break
        t = (up[i] - low[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        t = min(t, c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        a[i] += y[i] * t
        a[j] -= y[j] * t
        g -= y * t * (k[:, i] - k[:, j])
    else:
        raise RuntimeError("a small model did not converge")
    return x.T @ (a * y), float((up.max() + low.min()) / 2)


# ---- units -----------------------------------------------------------------------------

COUNTS = ["n_correct", "n_scored", "n_test"]


def decode(labels: DataFrame, patterns: DataFrame, shared: list[str], names: list[str], plan: Within | Across, scorer: str = "lda",
           trial: str = "vec_id", per_draw: bool = False, block: int = BLOCK) -> DataFrame:
    """Decoding of every cell (shared keys, names, roi) under all draws of the plan.

    ``labels``: shared keys, names, trial (whole number), y (0/1), is_train, is_test. ``patterns``: shared keys, roi,
    trial, features. The hashes of a cell's draws are seeded with the shared keys and the first name.

    Returns the counts and ``accuracy`` (mean over the draws that score) per cell and permutation, or per cell and draw."""
    cells = labels.groupBy(*shared, *names).agg(F.array_sort(F.collect_list(F.struct(
        F.col(trial).cast("bigint").alias("t"), F.col("y").cast("tinyint").alias("y"), "is_train", "is_test"))).alias("__l")).select(
        *shared, *names, *[F.col(f"__l.{k}").alias(k) for k in ("t", "y", "is_train", "is_test")])
    size = patterns.groupBy(*shared, "roi").agg(F.ceil(F.sum(F.size("features") * F.lit(8.0)) / block).cast("int").alias("__k"))
    size = cut_lineage(size.groupBy(*shared).agg(F.max("__k").alias("__k")))
    share = F.explode(F.sequence(F.lit(0), F.lit(min(SHARES, plan.permutations + 1) - 1))).alias("__p")
    rows = patterns.join(size, shared).select(*shared, F.pmod(F.xxhash64(trial), F.col("__k")).cast("int").alias("__b"), share, "roi",
                                              F.col(trial).cast("bigint").alias("t"), "features")
    beside = size.join(cells, shared).withColumn("__b", F.explode(F.sequence(F.lit(0), F.col("__k") - 1))).select("*", share)
    beside = beside.select(*[F.col(x).alias(x) for x in beside.columns])  # columns of its own: both sides stem from the patterns
    types = dict(cells.dtypes) | {"roi": dict(patterns.dtypes)["roi"]}
    cell = [*shared, "roi", *names]
    schema = ", ".join(f"`{c}` {types[c]}" for c in cell) + ", number int, n_correct bigint, n_scored bigint, n_test bigint, share double, " \
        "n_draws bigint, n array<bigint>, s array<double>, q array<double>"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        regions, parts = _regions(left), []
        for r in right.to_dict("records") if regions else []:
            for roi, out in _cell_draws(regions, r, plan, scorer, per_draw, "|".join(str(r[c]) for c in [*shared, names[0]])):
                for c in cell:
                    out[c] = roi if c == "roi" else r[c]
                parts.append(out)
        columns = [*cell, "number", *COUNTS, "share", "n_draws", "n", "s", "q"]
        return pd.concat(parts, ignore_index=True)[columns] if parts else pd.DataFrame(columns=columns)

    keys = [*shared, "__b", "__p"]
    found = rows.groupBy(*keys).cogroup(beside.groupBy(*keys)).applyInPandas(run, schema)
    return _united(cut_lineage(found), cell, plan, scorer, per_draw)


def _regions(left: pd.DataFrame) -> dict:
    """Per region its trials in order and their patterns."""
    out = {}
    for roi, part in left.groupby("roi", sort=True):
        own = part["t"].to_numpy()
        order = np.argsort(own, kind="stable")
        out[roi] = own[order], np.stack(part["features"].to_numpy()[order]).astype(np.float64)
    return out


def _cell_draws(regions: dict, r: dict, plan: Within | Across, scorer: str, per_draw: bool, where: str) -> list[tuple]:
    """Per region: results of a share of a cell's draws if its patterns are all here; their sums if there are more blocks.

    A draw does not depend on the region, so it is made once, and regions that hold the same trials share one product."""
    trial = np.asarray(r["t"], dtype=np.int64)
    y, is_train, is_test = (np.asarray(r[c]) for c in ("y", "is_train", "is_test"))
    together: dict[bytes, tuple] = {}
    for roi, (own, x) in regions.items():
        at = np.minimum(np.searchsorted(own, trial), len(own) - 1)
        here = own[at] == trial
        together.setdefault(here.tobytes(), (here, []))[1].append((roi, x[at[here]]))
    stacks = [(here, [roi for roi, _ in of], np.concatenate([x for _, x in of], axis=1), np.cumsum([0, *[x.shape[1] for _, x in of]]))
              for here, of in together.values()]
    whole = r["__k"] == 1
    every, shares = plan.permutations + 1, min(SHARES, plan.permutations + 1)
    start, stop = (every * p // shares for p in (r["__p"], r["__p"] + 1))
    step = max(1, STEP // max(1, plan.each * 2 * (plan.train + plan.test) * len(trial)))
    found: dict = {roi: [] for roi in regions}
    for first in range(start, stop, step):
        some = range(first, min(first + step, stop))
        slots = plan.slots(some, where, trial, y, is_train.astype(bool), is_test.astype(bool))
        number = first * plan.each + np.arange(len(slots))
        for here, rois, x, ends in stacks:
            n, sums, squares = group_sums(slots if here.all() else slots[:, here], x, plan.train, plan.test)
            for i, roi in enumerate(rois):
                s, q = (v[:, :, ends[i]:ends[i + 1]] for v in (sums, squares))
                found[roi].append(_counted(number, score(n, s, q, plan, scorer), plan, per_draw) if whole else pd.DataFrame(
                    {"number": number, "n": list(n), "s": list(s.reshape(len(s), -1)), "q": list(q.reshape(len(q), -1))}))
    return [(roi, _filled(pd.concat(parts, ignore_index=True))) for roi, parts in found.items()]


def _filled(out: pd.DataFrame) -> pd.DataFrame:
    for c in [*COUNTS, "share", "n_draws", "n", "s", "q"]:
        if c not in out:
            out[c] = None
    return out


def _counted(number: np.ndarray, counts: np.ndarray, plan: Within | Across, per_draw: bool) -> pd.DataFrame:
    """Counts and summed accuracies per draw, or added up per permutation."""
    scored = counts[:, 1] > 0
    share = np.where(scored, counts[:, 0] / np.maximum(counts[:, 1], 1), 0.0)
    if not per_draw:
        number, at = np.unique(number // plan.each, return_index=True)
        counts, share, scored = (np.add.reduceat(v, at, axis=0) for v in (counts, share, scored.astype(np.int64)))
    out = pd.DataFrame(counts, columns=COUNTS)
    out["number"], out["share"], out["n_draws"] = number.astype(np.int32), share, scored.astype(np.int64)
    return out


def _united(found: DataFrame, cell: list[str], plan: Within | Across, scorer: str, per_draw: bool) -> DataFrame:
    """Adds the blocks of each draw, scores them, and adds the draws of each permutation."""
    counts = [*COUNTS, "share", "n_draws"]
    cut = found.filter("n IS NOT NULL").withColumn("__together", F.floor(F.col("number") / TOGETHER))
    schema = ", ".join(f"`{c}` {t}" for c, t in found.select(*cell, "number", *counts).dtypes)

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number, of = np.unique(pdf["number"].to_numpy(), return_inverse=True)
        sums = []
        for c in ("n", "s", "q"):
            v = np.stack(pdf[c].to_numpy())
            total = np.zeros((len(number), v.shape[1]), dtype=v.dtype)
            np.add.at(total, of, v)
            sums.append(total)
        n, s, q = sums
        out = _counted(number, score(n, s.reshape(*n.shape, -1), q.reshape(len(n), 2, -1), plan, scorer), plan, True)
        if not per_draw:
            out["number"] //= plan.each
            out = out.groupby("number", as_index=False).sum()
        for c, v in zip(cell, key):
            out[c] = v
        return out[[*cell, "number", *counts]]

    every = found.filter("n IS NULL").select(*cell, "number", *counts).unionByName(
        cut.groupBy(*cell, "__together").applyInPandas(add, schema))
    total = every.groupBy(*cell, "number").agg(*[F.sum(c).alias(c) for c in counts])
    return total.select(*cell, F.col("number").alias("draw" if per_draw else "permutation"), *COUNTS,
                        (F.col("share") / F.nullif(F.col("n_draws"), F.lit(0))).alias("accuracy"), "n_draws")
