"""Does whitening leak? The same folds without it, with a covariance from all trials, and from training trials only.

Whitening is linear, so no whitened pattern is made: counts, means and scatter matrices of each (fold, class) give
the moments of the whitened training rows of every fold by subtraction, and the weights in whitened space are
carried back through the root, so that test rows are scored by one product with their own patterns. A unit's
patterns are read once for all arms, contrasts and folds. The matrices are trials x trials or features x
features, whichever is smaller."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxtrail.operators import linmodel as L, units as U

ARMS = ("none", "all_trials", "train_only")
BLOCK = 1 << 28  # bytes of a unit, which is whole in one task


class Root:
    """Inverse root of the shrunk covariance of residual rows, applied without being written out."""

    def __init__(self, r: np.ndarray):
        self.r = r
        if len(r) <= r.shape[1]:
            self.scale, self.inner, _ = L.root_factors(r @ r.T, r.shape[1])
        else:
            self.matrix = root_matrix(r)

    def times(self, x: np.ndarray) -> np.ndarray:
        """Rows of x times the root."""
        if len(self.r) <= self.r.shape[1]:
            return self.scale * x + ((x @ self.r.T) @ self.inner) @ self.r
        return x @ self.matrix


def root_matrix(r: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    n, p = r.shape
    g, lengths = r.T @ r, (r * r).sum(axis=1)
    mu, norm = lengths.sum() / n / p, (g * g).sum() / (n * n)
    beta = ((lengths * lengths).sum() / n - norm) / (p * n)
    delta = (norm - 2 * mu * lengths.sum() / n + p * mu * mu) / p
    shrinkage = max(0.0, min(beta, delta) / delta) if delta > 0 else 0.0
    val, vec = np.linalg.eigh((1 - shrinkage) * g / n + shrinkage * mu * np.eye(p))
    return (vec * np.clip(val, floor, None) ** -0.5) @ vec.T


def _weights(c: U.Cell, rows: np.ndarray, root: Root | None, shrinkage: float) -> tuple[np.ndarray, float] | None:
    """Weights on the patterns themselves, and the offset, of the separable scorer in whitened space."""
    x, y = c.x[rows], c.y[rows]
    n = np.array([(y == k).sum() for k in (0, 1)], dtype=np.float64)
    if n.min() < 2:
        return None
    mean = np.stack([x[y == k].mean(axis=0) for k in (0, 1)])
    r = x - mean[y]
    if root is not None:
        mean, r = root.times(mean), root.times(r)
    q = np.stack([(r[y == k] ** 2).sum(axis=0) for k in (0, 1)])
    w, b = U.weights(np.repeat(n[None, :, None], mean.shape[1], axis=2), mean[None], q[None], "lda", shrinkage)
    used = np.isfinite(w[0])
    if not used.any():
        return None
    w, b = np.where(used, w[0], 0.0), float(b[0][used].sum())
    return (root.times(w[None])[0] if root is not None else w), b  # the root is symmetric


def arms(u: U.Units, conditions: str = "condition", shrinkage: float = 0.1) -> DataFrame:
    """Hits, scored and all test rows and accuracy per arm, cell and fold.

    The patterns carry ``conditions``: residuals are taken about the condition's mean, over all trials of the unit for
    ``all_trials``, over the training trials of the contrast and fold for ``train_only``. Missing
    features are read as the unit's mean."""
    if u.cut:
        raise ValueError(f"a unit is whole in one task here; one exceeds {BLOCK} bytes")
    schema = u.schema("arm string", "fold bigint", *[f"{c} bigint" for c in U.COUNTS])

    def whole(left: pd.DataFrame, r: dict) -> pd.DataFrame:
        c = U.opened(left, r)
        c.there[:] = 1
        every = getattr(left, "_root", None)
        if every is None:
            every = Root(L.residual_rows(left._matrix[0], left[conditions].to_numpy()))
            object.__setattr__(left, "_root", every)  # once for all contrasts and folds
        condition = left[conditions].to_numpy()[c.rows]
        out = []
        for arm in ARMS:
            score, at = [], []
            for f, fold in enumerate(c.folds):
                train, test = np.flatnonzero(c.is_train & (c.fold != fold)), np.flatnonzero(c.is_test & (c.fold == fold))
                root = {"none": lambda: None, "all_trials": lambda: every,
                        "train_only": lambda: Root(L.residual_rows(c.x[train], condition[train])) if len(train) else None}[arm]()
                m = _weights(c, train, root, shrinkage)
                score.append(c.x[test] @ m[0] + m[1] if m else np.full(len(test), np.nan))
                at.append(test)
            rows = np.concatenate(at)
            found = U.counted(c.folds, np.searchsorted(c.folds, c.fold[rows]), np.concatenate(score), c.y[rows])
            found["arm"] = arm
            out.append(found)
        return pd.concat(out, ignore_index=True)

    return u.run(whole, schema).withColumn("accuracy", F.col("n_correct") / F.nullif(F.col("n_scored"), F.lit(0)))
