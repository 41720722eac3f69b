"""Statistical expressions over already aggregated columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)


def _cos_power_integral(lo: Column, hi: Column, power: Column) -> Column:
    """Integral of cos(u)**power on [lo, hi] by fixed Gauss-Legendre nodes."""
    rule = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w"))
                     for x, w in zip(_NODES, _WEIGHTS)])
    half, mid = (hi - lo) / 2, (hi + lo) / 2

    def step(acc, n):
        return acc + n["w"] * F.exp(power * F.log(F.cos(mid + half * n["x"])))

    return half * F.aggregate(rule, F.lit(0.0), step)


def _t_upper_share(t: Column, df: Column) -> Column:
    """P(|T| > |t|). With u = atan(T / sqrt(df)) the density is cos(u)**(df-1), so the
    tail is a ratio of two smooth integrals; the cost does not grow with df and small
    tails keep their relative precision. The range stops where the integrand is spent."""
    t, df = t.cast("double"), df.cast("double")
    reach = F.lit(9.5) / F.sqrt(df)
    start = F.atan(F.abs(t) / F.sqrt(df))
    end = F.lit(math.pi / 2)
    return (_cos_power_integral(start, F.least(end, start + reach), df - 1)
            / _cos_power_integral(F.lit(0.0), F.least(end, reach), df - 1))


def t_two_sided(t: Column, df: Column) -> Column:
    return F.when((df >= 1) & t.isNotNull(),
                  F.when(F.abs(t) == float("inf"), F.lit(0.0))
                  .otherwise(F.least(F.lit(1.0), _t_upper_share(t, df))))


def t_greater(t: Column, df: Column) -> Column:
    half = t_two_sided(t, df) / 2
    return F.when(t >= 0, half).otherwise(1 - half)


def sd_pop(x: Column) -> Column:
    """SD (ddof=0) as an aggregate, exactly 0 where all values are equal: the means of parts that are merged may
    differ in their last bit, which leaves ``stddev_pop`` of a constant above 0."""
    return F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(F.stddev_pop(x))


def sem(sd: Column, n: Column) -> Column:
    return F.when(n >= 2, sd / F.sqrt(n))


def one_sample_t(mean: Column, sd: Column, n: Column, mu: float = 0.0) -> Column:
    """NULL below two rows or without variance."""
    return F.when((n >= 2) & (sd > 0), (mean - mu) / (sd / F.sqrt(n)))


def cohens_d(ma, va, na, mb, vb, nb, floor: float = 1e-10) -> Column:
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))
    return F.when((na >= 2) & (nb >= 2) & (pooled >= floor), (ma - mb) / pooled)


def pooled_t(ma, va, na, mb, vb, nb) -> Column:
    pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    return F.when((na >= 2) & (nb >= 2) & (pooled > 0),
                  (ma - mb) / F.sqrt(pooled * (1 / na + 1 / nb)))


def pearson_p(r: Column, n: Column) -> Column:
    t = r * F.sqrt((n - 2) / (1 - r * r))
    return F.when(n >= 3, F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_two_sided(t, n - 2)))


def fisher_z(r: Column, limit: float = 0.999999) -> Column:
    return F.atanh(F.greatest(F.lit(-limit), F.least(F.lit(limit), r)))
