"""Numeric array expressions (whole feature vectors in one row)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once per row and hands it to ``body``.

    Inside a lambda an outer expression would be evaluated again for every element, which
    makes e.g. centring quadratic in the vector length."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_double(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def sum_squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def centre(a: Column) -> Column:
    return let(mean(a), lambda m: F.transform(a, lambda x: x - m))


def norm(a: Column) -> Column:
    return F.sqrt(sum_squares(a))


def sd_pop(a: Column) -> Column:
    return norm(centre(a)) / F.sqrt(F.size(a))


def _scaled(c: Column, by: Callable[[Column], Column], flat: float | None) -> Column:
    return let(by(c), lambda s: F.transform(c, lambda x: F.when(s > 0, x / s).otherwise(F.lit(flat))))


def zscore(a: Column) -> Column:
    """ddof=0 z-score; a constant vector becomes zero everywhere."""
    return let(centre(a), lambda c: _scaled(c, lambda v: norm(v) / F.sqrt(F.size(v)), 0.0))


def unit(a: Column) -> Column:
    """Centred and scaled to length one; NULL for a constant vector."""
    return let(centre(a), lambda c: let(norm(c), lambda n: F.when(n > 0, F.transform(c, lambda x: x / n))))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def corr(a: Column, b: Column, min_valid: int = 2) -> Column:
    """Pearson r over positions finite in both; NULL below ``min_valid`` positions."""
    z = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
                 lambda p: finite(p["x"]) & finite(p["y"]))

    def r(v):
        return let(F.struct(centre(F.transform(v, lambda p: p["x"])).alias("x"),
                            centre(F.transform(v, lambda p: p["y"])).alias("y")),
                   lambda c: let(norm(c["x"]) * norm(c["y"]),
                                 lambda d: F.when(d > 0, dot(c["x"], c["y"]) / d)))
    return let(z, lambda v: F.when(F.size(v) >= min_valid, r(v)))
