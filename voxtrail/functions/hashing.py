"""Hashes that any SQL engine can repeat, for folds, shuffles and draws."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PRIME = 2147483647  # 2**31 - 1


def _cols(parts):
    return [p if isinstance(p, Column) else F.lit(p) for p in parts]


def digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in _cols(parts)]))


def hash32(*parts) -> Column:
    """Unsigned 32-bit hash of the parts, as BIGINT."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")


def poly_seed(*parts) -> Column:
    """Four coefficients below PRIME taken from one digest."""
    d = digest(*parts)
    return F.array(*[F.conv(F.substring(d, 1 + 8 * i, 8), 16, 10).cast("bigint") % PRIME
                     for i in range(4)])


def poly_hash(seed: Column, x: Column) -> Column:
    """Cubic polynomial hash modulo PRIME: four-wise independent, plain integer arithmetic."""
    x = x.cast("bigint") % PRIME
    acc = F.get(seed, F.lit(3))
    for i in (2, 1, 0):
        acc = (acc * x + F.get(seed, F.lit(i))) % PRIME
    return acc
