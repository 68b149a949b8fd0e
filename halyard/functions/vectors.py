"""Dense vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(c: Column, low: float, high: float) -> Column:
    """c within [low, high]; null for null (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def dot(a, b, dimensions: int | None = None) -> Column:
    """Written out for a known number of dimensions, which compiles; else by higher-order functions, which are interpreted."""
    if dimensions:
        a, b = _c(a), _c(b)
        return sum((a[i] * b[i] for i in range(1, dimensions)), a[0] * b[0])
    return F.aggregate(F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a, dimensions: int | None = None) -> Column:
    return F.sqrt(dot(a, a, dimensions))


def normalized(a, least: float = 1e-8) -> Column:
    """The unit vector; raises on vectors that are not finite or shorter than `least`."""
    a = _c(a).cast("array<double>")
    bad = F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) | (norm(a) <= least)
    checked = F.when(bad, F.raise_error(F.lit("vector is not finite or has no length")).cast("array<double>")).otherwise(a)
    return F.when(a.isNotNull(), F.transform(checked, lambda x: x / norm(a)))


def cosine(a, b) -> Column:
    """Cosine clipped to [-1, 1]."""
    return clip(dot(a, b) / (norm(a) * norm(b)), -1.0, 1.0)


def hash_vector(high, low) -> Column:
    """A 64-bit hash as 64 numbers of +-1/8, the least bit first; a missing hash counts as 0."""
    one = F.lit(1).cast("long")
    return F.array(*[F.when(F.shiftright(F.coalesce(_c(half), F.lit(0).cast("long")), i).bitwiseAND(one) == 1, 0.125).otherwise(-0.125) for half in (low, high) for i in range(32)])
