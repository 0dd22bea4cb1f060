"""Dense vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """ab / sqrt(aa bb); null if either is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def scale_each(a: Column, by: Column) -> Column:
    return F.zip_with(a, by, lambda x, y: x * y)


def unit(a: Column) -> Column:
    """a over its length; a zero vector stays zero."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.coalesce(F.try_divide(x, n), x)))[0]


def truncate(a: Column, dim: int) -> Column:
    if dim < 1:
        raise ValueError("dim must be at least 1")
    return F.slice(a, 1, dim)


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimals, half away from zero; the sign stays, of zeros too, and what isn't finite stays."""
    many = F.abs(x) * F.lit(10.0**digits)
    return F.when(many < float("inf"), F.signum(x) * (F.round(many) / F.lit(10.0**digits))).otherwise(x)
