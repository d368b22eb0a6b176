"""Vector expressions on array columns; JVM-side, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalised(v: Column | str) -> Column:
    """The vector over its length; a tiny addend keeps the zero vector zero."""
    v = _col(v)
    return F.transform(v, lambda x: x / (norm(v) + F.lit(EPSILON)))


def least_of(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: F.least(x, y))


def sigmoid(x: Column) -> Column:
    """Stable on both sides: no exponential of a large positive number."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
