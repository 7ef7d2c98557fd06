"""Vector math on ARRAY columns, F6-F10 (all JVM-side higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    """inner product in double precision."""
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def sq_norm(a) -> Column:
    return _sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")))


def l2_norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def l2_normalize(a) -> Column:
    """unit-length copy; a zero vector becomes NULL."""
    n = l2_norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n))


def l2_distance(a, b) -> Column:
    """F8: Euclidean distance."""
    return F.sqrt(_sum(F.zip_with(_c(a), _c(b),
                                  lambda x, y: (x.cast("double") - y.cast("double"))
                                  * (x.cast("double") - y.cast("double")))))


def cosine(a, b) -> Column:
    """cosine similarity; NULL when either side is a zero vector."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def relu(x) -> Column:
    """F10."""
    return F.greatest(_c(x), F.lit(0.0))


def sigmoid(x) -> Column:
    """F10."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))
