"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, zero_norm: str = "zero") -> Column:
    """Cosine similarity; a zero vector gives 0, or with zero_norm "eps" the quotient by norms + 1e-10."""
    if zero_norm == "eps":
        return dot(a, b) / (norm(a) * norm(b) + 1e-10)
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
