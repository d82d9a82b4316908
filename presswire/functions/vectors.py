"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))


def cosine_similarity(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """Cosine of two equally long vectors; NULL for a zero vector or unequal lengths."""
    right_norm = norm(b) if b_norm is None else b_norm
    cosine = F.try_divide(dot(a, b), norm(a) * right_norm)
    return F.when(F.size(a) == F.size(b), cosine)
