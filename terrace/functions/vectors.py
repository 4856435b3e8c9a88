"""Vector expressions over array columns (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.functions.columns import col


def dot(a: str | Column, b: str | Column) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: str | Column, b: str | Column) -> Column:
    """Cosine of the angle; NULL when either vector has zero length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)
