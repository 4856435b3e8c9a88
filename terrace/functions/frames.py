"""Helpers that put small result frames together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Single-row aggregates with different columns as one row: stacked and collapsed, not joined."""
    out = one_row[0]
    for df in one_row[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])
