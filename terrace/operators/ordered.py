"""Ordered scans over a key that stay parallel when one key holds most of the rows.

A window over (key ORDER BY ts) sorts all rows of a key in one task. `ordered_scan` measures the
largest key first. Keys below the limit use the plain window. Rows of larger keys are range-partitioned
on (key, order), so one key spreads over many slices; each slice is scanned alone and one summary row
per (key, slice) carries values across slice borders. The result is the same for any limit.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.columns import all_of, col
from terrace.session import durable

HOT_ROWS = 4_000_000


def _null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str], prefix: str, how: str) -> DataFrame:
    renamed = other.select(
        *[F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)],
        *[c for c in other.columns if c not in keys],
    )
    cond = all_of([df[k].eqNullSafe(renamed[f"{prefix}{i}"]) for i, k in enumerate(keys)])
    joined = df.join(renamed, cond, how)
    return joined.drop(*[f"{prefix}{i}" for i in range(len(keys))])


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key: one partially aggregated pass over the key columns."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def split_hot(
    df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, biggest: int | None = None
) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows of ordinary keys, rows of hot keys or None, number of hot rows).

    `biggest`, an upper bound of the largest group if the caller knows one, saves the measuring pass.
    """
    if biggest is None:
        biggest = largest_group(df, keys)
    if biggest <= hot_rows:
        return df, None, 0
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    # Stored once: both halves must agree on which keys are hot.
    hot = durable(counts)
    n_hot = hot.agg(F.sum("_n")).first()[0]
    if not n_hot:
        return df, None, 0
    keys_only = hot.select(*keys)
    return (
        _null_safe(df, keys_only, keys, "_h", "left_anti"), _null_safe(df, keys_only, keys, "_h", "left_semi"), int(n_hot),
    )


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    lead: Mapping[str, str | Column] | None = None,
    lag: Mapping[str, str | Column] | None = None,
    carry: Mapping[str, str | Column] | None = None,
    running: Mapping[str, str | Column] | None = None,
    index: str | None = None,
    hot_rows: int = HOT_ROWS,
    biggest: int | None = None,
) -> DataFrame:
    """Add per-key ordered columns; `order` must be a total, ascending order of columns.

    lead / lag: value on the next / previous row. carry: newest non-null value up to this row.
    running: sum up to this row. index: 1-based position.
    """
    sums = {k: col(v) for k, v in (running or {}).items()}
    if index:
        sums[index] = F.lit(1).cast("bigint")
    spec = (
        {k: col(v) for k, v in (lead or {}).items()},
        {k: col(v) for k, v in (lag or {}).items()},
        {k: col(v) for k, v in (carry or {}).items()},
        sums,
    )
    cold, hot, n_hot = split_hot(df, keys, hot_rows, biggest)
    plain = _scan_whole(cold, keys, order, spec)
    if hot is None:
        return plain
    slices = max(2, math.ceil(2 * n_hot / hot_rows))
    return plain.unionByName(_scan_slices(hot, keys, order, spec, slices))


def _inner(df: DataFrame, part: Sequence[str], order: Sequence[str], spec) -> DataFrame:
    leads, lags, carries, sums = spec
    w = Window.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {}
    if leads:
        new["_lead"] = F.lead(F.struct(*[v.alias(k) for k, v in leads.items()])).over(w)
    if lags:
        new["_lag"] = F.lag(F.struct(*[v.alias(k) for k, v in lags.items()])).over(w)
    new |= {k: F.last(v, ignorenulls=True).over(upto) for k, v in carries.items()}
    new |= {k: F.sum(v).over(upto) for k, v in sums.items()}
    return df.withColumns(new)


def _unpack(df: DataFrame, spec) -> DataFrame:
    leads, lags, _, _ = spec
    out = {k: F.col("_lead").getField(k) for k in leads} | {k: F.col("_lag").getField(k) for k in lags}
    return df.withColumns(out).drop("_lead", "_lag") if out else df


def _scan_whole(df: DataFrame, keys, order, spec) -> DataFrame:
    return _unpack(_inner(df, keys, order, spec), spec)


def _scan_slices(df: DataFrame, keys, order, spec, slices: int) -> DataFrame:
    leads, lags, carries, sums = spec
    # The slice number must be a stored value: a recomputed range partition may cut elsewhere.
    sliced = durable(
        df.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    place = F.struct(*[F.col(o) for o in order])
    aggs, shifted = [F.count(F.lit(1)).alias("_rows")], []
    ws = Window.partitionBy(*keys).orderBy("_slice")
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    if leads:
        first = F.struct(*[v.alias(k) for k, v in leads.items()])
        aggs.append(F.min_by(first, place).alias("_first"))
        shifted.append(F.lead("_first").over(ws).alias("_lead_edge"))
    if lags:
        last = F.struct(*[v.alias(k) for k, v in lags.items()])
        aggs.append(F.max_by(last, place).alias("_last"))
        shifted.append(F.lag("_last").over(ws).alias("_lag_edge"))
    for k, v in carries.items():
        aggs.append(F.max_by(v, F.when(v.isNotNull(), place)).alias(f"_c_{k}"))
        shifted.append(F.last(f"_c_{k}", ignorenulls=True).over(before).alias(f"_pc_{k}"))
    for k, v in sums.items():
        aggs.append(F.sum(v).alias(f"_s_{k}"))
        shifted.append(F.sum(f"_s_{k}").over(before).alias(f"_ps_{k}"))
    edges = sliced.groupBy(*keys, "_slice").agg(*aggs).select(*keys, "_slice", *shifted)
    joined = _null_safe(
        _inner(sliced, [*keys, "_slice"], order, spec), edges, [*keys, "_slice"], "_e", "left"
    )
    fix = {}
    if leads:
        fix["_lead"] = F.coalesce("_lead", "_lead_edge")
    if lags:
        fix["_lag"] = F.coalesce("_lag", "_lag_edge")
    fix |= {k: F.coalesce(F.col(k), F.col(f"_pc_{k}")) for k in carries}
    # A running sum is NULL only while every value so far is NULL, as in the plain window.
    fix |= {
        k: F.when(F.col(k).isNull(), F.col(f"_ps_{k}"))
        .when(F.col(f"_ps_{k}").isNull(), F.col(k))
        .otherwise(F.col(k) + F.col(f"_ps_{k}"))
        for k in sums
    }
    out = _unpack(joined.withColumns(fix), spec)
    extra = [c for c in out.columns if c == "_slice" or c.endswith("_edge") or c[:4] in ("_pc_", "_ps_")]
    return out.drop(*extra)


def with_group_totals(
    df: DataFrame,
    keys: Sequence[str],
    totals: Mapping[str, Column],
    hot_rows: int = HOT_ROWS,
    biggest: int | None = None,
) -> DataFrame:
    """Add group aggregates to each row: one shuffled window for ordinary groups, a pre-aggregated
    join for groups too large for one task."""
    cold, hot, _ = split_hot(df, keys, hot_rows, biggest)
    w = Window.partitionBy(*keys)
    plain = cold.withColumns({name: agg.over(w) for name, agg in totals.items()})
    if hot is None:
        return plain
    sums = hot.groupBy(*keys).agg(*[agg.alias(name) for name, agg in totals.items()])
    return plain.unionByName(_null_safe(hot, sums, keys, "_g", "left"))
