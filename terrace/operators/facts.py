"""Fact builders: star loads, marts, snapshots, bridges, currency, drill-across."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.columns import date_key, dbl, money
from terrace.functions.frames import side_by_side
from terrace.operators.ordered import HOT_ROWS, largest_group, ordered_scan, with_group_totals
from terrace.operators.temporal import pit_join

ITEMS_PER_ROW = 10_000


def fact_incremental(
    existing: DataFrame | None,
    source: DataFrame,
    fact_key: Sequence[str],
    lookups: Sequence[tuple[DataFrame, str, str, str, object]] = (),
) -> DataFrame:
    """Rows to append: unseen fact keys with surrogate keys resolved.

    lookups: (dimension, its key, source column, surrogate column, value for unknown members).
    The anti join comes first, so only new rows are looked up.
    """
    fresh = source if existing is None else source.join(existing.select(*fact_key), list(fact_key), "left_anti")
    for dim, key, source_col, sk, unknown in lookups:
        small = dim.select(F.col(key).alias("_dk"), F.col(sk))
        fresh = fresh.join(small, F.col(source_col) == F.col("_dk"), "left").drop("_dk")
        fresh = fresh.withColumn(sk, F.coalesce(F.col(sk), F.lit(unknown)))
    return fresh


def late_arriving_bind(
    late: DataFrame, fact_key: str, fact_ts: str, versions: DataFrame, key: str, values: Sequence[str], most: int | None = None
) -> DataFrame:
    """Late facts take the version valid when they happened; `bound_to_past` tells those that would
    have got another version had they been joined to the current state."""
    bound = pit_join(late, fact_key, fact_ts, versions, key, [*values, "is_current"], most=most)
    return bound.withColumn("bound_to_past", F.coalesce(~F.col("is_current"), F.lit(False)))


def obt_mart(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """One wide table: the fact with every dimension's columns, so later queries need no join."""
    wide = fact
    for dim, left, right in dims:
        wide = wide.join(dim, F.col(left) == F.col(right), "left")
        if left != right:
            wide = wide.drop(right)
    return wide


def _items(order: Sequence[str], item: Sequence[str]) -> Column:
    """The item structs of a group in the given order, ties by the items themselves."""
    entry = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*item).alias("_item"))
    return F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["_item"])


def nested_mart(lines: DataFrame, key: str, order: Sequence[str], item: Sequence[str]) -> DataFrame:
    """One row per header with `items array<struct>`, whatever its number of items. A header whose items do not
    fit into one row wants `nested_mart_chunks`."""
    return lines.groupBy(key).agg(_items(order, item).alias("items"))


def nested_mart_chunks(
    lines: DataFrame, key: str, order: Sequence[str], item: Sequence[str], items_per_row: int = ITEMS_PER_ROW,
    hot_rows: int = HOT_ROWS, biggest: int | None = None,
) -> DataFrame:
    """Rows of (header, chunk_no) with at most `items_per_row` items each: chunk_no 0, 1, ... in the given order,
    so that no item is lost and no array grows without bound."""
    placed = ordered_scan(lines, [key], order, index="_pos", hot_rows=hot_rows, biggest=biggest)
    chunked = placed.withColumn("chunk_no", F.floor((F.col("_pos") - 1) / items_per_row).cast("int"))
    return chunked.groupBy(key, "chunk_no").agg(_items(["_pos"], item).alias("items"))


def unnest_items(mart: DataFrame, key: str) -> DataFrame:
    return mart.select(key, F.inline("items"))


def unnest_revenue(quantity: str, price: str) -> Column:
    """Revenue of an items array without exploding it."""
    zero = F.lit(0).cast("decimal(38,4)")
    return F.aggregate(
        "items", zero, lambda acc, x: (acc + money(x[quantity]) * money(x[price])).cast("decimal(38,4)")
    )


def accumulating_snapshot(
    events: DataFrame, key: str, type_col: str, ts: str, milestones: Mapping[str, str], lags: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """One row per process with the first time of each milestone {column: event type} and day lags
    {column: (from milestone, to milestone)}. One aggregate, no self-joins."""
    firsts = [F.min(F.when(F.col(type_col) == typ, F.col(ts))).alias(name) for name, typ in milestones.items()]
    row = events.groupBy(key).agg(*firsts)
    return row.withColumns({name: F.datediff(b, a) for name, (a, b) in lags.items()})


def funnel_conversion(snapshot: DataFrame, stages: Sequence[str], lags: Sequence[str] = ()) -> DataFrame:
    """Entities per stage, conversion in percent of the previous stage, and average lags."""
    aggs = [F.count(s).alias(f"{s}_count") for s in stages]
    for a, b in zip(stages, stages[1:]):
        both = F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())
        aggs.append((both * 100.0 / F.nullif(F.count(a), F.lit(0))).alias(f"{a}_to_{b}_pct"))
    aggs += [(F.sum(c) / F.count(c)).alias(f"avg_{c}") for c in lags]
    return snapshot.agg(*aggs)


def month_start(ts: str) -> Column:
    return F.trunc(F.col(ts), "month")


def periodic_snapshot(flows: DataFrame, entity: str, ts: str, amount: Column) -> DataFrame:
    """Entity x month grain from each entity's first month to the last month of the data, with the
    month's flow and the balance carried forward through months without activity.

    Flows are summed per entity and month first; afterwards an entity has one row per calendar month, so
    its window is short however many rows it had. Each active month then repeats itself up to the month
    before the next active one: no calendar is joined.
    """
    monthly = flows.groupBy(F.col(entity), month_start(ts).alias("_m")).agg(F.sum(amount).alias("_flow"))
    last = flows.agg(F.max(month_start(ts))).first()[0]
    w = Window.partitionBy(entity).orderBy("_m")
    active = monthly.withColumns({"balance": F.sum("_flow").over(w), "_next": F.lead("_m").over(w)})
    until = F.coalesce(F.add_months("_next", -1), F.lit(last))
    filled = active.withColumn("month", F.explode(F.sequence("_m", until, F.expr("interval 1 month"))))
    flow = F.when(F.col("month") == F.col("_m"), F.col("_flow")).otherwise(F.lit(0))
    return filled.select(entity, "month", flow.alias("flow"), "balance")


def closing_balance(snapshot: DataFrame, account: str, date: str, balance: str, period: Column) -> DataFrame:
    """Semi-additive: last balance of each account inside a period, then summed over accounts."""
    last = snapshot.groupBy(period.alias("period"), F.col(account)).agg(F.max_by(balance, date).alias("_b"))
    return last.groupBy("period").agg(
        F.sum("_b").alias("closing_balance"), F.count(F.lit(1)).alias("account_count")
    )


def cross_section_sum(snapshot: DataFrame, on_date: Column, balance: str, by: Sequence[str] = ()) -> DataFrame:
    """Additive across accounts on one date."""
    return snapshot.filter(on_date).groupBy(*by).agg(F.sum(balance).alias("total_balance"))


def rollup_table(fact: DataFrame, grain: Mapping[str, Column], measures: Mapping[str, Column]) -> DataFrame:
    keys = [c.alias(n) for n, c in grain.items()]
    return fact.groupBy(*keys).agg(
        *[F.sum(c).alias(n) for n, c in measures.items()], F.count(F.lit(1)).alias("row_count")
    )


def rollup_parity(rollup: DataFrame, base: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """Totals of the rollup and of its base fact, and their difference: one row per measure."""
    out = None
    for name, c in {**measures, "row_count": F.lit(1)}.items():
        r = rollup.agg(F.sum(name).alias("rollup_total"))
        b = base.agg(F.sum(c).alias("base_total"))
        one = side_by_side(r, b).select(
            F.lit(name).alias("measure"),
            dbl("rollup_total").alias("rollup_total"),
            dbl("base_total").alias("base_total"),
            dbl(F.col("rollup_total") - F.col("base_total")).alias("difference"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def aggregate_navigation(
    wanted: Mapping[str, Column], rollups: Sequence[tuple[DataFrame, Sequence[str]]], base: DataFrame,
    measures: Mapping[str, Column],
) -> DataFrame:
    """Sum measures at the wanted grain from the first rollup whose grain holds it, else from the base.
    Additive measures give the same answer either way. `wanted` maps grain names to base expressions."""
    for rollup, grain in rollups:
        if set(wanted) <= set(grain) and set(measures) <= set(rollup.columns):
            return rollup.groupBy(*wanted).agg(*[F.sum(m).alias(m) for m in measures])
    keys = [c.alias(n) for n, c in wanted.items()]
    return base.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in measures.items()])


def ratio_of_sums(df: DataFrame, by: Sequence[str], num: Column, den: Column, name: str) -> DataFrame:
    """A non-additive measure from its additive parts; never an average of ratios."""
    return df.groupBy(*by).agg((dbl(F.sum(num)) / F.nullif(dbl(F.sum(den)), F.lit(0.0))).alias(name))


def factless_fact(df: DataFrame, grain: Mapping[str, Column]) -> DataFrame:
    """One row per occurrence of the composite grain, without measures."""
    return df.select(*[c.alias(n) for n, c in grain.items()]).distinct()


def coverage_gap(coverage: DataFrame, occurrences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What was covered but did not happen."""
    return coverage.join(occurrences.select(*keys).distinct(), list(keys), "left_anti")


def allocate(
    df: DataFrame, group: str, member: Sequence[str], share: Column, total: Column, name: str, scale: int,
    hot_rows: int = HOT_ROWS, biggest: int | None = None,
) -> DataFrame:
    """Split `total` over the members of a group in proportion to `share`, rounded to `scale` digits;
    the rounding residue goes to the largest member, so the parts add up to the total exactly.
    `member` identifies a row inside its group; a group without any share puts all on one row."""
    kind = f"decimal(20,{scale})"
    if biggest is None:
        biggest = largest_group(df, [group])
    rows = df.withColumns({"_share": share, "_total": total.cast(kind)})
    rank = F.struct(F.col("_share"), *member)
    sums = with_group_totals(
        rows, [group], {"_sum": F.sum("_share"), "_top": F.max_by(F.struct(*member), rank)}, hot_rows, biggest
    )
    part = F.when(dbl("_sum") != 0, (dbl("_total") * dbl("_share") / dbl("_sum")).cast(kind)).otherwise(F.lit(0).cast(kind))
    parts = with_group_totals(
        sums.withColumn(name, part), [group], {"_parts": F.sum(name)}, hot_rows, biggest
    )
    is_top = F.struct(*member).eqNullSafe(F.col("_top"))
    fixed = F.when(is_top, F.col(name) + F.col("_total") - F.col("_parts")).otherwise(F.col(name)).cast(kind)
    return parts.withColumn(name, fixed).drop("_share", "_total", "_sum", "_top", "_parts")


def apportion(
    df: DataFrame, group: str, member: Sequence[str], share: Column, total: Column, name: str, scale: int,
    share_scale: int = 2, hot_rows: int = HOT_ROWS, biggest: int | None = None,
) -> DataFrame:
    """Split `total` over the members of a group by largest remainders, in whole units of `scale` digits and without floating point.
    Each member gets its quota rounded down; the units left go one each to the largest remainders, ties to the larger share, then to
    the smaller `member` (which identifies a row inside its group). Shares (at least 0; null counts as 0) and totals take up to 18 digits
    in their own units. A negative total is split like its absolute value; a group without any share is split equally; a null
    total gives null parts."""
    units, whole = "decimal(18,0)", "decimal(20,0)"
    if biggest is None:
        biggest = largest_group(df, [group])
    rows = df.withColumns({
        "_w": F.coalesce((share * F.lit(10**share_scale)).cast(units), F.lit(0).cast(units)), "_t": (total * F.lit(10**scale)).cast(units),
    })
    sums = with_group_totals(rows, [group], {"_sum": F.sum("_w"), "_n": F.count(F.lit(1))}, hot_rows, biggest)
    sums = sums.withColumns({
        "_w": F.when(F.col("_sum") > 0, F.col("_w")).otherwise(F.lit(1)).cast(units),
        "_sum": F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(F.col("_n")).cast(whole), "_u": F.abs("_t").cast(units),
    })
    quota = sums.withColumns({
        "_q": F.expr("(_u * _w) div _sum").cast(units), "_behind": F.expr("-((_u * _w) % _sum)").cast(whole), "_less": F.expr("-_w"),
    })
    left = with_group_totals(quota, [group], {"_given": F.sum("_q")}, hot_rows, biggest)
    placed = ordered_scan(left, [group], ["_behind", "_less", *member], index="_place", hot_rows=hot_rows, biggest=biggest)
    part = F.col("_q") + F.when(F.col("_place") <= F.col("_u") - F.col("_given"), 1).otherwise(0)
    signed = F.when(F.col("_t") < 0, -part).when(F.col("_t").isNotNull(), part).cast(whole)
    out = placed.withColumn(name, (signed * F.lit(f"1e-{scale}").cast(f"decimal({scale + 1},{scale})")).cast(f"decimal(20,{scale})"))
    return out.drop("_w", "_t", "_sum", "_n", "_u", "_q", "_behind", "_less", "_given", "_place")


def weighted_bridge(
    df: DataFrame, group: str, member: str, share: Column, hot_rows: int = HOT_ROWS, biggest: int | None = None
) -> DataFrame:
    """M:N bridge (group, member, allocation_weight); the weights of a group sum to 1 exactly."""
    pre = df.groupBy(group, member).agg(F.sum(share).alias("_w"))
    bridge = allocate(pre, group, [member], F.col("_w"), F.lit(1), "allocation_weight", 6, hot_rows, biggest)
    return bridge.select(group, member, F.col("allocation_weight").cast("decimal(9,6)").alias("allocation_weight"))


def attribute_by_weight(headers: DataFrame, bridge: DataFrame, group: str, member: str, measure: str, name: str) -> DataFrame:
    """Header measure attributed to members by weight, without double counting."""
    joined = bridge.join(headers.select(group, measure), group)
    return joined.groupBy(member).agg(F.sum(F.col(measure) * F.col("allocation_weight")).alias(name))


def bridge_member_count(bridge: DataFrame, group: str, is_counted: Column, name: str) -> DataFrame:
    return bridge.groupBy(group).agg(F.count_if(is_counted).alias(name))


def fx_triad(orders: DataFrame, rates: DataFrame, date: str, currency: str, local: str, prefix: str) -> DataFrame:
    """Local amount, currency, spot rate and reporting amount at one role-playing date.
    A missing rate leaves the reporting amount NULL for the triad check to find."""
    table = rates.select(
        F.col("rate_date").alias("_d"), F.col("currency_code").alias("_c"), F.col("spot_rate").alias(f"{prefix}_rate")
    )
    joined = orders.join(table, (F.col(date) == F.col("_d")) & (F.col(currency) == F.col("_c")), "left")
    amount = (F.col(local) * F.col(f"{prefix}_rate")).cast("decimal(28,6)")
    return joined.withColumn(f"{prefix}_usd", amount).drop("_d", "_c")


def conformed_facts(
    processes: Mapping[str, DataFrame], members: DataFrame, member: str, member_sk: str, unknown: str = "-1"
) -> DataFrame:
    """One bus of facts (process, `member_sk`, date_key, amount, and the member's other columns) over a member and a date dimension that
    all processes share. Each process gives (`member`, day, amount); they are stacked before the dimension is joined, so it is joined once.
    Rows without a known member keep the surrogate key `unknown` and null attributes."""
    bus = None
    for name, df in processes.items():
        rows = df.select(F.lit(name).alias("process"), F.col(member), date_key("day").alias("date_key"), "amount")
        bus = rows if bus is None else bus.unionByName(rows)
    joined = bus.join(members, member, "left").withColumn(member_sk, F.coalesce(member_sk, F.lit(unknown)))
    return joined.drop(member)


def drill_across(parts: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of facts that are already aggregated to `keys`; absent measures become 0.
    Stacking and one more sum replaces a chain of full joins: every side is shuffled once."""
    measures = [c for df in parts.values() for c in df.columns if c not in keys]
    out = None
    for name, df in parts.items():
        row = df.select("*", F.lit(1).alias(f"_in_{name}"))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    aggs = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]
    aggs += [(F.coalesce(F.max(f"_in_{n}"), F.lit(0)) == 1).alias(f"in_{n}") for n in parts]
    return out.groupBy(*keys).agg(*aggs)


def header_summary(lines: DataFrame, headers: DataFrame, line_key: str, header_key: str, measures: Mapping[str, Column]) -> DataFrame:
    """Header-grain companion fact: line measures are summed per header before the join, so header
    amounts stay single."""
    per_header = lines.groupBy(F.col(line_key).alias("_h")).agg(
        *[F.sum(c).alias(n) for n, c in measures.items()], F.count(F.lit(1)).alias("line_count")
    )
    return headers.join(per_header, F.col(header_key) == F.col("_h"), "left").drop("_h")


def entity_average(readings: DataFrame, entity: str, value: Column, from_ts: Column, above: float) -> DataFrame:
    """Average reading per entity from a date cut, kept where the average exceeds a threshold."""
    per = readings.filter(from_ts).groupBy(entity).agg(
        (dbl(F.sum(value)) / F.count(value)).alias("avg_value"), F.count(F.lit(1)).alias("reading_count")
    )
    return per.filter(F.col("avg_value") > above)


def named_entity_average(
    readings: DataFrame, entity: str, value: Column, from_ts: Column, above: float, members: DataFrame, key: str, name: str
) -> DataFrame:
    """The same per name of the entity in its dimension. Readings are summed per entity first, so the join moves one row per entity and a
    busy entity is no hot key; entities that share a name are averaged over all their readings, readings without member are left out."""
    sums = readings.filter(from_ts).groupBy(F.col(entity).alias("_entity")).agg(
        F.sum(value).alias("_total"), F.count(value).alias("_values"), F.count(F.lit(1)).alias("_rows")
    )
    named = sums.join(members.select(F.col(key).alias("_entity"), name), "_entity")
    per = named.groupBy(name).agg((dbl(F.sum("_total")) / F.sum("_values")).alias("avg_value"), F.sum("_rows").alias("reading_count"))
    return per.filter(F.col("avg_value") > above)


def time_series_rollup(readings: DataFrame, ts: str, bucket: str, by: Sequence[str], value: Column) -> DataFrame:
    """Append-only readings into fixed time buckets."""
    w = F.window(ts, bucket)
    return readings.groupBy(w.alias("_w"), *by).agg(
        F.count(F.lit(1)).alias("reading_count"),
        F.sum(value).alias("total"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    ).select(F.col("_w.start").alias("bucket_start"), *by, "reading_count", "total", "lowest", "highest")
