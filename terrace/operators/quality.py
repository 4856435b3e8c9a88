"""Proofs over data: each returns a small DataFrame of measured facts and a verdict."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.columns import all_of, any_of, dbl, n_rows
from terrace.functions.frames import side_by_side, stack
from terrace.operators.ordered import HOT_ROWS, ordered_scan
from terrace.session import small_table


# fixed values: score deductions and the drift limit of the certification rules
FAIL_POINTS, WARN_POINTS, ERROR_POINTS = 25.0, 5.0, 15.0
ZERO_DRIFT = 0.0001
SUM_TOLERANCE = 0.01


# ---- conservation and fan-out ---------------------------------------------------------------------


def metric_conservation(
    source: DataFrame, source_measure: Column, gold: DataFrame, gold_measure: Column, tolerance: float = SUM_TOLERANCE
) -> DataFrame:
    """Total before and after modelling; passes when they differ by no more than the tolerance."""
    both = side_by_side(
        source.agg(F.coalesce(F.sum(source_measure), F.lit(0)).alias("s")),
        gold.agg(F.coalesce(F.sum(gold_measure), F.lit(0)).alias("g")),
    )
    drift = F.abs(F.col("s") - F.col("g"))
    return both.select(
        dbl("s").alias("source_total"), dbl("g").alias("gold_total"), dbl(drift).alias("drift"),
        (drift <= tolerance).alias("passed"),
    )


def fanout_factor(name: str, fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Rows an inner join would give per fact row. Both sides are counted per key and the counts
    multiplied, so a many-to-many join is measured without running it."""
    f = fact.groupBy(F.col(fact_key).alias("k")).agg(n_rows().alias("fn"))
    d = dim.groupBy(F.col(dim_key).alias("k")).agg(n_rows().alias("dn"))
    joined = f.join(d, "k", "left")
    factor = dbl("joined_rows") / F.nullif(dbl("fact_rows"), F.lit(0.0))
    return joined.agg(
        F.coalesce(F.sum("fn"), F.lit(0)).alias("fact_rows"),
        F.coalesce(F.sum(F.col("fn") * F.col("dn")), F.lit(0)).alias("joined_rows"),
        F.coalesce(F.sum(F.when(F.col("dn").isNull(), F.col("fn"))), F.lit(0)).alias("lost_rows"),
        F.max("fn").alias("hottest_key_rows"),
    ).select(
        F.lit(name).alias("join_name"), "fact_rows", "joined_rows", "lost_rows", "hottest_key_rows", factor.alias("factor"),
        (F.coalesce(factor, F.lit(1.0)) <= 1.0).alias("passed"),
    )


def chasm_trap(
    facts: Mapping[str, tuple[DataFrame, str, Column]], measure_of: str
) -> DataFrame:
    """Per shared key: the correct sum of one fact's measure and the sum a direct join of all facts on
    the key would report. {fact: (table, key, measure)}. Only per-key counts are joined."""
    out = None
    others = [n for n in facts if n != measure_of]
    for name, (df, key, measure) in facts.items():
        aggs = [n_rows().alias(f"n_{name}")] + ([F.sum(measure).alias("correct")] if name == measure_of else [])
        per = df.groupBy(F.col(key).alias("key")).agg(*aggs)
        out = per if out is None else out.join(per, "key")
    factor = F.lit(1)
    for n in others:
        factor = factor * F.col(f"n_{n}")
    return out.select(
        "key", dbl("correct").alias("correct_sum"), dbl(F.col("correct") * factor).alias("naive_sum"),
        dbl(factor).alias("inflation"),
    )


# ---- keys and references --------------------------------------------------------------------------


def pk_unique(name: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duplicate and NULL key counts of a single or composite key. Rows are counted per key first."""
    per = df.groupBy(*keys).agg(n_rows().alias("n"))
    some_null = ~all_of([F.col(k).isNotNull() for k in keys])
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(some_null, F.col("n"))), F.lit(0)).alias("null_key_rows"),
    ).select(
        F.lit(name).alias("table_name"), "row_count", "duplicate_rows", "null_key_rows",
        ((F.col("duplicate_rows") == 0) & (F.col("null_key_rows") == 0)).alias("passed"),
    )


def relationships(name: str, child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Orphan foreign keys: rows with a non-NULL key the parent lacks. Keys are reduced before the join."""
    per = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("k")).agg(n_rows().alias("n"))
    lost = per.join(parent.select(F.col(pk).alias("k")), "k", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"), n_rows().alias("orphan_keys")).select(
        F.lit(name).alias("relationship"), "orphan_rows", "orphan_keys", (F.col("orphan_rows") == 0).alias("passed")
    )


# ---- interval proofs ------------------------------------------------------------------------------


def interval_checks(name: str, dim: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Overlaps, gaps, inverted versions, members without exactly one current row, and current rows
    without the far-future end: one ordered scan per member instead of a self-join."""
    seen = ordered_scan(
        dim.select(key, "valid_from", "valid_to", "is_current"), [key], ["valid_from", "valid_to"],
        lead={"next_from": "valid_from"}, hot_rows=hot_rows,
    )
    overlap = F.col("next_from") < F.col("valid_to")
    row_level = seen.agg(
        n_rows().alias("versions"),
        F.count_if(overlap).alias("overlaps"),
        F.count_if(F.col("next_from") > F.col("valid_to")).alias("gaps"),
        F.count_if(F.col("valid_from") >= F.col("valid_to")).alias("inverted"),
        F.count_if(F.col("is_current") & (F.col("valid_to") < F.lit("9999-01-01").cast("timestamp_ntz"))).alias("bad_sentinels"),
        F.min(F.when(overlap, F.col(key))).alias("sample_key"),
    )
    per = dim.groupBy(key).agg(F.count_if("is_current").alias("n"))
    members = per.agg(F.count_if(F.col("n") != 1).alias("not_single_current"))
    bad = F.col("overlaps") + F.col("gaps") + F.col("inverted") + F.col("bad_sentinels") + F.col("not_single_current")
    return side_by_side(row_level, members).select(
        F.lit(name).alias("table_name"), "versions", "overlaps", "gaps", "inverted", "bad_sentinels",
        "not_single_current", F.col("sample_key").cast("string").alias("sample_key"), (bad == 0).alias("passed"),
    )


def temporal_causality(name: str, bound: DataFrame, fact_ts: str) -> DataFrame:
    """Facts with the valid_from, valid_to and is_current of the version they were bound to, by whatever
    join: none may sit on a version that was not valid at the time of the fact."""
    inside = (F.col("valid_from") <= F.col(fact_ts)) & (F.col(fact_ts) < F.col("valid_to"))
    return bound.agg(
        n_rows().alias("fact_rows"),
        F.count("valid_from").alias("bound_rows"),
        F.count_if(F.col("is_current") == F.lit(False)).alias("bound_to_past"),
        F.count_if(F.col("valid_from").isNotNull() & ~inside).alias("violations"),
    ).select(F.lit(name).alias("binding"), "*", (F.col("violations") == 0).alias("passed"))


# ---- erasure --------------------------------------------------------------------------------------


def gdpr_erase(dim: DataFrame, key: str, subjects: DataFrame, name: str, email: str, phone: str, address: str) -> DataFrame:
    """Pseudonymise all subjects at once; surrogate and natural keys stay, so facts keep their parent."""
    marks = subjects.select(F.col(key)).distinct().withColumn("_erase", F.lit(True))
    flagged = dim.join(marks, key, "left")
    erase = F.coalesce("_erase", F.lit(False))
    # fixed values: the texts that replace personal data
    alias = F.concat(
        F.lit("gdpr_purged_"), F.substring(F.md5(F.col(key).cast("string")), 1, 12), F.lit("@privacy.internal")
    )
    return flagged.withColumns(
        {
            name: F.when(erase, F.lit("REDACTED")).otherwise(F.col(name)),
            email: F.when(erase, alias).otherwise(F.col(email)),
            phone: F.when(~erase, F.col(phone)),
            address: F.when(erase, F.lit("ANONYMIZED_RESIDENCE")).otherwise(F.col(address)),
        }
    ).drop("_erase").select(*dim.columns)


def erasure_proof(
    before: DataFrame, after: DataFrame, key: str, facts: DataFrame, fact_key: str, measure: Column, name: str
) -> DataFrame:
    """Row counts, orphans and measure drift around an erasure."""
    counts = side_by_side(
        before.agg(n_rows().alias("rows_before")),
        after.agg(n_rows().alias("rows_after"), F.count_if(F.col(name) == "REDACTED").alias("redacted_rows")),
    )
    lost = relationships("erasure", facts, fact_key, after, key).select("orphan_rows")
    per_fact = facts.groupBy(F.col(fact_key).alias("_k")).agg(F.sum(measure).alias("_m"))

    def total(dim, alias):
        joined = per_fact.join(dim.select(F.col(key).alias("_k")), "_k", "left_semi")
        return joined.agg(F.coalesce(F.sum("_m"), F.lit(0)).alias(alias))

    sums = side_by_side(total(before, "_b"), total(after, "_a"))
    out = side_by_side(counts, lost, sums).withColumn("metric_drift", dbl(F.abs(F.col("_a") - F.col("_b"))))
    ok = (F.col("rows_before") == F.col("rows_after")) & (F.col("orphan_rows") == 0) & (F.col("metric_drift") == 0)
    return out.drop("_a", "_b").withColumn("passed", ok)


# ---- assertions -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Check:
    """A named expectation: the first column of `data`'s single row, or its number of rows."""

    name: str
    data: DataFrame
    kind: str
    expected: float | None = None


def _verdict(kind: str, actual: Column, expected: Column) -> Column:
    tests = {
        "scalar_eq": actual == expected,
        "scalar_gt": actual > expected,
        "scalar_gte": actual >= expected,
        "scalar_lt": actual < expected,
        "scalar_lte": actual <= expected,
        "zero_drift": F.abs(actual) < ZERO_DRIFT,
        "not_null": actual.isNotNull(),
        "row_count_gt": actual > expected,
        "row_count_eq": actual == expected,
        "is_empty": actual == 0,
    }
    return F.coalesce(tests[kind], F.lit(False))


def assertion_suite(checks: Sequence[Check]) -> DataFrame:
    """(check_name, kind, expected, actual, passed) for every check; evaluation stays in Spark."""
    rows = []
    for c in checks:
        counted = c.kind.startswith("row_count") or c.kind == "is_empty"
        # A scalar query without rows must still give a (failed) row, hence the global aggregate.
        value = n_rows() if counted else F.max(F.col(c.data.columns[0]))
        one = c.data.agg(value.cast("double").alias("actual"))
        expected = F.lit(None if c.expected is None else float(c.expected)).cast("double")
        rows.append(
            one.select(
                F.lit(c.name).alias("check_name"), F.lit(c.kind).alias("kind"), expected.alias("expected"), "actual",
                _verdict(c.kind, F.col("actual"), expected).alias("passed"),
            )
        )
    return stack(rows)


# ---- additivity, factless, hybrid, marts ----------------------------------------------------------


def grain_differences(
    left: DataFrame, right: DataFrame, keys: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Groups of either side whose measures differ or that the other side lacks, from one stacked sum."""
    a = left.select(*keys, *[F.col(m).alias(m) for m in measures], F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    b = right.select(*keys, *[(-F.col(m)).alias(m) for m in measures], F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    net = a.unionByName(b).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures], F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    same = all_of([F.col(m) == 0 for m in measures] + [F.col("_l") == F.col("_r")])
    return net.agg(
        n_rows().alias("groups"), F.count_if(~F.coalesce(same, F.lit(False))).alias("different_groups")
    ).withColumn("passed", F.col("different_groups") == 0)


def additivity_check(snapshot: DataFrame, account: str, date: str, balance: str, period: Column) -> DataFrame:
    """Per period: the closing balance and what summing the balance over time would claim."""
    per = snapshot.groupBy(period.alias("period"), F.col(account)).agg(
        F.max_by(balance, date).alias("closing"), F.sum(balance).alias("summed")
    )
    out = per.groupBy("period").agg(F.sum("closing").alias("closing"), F.sum("summed").alias("summed"))
    inflation = dbl("summed") / F.nullif(dbl("closing"), F.lit(0.0))
    return out.select("period", dbl("closing").alias("closing_balance"), dbl("summed").alias("summed_balance"), inflation.alias("inflation"))


def factless_grain_check(fact: DataFrame, grain: Sequence[str], parents: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Duplicates of the grain, unresolved keys, and numeric columns outside the grain (there must be none)."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    measures = sorted(c for c, typ in fact.dtypes if c not in grain and (typ in numeric or typ.startswith("decimal")))
    dup = pk_unique("fact", fact, grain).select("row_count", "duplicate_rows")
    lost = stack([relationships(k, fact, k, p, pk).select("orphan_rows") for k, (p, pk) in parents.items()])
    out = side_by_side(dup, lost.agg(F.sum("orphan_rows").alias("unresolved_rows")))
    out = out.withColumn("measure_columns", F.lit(",".join(measures)))
    ok = (F.col("duplicate_rows") == 0) & (F.col("unresolved_rows") == 0) & (F.col("measure_columns") == "")
    return out.withColumn("passed", ok)


def scd6_consistency(dim: DataFrame, key: str, historical: str, current: str) -> DataFrame:
    """current_x is the same on all versions of a member and equals its newest historical_x."""
    per = dim.groupBy(key).agg(
        F.min(current).alias("lo"), F.max(current).alias("hi"), F.max_by(historical, "valid_from").alias("newest")
    )
    return per.agg(
        n_rows().alias("members"),
        F.count_if(~F.col("lo").eqNullSafe(F.col("hi"))).alias("mixed_current"),
        F.count_if(~F.col("lo").eqNullSafe(F.col("newest"))).alias("stale_current"),
    ).withColumn("passed", (F.col("mixed_current") == 0) & (F.col("stale_current") == 0))


def ghost_rows(dim: DataFrame, fact: DataFrame, fact_key: str, key: str, defaults: Mapping[str, object]) -> DataFrame:
    """Ghost rows (is_inferred) of a dimension against the facts that came before their member: every fact key finds a row, a ghost
    is referred to, holds the defaults only, stands alone for its key and goes when the real member comes. Both sides are counted per
    key before they meet. A dimension without is_inferred has no ghosts; facts with a null key are not late."""
    marked = dim if "is_inferred" in dim.columns else dim.withColumn("is_inferred", F.lit(False))
    ghost = F.col("is_inferred")
    filled = any_of([~F.col(c).eqNullSafe(F.lit(v)) for c, v in defaults.items()]) if defaults else F.lit(False)
    members = marked.groupBy(key).agg(F.count_if(ghost).alias("ghosts"), F.count_if(~ghost).alias("real"), F.count_if(ghost & filled).alias("filled"))
    referred = fact.filter(F.col(fact_key).isNotNull()).groupBy(F.col(fact_key).alias(key)).agg(n_rows().alias("facts"))
    both = members.join(referred, key, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = both.agg(
        F.sum(zero("ghosts")).alias("ghost_rows"),
        F.sum(F.when(zero("ghosts") > 0, zero("facts")).otherwise(0)).alias("facts_on_ghosts"),
        F.sum(F.when(F.col("ghosts").isNull(), F.col("facts")).otherwise(0)).alias("unbound_facts"),
        F.count_if((zero("ghosts") > 0) & F.col("facts").isNull()).alias("idle_ghosts"),
        F.sum(zero("filled")).alias("filled_ghosts"),
        F.count_if((zero("ghosts") > 1) | ((zero("ghosts") > 0) & (zero("real") > 0))).alias("doubled_keys"),
    ).select(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("ghost_rows", "facts_on_ghosts", "unbound_facts", "idle_ghosts", "filled_ghosts", "doubled_keys")])
    faults = F.col("unbound_facts") + F.col("idle_ghosts") + F.col("filled_ghosts") + F.col("doubled_keys")
    return out.withColumn("passed", faults == 0)


def partition_profile(df: DataFrame, partition: Column, kept: Column) -> DataFrame:
    """Partitions, rows, largest-to-mean skew and the share of rows a filter keeps."""
    per = df.groupBy(partition.alias("p")).agg(n_rows().alias("n"), F.count_if(kept).alias("k"))
    return per.agg(
        n_rows().alias("partitions"), F.sum("n").alias("row_count"), F.max("n").alias("largest"),
        (dbl(F.max("n")) * dbl(n_rows()) / dbl(F.sum("n"))).alias("skew"),
        (dbl(F.sum("k")) / dbl(F.sum("n"))).alias("kept_share"),
    )


# ---- catalogs and baselines -----------------------------------------------------------------------


def catalog(tables: Mapping[str, DataFrame], keys: Mapping[str, str]) -> DataFrame:
    """One row per table column with its type and whether it is the primary key: schemas only, no data."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c, typ, c == keys.get(t)) for t, df in tables.items() for c, typ in df.dtypes]
    return small_table(spark, rows, "table_name string, column_name string, data_type string, is_key boolean")


def schema_drift(base: DataFrame, live: DataFrame) -> DataFrame:
    """Tables and columns added or removed, type changes and primary-key changes between two catalogs."""
    b = base.select("table_name", "column_name", F.col("data_type").alias("bt"), F.col("is_key").alias("bk"))
    l = live.select("table_name", "column_name", F.col("data_type").alias("lt"), F.col("is_key").alias("lk"))
    both = b.join(l, ["table_name", "column_name"], "full")
    known_b = base.select("table_name").distinct().withColumn("in_base", F.lit(True))
    known_l = live.select("table_name").distinct().withColumn("in_live", F.lit(True))
    both = both.join(known_b, "table_name", "left").join(known_l, "table_name", "left")
    kind = (
        F.when(F.col("in_live").isNull(), "TABLE_REMOVED")
        .when(F.col("in_base").isNull(), "TABLE_ADDED")
        .when(F.col("lt").isNull(), "COLUMN_REMOVED")
        .when(F.col("bt").isNull(), "COLUMN_ADDED")
        .when(F.col("bk") != F.col("lk"), "KEY_CHANGED")
        .when(F.col("bt") != F.col("lt"), "TYPE_CHANGED")
    )
    return both.select("table_name", "column_name", kind.alias("change")).filter("change is not null")


def snapshot_capture(tables: Mapping[str, DataFrame], keys: Mapping[str, str], sums: Mapping[str, str]) -> DataFrame:
    """Fingerprint per table: columns, key, rows, distinct keys and the sum of one measure."""
    rows = []
    for name, df in tables.items():
        total = dbl(F.sum(F.col(sums[name]).cast("decimal(18,2)"))) if name in sums else F.lit(None).cast("double")
        rows.append(
            df.agg(n_rows().alias("row_count"), F.count_distinct(keys[name]).alias("key_count"), total.alias("measure_sum")).select(
                F.lit(name).alias("table_name"), F.lit(",".join(df.columns)).alias("columns"),
                F.lit(keys[name]).alias("primary_key"), "row_count", "key_count", "measure_sum",
            )
        )
    return stack(rows)


def metric_regression(
    live: DataFrame, base: DataFrame, keys: Sequence[str], metric: str, status: str,
    max_increase_pct: float = 100.0, min_delta: float = 1.0,
) -> DataFrame:
    """Compare a metric table with its baseline per key: new keys, keys that are gone, status flips, and increases beyond
    the percentage and the minimum delta. A baseline of zero has no percentage and never alerts."""
    b = base.select(*keys, F.col(metric).alias("base_value"), F.col(status).alias("base_status"), F.lit(True).alias("_in_base"))
    l = live.select(*keys, F.col(metric).alias("live_value"), F.col(status).alias("live_status"), F.lit(True).alias("_in_live"))
    joined = l.join(b, list(keys), "full")
    delta = F.col("live_value") - F.col("base_value")
    pct = F.when(F.col("base_value") > 0, delta / F.col("base_value") * 100.0).otherwise(F.lit(0.0))
    is_new, is_gone = F.col("_in_base").isNull(), F.col("_in_live").isNull()
    both = ~is_new & ~is_gone
    return joined.select(
        *keys, "live_value", "base_value", is_new.alias("is_new"), is_gone.alias("is_gone"),
        (both & ~F.col("live_status").eqNullSafe(F.col("base_status"))).alias("status_drift"),
        F.coalesce(both & (pct > max_increase_pct) & (delta >= min_delta), F.lit(False)).alias("regression"),
    )


def regression_verdict(compared: DataFrame) -> DataFrame:
    n = compared.agg(
        n_rows().alias("compared"), F.count_if("is_new").alias("new_keys"), F.count_if("is_gone").alias("gone_keys"),
        F.count_if("status_drift").alias("drifted"), F.count_if("regression").alias("alerts"),
    )
    verdict = (
        F.when(F.col("drifted") > 0, "DRIFT_DETECTED").when(F.col("alerts") > 0, "PERF_ALERT").otherwise("IDENTICAL")
    )
    return n.withColumn("verdict", verdict)


# ---- percentiles and scores -----------------------------------------------------------------------


def percentile_summary(df: DataFrame, by: str, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean, median, p95 and p99 by rank: the value at 0-based place int(n * p) of the sorted values; with
    fewer than 20 (p95) or 100 (p99) values the largest. The median is the mean of the two middle values.

    Values are counted first, then the counts are scanned in order; no group is collected or sorted whole.
    The mean is summed exactly to 12 decimals; a group with a value outside decimal(38,12) is summed in doubles.
    """
    v = F.col(value)
    exact = v.try_cast("decimal(38,12)")
    histogram = df.filter(v.isNotNull()).groupBy(by, value).agg(n_rows().alias("_n"), F.try_sum(exact).alias("_s"))
    cum = ordered_scan(histogram, [by], [value], running={"_upto": "_n"}, hot_rows=hot_rows)
    totals = histogram.groupBy(by).agg(
        F.sum("_n").alias("n"),
        (
            F.when(F.count("_s") == F.count(F.lit(1)), dbl(F.try_sum("_s"))).otherwise(F.sum(dbl(value) * dbl("_n")))
            / dbl(F.sum("_n"))
        ).alias("mean"),
        F.max(value).alias("_top"),
    )
    joined = cum.join(totals, by)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place), v))

    n = F.col("n")
    picked = joined.groupBy(by, "n", "mean", "_top").agg(
        at(F.floor((n - 1) / 2)).alias("_lo"), at(F.floor(n / 2)).alias("_hi"),
        at(F.floor(dbl(n) * F.lit(0.95))).alias("_p95"), at(F.floor(dbl(n) * F.lit(0.99))).alias("_p99"),
    )
    return picked.select(
        by, "n", "mean", ((F.col("_lo") + F.col("_hi")) / 2).alias("p50"),
        F.when(n >= 20, F.col("_p95")).otherwise(F.col("_top")).alias("p95"),
        F.when(n >= 100, F.col("_p99")).otherwise(F.col("_top")).alias("p99"),
    )


def scorecard(results: DataFrame) -> DataFrame:
    """Certification from result rows (risk_id, tier, status, blocking): taken in order of tier and id, cut
    after the first blocking failure, 100 - 25 per failure - 5 per warning - 15 per error, floor 0."""
    place = F.struct("tier", "risk_id")
    failed = F.col("status").isin("FAIL", "HALT")
    halt = results.agg(F.min(F.when(failed & F.col("blocking"), place))).scalar()
    seen = results.withColumn("_halt", halt).filter(F.col("_halt").isNull() | (place <= F.col("_halt")))
    n = seen.agg(
        n_rows().alias("evaluated"), F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "WARNING").alias("warnings"), F.count_if(failed).alias("failed"),
        F.count_if(F.col("status") == "EVALUATOR_ERROR").alias("errors"),
        F.coalesce(F.max("_halt.risk_id"), F.lit("")).alias("halted_at"),
    )
    points = 100.0 - F.col("failed") * FAIL_POINTS - F.col("warnings") * WARN_POINTS - F.col("errors") * ERROR_POINTS
    return n.withColumns(
        {
            "score": F.greatest(points, F.lit(0.0)),
            "certified": (F.col("failed") == 0) & (F.col("errors") == 0) & (F.col("evaluated") > 0),
        }
    )


# ---- modelling guards -----------------------------------------------------------------------------


def currency_triad_check(fact: DataFrame, amount: str, currency: str, rate: str) -> DataFrame:
    """Amounts without a currency or a usable rate."""
    has = F.col(amount).isNotNull()
    out = fact.agg(
        n_rows().alias("row_count"), F.count_if(has & F.col(currency).isNull()).alias("without_currency"),
        F.count_if(has & ~F.coalesce(F.col(rate) > 0, F.lit(False))).alias("without_rate"),
    )
    return out.withColumn("passed", (F.col("without_currency") == 0) & (F.col("without_rate") == 0))


def header_on_line_check(lines: DataFrame, header: str, measures: Sequence[str]) -> DataFrame:
    """A measure that never varies inside the headers with several lines is a header amount repeated on
    line grain; summing it over lines inflates it."""
    per = lines.groupBy(header).agg(
        n_rows().alias("_n"), *[(F.min(m).eqNullSafe(F.max(m))).cast("bigint").alias(m) for m in measures]
    ).filter("_n > 1")
    one = per.agg(n_rows().alias("headers"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])
    return stack(
        [
            one.select(
                F.lit(m).alias("measure"), "headers", F.col(m).alias("constant_headers"),
                ((F.col("headers") == 0) | (F.col(m) < F.col("headers"))).alias("passed"),
            )
            for m in measures
        ]
    )


