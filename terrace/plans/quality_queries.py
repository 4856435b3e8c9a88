"""Queries for the data-quality proofs."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace.functions.columns import dbl, money, month_key, n_rows, net_amount, ntz
from terrace.operators import dimensions as dim
from terrace.operators import facts, quality
from terrace.operators.quality import Check
from terrace.plans.dimension_queries import (
    PRIORITY_DIM_SQL, SCD6_SQL, STATUS_DIM_SQL, bind_priority, priority_dim, shipments, status_log,
)
from terrace.plans.fact_queries import (
    attendance, FX_SQL, ship_grain, ship_measures, SNAPSHOT_SQL, balances, foreign_orders, monthly_shipments,
    order_baskets, sales_star,
)
from terrace.plans.registry import Tables, query
from terrace.plans.sources_silver import DEDUP_SQL, clean_lines
from terrace.session import scratch_path, written
from terrace.sources.generators import date_dimension, gen_zipf_keys


C = F.col
M = "CAST({} AS DECIMAL(18,2))".format
NET = f"{M('l_extendedprice')} * (1::DECIMAL(5,2) - CAST(l_discount AS DECIMAL(5,2)))"


@query(
    "k1_metric_conservation",
    f"""SELECT CAST(sum({NET}) AS DOUBLE) AS source_total, CAST(sum({NET}) AS DOUBLE) AS gold_total, 0.0::DOUBLE AS drift,
               true AS passed FROM lineitem""",
)
def _(t):
    return quality.metric_conservation(t.lineitem, net_amount(), sales_star(t, t.lineitem), net_amount())


@query(
    "k2_fanout_factor",
    """WITH z AS (SELECT k, count(*) AS n FROM (SELECT l_suppkey AS k FROM lineitem) GROUP BY 1),
            o AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT 'lineitem to part' AS join_name, (SELECT count(*) FROM lineitem) AS fact_rows, (SELECT count(*) FROM lineitem) AS joined_rows,
         CAST(0 AS BIGINT) AS lost_rows, (SELECT max(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_partkey)) AS hottest_key_rows,
         1.0::DOUBLE AS factor, true AS passed UNION ALL
       SELECT 'orders to lineitem', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
         (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)), 1,
         CAST((SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey) AS DOUBLE) / (SELECT count(*) FROM orders), false""",
)
def _(t):
    return quality.fanout_factor("lineitem to part", t.lineitem, "l_partkey", t.part, "p_partkey").unionByName(
        quality.fanout_factor("orders to lineitem", t.orders, "o_orderkey", t.lineitem, "l_orderkey")
    )


@query(
    "k2_fanout_skewed_keys",
    """SELECT 'skewed events to keys' AS join_name, count(*) AS fact_rows, count(*) AS joined_rows, CAST(0 AS BIGINT) AS lost_rows,
         1.0::DOUBLE AS factor, true AS passed FROM events""",
)
def _(t):
    skewed = gen_zipf_keys(t.events.select("event_id"), "event_id", n_keys=50, s=1.2, seed=42)
    keys = skewed.select(C("skew_key").alias("dim_key")).distinct()
    return quality.fanout_factor("skewed events to keys", skewed, "skew_key", keys, "dim_key").drop("hottest_key_rows")


@query(
    "k3_chasm_trap",
    f"""WITH o AS (SELECT o_custkey AS key, count(*) AS n, sum({M('o_totalprice')}) AS s FROM orders GROUP BY 1),
             l AS (SELECT o_custkey AS key, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
             e AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1)
        SELECT o.key, CAST(s AS DOUBLE) AS correct_sum, CAST(s * l.n * e.n AS DOUBLE) AS naive_sum, CAST(l.n * e.n AS DOUBLE) AS inflation
        FROM o JOIN l ON l.key = o.key JOIN e ON e.key = o.key""",
)
def _(t):
    sources = {
        "orders": (t.orders, "o_custkey", money("o_totalprice")),
        "shipments": (shipments(t), "o_custkey", C("amount")),
        "events": (t.events, "user_id", money("value")),
    }
    return quality.chasm_trap(sources, "orders")


@query(
    "k4_pk_unique",
    """SELECT 'orders' AS table_name, count(*) AS row_count, CAST(0 AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS null_key_rows,
         true AS passed FROM orders UNION ALL
       SELECT 'lineitem', count(*), count(*) - count(DISTINCT (l_orderkey, l_linenumber)), 0, false FROM lineitem""",
)
def _(t):
    return quality.pk_unique("orders", t.orders, ["o_orderkey"]).unionByName(
        quality.pk_unique("lineitem", t.lineitem, ["l_orderkey", "l_linenumber"])
    )


@query(
    "k5_relationships",
    """SELECT 'orders.customer' AS relationship, count(*) AS orphan_rows, count(DISTINCT o_custkey) AS orphan_keys, count(*) = 0 AS passed
       FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL
       SELECT 'orders.active_customer', count(*), count(DISTINCT o_custkey), count(*) = 0 FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
)
def _(t):
    active = t.customer.filter("c_acctbal >= 0")
    return quality.relationships("orders.customer", t.orders, "o_custkey", t.customer, "c_custkey").unionByName(
        quality.relationships("orders.active_customer", t.orders, "o_custkey", active, "c_custkey")
    )


def interval_sql(name: str, table: str, key: str) -> str:
    return f"""SELECT '{name}' AS table_name, count(*) AS versions, count(*) FILTER (WHERE nf < valid_to) AS overlaps,
        count(*) FILTER (WHERE nf > valid_to) AS gaps, count(*) FILTER (WHERE valid_from >= valid_to) AS inverted,
        count(*) FILTER (WHERE is_current AND valid_to < TIMESTAMP '9999-01-01') AS bad_sentinels,
        (SELECT count(*) FROM (SELECT {key} FROM {table} GROUP BY 1 HAVING count(*) FILTER (WHERE is_current) <> 1)) AS not_single_current,
        CAST(min({key}) FILTER (WHERE nf < valid_to) AS VARCHAR) AS sample_key,
        count(*) FILTER (WHERE nf < valid_to OR nf > valid_to OR valid_from >= valid_to
          OR (is_current AND valid_to < TIMESTAMP '9999-01-01')) = 0 AND
        (SELECT count(*) FROM (SELECT {key} FROM {table} GROUP BY 1 HAVING count(*) FILTER (WHERE is_current) <> 1)) = 0 AS passed
        FROM (SELECT *, lead(valid_from) OVER (PARTITION BY {key} ORDER BY valid_from, valid_to) AS nf FROM {table})"""


STAY_SQL = f"""(SELECT user_id, ts AS valid_from, ts + INTERVAL 4 HOUR AS valid_to,
    ts = max(ts) OVER (PARTITION BY user_id) AS is_current FROM events)"""


@query("k6_interval_overlap", interval_sql("status", STATUS_DIM_SQL, "user_id") + " UNION ALL " + interval_sql("stays", STAY_SQL, "user_id"))
def _(t):
    good = dim.scd2_build(status_log(t), "user_id", "changed_at", ["status"])
    # Four-hour stays from each event overlap, leave gaps and carry no sentinel: all must be found.
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    stays = t.events.join(last, "user_id").select(
        "user_id", C("ts").alias("valid_from"), (C("ts") + F.expr("interval 4 hours")).alias("valid_to"),
        (C("ts") == C("last_ts")).alias("is_current"),
    )
    return quality.interval_checks("status", good, "user_id").unionByName(quality.interval_checks("stays", stays, "user_id"))


@query("k7_interval_gap", interval_sql("priority", PRIORITY_DIM_SQL, "cust_id"))
def _(t):
    return quality.interval_checks("priority", priority_dim(t), "cust_id")


@query(
    "k8_single_current",
    f"""SELECT count(*) AS members, count(*) FILTER (WHERE n <> 1) AS bad_members FROM (
          SELECT cust_id, count(*) FILTER (WHERE is_current AND valid_to >= TIMESTAMP '9999-01-01') AS n FROM {PRIORITY_DIM_SQL} GROUP BY 1)""",
)
def _(t):
    ends = C("is_current") & (C("valid_to") >= ntz("9999-01-01"))
    per = priority_dim(t).groupBy("cust_id").agg(F.count_if(ends).alias("n"))
    return per.agg(n_rows().alias("members"), F.count_if(C("n") != 1).alias("bad_members"))


@query(
    "k9_temporal_causality",
    f"""WITH f AS (SELECT o_custkey, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey), d AS (SELECT * FROM {PRIORITY_DIM_SQL})
        SELECT 'point in time' AS binding, count(*) AS fact_rows, count(valid_from) AS bound_rows,
          count(*) FILTER (WHERE NOT is_current) AS bound_to_past, CAST(0 AS BIGINT) AS violations, true AS passed
        FROM f LEFT JOIN d ON cust_id = o_custkey AND l_shipdate >= valid_from AND l_shipdate < valid_to UNION ALL
        SELECT 'current state', count(*), count(valid_from), 0, count(*) FILTER (WHERE l_shipdate < valid_from),
          count(*) FILTER (WHERE l_shipdate < valid_from) = 0 FROM f LEFT JOIN d ON cust_id = o_custkey AND is_current""",
)
def _(t):
    # The same facts bound properly, and bound to the current state, which the proof must reject.
    members, facts_at = priority_dim(t), shipments(t)
    bound = bind_priority(t, facts_at, ["is_current"])
    now = facts_at.join(dim.current_view(members), C("o_custkey") == C("cust_id"), "left")
    return quality.temporal_causality("point in time", bound, "l_shipdate").unionByName(
        quality.temporal_causality("current state", now, "l_shipdate")
    )


def person_dim(t: Tables):
    return t.customer.select(
        "c_custkey", C("c_name").alias("name"), F.concat(F.lit("c"), "c_custkey", F.lit("@mail.test")).alias("email"),
        C("c_nationkey").cast("string").alias("phone"), C("c_mktsegment").alias("address"),
    )


def erase_requests(t: Tables):
    return t.customer.filter("c_acctbal < 0").select("c_custkey")


@query(
    "k10_gdpr_erase",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'REDACTED' ELSE c_name END AS name,
         CASE WHEN c_acctbal < 0 THEN 'gdpr_purged_' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 12) || '@privacy.internal'
              ELSE 'c' || c_custkey || '@mail.test' END AS email,
         CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey AS VARCHAR) END AS phone,
         CASE WHEN c_acctbal < 0 THEN 'ANONYMIZED_RESIDENCE' ELSE c_mktsegment END AS address FROM customer""",
)
def _(t):
    return quality.gdpr_erase(person_dim(t), "c_custkey", erase_requests(t), "name", "email", "phone", "address")


@query(
    "k10_erasure_proof",
    """SELECT count(*) AS rows_before, count(*) AS rows_after, count(*) FILTER (WHERE c_acctbal < 0) AS redacted_rows,
         CAST(0 AS BIGINT) AS orphan_rows, 0.0::DOUBLE AS metric_drift, true AS passed FROM customer""",
)
def _(t):
    before = person_dim(t)
    after = quality.gdpr_erase(before, "c_custkey", erase_requests(t), "name", "email", "phone", "address")
    return quality.erasure_proof(before, after, "c_custkey", t.orders, "o_custkey", money("o_totalprice"), "name")


@query(
    "k11_assertion_suite",
    f"""SELECT 'orders exist' AS check_name, 'scalar_gt' AS kind, 0.0::DOUBLE AS expected, CAST(count(*) AS DOUBLE) AS actual,
          count(*) > 0 AS passed FROM orders UNION ALL
        SELECT 'five regions', 'scalar_eq', 5.0, CAST(count(*) AS DOUBLE), count(*) = 5 FROM region UNION ALL
        SELECT 'line floor', 'scalar_gte', 1.0, CAST(count(*) AS DOUBLE), count(*) >= 1 FROM lineitem UNION ALL
        SELECT 'largest discount', 'scalar_lte', 0.1, max(l_discount), max(l_discount) <= 0.1 FROM lineitem UNION ALL
        SELECT 'smallest quantity', 'scalar_lt', 1.0, min(l_quantity), min(l_quantity) < 1.0 FROM lineitem UNION ALL
        SELECT 'mart drift', 'zero_drift', NULL, 0.0, true UNION ALL
        SELECT 'last order date', 'not_null', NULL, CAST(max(year(o_orderdate)) AS DOUBLE), max(o_orderdate) IS NOT NULL FROM orders UNION ALL
        SELECT 'segments', 'row_count_eq', 5.0, CAST(count(DISTINCT c_mktsegment) AS DOUBLE), count(DISTINCT c_mktsegment) = 5 FROM customer UNION ALL
        SELECT 'busy users', 'row_count_gt', 10.0, CAST(count(DISTINCT user_id) AS DOUBLE), count(DISTINCT user_id) > 10 FROM events UNION ALL
        SELECT 'orphan orders', 'is_empty', NULL, CAST(count(*) AS DOUBLE), count(*) = 0 FROM orders
          WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def _(t):
    count = lambda df: df.agg(n_rows().alias("n"))
    drift = quality.metric_conservation(t.lineitem, net_amount(), sales_star(t, t.lineitem), net_amount())
    orphans = t.orders.join(t.customer, C("o_custkey") == C("c_custkey"), "left_anti")
    return quality.assertion_suite(
        [
            Check("orders exist", count(t.orders), "scalar_gt", 0),
            Check("five regions", count(t.region), "scalar_eq", 5),
            Check("line floor", count(t.lineitem), "scalar_gte", 1),
            Check("largest discount", t.lineitem.agg(F.max("l_discount")), "scalar_lte", 0.1),
            Check("smallest quantity", t.lineitem.agg(F.min("l_quantity")), "scalar_lt", 1),
            Check("mart drift", drift.select("drift"), "zero_drift"),
            Check("last order date", t.orders.agg(F.max(F.year("o_orderdate"))), "not_null"),
            Check("segments", t.customer.select("c_mktsegment").distinct(), "row_count_eq", 5),
            Check("busy users", t.events.select("user_id").distinct(), "row_count_gt", 10),
            Check("orphan orders", orphans, "is_empty"),
        ]
    )


@query(
    "k12_rollup_consistency",
    """SELECT count(*) AS groups, CAST(0 AS BIGINT) AS different_groups, true AS passed FROM (
         SELECT DISTINCT year(l_shipdate), month(l_shipdate), l_returnflag FROM lineitem)""",
)
def _(t):
    path = scratch_path(t.spark, "rollup")
    monthly_shipments(t).write.parquet(path)
    base = facts.rollup_table(t.lineitem, ship_grain(), ship_measures())
    return quality.grain_differences(t.spark.read.parquet(path), base, list(ship_grain()), ["quantity", "revenue", "row_count"])


@query(
    "k13_additivity_check",
    f"""SELECT CAST(period AS INTEGER) AS period, CAST(sum(c) AS DOUBLE) AS closing_balance, CAST(sum(s) AS DOUBLE) AS summed_balance,
          CAST(sum(s) AS DOUBLE) / CAST(sum(c) AS DOUBLE) AS inflation FROM (SELECT year(month) AS period, o_custkey,
            arg_max(balance, month) AS c, sum(balance) AS s FROM {SNAPSHOT_SQL} GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    return quality.additivity_check(balances(t), "o_custkey", "month", "balance", F.year("month"))


@query(
    "k14_factless_grain_check",
    """SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS duplicate_rows, count(*) FILTER (WHERE user_id NOT IN
         (SELECT c_custkey FROM customer)) AS unresolved_rows, '' AS measure_columns,
         count(*) FILTER (WHERE user_id NOT IN (SELECT c_custkey FROM customer)) = 0 AS passed
       FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events)""",
)
def _(t):
    seen = facts.factless_fact(t.events, attendance())
    days = date_dimension(t.events, "ts")
    parents = {"user_id": (t.customer, "c_custkey"), "date_key": (days, "date_sk")}
    return quality.factless_grain_check(seen, ["user_id", "event_type", "date_key"], parents)


@query(
    "k15_scd6_consistency",
    f"""SELECT count(DISTINCT cust_id) AS members, CAST(0 AS BIGINT) AS mixed_current, CAST(0 AS BIGINT) AS stale_current, true AS passed
        FROM {SCD6_SQL}""",
)
def _(t):
    hybrid = dim.scd6_hybrid(priority_dim(t), "cust_id", ["priority"])
    return quality.scd6_consistency(hybrid, "cust_id", "historical_priority", "current_priority")


LATE_SQL = "(SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0))"


@query(
    "k15_ghost_rows",
    f"""SELECT 'with ghosts' AS dimension, count(DISTINCT o_custkey) AS ghost_rows, count(*) AS facts_on_ghosts, CAST(0 AS BIGINT) AS unbound_facts,
               CAST(0 AS BIGINT) AS idle_ghosts, CAST(0 AS BIGINT) AS filled_ghosts, CAST(0 AS BIGINT) AS doubled_keys, true AS passed FROM {LATE_SQL}
        UNION ALL SELECT 'without ghosts', 0, 0, count(*), 0, 0, 0, count(*) = 0 FROM {LATE_SQL}
        UNION ALL SELECT 'members came', n, f, 0, 0, 0, n, n = 0 FROM (SELECT count(DISTINCT o_custkey) AS n, count(*) AS f FROM {LATE_SQL})""",
)
def _(t):
    member = [F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.lit(1).alias("version_number")]
    known, defaults = t.customer.filter("c_acctbal >= 0").select(*member), {"segment": "UNKNOWN", "version_number": 0}
    ghosts = dim.inferred_members(known, t.orders, "o_custkey", "customer_id", defaults)
    late = t.customer.filter("not coalesce(c_acctbal >= 0, false)").select(*member, F.lit(False).alias("is_inferred"))
    cases = {"with ghosts": ghosts, "without ghosts": known, "members came": ghosts.unionByName(late)}
    checked = [quality.ghost_rows(d, t.orders, "o_custkey", "customer_id", defaults).withColumn("dimension", F.lit(name)) for name, d in cases.items()]
    return checked[0].unionByName(checked[1]).unionByName(checked[2])


@query(
    "k16_partition_profile",
    """SELECT count(*) AS partitions, CAST(sum(n) AS BIGINT) AS row_count, max(n) AS largest,
         CAST(max(n) AS DOUBLE) * count(*) / CAST(sum(n) AS DOUBLE) AS skew, CAST(sum(k) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS kept_share
       FROM (SELECT year(l_shipdate), month(l_shipdate), count(*) AS n, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1998-06-01'
         AND l_shipdate < TIMESTAMP '1998-07-01') AS k FROM lineitem GROUP BY 1, 2)""",
)
def _(t):
    kept = (C("l_shipdate") >= ntz("1998-06-01")) & (C("l_shipdate") < ntz("1998-07-01"))
    return quality.partition_profile(t.lineitem, month_key("l_shipdate"), kept)


@query(
    "k17_mart_parity",
    f"""SELECT 'flat' AS mart, count(DISTINCT o_custkey) AS groups, CAST(0 AS BIGINT) AS different_groups, true AS passed
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL
        SELECT 'nested', count(DISTINCT l_orderkey), 0, true FROM lineitem""",
)
def _(t):
    amount = money("l_extendedprice")
    total = lambda df, key: df.groupBy(C(key).alias("key")).agg(F.sum(amount).alias("amount"), n_rows().alias("lines"))
    star = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), C("l_orderkey") == C("o_orderkey"))
    flat = quality.grain_differences(
        total(sales_star(t, t.lineitem), "o_custkey"), total(star, "o_custkey"), ["key"], ["amount", "lines"]
    )
    unnested = facts.unnest_items(order_baskets(t), "l_orderkey")
    nested = quality.grain_differences(
        total(unnested, "l_orderkey"), total(clean_lines(t), "l_orderkey"), ["key"], ["amount", "lines"]
    )
    return flat.withColumn("mart", F.lit("flat")).unionByName(nested.withColumn("mart", F.lit("nested")))


TABLE_KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey"}


@query(
    "k18_schema_drift",
    """SELECT 'customer' AS table_name, 'c_segment_key' AS column_name, 'COLUMN_ADDED' AS change UNION ALL
       SELECT 'customer', 'c_mktsegment', 'COLUMN_REMOVED' UNION ALL SELECT 'orders', 'o_totalprice', 'TYPE_CHANGED' UNION ALL
       SELECT 'part', 'p_partkey', 'KEY_CHANGED' UNION ALL SELECT 'part', 'p_name', 'KEY_CHANGED' UNION ALL
       SELECT 'supplier', column_name, 'TABLE_REMOVED' FROM (DESCRIBE supplier) UNION ALL
       SELECT 'orders_daily', unnest(['o_orderdate', 'order_count']), 'TABLE_ADDED'""",
)
def _(t):
    base = {n: getattr(t, n) for n in TABLE_KEYS}
    live = {
        "orders": t.orders.withColumn("o_totalprice", money("o_totalprice")),
        "customer": t.customer.withColumnRenamed("c_mktsegment", "c_segment_key"),
        "part": t.part,
        "orders_daily": t.orders.groupBy("o_orderdate").agg(n_rows().alias("order_count")),
    }
    live_keys = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_name", "orders_daily": "o_orderdate"}
    return quality.schema_drift(quality.catalog(base, TABLE_KEYS), quality.catalog(live, live_keys))


@query(
    "k19_snapshot_capture",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS table_name, (SELECT string_agg(column_name, ',') FROM (DESCRIBE {n})) AS columns, '{k}' AS primary_key,
            count(*) AS row_count, count(DISTINCT {k}) AS key_count, {f'CAST(sum({M(s)}) AS DOUBLE)' if s else 'CAST(NULL AS DOUBLE)'} AS measure_sum FROM {n}"""
        for n, k, s in [("orders", "o_orderkey", "o_totalprice"), ("customer", "c_custkey", "c_acctbal"),
                        ("part", "p_partkey", "p_retailprice"), ("supplier", "s_suppkey", None)]
    ),
)
def _(t):
    sums = {"orders": "o_totalprice", "customer": "c_acctbal", "part": "p_retailprice"}
    shot = quality.snapshot_capture({n: getattr(t, n) for n in TABLE_KEYS}, TABLE_KEYS, sums)
    path = scratch_path(t.spark, "snapshot")
    shot.write.json(path)
    return t.spark.read.schema(shot.schema).json(path)


DAY_SQL = f"""(SELECT event_type, CAST(day(ts) AS INTEGER) AS d, CAST(sum({M('value')}) AS DOUBLE) AS v,
    CASE WHEN count(*) >= 60 THEN 'BUSY' ELSE 'QUIET' END AS s FROM events GROUP BY 1, 2)"""
REGRESSION_SQL = f"""(SELECT coalesce(l.event_type, b.event_type) AS event_type, CAST(coalesce(l.d, b.d + 1) AS INTEGER) AS day,
    l.v AS live_value, b.v AS base_value, b.d IS NULL AS is_new, l.d IS NULL AS is_gone,
    coalesce(b.s <> l.s, false) AS status_drift,
    coalesce(CASE WHEN b.v > 0 THEN (l.v - b.v) / b.v * 100.0::DOUBLE ELSE 0 END > 100 AND l.v - b.v >= 1, false) AS regression
    FROM {DAY_SQL} l FULL JOIN {DAY_SQL} b ON b.event_type = l.event_type AND b.d + 1 = l.d)"""


def daily_regression(t: Tables):
    """Value per event type and day against the day before as its baseline."""
    daily = t.events.groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(
        dbl(F.sum(money("value"))).alias("v"), F.when(n_rows() >= 60, "BUSY").otherwise("QUIET").alias("s")
    )
    base = daily.withColumn("day", C("day") + 1)
    return quality.metric_regression(daily, base, ["event_type", "day"], "v", "s")


@query("k20_metric_regression", f"SELECT * FROM {REGRESSION_SQL}")
def _(t):
    return daily_regression(t)


@query(
    "k20_regression_verdict",
    f"""SELECT count(*) AS compared, count(*) FILTER (WHERE is_new) AS new_keys, count(*) FILTER (WHERE is_gone) AS gone_keys, count(*) FILTER (WHERE status_drift) AS drifted,
          count(*) FILTER (WHERE regression) AS alerts, CASE WHEN bool_or(status_drift) THEN 'DRIFT_DETECTED'
            WHEN bool_or(regression) THEN 'PERF_ALERT' ELSE 'IDENTICAL' END AS verdict FROM {REGRESSION_SQL}""",
)
def _(t):
    return quality.regression_verdict(daily_regression(t))


@query(
    "k21_percentile_summary",
    f"""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
          count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / n AS mean,
          (max(value) FILTER (WHERE i = (n - 1) // 2) + max(value) FILTER (WHERE i = n // 2)) / 2 AS p50,
          CASE WHEN n >= 20 THEN max(value) FILTER (WHERE i = floor(n * 0.95::DOUBLE)) ELSE max(value) END AS p95,
          CASE WHEN n >= 100 THEN max(value) FILTER (WHERE i = floor(n * 0.99::DOUBLE)) ELSE max(value) END AS p99
        FROM s GROUP BY 1, 2""",
)
def _(t):
    return quality.percentile_summary(t.events, "event_type", "value")


@query(
    "k22_scorecard",
    """WITH r AS (SELECT 'K01' AS risk_id, 1 AS tier, 'PASS' AS status, true AS blocking UNION ALL
         SELECT 'K05', 1, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARNING' END, false FROM orders
           WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) UNION ALL
         SELECT 'K04', 2, CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN 'PASS' ELSE 'FAIL' END, true FROM lineitem UNION ALL
         SELECT 'K09', 3, 'PASS', true),
       h AS (SELECT min((tier, risk_id)) AS p FROM r WHERE status = 'FAIL' AND blocking),
       s AS (SELECT r.* FROM r, h WHERE p IS NULL OR (tier, risk_id) <= p)
       SELECT count(*) AS evaluated, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARNING') AS warnings,
         count(*) FILTER (WHERE status = 'FAIL') AS failed, CAST(0 AS BIGINT) AS errors,
         coalesce((SELECT p[2] FROM h), '') AS halted_at,
         greatest(0.0::DOUBLE, 100.0::DOUBLE - 25 * count(*) FILTER (WHERE status = 'FAIL') - 5 * count(*) FILTER (WHERE status = 'WARNING')) AS score,
         count(*) FILTER (WHERE status = 'FAIL') = 0 AS certified FROM s""",
)
def _(t):
    def result(risk, tier, passed_df, bad, blocking):
        return passed_df.select(
            F.lit(risk).alias("risk_id"), F.lit(tier).alias("tier"),
            F.when(C("passed"), "PASS").otherwise(bad).alias("status"), F.lit(blocking).alias("blocking"),
        )

    active = t.customer.filter("c_acctbal >= 0")
    bound = bind_priority(t, shipments(t), ["is_current"])
    rows = quality.stack(
        [
            result("K01", 1, quality.metric_conservation(t.lineitem, net_amount(), sales_star(t, t.lineitem), net_amount()), "FAIL", True),
            result("K05", 1, quality.relationships("x", t.orders, "o_custkey", active, "c_custkey"), "WARNING", False),
            result("K04", 2, quality.pk_unique("x", t.lineitem, ["l_orderkey", "l_linenumber"]), "FAIL", True),
            result("K09", 3, quality.temporal_causality("pit", bound, "l_shipdate"), "FAIL", True),
        ]
    )
    # Check results are kept: the scorecard reads the stored rows and runs no check again.
    return quality.scorecard(written(rows, "check-results"))


@query(
    "k23_currency_triad_check",
    f"""SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS without_currency, CAST(0 AS BIGINT) AS without_rate, true AS passed FROM {FX_SQL}""",
)
def _(t):
    return quality.currency_triad_check(foreign_orders(t), "local_amount", "currency_code", "order_rate")


@query(
    "k23_header_on_line_check",
    """WITH g AS (SELECT l_orderkey, min(o_totalprice) = max(o_totalprice) AS h, min(l_extendedprice) = max(l_extendedprice) AS l
         FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) > 1)
       SELECT 'o_totalprice' AS measure, count(*) AS headers, count(*) FILTER (WHERE h) AS constant_headers,
         count(*) FILTER (WHERE h) < count(*) AS passed FROM g UNION ALL
       SELECT 'l_extendedprice', count(*), count(*) FILTER (WHERE l), count(*) FILTER (WHERE l) < count(*) FROM g""",
)
def _(t):
    lines = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey"))
    return quality.header_on_line_check(lines, "l_orderkey", ["o_totalprice", "l_extendedprice"])


@query(
    "k24_atomic_grain_check",
    f"""SELECT 'raw lines' AS table_name, count(*) AS row_count, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows,
          CAST(0 AS BIGINT) AS null_key_rows, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS passed FROM lineitem UNION ALL
        SELECT 'clean lines', count(*), 0, 0, true FROM {DEDUP_SQL} UNION ALL
        SELECT 'attendance', count(*), 0, 0, true FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) FROM events)""",
)
def _(t):
    keys = ["l_orderkey", "l_linenumber"]
    return quality.stack(
        [
            quality.pk_unique("raw lines", t.lineitem, keys),
            quality.pk_unique("clean lines", clean_lines(t), keys),
            quality.pk_unique("attendance", facts.factless_fact(t.events, attendance()), list(attendance())),
        ]
    )
