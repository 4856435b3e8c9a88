"""Queries for fact builders and the flagship mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.columns import date_key, day_text, dbl, md5_key, money, month_key, n_rows, net_amount, ntz, rate, ts_text
from terrace.operators import facts, silver
from terrace.operators.ordered import largest_group
from terrace.plans.dimension_queries import PRIORITY_DIM_SQL, bind_priority, orders_per_customer, priority_dim, shipments
from terrace.plans.registry import Tables, query
from terrace.plans.sources_silver import DEDUP_SQL, clean_lines
from terrace.sources.generators import date_dimension


M = "CAST({} AS DECIMAL(18,2))".format
NET_SQL = f"{M('l_extendedprice')} * (1::DECIMAL(5,2) - CAST(l_discount AS DECIMAL(5,2)))"


def sales_star(t: Tables, lines: DataFrame) -> DataFrame:
    """Flat sales mart: lines with their order, customer, nation, region and part. The order header is
    completed first, so the far larger lines are shuffled by order only once for all four tables."""
    people = [(t.customer, "o_custkey", "c_custkey"), (t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey")]
    headers = facts.obt_mart(t.orders, people)
    return facts.obt_mart(lines, [(headers, "l_orderkey", "o_orderkey"), (t.part, "l_partkey", "p_partkey")])


STAR_SQL = """orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
    LEFT JOIN part ON p_partkey = l_partkey"""


@query(
    "flagship_sales_mart",
    f"""WITH clean AS (SELECT * FROM {DEDUP_SQL} WHERE l_quantity > 0 AND l_discount <= 0.08)
        SELECT 'mart' AS row_kind, r_name AS region, CAST(year(o_orderdate) AS INTEGER) AS order_year,
               CAST(sum({NET_SQL}) AS DOUBLE) AS revenue, count(*) AS line_count
        FROM clean LEFT JOIN {STAR_SQL} GROUP BY 2, 3 UNION ALL
        SELECT 'source', 'ALL', 0, CAST(sum({NET_SQL}) AS DOUBLE), count(*) FROM clean""",
)
def _(t):
    rules = {"quantity > 0": F.col("l_quantity") > 0, "discount <= 0.08": F.col("l_discount") <= 0.08}
    # One shuffle by order serves both the de-duplication and the join to orders.
    biggest = largest_group(t.lineitem, ["l_orderkey"])
    lines = silver.contract_filter(clean_lines(t, biggest), rules)
    measures = [dbl(F.sum(net_amount())).alias("revenue"), n_rows().alias("line_count")]
    mart = sales_star(t, lines).groupBy(
        F.lit("mart").alias("row_kind"), F.col("r_name").alias("region"), F.year("o_orderdate").alias("order_year")
    ).agg(*measures)
    proof = lines.agg(*measures).select(
        F.lit("source").alias("row_kind"), F.lit("ALL").alias("region"), F.lit(0).alias("order_year"), "revenue", "line_count",
    )
    return mart.unionByName(proof)


@query(
    "f1_fact_incremental",
    """SELECT o_orderkey, coalesce(customer_sk, 'UNKNOWN_SK') AS customer_sk,
              CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS order_date_key,
              o_totalprice AS total_amount FROM orders LEFT JOIN (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS customer_sk
                FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1998-01-01'""",
)
def _(t):
    loaded = t.orders.filter(F.col("o_orderdate") < ntz("1998-01-01"))
    known = t.customer.filter("c_acctbal >= 0").withColumn("customer_sk", md5_key("c_custkey"))
    lookups = [(known, "c_custkey", "o_custkey", "customer_sk", "UNKNOWN_SK")]
    new = facts.fact_incremental(loaded, t.orders, ["o_orderkey"], lookups)
    return new.select(
        "o_orderkey", "customer_sk", date_key("o_orderdate").alias("order_date_key"),
        F.col("o_totalprice").alias("total_amount"),
    )


@query(
    "f2_pit_join",
    f"""SELECT coalesce(priority, 'NONE') AS priority, CAST(coalesce(version_number, 0) AS BIGINT) AS version_number,
               count(*) AS line_count, CAST(sum({M('l_extendedprice')}) AS DOUBLE) AS amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN {PRIORITY_DIM_SQL}
          ON cust_id = o_custkey AND l_shipdate >= valid_from AND l_shipdate < valid_to GROUP BY 1, 2""",
)
def _(t):
    bound = bind_priority(t, shipments(t), ["priority", "version_number"])
    keys = [
        F.coalesce("priority", F.lit("NONE")).alias("priority"),
        F.coalesce("version_number", F.lit(0)).alias("version_number"),
    ]
    return bound.groupBy(*keys).agg(n_rows().alias("line_count"), dbl(F.sum("amount")).alias("amount"))


@query(
    "f3_late_arriving_bind",
    f"""SELECT coalesce(priority, 'NONE') AS priority, coalesce(NOT is_current, false) AS bound_to_past, count(*) AS line_count
        FROM (SELECT o_custkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              WHERE l_shipdate < o_orderdate) LEFT JOIN {PRIORITY_DIM_SQL}
          ON cust_id = o_custkey AND l_shipdate >= valid_from AND l_shipdate < valid_to GROUP BY 1, 2""",
)
def _(t):
    # Lines shipped before their order was dated arrive after the fact and must bind to the past.
    heads = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    lines = t.lineitem.select("l_orderkey", "l_shipdate").join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
    late = lines.filter(F.col("l_shipdate") < F.col("o_orderdate")).select("o_custkey", "l_shipdate")
    biggest = orders_per_customer(t)
    members = priority_dim(t, biggest)
    bound = facts.late_arriving_bind(late, "o_custkey", "l_shipdate", members, "cust_id", ["priority"], most=biggest)
    return bound.groupBy(F.coalesce("priority", F.lit("NONE")).alias("priority"), "bound_to_past").agg(n_rows().alias("line_count"))


@query(
    "f4_obt_mart",
    f"""SELECT r_name, c_mktsegment, p_type, CAST(year(o_orderdate) AS INTEGER) AS order_year, count(*) AS line_count,
               CAST(sum({NET_SQL}) AS DOUBLE) AS revenue FROM lineitem LEFT JOIN {STAR_SQL} GROUP BY 1, 2, 3, 4""",
)
def _(t):
    wide = sales_star(t, t.lineitem)
    return wide.groupBy("r_name", "c_mktsegment", "p_type", F.year("o_orderdate").alias("order_year")).agg(
        n_rows().alias("line_count"), dbl(F.sum(net_amount())).alias("revenue")
    )


ITEM = ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


def order_baskets(t: Tables) -> DataFrame:
    return facts.nested_mart(clean_lines(t, orders_fit=True), "l_orderkey", ["l_linenumber"], ITEM)


@query(
    "f5_nested_mart",
    f"""SELECT l_orderkey, CAST(count(*) AS INTEGER) AS item_count,
               string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber) AS items
        FROM {DEDUP_SQL} GROUP BY 1""",
)
def _(t):
    label = F.transform("items", lambda x: F.concat(x["l_linenumber"], F.lit(":"), x["l_partkey"]))
    return order_baskets(t).select(
        "l_orderkey", F.size("items").alias("item_count"), F.array_join(label, ",").alias("items")
    )


@query(
    "f6_unnest_items",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM {DEDUP_SQL}",
)
def _(t):
    return facts.unnest_items(order_baskets(t), "l_orderkey")


@query(
    "f6_unnest_revenue",
    f"""SELECT l_orderkey, CAST(sum({M('l_quantity')} * {M('l_extendedprice')}) AS DOUBLE) AS revenue
        FROM {DEDUP_SQL} GROUP BY 1""",
)
def _(t):
    revenue = dbl(facts.unnest_revenue("l_quantity", "l_extendedprice"))
    return order_baskets(t).select("l_orderkey", revenue.alias("_r")).groupBy("l_orderkey").agg(F.sum("_r").alias("revenue"))


MILESTONES = {"signup_at": "signup", "view_at": "view", "click_at": "click", "purchase_at": "purchase"}
LAGS = {"signup_to_purchase_days": ("signup_at", "purchase_at"), "view_to_click_days": ("view_at", "click_at")}
FUNNEL_SQL = """(SELECT *, CAST(date_diff('day', CAST(signup_at AS DATE), CAST(purchase_at AS DATE)) AS INTEGER) AS signup_to_purchase_days,
    CAST(date_diff('day', CAST(view_at AS DATE), CAST(click_at AS DATE)) AS INTEGER) AS view_to_click_days FROM (
    SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS signup_at, min(ts) FILTER (WHERE event_type = 'view') AS view_at,
      min(ts) FILTER (WHERE event_type = 'click') AS click_at, min(ts) FILTER (WHERE event_type = 'purchase') AS purchase_at
    FROM events GROUP BY user_id))"""


def user_funnel(t: Tables) -> DataFrame:
    return facts.accumulating_snapshot(t.events, "user_id", "event_type", "ts", MILESTONES, LAGS)


@query(
    "f7_accumulating_snapshot",
    f"""SELECT user_id, signup_to_purchase_days, view_to_click_days, purchase_at IS NOT NULL AS is_active,
               strftime(signup_at, '%Y-%m-%d %H:%M:%S.%f') AS signup_at, strftime(purchase_at, '%Y-%m-%d %H:%M:%S.%f') AS purchase_at
        FROM {FUNNEL_SQL}""",
)
def _(t):
    return user_funnel(t).select(
        "user_id", "signup_to_purchase_days", "view_to_click_days", F.col("purchase_at").isNotNull().alias("is_active"),
        ts_text("signup_at").alias("signup_at"), ts_text("purchase_at").alias("purchase_at"),
    )


@query(
    "f8_funnel_conversion",
    f"""SELECT count(signup_at) AS signup_at_count, count(view_at) AS view_at_count, count(purchase_at) AS purchase_at_count,
               CAST(count(*) FILTER (WHERE signup_at IS NOT NULL AND view_at IS NOT NULL) * 100.0::DOUBLE / count(signup_at) AS DOUBLE)
                 AS signup_at_to_view_at_pct,
               CAST(count(*) FILTER (WHERE view_at IS NOT NULL AND purchase_at IS NOT NULL) * 100.0::DOUBLE / count(view_at) AS DOUBLE)
                 AS view_at_to_purchase_at_pct,
               CAST(sum(signup_to_purchase_days) AS DOUBLE) / count(signup_to_purchase_days) AS avg_signup_to_purchase_days
        FROM {FUNNEL_SQL}""",
)
def _(t):
    snap = user_funnel(t)
    return facts.funnel_conversion(snap, ["signup_at", "view_at", "purchase_at"], ["signup_to_purchase_days"])


SNAPSHOT_SQL = f"""(SELECT s.o_custkey, s.month, coalesce(m.flow, 0) AS flow, sum(coalesce(m.flow, 0)) OVER (
      PARTITION BY s.o_custkey ORDER BY s.month) AS balance FROM (
    SELECT o_custkey, CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)),
      (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH)) AS DATE) AS month FROM orders GROUP BY o_custkey) s
    LEFT JOIN (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum({M('o_totalprice')}) AS flow
      FROM orders GROUP BY 1, 2) m ON m.o_custkey = s.o_custkey AND m.month = s.month)"""


def balances(t: Tables) -> DataFrame:
    return facts.periodic_snapshot(t.orders, "o_custkey", "o_orderdate", money("o_totalprice"))


@query(
    "f9_periodic_snapshot",
    f"""SELECT o_custkey, strftime(month, '%Y-%m-%d') AS month, CAST(flow AS DOUBLE) AS flow, CAST(balance AS DOUBLE) AS balance
        FROM {SNAPSHOT_SQL}""",
)
def _(t):
    return balances(t).select("o_custkey", day_text("month").alias("month"), dbl("flow").alias("flow"), dbl("balance").alias("balance"))


@query(
    "f10_closing_balance",
    f"""SELECT CAST(period AS INTEGER) AS period, CAST(sum(b) AS DOUBLE) AS closing_balance, count(*) AS account_count FROM (
          SELECT year(month) AS period, o_custkey, arg_max(balance, month) AS b FROM {SNAPSHOT_SQL} GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    closing = facts.closing_balance(balances(t), "o_custkey", "month", "balance", F.year("month"))
    return closing.withColumn("closing_balance", dbl("closing_balance"))


@query(
    "f11_cross_section_sum",
    f"""SELECT c_mktsegment, CAST(sum(balance) AS DOUBLE) AS total_balance FROM {SNAPSHOT_SQL}
        JOIN customer ON c_custkey = o_custkey WHERE month = DATE '1998-12-01' GROUP BY 1""",
)
def _(t):
    held = balances(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    on_date = F.col("month") == F.lit("1998-12-01").cast("date")
    out = facts.cross_section_sum(held, on_date, "balance", ["c_mktsegment"])
    return out.withColumn("total_balance", dbl("total_balance"))


def ship_grain():
    return {"ship_month": month_key("l_shipdate"), "l_returnflag": F.col("l_returnflag")}
def ship_measures():
    return {"quantity": money("l_quantity"), "revenue": money("l_extendedprice")}


def monthly_shipments(t: Tables) -> DataFrame:
    return facts.rollup_table(t.lineitem, ship_grain(), ship_measures())


@query(
    "f12_rollup_table",
    f"""SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS ship_month, l_returnflag,
               CAST(sum({M('l_quantity')}) AS DOUBLE) AS quantity, CAST(sum({M('l_extendedprice')}) AS DOUBLE) AS revenue,
               count(*) AS row_count FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    return monthly_shipments(t).withColumns({"quantity": dbl("quantity"), "revenue": dbl("revenue")})


@query(
    "f12_rollup_parity",
    f"""WITH s AS (SELECT CAST(sum({M('l_quantity')}) AS DOUBLE) AS q, CAST(sum({M('l_extendedprice')}) AS DOUBLE) AS r,
                   CAST(count(*) AS DOUBLE) AS n FROM lineitem)
        SELECT 'quantity' AS measure, q AS rollup_total, q AS base_total, 0.0::DOUBLE AS difference FROM s UNION ALL
        SELECT 'revenue', r, r, 0.0 FROM s UNION ALL SELECT 'row_count', n, n, 0.0 FROM s""",
)
def _(t):
    return facts.rollup_parity(monthly_shipments(t), t.lineitem, ship_measures())


@query(
    "f13_aggregate_navigation",
    f"""SELECT 'month' AS answered, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS VARCHAR) AS grain_value,
               CAST(sum({M('l_quantity')}) AS DOUBLE) AS quantity FROM lineitem GROUP BY 2 UNION ALL
        SELECT 'supplier', CAST(l_suppkey AS VARCHAR), CAST(sum({M('l_quantity')}) AS DOUBLE) FROM lineitem GROUP BY 2""",
)
def _(t):
    rollups = [(monthly_shipments(t), list(ship_grain()))]
    measure = {"quantity": ship_measures()["quantity"]}

    def answer(kind, wanted):
        out = facts.aggregate_navigation(wanted, rollups, t.lineitem, measure)
        key = next(iter(wanted))
        return out.select(
            F.lit(kind).alias("answered"), F.col(key).cast("string").alias("grain_value"), dbl("quantity").alias("quantity")
        )

    covered = answer("month", {"ship_month": month_key("l_shipdate")})
    return covered.unionByName(answer("supplier", {"l_suppkey": F.col("l_suppkey")}))


@query(
    "f14_ratio_of_sums",
    f"""SELECT l_returnflag, l_linestatus, CAST(sum({M('l_extendedprice')} * CAST(l_discount AS DECIMAL(5,2))) AS DOUBLE)
               / CAST(sum({M('l_extendedprice')}) AS DOUBLE) AS discount_rate FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    num = money("l_extendedprice") * rate("l_discount")
    return facts.ratio_of_sums(t.lineitem, ["l_returnflag", "l_linestatus"], num, money("l_extendedprice"), "discount_rate")


def attendance():
    return {"user_id": F.col("user_id"), "event_type": F.col("event_type"), "date_key": date_key("ts")}


@query(
    "f15_factless_fact",
    """SELECT DISTINCT user_id, event_type, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS INTEGER) AS date_key FROM events""",
)
def _(t):
    return facts.factless_fact(t.events, attendance())


@query(
    "f15_occurrence_count",
    """SELECT event_type, count(*) AS occurrences, count(DISTINCT user_id) AS users FROM (
         SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events) GROUP BY 1""",
)
def _(t):
    seen = facts.factless_fact(t.events, attendance())
    return seen.groupBy("event_type").agg(n_rows().alias("occurrences"), F.count_distinct("user_id").alias("users"))


@query(
    "f16_coverage_gap",
    """WITH sold AS (SELECT DISTINCT n_name, p_brand, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS ym
         FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
         JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey),
       cal AS (SELECT DISTINCT CAST(year(d) * 100 + month(d) AS INTEGER) AS ym FROM (SELECT unnest(generate_series(
         (SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS d))
       SELECT n_name, p_brand, ym FROM (SELECT DISTINCT n_name, p_brand FROM sold), cal
       EXCEPT SELECT n_name, p_brand, ym FROM sold""",
)
def _(t):
    # Covered: every month of the calendar for each nation and brand that ever traded.
    wide = sales_star(t, t.lineitem.select("l_orderkey", "l_partkey"))
    sold = facts.factless_fact(
        wide, {"n_name": F.col("n_name"), "p_brand": F.col("p_brand"), "ym": month_key("o_orderdate")}
    )
    span = t.orders.agg(F.min(F.trunc("o_orderdate", "month")), F.max(F.trunc("o_orderdate", "month"))).first()
    months = F.sequence(F.lit(span[0]), F.lit(span[1]), F.expr("interval 1 month"))
    coverage = sold.select("n_name", "p_brand").distinct().withColumn("m", F.explode(months))
    coverage = coverage.select("n_name", "p_brand", month_key("m").alias("ym"))
    return facts.coverage_gap(coverage, sold, ["n_name", "p_brand", "ym"])


BRIDGE_SQL = f"""(SELECT l_orderkey, l_suppkey, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, l_suppkey DESC) = 1
      THEN p + 1 - sum(p) OVER (PARTITION BY l_orderkey) ELSE p END AS weight FROM (
    SELECT *, CAST(CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY l_orderkey) AS DOUBLE) AS DECIMAL(20,6)) AS p FROM (
      SELECT l_orderkey, l_suppkey, sum({M('l_extendedprice')}) AS w FROM lineitem GROUP BY 1, 2)))"""


def supplier_bridge(t: Tables) -> DataFrame:
    biggest = largest_group(t.lineitem, ["l_orderkey"])
    return facts.weighted_bridge(t.lineitem, "l_orderkey", "l_suppkey", money("l_extendedprice"), biggest=biggest)


@query("f17_weighted_bridge", f"SELECT l_orderkey, l_suppkey, CAST(weight AS DOUBLE) AS allocation_weight FROM {BRIDGE_SQL}")
def _(t):
    return supplier_bridge(t).withColumn("allocation_weight", dbl("allocation_weight"))


@query(
    "f17_weighted_attribution",
    f"""SELECT l_suppkey, CAST(sum({M('o_totalprice')} * CAST(weight AS DECIMAL(9,6))) AS DOUBLE) AS attributed
        FROM {BRIDGE_SQL} JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
)
def _(t):
    heads = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), money("o_totalprice").alias("amount"))
    out = facts.attribute_by_weight(heads, supplier_bridge(t), "l_orderkey", "l_suppkey", "amount", "attributed")
    return out.withColumn("attributed", dbl("attributed"))


@query(
    "f18_bridge_secondary_count",
    """SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber > 1) AS secondary_count FROM (
         SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem) GROUP BY 1""",
)
def _(t):
    bridge = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    return facts.bridge_member_count(bridge, "l_orderkey", F.col("l_linenumber") > 1, "secondary_count")


# fixed values: reporting currency of each region in the derived currency data
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CHF")
RATE_SQL = """CAST(CASE WHEN {c} = 'USD' THEN 1 ELSE (50 + (CAST(strftime({d}, '%Y%m%d') AS BIGINT) + unicode({c})) % 97) / 100.0 END AS DECIMAL(12,6))"""
CURRENCY_SQL = "list_extract(['USD','EUR','GBP','JPY','CHF'], CAST(n_regionkey + 1 AS BIGINT))"


def currency_rates(t: Tables) -> DataFrame:
    """A spot rate for each day and currency from the first order to 30 days after the last."""
    span = t.orders.select(F.col("o_orderdate").alias("d")).unionByName(
        t.orders.select((F.col("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("d"))
    )
    days = date_dimension(span, "d").select("calendar_date", "date_sk")
    codes = days.withColumn("currency_code", F.explode(F.array(*[F.lit(c) for c in CURRENCIES])))
    moving = ((F.lit(50) + (F.col("date_sk") + F.ascii("currency_code")) % 97) / 100).cast("decimal(12,6)")
    return codes.select(
        F.col("calendar_date").cast("timestamp_ntz").alias("rate_date"),
        "currency_code",
        F.when(F.col("currency_code") == "USD", F.lit(1).cast("decimal(12,6)")).otherwise(moving).alias("spot_rate"),
    )


def foreign_orders(t: Tables) -> DataFrame:
    cust = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), F.col("n_regionkey") + 1)
    rows = t.orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_orderdate", (F.col("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("payment_date"),
        code.alias("currency_code"), money("o_totalprice").alias("local_amount"),
    )
    rates = currency_rates(t)
    booked = facts.fx_triad(rows, rates, "o_orderdate", "currency_code", "local_amount", "order")
    return facts.fx_triad(booked, rates, "payment_date", "currency_code", "local_amount", "payment")


FX_SQL = f"""(SELECT o_orderkey, c AS currency_code, a AS local_amount, r1 AS order_rate, CAST(a * r1 AS DECIMAL(28,6)) AS order_usd,
    CAST(a * r2 AS DECIMAL(28,6)) AS payment_usd FROM (SELECT o_orderkey, {CURRENCY_SQL} AS c, {M('o_totalprice')} AS a,
      {RATE_SQL.format(c=CURRENCY_SQL, d='o_orderdate')} AS r1,
      {RATE_SQL.format(c=CURRENCY_SQL, d='(o_orderdate + INTERVAL 30 DAY)')} AS r2
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey))"""


@query(
    "f19_fx_triad",
    f"""SELECT o_orderkey, currency_code, CAST(local_amount AS DOUBLE) AS local_amount, CAST(order_rate AS DOUBLE) AS order_rate,
               CAST(order_usd AS DOUBLE) AS order_usd FROM {FX_SQL}""",
)
def _(t):
    rows = foreign_orders(t)
    return rows.select("o_orderkey", "currency_code", *[dbl(c).alias(c) for c in ("local_amount", "order_rate", "order_usd")])


@query(
    "f20_fx_variance",
    f"""SELECT currency_code, CAST(sum(order_usd) AS DOUBLE) AS order_usd, CAST(sum(payment_usd - order_usd) AS DOUBLE) AS realized_variance,
               CAST(sum(local_amount * order_rate - order_usd) AS DOUBLE) AS triangulation_drift FROM {FX_SQL} GROUP BY 1""",
)
def _(t):
    drift = F.col("local_amount") * F.col("order_rate") - F.col("order_usd")
    return foreign_orders(t).groupBy("currency_code").agg(
        dbl(F.sum("order_usd")).alias("order_usd"),
        dbl(F.sum(F.col("payment_usd") - F.col("order_usd"))).alias("realized_variance"),
        dbl(F.sum(drift)).alias("triangulation_drift"),
    )


@query(
    "f21_drill_across",
    f"""WITH o AS (SELECT o_custkey AS cust_id, CAST(year(o_orderdate) AS INTEGER) AS yr, sum({M('o_totalprice')}) AS ordered FROM orders GROUP BY 1, 2),
             s AS (SELECT o_custkey AS cust_id, CAST(year(l_shipdate) AS INTEGER) AS yr, sum({M('l_extendedprice')}) AS shipped
                   FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
        SELECT coalesce(o.cust_id, s.cust_id) AS cust_id, coalesce(o.yr, s.yr) AS yr, CAST(coalesce(ordered, 0) AS DOUBLE) AS ordered,
               CAST(coalesce(shipped, 0) AS DOUBLE) AS shipped, CAST(coalesce(ordered, 0) - coalesce(shipped, 0) AS DOUBLE) AS variance,
               o.cust_id IS NOT NULL AS in_orders, s.cust_id IS NOT NULL AS in_shipments
        FROM o FULL JOIN s ON o.cust_id = s.cust_id AND o.yr = s.yr""",
)
def _(t):
    ordered = t.orders.groupBy(F.col("o_custkey").alias("cust_id"), F.year("o_orderdate").alias("yr")).agg(
        F.sum(money("o_totalprice")).alias("ordered")
    )
    shipped = shipments(t).groupBy(F.col("o_custkey").alias("cust_id"), F.year("l_shipdate").alias("yr")).agg(
        F.sum("amount").alias("shipped")
    )
    both = facts.drill_across({"orders": ordered, "shipments": shipped}, ["cust_id", "yr"])
    return both.select(
        "cust_id", "yr", dbl("ordered").alias("ordered"), dbl("shipped").alias("shipped"),
        dbl(F.col("ordered") - F.col("shipped")).alias("variance"), "in_orders", "in_shipments",
    )


@query(
    "f22_multi_fact_value_stream",
    f"""SELECT 'orders' AS process, count(*) AS row_count, count(DISTINCT o_custkey) AS members,
               CAST(sum({M('o_totalprice')}) AS DOUBLE) AS amount FROM orders UNION ALL
        SELECT 'shipments', count(*), count(DISTINCT l_suppkey), CAST(sum({M('l_extendedprice')}) AS DOUBLE) FROM lineitem UNION ALL
        SELECT 'payments', count(*), count(DISTINCT user_id), CAST(sum({M('value')}) AS DOUBLE) FROM events WHERE event_type = 'purchase'""",
)
def _(t):
    def process(name, df, member, amount):
        return df.agg(
            n_rows().alias("row_count"), F.count_distinct(member).alias("members"), dbl(F.sum(money(amount))).alias("amount")
        ).withColumn("process", F.lit(name))

    paid = t.events.filter("event_type = 'purchase'")
    out = process("orders", t.orders, "o_custkey", "o_totalprice")
    out = out.unionByName(process("shipments", t.lineitem, "l_suppkey", "l_extendedprice"))
    return out.unionByName(process("payments", paid, "user_id", "value"))


@query(
    "f23_header_allocation",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, {M('l_extendedprice')} AS share, {M('o_totalprice')} AS total
                   FROM {DEDUP_SQL} JOIN orders ON o_orderkey = l_orderkey),
             y AS (SELECT *, CAST(CAST(total AS DOUBLE) * CAST(share AS DOUBLE)
                     / CAST(sum(share) OVER (PARTITION BY l_orderkey) AS DOUBLE) AS DECIMAL(20,2)) AS p FROM x)
        SELECT l_orderkey, l_linenumber, CAST(CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY share DESC, l_linenumber DESC) = 1
               THEN p + total - sum(p) OVER (PARTITION BY l_orderkey) ELSE p END AS DOUBLE) AS allocated FROM y""",
)
def _(t):
    biggest = largest_group(t.lineitem, ["l_orderkey"])
    heads = t.orders.select("o_orderkey", money("o_totalprice").alias("total"))
    lines = clean_lines(t, biggest).join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
    share = money("l_extendedprice")
    out = facts.allocate(lines, "l_orderkey", ["l_linenumber"], share, F.col("total"), "allocated", 2, biggest=biggest)
    return out.select("l_orderkey", "l_linenumber", dbl("allocated").alias("allocated"))


@query(
    "f24_header_summary_mart",
    f"""SELECT o_orderkey, CAST({M('o_totalprice')} AS DOUBLE) AS header_amount, CAST(s AS DOUBLE) AS line_amount,
               coalesce(n, 0) AS line_count FROM orders LEFT JOIN (SELECT l_orderkey, sum({M('l_extendedprice')}) AS s, count(*) AS n
               FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def _(t):
    mart = facts.header_summary(
        t.lineitem, t.orders, "l_orderkey", "o_orderkey", {"line_amount": money("l_extendedprice")}
    )
    return mart.select(
        "o_orderkey", dbl(money("o_totalprice")).alias("header_amount"), dbl("line_amount").alias("line_amount"),
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
    )


@query(
    "f25_telemetry_average",
    f"""SELECT user_id, CAST(sum({M('value')}) AS DOUBLE) / count(value) AS avg_value, count(*) AS reading_count FROM events
        WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1 HAVING CAST(sum({M('value')}) AS DOUBLE) / count(value) > 50""",
)
def _(t):
    return facts.entity_average(t.events, "user_id", money("value"), F.col("ts") >= ntz("2024-01-15"), 50.0)


@query(
    "f25_named_average",
    f"""SELECT c_name, CAST(sum({M('value')}) AS DOUBLE) / count(value) AS avg_value, count(*) AS reading_count FROM events JOIN customer ON c_custkey = user_id
        WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1 HAVING CAST(sum({M('value')}) AS DOUBLE) / count(value) > 50""",
)
def _(t):
    cut = F.col("ts") >= ntz("2024-01-15")
    return facts.named_entity_average(t.events, "user_id", money("value"), cut, 50.0, t.customer, "c_custkey", "c_name")


@query(
    "f26_time_series_rollup",
    f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS bucket_start, event_type, count(*) AS reading_count,
               CAST(sum({M('value')}) AS DOUBLE) AS total, min(value) AS lowest, max(value) AS highest FROM events GROUP BY 1, 2""",
)
def _(t):
    out = facts.time_series_rollup(t.events, "ts", "1 hour", ["event_type"], money("value"))
    return out.withColumn("bucket_start", ts_text("bucket_start")).withColumns({c: dbl(c) for c in ("total", "lowest", "highest")})


APPORTION_SQL = """SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY u * w % s DESC, w DESC, m) <= u - sum(u * w // s) OVER (PARTITION BY g) AS HUGEINT)
      + u * w // s AS part FROM (SELECT *, sum(w) OVER (PARTITION BY g) AS s FROM ({}))""".format


@query(
    "f17_apportioned_bridge",
    f"""SELECT g AS l_orderkey, m AS l_suppkey, CAST(part AS DOUBLE) / 1000000 AS allocation_weight FROM ({APPORTION_SQL(
        f"SELECT l_orderkey AS g, l_suppkey AS m, CAST(sum({M('l_extendedprice')}) * 100 AS HUGEINT) AS w, 1000000::HUGEINT AS u FROM lineitem GROUP BY 1, 2")})""",
)
def _(t):
    pre = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum(money("l_extendedprice")).alias("w"))
    out = facts.apportion(pre, "l_orderkey", ["l_suppkey"], F.col("w"), F.lit(1), "allocation_weight", 6, biggest=largest_group(t.lineitem, ["l_orderkey"]))
    return out.select("l_orderkey", "l_suppkey", dbl("allocation_weight").alias("allocation_weight"))


@query(
    "f23_header_apportionment",
    f"""SELECT g AS l_orderkey, m AS l_linenumber, CAST(part AS DOUBLE) / 100 AS allocated FROM ({APPORTION_SQL(
        f"SELECT l_orderkey AS g, l_linenumber AS m, CAST({M('l_extendedprice')} * 100 AS HUGEINT) AS w, CAST({M('o_totalprice')} * 100 AS HUGEINT) AS u "
        f"FROM {DEDUP_SQL} JOIN orders ON o_orderkey = l_orderkey")})""",
)
def _(t):
    biggest = largest_group(t.lineitem, ["l_orderkey"])
    heads = t.orders.select("o_orderkey", money("o_totalprice").alias("total"))
    lines = clean_lines(t, biggest).join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
    out = facts.apportion(lines, "l_orderkey", ["l_linenumber"], money("l_extendedprice"), F.col("total"), "allocated", 2, biggest=biggest)
    return out.select("l_orderkey", "l_linenumber", dbl("allocated").alias("allocated"))


def conformed_bus(t: Tables) -> DataFrame:
    people = t.customer.select(F.col("c_custkey").alias("cust_id"), md5_key("c_custkey").alias("customer_sk"), "c_mktsegment")

    def day(df, member, when, amount):
        return df.select(F.col(member).alias("cust_id"), F.col(when).alias("day"), amount.alias("amount"))

    shipped = day(shipments(t), "o_custkey", "l_shipdate", F.col("amount"))
    paid = day(t.events.filter("event_type = 'purchase'"), "user_id", "ts", money("value"))
    ordered = day(t.orders, "o_custkey", "o_orderdate", money("o_totalprice"))
    return facts.conformed_facts({"orders": ordered, "shipments": shipped, "payments": paid}, people, "cust_id", "customer_sk")


BUS_SQL = f"""(SELECT process, coalesce(md5(CAST(c_custkey AS VARCHAR)), '-1') AS customer_sk, c_mktsegment, amount,
      CAST(year(day) * 10000 + month(day) * 100 + day(day) AS INTEGER) AS date_key FROM (
    SELECT 'orders' AS process, o_custkey AS cust_id, CAST(o_orderdate AS DATE) AS day, {M('o_totalprice')} AS amount FROM orders UNION ALL
    SELECT 'shipments', o_custkey, CAST(l_shipdate AS DATE), {M('l_extendedprice')} FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL
    SELECT 'payments', user_id, CAST(ts AS DATE), {M('value')} FROM events WHERE event_type = 'purchase') LEFT JOIN customer ON c_custkey = cust_id)"""


@query(
    "f22_conformed_facts",
    f"SELECT process, customer_sk, date_key, count(*) AS row_count, CAST(sum(amount) AS DOUBLE) AS amount FROM {BUS_SQL} GROUP BY 1, 2, 3",
)
def _(t):
    return conformed_bus(t).groupBy("process", "customer_sk", "date_key").agg(n_rows().alias("row_count"), dbl(F.sum("amount")).alias("amount"))


@query(
    "f22_conformed_totals",
    f"""SELECT process, coalesce(c_mktsegment, 'Unknown') AS segment, CAST(date_key // 10000 AS INTEGER) AS yr, count(*) AS row_count,
               count(DISTINCT customer_sk) AS customers, CAST(sum(amount) AS DOUBLE) AS amount FROM {BUS_SQL} GROUP BY 1, 2, 3""",
)
def _(t):
    keys = ["process", F.coalesce("c_mktsegment", F.lit("Unknown")).alias("segment"), (F.col("date_key") / 10000).cast("int").alias("yr")]
    return conformed_bus(t).groupBy(*keys).agg(
        n_rows().alias("row_count"), F.count_distinct("customer_sk").alias("customers"), dbl(F.sum("amount")).alias("amount")
    )
