"""The three-batch integration on feeds derived from the given tables.

Suppliers are companies, parts securities, nations brokers, customers customers (those with an overdrawn
balance join only in batch 2), (customer, order priority) accounts, de-duplicated order lines trades at
their ship date. Orders before 1998 are batch 1, before July 2000 batch 2, the rest batch 3; since ship
dates spread over all years, every batch brings late trades. Orders without customer and lines without order
stay in the feeds, for the loader to reject (undated rows in batch 3); the SQL, which joins inner, lacks them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions.columns import dbl, money, month_key, n_rows, ntz, rate
from terrace.functions.frames import side_by_side
from terrace.operators import integration as it
from terrace.operators.ordered import largest_group
from terrace.plans.registry import Tables, query
from terrace.plans.sources_silver import DEDUP_SQL, clean_lines
from terrace.session import small_table, written

C = F.col

M = "CAST({} AS DECIMAL(18,2))".format
OPENED, CHANGED = "1990-01-01", "1998-01-15"
def rules():
    return {**it.trade_rules(), "discount within contract": C("fee") <= C("price") * F.lit("0.08").cast("decimal(5,2)")}


def batch_of(ts: str):
    return F.when(C(ts) < ntz("1998-01-01"), 1).when(C(ts) < ntz("2000-07-01"), 2).otherwise(3)


def shaped(df: DataFrame, feed: str) -> DataFrame:
    return df.select(*[C(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(it.FEEDS[feed])])


def order_rows(t: Tables) -> DataFrame:
    heads = t.orders.join(t.customer, C("o_custkey") == C("c_custkey"), "left")
    account = F.concat(C("o_custkey"), F.lit("-"), F.left("o_orderpriority", F.lit(1)))
    return heads.withColumns({"batch": batch_of("o_orderdate"), "account_id": account, "is_new": F.coalesce(C("c_acctbal") < 0, F.lit(False))})


def stored_orders(t: Tables) -> DataFrame:
    """Orders with what is known of their customers: stored once because trades, feeds and control totals read them."""
    used = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "c_custkey", "c_nationkey", "batch", "account_id", "is_new")
    return written(order_rows(t).select(*used), "orders")


def trade_rows(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """All trades of all batches: stored once because every batch reads a part of them."""
    heads = order_rows(t) if orders is None else orders
    rows = clean_lines(t, largest_group(t.lineitem, ["l_orderkey"])).join(heads, C("l_orderkey") == C("o_orderkey"), "left")
    price = money("l_extendedprice")
    return rows.select(
        (C("l_orderkey") * 10 + C("l_linenumber")).alias("trade_id"), C("c_nationkey").alias("broker_id"),
        C("o_custkey").alias("customer_id"), "account_id", C("l_partkey").alias("security_id"),
        C("l_shipdate").alias("traded_at"), price.alias("price"), money("l_quantity").alias("quantity"),
        (price * rate("l_discount")).alias("fee"), (price * rate("l_tax")).alias("commission"), F.lit(0).alias("tax"),
        "l_linestatus", F.coalesce("batch", F.lit(3)).alias("batch"),
    )


def feeds(t: Tables, trades: DataFrame, batch: int, orders: DataFrame | None = None) -> dict[str, DataFrame]:
    orders = (order_rows(t) if orders is None else orders).filter(C("batch") == batch)
    mine = trades.filter(C("batch") == batch)
    opened = ntz(OPENED) if batch == 1 else ntz(CHANGED)
    accounts = orders if batch > 1 else orders.filter(~C("is_new"))
    out = {
        "trade": mine,
        "holding": mine.filter("l_linestatus = 'O'").withColumn("held_at", C("traded_at")),
        "cash": orders.groupBy("account_id", C("o_custkey").alias("customer_id"), C("o_orderdate").alias("balance_at")).agg(
            F.sum(money("o_totalprice")).alias("cash")
        ),
        "market": mine.groupBy("security_id", month_key("traded_at").alias("date_key")).agg(
            F.max_by("price", F.struct("traded_at", "trade_id")).alias("close"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.sum("quantity").alias("volume"),
        ),
    }
    if batch < 3:
        out["account"] = accounts.groupBy("account_id", C("o_custkey").alias("customer_id")).agg(
            F.max("o_orderpriority").alias("description")
        ).withColumn("effective_at", opened)
    who = t.customer.select(
        C("c_custkey").alias("customer_id"), C("c_name").alias("last_name"), C("c_mktsegment").alias("tier"),
        C("c_nationkey").cast("string").alias("city"), "c_acctbal",
    )
    if batch == 1:
        out["customer"] = who.filter("c_acctbal >= 0").withColumn("effective_at", ntz(OPENED))
        out["company"] = t.supplier.select(
            C("s_suppkey").alias("company_id"), C("s_name").alias("company_name"), C("s_nationkey").cast("string").alias("industry"),
            ntz(OPENED).alias("effective_at"),
        )
        issuer = t.lineitem.groupBy(C("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("company_id"))
        out["security"] = t.part.join(issuer, "p_partkey", "left").select(
            C("p_partkey").alias("security_id"), C("p_name").alias("symbol"), C("p_type").alias("issue_type"), "company_id",
            ntz(OPENED).alias("effective_at"),
        )
        out["broker"] = t.nation.select(C("n_nationkey").alias("broker_id"), C("n_name").alias("broker_name"))
        views = t.events.filter("event_type = 'view'").select(
            C("user_id").alias("customer_id"), F.get_json_object("props", "$.k").cast("bigint").alias("security_id"), "ts"
        )
        out["watch"] = views.groupBy("customer_id", "security_id").agg(F.min("ts").alias("placed_at"))
        out["prospect"] = t.customer.filter("c_acctbal < 0").select(
            C("c_custkey").cast("string").alias("agency_id"), C("c_name").alias("last_name"), C("c_acctbal").alias("net_worth")
        )
    elif batch == 2:
        january = t.orders.filter((C("o_orderdate") >= ntz("1998-01-01")) & (C("o_orderdate") < ntz("1998-02-01")))
        active = who.filter("c_acctbal >= 0").join(january, C("customer_id") == C("o_custkey"), "left_semi")
        joined = who.filter("c_acctbal < 0").unionByName(active.withColumn("tier", F.lit("GOLD")))
        out["customer"] = joined.withColumn("effective_at", ntz(CHANGED))
    return {name: shaped(df, name) for name, df in out.items()}


def run_batches(t: Tables, upto: int, orders: DataFrame | None = None) -> tuple[it.State, DataFrame]:
    orders = stored_orders(t) if orders is None else orders
    trades = written(trade_rows(t, orders), "trades")
    state: it.State = {}
    for batch in range(1, upto + 1):
        state = it.load_batch(state, feeds(t, trades, batch, orders), batch, rules())
    return state, trades


BASE_SQL = f"""WITH o AS (SELECT orders.*, c_nationkey, c_acctbal, c_acctbal < 0 AS is_new, o_custkey || '-' || left(o_orderpriority, 1) AS account_id,
    CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 1 WHEN o_orderdate < TIMESTAMP '2000-07-01' THEN 2 ELSE 3 END AS batch
    FROM orders JOIN customer ON c_custkey = o_custkey),
  tr AS (SELECT l_orderkey * 10 + l_linenumber AS trade_id, account_id, l_partkey, l_shipdate AS ts, {M('l_extendedprice')} AS price,
    {M('l_quantity')} AS qty, CAST(l_discount AS DECIMAL(5,2)) AS disc, CAST(l_tax AS DECIMAL(5,2)) AS tax, l_linestatus, is_new, batch
    FROM {DEDUP_SQL} JOIN o ON o_orderkey = l_orderkey),
  acc AS (SELECT account_id, min(batch) AS b FROM (SELECT account_id, batch FROM o WHERE (batch = 1 AND NOT is_new) OR batch = 2) GROUP BY 1),
  chk AS (SELECT tr.*, disc <= 0.08 AND b <= batch AND NOT (is_new AND ts < TIMESTAMP '{CHANGED}') IS TRUE AS good FROM tr LEFT JOIN acc USING (account_id)),
  ok AS (SELECT * FROM chk WHERE good), hold AS (SELECT * FROM chk WHERE l_linestatus = 'O' AND good),
  cash AS (SELECT o.account_id, o_orderdate, o.batch, sum({M('o_totalprice')}) AS cash FROM o JOIN acc ON acc.account_id = o.account_id AND b <= o.batch
    WHERE NOT (is_new AND o_orderdate < TIMESTAMP '{CHANGED}') GROUP BY 1, 2, 3),
  mk AS (SELECT l_partkey, year(ts) AS y, month(ts) AS m, batch, sum(qty) AS v FROM tr GROUP BY 1, 2, 3, 4),
  wt AS (SELECT DISTINCT user_id, regexp_extract(props, '([0-9]+)', 1) AS k FROM events JOIN customer ON c_custkey = user_id
    WHERE event_type = 'view' AND c_acctbal >= 0),
  seen AS (SELECT DISTINCT user_id, regexp_extract(props, '([0-9]+)', 1) AS k FROM events WHERE event_type = 'view'),
  gold AS (SELECT DISTINCT o_custkey FROM o WHERE NOT is_new AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01') """


def totals_sql(b: int) -> str:
    customers = "(SELECT count(*) FROM customer WHERE c_acctbal >= 0)"
    if b > 1:
        customers += " + (SELECT count(*) FROM gold) + (SELECT count(*) FROM customer WHERE c_acctbal < 0)"
    rows = [
        ("dim_account", f"(SELECT count(*) FROM acc WHERE b <= {b})", "NULL"),
        ("dim_broker", "(SELECT count(*) FROM nation)", "NULL"), ("dim_company", "(SELECT count(*) FROM supplier)", "NULL"),
        ("dim_customer", customers, "NULL"), ("dim_security", "(SELECT count(*) FROM part)", "NULL"),
        ("fact_cash", f"(SELECT count(*) FROM cash WHERE batch <= {b})", f"(SELECT sum(cash) FROM cash WHERE batch <= {b})"),
        ("fact_holding", f"(SELECT count(*) FROM hold WHERE batch <= {b})", f"(SELECT sum(qty) FROM hold WHERE batch <= {b})"),
        ("fact_market", f"(SELECT count(*) FROM mk WHERE batch <= {b})", f"(SELECT sum(v) FROM mk WHERE batch <= {b})"),
        ("fact_trade", f"(SELECT count(*) FROM ok WHERE batch <= {b})", f"(SELECT sum(price * qty) FROM ok WHERE batch <= {b})"),
        ("fact_watch", "(SELECT count(*) FROM wt)", "NULL"),
        ("messages", f"(SELECT count(*) + count(*) FILTER (WHERE l_linestatus = 'O') FROM chk WHERE batch <= {b} AND NOT coalesce(good, false))"
         f" + (SELECT count(DISTINCT (account_id, o_orderdate, batch)) FROM o WHERE batch <= {b}) - (SELECT count(*) FROM cash WHERE batch <= {b})"
         f" + (SELECT count(*) FROM seen) - (SELECT count(*) FROM wt) + 2 * {b}", "NULL"),
        ("prospect", "(SELECT count(*) FROM customer WHERE c_acctbal < 0)", "NULL"),
    ]
    return BASE_SQL + " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, CAST({c} AS BIGINT) AS row_count, CAST({a} AS DOUBLE) AS amount" for n, c, a in rows
    )


@query("d1_historical_load", totals_sql(1))
def _(t):
    return it.control_totals(run_batches(t, 1)[0])


@query("d2_incremental_load", totals_sql(2))
def _(t):
    return it.control_totals(run_batches(t, 2)[0])


@query("d3_late_load", totals_sql(3))
def _(t):
    return it.control_totals(run_batches(t, 3)[0])


@query(
    "d3_late_binding",
    BASE_SQL + f"""SELECT trade_id, CAST(split_part(account_id, '-', 1) AS BIGINT) AS customer_id, batch AS batch_id,
         CAST(CASE WHEN second THEN 2 ELSE 1 END AS INTEGER) AS version_number, CASE WHEN second OR is_new THEN '{CHANGED}' ELSE '{OPENED}' END AS valid_from,
         second OR is_new OR CAST(split_part(account_id, '-', 1) AS BIGINT) NOT IN (SELECT o_custkey FROM gold) AS is_current
       FROM (SELECT *, batch >= 2 AND ts >= TIMESTAMP '{CHANGED}' AND CAST(split_part(account_id, '-', 1) AS BIGINT) IN (SELECT o_custkey FROM gold) AS second FROM ok)""",
)
def _(t):
    # Each accepted trade with the customer version it was bound to: a trade that comes late keeps the version of its day.
    state, _ = run_batches(t, 3)
    versions = state["dim_customer"].select(C("version_sk").alias("sk_customer_id"), "customer_id", "version_number", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), "is_current")
    bound = state["fact_trade"].select("trade_id", "sk_customer_id", "batch_id").join(versions, "sk_customer_id", "left")
    return bound.select("trade_id", "customer_id", "batch_id", "version_number", "valid_from", "is_current")


def expected_totals(t: Tables, trades: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Control totals of the audits straight from the sources, without the loader."""
    orders = order_rows(t) if orders is None else orders
    opening = ((C("batch") == 1) & ~C("is_new")) | (C("batch") == 2)
    known = C("c_custkey").isNotNull()
    acc = orders.filter(opening & known).groupBy("account_id").agg(F.min("batch").alias("b"))
    refused = orders.filter(opening & ~known).select("batch", "account_id", "o_custkey").distinct().agg(dbl(n_rows()).alias("refused"))
    late_joiners = t.customer.filter("c_acctbal < 0").select(C("c_custkey").alias("customer_id"), F.lit(True).alias("late"))
    seen = lambda df, ts: df.join(acc, "account_id").join(late_joiners, "customer_id", "left").filter(
        (C("b") <= C("batch")) & ~(C("late").isNotNull() & (C(ts) < ntz(CHANGED)))
    )
    good = seen(trades, "traded_at").filter(rules()["discount within contract"])
    trade = good.agg(
        dbl(n_rows()).alias("6"), dbl(F.sum(C("price") * C("quantity"))).alias("12"), dbl(F.sum("commission")).alias("13"), dbl(F.sum("fee")).alias("14"),
        dbl(F.count_if(C("l_linestatus") == "O")).alias("7"), dbl(F.sum(F.when(C("l_linestatus") == "O", C("quantity")))).alias("15"),
    )
    total = side_by_side(trades.agg(dbl(n_rows()).alias("all")), trade.select(C("6").alias("kept")), refused)
    total = total.select((C("all") - C("kept") + C("refused")).alias("45"))
    paid = seen(orders.withColumn("customer_id", C("o_custkey")), "o_orderdate")
    amount = money("o_totalprice")
    cash = paid.agg(
        *[dbl(F.sum(F.when(C("batch") == b, amount))).alias(str(15 + b)) for b in (1, 2)], dbl(F.sum(amount)).alias("18"),
        dbl(F.count_distinct("account_id", "o_orderdate", "batch")).alias("8"),
    )
    january = (C("o_orderdate") >= ntz("1998-01-01")) & (C("o_orderdate") < ntz("1998-02-01")) & ~C("is_new") & known
    gold = orders.filter(january).agg(dbl(F.count_distinct("o_custkey")).alias("25"))
    people = t.customer.agg(dbl(n_rows()).alias("n"), dbl(F.count_if(C("c_acctbal") < 0)).alias("11"))
    versions = side_by_side(people, gold).select((C("n") + C("25")).alias("1"), "25", "11")
    watched = t.events.filter("event_type = 'view'").join(t.customer.filter("c_acctbal >= 0"), C("user_id") == C("c_custkey"), "left_semi")
    frames = [
        trade, total, cash, versions, acc.agg(dbl(n_rows()).alias("2")), t.part.agg(dbl(n_rows()).alias("3")), t.supplier.agg(dbl(n_rows()).alias("4")),
        t.nation.agg(dbl(n_rows()).alias("5")), trades.agg(dbl(F.count_distinct("security_id", month_key("traded_at"), "batch")).alias("9")),
        watched.agg(dbl(F.count_distinct("user_id", F.get_json_object("props", "$.k"))).alias("10")),
    ]
    out = None
    for df in frames:
        entries = [F.struct(F.lit(int(c)).alias("audit_id"), C(c).alias("expected")) for c in df.columns]
        one = df.select(F.inline(F.array(*entries)))
        out = one if out is None else out.unionByName(one)
    return out.unionByName(small_table(t.spark, [(44, 3.0)], "audit_id int, expected double"))


def audit_sql() -> str:
    values = {
        1: "(SELECT count(*) FROM customer) + (SELECT count(*) FROM gold)", 2: "(SELECT count(*) FROM acc)", 3: "(SELECT count(*) FROM part)",
        4: "(SELECT count(*) FROM supplier)", 5: "(SELECT count(*) FROM nation)", 6: "(SELECT count(*) FROM ok)", 7: "(SELECT count(*) FROM hold)",
        8: "(SELECT count(*) FROM cash)", 9: "(SELECT count(*) FROM mk)", 10: "(SELECT count(*) FROM wt)",
        11: "(SELECT count(*) FROM customer WHERE c_acctbal < 0)", 12: "(SELECT sum(price * qty) FROM ok)", 13: "(SELECT sum(price * tax) FROM ok)",
        14: "(SELECT sum(price * disc) FROM ok)", 15: "(SELECT sum(qty) FROM hold)", 16: "(SELECT sum(cash) FROM cash WHERE batch = 1)",
        17: "(SELECT sum(cash) FROM cash WHERE batch = 2)", 18: "(SELECT sum(cash) FROM cash)", 25: "(SELECT count(*) FROM gold)", 44: "3",
        45: "(SELECT count(*) FROM chk WHERE NOT coalesce(good, false))",
    }
    rows = []
    for i, (title, _op) in it.AUDITS.items():
        v = f"CAST({values.get(i, '0')} AS DOUBLE)"
        rows.append(f"SELECT CAST({i} AS INTEGER) AS audit_id, '{title}' AS title, {v} AS expected, {v} AS actual, true AS passed")
    return BASE_SQL + " UNION ALL ".join(rows)


@query("d4_audit", audit_sql())
def _(t):
    orders = stored_orders(t)
    state, trades = run_batches(t, 3, orders)
    return it.audits(state, expected_totals(t, trades, orders))
