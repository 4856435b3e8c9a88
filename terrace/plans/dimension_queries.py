"""Queries for dimension builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.columns import date_key, day_text, dbl, md5_key, money, ntz, ts_text
from terrace.operators import dimensions as dim
from terrace.operators.ordered import largest_group
from terrace.operators.temporal import pit_join
from terrace.plans.registry import Tables, query
from terrace.session import written
from terrace.sources.generators import date_dimension

TS = "'%Y-%m-%d %H:%M:%S.%f'"
END = "TIMESTAMP '9999-12-31 23:59:59'"


# ---- change logs derived from the tables -----------------------------------------------------------

def status_log(t: Tables) -> DataFrame:
    """User status = type of the newest event."""
    return t.events.select("user_id", F.col("ts").alias("changed_at"), F.col("event_type").alias("status"))


def priority_log(t: Tables) -> DataFrame:
    """Customer priority = priority of the newest order of each day (largest order key)."""
    daily = t.orders.groupBy("o_custkey", "o_orderdate").agg(
        F.max_by("o_orderpriority", "o_orderkey").alias("priority")
    )
    return daily.select(F.col("o_custkey").alias("cust_id"), F.col("o_orderdate").alias("changed_at"), "priority")


def orders_per_customer(t: Tables) -> int:
    """Bounds the log rows and versions per customer; counting them reads one column."""
    return largest_group(t.orders, ["o_custkey"])


def priority_dim(t: Tables, biggest: int | None = None) -> DataFrame:
    biggest = orders_per_customer(t) if biggest is None else biggest
    return dim.scd2_build(priority_log(t), "cust_id", "changed_at", ["priority"], biggest=biggest)


def bind_priority(t: Tables, rows: DataFrame, values: Sequence[str], hybrid: bool = False) -> DataFrame:
    """Rows (o_custkey, l_shipdate, ...) with the customer's priority version valid at the ship date."""
    biggest = orders_per_customer(t)
    members = priority_dim(t, biggest)
    if hybrid:
        members = dim.scd6_hybrid(members, "cust_id", ["priority"])
    return pit_join(rows, "o_custkey", "l_shipdate", members, "cust_id", values, most=biggest)


PRIORITY_LOG_SQL = """(SELECT o_custkey AS cust_id, o_orderdate AS changed_at, arg_max(o_orderpriority, o_orderkey) AS priority
    FROM orders GROUP BY 1, 2)"""
STATUS_LOG_SQL = "(SELECT user_id, ts AS changed_at, event_type AS status FROM events)"


def versions_sql(log: str, key: str, attr: str) -> str:
    return f"""(SELECT *, coalesce(lead(valid_from) OVER w, {END}) AS valid_to, lead(valid_from) OVER w IS NULL AS is_current,
        row_number() OVER w AS version_number FROM (
          SELECT {key}, changed_at AS valid_from, {attr} FROM (SELECT *, lag({attr}) OVER (PARTITION BY {key} ORDER BY changed_at) AS p
            FROM {log}) WHERE p IS NULL OR p <> {attr})
        WINDOW w AS (PARTITION BY {key} ORDER BY valid_from))"""


PRIORITY_DIM_SQL = versions_sql(PRIORITY_LOG_SQL, "cust_id", "priority")
STATUS_DIM_SQL = versions_sql(STATUS_LOG_SQL, "user_id", "status")


def shown(df: DataFrame) -> DataFrame:
    return df.withColumns({"valid_from": ts_text("valid_from"), "valid_to": ts_text("valid_to")})


@query(
    "g1_scd1_upsert",
    """WITH a AS (SELECT o_custkey AS cust_id, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders
                  WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
            b AS (SELECT o_custkey AS cust_id, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders
                  WHERE o_orderdate >= TIMESTAMP '2000-06-01' GROUP BY 1)
       SELECT coalesce(b.cust_id, a.cust_id) AS cust_id, coalesce(b.priority, a.priority) AS priority
       FROM a FULL JOIN b ON a.cust_id = b.cust_id""",
)
def _(t):
    def newest(rows):
        return rows.groupBy(F.col("o_custkey").alias("cust_id")).agg(
            F.max_by("o_orderpriority", "o_orderkey").alias("priority")
        )

    before = newest(t.orders.filter(F.col("o_orderdate") < ntz("1996-01-01")))
    after = newest(t.orders.filter(F.col("o_orderdate") >= ntz("2000-06-01")))
    return dim.scd1_upsert(before, after, "cust_id")


@query(
    "g1_scd1_insert_only",
    """WITH a AS (SELECT DISTINCT o_custkey AS cust_id, 'old' AS origin FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
            b AS (SELECT DISTINCT o_custkey AS cust_id, 'new' AS origin FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01')
       SELECT * FROM a UNION ALL SELECT * FROM b WHERE cust_id NOT IN (SELECT cust_id FROM a)""",
)
def _(t):
    def members(rows, origin):
        return rows.select(F.col("o_custkey").alias("cust_id"), F.lit(origin).alias("origin")).distinct()

    before = members(t.orders.filter(F.col("o_orderdate") < ntz("1996-01-01")), "old")
    after = members(t.orders.filter(F.col("o_orderdate") >= ntz("2000-06-01")), "new")
    return dim.scd1_upsert(before, after, "cust_id", overwrite=False)


@query(
    "g2_scd2_build",
    f"""SELECT md5(user_id || '-' || strftime(valid_from, {TS})) AS version_sk, user_id, status,
               strftime(valid_from, {TS}) AS valid_from, strftime(valid_to, {TS}) AS valid_to, is_current, version_number
        FROM {STATUS_DIM_SQL}""",
)
def _(t):
    return shown(dim.scd2_build(status_log(t), "user_id", "changed_at", ["status"]))


CUT = "2024-01-15"
MERGED_SQL = versions_sql(
    f"""(SELECT * FROM {STATUS_LOG_SQL} WHERE changed_at < TIMESTAMP '{CUT}' UNION ALL
         SELECT user_id, max(changed_at), arg_max(status, changed_at) FROM {STATUS_LOG_SQL}
         WHERE changed_at >= TIMESTAMP '{CUT}' GROUP BY user_id)""",
    "user_id",
    "status",
)


def merged_status(t: Tables) -> DataFrame:
    """Dimension built from the first half of the log, then merged with each user's newest later status."""
    log = status_log(t)
    first = dim.scd2_build(log.filter(F.col("changed_at") < ntz(CUT)), "user_id", "changed_at", ["status"])
    first = written(first, "status-dim")
    later = log.filter(F.col("changed_at") >= ntz(CUT))
    batch = later.groupBy("user_id").agg(F.max_by("status", "changed_at").alias("status"), F.max("changed_at").alias("changed_at"))
    return dim.scd2_merge(first, batch, "user_id", "changed_at", ["status"])


@query(
    "g3_scd2_merge",
    f"""SELECT user_id, status, strftime(valid_from, {TS}) AS valid_from, strftime(valid_to, {TS}) AS valid_to,
               is_current, version_number FROM {MERGED_SQL}""",
)
def _(t):
    return shown(merged_status(t)).drop("version_sk")


@query("g4_current_view", f"SELECT user_id, status, version_number FROM {MERGED_SQL} WHERE is_current")
def _(t):
    return dim.current_view(merged_status(t)).select("user_id", "status", "version_number")


SCD6_SQL = f"""(SELECT h.cust_id, h.priority AS historical_priority, c.priority AS current_priority, h.valid_from, h.valid_to,
    h.is_current, h.version_number FROM {PRIORITY_DIM_SQL} h JOIN (SELECT cust_id, priority FROM {PRIORITY_DIM_SQL}
    WHERE is_current) c ON h.cust_id = c.cust_id)"""


@query(
    "g5_scd6_hybrid",
    f"""SELECT cust_id, historical_priority, current_priority, strftime(valid_from, {TS}) AS valid_from,
               strftime(valid_to, {TS}) AS valid_to, is_current, version_number FROM {SCD6_SQL}""",
)
def _(t):
    return shown(dim.scd6_hybrid(priority_dim(t), "cust_id", ["priority"])).drop("version_sk", "is_inferred")


def shipments(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select("o_custkey", "l_shipdate", money("l_extendedprice").alias("amount"))


PERSPECTIVE_SQL = f"""SELECT coalesce(s.%s, 'UNKNOWN') AS priority, count(*) AS line_count,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN {SCD6_SQL} s
      ON s.cust_id = o_custkey AND l_shipdate >= s.valid_from AND l_shipdate < s.valid_to GROUP BY 1"""


def perspective(t: Tables, attr: str) -> DataFrame:
    bound = bind_priority(t, shipments(t), [attr], hybrid=True)
    return bound.groupBy(F.coalesce(F.col(attr), F.lit("UNKNOWN")).alias("priority")).agg(
        F.count(F.lit(1)).alias("line_count"), dbl(F.sum("amount")).alias("amount")
    )


@query("g6_as_was_report", PERSPECTIVE_SQL % "historical_priority")
def _(t):
    return perspective(t, "historical_priority")


@query("g6_as_is_report", PERSPECTIVE_SQL % "current_priority")
def _(t):
    return perspective(t, "current_priority")


@query(
    "g7_inferred_members",
    """SELECT c_custkey AS customer_id, c_mktsegment AS segment, CAST(1 AS INTEGER) AS version_number, false AS is_inferred
       FROM customer WHERE c_acctbal >= 0 UNION ALL
       SELECT DISTINCT o_custkey, 'UNKNOWN', 0, true FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
)
def _(t):
    known = t.customer.filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.lit(1).alias("version_number")
    )
    return dim.inferred_members(known, t.orders, "o_custkey", "customer_id", {"segment": "UNKNOWN", "version_number": 0})


@query(
    "g8_unknown_member",
    """SELECT coalesce(customer_sk, 'UNKNOWN_SK') AS customer_sk, count(*) AS order_count FROM orders LEFT JOIN
         (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS customer_sk FROM customer WHERE c_acctbal >= 0)
         ON c_custkey = o_custkey GROUP BY 1""",
)
def _(t):
    known = t.customer.filter("c_acctbal >= 0").withColumn("customer_sk", md5_key("c_custkey"))
    keyed = dim.unknown_member(t.orders, "o_custkey", known, "c_custkey", "customer_sk", "UNKNOWN_SK")
    return keyed.groupBy("customer_sk").agg(F.count(F.lit(1)).alias("order_count"))


def corrected_log(t: Tables) -> DataFrame:
    """The priority log, known at once, plus retroactive corrections: each pending order turns its
    customer URGENT from 30 days before the order, known 60 days after it."""
    base = priority_log(t).select("cust_id", F.col("changed_at").alias("valid_at"), F.col("changed_at").alias("known_at"), "priority")
    pending = t.orders.filter("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("cust_id"),
        (F.col("o_orderdate") - F.make_dt_interval(F.lit(30))).alias("valid_at"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(60))).alias("known_at"),
        F.lit("1-URGENT").alias("priority"),
    )
    return base.unionByName(pending)


CORRECTED_SQL = f"""(SELECT cust_id, changed_at AS valid_at, changed_at AS known_at, priority FROM {PRIORITY_LOG_SQL} UNION ALL
    SELECT o_custkey, o_orderdate - INTERVAL 30 DAY, o_orderdate + INTERVAL 60 DAY, '1-URGENT' FROM orders
    WHERE o_orderstatus = 'P')"""


@query(
    "g9_bitemporal_asof",
    f"""SELECT cust_id, priority, strftime(valid_at, {TS}) AS valid_at, strftime(known_at, {TS}) AS known_at FROM (
          SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY valid_at DESC, known_at DESC, priority DESC) AS rn
          FROM {CORRECTED_SQL} WHERE valid_at <= TIMESTAMP '1998-01-01' AND known_at <= TIMESTAMP '1998-03-01') WHERE rn = 1""",
)
def _(t):
    seen = dim.bitemporal_asof(
        corrected_log(t), "cust_id", "valid_at", "known_at", ntz("1998-01-01"), ntz("1998-03-01"), ["priority"]
    )
    return seen.withColumns({"valid_at": ts_text("valid_at"), "known_at": ts_text("known_at")})


SPLICED_LOG_SQL = f"""(SELECT cust_id, valid_at AS changed_at, priority FROM {CORRECTED_SQL}
    WHERE known_at <= TIMESTAMP '2001-01-01'
    QUALIFY row_number() OVER (PARTITION BY cust_id, valid_at ORDER BY known_at DESC, priority DESC) = 1)"""


@query(
    "g9_bitemporal_splice",
    f"""SELECT cust_id, priority, strftime(valid_from, {TS}) AS valid_from, strftime(valid_to, {TS}) AS valid_to,
               is_current, version_number FROM {versions_sql(SPLICED_LOG_SQL, 'cust_id', 'priority')}""",
)
def _(t):
    chain = dim.bitemporal_splice(
        corrected_log(t), "cust_id", "valid_at", "known_at", ntz("2001-01-01"), ["priority"]
    )
    return shown(chain).drop("version_sk")


FLAGS = ["o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus"]


def flagged_lines(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus", money("l_extendedprice").alias("amount"))
    heads = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey"))


@query(
    "g10_junk_dimension",
    """SELECT DISTINCT md5(concat_ws('|', o_orderstatus, o_orderpriority, l_returnflag, l_linestatus)) AS junk_sk,
         o_orderstatus, o_orderpriority, l_returnflag, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(t):
    return dim.junk_dimension(flagged_lines(t), FLAGS)


@query(
    "g10_junk_totals",
    """SELECT md5(concat_ws('|', o_orderstatus, o_orderpriority, l_returnflag, l_linestatus)) AS junk_sk,
         count(*) AS line_count, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(t):
    keyed = dim.rekey_junk(flagged_lines(t), FLAGS)
    return keyed.groupBy("junk_sk").agg(F.count(F.lit(1)).alias("line_count"), dbl(F.sum("amount")).alias("amount"))


@query(
    "g11_outrigger_join",
    """SELECT r_name, count(*) AS order_count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount,
         count(DISTINCT n_nationkey) AS nation_count FROM orders LEFT JOIN customer ON c_custkey = o_custkey
       LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1""",
)
def _(t):
    chain = [(t.customer, "o_custkey", "c_custkey"), (t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey")]
    return dim.outrigger_join(t.orders, chain).groupBy("r_name").agg(
        F.count(F.lit(1)).alias("order_count"),
        dbl(F.sum(money("o_totalprice"))).alias("amount"),
        F.count_distinct("n_nationkey").alias("nation_count"),
    )


@query(
    "g12_mini_dimension",
    """SELECT md5(band) AS mini_sk, band AS balance_band, count(*) AS customer_count FROM (SELECT CASE
         WHEN c_acctbal < 0 THEN 'OVERDRAWN' WHEN c_acctbal < 2500 THEN 'LOW' WHEN c_acctbal < 7500 THEN 'MIDDLE'
         ELSE 'HIGH' END AS band FROM customer) GROUP BY 1, 2""",
)
def _(t):
    spec = {"balance_band": ("c_acctbal", [0, 2500, 7500], ["OVERDRAWN", "LOW", "MIDDLE", "HIGH"])}
    keyed, mini = dim.mini_dimension(t.customer, spec)
    counts = keyed.groupBy("mini_sk").agg(F.count(F.lit(1)).alias("customer_count"))
    return mini.join(counts, "mini_sk")


def part_tree(t: Tables) -> DataFrame:
    """Eight-way part hierarchy over the part keys; key 0 is the root and has no parent."""
    parent = F.floor((F.col("p_partkey") - 1) / 8).cast("bigint")
    return t.part.filter("p_partkey > 0").select(parent.alias("parent_id"), F.col("p_partkey").alias("child_id"))


CLOSURE_SQL = """(WITH RECURSIVE e AS (SELECT CAST((p_partkey - 1) // 8 AS BIGINT) AS parent_id, p_partkey AS child_id
    FROM part WHERE p_partkey > 0), c AS (SELECT p_partkey AS ancestor, p_partkey AS descendant, 0 AS depth_level FROM part
    UNION ALL SELECT c.ancestor, e.child_id, c.depth_level + 1 FROM c JOIN e ON e.parent_id = c.descendant)
    SELECT ancestor, descendant, CAST(depth_level AS INTEGER) AS depth_level,
           descendant NOT IN (SELECT parent_id FROM e) AS is_leaf FROM c)"""


@query("g13_closure_table", f"SELECT * FROM {CLOSURE_SQL}")
def _(t):
    return dim.closure_table(part_tree(t), "parent_id", "child_id")


@query(
    "g14_hierarchy_rollup",
    f"""SELECT ancestor, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS total_cost, count(*) AS member_count
        FROM {CLOSURE_SQL} JOIN part ON p_partkey = descendant GROUP BY 1""",
)
def _(t):
    closure = dim.closure_table(part_tree(t), "parent_id", "child_id")
    costs = t.part.select("p_partkey", money("p_retailprice").alias("cost"))
    return dim.hierarchy_rollup(closure, costs, "p_partkey", "cost", "total_cost").withColumn("total_cost", dbl("total_cost"))


@query(
    "g15_conformance_matrix",
    """SELECT 'orders' AS fact_name, (SELECT count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders) FROM orders
           WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)) AS customer,
         CAST(NULL AS DOUBLE) AS part, CAST(NULL AS DOUBLE) AS supplier,
         (SELECT count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders) FROM orders
           WHERE o_orderdate >= TIMESTAMP '1996-01-01') AS calendar UNION ALL
       SELECT 'lineitem', NULL,
         (SELECT count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem) FROM lineitem
           WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 45)),
         (SELECT count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem) FROM lineitem
           WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)),
         (SELECT count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem) FROM lineitem
           WHERE l_shipdate >= TIMESTAMP '1996-01-01'
             AND l_shipdate <= (SELECT max(o_orderdate) FROM orders))""",
)
def _(t):
    facts = {
        "orders": t.orders.withColumn("order_date", date_key("o_orderdate")),
        "lineitem": t.lineitem.withColumn("ship_date", date_key("l_shipdate")),
    }
    calendar = date_dimension(t.orders.filter(F.col("o_orderdate") >= ntz("1996-01-01")), "o_orderdate")
    dims = {
        "customer": (t.customer.filter("c_acctbal >= 0"), "c_custkey"),
        "part": (t.part.filter("p_size < 45"), "p_partkey"),
        "supplier": (t.supplier, "s_suppkey"),
        "calendar": (calendar, "date_sk"),
    }
    links = [
        ("orders", "o_custkey", "customer"), ("orders", "order_date", "calendar"),
        ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier"), ("lineitem", "ship_date", "calendar"),
    ]
    return dim.conformance_matrix(facts, dims, links)


@query(
    "g16_history_companion",
    f"""SELECT c_custkey, c_mktsegment, count(cust_id) AS version_count, strftime(min(valid_from), '%Y-%m-%d') AS first_seen
        FROM customer LEFT JOIN {PRIORITY_DIM_SQL} ON cust_id = c_custkey GROUP BY 1, 2""",
)
def _(t):
    # Type 1 customer beside a Type 2 outrigger that holds only the tracked attribute.
    companion = priority_dim(t).groupBy("cust_id").agg(
        F.count(F.lit(1)).alias("version_count"), F.min("valid_from").alias("first_seen")
    )
    joined = t.customer.join(companion, F.col("c_custkey") == F.col("cust_id"), "left")
    return joined.select(
        "c_custkey", "c_mktsegment", F.coalesce("version_count", F.lit(0)).alias("version_count"),
        day_text("first_seen").alias("first_seen"),
    )
