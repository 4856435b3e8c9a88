"""Queries for landing, generation and cleansing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.columns import date_key, day_text, dbl, money, ntz, ts_text
from terrace.operators import silver
from terrace.operators.ordered import HOT_ROWS
from terrace.plans.registry import Tables, query
from terrace.session import scratch_path
from terrace.sources import generators as gen
from terrace.sources import landing
from terrace.sources.schemas import DDL, read_declared, schema_of

LINE_KEYS = ["l_orderkey", "l_linenumber"]
def line_order():
    return [
        F.desc("l_shipdate"), F.desc("l_extendedprice"), F.desc("l_partkey"), F.desc("l_suppkey"),
        F.desc("l_quantity"), F.desc("l_discount"), F.desc("l_tax"), F.desc("l_returnflag"), F.desc("l_linestatus"),
    ]
DEDUP_SQL = """(SELECT * FROM lineitem QUALIFY row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC,
    l_suppkey DESC, l_quantity DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1)"""


def clean_lines(t: Tables, biggest_order: int | None = None, orders_fit: bool = False) -> DataFrame:
    """One row per order line: the newest of its duplicates. If no order is too large for one task, as its measured
    size says or the caller (`orders_fit`), lines are partitioned by order at once: later steps per order need no second shuffle."""
    lines = t.lineitem
    if orders_fit or (biggest_order is not None and biggest_order <= HOT_ROWS):
        lines = lines.repartition("l_orderkey")
    return silver.dedup_latest(lines, LINE_KEYS, line_order())


@query(
    "s1_bronze_ingest",
    """SELECT o_orderkey, sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority))
         AS _raw_payload_id, 'orders.parquet' AS _source_file, CAST(1 AS INTEGER) AS _batch_id FROM orders""",
)
def _(t):
    payload = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    raw = landing.bronze_ingest(t.orders, "orders.parquet", 1, payload)
    return raw.select("o_orderkey", "_raw_payload_id", "_source_file", "_batch_id")


@query(
    "s1_bronze_append",
    """SELECT o_orderkey, sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus)) AS _raw_payload_id,
         CAST(CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 1 ELSE 2 END AS INTEGER) AS _batch_id,
         CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'drop=1' ELSE 'drop=2' END AS drop_folder FROM orders""",
)
def _(t):
    # Two drops of files, as csv; the second is loaded twice, as after a retry.
    names = ["o_orderkey", "o_custkey", "o_orderstatus"]
    root = scratch_path(t.spark, "drops")
    drop = F.when(F.col("o_orderdate") < ntz("1996-01-01"), 1).otherwise(2)
    t.orders.select(*names, drop.alias("drop")).write.partitionBy("drop").option("header", True).csv(f"{root}/in")
    schema = t.orders.select(*names).schema
    for batch in (1, 2, 2):
        bronze = landing.append_files(t.spark, "csv", f"{root}/in/drop={batch}", schema, f"{root}/bronze", batch)
    return bronze.select("o_orderkey", "_raw_payload_id", "_batch_id", F.regexp_extract("_source_file", "(drop=[0-9]+)/", 1).alias("drop_folder"))


@query(
    "s2_declared_source_schema",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, CAST({s.count(',') + 1} AS INTEGER) AS column_count, count(*) AS row_count FROM {n}"
        for n, s in DDL.items()
    ),
)
def _(t):
    out = None
    for name in DDL:
        one = read_declared(t.spark, t.folder, name).agg(F.count(F.lit(1)).alias("row_count"))
        one = one.select(F.lit(name).alias("table_name"), F.lit(len(schema_of(name))).alias("column_count"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "s3_load_records",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, CAST(NULL AS VARCHAR) AS c_phone FROM customer",
)
def _(t):
    root = scratch_path(t.spark, "seeds")
    base, schema = t.customer, schema_of("customer")
    seg = F.col("c_mktsegment")
    base.filter(seg == "BUILDING").write.option("header", True).csv(f"{root}/csv")
    base.filter(seg == "FURNITURE").write.json(f"{root}/json")
    base.filter(~seg.isin("BUILDING", "FURNITURE") | seg.isNull()).write.parquet(f"{root}/parquet")
    feeds = [landing.read_records(t.spark, f, f"{root}/{f}", schema) for f in ("csv", "json", "parquet")]
    target = type(schema)(list(schema.fields)).add("c_phone", "string")
    return landing.insert_by_name(target, *feeds)


@query(
    "s4_profile_source",
    """SELECT 'events' AS table_name, c AS column_name, n AS row_count, k AS null_count, d AS distinct_count,
              lo AS min_text, hi AS max_text FROM (
         SELECT 'user_id' AS c, count(*) AS n, count(*) - count(user_id) AS k, count(DISTINCT user_id) AS d,
                CAST(min(user_id) AS VARCHAR) AS lo, CAST(max(user_id) AS VARCHAR) AS hi FROM events UNION ALL
         SELECT 'event_type', count(*), count(*) - count(event_type), count(DISTINCT event_type),
                min(event_type), max(event_type) FROM events)
       UNION ALL
       SELECT 'customer', c, n, k, d, lo, hi FROM (
         SELECT 'c_nationkey' AS c, count(*) AS n, count(*) - count(c_nationkey) AS k,
                count(DISTINCT c_nationkey) AS d, CAST(min(c_nationkey) AS VARCHAR) AS lo,
                CAST(max(c_nationkey) AS VARCHAR) AS hi FROM customer UNION ALL
         SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment),
                min(c_mktsegment), max(c_mktsegment) FROM customer)""",
)
def _(t):
    e = landing.profile_source(t.events.select("user_id", "event_type"), ["user_id", "event_type"])
    c = landing.profile_source(t.customer.select("c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"])
    both = e.withColumn("table_name", F.lit("events")).unionByName(c.withColumn("table_name", F.lit("customer")))
    return both.drop("data_type")


@query(
    "s4_profile_all_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{typ}' AS data_type, count(*) AS row_count, count(*) - count({c}) AS null_count, "
        f"CAST(min({c}) AS VARCHAR) AS min_text, CAST(max({c}) AS VARCHAR) AS max_text FROM events"
        for c, typ in [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
                       ("value", "double"), ("props", "string")]
    ),
)
def _(t):
    # The estimated distinct counts are left out: estimates have no exact twin.
    return landing.profile_source(t.events).drop("distinct_count")


@query(
    "s5_write_layers",
    f"""SELECT '01_bronze/lineitem' AS layer_table, count(*) AS row_count FROM lineitem UNION ALL
        SELECT '02_silver/lineitem', count(*) FROM {DEDUP_SQL} UNION ALL
        SELECT '03_gold/revenue_by_status', count(DISTINCT (l_returnflag, l_linestatus)) FROM {DEDUP_SQL}""",
)
def _(t):
    lines = clean_lines(t)
    gold = lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum(money("l_extendedprice")).alias("revenue"))
    layers = {
        "01_bronze": {"lineitem": landing.bronze_ingest(t.lineitem, "lineitem.parquet", 1, LINE_KEYS)},
        "02_silver": {"lineitem": lines},
        "03_gold": {"revenue_by_status": gold},
    }
    paths = landing.write_layers(layers, scratch_path(t.spark, "layers"))
    out = None
    for name, path in paths.items():
        one = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"))
        one = one.select(F.lit(name).alias("layer_table"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def shipments_by_month(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "ship-month")
    lines = t.lineitem.withColumn("ship_ym", F.year("l_shipdate") * 100 + F.month("l_shipdate"))
    landing.write_partitioned(lines, path, ["ship_ym"], ["l_suppkey"])
    return t.spark.read.parquet(path)


@query(
    "s6_write_partitioned",
    """SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS ship_ym, count(*) AS line_count,
              CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1""",
)
def _(t):
    stored = shipments_by_month(t)
    return stored.groupBy("ship_ym").agg(
        F.count(F.lit(1)).alias("line_count"), dbl(F.sum(money("l_quantity"))).alias("quantity")
    )


@query(
    "s7_partition_pruned_scan",
    """SELECT count(*) AS line_count, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' AND l_shipdate < TIMESTAMP '1998-07-01'""",
)
def _(t):
    stored = shipments_by_month(t).filter("ship_ym = 199806")
    return stored.agg(
        F.count(F.lit(1)).alias("line_count"), dbl(F.sum(money("l_extendedprice"))).alias("revenue")
    )


@query(
    "s8_append_backfill",
    """SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'base' ELSE 'backfill' END AS origin
       FROM orders""",
)
def _(t):
    o = t.orders
    base = o.filter(F.col("o_orderdate") >= ntz("1997-01-01")).withColumn("origin", F.lit("base"))
    history = o.filter(F.col("o_orderdate") < ntz("1998-01-01")).withColumn("origin", F.lit("backfill"))
    return landing.append_backfill(base, history, ["o_orderkey"]).select("o_orderkey", "origin")


@query(
    "s9_gen_sequence",
    """SELECT o_orderkey, CAST(i AS INTEGER) AS instalment, date_key FROM (
         SELECT o_orderkey, unnest(range(1, n + 1)) AS i, o_orderdate, n FROM (
           SELECT o_orderkey, o_orderdate, CAST(left(o_orderpriority, 1) AS INTEGER) AS n FROM orders)) x,
       LATERAL (SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS date_key
                FROM (SELECT o_orderdate + to_days(30 * CAST(i AS INTEGER)) AS d))""",
)
def _(t):
    count = F.left("o_orderpriority", F.lit(1)).cast("int")
    plan = gen.expand_sequence(t.orders, count, "instalment")
    due = F.col("o_orderdate") + F.make_dt_interval(F.col("instalment") * 30)
    return plan.select("o_orderkey", "instalment", date_key(due).alias("date_key"))


@query(
    "s10_gen_zipf_keys",
    """WITH w AS (SELECT k, 1.0 / pow(k, 1.2) AS w FROM range(1, 51) r(k)),
       c AS (SELECT k, sum(w) OVER (ORDER BY k) / (SELECT sum(w) FROM w) AS hi FROM w),
       b AS (SELECT k, coalesce(lag(hi) OVER (ORDER BY k), 0.0) AS lo, CASE WHEN k = 50 THEN 1.0 ELSE hi END AS hi FROM c),
       u AS (SELECT CAST(('0x' || substr(md5(event_id || '|42'), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM events)
       SELECT 'KEY_' || k AS skew_key, count(*) AS row_count FROM u JOIN b ON u >= lo AND u < hi GROUP BY 1""",
)
def _(t):
    keyed = gen.gen_zipf_keys(t.events.select("event_id"), "event_id", n_keys=50, s=1.2, seed=42)
    return keyed.groupBy("skew_key").agg(F.count(F.lit(1)).alias("row_count"))


def power_law_sql(table: str, id_col: str, n_keys: int, s: float, seed: int) -> str:
    c = {k: f"CAST('{v!r}' AS DOUBLE)" for k, v in {**gen.power_law_constants(n_keys, s), "e": 1 - s, "r": 1 / (1 - s), "s": -s}.items()}
    return f"""SELECT {id_col}, arg_min(k, i) AS key_rank FROM (
        SELECT *, CAST(least(greatest(floor(x + 0.5), 1), {n_keys}) AS BIGINT) AS k FROM (
          SELECT *, pow({c['e']} * u, {c['r']}) AS x FROM (
            SELECT {id_col}, i, {c['right']} + CAST(('0x' || substr(md5({id_col} || '|{seed}|' || i), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE
              * {c['width']} AS u FROM {table}, range(16) r(i))))
      WHERE k - x <= {c['safe']} OR u >= pow(k + 0.5::DOUBLE, {c['e']}) / {c['e']} - pow(k, {c['s']}) GROUP BY 1"""


@query("s10_power_law_keys", power_law_sql("events", "event_id", 10_000_000, 1.2, 42))
def _(t):
    return gen.gen_power_law_keys(t.events.select("event_id"), "event_id", n_keys=10_000_000, s=1.2, seed=42)


@query(
    "s11_gen_time_jitter",
    """SELECT event_id, off AS offset_hours,
              strftime(ts + to_hours(off), '%Y-%m-%d %H:%M:%S.%f') AS jittered_ts FROM (
         SELECT event_id, ts, CAST(CAST(('0x' || substr(md5(event_id || '|42'), 1, 8)) AS BIGINT) % 97 - 48 AS INTEGER)
           AS off FROM events)""",
)
def _(t):
    jittered = gen.gen_time_jitter(t.events, "ts", "event_id", hours=48, seed=42)
    return jittered.select("event_id", "offset_hours", ts_text("jittered_ts").alias("jittered_ts"))


@query(
    "s12_date_dimension",
    """SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS date_sk, strftime(d, '%Y-%m-%d') AS calendar_date,
              CAST(year(d) AS INTEGER) AS calendar_year, CAST(month(d) AS INTEGER) AS calendar_month,
              CAST(quarter(d) AS INTEGER) AS calendar_quarter, dayname(d) AS day_name
       FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d
             FROM (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders))""",
)
def _(t):
    dim = gen.date_dimension(t.orders, "o_orderdate")
    return dim.withColumn("calendar_date", day_text("calendar_date")).drop("yearmonth_num", "week_of_year")


@query(
    "s13_time_dimension",
    """SELECT CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, count(*) AS event_count
       FROM events GROUP BY 1, 2""",
)
def _(t):
    clock = gen.time_dimension(t.spark)
    seen = t.events.select(gen.second_of_day("ts").alias("time_sk"))
    return seen.join(clock, "time_sk").groupBy("hour", "minute").agg(F.count(F.lit(1)).alias("event_count"))


@query(
    "s14_role_playing_dates",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, CAST(year(l_shipdate) AS INTEGER) AS ship_year,
              count(*) AS line_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def _(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    span = t.orders.select(F.col("o_orderdate").alias("d")).unionByName(t.lineitem.select(F.col("l_shipdate").alias("d")))
    dates = gen.date_dimension(span, "d").select("date_sk", "calendar_year")
    both = gen.role_playing_dates(
        lines.select("o_orderdate", "l_shipdate"), dates, {"order": "o_orderdate", "ship": "l_shipdate"}
    )
    years = both.groupBy(
        F.col("order_calendar_year").alias("order_year"), F.col("ship_calendar_year").alias("ship_year")
    )
    return years.agg(F.count(F.lit(1)).alias("line_count"))


@query(
    "p1_dedup_latest",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
               strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM {DEDUP_SQL}""",
)
def _(t):
    return clean_lines(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        day_text("l_shipdate").alias("l_shipdate"),
    )


@query(
    "p2_clean_strings",
    """SELECT c_custkey, trim('  ' || c_name || ' ') AS c_name, upper(trim(' ' || lower(c_mktsegment))) AS c_mktsegment
       FROM customer""",
)
def _(t):
    padded = t.customer.select(
        "c_custkey",
        F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"),
        F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("c_mktsegment"),
    )
    return silver.clean_strings(padded, trimmed=["c_name"], coded=["c_mktsegment"])


@query(
    "p3_cast_columns",
    """SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER), 0) AS k,
              coalesce(TRY_CAST(event_type AS INTEGER), -1) AS type_number, 'USD' AS currency_code FROM events""",
)
def _(t):
    raw = t.events.select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("type_number")
    )
    spec = {"k": ("int", 0), "type_number": ("int", -1), "currency_code": ("string", "USD")}
    return silver.cast_columns(raw, spec)


@query("p4_surrogate_key_md5", "SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS customer_sk FROM customer")
def _(t):
    return silver.surrogate_key_md5(t.customer.select("c_custkey"), "c_custkey", "customer_sk")


@query(
    "p5_surrogate_key_versioned",
    """SELECT o_orderkey, md5(o_custkey || '-' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')) AS version_sk FROM orders""",
)
def _(t):
    keyed = silver.surrogate_key_versioned(t.orders, "o_custkey", "o_orderdate", "version_sk")
    return keyed.select("o_orderkey", "version_sk")


@query(
    "p6_surrogate_key_int64",
    "SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys, CAST(0 AS BIGINT) AS colliding_keys FROM lineitem",
)
def _(t):
    return silver.collision_audit(t.lineitem, LINE_KEYS)


def customer_rules():
    return {
        "account balance >= 0": F.col("c_acctbal") >= 0,
        "market segment is known": F.col("c_mktsegment") != "MACHINERY",
    }
def line_rules():
    return {
        "quantity > 0": F.col("l_quantity") > 0,
        "discount <= 0.08": F.col("l_discount") <= 0.08,
        "tax is charged": F.col("l_tax") > 0,
    }


@query(
    "p7_contract_filter",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY'",
)
def _(t):
    return silver.contract_filter(t.customer, customer_rules()).select("c_custkey", "c_acctbal")


@query(
    "p8_quarantine_split",
    """SELECT c_custkey, CASE WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'FAILED_INVARIANT: account balance >= 0'
         ELSE 'FAILED_INVARIANT: market segment is known' END AS reject_reason FROM customer
       WHERE NOT (coalesce(c_acctbal >= 0, false) AND coalesce(c_mktsegment <> 'MACHINERY', false))""",
)
def _(t):
    _, bad = silver.quarantine_split(t.customer, customer_rules())
    return bad.select("c_custkey", "reject_reason")


@query(
    "p8_quarantine_totals",
    """SELECT coalesce(reject_reason, 'accepted') AS outcome, count(*) AS row_count FROM (SELECT CASE
         WHEN NOT coalesce(l_quantity > 0, false) THEN 'FAILED_INVARIANT: quantity > 0'
         WHEN NOT coalesce(l_discount <= 0.08, false) THEN 'FAILED_INVARIANT: discount <= 0.08'
         WHEN NOT coalesce(l_tax > 0, false) THEN 'FAILED_INVARIANT: tax is charged' END AS reject_reason FROM lineitem)
       GROUP BY 1""",
)
def _(t):
    tagged = silver.tag_rejects(t.lineitem, line_rules())
    outcome = F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")
    return tagged.groupBy(outcome).agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "p9_contract_report",
    """SELECT rule_id, description, n AS evaluated, f AS failed, CAST(n - f AS DOUBLE) * 100.0::DOUBLE / n AS pass_pct FROM (
         SELECT 'BR-01' AS rule_id, 'quantity > 0' AS description, count(*) AS n,
                count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, false)) AS f FROM lineitem UNION ALL
         SELECT 'BR-02', 'discount <= 0.08', count(*), count(*) FILTER (WHERE NOT coalesce(l_discount <= 0.08, false))
           FROM lineitem UNION ALL
         SELECT 'BR-03', 'tax is charged', count(*), count(*) FILTER (WHERE NOT coalesce(l_tax > 0, false)) FROM lineitem)""",
)
def _(t):
    return silver.contract_report(t.lineitem, line_rules())


@query(
    "p10_reject_log",
    """SELECT CAST(1 AS INTEGER) AS batch_id, 'BatchControl' AS message_source, 'load finished' AS message_text,
              'INFO' AS message_type, 'rows=' || count(*) AS message_data FROM customer UNION ALL
       SELECT 1, 'TransformCustomer', 'FAILED_INVARIANT: account balance >= 0', 'REJECT', 'c_custkey=' || c_custkey
       FROM customer WHERE NOT coalesce(c_acctbal >= 0, false) UNION ALL
       SELECT 1, 'TransformCustomer', 'FAILED_INVARIANT: market segment is known', 'REJECT', 'c_custkey=' || c_custkey
       FROM customer WHERE coalesce(c_acctbal >= 0, false) AND NOT coalesce(c_mktsegment <> 'MACHINERY', false)""",
)
def _(t):
    _, bad = silver.quarantine_split(t.customer, customer_rules())
    rejects = silver.message_rows(
        bad, 1, "TransformCustomer", F.col("reject_reason"), "REJECT", F.concat(F.lit("c_custkey="), "c_custkey")
    )
    counted = t.customer.agg(F.count(F.lit(1)).alias("n"))
    info = silver.message_rows(
        counted, 1, "BatchControl", F.lit("load finished"), "INFO", F.concat(F.lit("rows="), "n")
    )
    return info.unionByName(rejects).drop("message_time")


@query(
    "p11_orphan_reject",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 45)""",
)
def _(t):
    small = t.part.filter("p_size < 45")
    _, orphans = silver.orphan_reject(t.lineitem, "l_partkey", small, "p_partkey")
    return orphans.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "p12_error_codes",
    """SELECT coalesce(error_code, 'OK') AS error_code, count(*) AS row_count FROM (
         SELECT CASE WHEN l_discount = 0 AND l_tax = 0 THEN 'E001_NULL_PK'
                     WHEN NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 45)
                     THEN 'E002_ORPHAN_FK' END AS error_code FROM lineitem) GROUP BY 1""",
)
def _(t):
    # Lines that carry neither discount nor tax stand for rows that arrived without their key.
    feed = t.lineitem.withColumn("line_key", F.expr("if(l_discount = 0 and l_tax = 0, null, l_orderkey)"))
    coded = silver.error_codes(feed, "line_key", "l_partkey", t.part.filter("p_size < 45"), "p_partkey")
    return coded.groupBy(F.coalesce("error_code", F.lit("OK")).alias("error_code")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query(
    "p13_pii_mask",
    "SELECT c_custkey, sha256(c_name) AS tax_id, sha256(CAST(c_acctbal AS DECIMAL(18,2))::VARCHAR) AS password FROM customer",
)
def _(t):
    feed = t.customer.select(
        "c_custkey", F.col("c_name").alias("tax_id"), money("c_acctbal").alias("password")
    )
    return silver.mask_columns(feed, silver.unmasked_pii_columns(feed))


@query(
    "p13_pii_value_scan",
    f"""SELECT lang, count(*) AS rows, count(*) FILTER (WHERE regexp_matches(text, '{silver.EMAIL_PATTERN}')) AS email_rows,
               count(*) FILTER (WHERE regexp_matches(text, '{silver.SSN_PATTERN}')) AS ssn_rows,
               count(*) FILTER (WHERE regexp_matches(text, '{silver.PHONE_PATTERN}')) AS phone_rows,
               count(*) FILTER (WHERE regexp_matches(text, '{silver.EMAIL_PATTERN}')
                 OR regexp_matches(text, '{silver.SSN_PATTERN}') OR regexp_matches(text, '{silver.PHONE_PATTERN}')) AS any_rows
        FROM documents GROUP BY lang""",
)
def _(t):
    return silver.pii_value_scan(t.documents, "text", ["lang"])
