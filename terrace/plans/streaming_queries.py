"""Queries for streaming jobs; each reads the events file as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions.columns import ntz, ts_text
from terrace.plans.dimension_queries import STATUS_DIM_SQL
from terrace.plans.registry import Tables, query
from terrace.session import scratch_path
from terrace.sources.generators import gen_time_jitter
from terrace.sources.landing import bronze_ingest
from terrace.sources.schemas import schema_of
from terrace.streaming import streams as st


C = F.col
M = "CAST({} AS DECIMAL(18,2))".format
TS = "'%Y-%m-%d %H:%M:%S.%f'"
def campaign():
    return F.get_json_object("props", "$.k").cast("int")


def event_stream(t: Tables) -> DataFrame:
    return st.read_stream(t.spark, t.path("events") + "*", schema_of("events"))


ROAS_SQL = f"""SELECT campaign_id, n AS event_count, CAST(r AS DOUBLE) AS revenue, CAST(c AS DOUBLE) AS cost,
    CAST(r AS DOUBLE) / nullif(CAST(c AS DOUBLE), 0) AS roas FROM (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS campaign_id,
      count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN {M('value')} ELSE 0 END) AS r,
      sum(CASE WHEN event_type = 'click' THEN {M('value')} ELSE 0 END) AS c FROM events GROUP BY 1)"""


def roas(events: DataFrame) -> DataFrame:
    rows = events.withColumn("campaign_id", campaign())
    return st.campaign_roas(rows, "campaign_id", st.revenue_of("purchase"), st.revenue_of("click"))


@query("r1_campaign_roas", ROAS_SQL)
def _(t):
    return roas(t.events)


@query("r1_campaign_roas_stream", ROAS_SQL)
def _(t):
    return st.replace_table(roas(event_stream(t)), "roas")


@query(
    "r2_approx_reach",
    """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS bucket, count(DISTINCT user_id) AS visitors, true AS within_tolerance
       FROM events GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT user_id), true FROM events""",
)
def _(t):
    day = F.date_format("ts", "yyyy-MM-dd")
    sketches = st.reach_sketches(t.events, day, "user_id")
    total = st.total_reach(sketches).select(F.lit("all").alias("bucket"), "approx_visitors")
    approx = st.reach(sketches).unionByName(total)
    exact = t.events.groupBy(day.alias("bucket")).agg(F.count_distinct("user_id").alias("visitors"))
    exact = exact.unionByName(t.events.agg(F.count_distinct("user_id").alias("visitors")).withColumn("bucket", F.lit("all")))
    error = F.abs(C("approx_visitors") - C("visitors"))
    return exact.join(approx, "bucket").select("bucket", "visitors", (error <= 0.05 * C("visitors")).alias("within_tolerance"))


WINDOW_COLS = f"""strftime(window_start, {TS}) AS window_start, event_count, conversions,
    CAST(conversions AS DOUBLE) / CAST(event_count AS DOUBLE) AS conversion_rate"""
SLIDING_SQL = f"""(SELECT w AS window_start, count(*) AS event_count, count(*) FILTER (WHERE event_type = 'purchase') AS conversions FROM (
    SELECT event_type, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS w FROM events) GROUP BY 1)"""


def converted(df: DataFrame) -> DataFrame:
    out = st.window_conversion(df, "ts", "10 minutes", "5 minutes", C("event_type") == "purchase")
    return out.drop("window_end").withColumn("window_start", ts_text("window_start"))


@query("r3_window_conversion", f"SELECT {WINDOW_COLS} FROM {SLIDING_SQL}")
def _(t):
    return converted(t.events)


@query("r3_window_conversion_stream", f"SELECT {WINDOW_COLS} FROM {SLIDING_SQL}")
def _(t):
    return st.drained(event_stream(t), converted, "ts", "1 hour", "conversion")


TUMBLING_SQL = f"""SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), {TS}) AS window_start, event_type, count(*) AS event_count FROM events GROUP BY 1, 2"""


def by_type(df: DataFrame) -> DataFrame:
    return st.tumbling_counts(df, "ts", "5 minutes", ["event_type"]).drop("window_end").withColumn("window_start", ts_text("window_start"))


@query("r4_tumbling_counts", TUMBLING_SQL)
def _(t):
    return by_type(t.events)


@query("r4_tumbling_counts_stream", TUMBLING_SQL)
def _(t):
    return st.drained(event_stream(t), by_type, "ts", "1 hour", "tumbling")


@query(
    "r5_stream_bronze_append",
    """SELECT event_id, sha256(event_id || '|' || event_type) AS _raw_payload_id, 'events' AS _source_file FROM events""",
)
def _(t):
    raw = bronze_ingest(event_stream(t), "events", 1, ["event_id", "event_type"])
    return st.append_to_table(raw, "bronze").select("event_id", "_raw_payload_id", "_source_file")


@query("r6_stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    # The feed carries every event twice, as after a producer's retry.
    feed = scratch_path(t.spark, "retries")
    t.events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy").write.parquet(feed)
    once = st.stream_dedup(st.read_stream(t.spark, feed, schema_of("events")), "event_id", "ts", "1 hour")
    return st.append_to_table(once, "dedup").select("event_id", "user_id", "event_type")


def event_rules():
    return {"value >= 5": C("value") >= 5, "type is not error": C("event_type") != "error"}


@query(
    "r7_stream_quarantine",
    """SELECT event_id, CASE WHEN NOT coalesce(value >= 5, false) THEN 'FAILED_INVARIANT: value >= 5'
         WHEN NOT coalesce(event_type <> 'error', false) THEN 'FAILED_INVARIANT: type is not error' ELSE 'accepted' END AS outcome FROM events""",
)
def _(t):
    good, bad = st.stream_quarantine(event_stream(t), event_rules(), "quarantine")
    kept = good.select("event_id", F.lit("accepted").alias("outcome"))
    return kept.unionByName(bad.select("event_id", C("reject_reason").alias("outcome")))


JITTERED = "event_id bigint, event_type string, jittered_ts timestamp_ntz, arrival int"


def jittered_events(t: Tables) -> DataFrame:
    """Events with clocks off by up to 48 hours, arriving in the order they were produced, week by week."""
    rows = gen_time_jitter(t.events, "ts", "event_id", 48, 42)
    week = F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7).cast("int")
    return rows.select("event_id", "event_type", "jittered_ts", week.alias("arrival"))


def arrivals_of(rows: DataFrame):
    """One writer per arrival. The rows are laid out by arrival in one scan, and each writer reads its own part; the number of arrivals is
    that of source drops, not of rows."""
    spark, landed = rows.sparkSession, scratch_path(rows.sparkSession, "arrivals")
    rows.withColumn("__drop", C("arrival")).write.partitionBy("__drop").parquet(landed)
    drops = spark.read.parquet(landed).select("__drop").distinct()  # folder names only
    numbers = sorted(r[0] for r in drops.collect())
    return [lambda path, i=i: spark.read.schema(rows.schema).parquet(f"{landed}/__drop={i}").write.mode("append").parquet(path) for i in numbers]


@query(
    "r8_stream_late_data",
    f"""WITH j AS (SELECT event_type, ts + to_hours(CAST(CAST(('0x' || substr(md5(event_id || '|42'), 1, 8)) AS BIGINT) % 97 - 48 AS INTEGER)) AS jts,
          CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS INTEGER) AS a FROM events),
        w AS (SELECT event_type, a, time_bucket(INTERVAL 1 HOUR, jts) AS s FROM j),
        m AS (SELECT a, max(max(jts)) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM j GROUP BY a)
        SELECT strftime(s, {TS}) AS window_start, event_type, count(*) AS event_count FROM w JOIN m ON m.a = w.a
        WHERE (before IS NULL OR s + INTERVAL 1 HOUR > date_trunc('millisecond', before) - INTERVAL 24 HOUR)
          AND s + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(jts) FROM j)) - INTERVAL 24 HOUR GROUP BY 1, 2""",
)
def _(t):
    rows = jittered_events(t)
    counts = st.stream_late_counts(
        arrivals_of(rows), T.StructType.fromDDL(JITTERED), t.spark, "jittered_ts", "24 hours", "1 hour", ["event_type"]
    )
    return counts.drop("window_end").withColumn("window_start", ts_text("window_start"))


@query(
    "r9_stream_scd2",
    f"""SELECT user_id, status, strftime(valid_from, {TS}) AS valid_from, strftime(valid_to, {TS}) AS valid_to, is_current, version_number
        FROM {STATUS_DIM_SQL}""",
)
def _(t):
    log = t.events.select("user_id", C("ts").alias("changed_at"), C("event_type").alias("status"))
    half = F.when(C("changed_at") < ntz("2024-01-16"), 0).otherwise(1)
    rows = log.withColumn("arrival", half)
    schema = T.StructType.fromDDL("user_id bigint, changed_at timestamp_ntz, status string, arrival int")
    built = st.stream_scd2(arrivals_of(rows), schema, t.spark, "user_id", "changed_at", ["status"])
    return built.withColumns({"valid_from": ts_text("valid_from"), "valid_to": ts_text("valid_to")}).drop("version_sk")


SESSION_SQL = """(SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS event_count FROM (
    SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no
    FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, no)"""
SESSION_COLS = f"user_id, strftime(session_start, {TS}) AS session_start, strftime(session_end, {TS}) AS session_end, event_count"


def shown(df: DataFrame) -> DataFrame:
    return df.withColumns({"session_start": ts_text("session_start"), "session_end": ts_text("session_end")})


@query("r10_session_activity", f"SELECT {SESSION_COLS} FROM {SESSION_SQL}")
def _(t):
    return shown(st.batch_sessions(t.events, "user_id", "ts", "event_id", 6 * 3600))


@query("r10_session_activity_stream", f"SELECT {SESSION_COLS} FROM {SESSION_SQL}")
def _(t):
    return shown(st.drained_sessions(event_stream(t).select("user_id", "ts"), "user_id", "ts", 6 * 3600, "1 hour"))


@query("r10_session_windows_stream", f"SELECT {SESSION_COLS} FROM {SESSION_SQL}")
def _(t):
    return shown(st.drained(event_stream(t), lambda live: st.stream_sessions(live, "user_id", "ts", "6 hours"), "ts", "1 hour", "session-windows"))
