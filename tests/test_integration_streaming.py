import os

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.operators import integration as it
from terrace.session import scratch_path, written
from terrace.sources.brokerage import brokerage_batch, expected_audits
from terrace.streaming import streams as st


@pytest.fixture(scope="module")
def state(spark):
    out = {}
    for batch in (1, 2, 3):
        out = it.load_batch(out, brokerage_batch(spark, batch), batch)
    return out


def test_all_46_audits_pass(spark, state):
    result = it.audits(state, expected_audits(spark))
    assert result.count() == 46
    assert rows(result.filter("not passed")) == []


def test_table_sizes(state):
    sizes = {n: c for n, c, _ in rows(it.control_totals(state))}
    # fixed values: row counts after three batches at scale 1
    assert {k: sizes[k] for k in ("dim_customer", "dim_account", "dim_security", "dim_company", "dim_broker", "fact_trade", "fact_holding",
                                  "fact_cash", "fact_market", "fact_watch", "prospect")} == {
        "dim_customer": 135, "dim_account": 230, "dim_security": 50, "dim_company": 50, "dim_broker": 20, "fact_trade": 1600,
        "fact_holding": 600, "fact_cash": 800, "fact_market": 600, "fact_watch": 100, "prospect": 50,
    }


def test_late_trades_bind_to_the_first_version(state):
    first = state["dim_customer"].filter("customer_id = 1 and version_number = 1").first()["version_sk"]
    late = state["fact_trade"].filter("batch_id = 3")
    assert rows(late.groupBy("sk_customer_id").count()) == [(first, 100)]


def test_audits_can_fail(spark, state):
    broken = dict(state)
    broken["fact_trade"] = state["fact_trade"].unionByName(state["fact_trade"].filter("trade_id <= 3"))
    broken["dim_account"] = state["dim_account"].filter("account_id <> '7'")
    failed = {r[0] for r in rows(it.audits(broken, expected_audits(spark)).filter("not passed"), "audit_id")}
    assert {2, 12, 13, 14, 30, 34, 36, 43} <= failed


def test_reloading_a_batch_adds_no_trade(spark, state):
    again = it.load_batch(state, {"trade": brokerage_batch(spark, 3)["trade"]}, 3)
    assert again["fact_trade"].count() == 1600


def test_reloading_a_whole_batch_changes_nothing(spark, state):
    again = it.load_batch(state, brokerage_batch(spark, 3), 3)
    assert rows(it.control_totals(again)) == rows(it.control_totals(state))


def test_each_feed_is_stored_once_without_long_keys(spark, state, monkeypatch):
    stored, kept = {}, it.written
    monkeypatch.setattr(it, "written", lambda df, name: stored.setdefault(name, kept(df, name)))
    after = it.load_batch(state, brokerage_batch(spark, 3), 4)
    # all trades are known from batch 3, which the keys alone tell
    assert after["fact_trade"].count() == state["fact_trade"].count()
    assert not {"fact_trade", "fact_holding", "fact_cash", "fact_watch", "dim_account"} & set(stored)
    assert all("sk_customer_id" not in stored[name].columns for name in stored if name.endswith("_feed"))
    assert stored["known_trades"].columns == ["trade_id", "_first", "_again"] and stored["known_trades"].count() == 100


def test_each_fact_row_is_kept_or_rejected(spark, state):
    first = brokerage_batch(spark, 1)
    odd = {"cash": first["cash"].orderBy("account_id", "balance_at").limit(3).withColumn("customer_id", F.lit(-1).cast("bigint"))}
    odd["cash"] = odd["cash"].unionByName(odd["cash"].withColumn("account_id", F.lit(None).cast("string")))
    odd["watch"] = first["watch"].orderBy("customer_id", "security_id").limit(4).withColumn("customer_id", F.lit(None).cast("bigint"))
    after = it.load_batch(state, odd, 4)
    assert after["fact_cash"].count() == state["fact_cash"].count() and after["fact_watch"].count() == state["fact_watch"].count()
    fresh = after["messages"].filter("batch_id = 4 and message_type = 'REJECT'").groupBy("message_source", "message_text").count()
    assert rows(fresh) == [("TransformCash", "ORPHAN: account", 3), ("TransformCash", "ORPHAN: customer version", 3), ("TransformWatch", "ORPHAN: customer version", 4)]


def test_later_holdings_are_kept_and_trades_known_from_another_batch_are_told(spark, state):
    first = brokerage_batch(spark, 1)
    some = first["holding"].orderBy("trade_id").limit(5).withColumn("quantity", F.lit(7).cast("decimal(18,2)"))
    later = some.withColumn("held_at", F.col("held_at") + F.expr("interval 90 days"))
    feeds = {"holding": written(some.unionByName(later), "later"), "trade": first["trade"].orderBy("trade_id").limit(3)}
    after = it.load_batch(state, feeds, 4)
    assert after["fact_holding"].filter("batch_id = 4 and quantity = 7").count() == 10
    assert after["fact_trade"].count() == state["fact_trade"].count()
    fresh = after["messages"].filter("batch_id = 4 and message_type = 'REJECT'")
    assert rows(fresh.groupBy("message_source", "message_text").count()) == [("TransformTrade", "KNOWN: trade of batch 1", 3)]
    assert rows(it.control_totals(it.load_batch(after, feeds, 4))) == rows(it.control_totals(after))


def test_orders_without_customer_and_lines_without_order_are_rejected(spark):
    from terrace.plans import integration_queries as iq
    from terrace.plans.registry import Tables
    from terrace.plans.sources_silver import clean_lines

    whole, t = Tables(spark, "/root/testdata/sf0.001"), Tables(spark, "/root/testdata/sf0.001")
    bought = whole.orders.join(whole.lineitem.select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    buyer = bought.filter("o_orderdate < '1998-01-01'").agg(F.min("o_custkey")).first()[0]
    lost = bought.filter(F.col("o_custkey") != buyer).agg(F.min("o_orderkey")).first()[0]
    t.customer, t.orders = whole.customer.filter(F.col("c_custkey") != buyer), whole.orders.filter(F.col("o_orderkey") != lost)
    got, trades = iq.run_batches(t, 3)
    rejected = got["messages"].filter("message_type = 'REJECT'")
    told = rejected.filter("message_source = 'TransformTrade'")
    assert got["fact_trade"].count() + told.count() == clean_lines(t).count()
    lines = clean_lines(t).join(whole.orders.filter(F.col("o_custkey") == buyer), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    orphans = lines.unionByName(clean_lines(t).filter(F.col("l_orderkey") == lost)).count()
    assert orphans > 0 and told.filter("message_text = 'ORPHAN: account' or message_text like 'discount%'").count() >= orphans
    assert rejected.filter("message_source = 'TransformAccount' and message_text = 'ORPHAN: customer'").count() > 0
    assert rows(it.audits(got, iq.expected_totals(t, trades)).filter("not passed")) == []


def drop(spark, data, ddl, path):
    spark.createDataFrame(data, ddl).write.mode("append").parquet(path)


def test_late_rows_are_dropped_exactly_when_the_watermark_says_so(spark):
    ddl = "kind string, at string, arrival int"
    data = [("a", "2024-01-01 10:00", 0), ("a", "2024-01-01 12:00", 0), ("a", "2024-01-01 11:10", 1), ("a", "2024-01-01 09:30", 1),
            ("b", "2024-01-01 15:00", 1), ("a", "2024-01-01 12:30", 2), ("b", "2024-01-02 03:00", 2), ("a", "2024-01-01 13:30", 2)]
    typed = spark.createDataFrame(data, ddl).withColumn("at", F.col("at").cast("timestamp_ntz"))
    arrivals = [lambda p, i=i: typed.filter(F.col("arrival") == i).write.mode("append").parquet(p) for i in range(3)]
    live = st.stream_late_counts(arrivals, typed.schema, spark, "at", "2 hours", "1 hour", ["kind"])
    twin = st.late_twin(typed, "arrival", "at", 7200, 3600, ["kind"])
    assert rows(live, "window_start", "kind", "event_count") == rows(twin, "window_start", "kind", "event_count")
    assert live.agg(F.sum("event_count")).first()[0] < len(data)


def test_sessions_hot_equals_plain(spark):
    data = [("u", f"2024-01-01 {h:02d}:{m:02d}:00", i) for i, (h, m) in enumerate([(0, 0), (0, 29), (0, 59), (2, 0), (2, 30), (3, 1), (3, 20)])]
    df = spark.createDataFrame(data, "k string, at string, id int").withColumn("at", F.col("at").cast("timestamp_ntz"))
    plain, hot = st.batch_sessions(df, "k", "at", "id", 1800), st.batch_sessions(df, "k", "at", "id", 1800, hot_rows=2)
    assert rows(plain) == rows(hot)
    own = st.stream_sessions(df, "k", "at", "30 minutes")
    assert rows(plain.select("session_start", "event_count")) == rows(own.select("session_start", "event_count"))


def test_quarantine_stream_and_sketches(spark):
    src = written(spark.range(200).select("id", (F.col("id") % 3).alias("v")), "quarantine-src")
    folder = src.inputFiles()[0].rsplit("/", 1)[0]
    stream = st.read_stream(spark, folder, T.StructType.fromDDL("id bigint, v bigint"))
    good, bad = st.stream_quarantine(stream, {"v > 0": F.col("v") > 0}, "q")
    assert (good.count(), bad.count()) == (133, 67)
    per_bucket = st.reach_sketches(src, F.col("v"), "id")
    assert abs(st.total_reach(per_bucket).first()[0] - 200) <= 6


def test_stream_reads_a_table_of_one_file_and_of_many(spark):
    df = spark.range(90)
    many = scratch_path(spark, "many") + ".parquet"
    df.repartition(3).write.parquet(many)
    one = f"{many}/" + next(f for f in os.listdir(many.removeprefix("file:")) if f.endswith(".parquet"))
    total = df.repartition(3).count()
    schema = T.StructType.fromDDL("id bigint")
    assert st.append_to_table(st.read_stream(spark, many + "*", schema), "many-out").count() == total
    assert 0 < st.append_to_table(st.read_stream(spark, one + "*", schema), "one-out").count() < total


def test_campaign_metrics(spark, make):
    ddl = "campaign string, ts timestamp_ntz, visitor string, cost decimal(10,2), revenue decimal(10,2), converted boolean"
    clicks = make([("A", "2024-01-01 10:01", "v1", 10, 0, "false"), ("A", "2024-01-01 10:02", "v2", 10, 75, "true"),
                   ("A", "2024-01-01 10:07", "v1", 0, 0, "false"), ("B", "2024-01-01 10:08", "v3", 0, 5, "true")], ddl)
    roas = st.campaign_roas(clicks, "campaign", F.col("revenue"), F.col("cost"))
    assert rows(roas, "campaign", "roas") == [("A", 3.75), ("B", None)]
    assert st.total_reach(st.reach_sketches(clicks, F.col("campaign"), "visitor")).first()[0] == 3
    slide = st.window_conversion(clicks, "ts", "10 minutes", "5 minutes", F.col("converted"))
    assert rows(slide, F.date_format("window_start", "HH:mm"), "event_count", "conversions") == [("09:55", 2, 1), ("10:00", 4, 2), ("10:05", 2, 1)]
    assert rows(st.tumbling_counts(clicks, "ts", "1 hour"), "event_count") == [(4,)]


def test_sessions_of_a_key_need_one_timer_at_a_time():
    import pandas as pd

    class Handle:
        def __init__(self):
            self.rows, self.timers = [], []

        def getListState(self, name, schema):
            return self

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

        def registerTimer(self, at):
            self.timers.append(at)

    class Mark:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    handle, job = Handle(), st.Sessions("k", "ts", 10_000_000)
    job.init(handle)
    stamps = lambda *seconds: iter([pd.DataFrame({"ts": pd.to_datetime([s * 10**6 for s in seconds], unit="us", utc=True)})])
    fire = lambda at: [tuple(r) for out in job.handleExpiredTimer((1,), Mark(at), None) for r in out[["k", "event_count"]].itertuples(index=False)]
    list(job.handleInputRows((1,), stamps(100, 130, 160), None))
    assert handle.timers == [110_000]
    list(job.handleInputRows((1,), stamps(109), None))  # the first session now ends at 119
    assert handle.timers == [110_000, 119_000]
    assert fire(110_000) == [] and fire(119_000) == [(1, 2)] and handle.timers[-1] == 140_000
    assert fire(10**9) == [(1, 1), (1, 1)] and handle.rows == []
