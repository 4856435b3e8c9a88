from decimal import Decimal

from conftest import rows
from pyspark.sql import functions as F

from terrace.functions.columns import money
from terrace.operators import facts, quality


def test_allocation_is_exact_for_any_split(make):
    lines = make([(1, i, v) for i, v in enumerate([10, 10, 10, 1])] + [(2, 0, 0), (2, 1, 0)], "o int, n int, v decimal(18,2)")
    for hot in (1000, 2):
        out = facts.allocate(lines, "o", ["n"], F.col("v"), F.lit(100), "part", 2, hot_rows=hot)
        assert rows(out.groupBy("o").agg(F.sum("part").alias("s"))) == [(1, Decimal("100.00")), (2, Decimal("100.00"))]
        assert [r[1] for r in rows(out.filter("o = 1"), "n", "part")] == [Decimal(x) for x in ("32.26", "32.26", "32.25", "3.23")]


def test_apportionment_by_largest_remainders(make):
    big = 10**15
    lines = make(
        [(1, i, Decimal(v), Decimal(100)) for i, v in enumerate([10, 10, 10, 1])] + [(2, 0, Decimal(0), Decimal("-0.05")), (2, 1, None, Decimal("-0.05"))]
        + [(3, i, Decimal(v), Decimal(big) / 100) for i, v in enumerate([big // 100, 1, 7, 3 * 10**12])] + [(4, 0, Decimal(1), None), (None, 0, Decimal(5), Decimal(9))],
        "o int, n int, v decimal(18,2), t decimal(18,2)",
    )
    for hot in (1000, 2):
        out = facts.apportion(lines, "o", ["n"], F.col("v"), F.col("t"), "part", 2, hot_rows=hot)
        got = {(r["o"], r["n"]): r["part"] for r in out.collect()}
        assert len(got) == lines.count() and out.columns == [*lines.columns, "part"]
        assert [got[1, i] for i in range(4)] == [Decimal(x) for x in ("32.26", "32.26", "32.26", "3.22")]
        assert [got[2, i] for i in range(2)] == [Decimal("-0.03"), Decimal("-0.02")]
        assert got[4, 0] is None and got[None, 0] == Decimal("9.00")
        shares = [100 * v for v in (big // 100, 1, 7, 3 * 10**12)]
        quotas = [divmod(big * w, sum(shares)) for w in shares]
        first = sorted(range(4), key=lambda i: (-quotas[i][1], -shares[i], i))[: big - sum(q for q, _ in quotas)]
        assert [int(got[3, i] * 100) for i in range(4)] == [q + (i in first) for i, (q, _) in enumerate(quotas)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "double" not in plan


def test_facts_share_members_and_days(make):
    import datetime as dt

    people = make([(1, "a", "x"), (2, "b", "y")], "c int, sk string, seg string")
    day = dt.date(2024, 2, 3)
    orders = make([(1, day, Decimal(5)), (9, day, Decimal(7)), (None, None, None)], "c int, day date, amount decimal(18,2)")
    paid = make([(2, day, Decimal(1))], "c int, day date, amount decimal(18,2)")
    bus = facts.conformed_facts({"orders": orders, "payments": paid}, people, "c", "sk")
    got = sorted(map(tuple, bus.select("process", "sk", "date_key", "amount", "seg").collect()), key=repr)
    assert got == sorted(
        [("orders", "a", 20240203, Decimal("5.00"), "x"), ("orders", "-1", 20240203, Decimal("7.00"), None), ("orders", "-1", None, None, None), ("payments", "b", 20240203, Decimal("1.00"), "y")],
        key=repr,
    )


def test_weighted_bridge_does_not_double_count(make):
    members = make([(1, "d1", 60), (1, "d2", 30), (1, "d3", 10), (2, "d1", 1)], "e int, doc string, w int")
    bridge = facts.weighted_bridge(members, "e", "doc", F.col("w"))
    heads = make([(1, 50000), (2, 30000)], "e int, charge decimal(18,2)")
    share = facts.attribute_by_weight(heads, bridge, "e", "doc", "charge", "share")
    assert rows(share.agg(F.sum("share").cast("double"))) == [(80000.0,)]
    assert rows(share.filter("doc = 'd1'").select(F.col("share").cast("double"))) == [(60000.0,)]
    assert rows(facts.bridge_member_count(members, "e", F.col("doc") != "d1", "n")) == [(1, 2), (2, 0)]


def test_nested_mart_splits_large_headers_and_loses_nothing(make):
    lines = make([(1, i, 2, i) for i in range(25)] + [(2, 0, 1, 7)], "o int, n int, q double, p double")
    whole = facts.nested_mart(lines, "o", ["n"], ["n", "q", "p"])
    assert rows(whole.select("o", F.size("items"))) == [(1, 25), (2, 1)] and rows(facts.unnest_items(whole, "o")) == rows(lines)
    assert [i.n for i in whole.filter("o = 1").first()["items"]] == list(range(25))
    mart = facts.nested_mart_chunks(lines, "o", ["n"], ["n", "q", "p"], items_per_row=10, hot_rows=8)
    assert rows(mart.select("o", "chunk_no", F.size("items"))) == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 1)]
    assert rows(facts.unnest_items(mart, "o")) == rows(lines)
    total = mart.select(facts.unnest_revenue("q", "p").cast("double").alias("r")).agg(F.sum("r")).first()[0]
    assert total == sum(2 * i for i in range(25)) + 7


def test_funnel(make):
    ev = make([(1, "lead", "2024-01-01"), (1, "trial", "2024-01-03"), (1, "paid", "2024-01-20"), (2, "lead", "2024-01-01"),
               (2, "trial", "2024-01-02"), (2, "paid", "2024-01-18"), (3, "lead", "2024-01-05"), (3, "trial", "2024-01-06"),
               (3, "trial", "2024-01-09")], "u int, kind string, ts timestamp_ntz")
    snap = facts.accumulating_snapshot(ev, "u", "kind", "ts", {"lead": "lead", "trial": "trial", "paid": "paid"}, {"lag": ("trial", "paid")})
    row = facts.funnel_conversion(snap, ["lead", "trial", "paid"], ["lag"]).first()
    assert (row.lead_count, row.paid_count, round(row.trial_to_paid_pct, 1), row.avg_lag) == (3, 2, 66.7, 16.5)


def test_balances_close_and_carry_forward(make):
    flows = make([("a", "2024-01-10", 100), ("a", "2024-03-05", -40), ("b", "2024-02-01", 10), ("b", "2024-02-20", 5)],
                 "acc string, d timestamp_ntz, amt decimal(18,2)")
    snap = facts.periodic_snapshot(flows, "acc", "d", money("amt"))
    got = rows(snap.select("acc", F.date_format("month", "MM"), F.col("balance").cast("int"), F.col("flow").cast("int")))
    assert got == [("a", "01", 100, 100), ("a", "02", 100, 0), ("a", "03", 60, -40), ("b", "02", 15, 15), ("b", "03", 15, 0)]
    close = facts.closing_balance(snap, "acc", "month", "balance", F.quarter("month"))
    assert rows(close.select(F.col("closing_balance").cast("int"), "account_count")) == [(75, 2)]
    naive = quality.additivity_check(snap, "acc", "month", "balance", F.quarter("month")).first()
    assert (naive.closing_balance, naive.summed_balance) == (75.0, 290.0)


def test_currency_triad_and_missing_rate(make):
    rates = make([("2024-01-01", "EUR", 1.1), ("2024-02-01", "EUR", 1.2)], "rate_date timestamp_ntz, currency_code string, spot_rate decimal(12,6)")
    orders = make([(1, "2024-01-01", "2024-02-01", "EUR", 100), (2, "2024-01-01", "2024-02-01", "XXX", 5)],
                  "id int, od timestamp_ntz, pd timestamp_ntz, cur string, amt decimal(18,2)")
    fx = facts.fx_triad(facts.fx_triad(orders, rates, "od", "cur", "amt", "order"), rates, "pd", "cur", "amt", "paid")
    variance = (F.col("paid_usd") - F.col("order_usd")).cast("double")
    assert rows(fx.select("id", variance)) == [(1, 10.0), (2, None)]
    assert not quality.currency_triad_check(fx, "amt", "cur", "order_rate").first()["passed"]


def test_drill_across_keeps_one_sided_keys(make):
    a, b = make([("x", 5), ("y", 7)], "k string, ordered int"), make([("y", 6), ("z", 1)], "k string, paid int")
    out = facts.drill_across({"o": a, "p": b}, ["k"])
    assert rows(out, "k", "ordered", "paid", "in_o", "in_p") == [("x", 5, 0, True, False), ("y", 7, 6, True, True), ("z", 0, 1, False, True)]


def test_incremental_and_navigation(make):
    src = make([(1, "a"), (2, "b"), (3, "zz")], "id int, c string")
    dim = make([("a", "sk_a"), ("b", "sk_b")], "c_key string, sk string")
    new = facts.fact_incremental(src.filter("id = 1"), src, ["id"], [(dim, "c_key", "c", "sk", "UNKNOWN_SK")])
    assert rows(new, "id", "sk") == [(2, "sk_b"), (3, "UNKNOWN_SK")]
    base = make([("p", 1, 2), ("p", 2, 3), ("q", 1, 5)], "g string, h int, v int")
    rollup = facts.rollup_table(base, {"g": F.col("g"), "h": F.col("h")}, {"v": F.col("v")})
    for wanted in ({"g": F.col("g")}, {"half": F.col("v") > 2}):
        a = facts.aggregate_navigation(wanted, [(rollup, ["g", "h"])], base, {"v": F.col("v")})
        b = facts.aggregate_navigation(wanted, [], base, {"v": F.col("v")})
        assert rows(a) == rows(b)
    gaps = facts.coverage_gap(src.select("c"), src.filter("id < 3"), ["c"])
    assert rows(gaps) == [("zz",)]


def test_named_average_weighs_readings_of_entities_that_share_a_name(make):
    readings = make([(1, 10, "2024-02-01"), (1, 20, "2024-02-01"), (2, 90, "2024-02-01"), (3, 99, "2024-02-01"), (4, 1, "2024-02-01"), (1, 999, "2023-01-01"), (2, None, "2024-02-01")], "e int, v decimal(10,2), ts timestamp_ntz")
    members = make([(1, "pump"), (2, "pump"), (4, "fan")], "k int, name string")
    got = facts.named_entity_average(readings, "e", F.col("v"), F.col("ts") >= "2024-01-01", 5.0, members, "k", "name")
    assert rows(got) == [("pump", 40.0, 4)]
