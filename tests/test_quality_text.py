from conftest import rows
from pyspark.sql import functions as F

from terrace.operators import quality
from terrace.operators import text as tx
from terrace.operators.quality import Check


def test_metric_inflation_fails(make):
    src, gold = make([(100,), (200,)], "v int"), make([(100,), (100,), (200,), (200,), (300,)], "v int")
    assert not quality.metric_conservation(src, F.col("v"), gold, F.col("v")).first()["passed"]
    assert quality.metric_conservation(src, F.col("v"), src, F.col("v")).first()["passed"]


def test_duplicate_and_null_keys_fail(make):
    bad = quality.pk_unique("t", make([(1, "A"), (1, "B"), (None, "C")], "id int, n string"), ["id"]).first()
    assert (bad.duplicate_rows, bad.null_key_rows, bad.passed) == (1, 1, False)


def test_interval_faults_are_found(make):
    ddl = "k string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"
    overlap = make([("a", "2025-01-01", "2025-08-01", "false"), ("a", "2025-07-01", "9999-12-31", "true")], ddl)
    row = quality.interval_checks("o", overlap, "k").first()
    assert (row.overlaps, row.sample_key, row.passed) == (1, "a", False)
    gap = make([("a", "2025-01-01", "2025-02-01", "false"), ("a", "2025-03-01", "2026-01-01", "true"), ("b", "2025-01-01", "2024-01-01", "false")], ddl)
    row = quality.interval_checks("g", gap, "k", hot_rows=1).first()
    assert (row.gaps, row.inverted, row.bad_sentinels, row.not_single_current) == (1, 1, 1, 1)


def test_chasm_and_fanout(make):
    a, b = make([(1, 10), (1, 20)], "k int, v int"), make([(1, 0), (1, 0), (1, 0)], "k int, v int")
    row = quality.chasm_trap({"a": (a, "k", F.col("v")), "b": (b, "k", F.col("v"))}, "a").first()
    naive = a.join(b.withColumnRenamed("v", "w"), "k").agg(F.sum("v")).first()[0]
    assert (row.correct_sum, row.naive_sum) == (30.0, float(naive))
    assert quality.fanout_factor("x", a, "k", b, "k").first()["factor"] == 3.0


def test_factless_with_a_measure_fails(make):
    users, ok = make([(1,)], "id int"), make([(1, "x")], "user_id int, kind string")
    check = lambda df: quality.factless_grain_check(df, ["user_id", "kind"], {"user_id": (users, "id")}).first()
    assert check(ok)["passed"]
    assert check(ok.withColumn("dummy_amount", F.lit(1).cast("decimal(10,2)")))["measure_columns"] == "dummy_amount"


def test_assertion_kinds(make):
    one, none = make([(5,)], "v int"), make([], "v int")
    spec = [("scalar_eq", 5, True), ("scalar_gt", 5, False), ("scalar_gte", 5, True), ("scalar_lt", 6, True), ("scalar_lte", 4, False),
            ("zero_drift", None, False), ("not_null", None, True), ("row_count_gt", 0, True), ("row_count_eq", 2, False), ("is_empty", None, False)]
    got = quality.assertion_suite([Check(k, one, k, e) for k, e, _ in spec])
    assert {r.check_name: r.passed for r in got.collect()} == {k: p for k, _, p in spec}
    empty = quality.assertion_suite([Check("a", none, "scalar_eq", 0), Check("b", none, "not_null"), Check("c", none, "is_empty")])
    assert rows(empty, "check_name", "passed") == [("a", False), ("b", False), ("c", True)]


def test_percentile_ranks(spark, make):
    hundred = spark.range(100).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    few = make([("s", i) for i in range(10)], "g string, v double")
    want = [("g", 100, 49.5, 49.5, 95.0, 99.0), ("s", 10, 4.5, 4.5, 9.0, 9.0)]
    for hot in (1000, 7):
        assert rows(quality.percentile_summary(hundred.unionByName(few), "g", "v", hot_rows=hot)) == want


def test_percentile_mean_of_small_and_huge_values(make):
    df = make([("a", 1e-5), ("a", 2e-5), ("b", 1e15), ("b", 3e15), ("c", 1e200), ("c", 1e200), ("d", None)], "g string, v double")
    got = {r.g: r.mean for r in quality.percentile_summary(df, "g", "v").collect()}
    assert got == {"a": 1.5e-5, "b": 2e15, "c": 1e200}


def test_scorecard_cuts_at_first_blocking_failure(make):
    ddl = "risk_id string, tier int, status string, blocking boolean"
    r = quality.scorecard(make([("B", 1, "WARNING", "false"), ("A", 1, "PASS", "true"), ("C", 2, "FAIL", "true"), ("D", 3, "FAIL", "true")], ddl)).first()
    assert (r.evaluated, r.score, r.certified, r.halted_at) == (3, 70.0, False, "C")
    assert quality.scorecard(make([("A", 1, "PASS", "true")], ddl)).first()["certified"]
    assert quality.scorecard(make([(f"R{i}", 1, "FAIL", "false") for i in range(6)], ddl)).first()["score"] == 0.0


def test_regression_rule(make):
    ddl = "k string, v double, s string"
    base = make([("a", 1, "OK"), ("b", 0.2, "OK"), ("c", 0, "OK"), ("d", 1, "OK")], ddl)
    live = make([("a", 2.5, "OK"), ("b", 0.9, "OK"), ("c", 9, "OK"), ("e", 1, "OK")], ddl)
    cmp = quality.metric_regression(live, base, ["k"], "v", "s")
    assert rows(cmp.filter("regression"), "k") == [("a",)] and rows(cmp.filter("is_new"), "k") == [("e",)]
    assert rows(cmp.filter("is_gone"), "k", "live_value", "base_value", "status_drift") == [("d", None, 1.0, False)]
    assert quality.regression_verdict(cmp).first()["verdict"] == "PERF_ALERT"
    flipped = quality.metric_regression(live.withColumn("s", F.lit("BAD")), base, ["k"], "v", "s")
    assert quality.regression_verdict(flipped).first()["verdict"] == "DRIFT_DETECTED"
    same = quality.metric_regression(base, base, ["k"], "v", "s")
    assert quality.regression_verdict(same).first()["verdict"] == "IDENTICAL"


def test_erasure(make):
    people = make([(1, "Ann", "a@x", "1", "R1"), (2, "Bob", "b@x", "2", "R2")], "id int, name string, email string, phone string, address string")
    sales = make([(1, 1, 10), (2, 1, 5), (3, 2, 7)], "o int, cust int, amt decimal(18,2)")
    done = quality.gdpr_erase(people, "id", make([(1,), (1,)], "id int"), "name", "email", "phone", "address")
    row = done.filter("id = 1").first()
    assert (row["name"], row.phone, row.address) == ("REDACTED", None, "ANONYMIZED_RESIDENCE") and row.email.startswith("gdpr_purged_")
    assert tuple(done.filter("id = 2").first()) == (2, "Bob", "b@x", "2", "R2")
    proof = quality.erasure_proof(people, done, "id", sales, "cust", F.col("amt"), "name").first()
    assert proof.passed and proof.redacted_rows == 1
    lost = quality.erasure_proof(people, done.filter("id = 2"), "id", sales, "cust", F.col("amt"), "name").first()
    assert not lost.passed and lost.orphan_rows == 2 and lost.metric_drift == 15.0


def test_every_fault_of_ghost_rows_is_found(make):
    ddl = "id int, name string, is_inferred boolean"
    fact = make([(1,), (2,), (2,), (9,), (None,)], "id int")
    check = lambda rows_: quality.ghost_rows(make(rows_, ddl), fact, "id", "id", {"name": "?"}).first()
    good = check([(1, "a", "false"), (2, "?", "true"), (9, "?", "true"), (4, "d", "false")])
    assert (good.ghost_rows, good.facts_on_ghosts, good.passed) == (2, 3, True)
    bad = check([(1, "a", "false"), (1, "?", "true"), (2, "known", "true"), (7, "?", "true"), (7, "?", "true")])
    assert (bad.unbound_facts, bad.idle_ghosts, bad.filled_ghosts, bad.doubled_keys, bad.passed) == (1, 1, 1, 2, False)
    none = quality.ghost_rows(make([(1, "a")], "id int, name string"), fact, "id", "id", {}).first()
    assert (none.ghost_rows, none.unbound_facts, none.passed) == (0, 3, False)
    assert quality.ghost_rows(make([], ddl), fact.limit(0), "id", "id", {}).first()["passed"]


def test_a_large_lexicon_is_not_broadcast(make, monkeypatch):
    texts = make([(1, "red blue red"), (2, "blue"), (3, None)], "id int, text string")
    lexicon = make([("warm", "red"), ("cold", "blue"), ("any", "blue")], "tag string, term string")
    small = tx.lexicon_tags(texts, ["id"], "text", lexicon)
    monkeypatch.setattr(tx, "BROADCAST_ROWS", 2)
    large = tx.lexicon_tags(texts, ["id"], "text", lexicon)
    assert rows(small) == rows(large) == [(1, "any", 1), (1, "cold", 1), (1, "warm", 1), (2, "any", 1), (2, "cold", 1)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(small) and "SortMergeJoin" in plan(large)


def test_scd6_and_grain_differences(make):
    bad = make([("a", "LOW", "HIGH", "2024-01-01"), ("a", "HIGH", "LOW", "2024-02-01")], "k string, h string, c string, valid_from timestamp_ntz")
    row = quality.scd6_consistency(bad, "k", "h", "c").first()
    assert (row.mixed_current, row.passed) == (1, False)
    a, b = make([("x", 1), ("y", 2)], "g string, v int"), make([("x", 1), ("z", 0)], "g string, v int")
    assert quality.grain_differences(a, b, ["g"], ["v"]).first()["different_groups"] == 2
    assert quality.grain_differences(a, a, ["g"], ["v"]).first()["passed"]


def test_text_rules(make):
    texts = [
        ("too few words", "REJECT_INSUFFICIENT_LENGTH"), (None, "REJECT_INSUFFICIENT_LENGTH"),
        ("we sell zzzzz things daily", "REJECT_GIBBERISH_DETECTED"), ("a-a-a-a is one word here", "REJECT_GIBBERISH_DETECTED"),
        ("please ASDFGH our four orders", "REJECT_GIBBERISH_DETECTED"), ("the bcdfg word has no vowel", "REJECT_GIBBERISH_DETECTED"),
        ("rows need a row lock and a monthly snapshot", "FLAG_CONTRADICTION"),
        ("live checkout cart with a streaming sensor", "FLAG_CONTRADICTION"),
        ("customers place orders and pay later", "SANITY_PASSED"), ("flask and flash are fine words", "SANITY_PASSED"),
    ]
    df = make([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", tx.text_sanity("t")).collect())
    assert got == {i: reason for i, (_, reason) in enumerate(texts)}


def test_tags_roles_and_completeness(make):
    df = make([(1, "A customer places orders; the shipment payment is tracked on a dashboard with a snapshot of each graph.")], "i int, t string")
    tags = {r.tag for r in tx.tag_counts(df, "t").collect()}
    assert tags == {"is_periodic_state_rollup", "is_graph_topology", "needs_history"}
    roles = tx.term_roles(df, ["i"], "t").first()
    assert roles.nouns == ["customer", "payment", "shipment"] and "tracked" in roles.adjectives and "places" in roles.verbs
    row = tx.completeness_score(df, "t").first()
    assert (row.score, row.missing, row.is_sufficient) == (80.0, ["temporal_policy"], False)
