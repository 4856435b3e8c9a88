from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.operators import silver
from terrace.session import scratch_path
from terrace.sources import generators as gen
from terrace.sources import landing


def rules():
    return {"amount >= 0": F.col("amount") >= 0, "days > 0": F.col("days") > 0}


DDL = "id int, cust string, amount decimal(14,2), days int"


def test_null_operand_lands_in_quarantine_and_nothing_is_lost(make):
    df = make([(1, "a", 5, 1), (2, "a", -1, 0), (3, "b", None, 3), (4, "b", 2, None)], DDL)
    good, bad = silver.quarantine_split(df, rules())
    assert rows(good, "id") == [(1,)]
    assert rows(bad, "id", "reject_reason") == [
        (2, "FAILED_INVARIANT: amount >= 0"), (3, "FAILED_INVARIANT: amount >= 0"), (4, "FAILED_INVARIANT: days > 0"),
    ]
    assert rows(silver.contract_report(df, rules()), "rule_id", "evaluated", "failed", "pass_pct") == [("BR-01", 4, 2, 50.0), ("BR-02", 4, 2, 50.0)]
    assert rows(silver.contract_filter(df, rules()), "id") == [(1,)]


def test_dedup_and_partial_limit(make):
    df = make([(1, "a", 1, 1), (1, "b", 2, 1), (2, "c", 3, 1)], DDL)
    out = silver.dedup_latest(df, ["id"], [F.desc("amount"), F.desc("cust")])
    assert rows(out, "id", "cust") == [(1, "b"), (2, "c")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_casts_defaults_and_codes(make):
    df = make([("x", " Ann "), ("7", "bob")], "n string, name string")
    out = silver.cast_columns(silver.clean_strings(df, ["name"]), {"n": ("int", 0), "cur": ("string", "USD")})
    assert rows(out, "n", "name", "cur") == [(0, "Ann", "USD"), (7, "bob", "USD")]


def test_orphans_and_error_codes(make):
    child = make([(1, 10), (None, 10), (3, 99), (4, None)], "pk int, fk int")
    parent = make([(10,), (10,)], "p int")
    ok, lost = silver.orphan_reject(child, "fk", parent, "p")
    assert ok.count() == 2 and lost.count() == 2
    assert rows(silver.error_codes(child, "pk", "fk", parent, "p"), "pk", "error_code") == [
        (1, None), (3, "E002_ORPHAN_FK"), (4, "E002_ORPHAN_FK"), (None, "E001_NULL_PK"),
    ]


def test_pii(make):
    df = make([("Ann", "123-45-6789")], "name string, user_ssn string")
    assert silver.unmasked_pii_columns(df) == ["user_ssn"]
    masked = silver.mask_columns(df, ["user_ssn"])
    assert silver.unmasked_pii_columns(masked) == [] and len(masked.first()["user_ssn"]) == 64
    text = make([("mail a.b@c.org or 123-45-6789",), ("nothing",)], "t string")
    assert tuple(silver.pii_value_scan(text, "t").first()) == (2, 1, 1, 1, 1)
    assert text.select(silver.redact_text("t")).first()[0] == "mail <EMAIL> or <SSN>"


def test_insert_by_name_and_backfill(make):
    target = T.StructType.fromDDL("a int, b string, c double")
    out = landing.insert_by_name(target, make([("x", "1")], "b string, a string"), make([(2.5,)], "c double"))
    assert out.schema.simpleString() == target.simpleString()
    assert rows(out) == [(1, "x", None), (None, None, 2.5)]
    have, more = make([(1, "old")], "k int, v string"), make([(1, "dup"), (2, "new")], "k int, v string")
    assert rows(landing.append_backfill(have, more, ["k"])) == [(1, "old"), (2, "new")]


def test_partition_pruning_reaches_the_scan(spark, make):
    path = scratch_path(spark, "parts")
    landing.write_partitioned(make([(i, i % 5) for i in range(100)], "v int, p int"), path, ["p"], ["v"])
    one = spark.read.parquet(path).filter("p = 3")
    assert one.count() == 20
    assert "PartitionFilters: [isnotnull(p" in one._jdf.queryExecution().executedPlan().toString()


def test_zipf_is_repeatable_and_skewed(spark):
    ids = spark.range(4000)
    a = gen.gen_zipf_keys(ids, "id", 50, 1.2, 42)
    assert a.count() == 4000
    assert rows(a, "id", "skew_key") == rows(gen.gen_zipf_keys(ids, "id", 50, 1.2, 42), "id", "skew_key")
    top = a.groupBy("skew_key").count().orderBy(F.desc("count")).limit(10).agg(F.sum("count")).first()[0]
    assert top >= 0.7 * 4000


def test_power_law_keys_without_a_table(spark):
    ids = spark.range(40_000)
    for n, s in ((5, 1.0), (200, 0.7), (1000, 1.5), (1, 2.0)):
        drawn = gen.gen_power_law_keys(ids, "id", n, s, 7)
        counts = dict(rows(drawn.groupBy("key_rank").count(), "key_rank", "count"))
        total = sum(k**-s for k in range(1, n + 1))
        assert sum(counts.values()) == 40_000 and min(counts) >= 1 and max(counts) <= n
        for k in range(1, min(n, 5) + 1):
            share = k**-s / total
            assert abs(counts[k] - 40_000 * share) <= 5 * (40_000 * share) ** 0.5 + 1
        head = sum(c for k, c in counts.items() if k <= 20)
        share = sum(k**-s for k in range(1, min(n, 20) + 1)) / total
        assert abs(head - 40_000 * share) <= 500
    wide = gen.gen_power_law_keys(ids, "id", 10**7, 1.2, 7)
    assert rows(wide, "id", "key_rank") == rows(gen.gen_power_law_keys(ids, "id", 10**7, 1.2, 7), "id", "key_rank")
    assert wide.agg(F.max("key_rank")).first()[0] > 10**5


def test_partition_filters_reach_the_scan_and_buckets_save_the_exchange(spark):
    path = scratch_path(spark, "pruned")
    landing.write_partitioned(spark.range(300).selectExpr("id", "id % 3 as part"), path, ["part"], ["id"])
    pruned = spark.read.parquet(path).filter("part = 1")
    assert pruned.count() == 100
    assert "PartitionFilters: [isnotnull(part" in pruned._jdf.queryExecution().executedPlan().toString()
    names = ["terrace_bucket_a", "terrace_bucket_b"]
    for name in names:
        landing.write_bucketed(spark.range(1000).selectExpr("id as k", "id * 2 as v"), name, ["k"], 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table(names[0]).join(spark.table(names[1]).withColumnRenamed("v", "w"), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000 and "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_time_dimension(spark):
    assert gen.time_dimension(spark).filter("hour = 10 and minute = 0 and second = 0").first()["time_sk"] == 36000


def test_drops_of_files_are_appended_once_with_their_path(spark, tmp_path):
    for drop, first in (("a", 0), ("b", 10)):
        spark.range(first, first + 10).selectExpr("id", "cast(id % 3 as string) as kind").repartition(2).write.json(str(tmp_path / drop))
    schema = spark.range(1).selectExpr("id", "cast(id as string) as kind").schema
    for drop, batch in (("a", 1), ("b", 2), ("b", 2)):
        bronze = landing.append_files(spark, "json", str(tmp_path / drop), schema, str(tmp_path / "bronze"), batch)
    assert (bronze.count(), bronze.select("id").distinct().count(), bronze.select("_raw_payload_id").distinct().count()) == (20, 20, 20)
    origin = bronze.selectExpr("_batch_id", "regexp_extract(_source_file, '/([ab])/part-', 1) as folder").distinct()
    assert rows(origin) == [(1, "a"), (2, "b")]
    assert bronze.select("_source_file").distinct().count() == 4
