"""Streams that stop after half of their files and go on in another process give what a batch over all of them gives."""

import subprocess
import sys
from pathlib import Path

import stream_jobs

from conftest import rows
from pyspark.sql import functions as F
from terrace.operators import dimensions as dim
from terrace.operators.silver import tag_rejects
from terrace.streaming import streams as st

JOBS = Path(__file__).with_name("stream_jobs.py")


def events(spark, first, last):
    """Two events a minute for three days with pauses, every tenth event twice, one very active user."""
    n = spark.range(first, last).withColumn("i", F.explode(F.when(F.col("id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    at = F.col("id") * 30 + F.floor(F.col("id") / 700) * 7200
    return n.select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).cast("bigint").alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + at).cast("timestamp_ntz").alias("ts"),
        F.element_at(F.array(*map(F.lit, "abc")), (F.floor(F.col("id") / 50) % 3 + 1).cast("int")).alias("kind"), (F.col("id") % 7).alias("value"),
    )


def run(*args):
    subprocess.run([sys.executable, str(JOBS), *map(str, args)], check=True, capture_output=True, timeout=400)


def test_a_new_process_goes_on(spark, tmp_path):
    data, half = tmp_path / "data", 1000
    events(spark, 0, half).coalesce(2).write.mode("append").parquet(str(data))
    run(data, tmp_path / "root", "more", tmp_path / "first")
    events(spark, half, 2 * half).coalesce(2).write.mode("append").parquet(str(data))
    run(data, tmp_path / "root", "final", tmp_path / "second")
    table = events(spark, 0, 2 * half)
    once = table.dropDuplicates()
    sessions = st.batch_sessions(table, "user_id", "ts", "event_id", 1800)
    want = {
        "roas": st.campaign_roas(table, "kind", F.col("value"), F.lit(1)), "dedup": once.drop("ts"), "good": table.filter("value > 0"),
        "bad": tag_rejects(table, {"value > 0": F.col("value") > 0}).filter("reject_reason is not null"),
        "scd2": dim.scd2_build(once, "user_id", "ts", ["kind"]),
        "windows": st.tumbling_counts(table.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "10 minutes", ["kind"]),
        "sessions": sessions.select("user_id", F.col("session_start").cast("timestamp"), F.col("session_end").cast("timestamp"), "event_count"),
    }
    for name, whole in want.items():
        first, second = (spark.read.parquet(str(tmp_path / part / name)).select(*whole.columns) for part in ("first", "second"))
        assert rows(second) == rows(whole), name
        assert rows(first) != rows(whole), name


def test_a_stream_without_files(spark, tmp_path):
    spark.createDataFrame([], stream_jobs.EVENTS).write.parquet(str(tmp_path / "none"))
    found = stream_jobs.jobs(st.read_stream(spark, str(tmp_path / "none"), stream_jobs.EVENTS), str(tmp_path / "root"), True)
    assert {name: table.count() for name, table in found.items()} == dict.fromkeys(found, 0)


def test_a_repeated_micro_batch_replaces_its_output(spark, tmp_path):
    root = str(tmp_path / "root")
    assert st.newest(spark, root) == ""
    st.commit(spark, root, 0, "a")
    st.commit(spark, root, 1, "b")
    st.commit(spark, root, 1, "c")
    assert st.newest(spark, root) == "c" and st.newest(spark, root, 1) == "a" and st.newest(spark, root, 0) == ""
