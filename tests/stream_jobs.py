"""Every streaming job over a folder of event files; run by `test_stream_restart` in processes of its own."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402
from terrace.streaming import streams as st  # noqa: E402

EVENTS = T.StructType().add("event_id", T.LongType()).add("user_id", T.LongType()).add("ts", T.TimestampNTZType()).add("kind", T.StringType()).add("value", T.LongType())


def sessions(stream, root, final):
    """As `drained_sessions`, with the end of the stream left to the caller."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKS)
    live = st.with_event_time(st.closable(stream.select("user_id", "ts"), root), "ts", "1 hour")
    plan = st.state_sessions(live, "user_id", "ts", 1800)
    out = st.append_to_table(plan, "sessions", root)
    if final:
        st.close(stream.select("user_id", "ts"), root, "ts")
        out = st.append_to_table(plan, "sessions", root)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return out


def windows(stream, root, final):
    plan = st.tumbling_counts(st.with_event_time(st.closable(stream, root), "ts", "1 hour"), "ts", "10 minutes", ["kind"])
    out = st.append_to_table(plan, "windows", root)
    if final:
        st.close(stream, root, "ts")
        out = st.append_to_table(plan, "windows", root)
    return out


def jobs(stream, root, final):
    """name -> table after everything in the folder has been read."""
    good, bad = st.stream_quarantine(stream, {"value > 0": F.col("value") > 0}, "quarantine", f"{root}/quarantine")
    return {
        "roas": st.replace_table(st.campaign_roas(stream, "kind", F.col("value"), F.lit(1)), "roas", f"{root}/roas"),
        "dedup": st.append_to_table(st.stream_dedup(stream, "event_id", "ts", "1 hour"), "dedup", f"{root}/dedup").drop("ts"),
        "good": good,
        "bad": bad,
        "scd2": st.scd2_snapshot(stream, "user_id", "ts", ["kind"], f"{root}/scd2"),
        "windows": windows(stream, f"{root}/windows", final),
        "sessions": sessions(stream, f"{root}/sessions", final),
    }


def main(folder: str, root: str, final: str, result: str) -> None:
    from terrace.session import local_session

    spark = local_session(4, 2)
    spark.sparkContext.setLogLevel("ERROR")
    for name, table in jobs(st.read_stream(spark, folder, EVENTS), root, final == "final").items():
        table.write.parquet(f"{result}/{name}")


if __name__ == "__main__":
    main(*sys.argv[1:])
