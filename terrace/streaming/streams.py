"""Structured Streaming jobs. Transformations are plain DataFrame functions, so the same code serves a
stream and its batch twin.

Every job takes a `root` folder of its own (sink, checkpoint and commit table lie in it). Called again with the
same root, also by a new process, it goes on where it stopped; without one it gets a new folder. What a job must
know of earlier micro-batches is read from storage: parquet sinks keep Spark's own log, `foreachBatch` sinks write
one folder per micro-batch and then a row of the commit table, so a repeated micro-batch overwrites its own output
and readers see committed ones only.

Append-mode windows and sessions are final once the watermark has passed them. `closable` adds a second source to a
stream, and `close` puts one row far in the future into it: the next run then emits what was still open.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terrace.functions.columns import dbl, money, n_rows
from terrace.operators import dimensions as dim
from terrace.operators.ordered import HOT_ROWS, largest_group, ordered_scan
from terrace.operators.silver import tag_rejects
from terrace.session import scratch_path, small_table


# ---- plumbing -------------------------------------------------------------------------------------


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Stream over the parquet files of a folder, or of a pattern such as `.../events.parquet*`, which
    covers a table kept as one file as well as one kept as a folder of part files."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def with_event_time(df: DataFrame, ts: str, delay: str | None = None) -> DataFrame:
    """Watermarks need a zoned timestamp; zone-less ones are read in the session zone."""
    out = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, delay) if delay else out


def run_once(writer, checkpoint: str) -> None:
    """Process everything available now and stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def root_of(spark: SparkSession, name: str, root: str | None) -> str:
    return root.rstrip("/") if root else scratch_path(spark, name)


def append_to_table(stream: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Append-mode parquet sink: takes everything available now and returns the whole table."""
    spark, root = stream.sparkSession, root_of(stream.sparkSession, name, root)
    run_once(stream.writeStream.format("parquet").option("path", f"{root}/data").outputMode("append"), f"{root}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


COMMITS = "path string, batch bigint"


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(path, batch) of each finished micro-batch of a `foreachBatch` sink; batch -1 stands for none."""
    small_table(spark, [("",)], "path string").write.mode("ignore").parquet(f"{root}/commits/batch=-1")
    return spark.read.schema(COMMITS).parquet(f"{root}/commits")


def commit(spark: SparkSession, root: str, batch: int, path: str) -> None:
    small_table(spark, [(path,)], "path string").write.mode("overwrite").parquet(f"{root}/commits/batch={batch}")


def newest(spark: SparkSession, root: str, before: int | None = None) -> str:
    """What the last micro-batch (before `before`) wrote; empty if there is none."""
    done = commits(spark, root)
    done = done if before is None else done.filter(F.col("batch") < before)
    return done.agg(F.max_by("path", "batch")).first()[0]


def replace_table(stream: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Complete-mode aggregate: each micro-batch writes a new version; the newest committed one is read back."""
    spark, root = stream.sparkSession, root_of(stream.sparkSession, name, root)

    def save(batch: DataFrame, batch_id: int) -> None:
        path = f"{root}/version={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        commit(batch.sparkSession, root, batch_id, path)

    run_once(stream.writeStream.outputMode("complete").foreachBatch(save), f"{root}/checkpoint")
    path = newest(spark, root)
    return spark.read.schema(stream.schema).parquet(path) if path else spark.createDataFrame([], stream.schema)


FAR = "2200-01-01"  # later than any event, and within what pandas holds


def closable(stream: DataFrame, root: str) -> DataFrame:
    """The stream, with a second source that `close` uses."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{root}/close/open")
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{root}/close/*"))


def close(stream: DataFrame, root: str, ts: str) -> None:
    """End the stream: one row that is null but for a time far ahead, so the watermark passes all windows but that row's own.
    Events that come later are late."""
    row = [F.lit(FAR).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
    stream.sparkSession.range(1).select(*row).write.mode("ignore").parquet(f"{root}/close/closed")


def drained(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], ts: str, delay: str, name: str, root: str | None = None) -> DataFrame:
    """`plan` over the stream with its watermark, into a table: all that is available, then the end of the stream."""
    root = root_of(stream.sparkSession, name, root)
    result = plan(with_event_time(closable(stream, root), ts, delay))
    append_to_table(result, name, root)
    close(stream, root, ts)
    return append_to_table(result, name, root)


# ---- metrics: the same for batch and stream -------------------------------------------------------


def campaign_roas(df: DataFrame, campaign: str, revenue: Column, cost: Column) -> DataFrame:
    """Revenue over cost per campaign; no cost gives no ratio."""
    sums = df.groupBy(campaign).agg(F.sum(revenue).alias("_r"), F.sum(cost).alias("_c"), n_rows().alias("event_count"))
    return sums.select(
        campaign, "event_count", dbl("_r").alias("revenue"), dbl("_c").alias("cost"),
        (dbl("_r") / F.nullif(dbl("_c"), F.lit(0.0))).alias("roas"),
    )


def reach_sketches(df: DataFrame, bucket: Column, visitor: str) -> DataFrame:
    """One mergeable HyperLogLog sketch per bucket."""
    return df.groupBy(bucket.alias("bucket")).agg(F.hll_sketch_agg(visitor, F.lit(14)).alias("sketch"))


def reach(sketches: DataFrame) -> DataFrame:
    return sketches.select("bucket", F.hll_sketch_estimate("sketch").alias("approx_visitors"))


def total_reach(sketches: DataFrame) -> DataFrame:
    """Distinct visitors over all buckets from the union of their sketches."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_visitors"))


def window_conversion(df: DataFrame, ts: str, size: str, slide: str | None, converted: Column) -> DataFrame:
    """Share of converted events in sliding (or tumbling) windows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    counts = df.groupBy(w.alias("_w")).agg(n_rows().alias("event_count"), F.count_if(converted).alias("conversions"))
    return counts.select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "event_count", "conversions",
        (dbl("conversions") / dbl("event_count")).alias("conversion_rate"),
    )


def tumbling_counts(df: DataFrame, ts: str, size: str, by: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(F.window(ts, size).alias("_w"), *by).agg(n_rows().alias("event_count"))
    return counts.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, "event_count")


def stream_sessions(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Inactivity sessions with Spark's own session windows (use on streams)."""
    s = df.groupBy(F.session_window(ts, gap).alias("_s"), key).agg(n_rows().alias("event_count"))
    return s.select(key, F.col("_s.start").alias("session_start"), F.col("_s.end").alias("session_end"), "event_count")


class Sessions(StatefulProcessor):
    """Open sessions of one key: a list of (start, last event, events), in microseconds. Input is folded into it batch by batch, so a very
    active key costs the sessions that are still open and not its events. One timer a key, at the end of its earliest session, emits all that
    are over and sets the next; one that a later event made too early emits nothing."""

    def __init__(self, key: str, ts: str, gap_micros: int):
        self.key, self.ts, self.gap = key, ts, gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start bigint, last bigint, events bigint")

    def merged(self, sessions: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for start, last, events in sorted(sessions):
            if out and start <= out[-1][1] + self.gap:
                out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + events)
            else:
                out.append((start, last, events))
        return out

    def handleInputRows(self, key, rows, timerValues):
        found = [tuple(r) for r in self.open.get()]
        for frame in rows:
            if key[0] is None:  # the row that ends the stream
                continue
            at = frame[self.ts].astype("datetime64[us, UTC]" if frame[self.ts].dt.tz is not None else "datetime64[us]").astype("int64")
            counts = at.groupby(at).size()
            found = self.merged(found + [(int(t), int(t), int(n)) for t, n in counts.items()])
        self.keep(found)
        return iter(())

    def keep(self, sessions: list[tuple[int, int, int]]) -> None:
        if sessions:
            self.open.put(sessions)
            self.handle.registerTimer(-(-(min(last for _, last, _ in sessions) + self.gap) // 1000))
        else:
            self.open.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs() * 1000
        every = [tuple(r) for r in self.open.get()]
        done = [s for s in every if s[1] + self.gap <= now]
        self.keep([s for s in every if s[1] + self.gap > now])
        if done:
            micros = lambda values: pd.to_datetime(list(values), unit="us", utc=True)
            yield pd.DataFrame({self.key: [key[0]] * len(done), "session_start": micros(s[0] for s in done), "session_end": micros(s[1] + self.gap for s in done), "event_count": [s[2] for s in done]})

    def close(self) -> None:
        pass


def state_sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """The same sessions by an arbitrary-state operator with event-time timers (needs the RocksDB state store). `df` has a watermark on `ts`."""
    kind = df.schema[key].dataType.simpleString()
    out = f"{key} {kind}, session_start timestamp, session_end timestamp, event_count bigint"
    processor = Sessions(key, ts, gap_seconds * 1_000_000)
    return df.select(key, ts).groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=T.StructType.fromDDL(out), outputMode="append", timeMode="eventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained_sessions(stream: DataFrame, key: str, ts: str, gap_seconds: int, delay: str, root: str | None = None) -> DataFrame:
    """All sessions of a stream that ends, by `state_sessions`."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        return drained(stream, lambda live: state_sessions(live, key, ts, gap_seconds), ts, delay, "sessions", root)
    finally:
        spark.conf.set(name, before)


def batch_sessions(df: DataFrame, key: str, ts: str, tie: str, gap_seconds: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same sessions over a table, scanned in slices so that one very active key does not fill a task."""
    rows = df.select(key, ts, tie)
    biggest = largest_group(rows, [key])
    seen = ordered_scan(rows, [key], [ts, tie], lag={"_p": ts}, hot_rows=hot_rows, biggest=biggest)
    gap = F.make_dt_interval(secs=F.lit(gap_seconds).cast("decimal(18,6)"))
    starts = (F.col("_p").isNull() | (F.col(ts) > F.col("_p") + gap)).cast("bigint")
    numbered = ordered_scan(seen.withColumn("_new", starts), [key], [ts, tie], running={"_no": "_new"}, hot_rows=hot_rows, biggest=biggest)
    return numbered.groupBy(key, "_no").agg(
        F.min(ts).alias("session_start"), (F.max(ts) + gap).alias("session_end"), n_rows().alias("event_count")
    ).drop("_no")


# ---- ingestion ------------------------------------------------------------------------------------


def stream_dedup(df: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """First copy of each key; the watermark bounds how long keys are remembered."""
    return with_event_time(df, ts, delay).dropDuplicatesWithinWatermark([key])


def stream_quarantine(df: DataFrame, rules: Mapping[str, Column], name: str, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split each micro-batch once into accepted and rejected tables partitioned by micro-batch, so that a
    repeated micro-batch overwrites its own output."""
    spark, root = df.sparkSession, root_of(df.sparkSession, name, root)
    tagged_schema = tag_rejects(df, rules).schema

    def split(batch: DataFrame, batch_id: int) -> None:
        tagged = tag_rejects(batch, rules).withColumn("outcome", F.when(F.col("reject_reason").isNull(), "good").otherwise("bad"))
        path = f"{root}/data/batch={batch_id}"
        tagged.write.mode("overwrite").partitionBy("outcome").parquet(path)
        commit(batch.sparkSession, root, batch_id, path)

    run_once(df.writeStream.foreachBatch(split), f"{root}/checkpoint")
    spark.createDataFrame([], tagged_schema).write.mode("ignore").parquet(f"{root}/data/batch=-1/outcome=none")
    schema = T.StructType([*tagged_schema.fields, T.StructField("batch", T.LongType()), T.StructField("outcome", T.StringType())])
    both = spark.read.schema(schema).parquet(f"{root}/data").join(commits(spark, root).select("batch"), "batch", "left_semi")
    good = both.filter("outcome = 'good'").drop("outcome", "batch", "reject_reason")
    return good, both.filter("outcome = 'bad'").drop("outcome", "batch")


def scd2_snapshot(stream: DataFrame, key: str, ts: str, attrs: Sequence[str], root: str | None = None) -> DataFrame:
    """Changes into a Type 2 dimension. Every micro-batch merges into the newest snapshot committed before it and writes its own, named
    by the micro-batch id; a repeated micro-batch gives the same snapshot."""
    spark, root = stream.sparkSession, root_of(stream.sparkSession, "stream-scd2", root)
    none = dim.scd2_build(spark.createDataFrame([], stream.select(key, ts, *attrs).schema), key, ts, attrs, biggest=0)

    def snapshot(session: SparkSession, path: str) -> DataFrame:
        return session.read.schema(none.schema).parquet(path) if path else session.createDataFrame([], none.schema)

    def merge(batch: DataFrame, batch_id: int) -> None:
        old = snapshot(batch.sparkSession, newest(batch.sparkSession, root, batch_id))
        path = f"{root}/snapshot-{batch_id}"
        dim.scd2_merge(old, batch, key, ts, attrs).write.mode("overwrite").parquet(path)
        commit(batch.sparkSession, root, batch_id, path)

    run_once(stream.writeStream.foreachBatch(merge), f"{root}/checkpoint")
    return snapshot(spark, newest(spark, root))


def stream_scd2(
    arrivals: Sequence[Callable[[str], None]], schema: T.StructType, spark: SparkSession, key: str, ts: str, attrs: Sequence[str], root: str | None = None
) -> DataFrame:
    """`scd2_snapshot` after each of `arrivals`, callables that each add files to the source folder."""
    root = root_of(spark, "stream-scd2", root)
    for arrive in arrivals:
        arrive(f"{root}/source")
        done = scd2_snapshot(read_stream(spark, f"{root}/source", schema), key, ts, attrs, root)
    return done


def stream_late_counts(
    arrivals: Sequence[Callable[[str], None]], schema: T.StructType, spark: SparkSession, ts: str, delay: str, size: str, by: Sequence[str], root: str | None = None
) -> DataFrame:
    """Windowed counts under a watermark: a row whose window has already been passed by the watermark is
    dropped, anything newer is counted even when it arrives out of order."""
    root = root_of(spark, "stream-late", root)
    for arrive in arrivals:
        arrive(f"{root}/source")
        done = append_to_table(tumbling_counts(with_event_time(read_stream(spark, f"{root}/source", schema), ts, delay), ts, size, by), "stream-late", root)
    return done


def late_twin(df: DataFrame, arrival: str, ts: str, delay_seconds: int, window_seconds: int, by: Sequence[str]) -> DataFrame:
    """Batch twin of `stream_late_counts`: the watermark of an arrival is the newest event time of the
    arrivals before it less the delay; only windows closed after the last arrival have been emitted.

    Arrivals are few (one per run of the stream), so their maxima are collected per arrival, not per row.
    """
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    end = ((F.floor(second / window_seconds) + 1) * window_seconds).cast("bigint")
    newest = df.groupBy(arrival).agg(F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("_m"))
    marks = newest.withColumns(
        {
            "_before": F.max("_m").over(Window.orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)),
            "_all": F.max("_m").over(Window.orderBy(arrival).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    lag = delay_seconds * 1000
    millis = lambda c: F.greatest(F.floor(F.col(c) / 1000) - lag, F.lit(0))
    marks = marks.select(arrival, F.coalesce(millis("_before"), F.lit(0)).alias("mark"), millis("_all").alias("final"))
    rows = df.withColumn("_end", end).join(marks, arrival)
    kept = rows.filter((F.col("_end") * 1000 > F.col("mark")) & (F.col("_end") * 1000 <= F.col("final")))
    counts = kept.groupBy("_end", *by).agg(n_rows().alias("event_count"))
    return counts.select(F.timestamp_seconds(F.col("_end") - window_seconds).alias("window_start"), *by, "event_count")


def revenue_of(kind: str, value: str = "value", type_col: str = "event_type") -> Column:
    return F.when(F.col(type_col) == kind, money(value)).otherwise(F.lit(0).cast("decimal(18,2)"))
