"""Deterministic generators and the calendar / clock dimensions."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.columns import col, date_key, md5_key, unit_hash
from terrace.session import BROADCAST_ROWS, small_table


def gen_sequence(spark: SparkSession, start: int, stop: int, columns: Mapping[str, Column]) -> DataFrame:
    """Rows for ids start..stop-1 with columns computed from `id`."""
    return spark.range(start, stop).select(*[c.alias(n) for n, c in columns.items()])


def expand_sequence(df: DataFrame, count: Column, index: str = "seq") -> DataFrame:
    """`count` numbered rows (1..count) for each input row; rows with a count below 1 give none."""
    return df.withColumn(
        index, F.explode(F.when(count >= 1, F.sequence(F.lit(1), count.cast("int"))))
    )


def zipf_table(spark: SparkSession, n_keys: int, s: float, cells: int = 1024) -> DataFrame:
    """Cumulative weights 1/k^s cut into equal cells for an equi-join lookup; at most n_keys + cells rows."""
    weights = [1.0 / k**s for k in range(1, n_keys + 1)]
    total, lower, rows = sum(weights), 0.0, []
    running = 0.0
    for k, w in enumerate(weights, start=1):
        running += w
        upper = running / total if k < n_keys else 1.0
        rows.append((k, lower, upper))
        lower = upper
    table = small_table(spark, rows, "key_rank bigint, lo double, hi double")
    first = F.floor(F.col("lo") * cells).cast("int")
    final = F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)).cast("int")
    return table.withColumn("cell", F.explode(F.sequence(first, final)))


def gen_zipf_keys(
    df: DataFrame, id_col: str, n_keys: int, s: float, seed: int, prefix: str = "KEY_", cells: int = 1024
) -> DataFrame:
    """Give each row a power-law key (weight of key k is 1/k^s), fixed by the row id and the seed."""
    table = zipf_table(df.sparkSession, n_keys, s, cells)
    drawn = df.withColumn("_u", unit_hash(id_col, F.lit(seed)))
    drawn = drawn.withColumn("_cell", F.floor(F.col("_u") * cells).cast("int"))
    if n_keys + cells <= BROADCAST_ROWS:
        table = F.broadcast(table)
    hit = (F.col("_cell") == F.col("cell")) & (F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi"))
    keyed = drawn.join(table, hit)
    return keyed.withColumn("skew_key", F.concat(F.lit(prefix), F.col("key_rank"))).drop(
        "_u", "_cell", "cell", "lo", "hi"
    )


def power_law_constants(n_keys: int, s: float) -> dict[str, float]:
    """Constants of rejection-inversion: the integral of x^-s at both ends and the width of the zone that is always accepted."""
    area = math.log if s == 1 else lambda x: x ** (1 - s) / (1 - s)
    back = math.exp if s == 1 else lambda y: ((1 - s) * y) ** (1 / (1 - s))
    return {"right": area(n_keys + 0.5), "width": area(1.5) - 1.0 - area(n_keys + 0.5), "safe": 2.0 - back(area(2.5) - 2.0**-s)}


def gen_power_law_keys(df: DataFrame, id_col: str, n_keys: int, s: float, seed: int, name: str = "key_rank", tries: int = 16) -> DataFrame:
    """Give each row a key 1..n_keys with weight 1/k^s (s > 0) by rejection-inversion of draws hashed from the row id, the seed and the try:
    columns only, no table of weights, so n_keys costs nothing. The first accepted draw counts; a draw is rejected in fewer than one
    case in five, and after `tries` rejections (below 1e-11) the last key stands. Equal ids, also null ones, get equal keys."""
    if n_keys < 1 or s <= 0:
        raise ValueError("at least one key and a positive exponent")
    c = power_law_constants(n_keys, s)
    area = F.log if s == 1 else lambda x: F.pow(x, F.lit(1 - s)) / F.lit(1 - s)
    back = F.exp if s == 1 else lambda y: F.pow(F.lit(1 - s) * y, F.lit(1 / (1 - s)))

    def let(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]

    def key(x: Column) -> Column:
        return F.least(F.greatest(F.floor(x + 0.5), F.lit(1)), F.lit(n_keys)).cast("bigint")

    def draw(i: int) -> Column:
        return F.lit(c["right"]) + unit_hash(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed), F.lit(i)) * F.lit(c["width"])

    def tried(u: Column) -> Column:
        def judged(x: Column) -> Column:
            return let(key(x), lambda k: F.when((k - x <= F.lit(c["safe"])) | (u >= area(k + 0.5) - F.pow(k.cast("double"), F.lit(-s))), k))

        return let(back(u), judged)

    chain = [let(draw(i), tried) for i in range(tries)] + [key(back(draw(tries - 1)))]
    return df.withColumn(name, F.coalesce(*chain))


def gen_time_jitter(df: DataFrame, ts: str, id_col: str, hours: int, seed: int) -> DataFrame:
    """Clock drift of -hours..+hours whole hours, fixed by the row id and the seed."""
    digest = F.conv(F.substring(md5_key(id_col, F.lit(seed), sep="|"), 1, 8), 16, 10).cast("bigint")
    offset = (digest % (2 * hours + 1) - hours).cast("int")
    return df.withColumn("offset_hours", offset).withColumn(
        "jittered_ts", F.col(ts) + F.make_dt_interval(F.lit(0), F.col("offset_hours"))
    )


def date_dimension(df: DataFrame, ts: str) -> DataFrame:
    """One row per calendar day between the smallest and largest date of `ts`."""
    span = df.agg(F.min(ts).cast("date").alias("a"), F.max(ts).cast("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("calendar_date"))
    d = F.col("calendar_date")
    return days.select(
        date_key(d).alias("date_sk"),
        d,
        F.year(d).alias("calendar_year"),
        F.month(d).alias("calendar_month"),
        F.quarter(d).alias("calendar_quarter"),
        F.date_format(d, "EEEE").alias("day_name"),
        (F.year(d) * 100 + F.month(d)).alias("yearmonth_num"),
        F.weekofyear(d).alias("week_of_year"),
    )


def time_dimension(spark: SparkSession) -> DataFrame:
    """One row per second of the day."""
    s = F.col("id")
    return spark.range(86400).select(
        s.cast("int").alias("time_sk"),
        F.floor(s / 3600).cast("int").alias("hour"),
        F.floor((s % 3600) / 60).cast("int").alias("minute"),
        (s % 60).cast("int").alias("second"),
    )


def second_of_day(ts: str | Column) -> Column:
    c = col(ts)
    return (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("int")


def role_playing_dates(fact: DataFrame, dates: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Join one date dimension once per role: {role prefix: timestamp column of the fact}."""
    out = fact
    for role, ts in roles.items():
        dim = dates.select(*[F.col(c).alias(f"{role}_{c}") for c in dates.columns])
        out = out.join(dim, date_key(ts) == F.col(f"{role}_date_sk"), "left")
    return out
