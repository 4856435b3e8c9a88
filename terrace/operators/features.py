"""Feature store: versions, point-in-time training sets, rolling features, vector search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.columns import micros
from terrace.functions.vectors import cosine_similarity
from terrace.operators.ordered import HOT_ROWS, ordered_scan, split_hot
from terrace.operators.temporal import asof_join

MOST_QUERIES = 10_000


def feature_versions(features: DataFrame, key: str) -> DataFrame:
    return features.groupBy(key).agg(F.count(F.lit(1)).alias("version_count"))


def training_set(
    observations: DataFrame, features: DataFrame, key: str, obs_ts: str, feature_ts: str,
    values: Sequence[str], tie: Sequence[str] = (), hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Observations with the newest features known at their time, and a `leaks` flag (never true)."""
    bound = asof_join(observations, features, key, obs_ts, feature_ts, values, tie, hot_rows=hot_rows)
    return bound.withColumn("leaks", F.coalesce(F.col(f"matched_{feature_ts}") > F.col(obs_ts), F.lit(False)))


def feature_completeness(bound: DataFrame, matched: str, values: Sequence[str]) -> DataFrame:
    return bound.agg(
        F.count(F.lit(1)).alias("observations"),
        F.count(matched).alias("bound"),
        *[F.count(v).alias(f"{v}_present") for v in values],
    )


def centroids(vectors: DataFrame, label: str, vector: str, length: int) -> DataFrame:
    """Mean vector per label for vectors of a known length: one mean per component, pre-aggregated before
    the shuffle, so no component rows are exploded."""
    means = vectors.groupBy(label).agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"_{i}") for i in range(length)])
    return means.select(label, F.array(*[f"_{i}" for i in range(length)]).alias("centroid"))


def similarity_to(vectors: DataFrame, queries: DataFrame, on: str, vector: str, query: str, digits: int = 6) -> DataFrame:
    """Cosine of each vector with the query vector of its group: one query per group, no pairs."""
    joined = vectors.join(queries, on)
    return joined.withColumn("similarity", F.round(cosine_similarity(vector, query), digits))


def topk_similar(vectors: DataFrame, queries: DataFrame, on: str, vector: str, query: str, tie: str, k: int) -> DataFrame:
    """The k nearest vectors per query among those of its own group (`topk_nearest` looks at all); each map task keeps at
    most k rows per group before the shuffle."""
    scored = similarity_to(vectors, queries, on, vector, query)
    w = Window.partitionBy(on).orderBy(F.desc("similarity"), tie)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def topk_nearest(
    vectors: DataFrame, queries: DataFrame, name: str, vector: str, query: str, tie: str, k: int, digits: int = 6,
    most: int = MOST_QUERIES,
) -> DataFrame:
    """The k nearest of all vectors per query (`name`, `query`). The query set is broadcast, so more than `most` queries
    are an error; each map task keeps at most k rows per query before the shuffle. Vectors without a cosine are not near."""
    asked = queries.select(F.col(name).alias("_name"), F.col(query).alias("_query"))
    if asked.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} queries")
    scored = vectors.select(tie, vector).crossJoin(F.broadcast(asked))
    scored = scored.select(F.col("_name").alias(name), tie, F.round(cosine_similarity(vector, "_query"), digits).alias("similarity"))
    w = Window.partitionBy(name).orderBy(F.desc("similarity"), tie)
    return scored.filter("similarity is not null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rolling_features(
    df: DataFrame, key: str, ts: str, value: Column, windows: Mapping[str, int], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rolling sum and count over the last `seconds` (inclusive) at each (key, ts).

    Ordinary keys use a RANGE window. Hot keys use prefix sums: the running total now minus the running
    total just before the window opens, both found by slice-parallel scans. A window without values sums to NULL in both ways. The
    value must be exact (decimal or integer): differences of running doubles would lose digits.
    """
    per = df.groupBy(key, ts).agg(F.sum(value).alias("_v"), F.count(value).alias("_n"))
    cold, hot, _ = split_hot(per, [key], hot_rows)
    w = Window.partitionBy(key).orderBy(F.col("_us"))
    ranged = cold.withColumn("_us", micros(ts))
    out = ranged.withColumns(
        {f"{n}_sum": F.sum("_v").over(w.rangeBetween(-s * 1_000_000, 0)) for n, s in windows.items()}
        | {f"{n}_count": F.sum("_n").over(w.rangeBetween(-s * 1_000_000, 0)) for n, s in windows.items()}
    ).drop("_us", "_v", "_n")
    if hot is None:
        return out
    running = ordered_scan(hot, [key], [ts], running={"_rv": "_v", "_rn": "_n"}, hot_rows=hot_rows)
    probe = running
    past = running.select(key, F.col(ts).alias("_pt"), F.col("_rv").alias("_ov"), F.col("_rn").alias("_on"))
    for n, s in windows.items():
        opened = probe.withColumn("_open", F.col(ts) - F.expr(f"interval {s} seconds") - F.expr("interval 1 microsecond"))
        hit = asof_join(opened, past, key, "_open", "_pt", ["_ov", "_on"], hot_rows=hot_rows)
        probe = hit.withColumns(
            {
                f"{n}_sum": F.when(F.col("_rn") > F.coalesce("_on", F.lit(0)), F.coalesce("_rv", F.lit(0)) - F.coalesce("_ov", F.lit(0))),
                f"{n}_count": F.col("_rn") - F.coalesce("_on", F.lit(0)),
            }
        ).drop("_open", "matched__pt", "_ov", "_on")
    return out.unionByName(probe.select(*out.columns))
