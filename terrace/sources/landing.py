"""Landing, loading, layout and profiling of source data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bronze_ingest(
    df: DataFrame, source: str, batch_id: int, payload: Sequence[str] | None = None
) -> DataFrame:
    """Raw rows plus audit columns: payload hash, origin, batch and load time."""
    cols = list(payload or df.columns)
    return df.withColumns(
        {
            "_raw_payload_id": F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256),
            "_source_file": F.lit(source),
            "_batch_id": F.lit(batch_id),
            "_ingested_at": F.current_timestamp(),
        }
    )


def append_bronze(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_files(
    spark: SparkSession, fmt: str, files: str, schema: T.StructType, bronze: str, batch_id: int, payload: Sequence[str] | None = None
) -> DataFrame:
    """Append a drop of files to a bronze table, each row with the file it comes from, and return the whole table. A batch has a partition
    of its own, which a repeated load of the same batch replaces."""
    reader = spark.read.schema(schema)
    drop = (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(files)
    raw = bronze_ingest(drop, "", batch_id, payload or schema.names).withColumn("_source_file", F.col("_metadata.file_path"))
    raw.drop("_batch_id").write.mode("overwrite").parquet(f"{bronze}/_batch_id={batch_id}")
    return spark.read.schema(raw.schema).parquet(bronze)


def read_records(spark: SparkSession, fmt: str, path: str, schema: T.StructType) -> DataFrame:
    """Seed records from csv, json or parquet under a declared schema."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def insert_by_name(target: T.StructType, *feeds: DataFrame) -> DataFrame:
    """Union feeds by column name; columns a feed lacks become NULL, types follow the target."""
    out = None
    for feed in feeds:
        cols = [
            (F.col(f.name) if f.name in feed.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target
        ]
        shaped = feed.select(*cols)
        out = shaped if out is None else out.unionByName(shaped)
    return out


def profile_source(df: DataFrame, exact_distinct: Sequence[str] = ()) -> DataFrame:
    """One row per column from a single aggregate: rows, nulls, distinct values, min and max as text.

    Distinct counts are HyperLogLog estimates unless the column is listed in `exact_distinct`.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in df.columns:
        distinct = F.count_distinct(c) if c in exact_distinct else F.approx_count_distinct(c)
        aggs += [
            F.count(c).alias(f"n_{c}"),
            distinct.alias(f"d_{c}"),
            F.min(c).cast("string").alias(f"lo_{c}"),
            F.max(c).cast("string").alias(f"hi_{c}"),
        ]
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(t).alias("data_type"),
            F.col("rows").alias("row_count"),
            (F.col("rows") - F.col(f"n_{c}")).alias("null_count"),
            F.col(f"d_{c}").alias("distinct_count"),
            F.col(f"lo_{c}").alias("min_text"),
            F.col(f"hi_{c}").alias("max_text"),
        )
        for c, t in df.dtypes
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def write_layers(layers: Mapping[str, Mapping[str, DataFrame]], root: str) -> dict[str, str]:
    """Write each layer's tables below `root/<layer>/<table>`; returns the paths."""
    paths = {}
    for layer, tables in layers.items():
        for name, df in tables.items():
            paths[f"{layer}/{name}"] = f"{root}/{layer}/{name}"
            df.write.mode("overwrite").parquet(paths[f"{layer}/{name}"])
    return paths


def write_partitioned(
    df: DataFrame, path: str, partition_by: Sequence[str], cluster_by: Sequence[str] = ()
) -> None:
    """Hive-style partitions, clustered inside. REBALANCE lets AQE split a hot partition over writers."""
    out = df.hint("rebalance", *partition_by)
    if cluster_by:
        out = out.sortWithinPartitions(*partition_by, *cluster_by)
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """Bucketed and sorted table, so later joins on `keys` need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def append_backfill(existing: DataFrame, backfill: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add historical rows whose key is not there yet (on conflict do nothing)."""
    fresh = backfill.join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh)
