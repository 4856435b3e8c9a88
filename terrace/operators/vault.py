"""Raw vault loads: hubs, links, satellites and the views over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.columns import business_key, sha_key
from terrace.operators.ordered import HOT_ROWS, ordered_scan


def hub_load(
    existing: DataFrame | None, feed: DataFrame, key: str, load_dts: str, rec_src: str, hk: str
) -> DataFrame:
    """New hub rows: one per business key with its first load time and source. Insert only. Rows are
    reduced to one per key first, so each key is hashed once."""
    keyed = feed.filter(F.col(key).isNotNull()).groupBy(business_key(key).alias("_bk")).agg(
        F.min(F.col(key)).alias(key),
        F.min(load_dts).alias("load_dts"),
        F.min_by(F.col(rec_src), F.struct(load_dts, rec_src)).alias("rec_src"),
    )
    first = keyed.select(sha_key("_bk").alias(hk), key, "load_dts", "rec_src")
    return first if existing is None else first.join(existing.select(hk), hk, "left_anti")


def link_load(
    existing: DataFrame | None, feed: DataFrame, keys: Mapping[str, str], load_dts: str, rec_src: str, hk: str
) -> DataFrame:
    """New link rows for {hash key name: business key column}; the link key hashes all of them."""
    parts = [f"_b{i}" for i in range(len(keys))]
    by = [business_key(c).alias(p) for c, p in zip(keys.values(), parts)]
    distinct = feed.groupBy(*by).agg(
        F.min(load_dts).alias("load_dts"), F.min_by(F.col(rec_src), F.struct(load_dts, rec_src)).alias("rec_src")
    )
    hashed = [sha_key(p).alias(name) for name, p in zip(keys, parts)]
    first = distinct.select(sha_key(*parts).alias(hk), *hashed, "load_dts", "rec_src")
    return first if existing is None else first.join(existing.select(hk), hk, "left_anti")


def hash_diff(attrs: Sequence[str]) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(a).cast("string"), F.lit("")) for a in attrs]), 256)


def satellite_load(
    existing: DataFrame | None,
    feed: DataFrame,
    key: str,
    load_dts: str,
    attrs: Sequence[str],
    rec_src: Column,
    hk: str,
    hot_rows: int = HOT_ROWS,
    biggest: int | None = None,
) -> DataFrame:
    """New satellite rows: a row is appended only when its attributes differ from the row before it,
    the newest stored row included. One row per (key, load time) is expected in the feed."""
    rows = feed.select(
        sha_key(key).alias(hk), F.col(load_dts).alias("load_dts"), hash_diff(attrs).alias("hash_diff"),
        *attrs, rec_src.alias("rec_src"), F.lit(1).alias("_new"),
    )
    if existing is not None:
        last = satellite_latest(existing, hk).withColumn("_new", F.lit(0))
        rows = rows.unionByName(last.select(*rows.columns))
    seen = ordered_scan(rows, [hk], ["load_dts", "_new"], lag={"_prev": "hash_diff"}, hot_rows=hot_rows, biggest=biggest)
    return seen.filter((F.col("_new") == 1) & ~F.col("hash_diff").eqNullSafe(F.col("_prev"))).drop("_new", "_prev")


def satellite_latest(sat: DataFrame, hk: str, as_of: Column | None = None) -> DataFrame:
    """Newest row per hub key, optionally among rows loaded up to `as_of`. Aggregates before the shuffle."""
    rows = sat if as_of is None else sat.filter(F.col("load_dts") <= as_of)
    rest = [c for c in rows.columns if c != hk]
    newest = F.max_by(F.struct(*rest), F.struct("load_dts", "hash_diff")).alias("_s")
    return rows.groupBy(hk).agg(newest).select(hk, "_s.*")


def hub_profile(
    hub: DataFrame, sats: Mapping[str, tuple[DataFrame, Sequence[str]]], hk: str, as_of: Column | None = None
) -> DataFrame:
    """The hub with the newest (or as-of) attributes of each satellite {name: (satellite, attributes)}."""
    out = hub
    for name, (sat, attrs) in sats.items():
        newest = satellite_latest(sat, hk, as_of).select(hk, *attrs, F.col("load_dts").alias(f"{name}_load_dts"))
        out = out.join(newest, hk, "left")
    return out


def vault_orphans(link: DataFrame, hubs: Mapping[str, DataFrame]) -> DataFrame:
    """Link rows whose hash key has no hub row, per hash key."""
    out = None
    for hk, hub in hubs.items():
        one = link.join(hub.select(hk), hk, "left_anti").select(F.lit(hk).alias("hash_key"), F.col(hk).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def source_isolation(sats: Sequence[DataFrame]) -> DataFrame:
    """Rows and keys per source over all satellites."""
    out = None
    for sat in sats:
        one = sat.select("rec_src", F.col(sat.columns[0]).alias("hk"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("rec_src").agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("hk").alias("key_count"))
