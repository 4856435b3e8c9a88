"""Sharding by a keyed permutation of global row numbers.

A balanced Feistel network over 2*h bits (the smallest even width that holds all rows) permutes row numbers; numbers that land outside the
table walk the cycle until they come back in. Shard and slot follow from the place by one division, so both are computable from (row number,
row count, shard count, seed) alone, and `row_of` goes back. Law `rows`: counts of shards differ by one at most, slots have no gaps.

Rows of equal doc_id are ordered by size and CRC; rows equal in all three are interchangeable. A null doc_id comes first; a null text counts
as no bytes (size 1, CRC 0). An empty table gives no rows. Other columns take no part and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import numbered

ROUNDS = 6
SEED = 20240229


def _keys(seed: int) -> list[int]:
    return [(seed * 0x9E3779B97F4A7C15 + i * 0xBF58476D1CE4E5B9) % (1 << 63) for i in range(1, ROUNDS + 1)]


def _half(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(x: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return (x ^ (x >> np.uint64(32))) & mask


def _network(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in reversed(keys) if back else keys:
        left, right = (right ^ _round(left, key, mask), left) if back else (right, left ^ _round(right, key, mask))
    return (left << shift) | right


def permuted(rows: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Places of row numbers 0..n-1 (`back`: row numbers of places), a bijection of 0..n-1."""
    half, keys = _half(n), _keys(seed)
    with np.errstate(over="ignore"):
        out = _network(rows.astype(np.uint64), half, keys, back)
        while (outside := out >= np.uint64(n)).any():
            out[outside] = _network(out[outside], half, keys, back)
    return out.astype(np.int64)


def row_of(shard: int, slot: int, n: int, shards: int, seed: int = SEED) -> int:
    """The row number at a shard's slot."""
    return int(permuted(np.array([slot * shards + shard]), n, seed, back=True)[0])


def place(row_no: Column, n: int, seed: int = SEED) -> Column:
    @F.pandas_udf("long")
    def at(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(permuted(rows.to_numpy(np.int64), n, seed))

    return at(row_no)


def shard_rows(documents: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_no, shard, slot of every row. Only these narrow columns are shuffled, never the texts."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered(narrow, [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")], int(spark.conf.get("spark.sql.shuffle.partitions")), "shard-rows")
    n = rows.count()
    at = rows.withColumn("place", place(F.col("row_no"), max(n, 1), seed))
    return at.select("doc_id", "size", "text_crc32", "row_no", (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {int(shards)}").alias("slot"))
