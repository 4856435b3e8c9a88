"""What several operators of this package share: stored tables, word hashing in tasks, components of a link table."""

from __future__ import annotations

import shutil
import struct
import tempfile
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.session import scratch_path

MIX = 0x9E3779B97F4A7C15
BATCH_BYTES = 1 << 20


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Give executors this package through Spark, once per application: they need not have it installed."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        _SHIPPED.add(application)
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='terrace-')}/terrace_package", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, partitions: int, name: str) -> DataFrame:
    """`df` with a gapless global `row_no` from 0 in the given order. No task sees more than its range: rows are range-partitioned and
    sorted, stored once, and only the count of each partition (one row per partition) is summed up and sent back."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    kept = stored(ranged, name)
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r[0], r[1]) for r in kept.groupBy(part.alias("p")).count().collect())  # bounded by `partitions`
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    if not offsets:
        return kept.withColumn("row_no", F.col("__at")).drop("__at")
    small = spark.createDataFrame(pa.table({"__p": [p for p, _ in offsets], "__offset": [o for _, o in offsets]}))
    return kept.withColumn("__p", part).join(F.broadcast(small), "__p").withColumn("row_no", F.col("__offset") + place).drop("__p", "__at", "__offset")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), for uint64 arrays."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """64-bit hashes of byte words. Frequent words are hashed once per task; the memo has a size bound."""

    LIMIT = 200_000

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo, hash_of = self.memo, xxhash.xxh3_64_intdigest
        if len(memo) > self.LIMIT:
            memo.clear()
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = memo.get(w)
            if h is None:
                h = memo[w] = hash_of(w)
            out[i] = h
        return out


def word_list(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white-space bytes: the words `[^\\x20\\x09-\\x0D]+`."""
    return text.lower().split() if text else []


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; of the whole sequence, if it is shorter; none of an empty one."""
    n = len(hashes)
    if n == 0:
        return hashes
    span = min(width, n)
    out = np.zeros(n - span + 1, np.uint64)
    for i in range(span):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(hashes[i : n - span + 1 + i] + np.uint64((i + 1) * MIX % (1 << 64)))
    return mixed(out + np.uint64(span))


def over_batches(fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: pa.Schema) -> Callable:
    """mapInArrow body: `fn` gives row dicts of a batch."""

    def run(batches):
        for batch in batches:
            rows = list(fn(batch))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def components(links: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(node, root) for every node of the links: root is the smallest node reachable. Alternating star steps; each round is one stored
    table of at most as many rows as before, and the number of rounds grows with the logarithm of the longest chain."""
    edges = stored(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), f"{name}-edges")
    while True:
        # large star: every larger neighbour goes to the smallest neighbour (or the node itself)
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: every smaller neighbour and the node itself go to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        after = stored(small, f"{name}-edges")
        # done when every node has one root and no root hangs below another
        several = after.groupBy("hi").count().where("count > 1").limit(1).count()
        chained = 0 if several else after.join(after.select(F.col("hi").alias("lo")), "lo", "left_semi").limit(1).count()
        edges = after
        if not several and not chained:
            break
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots.select("node", F.col("node").alias("root")))


_ID = struct.Struct("<I").pack


class WordIds:
    """Ids of texts whose words are encoded independently. Each distinct word of a batch goes once to the tokenizer's model (the whole tokenizer costs
    three times as much a word); a memo of bounded size keeps the words seen first. `spelt` gives the model's spelling of a word."""

    LIMIT = 200_000

    def __init__(self, model, split: Callable[[str], list[str]], spelt: Callable[[str], str] = str):
        self.model, self.split, self.spelt = model, split, spelt
        self.memo: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.split(t) if t else [] for t in texts]
        known = self.memo
        new = list(set(chain.from_iterable(cut)).difference(known))
        tokenize, spelt = self.model.tokenize, self.spelt
        found = {w: b"".join([_ID(t.id) for t in tokenize(spelt(w))]) for w in new}
        full = len(known) >= self.LIMIT
        known.update(found)
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in cut]
        if full:
            for w in new:
                del known[w]
        return out


def slices(batch: pa.RecordBatch, texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `most` bytes of text each, so that ids of a part fit in a worker."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t.as_buffer() or b"") if t.is_valid else 0
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
