"""Hard negatives by exact inner products in a residue number system.

Components are quantised to floor(256 * x). Rows are packed into blocks, anchors into batches, and every block meets every batch of its vector length. Where
they meet, both matrices are reduced modulo several small primes, multiplied in float32 (residues are small enough for every partial sum to stay below
2^24, so each product is exact), and the signed scores are put together by Chinese remaindering. The primes are as many as the largest possible score of
the two needs. A first meeting gives the best rows of the anchor's label (its positives), a second one the best rows of other labels whose score lies in
the window that each positive opens; few rows per block go on to the final ranking by window functions.

Rows with a null label, id or vector, or with a component that is null, not finite, or not finite when multiplied by 256, take no part. Only vectors of equal
length meet. Rows that share an id are separate rows, as anchors and as candidates; only the anchor's own row is left out. Ties go to the smaller id. Scores
of any size are ranked exactly; one that no 64-bit integer holds is returned as null. Extra columns take no part. Without rows the result is empty.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import stored

BLOCK_BYTES = 4 << 20
BATCH_BYTES = 128 << 10
CHUNK = 1024  # components per float32 product
EXACT = 1 << 24


@lru_cache(maxsize=8)
def primes(dims: int) -> list[int]:
    """Primes, largest first, whose centred residues keep a product over min(dims, CHUNK) components below 2^24."""
    most = 2 * math.isqrt((EXACT - 1) // max(1, min(dims, CHUNK))) + 1
    return [p for p in range(most, 2, -1) if all(p % d for d in range(2, math.isqrt(p) + 1))]


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """Residues in [-(p-1)/2, (p-1)/2] as float32; values are whole doubles of any size."""
    r = np.fmod(values, p)
    half = (p - 1) // 2
    return np.where(r > half, r - p, np.where(r < -half, r + p, r)).astype(np.float32)


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products (rows x anchors) of whole doubles: int64, or Python integers where a score might not fit."""
    dims = rows.shape[1]
    if not len(rows) or not len(anchors) or not dims:
        return np.zeros((len(rows), len(anchors)), np.int64)
    bound = dims * int(np.abs(rows).max()) * int(np.abs(anchors).max())
    used, product = [], 1
    for p in primes(dims):
        if product > 2 * bound:
            break
        used.append(p)
        product *= p
    if product <= 2 * bound:  # more than all primes hold: components of about 1e200
        whole = lambda m: [[int(x) for x in row] for row in m.tolist()]
        right = whole(anchors)
        return np.array([[sum(a * b for a, b in zip(x, y)) for y in right] for x in whole(rows)], object)
    wide = product >= 1 << 62
    total, base = None, 1
    for p in used:  # mixed radix: total is the score modulo the product of the primes so far
        r = np.zeros((len(rows), len(anchors)), np.int64)
        left, right = residues(rows, p), residues(anchors, p)
        for at in range(0, dims, CHUNK):
            r += np.rint(left[:, at : at + CHUNK] @ right[:, at : at + CHUNK].T).astype(np.int64)
        r %= p
        if total is None:
            total = r.astype(object) if wide else r
        else:
            total = total + base * ((r - (total % p).astype(np.int64)) * pow(base, -1, p) % p).astype(total.dtype)
        base *= p
    return np.where(total > product // 2, total - product, total)


def sortable(score: int) -> str:
    """Digits whose order as a string is that of the integers."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + digits.translate(NINES)


NINES = str.maketrans("0123456789", "9876543210")


def value_of(key: str) -> int:
    return int(key[5:]) if key[0] == "1" else -int(key[5:].translate(NINES))


def as_long(key: Column) -> Column:
    """The score of a sortable key; null where no long holds it."""
    digits = F.substring(key, 6, 20)
    positive, negative = digits.try_cast("bigint"), (-F.translate(digits, "0123456789", "9876543210").cast("decimal(20,0)")).try_cast("bigint")
    return F.when(F.length(key) > 24, F.lit(None).cast("bigint")).when(key.startswith("1"), positive).otherwise(negative)


def taking_part(embeddings: DataFrame, label: Column) -> DataFrame:
    """row (a number of its own), vec_id, label, dims, v of the rows that take part."""
    v = F.transform(F.col("embedding"), lambda e: e.cast("double") * 256)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("v").alias("dims"), "v"), "negatives-rows")


def packed(rows: DataFrame, part_bytes: int, name: str) -> DataFrame:
    """dims, part, rows: about `part_bytes` of vectors in each part, dealt by a hash of the row."""
    total = rows.agg(F.sum(F.col("dims").cast("long") + 4)).first()[0] or 0
    parts = max(1, -(-total * 8 // part_bytes))
    columns = [c for c in rows.columns if c != "dims"]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    return dealt.groupBy("dims", "part").agg(F.collect_list(F.struct(*columns)).alias(name))


def met(blocks: DataFrame, batches: DataFrame, found, ddl: str) -> DataFrame:
    """Rows (as tuples in the order of `ddl`) that `found` gives for each block and each batch of the same vector length."""
    spark = blocks.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = blocks.select("dims", F.col("part").alias("block"))
    sent = batches.select("dims", "anchors").join(names, "dims")
    work = blocks.withColumnRenamed("part", "block").repartition(partitions, "dims", "block").join(sent.repartition(partitions, "dims", "block"), ["dims", "block"])
    schema = spark.createDataFrame([], ddl).schema
    kinds = [pa.string() if f.dataType.typeName() == "string" else pa.int64() for f in schema]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                out = list(found(Part(b.column("rows")[i].values), Part(b.column("anchors")[i].values)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=schema.names)

    return work.select("rows", "anchors").mapInArrow(run, schema)


class Part:
    """The rows of a block or batch as arrays."""

    def __init__(self, packed_rows: pa.StructArray):
        order = np.lexsort((packed_rows.field("row").to_numpy(), packed_rows.field("vec_id").to_numpy()))
        take = packed_rows.take(pa.array(order))  # in ascending id
        self.row, self.vec_id, self.label = (take.field(c).to_numpy() for c in ("row", "vec_id", "label"))
        self.v = np.floor(take.field("v").flatten().to_numpy(zero_copy_only=False)).reshape(len(order), -1)
        self.windows = take.field("windows").to_pylist() if "windows" in [f.name for f in take.type] else None


def best(rows: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """The k of `rows` (ascending) with the highest scores, in order; ties to the first."""
    if len(rows) > k:
        kth = np.partition(s[rows], len(rows) - k)[len(rows) - k] if s.dtype != object else sorted(s[rows], reverse=True)[k - 1]
        rows = rows[s[rows] >= kth]
    return rows[np.argsort(-s[rows], kind="stable")][:k]


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of `anchors` (rows of `rows`) and each of its `positives`
    best other rows of its label the `negatives` best rows of other labels with low * positive score <= 100 * score <= high * positive score. `rows` as
    `taking_part` gives them."""
    blocks = stored(packed(rows, BLOCK_BYTES, "rows"), "negatives-blocks")

    def same_label(block: Part, batch: Part):
        every = scores(block.v, batch.v)
        for j, row in enumerate(batch.row.tolist()):
            for i in best(np.flatnonzero((block.label == batch.label[j]) & (block.row != row)), every[:, j], positives).tolist():
                yield row, int(block.row[i]), int(block.vec_id[i]), sortable(int(every[i, j]))

    near = met(blocks, packed(anchors, BATCH_BYTES, "anchors"), same_label, "row long, positive_row long, positive_id long, score string")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "positive_id", "positive_row"))
    kept = near.withColumn("place", place).where(F.col("place") <= positives)
    windows = kept.groupBy("row").agg(F.collect_list(F.struct("positive_row", "positive_id", "score")).alias("windows"))  # at most `positives`
    opened = stored(anchors.join(windows, "row"), "negatives-anchors")

    def other_label(block: Part, batch: Part):
        every = scores(block.v, batch.v)
        for j, row in enumerate(batch.row.tolist()):
            s, other = every[:, j], block.label != batch.label[j]
            for w in batch.windows[j]:
                p = value_of(w["score"])
                least, most = -(-low * p // 100), high * p // 100
                if s.dtype != object:  # bounds beyond 64 bits hold for all or none of the scores
                    least, most = max(least, -(1 << 63)), min(most, (1 << 63) - 1)
                    if least > most:
                        continue
                for i in best(np.flatnonzero(other & (s >= least) & (s <= most)), s, negatives).tolist():
                    yield row, int(batch.vec_id[j]), w["positive_row"], w["positive_id"], w["score"], int(block.row[i]), int(block.vec_id[i]), sortable(int(s[i]))

    ddl = "row long, anchor_id long, positive_row long, positive_id long, positive string, negative_row long, negative_id long, negative string"
    found = met(blocks, packed(opened, BATCH_BYTES, "anchors"), other_label, ddl)
    rank = F.row_number().over(Window.partitionBy("row", "positive_row").orderBy(F.desc("negative"), "negative_id", "negative_row"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", as_long(F.col("positive")).alias("positive_score"), as_long(F.col("negative")).alias("negative_score"))
