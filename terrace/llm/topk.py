"""Exact top-k inner products over a bit-sliced index.

Components are quantised to floor(256 * x). The index holds blocks of rows: for each component the upper bits of the quantised value, as bit slices
(one bitmap per bit over the rows of the block), the exact values, and the ids in ascending order. For a query, slices are added with bitmap
arithmetic (3:2 adders over whole groups of bitmaps, weighted by the query's bits), which gives the slices of a coarse score per row; rows are chosen
from the most significant slice downward. The bits left out bound the error, so every row whose coarse score may still reach the k-th is a
boundary row; those are scored exactly. A stated query set runs against all blocks; per query and block k rows go on to the final ranking.

Where a quantised component of the block or the query lies beyond +-LARGEST, the whole block is scored exactly instead, by integers of any size.

Vectors that are null, empty, or hold a null or non-finite component take no part; nor do rows without id. Rows of equal id are separate candidates and
are ranked together as queries, as in the SQL, but a row repeated whole (id and vector) counts once. Only vectors of the same length meet. Ties go to the
smaller id. Extra columns take no part. A quantised component, or a score among the k best of a block, that no 64-bit integer holds is an error, as in the SQL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import stored

BLOCK_ROWS = 8_192
BATCH_QUERIES = 128
LEFT_OUT = 3
LARGEST = (1 << 20) - 1


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array of long) of every row that takes part."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    clean = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    clean = clean.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))).distinct()
    # floor alone would silently stop at the ends of long
    whole = lambda e: F.when((e * 256 >= -(2.0**63)) & (e * 256 < 2.0**63), F.floor(e * 256)).otherwise(F.raise_error(F.lit("floor(256 * x) of a component is no 64-bit integer")).cast("long"))
    return clean.select("vec_id", F.transform("x", whole).alias("v"))


def exact(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of rows of 64-bit integers with a query; integers of any size for rows that could leave 64 bits."""
    fits = np.abs(values.astype(float)).max(axis=1, initial=0) * np.abs(query.astype(float)).sum() < 2.0**62
    if fits.all():
        return values.astype(np.int64) @ query
    out = np.empty(len(values), object)
    out[fits] = (values[fits].astype(np.int64) @ query).astype(object)
    out[~fits] = [sum(a * b for a, b in zip(row, query.tolist())) for row in values[~fits].tolist()]
    return out


def wide(values: np.ndarray) -> bool:
    """Whether bit slices would not do: a value beyond +-LARGEST."""
    return int(values.max()) > LARGEST or int(values.min()) < -LARGEST


class Block:
    """Bit slices of one block: rows are bit positions, in ascending id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], np.ascontiguousarray(values[order])
        rows, dims = self.values.shape
        self.wide = wide(self.values)
        if self.wide:
            return
        upper = self.values >> LEFT_OUT
        self.least = upper.min(axis=0)
        shifted = (upper - self.least).astype(np.int64)
        self.bits = max(1, int(shifted.max()).bit_length())
        self.words = -(-rows // 64)
        padded = np.zeros((self.words * 64, dims), np.int64)
        padded[:rows] = shifted
        self.slices = np.empty((dims, self.bits, self.words), np.uint64)
        for b in range(self.bits):
            packed = np.packbits(((padded >> b) & 1).astype(np.uint8), axis=0, bitorder="little")
            self.slices[:, b] = np.ascontiguousarray(packed.T).view(np.uint64)
        self.everyone = np.packbits((np.arange(self.words * 64) < rows).astype(np.uint8), bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of sum |q_d| * u_d (least significant first), u_d the shifted upper bits, or their complement for a negative q_d; and what to
        add to get sum q_d * (upper bits)."""
        weights: dict[int, list[np.ndarray]] = {}
        size, flip, top = np.abs(query), query < 0, (1 << self.bits) - 1
        for j in range(int(size.max()).bit_length()):
            on = (size >> j) & 1 == 1
            for b in range(self.bits):
                plus, minus = self.slices[on & ~flip, b], ~self.slices[on & flip, b]
                weights.setdefault(j + b, []).extend(x for x in (plus, minus) if len(x))
        constant = int((query * self.least).sum()) - int(size[flip].sum()) * top
        out, w = [], 0
        while weights:
            group = weights.pop(w, [])
            stack = np.concatenate(group) if group else np.zeros((0, self.words), np.uint64)
            carries = []
            while len(stack) > 1:
                if len(stack) == 2:
                    a, b = stack[:1], stack[1:]
                    carries.append(a & b)
                    stack = a ^ b
                    continue
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                half = a ^ b
                carries.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * third :]])
            if carries:
                weights.setdefault(w + 1, []).extend(carries)
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            w += 1
        return out, constant

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) of the block for a query, its own id left out; ties to the smaller id."""
        if self.wide or wide(query):
            return self.best(np.flatnonzero(self.ids != own), query, k)
        candidates = self.everyone.copy()
        for at in range(np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")):
            candidates[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        slices, _ = self.sums(query)
        sure, tied, kth = np.zeros_like(candidates), candidates, 0
        for w in range(len(slices) - 1, -1, -1):  # kth: the k-th largest coarse sum
            one = tied & slices[w]
            n = int(np.bitwise_count(sure).sum() + np.bitwise_count(one).sum())
            if n >= k:
                tied, kth = one, kth | (1 << w)
            else:
                sure, tied = sure | one, tied & ~slices[w]
        if int(np.bitwise_count(sure).sum() + np.bitwise_count(tied).sum()) < k:
            near = candidates  # fewer than k rows in all
        else:
            # the bits left out add between sum of negative q * most and sum of positive q * most
            most = (1 << LEFT_OUT) - 1
            slack = int(np.abs(query).sum()) * most
            near = self.at_least(slices, kth - -(-slack >> LEFT_OUT), candidates)
        return self.best(np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")), query, k)

    def best(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of `rows` by their exact scores."""
        scores = exact(self.values[rows], query)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]

    @staticmethod
    def at_least(slices: list[np.ndarray], bound: int, candidates: np.ndarray) -> np.ndarray:
        """Rows of `candidates` whose sum is at least `bound`."""
        if bound <= 0:
            return candidates
        if bound.bit_length() > len(slices):
            return np.zeros_like(candidates)
        more, equal = np.zeros_like(candidates), candidates
        for w in range(len(slices) - 1, -1, -1):
            if (bound >> w) & 1:
                equal = equal & slices[w]
            else:
                more, equal = more | (equal & slices[w]), equal & ~slices[w]
        return more | equal


def _by_dims(rows: DataFrame, size: int):
    """For each length of vector: into how many parts of about `size` rows its rows go."""
    parts = F.lit(1)
    for dims, n in rows.groupBy("dims").count().collect():  # one row per length of vector
        parts = F.when(F.col("dims") == dims, -(-n // size)).otherwise(parts)
    return parts


INDEX = "dims int, block int, ids binary, vectors binary"


def index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block: ids and quantised values of at most about `block_rows` rows, dealt by a hash of the row."""
    rows = stored(vectors.withColumn("dims", F.size("v")), "bsi-vectors")
    blocks = _by_dims(rows, block_rows)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        values = np.stack(frame["v"].to_numpy()).astype("<i8")
        values = values if wide(values) else values.astype("<i4")
        return pd.DataFrame({"dims": [values.shape[1]], "block": [int(frame["block"].iloc[0])], "ids": [frame["vec_id"].to_numpy("<i8").tobytes()], "vectors": [values.tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), blocks).cast("int"))
    return stored(dealt.groupBy("dims", "block").applyInPandas(build, INDEX), "bsi-index")


FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` (vec_id, v) the k best other rows of `vectors`."""
    blocks = index(vectors)
    partitions = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = queries.withColumn("dims", F.size("v"))
    batch = F.pmod(F.xxhash64("vec_id", "v", F.lit(7)), _by_dims(sized, BATCH_QUERIES)).cast("int")
    packed = sized.withColumn("batch", batch).groupBy("dims", "batch").agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))  # about BATCH_QUERIES each
    # every block meets every batch of the stated query set: a batch goes to each block of its length
    sent = packed.join(F.broadcast(blocks.groupBy("dims").agg(F.max("block").alias("last"))), "dims").select("dims", "queries", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"))
    work = blocks.repartition(partitions, "dims", "block").join(sent.repartition(partitions, "dims", "block"), ["dims", "block"])

    def search(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column("ids")[i].as_py(), "<i8")
                data = b.column("vectors")[i].as_py()
                width = len(data) // (len(ids) * b.column("dims")[i].as_py())  # 4 bytes, or 8 in a wide block
                block = Block(ids, np.frombuffer(data, f"<i{width}").reshape(len(ids), -1))
                out = []
                for q in b.column("queries")[i].as_py():
                    found, scores = block.top(q["vec_id"], np.array(q["v"], np.int64), k)
                    out += [(q["vec_id"], a, s) for a, s in zip(found.tolist(), scores.tolist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    found = work.select("dims", "ids", "vectors", "queries").mapInArrow(search, FOUND)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("vec_id")))), 1, k)  # k rows per block and query
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("rank", "one"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.minus")).alias("score"))
