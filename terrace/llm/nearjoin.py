"""Set-similarity self-join of documents by n-gram Jaccard, with count vectors in an R-tree.

A document's set is its distinct `WIDTH`-word shingles. Documents with equal sets are one point. Two sets A, B with Jaccard >= 75/100 share a shingle among
the first |A| - ceil(0.75 |A|) + 1 of A and as many of B, in any order common to all; so only these prefixes are shuffled, packed, by shingle. Sets that meet
there (by bytes of a hash: a chance meeting is one more candidate and no link) form groups around the smallest member. In a group, shingles are hashed into `GROUPS` groups; the counts are a point, an R-tree holds the points, and the
summed minima of coordinates bound the overlap of a set with a node's box and with a point. First the bound alone thins the groups out, then full sets are
fetched for those left, and surviving pairs are verified exactly, except pairs that are already connected. Full sets are shuffled twice, by set and then by
call; teams with the same least set share a call, and a call gets each of its sets once.

Every shingle order gives the same links. The order used is by hash, with shingles last that a sample of documents shows to be frequent: a matter of speed only.
Groups larger than a task's share are split; members that are then outside the group's main component meet every part of it.

Words: `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; with fewer than `WIDTH` words the whole sequence is the only shingle; null, empty or blank texts have none and
link with nothing. Shingles are compared by 64-bit hashes, sets by 128-bit hashes. Repeated doc_ids are separate texts; a null doc_id links, but is never a component's name (null if
there is no other). Extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import Words, components, mixed, shingle_hashes, stored, word_list

WIDTH = 5
NUM, DEN = 75, 100
GROUPS = 64
CHUNK = 1024
SAMPLED = 64
FREQUENT = 8
FREQUENT_KEPT = 100_000
BITS = 1 << 24
BIT_ROW = 32768  # bits in a row of a bitmap
KEY_BYTES, SENT_BYTES = 6, 5  # of a prefix shingle's hash: stored; sent to the task that its stored bytes name
CALL_ROWS = 10_000
CALL_BYTES = 16 << 20


def shingle_set(words: Words, text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(words(word_list(text)), WIDTH))


def set_id(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def short_id(sid: bytes) -> int:
    return int.from_bytes(sid[:8], "little", signed=True)


def prefix(own: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The part of a set that must meet: hash order, frequent shingles (`last`, sorted) after all others."""
    n = len(own)
    if len(last):
        late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
        own = np.concatenate([own[~late], own[late]])
    return own[: n - -(-NUM * n // DEN) + 1]


def short_keys(keys: np.ndarray, size: int = KEY_BYTES) -> bytes:
    """The low `size` bytes of each hash."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def long_keys(data: bytes, size: int = KEY_BYTES) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def count_vector(own: np.ndarray) -> np.ndarray:
    """Shingles per group. The number of groups is a power of two that grows with the set (GROUPS up to twice GROUPS * 8 shingles), since a box over few groups
    says nothing of long texts; a vector folds to fewer groups by adding its parts."""
    groups = GROUPS << max(0, (max(len(own), 1) - 1) // (GROUPS * 8)).bit_length()
    return np.bincount((mixed(own) % np.uint64(groups)).astype(np.int64), minlength=groups).astype("<u4")


def packed_vector(own: np.ndarray) -> bytes:
    """The counts in the fewest bytes that hold the largest, which come first; 0 stands for half a byte."""
    v = count_vector(own)
    if v.max(initial=0) < 16:
        return b"0" + (v[::2] | v[1::2] << 4).astype(np.uint8).tobytes()
    width = next(w for w in (1, 2, 4) if v.max(initial=0) < 1 << 8 * w)
    return b"%d" % width + v.astype(f"<u{width}").tobytes()


def unpacked_vector(data: bytes) -> np.ndarray:
    if data[:1] == b"0":
        halves = np.frombuffer(data, np.uint8, offset=1)
        return np.stack([halves & 15, halves >> 4], axis=1).ravel()
    return np.frombuffer(data, f"<u{data[:1].decode()}", offset=1)


def folded(v: np.ndarray, groups: int) -> np.ndarray:
    return v.astype(np.int64).reshape(-1, groups).sum(axis=0)


def least_overlap(a, b):
    """The smallest overlap of sets of a and b shingles with 100 * overlap >= 75 * union."""
    return -(-(NUM * (a + b)) // (DEN + NUM))


class Tree:
    """A two-level R-tree over count vectors: leaves of points that are near in size and counts, boxes of leaves, boxes of boxes."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        major = points[:, : points.shape[1] // 2].sum(axis=1)
        order = np.argsort(sizes, kind="stable")
        # sort-tile: slabs by size, then by half of the counts within a slab
        slab = (np.arange(len(order)) // (self.FAN * self.FAN))[np.argsort(order, kind="stable")]
        self.order = np.lexsort((major, slab))
        self.points, self.sizes = points[self.order].astype(np.int64), sizes[self.order]
        cut = np.arange(0, len(order), self.FAN)
        self.high, self.low_n, self.high_n = np.maximum.reduceat(self.points, cut), np.minimum.reduceat(self.sizes, cut), np.maximum.reduceat(self.sizes, cut)
        cut = np.arange(0, len(cut), self.FAN)
        self.top = np.maximum.reduceat(self.high, cut), np.minimum.reduceat(self.low_n, cut), np.maximum.reduceat(self.high_n, cut)

    @staticmethod
    def may(point, n, high, low_n, high_n) -> np.ndarray:
        """Boxes that may hold a partner: by size, then by summed coordinate minima."""
        fits = (high_n * DEN >= NUM * n) & (low_n * NUM <= DEN * n)
        bound = np.minimum(point, high).sum(axis=1)
        return fits & (bound >= least_overlap(n, np.maximum(low_n, -(-NUM * n // DEN))))

    def partners(self, point: np.ndarray, n: int) -> np.ndarray:
        """Points (original positions) whose bound with `point` allows a link."""
        point = point.astype(np.int64)
        upper = np.flatnonzero(self.may(point, n, *self.top))
        leaves = (upper[:, None] * self.FAN + np.arange(self.FAN)).ravel()
        leaves = leaves[leaves < len(self.high)]
        leaves = leaves[self.may(point, n, self.high[leaves], self.low_n[leaves], self.high_n[leaves])]
        rows = (leaves[:, None] * self.FAN + np.arange(self.FAN)).ravel()
        rows = rows[rows < len(self.points)]
        return self.order[rows[self.may(point, n, self.points[rows], self.sizes[rows], self.sizes[rows])]]


def joined(vectors: list[np.ndarray], sizes: np.ndarray, linked: Callable[[int, int], bool] | None, label: np.ndarray | None = None) -> np.ndarray:
    """Labels of the components under `linked` (None: under the bound alone). Pairs inside a component are not looked at again. Partners differ
    in size by a third at most, so their vectors have as many groups or twice as many: one tree for each number of groups."""
    label = np.arange(len(vectors)) if label is None else label.copy()
    dims = np.array([len(v) for v in vectors])
    for g in np.unique(dims).tolist():
        pool = np.flatnonzero((dims == g) | (dims == 2 * g))
        if len(pool) < 2:
            continue
        points = np.stack([folded(vectors[i], g) for i in pool])
        tree = Tree(points, sizes[pool])
        for at in np.flatnonzero(dims[pool] == g).tolist():
            i = int(pool[at])
            if (label[pool] == label[i]).all():
                continue
            near = pool[tree.partners(points[at], int(sizes[i]))]
            near = near[(label[near] != label[i]) & ((near > i) | (dims[near] > g))]
            while len(near):
                j = int(near[0])
                if linked is None or linked(i, j):
                    label[label == label[j]] = label[i]
                near = near[1:]
                near = near[label[near] != label[i]]
    return label


def verified(sets: list[np.ndarray]) -> Callable[[int, int], bool]:
    def linked(i: int, j: int) -> bool:
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return DEN * common >= NUM * (len(sets[i]) + len(sets[j]) - common)

    return linked


def frequent(documents: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that are frequent in prefixes of one in SAMPLED documents: bounded, and used for the order only."""

    def keys(batches):
        words, none = Words(), np.zeros(0, np.uint64)
        for b in batches:
            sets = [shingle_set(words, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.binary()), pa.array([prefix(s, none).view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sid", "keys"])

    some = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select(F.col("text").cast("string").cast("binary").alias("text"))
    once = some.mapInArrow(keys, "sid binary, keys array<long>").groupBy("sid").agg(F.first("keys").alias("keys"))
    counted = once.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    rows = counted.orderBy(F.desc("n"), "key").limit(FREQUENT_KEPT).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


READ = "doc_id long, n long, sid binary, prefix binary, counts binary"


def read_sets(documents: DataFrame, last: np.ndarray, key: str | None = None) -> DataFrame:
    """A row per document: size and id of its set; prefix and counts, unless the same task has already given those of an equal set; and column `key`, if named."""
    kept = ["doc_id", *[key] * (key is not None)]
    sent = documents.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        words, seen, last_ = Words(), set(), sent.value
        for b in batches:
            size, sids, prefixes, counts = [], [], [], []
            for t in b.column("text"):
                own = shingle_set(words, t.as_py())
                sid = set_id(own) if len(own) else None
                new = sid is not None and sid not in seen
                if new and len(seen) < 500_000:
                    seen.add(sid)
                size.append(len(own))
                sids.append(sid)
                prefixes.append(short_keys(prefix(own, last_)) if new else None)
                counts.append(packed_vector(own) if new else None)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(size, pa.int64()), pa.array(sids, pa.binary()), pa.array(prefixes, pa.binary()), pa.array(counts, pa.binary())], names=[*kept, "n", "sid", "prefix", "counts"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in kept[1:]], F.col("text").cast("string").cast("binary").alias("text"))
    return stored(narrow.mapInArrow(run, READ if key is None else READ.replace("doc_id long", f"doc_id long, `{key}` string")), "join-sets")


MET = "pivot long, member long"


def met(read: DataFrame, parts: int) -> DataFrame:
    """(pivot, member) of sets that share a prefix shingle, the pivot being the smallest that has it. Entries travel packed, in one row per task
    batch and part: keys, each set once, and a bit for each key that is the first of the next set. A shingle's entries of equal sets fall together in the
    task that gets it."""

    def deal(batches):
        for b in batches:
            prefixes = b.column("prefix").to_pylist()
            shorts = np.array([short_id(s) for s in b.column("sid").to_pylist()], np.int64)
            keys = long_keys(b"".join(prefixes))
            owner = np.repeat(np.arange(len(shorts)), [len(p) // KEY_BYTES for p in prefixes])
            part = (mixed(keys) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, keys, owner = part[order], keys[order], owner[order]
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            rows = []
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(part)]):
                first = np.diff(owner[a:z], prepend=-1) != 0
                rows.append((int(part[a]), short_keys(keys[a:z], SENT_BYTES), shorts[owner[a:z][first]].tobytes(), np.packbits(first).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "keys", "owners", "firsts"])

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [long_keys(x, SENT_BYTES) for x in frame["keys"]]
        firsts = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for k, x in zip(keys, frame["firsts"])]
        owners = np.concatenate([np.frombuffer(x, np.int64)[np.cumsum(f, dtype=np.int64) - 1] for x, f in zip(frame["owners"], firsts)])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        several = np.zeros(len(keys), bool)
        same = keys[1:] == keys[:-1]
        several[1:] |= same
        several[:-1] |= same
        keys, owners = keys[several], owners[several]
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
        keys, owners = keys[new], owners[new]
        start = np.ones(len(keys), bool)
        start[1:] = keys[1:] != keys[:-1]
        pivot = owners[np.maximum.accumulate(np.where(start, np.arange(len(keys)), 0))] if len(keys) else owners
        return pd.DataFrame({"pivot": pivot, "member": owners})[pivot != owners].drop_duplicates()

    dealt = read.where("prefix is not null").select("sid", "prefix").mapInArrow(deal, "part long, keys binary, owners binary, firsts binary")
    return stored(dealt.groupBy("part").applyInPandas(meet, MET).distinct(), "join-met")


def _cut(*columns: pd.Series) -> list[tuple[int, int]]:
    """Ranges of equal values in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        v = c.to_numpy()
        new[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(new)
    return list(zip(at.tolist(), np.append(at[1:], len(new)).tolist()))


def thinned(groups: DataFrame, points: DataFrame) -> DataFrame:
    """(pivot, chunk, member) -> those with a partner in their group under the bound, in groups that the bound connects: (team, lead, sid, n), lead being the
    short id of the team's least sid. Many small groups share a task call. With a column `root`, members of one root are connected already, and it is kept."""
    rooted = ["root"] if "root" in groups.columns else []
    calls = max(-(-groups.count() // CALL_ROWS), int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def thin(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pivot", "chunk", "sid"]).drop_duplicates(["pivot", "chunk", "sid"]).reset_index(drop=True)
        roots = frame["root"].to_list() if rooted else []
        vectors, sizes, sids = [unpacked_vector(c) for c in frame["counts"]], frame["n"].to_numpy(np.int64), frame["sid"].to_list()
        team, lead, member = [], [], []
        for a, z in _cut(frame["pivot"], frame["chunk"]):
            start = np.unique(frame["root"][a:z], return_inverse=True)[1] if rooted else None
            if rooted and start.max() == 0:
                continue
            label = joined(vectors[a:z], sizes[a:z], None, start)
            for one in np.unique(label).tolist():
                at = np.flatnonzero(label == one) + a
                if len(at) > 1 and (not rooted or len({roots[i] for i in at}) > 1):
                    name = xxhash.xxh3_64_intdigest(b"".join(sids[i] for i in at)) - (1 << 63)
                    team += [name] * len(at)
                    lead += [short_id(sids[at[0]])] * len(at)
                    member += at.tolist()
        out = pd.DataFrame({"team": np.array(team, np.int64), "lead": np.array(lead, np.int64), "sid": [sids[i] for i in member], "n": sizes[member] if member else np.zeros(0, np.int64)})
        return out.assign(root=[roots[i] for i in member]) if rooted else out

    own = groups.join(points, groups["member"] == points["short"]).select("pivot", "chunk", "sid", "n", "counts", *rooted)
    call = F.pmod(F.xxhash64("pivot", "chunk"), F.lit(calls)).alias("call")
    return own.groupBy(call).applyInPandas(thin, "team long, lead long, sid binary, n long" + ", root binary" * len(rooted)).distinct()


def bitmap_of(hashes: DataFrame) -> DataFrame:
    """(b, bits): the bits of column `h`, modulo BITS, in rows of BIT_ROW bits. At most BITS bits in all."""
    bit = F.pmod(F.col("h"), F.lit(BITS))
    return hashes.select(F.floor(bit / BIT_ROW).cast("int").alias("b"), (bit % BIT_ROW).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))


def parted(rows: DataFrame, h: Column, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` whose hash `h` may be among `hashes` (column `h`), and the others, told apart by a bitmap of fixed size before any shuffle."""
    bit = F.pmod(h, F.lit(BITS))
    place = bit % BIT_ROW
    byte = F.conv(F.hex(F.substring("__hit_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.col("__hit_bits").isNotNull() & (F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1)
    bits = stored(bitmap_of(hashes).select(F.col("b").alias("__hit_row"), F.col("bits").alias("__hit_bits")), "join-bits")
    told = rows.join(F.broadcast(bits), F.floor(bit / BIT_ROW) == F.col("__hit_row"), "left")
    return told.where(hit).select(*rows.columns), told.where(~hit).select(*rows.columns)


def fetched(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, own) of all sids of `wanted` (sid, h: hash of a doc_id that has it) and some others, once each. Texts are filtered by a bitmap before any shuffle."""
    spark = documents.sparkSession
    packed = bitmap_of(wanted).collect()
    bitmap = np.zeros(BITS // 8, np.uint8)
    for b, bits in packed:
        bitmap[b * 4096 : (b + 1) * 4096] = np.frombuffer(bits, np.uint8)
    sent = spark.sparkContext.broadcast(bitmap)

    def run(batches):
        words = Words()
        for b in batches:
            at = b.column("bit").to_numpy().astype(np.int64)
            hits = np.flatnonzero((sent.value[at >> 3] >> (at & 7)) & 1)
            for start in range(0, len(hits), 2000):
                sets = [shingle_set(words, b.column("text")[i].as_py()) for i in hits[start : start + 2000]]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "own"])

    texts = documents.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BITS)).alias("bit"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, "sid binary, own binary").dropDuplicates(["sid"])


def confirmed(documents: DataFrame, teams: DataFrame, points: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect the members of each team as its pairs do. Members may carry a `root` they are already connected by."""
    rooted = "root" in teams.columns
    full = fetched(documents, teams.select("sid").distinct().join(points.select("sid", "h"), "sid"))
    size = teams.agg(F.sum("n")).first()[0] or 0
    calls = -(-int(size) * 8 // CALL_BYTES) or 1

    def confirm(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sid").reset_index(drop=True)
        sids, sets, out = frame["sid"].to_list(), [np.frombuffer(o, np.uint64) for o in frame["own"]], []
        vectors, sizes = [count_vector(s) for s in sets], np.array([len(s) for s in sets])
        member = np.repeat(np.arange(len(sets)), [len(t) for t in frame["teams"]])
        rows = pd.DataFrame({"team": np.concatenate(frame["teams"].to_list()), "member": member})
        if rooted:
            rows["root"] = [r for own in frame["roots"] for r in own]
        rows = rows.sort_values(["team", "member"]).reset_index(drop=True)
        for a, z in _cut(rows["team"]):
            at = rows["member"][a:z].to_numpy()
            start = np.unique(rows["root"][a:z], return_inverse=True)[1] if rooted else None
            label = joined([vectors[i] for i in at], sizes[at], verified([sets[i] for i in at]), start)
            first = {}
            out += [(sids[at[first.setdefault(k, i)]], sids[at[i]]) for i, k in enumerate(label.tolist())]
        return pd.DataFrame([(a, b) for a, b in out if a != b], columns=["a", "b"])

    call = F.pmod(F.xxhash64("lead"), F.lit(calls)).alias("call")
    dealt = teams.groupBy("sid", call).agg(F.collect_list("team").alias("teams"), *[F.collect_list("root").alias("roots")] * rooted)
    return full.join(dealt, "sid").groupBy("call").applyInPandas(confirm, "a binary, b binary").distinct()


def links(documents: DataFrame, read: DataFrame) -> DataFrame:
    """(a, b) of set ids: verified links whose components are those of all links."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = met(read, parts)
    points = read.where("counts is not null").groupBy("sid").agg(F.first("n").alias("n"), F.first("counts").alias("counts"), F.min(F.xxhash64("doc_id")).alias("h"))
    points = stored(points.withColumn("short", _short(F.col("sid"))), "join-points")
    sized = pairs.groupBy("pivot").agg(F.ceil((F.count(F.lit(1)) + 1) / CHUNK).alias("chunks"))
    dealt = pairs.join(sized, "pivot")
    member = dealt.select("pivot", F.pmod(F.xxhash64("member"), F.col("chunks")).alias("chunk"), "member")
    pivots = sized.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("pivot").alias("member"))
    teams = stored(thinned(member.union(pivots), points), "join-teams")
    found = stored(confirmed(documents, teams, points), "join-links")
    split = stored(sized.where("chunks > 1"), "join-split")
    if split.isEmpty():
        return found
    large = dealt.drop("chunks").join(split, "pivot").select("pivot", "member", "chunks").union(split.select("pivot", F.col("pivot").alias("member"), "chunks"))
    return found.union(across(documents, large, points, found))


def across(documents: DataFrame, large: DataFrame, points: DataFrame, found: DataFrame) -> DataFrame:
    """Links between components inside groups that were split: (pivot, member, chunks). Members outside the group's main component (the one of most members) meet
    every part of the group; members of the main component are one already and need not meet each other."""
    root = components(found, "a", "b", "join-part")
    own = large.join(points.select("short", "sid"), F.col("member") == F.col("short")).join(root.withColumnRenamed("node", "sid"), "sid", "left")
    own = stored(own.select("pivot", "member", "chunks", F.coalesce("root", "sid").alias("root")), "join-large")
    sizes = own.groupBy("pivot", "root").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("pivot").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"))
    main = stored(main.where(F.col("all") > F.col("most")).select("pivot", "main", F.ceil((F.col("all") - F.col("most")) / CHUNK).alias("rests")), "join-main")
    left = own.join(main, "pivot")
    hashed = F.xxhash64("member", F.lit(5))
    # each of the rest goes to every part, and to its own place among the rest; each part is met by every block of the rest
    rest = left.where(F.col("root") != F.col("main")).select("pivot", "member", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("i"), F.pmod(hashed, F.col("rests")).alias("j"))
    part = left.select("pivot", "member", "root", F.pmod(F.xxhash64("member"), F.col("chunks")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)).alias("j"))
    groups = rest.union(part).select("pivot", F.xxhash64("i", "j").alias("chunk"), "member", "root").distinct()
    teams = stored(thinned(stored(groups, "join-rest"), points), "join-across")
    return confirmed(documents, teams, points)


def _short(sid):
    """The first eight bytes of a set id as a little-endian long."""
    swapped = F.concat(*[F.substring(F.hex(sid), 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(swapped, 16, -10).cast("long")


def components_of(documents: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, and component_rows (how many documents its component has). With `key`, the name of a text column
    that tells documents of equal doc_id apart, also that column and least: whether the row is the least (doc_id, key) of its component, null ids last."""
    read = read_sets(documents, frequent(documents), key)
    root = components(links(documents, read), "a", "b", "join")
    place = [] if key is None else [F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(key).alias("key"))]
    named = read.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"), *[F.min(p).alias("first") for p in place])
    rooted = named.join(root.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least", "rows", F.coalesce("root", "sid").alias("root"), *["first"] * len(place))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("component_rows"), *[F.min("first").alias("component_first") for _ in place])
    by_set = stored(rooted.join(whole, "root").select("sid", "component_id", "component_rows", *["component_first"] * len(place)), "join-named")
    more = [c for p in place for c in (F.col(key), F.coalesce(p == F.col("component_first"), F.lit(True)).alias("least"))]
    out = read.join(by_set, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component_rows", F.lit(1)).alias("component_rows"), *more)
    return out
