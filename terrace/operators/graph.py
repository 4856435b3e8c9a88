"""Directed transfer graphs: closed rings, reach, degrees, cyclic cores.

Ring search enumerates each wedge at the vertex of lowest (or, for four hops, highest) degree. A vertex
has at most sqrt(2m) neighbours of higher rank, so the work is bounded by m^1.5 for m edges even when one
account takes part in a third of all transfers; plain path expansion would pair all its partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.session import durable


def distinct_pairs(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).filter("s <> d").distinct()


def _ranked(pairs: DataFrame) -> DataFrame:
    """Edges with the (degree, id) rank of both ends."""
    ends = pairs.select(F.explode(F.array("s", "d")).alias("v"))
    degree = ends.groupBy("v").agg(F.count(F.lit(1)).alias("g"))
    s = degree.select(F.col("v").alias("s"), F.col("g").alias("gs"))
    d = degree.select(F.col("v").alias("d"), F.col("g").alias("gd"))
    both = pairs.join(s, "s").join(d, "d")
    return both.select("s", "d", F.struct("gs", "s").alias("rs"), F.struct("gd", "d").alias("rd"))


def ring_roots(edges: DataFrame, src: str, dst: str, size: int) -> DataFrame:
    """Accounts that lie on a simple closed ring of `size` hops (1 to 4): one row per account."""
    if size == 1:
        roots = edges.filter(F.col(src) == F.col(dst)).select(F.col(src).alias("root"))
    elif size == 2:
        pairs = distinct_pairs(edges, src, dst)
        back = pairs.select(F.col("s").alias("d"), F.col("d").alias("s"))
        roots = pairs.join(back, ["s", "d"], "left_semi").select(F.col("s").alias("root"))
    elif size == 3:
        roots = _three_hop(durable(_ranked(distinct_pairs(edges, src, dst))))
    elif size == 4:
        roots = _four_hop(durable(_ranked(distinct_pairs(edges, src, dst))))
    else:
        raise ValueError("rings of 1 to 4 hops are supported")
    return roots.distinct().withColumn("ring_size", F.lit(size))


def _three_hop(ranked: DataFrame) -> DataFrame:
    # v has the lowest rank: v -> w, u -> v, closed by w -> u.
    out = ranked.filter("rd > rs").select(F.col("s").alias("v"), F.col("d").alias("w"))
    into = ranked.filter("rs > rd").select(F.col("d").alias("v"), F.col("s").alias("u"))
    wedges = out.join(into, "v").filter("u <> w")
    closing = ranked.select(F.col("s").alias("w"), F.col("d").alias("u"))
    rings = wedges.join(closing, ["w", "u"], "left_semi")
    return rings.select(F.explode(F.array("v", "w", "u")).alias("root"))


def _four_hop(ranked: DataFrame) -> DataFrame:
    # v has the highest rank: v -> w -> x and x -> u -> v with u <> w.
    down = ranked.filter("rd < rs").select(F.col("s").alias("v"), F.col("rs").alias("rv"), F.col("d").alias("w"))
    step = ranked.select(F.col("s").alias("w"), F.col("d").alias("x"), F.col("rd").alias("rx"))
    forth = down.join(step, "w").filter("rx < rv").select("v", "x", "w")
    up = ranked.filter("rs < rd").select(F.col("d").alias("v"), F.col("rd").alias("rv"), F.col("s").alias("u"))
    back_step = ranked.select(F.col("d").alias("u"), F.col("s").alias("x"), F.col("rs").alias("rx"))
    back = up.join(back_step, "u").filter("rx < rv").select("v", "x", "u")
    # The opposite halves are met through the two extreme middles only: no pairs are enumerated.
    mids_f = forth.groupBy("v", "x").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    mids_b = back.groupBy("v", "x").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    ok_f = forth.join(mids_b, ["v", "x"]).filter("lo <> w or hi <> w")
    ok_b = back.join(mids_f, ["v", "x"]).filter("lo <> u or hi <> u")
    return ok_f.select(F.explode(F.array("v", "x", "w")).alias("root")).unionByName(ok_b.select(F.col("u").alias("root")))


def ring_volume(edges: DataFrame, src: str, dst: str, amount: str, members: DataFrame, member: str) -> DataFrame:
    """Transfers whose both ends are members: how many, and how much."""
    inside = edges.join(members.select(F.col(member).alias(src)).distinct(), src, "left_semi")
    inside = inside.join(members.select(F.col(member).alias(dst)).distinct(), dst, "left_semi")
    return inside.agg(F.count(F.lit(1)).alias("transfer_count"), F.sum(amount).alias("volume"))


def out_degree(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.groupBy(src).agg(F.count_distinct(dst).alias("out_degree"))


def top_hubs(edges: DataFrame, src: str, dst: str, k: int) -> DataFrame:
    return out_degree(edges, src, dst).orderBy(F.desc("out_degree"), src).limit(k)


def reachability(edges: DataFrame, src: str, dst: str, seeds: DataFrame, seed: str, max_hops: int) -> DataFrame:
    """Accounts reached from any seed in at most `max_hops` transfers, with the fewest hops needed.
    Only newly found accounts are expanded, so each edge is followed once."""
    links = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    found = durable(seeds.select(F.col(seed).alias("node")).distinct().withColumn("hops", F.lit(0)))
    frontier = found
    for hop in range(1, max_hops + 1):
        step = frontier.select(F.col("node").alias("s")).join(links, "s").select(F.col("d").alias("node")).distinct()
        frontier = durable(step.join(found.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def cyclic_core(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Nodes that remain when nodes without an incoming or without an outgoing edge are removed until
    none is left: empty exactly when the graph has no cycle. Nodes between two cycles stay; `components` leaves
    them out. One round per level of depth."""
    links = durable(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct())
    return _core(links, 0)[0].select(F.explode(F.array("s", "d")).alias("node")).distinct()


def _core(links: DataFrame, enough: int) -> tuple[DataFrame, int]:
    """Edges whose ends both have incoming and outgoing edges among them, with their bytes; trimmed no further once those are at most
    `enough`."""
    size, volume = _size(links)
    while volume > enough:
        has_in = links.select(F.col("d").alias("s")).distinct()
        has_out = links.select(F.col("s").alias("d")).distinct()
        links = durable(links.join(has_in, "s", "left_semi").join(has_out, "d", "left_semi"))
        left, volume = _size(links)
        if left == size:
            break
        size = left
    return links, volume


def _size(links: DataFrame) -> tuple[int, int]:
    """Edges, and about the bytes they take: both ends as text and 16 more."""
    text = [F.octet_length(F.col(c).cast("string")) for c in ("s", "d")]
    edges, volume = links.agg(F.count(F.lit(1)), F.sum(F.lit(16) + F.coalesce(text[0], F.lit(0)) + F.coalesce(text[1], F.lit(0)))).first()
    return edges, volume or 0


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component_id) of every node that lies on a cycle: strongly connected components of several nodes, and nodes with an edge
    to themselves; the id is the smallest node. Edges with a null end are no edges.

    Nodes that cannot be on a cycle are trimmed until the rest fits one task, which then ends the search in linear time. What stays
    larger gets bounded shortcuts that make paths shorter. Each phase labels every node with the smallest node that reaches it and the
    smallest node that it reaches, both in the same rounds. Where the two agree, that node is the smallest of the component, which is then
    whole; edges between nodes with different labels are dropped, and the rest goes into one task if it fits now, else into the next
    phase. Only nodes that changed send messages, aggregated by receiver before the shuffle. Rounds: the longest trimmed path, and per
    phase the longest shortest path with shortcuts; each phase ends at least the smallest node of each weakly connected part."""
    links = durable(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).dropna().distinct())
    kind = links.select(F.array("s", "d")).schema[0].dataType.elementType
    enough = ONE_TASK if isinstance(kind, ORDERED) or kind == T.StringType() else 0
    found = links.filter("s = d").select("s", F.col("s").alias("component"))
    rest, volume = _core(links.filter("s <> d"), enough)
    if volume > enough:
        rest = _shortened(rest)
    while volume > enough:
        labels = _labelled(rest)
        met = labels.filter("above = below").select(F.col("node").alias("s"), F.col("above").alias("component"))
        several = met.filter("s <> component").select("component").distinct()
        found = found.unionByName(durable(met.join(several, "component", "left_semi").select("s", "component")))
        open_ = labels.filter("above <> below")
        ends = [open_.select(F.col("node").alias(e), "above", "below") for e in ("s", "d")]
        rest = durable(rest.join(ends[0], "s").join(ends[1], ["d", "above", "below"]).select("s", "d"))
        volume = _size(rest)[1]
    if volume:
        found = found.unionByName(durable(_in_one_task(rest, kind)))
    return found.groupBy(F.col("s").alias("node")).agg(F.min("component").alias("component_id"))


ONE_TASK = 32 * 1024 * 1024  # bytes of edges, about a million, that one task may take
ORDERED = (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)  # Arrow sorts these as Spark does; also plain text


def _in_one_task(links: DataFrame, kind: T.DataType) -> DataFrame:
    """(s, component) of the components of several nodes, for edges that fit one task: trimmed while that drops a tenth of them, then
    searched depth first."""

    def strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # nested, so that executors get it by value
        read = [b for b in batches if b.num_rows]
        if not read:
            return
        ends = pa.concat_arrays([b.column(i) for i in (0, 1) for b in read]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        names, nodes = ends.dictionary.take(order), len(order)
        place = np.empty(nodes, np.int64)
        place[order.to_numpy()] = np.arange(nodes)
        s, d = place[ends.indices.to_numpy()].reshape(2, -1)
        while len(s):
            has_in, has_out = np.zeros(nodes, bool), np.zeros(nodes, bool)
            has_in[d], has_out[s] = True, True
            kept = has_in[s] & has_out[d]
            s, d = s[kept], d[kept]
            if kept.mean() > 0.9:
                break
        to, first = d[np.argsort(s, kind="stable")].tolist(), np.append(0, np.cumsum(np.bincount(s, minlength=nodes)))
        following, end = first[:-1].tolist(), first[1:].tolist()
        number, low, done = [0] * nodes, [0] * nodes, [False] * nodes  # number: place in the order of first visits, from 1
        visits, opened, path, members, smallest = 0, [], [], [], []
        for root in np.unique(s).tolist():
            if number[root]:
                continue
            path.append(root)
            while path:
                v = path[-1]
                if not number[v]:
                    visits += 1
                    number[v] = low[v] = visits
                    opened.append(v)
                at = following[v]
                if at < end[v]:
                    following[v] = at + 1
                    w = to[at]
                    if not number[w]:
                        path.append(w)
                    elif not done[w] and number[w] < low[v]:
                        low[v] = number[w]
                    continue
                path.pop()
                if path and low[v] < low[path[-1]]:
                    low[path[-1]] = low[v]
                if low[v] == number[v]:
                    one = [opened.pop()]
                    while one[-1] != v:
                        one.append(opened.pop())
                    for w in one:
                        done[w] = True
                    if len(one) > 1:
                        members += one
                        smallest += [min(one)] * len(one)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(x, pa.int64())) for x in (members, smallest)], ["s", "component"])

    ends = links.select(*[F.col(c).cast(kind).alias(c) for c in ("s", "d")])
    return ends.coalesce(1).mapInArrow(strong, T.StructType([T.StructField("s", kind), T.StructField("component", kind)]))


SHORTCUTS = 16  # two-step paths to enumerate at most, as a multiple of the edges given


def _shortened(links: DataFrame) -> DataFrame:
    """The edges with shortcuts over two steps, again and again while there are few such paths (counted before they are joined). What
    reaches what stays the same, and each time the longest shortest path is halved."""
    given = links.count()
    while given:
        into, out = links.groupBy(F.col("d").alias("node")).agg(F.count(F.lit(1)).alias("i")), links.groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("o"))
        paths = into.join(out, "node").agg(F.sum(F.col("i") * F.col("o"))).first()[0] or 0
        if not 0 < paths <= SHORTCUTS * given:
            break
        size = links.count()
        steps = links.select("s", F.col("d").alias("m")).join(links.select(F.col("s").alias("m"), "d"), "m").select("s", "d").filter("s <> d")
        links = durable(links.unionByName(steps).distinct())
        if links.count() == size:
            break
    return links


def _labelled(links: DataFrame) -> DataFrame:
    """(node, above, below): the smallest node that reaches it and the smallest that it reaches, itself included."""
    steps = durable(links.select(F.inline(F.array(
        F.struct("s", "d", F.lit(True).alias("down")), F.struct(F.col("d").alias("s"), F.col("s").alias("d"), F.lit(False).alias("down"))
    ))))
    labels = durable(steps.select(F.col("s").alias("node")).distinct().select("node", F.explode(F.array(F.lit(True), F.lit(False))).alias("down"), F.col("node").alias("label")))
    changed = labels
    while not changed.isEmpty():
        sent = changed.select(F.col("node").alias("s"), "down", "label").join(steps, ["s", "down"]).groupBy(F.col("d").alias("node"), "down").agg(F.min("label").alias("heard"))
        both = durable(labels.join(sent, ["node", "down"], "left").withColumn("new", F.coalesce(F.col("heard") < F.col("label"), F.lit(False))))
        labels = both.select("node", "down", F.least("label", "heard").alias("label"))
        changed = both.filter("new").select("node", "down", F.col("heard").alias("label"))
    return durable(labels.groupBy("node").agg(F.min(F.when(F.col("down"), F.col("label"))).alias("above"), F.min(F.when(~F.col("down"), F.col("label"))).alias("below")))
