import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from terrace.functions.vectors import cosine_similarity
from terrace.operators import features, graph, vault


def brute_rings(edges, size):
    out = set()
    nodes = {n for e in edges for n in e}
    if size == 1:
        return {a for a, b in edges if a == b}
    for path in itertools.permutations(nodes, size):
        if all((path[i], path[(i + 1) % size]) in edges for i in range(size)):
            out.update(path)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rings_match_brute_force(make, seed):
    rnd = random.Random(seed)
    edges = {(rnd.randint(0, 8), rnd.randint(0, 8)) for _ in range(17)} | {(0, i) for i in range(1, 6)}
    df = make(sorted(edges) + [(0, 1)], "s int, d int")
    for size in (1, 2, 3, 4):
        assert {r[0] for r in rows(graph.ring_roots(df, "s", "d", size))} == brute_rings(edges, size), size


def test_ring_volume_hub_and_chain(make):
    edges = make([("a", "b", 10), ("b", "c", 20), ("c", "a", 30), ("h", "x", 1), ("h", "y", 1), ("h", "z", 1), ("h", "z", 1), ("x", "y", 1)],
                 "s string, d string, amt int")
    ring = graph.ring_roots(edges, "s", "d", 3)
    assert rows(ring, "root") == [("a",), ("b",), ("c",)]
    assert tuple(graph.ring_volume(edges, "s", "d", "amt", ring, "root").first()) == (3, 60)
    assert rows(graph.top_hubs(edges, "s", "d", 1)) == [("h", 3)]
    reach = graph.reachability(edges, "s", "d", make([("h",)], "n string"), "n", 4)
    assert rows(reach) == [("h", 0), ("x", 1), ("y", 1), ("z", 1)]


def test_cyclic_core(make):
    assert rows(graph.cyclic_core(make([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("z", "a")], "p string, c string"), "p", "c")) == [("a",), ("b",), ("c",)]
    assert graph.cyclic_core(make([("a", "b"), ("b", "c"), ("a", "c")], "p string, c string"), "p", "c").isEmpty()


def test_vault(make):
    feed = make([(" c1", "2024-01-01", "CRM"), ("C1", "2024-01-05", "WEB"), ("c2", "2024-01-02", "WEB"), (None, "2024-01-02", "WEB")],
                "id string, at timestamp_ntz, src string")
    hub = vault.hub_load(None, feed, "id", "at", "src", "hk")
    assert rows(hub, "rec_src") == [("CRM",), ("WEB",)]
    assert vault.hub_load(hub, feed, "id", "at", "src", "hk").isEmpty()
    limits = make([("c1", "2024-01-01", 50), ("c1", "2024-01-03", 50), ("c1", "2024-01-20", 250)], "id string, at timestamp_ntz, lim int")
    first = vault.satellite_load(None, limits.filter("lim = 50"), "id", "at", ["lim"], F.lit("CRM"), "hk")
    assert first.count() == 1
    more = vault.satellite_load(first, limits, "id", "at", ["lim"], F.lit("CRM"), "hk")
    sat = first.unionByName(more.filter("lim = 250"))
    now, then = vault.satellite_latest(sat, "hk"), vault.satellite_latest(sat, "hk", F.lit("2024-01-10").cast("timestamp_ntz"))
    assert (now.first()["lim"], then.first()["lim"]) == (250, 50)
    link = vault.link_load(None, make([("c1", "a1", "2024-01-01", "S"), ("c9", "a1", "2024-01-01", "S")], "c string, a string, at timestamp_ntz, src string"),
                           {"hk": "c", "account_hk": "a"}, "at", "src", "link_hk")
    assert link.count() == 2 and vault.vault_orphans(link, {"hk": hub}).count() == 1


def test_satellite_reload_is_empty(make):
    limits = make([("c1", "2024-01-01", 50), ("c1", "2024-01-20", 250)], "id string, at timestamp_ntz, lim int")
    sat = vault.satellite_load(None, limits, "id", "at", ["lim"], F.lit("CRM"), "hk")
    same = vault.satellite_load(sat, limits.filter("lim = 250"), "id", "at", ["lim"], F.lit("CRM"), "hk")
    assert same.isEmpty()


def test_cosine(make):
    df = make([(1,)], "i int").select(
        cosine_similarity(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(4.0))).alias("same"),
        cosine_similarity(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(3.0))).alias("right"),
        cosine_similarity(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
    ).first()
    assert (round(df.same, 9), df.right, df.zero) == (1.0, 0.0, None)


def test_nearest_vectors_may_have_another_label(spark, make):
    vectors = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [1.0, 0.1]), (4, "b", None), (5, "b", [0.0, 0.0]), (6, "b", [2.0, 0.0])], "id long, label string, v array<double>")
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "label string, q array<double>")
    top = features.topk_nearest(vectors, asked, "label", "v", "q", "id", 3)
    assert rows(top, "label", "rank", "id") == [("a", 1, 1), ("a", 2, 6), ("a", 3, 3), ("b", 1, 2), ("b", 2, 3), ("b", 3, 1)]
    with pytest.raises(ValueError):
        features.topk_nearest(vectors, asked, "label", "v", "q", "id", 3, most=1)


def test_rolling_features_hot_equals_window(make):
    rnd = random.Random(5)
    data = [(rnd.choice(["hot", "hot", "hot", "b"]), f"2024-01-01 {rnd.randint(0, 3):02d}:{rnd.randint(0, 59):02d}:00", rnd.randint(1, 9)) for _ in range(200)]
    df = make(data, "k string, ts timestamp_ntz, v decimal(10,2)")
    args = ("k", "ts", F.col("v"), {"half": 1800, "hour": 3600})
    a, b = features.rolling_features(df, *args), features.rolling_features(df, *args, hot_rows=20)
    assert rows(a, *sorted(a.columns)) == rows(b, *sorted(a.columns))


def test_rolling_windows_without_values_are_null_in_both_ways(make):
    data = [("hot", f"2024-01-01 {h:02d}:00:00", None if h % 3 else h) for h in range(24)] + [("hot", "2024-01-01 12:00:00", None)]
    df = make(data, "k string, ts timestamp_ntz, v decimal(10,2)")
    args = ("k", "ts", F.col("v"), {"half": 1800, "long": 7200})
    a, b = features.rolling_features(df, *args), features.rolling_features(df, *args, hot_rows=5)
    got = rows(a, *sorted(a.columns))
    assert got == rows(b, *sorted(a.columns))
    assert a.where("half_sum is null and half_count = 0").count() == 16


def test_training_set_never_leaks(make):
    obs = make([(1, "c", "2024-01-10"), (2, "c", "2024-01-01")], "id int, k string, at timestamp_ntz")
    feats = make([("c", "2024-01-05", 0.45), ("c", "2024-01-12", 0.99)], "k string, ft timestamp_ntz, risk double")
    out = features.training_set(obs, feats, "k", "at", "ft", ["risk"])
    assert rows(out, "id", "risk", "leaks") == [(1, 0.45, False), (2, None, False)]
    assert tuple(features.feature_completeness(out, "matched_ft", ["risk"]).first()) == (2, 1, 1)


def strong_components(pairs):
    """Plain reachability in both directions."""
    nodes = {x for p in pairs for x in p}
    reach = {n: set() for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            at = todo.pop()
            new = {d for s, d in pairs if s == at} - reach[n]
            reach[n] |= new
            todo += new
    return sorted((n, min(m for m in nodes if m in reach[n] and n in reach[m])) for n in nodes if n in reach[n])


@pytest.mark.parametrize("seed, nodes, edges", [(1, 12, 14), (2, 30, 36), (3, 25, 70), (4, 40, 44)])
def test_components_equal_plain_reachability(spark, seed, nodes, edges):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)})
    frame = spark.createDataFrame([*pairs, *pairs[:5], (1, None), (None, 1)], "a long, b long")
    assert rows(graph.components(frame, "a", "b")) == sorted(strong_components(pairs), key=str)


def test_components_leave_out_what_lies_between_cycles(spark):
    pairs = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 9), (9, 8), (8, 9), (9, 20), (20, 21), (30, 1), (7, 7), (40, 39), (39, 38), (38, 40), (40, 9)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    assert rows(graph.components(frame, "a", "b")) == sorted([(1, 1), (2, 1), (8, 8), (9, 8), (7, 7), (38, 38), (39, 38), (40, 38)], key=str)
    assert rows(graph.components(frame.limit(0), "a", "b")) == []


def test_components_of_a_long_ring_take_few_rounds(spark, monkeypatch):
    ring = spark.createDataFrame([(i, (i + 1) % 24) for i in range(24)] + [(5, 30), (30, 31), (31, 30)], "a bigint, b bigint")
    stored, kept = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: stored.append(1) or kept(df))
    assert rows(graph.components(ring, "a", "b")) == sorted([(i, 0) for i in range(24)] + [(30, 30), (31, 30)], key=str)
    assert len(stored) < 24


def test_components_of_a_graph_that_fits_one_task_take_no_rounds(spark, monkeypatch):
    pairs = [(i, (i + 1) % 500) for i in range(500)] + [(i, i + 1) for i in range(499, 1500)] + [(2000, 1999), (1999, 2000), (1500, 2000), (3000, 3000)]
    frame = spark.createDataFrame(pairs, "a bigint, b bigint")
    stored, kept = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: stored.append(1) or kept(df) if len(stored) < 9 else pytest.fail("a step for each node of a path"))
    assert rows(graph.components(frame, "a", "b")) == sorted([(i, 0) for i in range(500)] + [(1999, 1999), (2000, 1999), (3000, 3000)], key=str)
    assert len(stored) <= 2


@pytest.mark.parametrize("limit", [0, 1_200, 1 << 20])
def test_components_are_the_same_by_rounds_and_in_one_task(spark, monkeypatch, limit):
    rng = random.Random(6)
    pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(85)} | {(70, 71), (71, 72), (72, 70), (72, 73), (73, 74), (74, 73), (3, 70)})
    monkeypatch.setattr(graph, "ONE_TASK", limit)
    expected = strong_components([(f"n{a}", f"n{b}") for a, b in pairs])
    frame = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in [*pairs, *pairs[:9]]] + [("n1", None)], "a string, b string")
    assert rows(graph.components(frame, "a", "b")) == sorted(expected, key=str)


def test_shortcuts_keep_what_reaches_what_and_stay_bounded(spark):
    star = [(i, 0) for i in range(1, 60)] + [(0, i) for i in range(1, 60)]
    links = spark.createDataFrame(star, "s bigint, d bigint")
    assert graph._shortened(links).count() == len(star)  # 59 * 59 paths over the hub are not enumerated
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "s bigint, d bigint")
    assert rows(graph._shortened(path)) == sorted([(i, j) for i in range(1, 5) for j in range(i + 1, 5)], key=str)
