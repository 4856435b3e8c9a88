from conftest import rows
from pyspark.sql import functions as F

from terrace.functions.columns import ntz
from terrace.operators import dimensions as dim

LOG = "k string, at timestamp_ntz, v string"


def show(df):
    return rows(df, "k", "v", F.date_format("valid_from", "MM-dd"), F.date_format("valid_to", "yyyy-MM-dd"), "is_current", "version_number")


def test_scd2_collapses_unchanged_rows(make):
    log = make([("a", "2024-01-01", "x"), ("a", "2024-01-05", "x"), ("a", "2024-02-01", "y"), ("b", "2024-01-03", None)], LOG)
    want = [
        ("a", "x", "01-01", "2024-02-01", False, 1), ("a", "y", "02-01", "9999-12-31", True, 2), ("b", None, "01-03", "9999-12-31", True, 1),
    ]
    assert show(dim.scd2_build(log, "k", "at", ["v"])) == want
    assert show(dim.scd2_build(log, "k", "at", ["v"], hot_rows=2)) == want


def test_scd2_merge_closes_and_inserts_is_idempotent_and_takes_late_changes(make):
    base = dim.scd2_build(make([("a", "2024-01-01", "x"), ("b", "2024-01-01", "p")], LOG), "k", "at", ["v"])
    batch = make([("a", "2024-03-01", "y"), ("c", "2024-03-01", "n"), ("b", "2024-03-01", "p")], LOG)
    once = dim.scd2_merge(base, batch, "k", "at", ["v"])
    want = [
        ("a", "x", "01-01", "2024-03-01", False, 1), ("a", "y", "03-01", "9999-12-31", True, 2),
        ("b", "p", "01-01", "9999-12-31", True, 1), ("c", "n", "03-01", "9999-12-31", True, 1),
    ]
    assert show(once) == want
    assert show(dim.scd2_merge(once, batch, "k", "at", ["v"])) == want
    late = dim.scd2_merge(once, make([("a", "2024-02-01", "w")], LOG), "k", "at", ["v"])
    assert [r[1:4] for r in show(late) if r[0] == "a"] == [
        ("w", "02-01", "2024-03-01"), ("x", "01-01", "2024-02-01"), ("y", "03-01", "9999-12-31"),
    ]
    assert dim.current_view(late).count() == 3


def test_scd1(make):
    old, new = make([(1, "a"), (2, "b")], "k int, v string"), make([(2, "B"), (3, "C")], "k int, v string")
    assert rows(dim.scd1_upsert(old, new, "k")) == [(1, "a"), (2, "B"), (3, "C")]
    twice = new.unionByName(new)
    assert rows(dim.scd1_upsert(old, twice, "k")) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(dim.scd1_upsert(old, new, "k", overwrite=False)) == [(1, "a"), (2, "b"), (3, "C")]


def test_hybrid_and_ghosts(make):
    versions = dim.scd2_build(make([("a", "2024-01-01", "LOW"), ("a", "2024-02-01", "HIGH")], LOG), "k", "at", ["v"])
    hybrid = dim.scd6_hybrid(versions, "k", ["v"])
    assert rows(hybrid, "historical_v", "current_v") == [("HIGH", "HIGH"), ("LOW", "HIGH")]
    claims = make([(1, "a"), (2, "ghost"), (3, "ghost"), (4, None)], "id int, policy string")
    full = dim.inferred_members(hybrid, claims, "policy", "k", {"historical_v": "UNKNOWN", "version_number": 0})
    assert rows(full.filter("is_inferred"), "k", "historical_v", "version_number") == [("ghost", "UNKNOWN", 0)]
    assert full.count() == 3


def test_bitemporal_correction_splits_interval(make):
    log = make(
        [("p", "2024-01-01", "2024-01-01", 10), ("p", "2024-06-01", "2024-06-01", 12), ("p", "2024-03-01", "2024-07-01", 11)],
        "k string, valid timestamp_ntz, known timestamp_ntz, price int",
    )
    before = dim.bitemporal_splice(log, "k", "valid", "known", ntz("2024-06-15"), ["price"])
    after = dim.bitemporal_splice(log, "k", "valid", "known", ntz("2024-12-31"), ["price"])
    assert rows(before, "price") == [(10,), (12,)]
    assert rows(after, "price", F.date_format("valid_to", "yyyy-MM-dd")) == [(10, "2024-03-01"), (11, "2024-06-01"), (12, "9999-12-31")]
    seen = lambda known: dim.bitemporal_asof(log, "k", "valid", "known", ntz("2024-04-01"), ntz(known), ["price"]).first()["price"]
    assert (seen("2024-06-15"), seen("2024-08-01")) == (10, 11)


def test_closure_of_a_chain_and_rollup(make):
    chain = dim.closure_table(make([(1, 2), (2, 3)], "p int, c int"), "p", "c")
    assert rows(chain, "ancestor", "descendant", "depth_level", "is_leaf") == [
        (1, 1, 0, False), (1, 2, 1, False), (1, 3, 2, True), (2, 2, 0, False), (2, 3, 1, True), (3, 3, 0, True),
    ]
    costs = make([(1, 5), (2, 7), (3, 9)], "n int, cost int")
    assert rows(dim.hierarchy_rollup(chain, costs, "n", "cost", "total"), "ancestor", "total") == [(1, 21), (2, 16), (3, 9)]


def test_closure_of_a_diamond_and_of_cycles(make):
    diamond = make([(1, 2), (1, 3), (2, 4), (3, 4), (1, 4), (1, 2), (None, 1)], "p int, c int")
    closure = dim.closure_table(diamond, "p", "c")
    assert rows(closure.filter("descendant = 4"), "ancestor", "depth_level") == [(1, 1), (2, 1), (3, 1), (4, 0)]
    assert closure.count() == closure.select("ancestor", "descendant").distinct().count() == 9
    assert rows(dim.hierarchy_rollup(closure, make([(2, 5), (4, 9)], "n int, cost int"), "n", "cost", "total").filter("ancestor = 1"), "total") == [(14,)]
    assert dim.cycle_members(closure, diamond, "p", "c").isEmpty()
    ring = make([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6)], "p int, c int")
    closed = dim.closure_table(ring, "p", "c")
    assert rows(closed.filter("ancestor = 1"), "descendant", "depth_level") == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert rows(dim.cycle_members(closed, ring, "p", "c")) == [(1,), (2,), (3,), (6,)]


def test_long_chain_closure(make):
    n = 21
    chain = dim.closure_table(make([(i, i + 1) for i in range(n)], "p int, c int"), "p", "c")
    assert chain.count() == (n + 1) * (n + 2) // 2
    assert chain.filter("ancestor = 0 and descendant = 21").first()["depth_level"] == 21


def test_junk_and_bands(make):
    f = make([(1, "CARD", "Y"), (2, "CARD", "Y"), (3, "CASH", None)], "id int, pay string, gift string")
    junk = dim.junk_dimension(f, ["pay", "gift"])
    keyed = dim.rekey_junk(f, ["pay", "gift"])
    assert junk.count() == 2 and keyed.join(junk, "junk_sk").count() == 3
    people, mini = dim.mini_dimension(make([(1, 5), (2, 50), (3, 500), (4, None)], "id int, score int"),
                                      {"band": ("score", [10, 100], ["LOW", "MID", "TOP"])})
    assert rows(people, "id", "band") == [(1, "LOW"), (2, "MID"), (3, "TOP"), (4, None)] and mini.count() == 4
