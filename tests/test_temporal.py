import random

import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from terrace.operators import dimensions as dim
from terrace.operators.temporal import asof_join, pit_join


def ts(minute):
    return str(pd.Timestamp("2024-05-01") + pd.Timedelta(minutes=minute))


def test_asof_join_equals_merge_asof(make):
    rnd = random.Random(7)
    left = [(i, rnd.choice("xxxyz"), ts(rnd.randint(0, 500))) for i in range(200)]
    times = {(rnd.choice("xxxyw"), rnd.randint(0, 500)) for _ in range(150)}
    right = [(k, ts(m), f"{k}{m}") for k, m in times]
    l, r = make(left, "id int, k string, lt timestamp_ntz"), make(right, "k string, rt timestamp_ntz, f string")
    lp = pd.DataFrame(left, columns=["id", "k", "lt"]).assign(lt=lambda d: pd.to_datetime(d["lt"])).sort_values("lt")
    rp = pd.DataFrame(right, columns=["k", "rt", "f"]).assign(rt=lambda d: pd.to_datetime(d["rt"])).sort_values("rt")
    want = {i: (None if pd.isna(f) else f) for i, f in pd.merge_asof(lp, rp, left_on="lt", right_on="rt", by="k")[["id", "f"]].values}
    for hot in (10_000, 15):
        got = {i: f for i, f in rows(asof_join(l, r, "k", "lt", "rt", ["f"], hot_rows=hot), "id", "f")}
        assert got == want
    inner = asof_join(l, r, "k", "lt", "rt", ["f"], how="inner")
    assert inner.count() == sum(f is not None for f in want.values())


def test_asof_ignores_null_keys(make):
    l = make([(1, None, ts(5)), (2, "x", None)], "id int, k string, lt timestamp_ntz")
    r = make([(None, ts(1), "n"), ("x", ts(1), "x")], "k string, rt timestamp_ntz, f string")
    assert rows(asof_join(l, r, "k", "lt", "rt", ["f"]), "id", "f") == [(1, None), (2, None)]


def test_point_in_time_binds_to_the_past(make):
    log = make([("c1", "2024-01-01", "Lyon"), ("c1", "2024-06-01", "Oslo")], "cust string, at timestamp_ntz, city string")
    members = dim.scd2_build(log, "cust", "at", ["city"])
    facts = make([(1, "c1", "2024-03-15 14:30:00"), (2, "c1", "2024-06-01"), (3, "c1", "2023-12-31"), (4, "zz", "2024-03-01")],
                 "id int, c string, at timestamp_ntz")
    want = [(1, "Lyon"), (2, "Oslo"), (3, None), (4, None)]
    assert rows(pit_join(facts, "c", "at", members, "cust", ["city"]), "id", "city") == want
    # The as-of path, chosen when members have many versions, gives the same binding and the same columns.
    scan = pit_join(facts, "c", "at", members, "cust", ["city"], few_versions=0, hot_rows=2)
    assert rows(scan, "id", "city") == want
    assert scan.columns == ["id", "c", "at", "valid_from", "valid_to", "city"]


def test_pit_join_gives_one_row_whatever_the_versions_overlap(make):
    members = make(
        [("c", "2024-01-01", "2024-06-01", 1), ("c", "2024-02-01", "2024-03-01", 2), ("c", "2024-02-01", "2024-04-01", None),
         ("c", "2024-05-01", None, 4), (None, "2024-01-01", "2024-06-01", 5)],
        "k string, valid_from timestamp_ntz, valid_to timestamp_ntz, v int",
    )
    facts = make([(1, "c", "2024-01-10"), (2, "c", "2024-02-10"), (3, "c", "2024-04-10"), (4, "c", "2024-05-10"), (5, None, "2024-02-01"),
                  (6, "c", None)], "id int, fk string, at timestamp_ntz")
    equi, scan = (pit_join(facts, "fk", "at", members, "k", ["v"], few_versions=few) for few in (64, 0))
    assert equi.columns == scan.columns == ["id", "fk", "at", "valid_from", "valid_to", "v"]
    assert rows(equi) == rows(scan)
    assert rows(equi, "id", F.month("valid_to"), "v") == [(1, 6, 1), (2, 4, None), (3, None, None), (4, None, None), (5, None, None), (6, None, None)]


def test_pit_join_respects_gaps(make):
    members = make([("c", "2024-01-01", "2024-02-01", 1), ("c", "2024-03-01", "9999-12-31 23:59:59", 2)],
                   "k string, valid_from timestamp_ntz, valid_to timestamp_ntz, v int")
    facts = make([(1, "c", "2024-02-10")], "id int, fk string, at timestamp_ntz")
    for few in (64, 0):
        assert rows(pit_join(facts, "fk", "at", members, "k", ["v"], few_versions=few), "id", "v", "valid_to") == [(1, None, None)]
    assert facts.filter(F.col("at").isNull()).count() == 0
