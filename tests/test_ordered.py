"""The slice-parallel scan must equal the plain window for any split, with hot, NULL and single keys."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from terrace.operators.ordered import ordered_scan, split_hot, with_group_totals

DDL = "k string, t int, id int, v int"


def data(seed, n=400):
    rnd = random.Random(seed)
    keys = ["hot"] * 3 + ["a", "b", None, "c"]
    return [
        (rnd.choice(keys), rnd.randint(0, 60), i, rnd.choice([None, rnd.randint(-5, 5)])) for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_sliced_scan_equals_window(make, seed):
    df = make(data(seed), DDL)
    args = dict(lead={"nv": "v", "nid": "id"}, lag={"pv": "v", "pid": "id"}, carry={"known": "v"}, running={"total": "v"}, index="pos")
    plain = ordered_scan(df, ["k"], ["t", "id"], **args)
    sliced = ordered_scan(df, ["k"], ["t", "id"], hot_rows=20, **args)
    assert rows(plain, *sorted(plain.columns)) == rows(sliced, *sorted(plain.columns))
    assert rows(plain.filter("pos = 1").select("pid")) == [(None,)] * 5


def test_split_keeps_every_row(make):
    df = make(data(3), DDL)
    cold, hot, n = split_hot(df, ["k"], hot_rows=100)
    assert hot.count() == n and cold.count() + n == 400
    assert {r.k for r in hot.select("k").distinct().collect()} == {"hot"}


def test_group_totals_hot_equals_plain(make):
    df = make(data(4), DDL)
    totals = {"s": F.sum("v"), "top": F.max_by("id", F.struct("v", "id"))}
    a, b = with_group_totals(df, ["k"], totals), with_group_totals(df, ["k"], totals, hot_rows=30)
    assert rows(a) == rows(b)
