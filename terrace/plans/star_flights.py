"""The 13 star-schema benchmark flights on a line-order star derived from the given tables.

Literals are fitted to the data (order years 1995-2001, nations NATION_0..24); brand groups of five form
a manufacturer, a brand is the category and brand with type is the finest level; supply cost stands in as
60 % of the retail price times quantity because the tables hold no cost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from terrace.functions.columns import date_key, money, net_amount
from terrace.operators.star import Flight, Star, run_flight
from terrace.plans.registry import Tables, query
from terrace.sources.generators import date_dimension

STAR_SQL = """WITH lo AS (SELECT o_custkey, l_partkey, l_suppkey, CAST(year(o_orderdate) AS INTEGER) AS d_year,
    CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS d_yearmonthnum, CAST(weekofyear(o_orderdate) AS INTEGER) AS d_weeknum,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(round(l_discount * 100) AS INTEGER) AS disc, l_quantity AS qty,
    CAST(l_extendedprice AS DECIMAL(18,2)) * (1::DECIMAL(5,2) - CAST(l_discount AS DECIMAL(5,2))) AS revenue,
    CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(9,2)) * CAST(0.6 AS DECIMAL(2,1)) AS cost,
    cn.n_name AS c_nation, cr.r_name AS c_region, cn.n_name || ' ' || right(c_name, 1) AS c_city,
    sn.n_name AS s_nation, sr.r_name AS s_region, sn.n_name || ' ' || right(s_name, 1) AS s_city,
    'MFGR#' || ((CAST(substr(p_brand, 7) AS INTEGER) - 1) // 5 + 1) AS p_mfgr, p_brand AS p_category, p_brand || ' ' || p_type AS p_brand1
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN part ON p_partkey = l_partkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN region cr ON cr.r_regionkey = cn.n_regionkey
  JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN region sr ON sr.r_regionkey = sn.n_regionkey) """


def line_order_star(t: Tables) -> Star:
    lines = t.lineitem.join(
        t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    fact = lines.select(
        F.col("o_custkey").alias("lo_custkey"), F.col("l_partkey").alias("lo_partkey"),
        F.col("l_suppkey").alias("lo_suppkey"), date_key("o_orderdate").alias("lo_orderdate"),
        F.col("l_quantity").alias("lo_quantity"), money("l_extendedprice").alias("lo_extendedprice"),
        F.round(F.col("l_discount") * 100).cast("int").alias("lo_discount"), net_amount().alias("lo_revenue"),
    )
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    digit = lambda name: F.concat("n_name", F.lit(" "), F.right(name, F.lit(1)))
    customers = t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_name").alias("c_nation"), F.col("r_name").alias("c_region"), digit("c_name").alias("c_city")
    )
    suppliers = t.supplier.join(geo, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("n_name").alias("s_nation"), F.col("r_name").alias("s_region"), digit("s_name").alias("s_city")
    )
    brand_no = F.substring("p_brand", 7, 4).cast("int")
    parts = t.part.select(
        "p_partkey",
        F.concat(F.lit("MFGR#"), F.floor((brand_no - 1) / 5).cast("int") + 1).alias("p_mfgr"),
        F.col("p_brand").alias("p_category"),
        F.concat("p_brand", F.lit(" "), "p_type").alias("p_brand1"),
        (money("p_retailprice") * F.lit("0.6").cast("decimal(2,1)")).alias("p_unit_cost"),
    )
    dates = date_dimension(t.orders, "o_orderdate").select(
        "date_sk", F.col("calendar_year").alias("d_year"), F.col("yearmonth_num").alias("d_yearmonthnum"),
        F.col("week_of_year").alias("d_weeknum"),
    )
    return Star(
        fact,
        {
            "date": (dates, "lo_orderdate", "date_sk"),
            "customer": (customers, "lo_custkey", "c_custkey"),
            "supplier": (suppliers, "lo_suppkey", "s_suppkey"),
            "part": (parts, "lo_partkey", "p_partkey"),
        },
    )


C = F.col


def saved():
    return C("lo_extendedprice") * C("lo_discount")


def profit():
    return C("lo_revenue") - C("p_unit_cost") * C("lo_quantity").cast("decimal(9,2)")


def year_then_revenue():
    return [F.asc("d_year"), F.desc("revenue")]


def years():
    return C("d_year").between(1996, 1999)


FLIGHTS: dict[str, tuple[Callable[[], Flight], list[str], str]] = {
    "q1_1": (
        lambda: Flight(saved(), "revenue", {"date": C("d_year") == 1997, "fact": C("lo_discount").between(1, 3) & (C("lo_quantity") < 25)}),
        ["date"], "SELECT CAST(sum(price * disc) AS DOUBLE) AS revenue FROM lo WHERE d_year = 1997 AND disc BETWEEN 1 AND 3 AND qty < 25",
    ),
    "q1_2": (
        lambda: Flight(saved(), "revenue", {"date": C("d_yearmonthnum") == 199801,
               "fact": C("lo_discount").between(4, 6) & C("lo_quantity").between(26, 35)}),
        ["date"], """SELECT CAST(sum(price * disc) AS DOUBLE) AS revenue FROM lo WHERE d_yearmonthnum = 199801
                     AND disc BETWEEN 4 AND 6 AND qty BETWEEN 26 AND 35""",
    ),
    "q1_3": (
        lambda: Flight(saved(), "revenue", {"date": (C("d_weeknum") == 6) & (C("d_year") == 1998),
               "fact": C("lo_discount").between(5, 7) & C("lo_quantity").between(26, 35)}),
        ["date"], """SELECT CAST(sum(price * disc) AS DOUBLE) AS revenue FROM lo WHERE d_weeknum = 6 AND d_year = 1998
                     AND disc BETWEEN 5 AND 7 AND qty BETWEEN 26 AND 35""",
    ),
    "q2_1": (
        lambda: Flight(C("lo_revenue"), "revenue", {"part": C("p_category") == "Brand#12", "supplier": C("s_region") == "AMERICA"},
               ["d_year", "p_brand1"], ["d_year", "p_brand1"]),
        ["part", "supplier", "date"], """SELECT d_year, p_brand1, CAST(sum(revenue) AS DOUBLE) AS revenue FROM lo
            WHERE p_category = 'Brand#12' AND s_region = 'AMERICA' GROUP BY 1, 2""",
    ),
    "q2_2": (
        lambda: Flight(C("lo_revenue"), "revenue", {"part": C("p_brand1").between("Brand#21 A", "Brand#23 Z"), "supplier": C("s_region") == "ASIA"},
               ["d_year", "p_brand1"], ["d_year", "p_brand1"]),
        ["part", "supplier", "date"], """SELECT d_year, p_brand1, CAST(sum(revenue) AS DOUBLE) AS revenue FROM lo
            WHERE p_brand1 BETWEEN 'Brand#21 A' AND 'Brand#23 Z' AND s_region = 'ASIA' GROUP BY 1, 2""",
    ),
    "q2_3": (
        lambda: Flight(C("lo_revenue"), "revenue", {"part": C("p_brand1") == "Brand#22 PROMO", "supplier": C("s_region") == "EUROPE"},
               ["d_year", "p_brand1"], ["d_year", "p_brand1"]),
        ["part", "supplier", "date"], """SELECT d_year, p_brand1, CAST(sum(revenue) AS DOUBLE) AS revenue FROM lo
            WHERE p_brand1 = 'Brand#22 PROMO' AND s_region = 'EUROPE' GROUP BY 1, 2""",
    ),
    "q3_1": (
        lambda: Flight(C("lo_revenue"), "revenue", {"customer": C("c_region") == "ASIA", "supplier": C("s_region") == "ASIA", "date": years()},
               ["c_nation", "s_nation", "d_year"], year_then_revenue()),
        ["customer", "supplier", "date"], """SELECT c_nation, s_nation, d_year, CAST(sum(revenue) AS DOUBLE) AS revenue FROM lo
            WHERE c_region = 'ASIA' AND s_region = 'ASIA' AND d_year BETWEEN 1996 AND 1999 GROUP BY 1, 2, 3""",
    ),
    "q3_2": (
        lambda: Flight(C("lo_revenue"), "revenue", {"customer": C("c_nation") == "NATION_6", "supplier": C("s_nation") == "NATION_6", "date": years()},
               ["c_city", "s_city", "d_year"], year_then_revenue()),
        ["customer", "supplier", "date"], """SELECT c_city, s_city, d_year, CAST(sum(revenue) AS DOUBLE) AS revenue FROM lo
            WHERE c_nation = 'NATION_6' AND s_nation = 'NATION_6' AND d_year BETWEEN 1996 AND 1999 GROUP BY 1, 2, 3""",
    ),
    "q3_3": (
        lambda: Flight(C("lo_revenue"), "revenue", {"customer": C("c_city").isin("NATION_6 1", "NATION_6 5"),
               "supplier": C("s_nation").isin("NATION_6", "NATION_1"), "date": years()}, ["c_city", "s_city", "d_year"], year_then_revenue()),
        ["customer", "supplier", "date"], """SELECT c_city, s_city, d_year, CAST(sum(revenue) AS DOUBLE) AS revenue FROM lo
            WHERE c_city IN ('NATION_6 1', 'NATION_6 5') AND s_nation IN ('NATION_6', 'NATION_1')
              AND d_year BETWEEN 1996 AND 1999 GROUP BY 1, 2, 3""",
    ),
    "q3_4": (
        lambda: Flight(C("lo_revenue"), "revenue", {"customer": C("c_nation").isin("NATION_6", "NATION_1"),
               "supplier": C("s_nation").isin("NATION_6", "NATION_1"), "date": C("d_yearmonthnum") == 199712},
               ["c_city", "s_city", "d_year"], year_then_revenue()),
        ["customer", "supplier", "date"], """SELECT c_city, s_city, d_year, CAST(sum(revenue) AS DOUBLE) AS revenue FROM lo
            WHERE c_nation IN ('NATION_6', 'NATION_1') AND s_nation IN ('NATION_6', 'NATION_1') AND d_yearmonthnum = 199712 GROUP BY 1, 2, 3""",
    ),
    "q4_1": (
        lambda: Flight(profit(), "profit", {"customer": C("c_region") == "AMERICA", "supplier": C("s_region") == "AMERICA",
               "part": C("p_mfgr").isin("MFGR#1", "MFGR#2")}, ["d_year", "c_nation"], ["d_year", "c_nation"], ["p_unit_cost"]),
        ["customer", "supplier", "part", "date"], """SELECT d_year, c_nation, CAST(sum(revenue - cost) AS DOUBLE) AS profit FROM lo
            WHERE c_region = 'AMERICA' AND s_region = 'AMERICA' AND p_mfgr IN ('MFGR#1', 'MFGR#2') GROUP BY 1, 2""",
    ),
    "q4_2": (
        lambda: Flight(profit(), "profit", {"customer": C("c_region") == "AMERICA", "supplier": C("s_region") == "AMERICA",
               "part": C("p_mfgr").isin("MFGR#1", "MFGR#2"), "date": C("d_year").isin(1997, 1998)},
               ["d_year", "s_nation", "p_category"], ["d_year", "s_nation", "p_category"], ["p_unit_cost"]),
        ["customer", "supplier", "part", "date"], """SELECT d_year, s_nation, p_category, CAST(sum(revenue - cost) AS DOUBLE) AS profit FROM lo
            WHERE c_region = 'AMERICA' AND s_region = 'AMERICA' AND p_mfgr IN ('MFGR#1', 'MFGR#2') AND d_year IN (1997, 1998) GROUP BY 1, 2, 3""",
    ),
    "q4_3": (
        lambda: Flight(profit(), "profit", {"customer": C("c_region") == "AMERICA", "supplier": C("s_nation") == "NATION_6",
               "part": C("p_mfgr") == "MFGR#3", "date": C("d_year").isin(1997, 1998)},
               ["d_year", "s_city", "p_brand1"], ["d_year", "s_city", "p_brand1"], ["p_unit_cost"]),
        ["customer", "supplier", "part", "date"], """SELECT d_year, s_city, p_brand1, CAST(sum(revenue - cost) AS DOUBLE) AS profit FROM lo
            WHERE c_region = 'AMERICA' AND s_nation = 'NATION_6' AND p_mfgr = 'MFGR#3' AND d_year IN (1997, 1998) GROUP BY 1, 2, 3""",
    ),
}


def _register() -> None:
    for name, (flight, dims, sql) in FLIGHTS.items():
        query(f"ssb_{name}", STAR_SQL + sql)(lambda t, f=flight, d=dims: run_flight(line_order_star(t), f(), d))


_register()
