"""Generated brokerage feeds for the three-batch integration, from integer ranges and a scale factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions.columns import ntz
from terrace.operators.integration import FEEDS
from terrace.session import small_table
from terrace.sources.generators import gen_sequence

# fixed values: rows per feed and batch at scale 1, and the batch dates
BATCH_1 = {"company": 50, "security": 50, "broker": 20, "customer": 100, "account": 200, "trade": 1000, "holding": 500,
           "cash": 600, "market": 500, "watch": 100, "prospect": 50}
BATCH_2 = {"changed": 20, "joined": 15, "account": 30, "trade": 500, "cash": 200, "holding": 100, "market": 100}
BATCH_3 = {"trade": 100}
DATES = {1: "2026-01-01", 2: "2026-01-15", 3: "2026-01-10"}
# fixed values: amounts of one trade, holding and cash record per batch
TRADE = {1: (50, 100, 100, 5, 10, 2.5), 2: (75, 50, 200, 5, 15, 3.75), 3: (100, 1, 50, 5, 10, 2.5)}
CASH = {1: 25000, 2: 32000}
SHARES = {1: 100, 2: 200}


def _feed(spark: SparkSession, name: str, start: int, n: int, columns: dict[str, Column]) -> DataFrame:
    schema = T.StructType.fromDDL(FEEDS[name])
    typed = {f.name: columns.get(f.name, F.lit(None)).cast(f.dataType) for f in schema}
    return gen_sequence(spark, start, start + n, typed)


def _cycle(n: int) -> Column:
    """1..n again and again over the ids 1, 2, 3, ..."""
    return (F.col("id") - 1) % n + 1


def brokerage_batch(spark: SparkSession, batch: int, scale: int = 1) -> dict[str, DataFrame]:
    i, day = F.col("id"), ntz(DATES[batch])
    n = {k: v * scale for k, v in {1: BATCH_1, 2: BATCH_2, 3: BATCH_3}[batch].items()}
    people, accounts, papers, agents = (BATCH_1[k] * scale for k in ("customer", "account", "security", "broker"))
    base, spread, shares, fee, commission, tax = TRADE[batch]
    first = {1: 0, 2: BATCH_1["trade"], 3: BATCH_1["trade"] + BATCH_2["trade"]}[batch] * scale
    active = {1: people, 2: BATCH_2["changed"] * scale, 3: 1}[batch]

    def trades(count: int) -> DataFrame:
        k = i - first
        nth = lambda m: (k - 1) % m + 1
        return _feed(spark, "trade", first + 1, count, {
            "trade_id": i, "broker_id": nth(agents if batch < 3 else 1), "customer_id": nth(active),
            "account_id": nth(accounts if batch < 3 else 1), "security_id": nth(papers if batch < 3 else 1),
            "traded_at": day + F.expr("interval 12 hours"), "price": base + k % spread, "quantity": F.lit(shares),
            "fee": F.lit(fee), "commission": F.lit(commission), "tax": F.lit(tax),
        })

    out = {"trade": trades(n["trade"])}
    if batch == 3:
        return out

    def holdings(count: int) -> DataFrame:
        k = i - first
        return _feed(spark, "holding", first + 1, count, {
            "trade_id": i, "customer_id": (k - 1) % active + 1, "account_id": (k - 1) % accounts + 1,
            "security_id": (k - 1) % papers + 1, "held_at": day, "price": F.lit(base), "quantity": F.lit(SHARES[batch]),
        })

    out["holding"] = holdings(n["holding"])
    out["cash"] = _feed(spark, "cash", 1, n["cash"], {
        "customer_id": _cycle(people), "account_id": _cycle(accounts), "balance_at": day, "cash": F.lit(CASH[batch]),
    })
    out["market"] = _feed(spark, "market", 1, n["market"], {
        "security_id": _cycle(papers), "date_key": F.lit(int(DATES[batch].replace("-", ""))), "close": F.lit(150),
        "high": F.lit(155), "low": F.lit(148), "volume": F.lit(100000),
    })
    if batch == 1:
        person = {"customer_id": i, "last_name": F.concat(F.lit("Person"), i), "tier": F.lit("1"), "city": F.lit("Seattle"), "effective_at": day}
        out["customer"] = _feed(spark, "customer", 1, people, person)
        out["account"] = _feed(spark, "account", 1, accounts, {
            "account_id": i, "customer_id": _cycle(people), "description": F.concat(F.lit("Account "), i), "effective_at": day,
        })
        out["company"] = _feed(spark, "company", 1, n["company"], {
            "company_id": i, "company_name": F.concat(F.lit("Company "), i), "industry": F.lit("Technology"), "effective_at": day,
        })
        out["security"] = _feed(spark, "security", 1, papers, {
            "security_id": i, "symbol": F.concat(F.lit("SYM"), i), "issue_type": F.lit("COMMON"), "company_id": i, "effective_at": day,
        })
        out["broker"] = _feed(spark, "broker", 1, agents, {"broker_id": i, "broker_name": F.concat(F.lit("Broker "), i)})
        out["watch"] = _feed(spark, "watch", 1, n["watch"], {"customer_id": i, "security_id": _cycle(papers), "placed_at": day})
        out["prospect"] = _feed(spark, "prospect", 1, n["prospect"], {
            "agency_id": i, "last_name": F.concat(F.lit("Prospect"), i), "net_worth": F.lit(500000),
        })
        return out
    moved = {"customer_id": i, "last_name": F.concat(F.lit("Person"), i), "tier": F.lit("2"), "city": F.lit("New York"), "effective_at": day}
    joined = {**moved, "tier": F.lit("1"), "city": F.lit("Chicago")}
    out["customer"] = _feed(spark, "customer", 1, n["changed"], moved).unionByName(
        _feed(spark, "customer", people + 1, n["joined"], joined)
    )
    new_accounts = _feed(spark, "account", accounts + 1, n["account"], {
        "account_id": i, "customer_id": people + (i - accounts - 1) % n["joined"] + 1,
        "description": F.concat(F.lit("Account "), i), "effective_at": day,
    })
    # One dirty record of each kind: an account without a customer and a trade with a negative price.
    dirty_account = _feed(spark, "account", 999992, 1, {"account_id": i, "customer_id": F.lit(-1), "effective_at": day})
    dirty_trade = _feed(spark, "trade", 999991, 1, {
        "trade_id": i, "broker_id": F.lit(1), "customer_id": F.lit(1), "account_id": F.lit(1), "security_id": F.lit(1),
        "traded_at": day, "price": F.lit(-100), "quantity": F.lit(1), "fee": F.lit(0), "commission": F.lit(0), "tax": F.lit(0),
    })
    out["account"] = new_accounts.unionByName(dirty_account)
    out["trade"] = out["trade"].unionByName(dirty_trade)
    return out


def expected_audits(spark: SparkSession, scale: int = 1) -> DataFrame:
    """Control totals the generated feeds must lead to after all three batches."""
    b1, b2, b3 = BATCH_1, BATCH_2, BATCH_3
    volume = sum(TRADE[1][0] + k % TRADE[1][1] for k in range(1, b1["trade"] * scale + 1)) * TRADE[1][2]
    volume += sum(TRADE[2][0] + k % TRADE[2][1] for k in range(1, b2["trade"] * scale + 1)) * TRADE[2][2]
    volume += b3["trade"] * scale * TRADE[3][0] * TRADE[3][2]
    count = {
        1: b1["customer"] + b2["changed"] + b2["joined"], 2: b1["account"] + b2["account"], 3: b1["security"], 4: b1["company"],
        5: b1["broker"], 6: b1["trade"] + b2["trade"] + b3["trade"], 7: b1["holding"] + b2["holding"], 8: b1["cash"] + b2["cash"],
        9: b1["market"] + b2["market"], 10: b1["watch"], 11: b1["prospect"], 25: b2["changed"],
    }
    money = {
        13: b1["trade"] * 10 + b2["trade"] * 15 + b3["trade"] * 10, 14: (b1["trade"] + b2["trade"] + b3["trade"]) * 5,
        15: b1["holding"] * SHARES[1] + b2["holding"] * SHARES[2], 16: b1["cash"] * CASH[1], 17: b2["cash"] * CASH[2],
        18: b1["cash"] * CASH[1] + b2["cash"] * CASH[2],
    }
    rows = [(k, float(v * scale)) for k, v in (count | money).items()] + [(12, float(volume)), (44, 3.0), (45, 2.0)]
    return small_table(spark, rows, "audit_id int, expected double")
