"""Three-batch brokerage integration: one loader for historical, incremental and late batches, 46 audits.

A batch is a dict of feeds; the warehouse is a dict of tables. `load_batch` returns the next state and never
changes the old one; every new piece is stored in the shared folder, so later steps re-read files instead of
recomputing the batch. Facts resolve the customer version by the time of the event, so late facts need no
special path.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.columns import all_of, dbl, md5_key, n_rows, sentinel
from terrace.operators import dimensions as dim
from terrace.operators.ordered import largest_group, ordered_scan
from terrace.operators.silver import message_rows, tag_rejects
from terrace.operators.temporal import pit_join
from terrace.session import small_table, written

State = dict[str, DataFrame]

CUSTOMER_ATTRS = ["last_name", "tier", "city"]

FEEDS = {
    "company": "company_id bigint, company_name string, industry string, effective_at timestamp_ntz",
    "security": "security_id bigint, symbol string, issue_type string, company_id bigint, effective_at timestamp_ntz",
    "broker": "broker_id bigint, broker_name string",
    "customer": "customer_id bigint, last_name string, tier string, city string, effective_at timestamp_ntz",
    "account": "account_id string, customer_id bigint, description string, effective_at timestamp_ntz",
    "trade": "trade_id bigint, broker_id bigint, customer_id bigint, account_id string, security_id bigint, "
    "traded_at timestamp_ntz, price decimal(18,2), quantity decimal(18,2), fee decimal(18,4), "
    "commission decimal(18,4), tax decimal(18,4)",
    "holding": "trade_id bigint, customer_id bigint, account_id string, security_id bigint, held_at timestamp_ntz, "
    "price decimal(18,2), quantity decimal(18,2)",
    "cash": "customer_id bigint, account_id string, balance_at timestamp_ntz, cash decimal(28,2)",
    "market": "security_id bigint, date_key int, close decimal(18,2), high decimal(18,2), low decimal(18,2), "
    "volume decimal(28,2)",
    "watch": "customer_id bigint, security_id bigint, placed_at timestamp_ntz",
    "prospect": "agency_id string, last_name string, net_worth decimal(18,2)",
}

def trade_rules():
    return {"price > 0": F.col("price") > 0, "quantity > 0": F.col("quantity") > 0}


def open_versions(df: DataFrame, key: str) -> DataFrame:
    """First and only version of each member, open until the sentinel."""
    rest = [c for c in df.columns if c not in (key, "effective_at", "batch_id")]
    return df.select(
        md5_key(key, F.date_format("effective_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("version_sk"), key, *rest,
        F.col("effective_at").alias("valid_from"), sentinel().alias("valid_to"), F.lit(True).alias("is_current"), "batch_id",
    )


def _append(state: State, name: str, rows: DataFrame) -> DataFrame:
    piece = written(rows, name)
    return state[name].unionByName(piece) if name in state else piece


def _unseen(state: State, name: str, rows: DataFrame, key: list[str], batch_id: int) -> DataFrame:
    """The rows that the table does not hold yet, so that a batch loaded again adds nothing. NULLs are equal. `key` has the batch,
    so only a batch that the table has rows of is joined at all."""
    if name not in state:
        return rows
    same = state[name].filter(F.col("batch_id") == batch_id)
    if same.isEmpty():
        return rows
    kept = same.select(*[F.col(k).alias(f"_seen_{k}") for k in key])
    return rows.join(kept, all_of([F.col(k).eqNullSafe(F.col(f"_seen_{k}")) for k in key]), "left_anti")


def _add(state: State, name: str, rows: DataFrame) -> DataFrame:
    """`rows` come from a stored feed by filters and expressions alone, so they are not stored a second time."""
    return state[name].unionByName(rows) if name in state else rows


def _bind_customer(rows: DataFrame, ts: str, customers: DataFrame, most: int) -> DataFrame:
    """The start of the version (NULL without one) stands for its long hash key in shuffles and stored feeds."""
    bound = pit_join(rows, "customer_id", ts, customers, "customer_id", [], most=most)
    return bound.withColumnRenamed("valid_from", "_version_from").drop("valid_to")


def _keyed(bound: DataFrame) -> DataFrame:
    """The customer version's key as `scd2_build` makes it, in place of customer and start."""
    stamp = F.date_format("_version_from", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return bound.withColumn("sk_customer_id", md5_key("customer_id", stamp)).drop("customer_id", "_version_from")


def load_batch(
    state: State, feeds: Mapping[str, DataFrame], batch_id: int, rules: Mapping[str, Column] | None = None
) -> State:
    """Next warehouse state. Feeds that a batch lacks leave their table as it is. Every row of a feed of facts is
    either in its fact or in the messages, and a batch loaded again leaves all tables as they are. Holdings, cash,
    watches and market days of a later batch are further rows; a trade that an earlier batch brought is rejected."""
    rules = trade_rules() if rules is None else rules
    out = dict(state)
    stamped = {n: df.withColumn("batch_id", F.lit(batch_id)) for n, df in feeds.items()}
    messages = []

    if "customer" in feeds:
        log = feeds["customer"]
        if "dim_customer" in state:
            merged = dim.scd2_merge(state["dim_customer"], log, "customer_id", "effective_at", CUSTOMER_ATTRS)
        else:
            merged = dim.scd2_build(log, "customer_id", "effective_at", CUSTOMER_ATTRS)
        out["dim_customer"] = written(merged, "dim_customer")
    customers = out["dim_customer"]
    most = largest_group(customers, ["customer_id"])

    for name, key in (("company", "company_id"), ("security", "security_id")):
        if name in feeds:
            fresh = stamped[name]
            if f"dim_{name}" in state:
                fresh = fresh.join(state[f"dim_{name}"].select(key), key, "left_anti")
            out[f"dim_{name}"] = _append(state, f"dim_{name}", open_versions(fresh, key))
    for name, key in (("broker", "broker_id"), ("prospect", "agency_id")):
        if name in feeds:
            table = f"dim_{name}" if name == "broker" else name
            fresh = stamped[name]
            if table in state:
                fresh = fresh.join(state[table].select(key), key, "left_anti")
            out[table] = _append(state, table, fresh)

    if "account" in feeds:
        fresh = stamped["account"]
        if "dim_account" in state:
            fresh = fresh.join(state["dim_account"].select("account_id"), "account_id", "left_anti")
        bound = written(_bind_customer(fresh, "effective_at", customers, most), "account_feed")
        orphan = F.col("_version_from").isNull()
        out["dim_account"] = _add(state, "dim_account", open_versions(_keyed(bound.filter(~orphan)), "account_id"))
        messages.append(
            message_rows(
                bound.filter(orphan), batch_id, "TransformAccount", F.lit("ORPHAN: customer"), "REJECT",
                F.concat(F.lit("account_id="), F.coalesce("account_id", F.lit("null"))),
            )
        )
    accounts = out["dim_account"].select("account_id", F.lit(True).alias("_known"))

    if "trade" in feeds:
        tagged = tag_rejects(stamped["trade"], rules).join(accounts, "account_id", "left")
        bound = _bind_customer(tagged, "traded_at", customers, most)
        reason = F.coalesce(
            F.col("reject_reason"),
            F.when(F.col("_known").isNull(), "ORPHAN: account"),
            F.when(F.col("_version_from").isNull(), "ORPHAN: customer version"),
        )
        seen = F.lit(False)
        if "fact_trade" in state:
            # a trade of this batch is one loaded again, that of another batch is refused; found by keys alone, as there are few
            both = state["fact_trade"].select("trade_id", "batch_id").join(stamped["trade"].select("trade_id"), "trade_id", "left_semi")
            known = both.groupBy("trade_id").agg(F.min("batch_id").alias("_first"), F.bool_or(F.col("batch_id") == batch_id).alias("_again"))
            bound = bound.join(written(known, "known_trades"), "trade_id", "left")
            seen = F.col("_first").isNotNull()
            reason = F.coalesce(reason, F.when(~F.col("_again"), F.concat(F.lit("KNOWN: trade of batch "), F.col("_first").cast("string"))))
        checked = written(bound.withColumns({"reject_reason": reason, "_seen": seen}).drop("_known", "_first", "_again"), "trade_feed")
        out["fact_trade"] = _add(state, "fact_trade", _keyed(checked.filter("reject_reason is null and not _seen").drop("reject_reason", "_seen")))
        messages.append(
            message_rows(
                checked.filter("reject_reason is not null"), batch_id, "TransformTrade", F.col("reject_reason"), "REJECT",
                F.concat(F.lit("trade_id="), F.coalesce(F.col("trade_id").cast("string"), F.lit("null"))),
            )
        )

    # Rows without account, customer version or trade go to the messages with the first reason that holds.
    trades = out["fact_trade"].select("trade_id", F.lit(True).alias("_traded")) if "fact_trade" in out else None
    for name, table, ts, key in (
        ("holding", "fact_holding", "held_at", ["trade_id", "held_at", "batch_id"]),
        ("cash", "fact_cash", "balance_at", ["account_id", "balance_at", "batch_id"]),
        ("watch", "fact_watch", "placed_at", ["sk_customer_id", "security_id", "placed_at", "batch_id"]),
    ):
        if name not in feeds:
            continue
        rows = _bind_customer(stamped[name], ts, customers, most)
        reason = F.when(F.col("_version_from").isNull(), "ORPHAN: customer version")
        if name != "watch":
            rows = rows.join(accounts, "account_id", "left")
            reason = F.when(F.col("_known").isNull(), "ORPHAN: account").otherwise(reason)
        if name == "holding":
            rows = rows.withColumn("_traded", F.lit(None).cast("boolean")) if trades is None else rows.join(trades, "trade_id", "left")
            reason = F.coalesce(reason, F.when(F.col("_traded").isNull(), "ORPHAN: trade"))
        checked = written(rows.withColumn("reject_reason", reason).drop("_known", "_traded"), f"{name}_feed")
        good = _keyed(checked.filter("reject_reason is null").drop("reject_reason"))
        fresh = _unseen(state, table, good, key, batch_id)
        out[table] = _add(state, table, fresh if fresh is good else written(fresh, table))
        named = [c for c in ("trade_id", "account_id", "customer_id", "security_id", ts) if c in checked.columns]
        text = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in named])
        messages.append(
            message_rows(checked.filter("reject_reason is not null"), batch_id, f"Transform{name.capitalize()}", F.col("reject_reason"), "REJECT", text)
        )
    if "market" in feeds:
        key = ["security_id", "date_key", "batch_id"]
        out["fact_market"] = _append(state, "fact_market", _unseen(state, "fact_market", stamped["market"], key, batch_id))

    control = customers.sparkSession.range(1)
    for text in ("batch started", "batch completed"):
        messages.append(message_rows(control, batch_id, "BatchControl", F.lit(text), "INFO", F.lit(f"batch {batch_id}")))
    log = messages[0]
    for m in messages[1:]:
        log = log.unionByName(m)
    told = ["batch_id", "message_source", "message_text", "message_type", "message_data"]
    out["messages"] = _append(state, "messages", _unseen(state, "messages", log, told, batch_id))
    return out


def control_totals(state: State) -> DataFrame:
    """Rows and one measure of every table of a state."""
    measures = {
        "fact_trade": F.col("price") * F.col("quantity"), "fact_holding": F.col("quantity"), "fact_cash": F.col("cash"),
        "fact_market": F.col("volume"),
    }
    out = None
    for name, df in sorted(state.items()):
        amount = dbl(F.sum(measures[name])) if name in measures else F.lit(None).cast("double")
        one = df.agg(n_rows().alias("row_count"), amount.alias("amount")).select(F.lit(name).alias("table_name"), "row_count", "amount")
        out = one if out is None else out.unionByName(one)
    return out


# fixed values: the audits, numbered as in the benchmark, and how actual and expected are compared
AUDITS: dict[int, tuple[str, str]] = {
    1: ("customer versions at least", ">="), 2: ("accounts at least", ">="), 3: ("securities at least", ">="),
    4: ("companies at least", ">="), 5: ("brokers at least", ">="), 6: ("trades at least", ">="),
    7: ("holdings at least", ">="), 8: ("cash balances at least", ">="), 9: ("market days at least", ">="),
    10: ("watches at least", ">="), 11: ("prospects at least", ">="), 12: ("trade dollar volume", "="),
    13: ("trade commission total", "="), 14: ("trade fee total", "="), 15: ("holding share total", "="),
    16: ("cash total of batch 1", "="), 17: ("cash total of batch 2", "="), 18: ("cash total of all batches", "="),
    19: ("trades with a net amount of zero or less", "="), 20: ("market days with high below low", "="),
    21: ("trades without price or quantity", "="), 22: ("customer versions that end before they start", "="),
    23: ("overlapping customer versions", "="), 24: ("customers without exactly one open version", "="),
    25: ("closed customer versions that meet their successor", "="), 26: ("accounts that end before they start", "="),
    27: ("overlapping account versions", "="), 28: ("accounts without exactly one current version", "="),
    29: ("companies that end before they start", "="), 30: ("trades without account", "="),
    31: ("trades without security", "="), 32: ("trades without broker", "="), 33: ("accounts without customer", "="),
    34: ("holdings without account", "="), 35: ("holdings without security", "="), 36: ("cash without account", "="),
    37: ("watches without customer", "="), 38: ("watches without security", "="),
    39: ("customer key not unique", "="), 40: ("account key not unique", "="), 41: ("security key not unique", "="),
    42: ("company key not unique", "="), 43: ("trade key not unique", "="), 44: ("batches in the message log", "="),
    45: ("rejected accounts and trades in the message log", "="), 46: ("rejected trades found in the fact", "="),
}


def _dirty_keys(df: DataFrame, key: str) -> Column:
    """Rows beyond the first of each key, plus NULL keys, as an aggregate over per-key counts."""
    return F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)) + F.coalesce(F.sum(F.when(F.col(key).isNull(), 1)), F.lit(0))


def _orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    per = child.groupBy(F.col(fk).alias("_k")).agg(n_rows().alias("_n"))
    known = parent.select(F.col(pk).alias("_k")).distinct()
    return per.join(known, "_k", "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("v"))


def _version_audits(versions: DataFrame, key: str, ids: Mapping[str, int]) -> list[tuple[dict[int, str], DataFrame]]:
    seen = ordered_scan(
        versions.select(key, "valid_from", "valid_to", "is_current"), [key], ["valid_from", "valid_to"],
        lead={"next_from": "valid_from"},
    )
    scan = seen.agg(
        F.count_if(F.col("valid_from") >= F.col("valid_to")).alias("inverted"),
        F.count_if(F.col("next_from") < F.col("valid_to")).alias("overlap"),
        F.count_if(~F.col("is_current") & (F.col("next_from") == F.col("valid_to"))).alias("meets"),
    )
    open_rows = F.count_if(F.col("is_current") & (F.col("valid_to") == sentinel()))
    single = versions.groupBy(key).agg(open_rows.alias("n")).agg(F.count_if(F.col("n") != 1).alias("open"))
    first = {ids[n]: n for n in ("inverted", "overlap", "meets") if n in ids}
    return [(first, scan), ({ids["open"]: "open"}, single)]


def audit_actuals(state: State) -> DataFrame:
    """(audit_id, actual) for the 46 audits; one aggregate per table plus the key joins."""
    trade, account, customer = state["fact_trade"], state["dim_account"], state["dim_customer"]
    holding, cash, watch = state["fact_holding"], state["fact_cash"], state["fact_watch"]
    net = F.col("price") * F.col("quantity") + F.col("fee") + F.col("commission") + F.col("tax")
    parts: list[tuple[dict[int, str], DataFrame]] = []

    counted = {2: account, 3: state["dim_security"], 4: state["dim_company"], 5: state["dim_broker"], 10: watch, 11: state["prospect"], 1: customer}
    parts += [({i: "v"}, df.agg(n_rows().alias("v"))) for i, df in counted.items()]
    parts.append(
        (
            {6: "a", 12: "b", 13: "c", 14: "d", 19: "e", 21: "f"},
            trade.agg(
                n_rows().alias("a"), dbl(F.sum(F.col("price") * F.col("quantity"))).alias("b"), dbl(F.sum("commission")).alias("c"),
                dbl(F.sum("fee")).alias("d"), F.count_if(net <= 0).alias("e"),
                F.count_if((F.col("price") <= 0) | (F.col("quantity") <= 0)).alias("f"),
            ),
        )
    )
    parts.append(({7: "a", 15: "b"}, holding.agg(n_rows().alias("a"), dbl(F.sum("quantity")).alias("b"))))
    per_batch = lambda b: dbl(F.coalesce(F.sum(F.when(F.col("batch_id") == b, F.col("cash"))), F.lit(0)))
    parts.append(
        ({8: "a", 16: "b", 17: "c", 18: "d"}, cash.agg(n_rows().alias("a"), per_batch(1).alias("b"), per_batch(2).alias("c"), dbl(F.sum("cash")).alias("d")))
    )
    parts.append(({9: "a", 20: "b"}, state["fact_market"].agg(n_rows().alias("a"), F.count_if(F.col("high") < F.col("low")).alias("b"))))
    parts += _version_audits(customer, "customer_id", {"inverted": 22, "overlap": 23, "meets": 25, "open": 24})
    parts += _version_audits(account, "account_id", {"inverted": 26, "overlap": 27, "open": 28})
    parts.append(({29: "v"}, state["dim_company"].agg(F.count_if(F.col("valid_from") >= F.col("valid_to")).alias("v"))))
    orphans = {
        30: (trade, "account_id", account, "account_id"), 31: (trade, "security_id", state["dim_security"], "security_id"),
        32: (trade, "broker_id", state["dim_broker"], "broker_id"), 33: (account, "sk_customer_id", customer, "version_sk"),
        34: (holding, "account_id", account, "account_id"), 35: (holding, "security_id", state["dim_security"], "security_id"),
        36: (cash, "account_id", account, "account_id"), 37: (watch, "sk_customer_id", customer, "version_sk"),
        38: (watch, "security_id", state["dim_security"], "security_id"),
    }
    parts += [({i: "v"}, _orphans(*spec)) for i, spec in orphans.items()]
    keys = {39: (customer, "version_sk"), 40: (account, "version_sk"), 41: (state["dim_security"], "version_sk"),
            42: (state["dim_company"], "version_sk"), 43: (trade, "trade_id")}
    parts += [
        ({i: "v"}, df.groupBy(k).agg(n_rows().alias("_n")).agg(_dirty_keys(df, k).alias("v"))) for i, (df, k) in keys.items()
    ]
    log = state["messages"]
    reject = F.col("message_type") == "REJECT"
    named = reject & F.col("message_source").isin("TransformAccount", "TransformTrade")
    parts.append(({44: "a", 45: "b"}, log.agg(F.count_distinct("batch_id").alias("a"), F.count_if(named).alias("b"))))
    rejected = log.filter(reject & (F.col("message_source") == "TransformTrade")).select(
        F.regexp_extract("message_data", "([0-9]+)", 1).cast("bigint").alias("trade_id"), "batch_id"
    )
    parts.append(({46: "v"}, trade.join(rejected, ["trade_id", "batch_id"], "left_semi").agg(n_rows().alias("v"))))

    out = None
    for names, df in parts:
        entries = [F.struct(F.lit(i).alias("audit_id"), dbl(c).alias("actual")) for i, c in names.items()]
        one = df.select(F.inline(F.array(*entries)))
        out = one if out is None else out.unionByName(one)
    return out


def audits(state: State, expected: DataFrame) -> DataFrame:
    """(audit_id, title, expected, actual, passed). `expected` holds (audit_id, expected) control totals that
    come from the sources; audits without one expect zero."""
    spark = expected.sparkSession
    plan = small_table(spark, [(i, title, op) for i, (title, op) in AUDITS.items()], "audit_id int, title string, op string")
    rows = plan.join(expected, "audit_id", "left").join(audit_actuals(state), "audit_id", "left")
    want = F.coalesce("expected", F.lit(0.0))
    ok = F.when(F.col("op") == ">=", F.col("actual") >= want).otherwise(F.abs(F.col("actual") - want) < 0.01)
    return rows.select("audit_id", "title", want.alias("expected"), "actual", F.coalesce(ok, F.lit(False)).alias("passed"))
