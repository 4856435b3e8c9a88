"""Queries for vault loads, transfer graphs and the feature store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.columns import dbl, money, n_rows, ntz, ts_text
from terrace.operators import features, graph, vault
from terrace.operators.temporal import asof_join
from terrace.plans.dimension_queries import PRIORITY_LOG_SQL, orders_per_customer, priority_log
from terrace.plans.registry import Tables, query
from terrace.session import written


M = "CAST({} AS DECIMAL(18,2))".format
TS = "'%Y-%m-%d %H:%M:%S.%f'"
SHA = "sha256(upper(trim(CAST({} AS VARCHAR))))".format

# ---- vault ---------------------------------------------------------------------------------------


def customer_feed(t: Tables) -> DataFrame:
    """Customer keys seen by two systems: the order system and the customer master."""
    ordered = t.orders.select("o_custkey", "o_orderdate", F.lit("ORDERS").alias("src"))
    master = t.customer.select(F.col("c_custkey").alias("o_custkey"), ntz("1999-01-01").alias("o_orderdate"), F.lit("MASTER").alias("src"))
    return ordered.unionByName(master)


def customer_hub(t: Tables) -> DataFrame:
    return vault.hub_load(None, customer_feed(t), "o_custkey", "o_orderdate", "src", "customer_hk")


@query(
    "v1_hub_load",
    f"""SELECT {SHA('o_custkey')} AS customer_hk, o_custkey, strftime(min(d), {TS}) AS load_dts, arg_min(src, (d, src)) AS rec_src
        FROM (SELECT o_custkey, o_orderdate AS d, 'ORDERS' AS src FROM orders UNION ALL
              SELECT c_custkey, TIMESTAMP '1999-01-01', 'MASTER' FROM customer) GROUP BY o_custkey""",
)
def _(t):
    return customer_hub(t).withColumn("load_dts", ts_text("load_dts"))


@query(
    "v1_hub_increment",
    f"""SELECT {SHA('s_suppkey')} AS supplier_hk, s_suppkey FROM supplier WHERE s_acctbal < 0""",
)
def _(t):
    feed = t.supplier.select("s_suppkey", "s_acctbal", ntz("2000-01-01").alias("d"), F.lit("ERP").alias("src"))
    loaded = vault.hub_load(None, feed.filter("s_acctbal >= 0"), "s_suppkey", "d", "src", "supplier_hk")
    return vault.hub_load(loaded, feed, "s_suppkey", "d", "src", "supplier_hk").select("supplier_hk", "s_suppkey")


def order_link(t: Tables) -> DataFrame:
    feed = t.orders.withColumn("src", F.lit("ORDERS"))
    keys = {"customer_hk": "o_custkey", "order_hk": "o_orderkey"}
    return vault.link_load(None, feed, keys, "o_orderdate", "src", "link_customer_order_hk")


@query(
    "v2_link_load",
    f"""SELECT sha256(o_custkey || '||' || o_orderkey) AS link_customer_order_hk, {SHA('o_custkey')} AS customer_hk,
               {SHA('o_orderkey')} AS order_hk, 'ORDERS' AS rec_src FROM orders""",
)
def _(t):
    return order_link(t).drop("load_dts")


def priority_satellite(t: Tables) -> DataFrame:
    """Loaded in two runs: the second appends only what changed against the newest stored row."""
    log, src = priority_log(t), F.lit("CRM")
    biggest = orders_per_customer(t) + 1
    first = vault.satellite_load(
        None, log.filter(F.col("changed_at") < ntz("1998-01-01")), "cust_id", "changed_at", ["priority"], src, "customer_hk", biggest=biggest
    )
    first = written(first, "satellite")
    later = log.filter(F.col("changed_at") >= ntz("1998-01-01"))
    second = vault.satellite_load(first, later, "cust_id", "changed_at", ["priority"], src, "customer_hk", biggest=biggest)
    return first.unionByName(second)


def status_satellite(t: Tables) -> DataFrame:
    daily = t.orders.groupBy(F.col("o_custkey").alias("cust_id"), F.col("o_orderdate").alias("changed_at")).agg(
        F.max_by(F.struct("o_orderstatus", "o_totalprice"), "o_orderkey").alias("x")
    ).select("cust_id", "changed_at", F.col("x.o_orderstatus").alias("status"), money("x.o_totalprice").alias("credit"))
    return vault.satellite_load(
        None, daily, "cust_id", "changed_at", ["status", "credit"], F.lit("BILLING"), "customer_hk", biggest=orders_per_customer(t)
    )


PSAT_SQL = f"""(SELECT {SHA('cust_id')} AS customer_hk, cust_id, changed_at AS load_dts, sha256(priority) AS hash_diff, priority FROM (
    SELECT *, lag(priority) OVER (PARTITION BY cust_id ORDER BY changed_at) AS p FROM {PRIORITY_LOG_SQL}) WHERE p IS NULL OR p <> priority)"""
SLOG_SQL = f"""(SELECT o_custkey AS cust_id, o_orderdate AS changed_at, arg_max(o_orderstatus, o_orderkey) AS status,
    arg_max({M('o_totalprice')}, o_orderkey) AS credit FROM orders GROUP BY 1, 2)"""
SSAT_SQL = f"""(SELECT {SHA('cust_id')} AS customer_hk, changed_at AS load_dts, status, credit FROM (
    SELECT *, lag(status || credit) OVER (PARTITION BY cust_id ORDER BY changed_at) AS p FROM {SLOG_SQL})
    WHERE p IS NULL OR p <> status || credit)"""


@query(
    "v3_satellite_load",
    f"SELECT customer_hk, strftime(load_dts, {TS}) AS load_dts, hash_diff, priority, 'CRM' AS rec_src FROM {PSAT_SQL}",
)
def _(t):
    return priority_satellite(t).withColumn("load_dts", ts_text("load_dts"))


def profile_sql(as_of: str | None) -> str:
    where = f"WHERE load_dts <= TIMESTAMP '{as_of}'" if as_of else ""
    return f"""SELECT {SHA('c_custkey')} AS customer_hk, priority, CAST(credit AS DOUBLE) AS credit,
               strftime(p.d, {TS}) AS crm_load_dts FROM customer
        LEFT JOIN (SELECT customer_hk, arg_max(priority, load_dts) AS priority, max(load_dts) AS d FROM {PSAT_SQL} {where} GROUP BY 1) p
          ON p.customer_hk = {SHA('c_custkey')}
        LEFT JOIN (SELECT customer_hk, arg_max(credit, load_dts) AS credit FROM {SSAT_SQL} {where} GROUP BY 1) s
          ON s.customer_hk = {SHA('c_custkey')}"""


def customer_profile(t: Tables, as_of=None) -> DataFrame:
    sats = {"crm": (priority_satellite(t), ["priority"]), "billing": (status_satellite(t), ["credit"])}
    out = vault.hub_profile(customer_hub(t), sats, "customer_hk", as_of)
    return out.select("customer_hk", "priority", dbl("credit").alias("credit"), ts_text("crm_load_dts").alias("crm_load_dts"))


@query("v4_customer_360", profile_sql(None))
def _(t):
    return customer_profile(t)


@query("v5_vault_pit", profile_sql("1998-01-01"))
def _(t):
    return customer_profile(t, ntz("1998-01-01"))


@query(
    "v6_vault_orphans",
    f"""SELECT 'customer_hk' AS hash_key, count(*) AS orphan_count FROM orders
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
)
def _(t):
    active = t.customer.filter("c_acctbal >= 0").select("c_custkey", ntz("1999-01-01").alias("d"), F.lit("MASTER").alias("src"))
    customers = vault.hub_load(None, active, "c_custkey", "d", "src", "customer_hk")
    heads = t.orders.withColumn("src", F.lit("ORDERS"))
    orders = vault.hub_load(None, heads, "o_orderkey", "o_orderdate", "src", "order_hk")
    lost = vault.vault_orphans(order_link(t), {"customer_hk": customers, "order_hk": orders})
    return lost.groupBy("hash_key").agg(n_rows().alias("orphan_count"))


@query(
    "v7_source_isolation",
    f"""SELECT 'CRM' AS rec_src, count(*) AS row_count, count(DISTINCT customer_hk) AS key_count FROM {PSAT_SQL} UNION ALL
        SELECT 'BILLING', count(*), count(DISTINCT customer_hk) FROM {SSAT_SQL}""",
)
def _(t):
    return vault.source_isolation([priority_satellite(t), status_satellite(t)])


# ---- graph ---------------------------------------------------------------------------------------


def ring_edges(t: Tables) -> DataFrame:
    """Customers in rings of three, with a linear chain through the rings as noise."""
    c = F.col("c_custkey")
    ring = t.customer.select(
        c.alias("src"), (F.floor(c / 3).cast("bigint") * 3 + (c + 1) % 3).alias("dst"), money("c_acctbal").alias("amount")
    )
    chain = t.customer.select(c.alias("src"), (c + 3).alias("dst"), money("c_acctbal").alias("amount"))
    known = t.customer.select(c.alias("dst"))
    return ring.unionByName(chain).join(known, "dst", "left_semi")


RING_EDGES_SQL = f"""(SELECT src, dst, amount FROM (
    SELECT c_custkey AS src, CAST(3 * (c_custkey // 3) + (c_custkey + 1) % 3 AS BIGINT) AS dst, {M('c_acctbal')} AS amount FROM customer
    UNION ALL SELECT c_custkey, c_custkey + 3, {M('c_acctbal')} FROM customer) WHERE dst IN (SELECT c_custkey FROM customer))"""


def transfers(t: Tables) -> DataFrame:
    """Transfers from a user to the account named in the event's JSON."""
    target = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select(F.col("user_id").alias("src"), target.alias("dst"), money("value").alias("amount"))


TRANSFERS_SQL = f"""(SELECT user_id AS src, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS dst, {M('value')} AS amount FROM events)"""


@query(
    "x1_cycle_rings",
    f"""WITH e AS (SELECT DISTINCT src, dst FROM {RING_EDGES_SQL} WHERE src <> dst)
        SELECT DISTINCT a.src AS root, CAST(3 AS INTEGER) AS ring_size FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src
        WHERE c.dst = a.src AND b.dst <> a.src""",
)
def _(t):
    return graph.ring_roots(ring_edges(t), "src", "dst", 3)


@query(
    "x1_cycle_rings_by_size",
    f"""WITH e AS (SELECT DISTINCT src, dst FROM {TRANSFERS_SQL}), n AS (SELECT * FROM e WHERE src <> dst),
             p AS (SELECT DISTINCT a.src AS s, a.dst AS m, b.dst AS d FROM n a JOIN n b ON a.dst = b.src WHERE b.dst <> a.src)
        SELECT src AS root, CAST(1 AS INTEGER) AS ring_size FROM e WHERE src = dst UNION ALL
        SELECT DISTINCT a.src, 2 FROM n a JOIN n b ON a.dst = b.src AND b.dst = a.src UNION ALL
        SELECT DISTINCT p.s, 3 FROM p JOIN n ON n.src = p.d AND n.dst = p.s UNION ALL
        SELECT DISTINCT p.s, 4 FROM p JOIN p q ON q.s = p.d AND q.d = p.s AND q.m <> p.m""",
)
def _(t):
    edges = transfers(t)
    out = graph.ring_roots(edges, "src", "dst", 1)
    for size in (2, 3, 4):
        out = out.unionByName(graph.ring_roots(edges, "src", "dst", size))
    return out


@query(
    "x2_ring_volume",
    f"""WITH e AS (SELECT DISTINCT src, dst FROM {TRANSFERS_SQL} WHERE src <> dst),
             r AS (SELECT DISTINCT a.src AS root FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src
                   WHERE c.dst = a.src AND b.dst <> a.src)
        SELECT count(*) AS transfer_count, CAST(sum(amount) AS DOUBLE) AS volume FROM {TRANSFERS_SQL}
        WHERE src IN (SELECT root FROM r) AND dst IN (SELECT root FROM r)""",
)
def _(t):
    edges = transfers(t)
    members = graph.ring_roots(edges, "src", "dst", 3)
    return graph.ring_volume(edges, "src", "dst", "amount", members, "root").withColumn("volume", dbl("volume"))


@query(
    "x3_out_degree",
    f"""SELECT src, count(DISTINCT dst) AS out_degree FROM {TRANSFERS_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(t):
    return graph.top_hubs(transfers(t), "src", "dst", 10)


@query(
    "x4_chain_immunity",
    f"""WITH e AS (SELECT DISTINCT src, dst FROM {TRANSFERS_SQL} WHERE src <> dst)
        SELECT DISTINCT src FROM e WHERE src NOT IN (SELECT a.src FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src
        WHERE c.dst = a.src AND b.dst <> a.src)""",
)
def _(t):
    edges = transfers(t)
    on_ring = graph.ring_roots(edges, "src", "dst", 3).select(F.col("root").alias("src"))
    return edges.filter("src <> dst").select("src").distinct().join(on_ring, "src", "left_anti")


@query(
    "x4_reachability",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {RING_EDGES_SQL}),
          r AS (SELECT c_custkey AS node, 0 AS hops FROM customer WHERE c_acctbal < -900
                UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE r.hops < 4)
        SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY 1""",
)
def _(t):
    seeds = t.customer.filter("c_acctbal < -900")
    return graph.reachability(ring_edges(t), "src", "dst", seeds, "c_custkey", 4)


DEPENDENCY_SQL = """(SELECT CAST((p_partkey - 1) // 8 AS BIGINT) AS parent_id, p_partkey AS child_id FROM part WHERE p_partkey > 0
    UNION ALL SELECT p_partkey, CAST((p_partkey - 1) // 64 AS BIGINT) FROM part WHERE p_partkey > 0 AND p_size = 50)"""


@query(
    "x5_dependency_cycles",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT parent_id AS s, child_id AS d FROM {DEPENDENCY_SQL}),
          r AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON r.d = e.s),
          cyc AS (SELECT s AS n FROM r WHERE s = d)
        SELECT n AS node FROM cyc UNION
        SELECT a.d FROM r a JOIN r b ON a.d = b.s WHERE a.s IN (SELECT n FROM cyc) AND b.d IN (SELECT n FROM cyc)""",
)
def _(t):
    return graph.cyclic_core(dependencies(t), "parent_id", "child_id")


def dependencies(t: Tables) -> DataFrame:
    """The part tree with a back reference from each part of size 50 to an ancestor region."""
    p = F.col("p_partkey")
    tree = t.part.filter(p > 0).select(F.floor((p - 1) / 8).cast("bigint").alias("parent_id"), p.alias("child_id"))
    back = t.part.filter((p > 0) & (F.col("p_size") == 50)).select(
        p.alias("parent_id"), F.floor((p - 1) / 64).cast("bigint").alias("child_id")
    )
    return tree.unionByName(back)


@query(
    "x5_components",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT parent_id AS s, child_id AS d FROM {DEPENDENCY_SQL}),
          r AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON r.d = e.s)
        SELECT a.s AS node, min(a.d) AS component_id FROM r a JOIN r b ON a.s = b.d AND a.d = b.s GROUP BY 1""",
)
def _(t):
    return graph.components(dependencies(t), "parent_id", "child_id")


@query(
    "x5_transfer_components",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src AS s, dst AS d FROM {TRANSFERS_SQL} WHERE src IS NOT NULL AND dst IS NOT NULL),
          r AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON r.d = e.s)
        SELECT a.s AS node, min(a.d) AS component_id FROM r a JOIN r b ON a.s = b.d AND a.d = b.s GROUP BY 1""",
)
def _(t):
    return graph.components(transfers(t), "src", "dst")


# ---- feature store -------------------------------------------------------------------------------


def purchases(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("obs_ts"))


def view_features(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'view'").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"), F.col("event_id").alias("view_id")
    )


ASOF_SQL = f"""(SELECT o.event_id, o.user_id, o.ts AS obs_ts, f.ts AS view_ts, f.value AS view_value FROM
    (SELECT * FROM events WHERE event_type = 'purchase') o ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') f
    ON o.user_id = f.user_id AND o.ts >= f.ts)"""


@query("a1_asof_join", f"SELECT event_id, user_id, strftime(view_ts, {TS}) AS view_ts, view_value FROM {ASOF_SQL}")
def _(t):
    hit = asof_join(purchases(t), view_features(t), "user_id", "obs_ts", "view_ts", ["view_value"], ["view_id"])
    return hit.select("event_id", "user_id", ts_text("matched_view_ts").alias("view_ts"), "view_value")


@query("a1_asof_join_inner", f"SELECT event_id, view_value FROM {ASOF_SQL} WHERE view_ts IS NOT NULL")
def _(t):
    hit = asof_join(purchases(t), view_features(t), "user_id", "obs_ts", "view_ts", ["view_value"], ["view_id"], how="inner")
    return hit.select("event_id", "view_value")


CENTROID_SQL = """(SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM (
    SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""
SCORED_SQL = f"""(SELECT vec_id, e.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 6) AS similarity
    FROM embeddings e JOIN {CENTROID_SQL} c ON c.label = e.label)"""


@query("a2_cosine_similarity", f"SELECT vec_id, label, similarity FROM {SCORED_SQL}")
def _(t):
    means = features.centroids(t.embeddings, "label", "embedding", 64)
    scored = features.similarity_to(t.embeddings, means, "label", "embedding", "centroid")
    return scored.select("vec_id", "label", "similarity")


@query(
    "a3_topk_similar",
    f"""SELECT label, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label
        ORDER BY similarity DESC, vec_id) AS rank FROM {SCORED_SQL}) WHERE rank <= 5""",
)
def _(t):
    means = features.centroids(t.embeddings, "label", "embedding", 64)
    top = features.topk_similar(t.embeddings, means, "label", "embedding", "centroid", "vec_id", 5)
    return top.select("label", "vec_id", "similarity", "rank")


@query(
    "a3_topk_nearest",
    f"""SELECT label, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label
        ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT c.label, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
        centroid), 6) AS similarity FROM embeddings CROSS JOIN {CENTROID_SQL} c) WHERE similarity IS NOT NULL) WHERE rank <= 5""",
)
def _(t):
    means = features.centroids(t.embeddings, "label", "embedding", 64)
    top = features.topk_nearest(t.embeddings, means, "label", "embedding", "centroid", "vec_id", 5)
    return top.select("label", "vec_id", "similarity", "rank")


@query("a4_feature_versions", "SELECT user_id, count(*) AS version_count FROM events WHERE event_type = 'view' GROUP BY 1")
def _(t):
    return features.feature_versions(view_features(t), "user_id")


@query(
    "a5_feature_completeness",
    f"SELECT count(*) AS observations, count(view_ts) AS bound, count(view_value) AS view_value_present FROM {ASOF_SQL}",
)
def _(t):
    hit = asof_join(purchases(t), view_features(t), "user_id", "obs_ts", "view_ts", ["view_value"], ["view_id"])
    return features.feature_completeness(hit, "matched_view_ts", ["view_value"])


@query(
    "a6_training_set",
    f"""SELECT s.event_id, s.user_id, view_value, false AS leaks, CAST(value > 100 AS INTEGER) AS label FROM {ASOF_SQL} s
        JOIN events e ON e.event_id = s.event_id""",
)
def _(t):
    observed = t.events.filter("event_type = 'purchase'").select(
        "event_id", "user_id", F.col("ts").alias("obs_ts"), (F.col("value") > 100).cast("int").alias("label")
    )
    built = features.training_set(observed, view_features(t), "user_id", "obs_ts", "view_ts", ["view_value"], ["view_id"])
    return built.select("event_id", "user_id", "view_value", "leaks", "label")


@query(
    "a7_rolling_features",
    f"""SELECT user_id, strftime(ts, {TS}) AS ts, CAST(sum({M('value')}) OVER (PARTITION BY user_id ORDER BY ts
          RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS DOUBLE) AS velocity_30m_sum,
          count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS velocity_30m_count,
          CAST(sum({M('value')}) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS DOUBLE) AS week_sum,
          count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS week_count FROM events""",
)
def _(t):
    rolled = features.rolling_features(
        t.events, "user_id", "ts", money("value"), {"velocity_30m": 1800, "week": 7 * 86400}
    )
    return rolled.withColumns(
        {"ts": ts_text("ts"), "velocity_30m_sum": dbl("velocity_30m_sum"), "week_sum": dbl("week_sum")}
    )
