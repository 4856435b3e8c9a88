"""Word lists of the text rules."""

# fixed values: ordinary words that keyboard-mash and vowel rules never flag
COMMON_WORDS = ("a", "at", "as", "all", "ask", "fall", "flask", "glad", "flag", "salt", "walk", "talk", "dash", "flash")

# fixed values: beginnings of keyboard mash
MASH_PREFIXES = ("asdf", "lkjh", "qwerty", "zxcv", "ghjk")

# fixed values: marker phrases; a live marker contradicts a monthly or a sensor marker
LIVE_MARKERS = ("sub-millisecond", "row lock", "live checkout cart", "mobile app backend", "instant point updates")
MONTHLY_MARKERS = ("monthly snapshot", "monthly balance rollup", "month-end accounting ledger")
SENSOR_MARKERS = ("streaming sensor", "iot telemetry every second", "10,000 ticks per second")

# fixed values: words and endings of the three term classes
NOUNS = (
    "customer", "employee", "product", "department", "manager", "order", "claim", "patient", "driver", "warehouse",
    "store", "account", "item", "cart", "ticket", "invoice", "payment", "shipment", "carrier", "doctor", "hospital",
    "part", "supplier", "tenant", "subscription",
)
NOUN_ENDINGS = ("er", "ee", "ment", "or")
VERBS = (
    "places", "orders", "promotes", "transfers", "pays", "ships", "delivers", "refunds", "charges", "admits",
    "executes", "buys", "cancels", "submits", "upgrades", "downgrades", "scans", "picks",
)
VERB_ENDINGS = ("s", "ed", "ing")
ADJECTIVES = (
    "active", "remote", "shipped", "pending", "cancelled", "approved", "high", "low", "returned", "closed",
    "incurred", "allocated",
)
ADJECTIVE_ENDINGS = ("able", "ed")

# fixed values: phrases that set each tag
TAG_PHRASES = {
    "is_high_frequency_stream": (
        "sensor", "telemetry", "iot", "ticker", "every second", "milliseconds", "streaming", "clickstream", "devices",
    ),
    "is_live_app": (
        "live website", "mobile app", "checkout screen", "user clicks", "instant updates", "powers a live",
        "powers the live", "microservice", "real time app", "shopping cart", "session token", "point-of-care", "ehr",
        "bedside charting",
    ),
    "has_retroactive_backdating": (
        "sox", "regulated", "audit date", "retroactive", "backdated", "restatement", "general ledger", "accounting audit",
    ),
    "has_multi_stage_milestones": (
        "sequential steps", "turnaround time", "order placed ->", "milestone", "stage", "duration", "lifecycle",
        "placed -> picked", "admission-to-discharge", "funnel", "intake -> underwriting -> closing",
    ),
    "is_periodic_state_rollup": (
        "snapshot", "monthly summary", "daily summary", "inventory stock", "balance rollup", "month-end", "nightly snapshot",
    ),
    "has_high_churn_ml_scores": (
        "ml score", "churn risk", "health score", "fico", "propensity", "dynamic score", "daily risk scoring",
        "updating nightly",
    ),
    "is_denormalized_obt": (
        "one big table", "single flat table", "denormalized mart", "zero join latency", "sub-second dashboard scan",
        "flattened reporting", "single denormalized",
    ),
    "is_nested_columnar": (
        "nested repeated", "repeated records", "line items inside order", "struct and array", "nested columnar",
        "array of structs", "repeated line items", "nested line items",
    ),
    "has_multi_fact_bus_matrix": (
        "bus matrix", "enterprise bus", "multi-fact", "multi fact", "order-to-cash", "procure-to-pay", "drill across",
        "drill-across", "cross-process", "across orders and", "orders and shipments", "shipments and payments",
        "orders, shipments", "conformed dimensions across facts", "shared conformed dimensions",
    ),
    "has_scd6_hybrid": (
        "scd6", "scd 6", "type 6", "type-6", "hybrid dimension", "as-was and as-is", "as was and as is",
        "historical and current", "dual-perspective", "dual perspective", "bitemporal scd",
    ),
    "has_semi_additive_balances": (
        "semi-additive", "semi additive", "ending balance", "closing balance", "ledger balance", "available balance",
        "aggregate rollup", "aggregate navigation", "monthly rollup",
    ),
    "is_factless_event": (
        "factless", "fact-less", "event attendance", "security event", "audit event", "promotion coverage",
        "login event", "zero numeric measure",
    ),
    "has_multivalued_bridge": (
        "bridge table", "multi-valued", "multivalued", "weighting factor", "allocation factor", "group bridge",
        "co-owners", "co-ownership", "care team attribution", "secondary comorbidity", "diagnosis bridge",
    ),
    "has_junk_dimension": (
        "junk dimension", "miscellaneous flags", "status indicators", "indicator flags", "low-cardinality flags",
        "consolidated flags", "flag consolidation", "order indicators",
    ),
    "has_outrigger_dimension": (
        "outrigger dimension", "dimension outrigger", "secondary dimension", "county demographic outrigger",
        "demographic outrigger",
    ),
    "is_data_vault": (
        "data vault", "data vault 2.0", "hubs and links", "hub, link, sat", "raw vault", "hash key",
        "multi-source integration", "audit trail raw layer", "enterprise data vault", "raw data vault", "hubs, links",
        "satellite table",
    ),
    "is_graph_topology": (
        "property graph", "nodes and edges", "vertices and edges", "mule ring", "circular transaction",
        "network topology", "graph traversal", "fraud ring", "money mule", "shortest path", "connected components",
        "aml network", "circular transfer", "directed edges", "mule account", "graph olap", "directed graph",
    ),
    "is_realtime_streaming_olap": (
        "clickhouse", "pinot", "columnar streaming", "streaming olap", "hyperloglog", "wide flat stream",
        "approximate count distinct", "roaring bitmap", "ad telemetry", "clickstream", "approx_count_distinct",
        "approximate distinct", "real-time columnar", "wide denormalized event stream",
    ),
    "is_vector_feature_store": (
        "feature store", "asof join", "as-of join", "vector embedding", "pgvector", "feature leakage", "dual-speed",
        "online store and offline store", "point-in-time feature", "dense vector", "cosine similarity",
        "training dataset generation",
    ),
}

# fixed values: word patterns that also set a tag
TAG_PATTERNS = {
    "is_denormalized_obt": r"\bobt\b",
    "is_graph_topology": r"\bgraphs?\b",
    "is_realtime_streaming_olap": r"\bhll\b",
}

# fixed values: phrases that say history is not kept; without any of them the history tag is set
NO_HISTORY_PHRASES = ("always overwrite", "current state only", "overwrite past records")

# fixed values: phrases of the five completeness questions, 20 points each
WORKLOAD_PHRASES = (
    "dashboard", "reporting", "bi report", "analytics", "trends over time", "live website", "mobile app", "checkout",
    "sensor", "telemetry", "streaming", "ticker", "live point-of-care", "ehr application", "powers the live",
    "powers a live", "real-time", "bedside charting", "operational database", "sub-second", "live app",
    "point-of-care", "analyze", "metrics", "performance", "over time", "business metrics", "one big table", "obt",
    "single flat table", "denormalized mart", "zero join latency", "sub-second dashboard scan", "nested repeated",
    "nested columnar", "struct and array", "repeated records", "bus matrix", "drill-across", "drill across",
    "cross-process", "value stream", "order-to-cash", "multi-fact", "multi fact",
)
GRAIN_PHRASES = (
    "line item", "order line", "transaction", "each encounter", "single event", "snapshot", "one row per",
    "individual", "prescription", "procedure", "order", "patient", "stay", "admission", "vitals", "product sales",
    "physical or digital goods", "subscription memberships", "monthly billing renewals", "patient care",
    "credit lending", "revenue", "insurance", "car insurance", "policy", "driver", "coverage", "premium",
    "subscription", "subscriptions", "contract", "contracts", "renewal", "renewals", "nested line items",
    "repeated line items", "order items", "shipment packages", "payment transaction attempts", "orders, shipments",
    "multi-process",
)
OFFERING_PHRASES = (
    "product sales", "physical or digital goods", "subscription memberships", "patient care", "credit lending",
    "subscription", "subscriptions",
)
HISTORY_PHRASES = (
    "preserve", "historical", "scd", "original address", "point-in-time", "overwrite", "newest address", "audit date",
    "regulated", "sox", "insurance at time", "newest policy", "always overwrite", "newest menu price",
    "original price", "tracking", "cohort", "churn", "calendar dates", "dates", "role-playing",
)
LIFECYCLE_PHRASES = (
    "stage", "milestone", "turnaround", "placed ->", "duration", "funnel", "sequential", "standalone event",
    "single event", "encounter", "picked to shipped", "admitted", "discharged", "inpatient stay",
    "admission to discharge", "stay", "transferred", "purchase", "checkout counter", "point-of-sale", "sale", "sales",
    "checkout", "snapshot", "snapshots", "periodic", "monthly summary", "daily summary", "balance rollup",
    "stock levels", "single standalone transaction", "multi-stage turnaround tracking", "renewal", "renewals",
    "recurring subscription", "subscription renewals", "order checkout", "order with repeated line items",
    "e-commerce order", "order-to-cash", "order to cash", "orders, shipments, and payments", "value stream",
    "lifecycle facts", "lifecycle",
)
RELATION_PHRASES = (
    "one-to-one ownership", "one-to-many", "co-ownership", "shared", "standard", "denormalized", "nested", "repeated",
    "obt", "bus matrix", "conformed", "conformed dimensions",
)
