"""Dimension builders: change history, hybrids, bitemporal splicing, junk, outrigger, hierarchy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.columns import any_of, md5_key, sentinel
from terrace.operators.ordered import HOT_ROWS, largest_group, ordered_scan
from terrace.session import durable


def scd1_upsert(dim: DataFrame, src: DataFrame, key: str, overwrite: bool = True) -> DataFrame:
    """Type 1: insert new members; with `overwrite` also replace the attributes of known ones. Of source rows with equal key the
    one with the greatest values, column by column, counts, so a member has one row."""
    src = src.groupBy(F.col(key)).agg(F.max(F.struct(*dim.columns)).alias("_row")).select("_row.*")
    if not overwrite:
        return dim.unionByName(src.join(dim.select(key), key, "left_anti"))
    kept = dim.join(src.select(key), key, "left_anti")
    return kept.unionByName(src.select(*dim.columns))


def scd2_build(
    history: DataFrame,
    key: str,
    ts: str,
    attrs: Sequence[str],
    hot_rows: int = HOT_ROWS,
    biggest: int | None = None,
) -> DataFrame:
    """Versions from a change log with at most one row per (key, ts): unchanged rows collapse, a version
    ends where the next starts, the open one at the 9999 sentinel. Adds version_number and a
    version-specific surrogate key."""
    log = history.select(key, F.col(ts).alias("valid_from"), *attrs)
    if biggest is None:
        biggest = largest_group(log, [key])
    seen = ordered_scan(
        log, [key], ["valid_from"], lag={f"_p_{a}": a for a in attrs} | {"_p_ts": "valid_from"},
        hot_rows=hot_rows, biggest=biggest,
    )
    changed = F.col("_p_ts").isNull() | any_of([~F.col(a).eqNullSafe(F.col(f"_p_{a}")) for a in attrs])
    changes = seen.filter(changed).select(key, "valid_from", *attrs)
    closed = ordered_scan(
        changes, [key], ["valid_from"], lead={"_next": "valid_from"}, index="version_number",
        hot_rows=hot_rows, biggest=biggest,
    )
    stamp = F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return closed.select(
        md5_key(key, stamp).alias("version_sk"),
        key,
        *attrs,
        "valid_from",
        F.coalesce("_next", sentinel()).alias("valid_to"),
        F.col("_next").isNull().alias("is_current"),
        "version_number",
    )


def scd2_merge(dim: DataFrame, batch: DataFrame, key: str, ts: str, attrs: Sequence[str], **scan) -> DataFrame:
    """Apply a batch of changes: changed members are closed and get their new version, new members are
    inserted. Only touched members are rebuilt, so several changes, late changes and a re-run of the
    same batch all give the same result. Written as a new snapshot by the caller."""
    touched = batch.select(key).distinct()
    untouched = dim.join(touched, key, "left_anti")
    known = dim.join(touched, key, "left_semi").select(
        key, F.col("valid_from").alias(ts), *attrs, F.lit(0).alias("_from_batch")
    )
    both = known.unionByName(batch.select(key, ts, *attrs).withColumn("_from_batch", F.lit(1)))
    newest = both.groupBy(key, ts).agg(
        F.max_by(F.struct(*attrs), F.struct("_from_batch", *attrs)).alias("_a")
    )
    rebuilt = scd2_build(newest.select(key, ts, "_a.*"), key, ts, attrs, **scan)
    return untouched.unionByName(rebuilt)


def current_view(dim: DataFrame) -> DataFrame:
    return dim.filter(F.col("valid_to") >= sentinel())


def scd6_hybrid(versions: DataFrame, key: str, attrs: Sequence[str]) -> DataFrame:
    """Every version keeps its own value (historical_x) beside the newest one (current_x)."""
    now = current_view(versions).select(key, *[F.col(a).alias(f"current_{a}") for a in attrs])
    was = versions.withColumnsRenamed({a: f"historical_{a}" for a in attrs})
    return was.join(now, key, "left").withColumn("is_inferred", F.lit(False))


def orphan_keys(fact: DataFrame, fact_key: str, dim: DataFrame, key: str) -> DataFrame:
    keys = fact.select(F.col(fact_key).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return keys.join(dim.select(key).distinct(), key, "left_anti")


def inferred_members(
    dim: DataFrame, fact: DataFrame, fact_key: str, key: str, defaults: Mapping[str, object]
) -> DataFrame:
    """Adds a ghost row (is_inferred, defaults elsewhere) for each fact key the dimension lacks."""
    ghosts = orphan_keys(fact, fact_key, dim, key)
    marked = dim if "is_inferred" in dim.columns else dim.withColumn("is_inferred", F.lit(False))
    shaped = [
        F.col(f.name)
        if f.name == key
        else F.lit(True).alias(f.name)
        if f.name == "is_inferred"
        else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name)
        for f in marked.schema
    ]
    return marked.unionByName(ghosts.select(*shaped))


def unknown_member(
    fact: DataFrame, fact_key: str, dim: DataFrame, key: str, sk: str, unknown: object
) -> DataFrame:
    """Resolve a surrogate key; facts without a member take the unknown key."""
    looked_up = dim.select(F.col(key).alias("_dk"), F.col(sk))
    joined = fact.join(looked_up, F.col(fact_key) == F.col("_dk"), "left").drop("_dk")
    return joined.withColumn(sk, F.coalesce(F.col(sk), F.lit(unknown)))


def bitemporal_asof(
    log: DataFrame, key: str, valid_ts: str, system_ts: str, valid_at: Column, known_at: Column,
    attrs: Sequence[str],
) -> DataFrame:
    """What the system knew at `known_at` to be true at `valid_at`: one row per key."""
    seen = log.filter((F.col(valid_ts) <= valid_at) & (F.col(system_ts) <= known_at))
    best = F.max_by(F.struct(valid_ts, system_ts, *attrs), F.struct(valid_ts, system_ts, *attrs))
    return seen.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def bitemporal_splice(
    log: DataFrame, key: str, valid_ts: str, system_ts: str, known_at: Column, attrs: Sequence[str], **scan
) -> DataFrame:
    """The version chain as known at `known_at`: a retroactive correction closes or splits the interval
    it falls into exactly at its own valid time."""
    newest = (
        log.filter(F.col(system_ts) <= known_at)
        .groupBy(key, valid_ts)
        .agg(F.max_by(F.struct(*attrs), F.struct(system_ts, *attrs)).alias("_a"))
        .select(key, valid_ts, "_a.*")
    )
    return scd2_build(newest, key, valid_ts, attrs, **scan)


def junk_key(flags: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("?")) for f in flags]))


def junk_dimension(fact: DataFrame, flags: Sequence[str], sk: str = "junk_sk") -> DataFrame:
    """Distinct flag combinations; the key is a hash, so facts are re-keyed without a join."""
    return fact.select(*flags).distinct().select(junk_key(flags).alias(sk), *flags)


def rekey_junk(fact: DataFrame, flags: Sequence[str], sk: str = "junk_sk") -> DataFrame:
    return fact.withColumn(sk, junk_key(flags)).drop(*flags)


def outrigger_join(fact: DataFrame, chain: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Follow (table, left key, right key) links from the fact to dimensions of coarser grain."""
    out = fact
    for dim, left, right in chain:
        out = out.join(dim, F.col(left) == F.col(right), "left")
    return out


def band(value: str, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """labels[i] for values below cuts[i]; the last label for the rest; NULL stays NULL."""
    c = F.when(F.col(value).isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        c = c.when(F.col(value) < cut, F.lit(label))
    return c.otherwise(F.lit(labels[-1]))


def mini_dimension(
    df: DataFrame, bands: Mapping[str, tuple[str, Sequence[float], Sequence[str]]], sk: str = "mini_sk"
) -> tuple[DataFrame, DataFrame]:
    """Band volatile attributes {band name: (column, cuts, labels)}. Returns (rows with mini key, mini dimension)."""
    banded = df.withColumns({name: band(*spec) for name, spec in bands.items()})
    keyed = banded.withColumn(sk, junk_key(list(bands)))
    return keyed, keyed.select(sk, *bands).distinct()


def closure_table(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """All (ancestor, descendant, depth_level, is_leaf) pairs of a hierarchy, self pairs at depth 0.

    One row per pair, at the length of its shortest path: a member reached over several parents counts once, and
    a cycle ends because its pairs are known (`cycle_members` reports it). A row without a parent only names a
    root. Pointer doubling: each round joins the exact 2^k-step links with all pairs known so far, so
    a tree of depth d takes log2(d) rounds.
    """
    links = edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant"))
    base = links.filter(F.col("ancestor").isNotNull() & F.col("descendant").isNotNull())
    pairs = durable(base.filter(F.col("ancestor") != F.col("descendant")).distinct().withColumn("depth_level", F.lit(1)))
    step = 1
    while True:
        jump = pairs.filter(F.col("depth_level") == step).select(
            F.col("ancestor").alias("_mid"), F.col("descendant").alias("_low")
        )
        reached = pairs.join(jump, F.col("descendant") == F.col("_mid")).filter(F.col("ancestor") != F.col("_low"))
        nearest = reached.groupBy("ancestor", F.col("_low").alias("descendant")).agg(F.min(F.col("depth_level") + step).alias("depth_level"))
        longer = durable(nearest.join(pairs.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti"))
        if longer.isEmpty():
            break
        pairs = pairs.unionByName(longer)
        step *= 2
    nodes = links.select(F.col("ancestor").alias("n")).unionByName(links.select(F.col("descendant").alias("n")))
    selves = nodes.filter("n is not null").distinct().select(
        F.col("n").alias("ancestor"), F.col("n").alias("descendant"), F.lit(0).alias("depth_level")
    )
    inner = base.select(F.col("ancestor").alias("_inner")).distinct()
    full = selves.unionByName(pairs)
    return full.join(inner, F.col("descendant") == F.col("_inner"), "left").select(
        "ancestor", "descendant", "depth_level", F.col("_inner").isNull().alias("is_leaf")
    )


def cycle_members(closure: DataFrame, edges: DataFrame, parent: str, child: str) -> DataFrame:
    """Members (`member`) that are above themselves: by a link to themselves, or over others."""
    proper = closure.filter("depth_level > 0").select("ancestor", "descendant")
    back = proper.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("descendant"))
    mutual = proper.join(back, ["ancestor", "descendant"], "left_semi").select(F.col("ancestor").alias("member"))
    own = edges.filter(F.col(parent) == F.col(child)).select(F.col(parent).alias("member"))
    return mutual.unionByName(own).distinct()


def hierarchy_rollup(closure: DataFrame, facts: DataFrame, key: str, measure: str, name: str) -> DataFrame:
    """Measure of each ancestor summed over itself and all its descendants."""
    per_node = facts.groupBy(key).agg(F.sum(measure).alias("_m"))
    joined = closure.join(per_node, F.col("descendant") == F.col(key))
    return joined.groupBy("ancestor").agg(F.sum("_m").alias(name), F.count(F.lit(1)).alias("member_count"))


def key_coverage(fact: DataFrame, fact_key: str, dim: DataFrame, key: str) -> DataFrame:
    """Rows of the fact and rows whose key the dimension has. Keys are counted before the join."""
    per_key = fact.groupBy(F.col(fact_key).alias("_fk")).agg(F.count(F.lit(1)).alias("_n"))
    known = dim.select(F.col(key).alias("_dk")).distinct()
    joined = per_key.join(known, F.col("_fk") == F.col("_dk"), "left")
    return joined.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("fact_rows"),
        F.coalesce(F.sum(F.when(F.col("_dk").isNotNull(), F.col("_n"))), F.lit(0)).alias("matched_rows"),
    )


def conformance_matrix(
    facts: Mapping[str, DataFrame],
    dims: Mapping[str, tuple[DataFrame, str]],
    links: Sequence[tuple[str, str, str]],
) -> DataFrame:
    """fact x role matrix of matched-key percentages. `links` are (fact, role = fact column, dimension)."""
    rows = None
    for fact, fact_key, dim in links:
        one = key_coverage(facts[fact], fact_key, *dims[dim])
        pct = F.when(F.col("fact_rows") > 0, F.col("matched_rows") * 100.0 / F.col("fact_rows"))
        one = one.select(F.lit(fact).alias("fact_name"), F.lit(dim).alias("dim_name"), pct.alias("pct"))
        rows = one if rows is None else rows.unionByName(one)
    # A fact may play one dimension in several roles; the weakest role is reported.
    return rows.groupBy("fact_name").pivot("dim_name", list(dims)).agg(F.min("pct"))


