"""Point-in-time lookups: interval joins and as-of joins that tolerate hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.ordered import HOT_ROWS, largest_group, ordered_scan

FEW_VERSIONS = 64


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    tie: Sequence[str] = (),
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Give each left row the newest right row of its key with right_ts <= left_ts.

    Both sides are stacked and scanned once in time order, so the work is linear in the rows whatever
    the number of matches. `tie` orders right rows of one time. NULL keys or times match nothing.
    """
    payload = F.struct(F.col(right_ts).alias("_rts"), *[F.col(v).alias(v) for v in values])
    order_cols = [F.col(c) for c in tie] or [F.lit(0)]
    r = right.filter(F.col(key).isNotNull() & F.col(right_ts).isNotNull()).select(
        F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"),
        F.struct(*order_cols).alias("_tie"), payload.alias("_payload"),
    )
    row = F.struct(*left.columns)
    l = left.select(
        F.col(key).alias("_k"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), row.alias("_row")
    )
    stacked = r.unionByName(l, allowMissingColumns=True)
    # The left row itself breaks ties among left rows; it changes no result, only balances slices.
    spread = F.xxhash64("_row") if left.columns else F.lit(0)
    stacked = stacked.withColumn("_spread", F.when(F.col("_side") == 1, spread).otherwise(F.lit(0)))
    scanned = ordered_scan(
        stacked, ["_k"], ["_t", "_side", "_tie", "_spread"], carry={"_hit": "_payload"}, hot_rows=hot_rows
    )
    live = F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.col("_hit"))
    out = scanned.filter(F.col("_side") == 1).withColumn("_hit", live)
    if how == "inner":
        out = out.filter(F.col("_hit").isNotNull())
    return out.select(
        "_row.*", F.col("_hit._rts").alias(f"matched_{right_ts}"), *[F.col(f"_hit.{v}").alias(v) for v in values]
    )


def pit_join(
    fact: DataFrame,
    fact_key: str,
    fact_ts: str,
    dim: DataFrame,
    key: str,
    values: Sequence[str],
    hot_rows: int = HOT_ROWS,
    few_versions: int = FEW_VERSIONS,
    most: int | None = None,
) -> DataFrame:
    """Left join of facts to the dimension version valid at the fact time (valid_from <= ts < valid_to).

    A fact takes the newest version that began by its time, provided that it had not ended: of overlapping
    versions the one with the largest (valid_from, valid_to, values) counts, so a fact stays one row. Columns:
    those of the fact, valid_from, valid_to, values. Versions without a key match nothing.

    With few versions per member the equi-join with a range residual is cheapest. With many, one hot
    member would multiply its facts by its versions, so the as-of scan is used instead; both give the same rows.
    `most`, a known bound of versions per member, saves counting them while it is small.
    """
    known = dim.filter(F.col(key).isNotNull())
    if most is None or most > few_versions:
        most = largest_group(known, [key])
    if most <= few_versions:
        following = Window.partitionBy("_dk").orderBy("valid_from", "valid_to", *values)
        versions = known.select(F.col(key).alias("_dk"), "valid_from", "valid_to", *values).withColumn(
            "_next", F.lead("valid_from").over(following)
        )
        cond = (
            (F.col(fact_key) == F.col("_dk"))
            & (F.col(fact_ts) >= F.col("valid_from"))
            & (F.col(fact_ts) < F.col("valid_to"))
            & (F.col("_next").isNull() | (F.col(fact_ts) < F.col("_next")))
        )
        return fact.join(versions, cond, "left").drop("_dk", "_next")
    renamed = known.select(F.col(key).alias(fact_key), "valid_from", "valid_to", *values)
    ends = ["valid_to", *values]
    hit = asof_join(fact, renamed, fact_key, fact_ts, "valid_from", ends, tie=ends, hot_rows=hot_rows)
    inside = F.col(fact_ts) < F.col("valid_to")
    found = {"valid_from": "matched_valid_from"} | {c: c for c in ends}
    return hit.select(*fact.columns, *[F.when(inside, F.col(source)).alias(c) for c, source in found.items()])
