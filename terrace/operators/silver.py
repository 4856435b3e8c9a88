"""Cleansing: de-duplication, casts, keys, contracts, quarantine and masking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.columns import all_of, any_of, md5_key

# fixed values: column-name fragments that mark sensitive data
PII_NAME_PARTS = ("ssn", "social_security", "credit_card", "password", "tax_id")

EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SSN_PATTERN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
PHONE_PATTERN = r"\+?[0-9][0-9 ()-]{7,}[0-9]"


def dedup_latest(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """First row of each key under `order_by` (a total order). Spark limits each map task to one row
    per key before the shuffle, so a hot key moves little data."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def clean_strings(df: DataFrame, trimmed: Sequence[str] = (), coded: Sequence[str] = ()) -> DataFrame:
    """TRIM names, UPPER(TRIM()) codes such as status, tier, type and id."""
    fixes = {c: F.trim(c) for c in trimmed} | {c: F.upper(F.trim(c)) for c in coded}
    return df.withColumns(fixes)


def cast_columns(df: DataFrame, spec: Mapping[str, tuple[str, object]]) -> DataFrame:
    """{column: (type, default)}: failed casts and NULLs take the default (None keeps NULL);
    columns that do not exist are added with the default."""
    out = {}
    for name, (typ, default) in spec.items():
        value = F.col(name).try_cast(typ) if name in df.columns else F.lit(None).cast(typ)
        out[name] = value if default is None else F.coalesce(value, F.lit(default).cast(typ))
    return df.withColumns(out)


def surrogate_key_md5(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.withColumn(name, F.md5(F.col(key).cast("string")))


def surrogate_key_versioned(df: DataFrame, key: str, ts: str, name: str) -> DataFrame:
    """Natural key and version time, so that every version has its own key."""
    stamp = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return df.withColumn(name, md5_key(key, stamp))


def surrogate_key_int64(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, F.xxhash64(*keys))


def collision_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys, and keys whose 64-bit hash another key shares."""
    hashed = surrogate_key_int64(df.select(*keys).distinct(), keys, "_h")
    per_hash = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("n"))
    return per_hash.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("distinct_keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("colliding_keys"),
    )


def holds(pred: Column) -> Column:
    """A contract rule holds only when it is true: NULL counts as a failure."""
    return F.coalesce(pred, F.lit(False))


def contract_filter(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return df.filter(all_of([holds(p) for p in rules.values()]))


def tag_rejects(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds `reject_reason`: the first failing rule, NULL for good rows. One pass serves both outputs."""
    reason = F.lit(None).cast("string")
    for text, pred in reversed(list(rules.items())):
        reason = F.when(~holds(pred), F.lit(f"FAILED_INVARIANT: {text}")).otherwise(reason)
    return df.withColumn("reject_reason", reason)


def quarantine_split(
    df: DataFrame, rules: Mapping[str, Column], seen_at: datetime | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with reason and quarantine time); together they are all rows."""
    tagged = tag_rejects(df, rules)
    stamp = F.lit(seen_at) if seen_at else F.current_timestamp()
    good = tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = tagged.filter(F.col("reject_reason").isNotNull()).withColumn("quarantined_at", stamp)
    return good, bad


def contract_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One aggregate over the data, one output row per rule BR-01, BR-02, ..."""
    preds = list(rules.items())
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(~holds(p)).alias(f"f{i}") for i, (_, p) in enumerate(preds)]
    rows = [
        F.struct(
            F.lit(f"BR-{i + 1:02d}").alias("rule_id"),
            F.lit(text).alias("description"),
            F.col("rows").alias("evaluated"),
            F.col(f"f{i}").alias("failed"),
            F.when(
                F.col("rows") > 0,
                (F.col("rows") - F.col(f"f{i}")).cast("double") * 100.0 / F.col("rows").cast("double"),
            ).alias("pass_pct"),
        )
        for i, (text, _) in enumerate(preds)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def message_rows(df: DataFrame, batch: int, source: str, text: Column, kind: str, data: Column) -> DataFrame:
    """Rows of a batch message log (type INFO or REJECT)."""
    return df.select(
        F.current_timestamp().alias("message_time"),
        F.lit(batch).alias("batch_id"),
        F.lit(source).alias("message_source"),
        text.alias("message_text"),
        F.lit(kind).alias("message_type"),
        data.alias("message_data"),
    )


def orphan_reject(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a parent, orphans). NULL keys are orphans."""
    parents = parent.select(F.col(parent_key).alias("_pk")).distinct()
    cond = F.col(key) == F.col("_pk")
    return df.join(parents, cond, "left_semi"), df.join(parents, cond, "left_anti")


def error_codes(df: DataFrame, pk: str, fk: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Adds `error_code`: E001_NULL_PK, else E002_ORPHAN_FK, else NULL."""
    parents = parent.select(F.col(parent_key).alias("_pk")).distinct()
    joined = df.join(parents, F.col(fk) == F.col("_pk"), "left")
    code = F.when(F.col(pk).isNull(), F.lit("E001_NULL_PK")).when(
        F.col("_pk").isNull(), F.lit("E002_ORPHAN_FK")
    )
    return joined.withColumn("error_code", code).drop("_pk")


def unmasked_pii_columns(df: DataFrame) -> list[str]:
    """Columns named like sensitive data whose field metadata names no masking policy."""
    return [
        f.name
        for f in df.schema
        if any(part in f.name.lower() for part in PII_NAME_PARTS) and not f.metadata.get("masking_policy")
    ]


def mask_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hash mask, recorded in the field metadata."""
    masked = df
    for c in columns:
        value = F.sha2(F.col(c).cast("string"), 256)
        masked = masked.withColumn(c, value.alias(c, metadata={"masking_policy": "hash_mask"}))
    return masked


def pii_value_scan(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per group whose whole text holds an e-mail, a social-security-like number or a phone number."""
    t = F.col(text)
    hits = {"email": EMAIL_PATTERN, "ssn": SSN_PATTERN, "phone": PHONE_PATTERN}
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(t.rlike(p)).alias(f"{name}_rows") for name, p in hits.items()],
        F.count_if(any_of([t.rlike(p) for p in hits.values()])).alias("any_rows"),
    )


def redact_text(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    for tag, pattern in (("EMAIL", EMAIL_PATTERN), ("SSN", SSN_PATTERN), ("PHONE", PHONE_PATTERN)):
        c = F.regexp_replace(c, pattern, f"<{tag}>")
    return c
