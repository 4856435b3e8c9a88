"""Column helpers shared by the operators. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL_TEXT = "9999-12-31 23:59:59"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    """Exact two-decimal amount; sums of it do not depend on row order."""
    return col(c).cast("decimal(18,2)")


def rate(c: str | Column) -> Column:
    return col(c).cast("decimal(5,2)")


def dbl(c: str | Column) -> Column:
    return col(c).cast("double")


def net_amount(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    return money(price) * (F.lit(1).cast("decimal(5,2)") - rate(discount))


def sentinel() -> Column:
    return F.lit(SENTINEL_TEXT).cast("timestamp_ntz")


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def date_key(c: str | Column) -> Column:
    """yyyymmdd as an int."""
    c = col(c)
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def month_key(c: str | Column) -> Column:
    c = col(c)
    return F.year(c) * 100 + F.month(c)


def ts_text(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def day_text(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def seconds(c: str | Column) -> Column:
    """Whole seconds since the epoch of a zone-less timestamp."""
    return F.unix_seconds(col(c).cast("timestamp"))


def micros(c: str | Column) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def md5_key(*parts: str | Column, sep: str = "-") -> Column:
    return F.md5(F.concat_ws(sep, *[col(p).cast("string") for p in parts]))


def business_key(c: str | Column) -> Column:
    return F.upper(F.trim(col(c).cast("string")))


def sha_key(*parts: str | Column, sep: str = "||") -> Column:
    """Business-key hash: trimmed, upper-cased, joined, SHA-256."""
    return F.sha2(F.concat_ws(sep, *[business_key(p) for p in parts]), 256)


def int_key(*parts: str | Column) -> Column:
    return F.xxhash64(*[col(p) for p in parts])


def unit_hash(*parts: str | Column) -> Column:
    """Uniform number in [0, 1) from the first 13 hex digits of an MD5: portable and seedable."""
    digest = md5_key(*parts, sep="|")
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def all_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def any_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def n_rows() -> Column:
    return F.count(F.lit(1))
