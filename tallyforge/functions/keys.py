"""Keys and canonical renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what stands for a null in a surrogate key.
NULL_KEY = "_dbt_utils_surrogate_key_null_"


def shown(amount: Column) -> Column:
    """A double as text: at least one decimal, at most eleven, no exponent.

    For amounts of up to eleven decimals this is the shortest form that reads
    back as the same number.
    """
    return F.call_function("format_number", amount, F.lit("0.0##########"))


def utc(stamp: Column) -> Column:
    """An ISO-8601 time with its zero offset written as Z."""
    return F.replace(stamp, F.lit("+00:00"), F.lit("Z"))


def natural_key(columns: dict[str, Column]) -> Column:
    """SHA-256 of the fields joined by a bar, in the order given. No field may be null."""
    return F.sha2(F.concat_ws("|", *columns.values()), 256)


def surrogate_key(*columns: str | Column) -> Column:
    """MD5 of the fields as text joined by a dash, nulls replaced."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit(NULL_KEY)) for c in cols]))
