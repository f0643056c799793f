"""Ordered validation rules as one expression: no row leaves the JVM, and all messages come from one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.keys import shown, utc
from tallyforge.schemas import BUSINESS, CATEGORIES, CURRENCIES, STATUSES, TYPES, countries

#: Plain decimal numbers; it keeps out NaN, infinities and the suffixes that a cast would take.
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule where ``bad`` is true, and then gets ``message``."""

    bad: Column
    message: Column


def valued(name: str, bad: Column, value: Column) -> Rule:
    return Rule(bad, F.concat(F.lit(f"{name}:"), value))


def lenient_amount(amount: Column) -> Column:
    """The amount as a double, null where the text is no plain number."""
    text = amount.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def valid_stamp(stamp: Column) -> Column:
    """Whether a text is a padded ISO-8601 UTC time of a real calendar day."""
    z = utc(stamp)
    return z.rlike(STAMP) & F.try_to_timestamp(z, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull()


def transaction_rules(df: DataFrame) -> list[Rule]:
    """The rules of transactions, in the order of their messages."""
    c = {n: F.col(n).cast("string") for n in BUSINESS}
    amount = lenient_amount(F.col("amount"))
    codes = countries(df.sparkSession)
    return [
        valued("invalid_transaction_id", ~c["transaction_id"].rlike(r"^TXN-[0-9]{4}\z"), c["transaction_id"]),
        valued("invalid_account_id", ~c["account_id"].rlike(r"^ACC-[0-9]{4}\z"), c["account_id"]),
        valued("invalid_transaction_date", ~valid_stamp(c["transaction_date"]), c["transaction_date"]),
        valued("non_positive_amount", amount <= 0, shown(amount)),
        valued("invalid_amount", amount.isNull() | (F.abs(amount) == float("inf")), c["amount"]),
        valued("invalid_currency", ~c["currency"].isin(*CURRENCIES), c["currency"]),
        valued("invalid_transaction_type", ~c["transaction_type"].isin(*TYPES), c["transaction_type"]),
        Rule(c["merchant_name"].rlike(r"^(?U)\s*\z"), F.lit("blank_merchant_name")),
        valued("invalid_merchant_category", ~c["merchant_category"].isin(*CATEGORIES), c["merchant_category"]),
        valued("invalid_status", ~c["status"].isin(*STATUSES), c["status"]),
        valued("invalid_country_code", ~c["country_code"].isin(*codes), c["country_code"]),
    ]


def error_reason(rules: list[Rule], required: tuple[str, ...] = ()) -> Column:
    """All messages of a row joined by "; ", null if it is clean. A missing required field hides the other rules."""
    missing = F.concat_ws("; ", *[F.when(F.col(c).isNull(), F.lit(f"missing_field:{c}")) for c in required]) if required else F.lit("")
    other = F.concat_ws("; ", *[F.when(r.bad, r.message) for r in rules])
    return F.nullif(F.when(missing != "", missing).otherwise(other), F.lit(""))


def validate(df: DataFrame) -> DataFrame:
    """Transactions with ``error_reason``, null for the valid ones."""
    return df.withColumn("error_reason", error_reason(transaction_rules(df), BUSINESS))
