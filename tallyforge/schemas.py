"""Schemas and value domains of the transaction tables, each defined once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

#: The domains of the enumerated columns.
CURRENCIES = ("USD", "EUR", "GBP", "CHF", "JPY", "AUD", "CAD")
TYPES = ("debit", "credit")
STATUSES = ("completed", "pending", "failed", "reversed")
CATEGORIES = ("e-commerce", "travel", "food_and_beverage", "groceries", "electronics", "retail", "entertainment", "health", "transportation", "home_and_garden", "payroll", "transfer")

#: The business columns, and the ones that make two records the same, in the order in which they are hashed.
BUSINESS = ("transaction_id", "account_id", "transaction_date", "amount", "currency", "transaction_type", "merchant_name", "merchant_category", "status", "country_code")
NATURAL_KEY = BUSINESS[1:]

#: Dollars for one unit of each currency.
RATES = (
    ("USD", "US Dollar", "1.000000"),
    ("EUR", "Euro", "1.085000"),
    ("CAD", "Canadian Dollar", "0.735000"),
    ("GBP", "British Pound", "1.270000"),
    ("CHF", "Swiss Franc", "1.120000"),
    ("JPY", "Japanese Yen", "0.006700"),
    ("AUD", "Australian Dollar", "0.635000"),
)

#: What each column holds; tables carry it as the column's comment.
ABOUT = {
    "id": "number of the record at its source, if it has one",
    "transaction_id": "TXN- and four digits",
    "account_id": "ACC- and four digits",
    "transaction_date": "time in UTC, ISO 8601",
    "amount": "amount in the transaction's currency; above zero where valid",
    "currency": "one of " + ", ".join(CURRENCIES),
    "transaction_type": "one of " + ", ".join(TYPES),
    "merchant_name": "the other party; not blank where valid",
    "merchant_category": "one of the listed categories",
    "status": "one of " + ", ".join(STATUSES),
    "country_code": "two letters after ISO 3166-1",
    "natural_key_hash": "SHA-256 of the fields that make two records the same",
    "error_reason": "why the record was refused; reasons are joined by semicolons",
    "ingestion_timestamp": "time of the run that took the record in, in UTC",
    "max_transaction_date": "the newest transaction that was taken in",
    "last_run_timestamp": "time of the last run, in UTC",
    "records_ingested": "new records of the last run",
}


def described(schema: T.StructType) -> T.StructType:
    """The schema with the columns' comments."""
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {"comment": ABOUT[f.name]} if f.name in ABOUT else {}) for f in schema])


def table_name(layer: str | None, name: str, target: str = "default") -> str:
    """A table's own layer as it is written, or else the target one."""
    return f"{(layer or target).strip()}.{name}"


LANDING = T.StructType([T.StructField("id", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in BUSINESS], T.StructField("ingestion_timestamp", T.StringType(), False)])
RAW = T.StructType(
    [T.StructField("id", T.IntegerType()), *[T.StructField(c, T.DoubleType() if c == "amount" else T.StringType(), False) for c in BUSINESS], T.StructField("natural_key_hash", T.StringType(), False), T.StructField("ingestion_timestamp", T.StringType(), False)]
)
QUARANTINE = T.StructType([*LANDING.fields[:-1], T.StructField("error_reason", T.StringType(), False), LANDING.fields[-1]])
WATERMARK = T.StructType([T.StructField("max_transaction_date", T.StringType(), False), T.StructField("last_run_timestamp", T.StringType(), False), T.StructField("records_ingested", T.IntegerType(), False)])


def countries(spark: SparkSession) -> list[str]:
    """The assigned ISO 3166-1 alpha-2 codes, as the JVM's locale data list them."""
    return sorted(spark._jvm.java.util.Locale.getISOCountries())
