"""Duplicates by natural key: within a batch the first row wins, across batches the stored one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.keys import natural_key, shown, utc
from tallyforge.operators.rules import lenient_amount, validate
from tallyforge.schemas import BUSINESS, NATURAL_KEY, QUARANTINE, RAW


def key_hash() -> Column:
    """The natural key of a valid transaction. Times are normalised first, so both ways to write UTC agree."""
    fields = {c: F.col(c).cast("string") for c in NATURAL_KEY}
    fields["transaction_date"] = utc(F.col("transaction_date"))
    fields["amount"] = shown(lenient_amount(F.col("amount")))
    return natural_key(fields)


def first_wins(df: DataFrame, keys: list[str], order: list[str], name: str, winner: str = "winner") -> DataFrame:
    """Adds ``nth``, a row's place in its key group, and ``winner``, the first row's value of ``name``.

    ``order`` should be total; rows alike in all its columns are interchangeable.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).withColumn(winner, F.first(name).over(w.rowsBetween(W.unboundedPreceding, 0)))


def not_in(df: DataFrame, stored: DataFrame, key: str | list[str]) -> DataFrame:
    """The rows whose key is not stored. Adaptive execution broadcasts the stored keys where they are small."""
    keys = [key] if isinstance(key, str) else key
    return df.join(stored.select(*keys), keys, "left_anti")


def insert_new(df: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What an insert-only merge adds: the first row of each key that is not stored."""
    new = not_in(df, stored, key)
    return first_wins(new, [key], order, key).filter("nth = 1").drop("nth", "winner")


#: The order in which rows of a batch win.
ORDER = ["ingestion_timestamp", "transaction_date", "id", "transaction_id"]


def annotate(landing: DataFrame, stored_hashes: DataFrame) -> DataFrame:
    """Landing rows with ``natural_key_hash`` (of valid ones) and ``error_reason``, null for the rows to insert.

    Only valid rows take part in the search for duplicates. Invalid ones, which
    have no hash, do not pass through the window at all.
    """
    checked = validate(landing)
    bad = checked.filter("error_reason is not null").withColumn("natural_key_hash", F.lit(None).cast("string"))
    good = checked.filter("error_reason is null").withColumn("natural_key_hash", key_hash())
    known = stored_hashes.select("natural_key_hash").distinct().withColumn("stored", F.lit(True))
    good = first_wins(good.join(known, "natural_key_hash", "left"), ["natural_key_hash"], ORDER, "transaction_id")
    reason = F.when(F.col("stored"), F.lit("duplicate_of:existing_record")).when(F.col("nth") > 1, F.concat(F.lit("duplicate_of:"), F.col("winner")))
    return good.withColumn("error_reason", reason).drop("stored", "nth", "winner").unionByName(bad)


def classify(landing: DataFrame, stored_hashes: DataFrame, run_ts: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotated, raw rows to insert, rows to quarantine); all rows get the run's timestamp.

    Two sinks read the annotated rows; whoever runs both should persist them.
    """
    rows = annotate(landing, stored_hashes).withColumn("ingestion_timestamp", F.lit(run_ts))
    clean = rows.filter("error_reason is null")
    raw = clean.withColumn("amount", lenient_amount(F.col("amount"))).withColumn("transaction_date", utc(F.col("transaction_date")))
    refused = rows.filter("error_reason is not null")
    return rows, raw.select(*RAW.fieldNames()), refused.select(*[F.col(c).cast("string") if c in BUSINESS else F.col(c) for c in QUARANTINE.fieldNames()])
