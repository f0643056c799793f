"""The layers above raw transactions: history, star schema and daily accounts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.keys import surrogate_key
from tallyforge.operators.scd2 import scd2
from tallyforge.schemas import RATES

FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def silver(raw: DataFrame) -> DataFrame:
    """Typed transactions with their history."""
    typed = raw.withColumn("transaction_timestamp", F.to_timestamp("transaction_date", FORMAT)).withColumn("transaction_date", F.to_date("transaction_date", FORMAT)).drop("id")
    rows = scd2(typed, "transaction_id", "ingestion_timestamp", "natural_key_hash", ties=("transaction_timestamp",))
    return rows.select(
        surrogate_key("transaction_id", "natural_key_hash").alias("transaction_sk"), "transaction_id", "account_id", "transaction_timestamp", "transaction_date", "amount", "currency",
        "transaction_type", "merchant_name", "merchant_category", "status", "country_code", "natural_key_hash", "valid_from", "valid_to", "is_current", "version_number",
    )


def dim_account(history: DataFrame) -> DataFrame:
    return history.filter("is_current").select("account_id").distinct()


def dim_merchant(history: DataFrame) -> DataFrame:
    return history.filter("is_current").select("merchant_name").distinct().select(surrogate_key("merchant_name").alias("merchant_sk"), "merchant_name")


def dim_date(history: DataFrame, column: str = "transaction_date") -> DataFrame:
    """The calendar of all days that occur, in whatever version."""
    return history.select(F.col(column).alias("date_day")).distinct().select(
        "date_day", F.year("date_day").alias("year"), F.quarter("date_day").alias("quarter"), F.month("date_day").alias("month"), F.day("date_day").alias("day"), F.dayofweek("date_day").alias("day_of_week"),
        F.date_format("date_day", "EEEE").alias("day_name"), F.date_format("date_day", "MMMM").alias("month_name"), F.weekofyear("date_day").alias("week_of_year"),
    )


def dim_currency(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(a, b, Decimal(c)) for a, b, c in RATES], "currency_code string, currency_name string, usd_exchange_rate decimal(12,6)")
    return rows.select(surrogate_key("currency_code").alias("currency_sk"), "currency_code", "currency_name", "usd_exchange_rate")


def fact_transaction(history: DataFrame, merchants: DataFrame, currencies: DataFrame) -> DataFrame:
    """Current transactions in dollars. The currencies are a fixed short list; the merchants may be many."""
    t = history.filter("is_current").join(merchants, "merchant_name", "left").join(F.broadcast(currencies), F.col("currency") == F.col("currency_code"), "left")
    return t.select(
        "transaction_sk", "transaction_id", "account_id", "merchant_sk", "currency_sk", "transaction_date", F.col("amount").alias("amount_original"),
        F.round(F.col("amount") * F.col("usd_exchange_rate"), 2).alias("amount"), "currency", "transaction_type", "merchant_category", "status", "country_code",
    )


def daily_sums(df: DataFrame, account: str, day: str, kind: str, amount: str, category: str, counted: str, listed: str, debit, credit) -> DataFrame:
    """Per account and day: debits, credits, net, count, distinct ``counted``, top category, sorted ``listed``.

    The aggregate by category and ``counted`` feeds one by category and that one by
    day, so the input is read once; all combine before their shuffles, and no row
    holds a list that grows but that of ``listed``, whose values are few. Of a
    ``counted`` value's rows on a day the one of its least category counts.
    """
    a = F.col(amount)
    plus = lambda v: F.sum(F.when(F.col(kind) == v, a))
    each = df.groupBy(account, day, category, counted).agg(plus(debit).alias("d"), plus(credit).alias("c"), F.sum(a).alias("total"), F.count(F.lit(1)).alias("n"), F.collect_set(listed).alias("what"))
    first = F.row_number().over(W.partitionBy(account, day, counted).orderBy(category)) == 1
    each = each.withColumn("one", (first & F.col(counted).isNotNull()).cast("long"))
    by_category = each.groupBy(account, day, category).agg(*[F.sum(x).alias(x) for x in ("d", "c", "total", "n", "one")], F.collect_set("what").alias("what"))
    debits, credits = F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))
    # The largest total first and a null last, then the name.
    rank = F.struct(F.col("total").isNull(), -F.col("total"), F.col(category))
    return by_category.groupBy(account, day).agg(
        debits.alias("total_debit_amount"),
        credits.alias("total_credit_amount"),
        (credits - debits).alias("net_amount"),
        F.sum("n").alias("transaction_count"),
        F.sum("one").alias("distinct_merchants"),
        F.min_by(category, rank).alias("top_category"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("what"))))), ", ").alias("currencies"),
    )


def daily_account_summary(fact: DataFrame, merchants: DataFrame) -> DataFrame:
    """The daily accounts of completed transactions, in dollars."""
    done = fact.filter(F.lower("status") == "completed").join(merchants, "merchant_sk", "left")
    out = daily_sums(done, "account_id", "transaction_date", "transaction_type", "amount", "merchant_category", "merchant_name", "currency", "debit", "credit")
    return out.withColumn("updated_at", F.current_timestamp()).orderBy("account_id", "transaction_date")
