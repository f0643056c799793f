"""Slowly changing history of type 2: one row for each version of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the end of a version that is still current.
OPEN_END = "9999-12-31 00:00:00"


def scd2(df: DataFrame, key: str, order: str, hash_column: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Versions with version_number, valid_from, valid_to and is_current.

    Of rows with equal key and order the first by ``ties`` and then the hash
    stays. Rows whose hash equals the one before start no version. All windows
    work on the one partitioning by key, so there is one shuffle.
    """
    by = W.partitionBy(key).orderBy(order)
    rows = df.repartition(key)
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(key, order).orderBy(*ties, hash_column))).filter("_n = 1")
    rows = rows.withColumn("_before", F.lag(hash_column).over(by)).filter(F.col("_before").isNull() | (F.col("_before") != F.col(hash_column)))
    rows = rows.withColumn("_next", F.lead(F.col(order).cast("timestamp")).over(by))
    return rows.select(
        *df.columns,
        F.row_number().over(by).alias("version_number"),
        F.col(order).cast("timestamp").alias("valid_from"),
        F.coalesce("_next", F.lit(OPEN_END).cast("timestamp")).alias("valid_to"),
        F.col("_next").isNull().alias("is_current"),
    )
