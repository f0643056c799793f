"""CSV in and out, and the choice among sources."""

from __future__ import annotations

import logging
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyforge.schemas import BUSINESS

log = logging.getLogger(__name__)


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = BUSINESS) -> DataFrame:
    """All columns as text, so nothing is guessed; NA is a country code here, not a null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST")


def write_csv(df: DataFrame, path: str) -> None:
    """With a header and the word null for nulls."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="null")


class NoRecords(RuntimeError):
    pass


#: What a source fails with; other errors are mistakes of the caller's and go up.
FAILURES = (NoRecords, PySparkException, Py4JError, OSError)


def first_with_rows(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first source that gives rows without an error.

    Reads are lazy, so each source is read in full once and kept, and what is
    returned is not fetched again; the caller unpersists it when done. The last
    source's error is raised; without any rows anywhere NoRecords is.
    """
    for i, make in enumerate(sources):
        try:
            df = make().persist()
            if df.count():
                return df
            df.unpersist()
            raise NoRecords("the source has no records")
        except FAILURES as e:
            if i + 1 == len(sources):
                raise
            log.warning("source %d failed, trying the next: %s", i + 1, type(e).__name__)
    raise NoRecords("no sources")
