"""Full and incremental loads: landing, classification, and one commit of raw, quarantine and watermark."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.keys import utc
from tallyforge.operators.dedup import classify
from tallyforge.operators.rules import valid_stamp
from tallyforge.plans.store import TableStore
from tallyforge.schemas import BUSINESS, LANDING, QUARANTINE, RAW, WATERMARK, described, table_name

LAND, CLEAN, REFUSED, MARK = table_name("bronze_landing", "transactions"), table_name("bronze", "transactions"), table_name("bronze", "quarantine_transactions"), table_name(None, "ingestion_watermark")
TABLES = {LAND: LANDING, CLEAN: RAW, REFUSED: QUARANTINE, MARK: WATERMARK}
ABOUT_TABLES = {
    LAND: "records as they came, with the time of the run; only appended to",
    CLEAN: "valid records, one for each natural key",
    REFUSED: "records that broke rules or that repeat others; only appended to",
    MARK: "one row: how far the loads have come",
}
LOOKBACK_DAYS = 30
#: The mark of a store that has seen no date yet.
EPOCH = "1970-01-01T00:00:00Z"
_FORMAT = "%Y-%m-%dT%H:%M:%SZ"


def now() -> str:
    return datetime.now(timezone.utc).strftime(_FORMAT)


def ensure_tables(store: TableStore) -> None:
    """Makes the tables that are missing, with their schemas."""
    if not all(store.exists(t) for t in TABLES):
        with store.commit() as c:
            for table, schema in TABLES.items():
                c.create(table, described(schema), ABOUT_TABLES[table])


def land(store: TableStore, records: DataFrame, run_ts: str) -> str:
    """Appends records as they came, as text with nulls kept, under one timestamp."""
    have = set(records.columns)
    cols = [(F.col("id") if "id" in have else F.lit(None)).try_cast("int").alias("id")] + [(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in BUSINESS]
    with store.commit() as c:
        return c.append(LAND, records.select(*cols, F.lit(run_ts).alias("ingestion_timestamp")))


def watermark(store: TableStore) -> str | None:
    """The largest transaction date seen, None before the first run."""
    if not store.exists(MARK):
        return None
    row = store.read(MARK).first()
    return row.max_transaction_date if row else None


def fetch_from(mark: str | None, days: int = LOOKBACK_DAYS) -> str | None:
    """Where an incremental fetch starts: the mark less the lookback, None for everything."""
    return mark and (datetime.strptime(mark.replace("+00:00", "Z"), _FORMAT) - timedelta(days=days)).strftime(_FORMAT)


def process(store: TableStore, run_ts: str) -> dict:
    """Classifies the landing batches that no run has processed yet.

    Raw, quarantine, watermark and the list of processed batches change in one
    commit, which also holds the lock from the first read on. So a run that dies
    can simply be repeated, and no two runs process a batch. Stored records are
    searched within the dates of the new ones only, as the date is part of the key.
    """
    with store.commit() as c:
        done = c.noted("processed", [])
        todo = [b for b in c.batches(LAND) if b not in set(done)]
        landed = c.read(LAND, todo).drop("batch_id")
        day = F.when(valid_stamp(F.col("transaction_date")), utc(F.col("transaction_date")))
        span = landed.agg(F.min(day).alias("first"), F.max(day).alias("last")).first()
        stored = c.read(CLEAN).filter(F.col("transaction_date").between(span.first, span.last)) if span.first else c.read(CLEAN).limit(0)
        rows, raw, refused = classify(landed, stored, run_ts)
        rows.persist()  # read by both sinks and by the counts
        try:
            invalid = F.col("error_reason").isNotNull() & ~F.col("error_reason").startswith("duplicate_of:")
            told = rows.agg(
                F.count(F.lit(1)).alias("read"),
                F.count(F.when(F.col("error_reason").isNull(), 1)).alias("inserted"),
                F.count(F.when(invalid, 1)).alias("invalid"),
                F.max(F.when(F.col("error_reason").isNull(), F.replace("transaction_date", F.lit("+00:00"), F.lit("Z")))).alias("newest"),
            ).first()
            before = c.read(MARK).first()
            mark = max(told.newest or EPOCH, before.max_transaction_date if before else EPOCH)
            if told.inserted:
                # Sorted by date, so that later searches skip the row groups of other dates.
                c.append(CLEAN, raw.sortWithinPartitions("transaction_date"))
            if told.read - told.inserted:
                c.append(REFUSED, refused)
            c.overwrite(MARK, store.spark.createDataFrame([(mark, run_ts, told.inserted)], WATERMARK))
            c.note("processed", [*done, *todo])
        finally:
            rows.unpersist()
    return {"read": told.read, "inserted": told.inserted, "invalid": told.invalid, "duplicates": told.read - told.inserted - told.invalid, "watermark": mark, "run": run_ts}


def _load(store: TableStore, records: DataFrame, run_ts: str) -> dict:
    try:
        land(store, records, run_ts)
    finally:
        records.unpersist()  # a source may have kept what it read
    return process(store, run_ts)


def full_load(store: TableStore, source: Callable[[str | None], DataFrame], run_ts: str | None = None) -> dict:
    """Fetches everything, lands it and processes it."""
    run_ts = run_ts or now()
    ensure_tables(store)
    return _load(store, source(None), run_ts)


def incremental_load(store: TableStore, source: Callable[[str | None], DataFrame], run_ts: str | None = None, days: int = LOOKBACK_DAYS) -> dict:
    """Fetches from the watermark less the lookback on; late rows come again and old ones turn out as duplicates."""
    run_ts = run_ts or now()
    ensure_tables(store)
    return _load(store, source(fetch_from(watermark(store), days)), run_ts)


def reconcile(store: TableStore) -> DataFrame:
    """One row: what was landed and processed against what went to raw and to quarantine."""
    tables = {"landed": LAND, "raw": CLEAN, "quarantined": REFUSED}
    counts = [store.read(t).agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.lit(name)) for name, t in tables.items()]
    every = counts[0].unionByName(counts[1]).unionByName(counts[2])
    row = every.agg(*[F.sum(F.when(F.col("of") == name, F.col("n"))).alias(name) for name in tables])
    return row.withColumn("difference", F.col("landed") - F.col("raw") - F.col("quarantined"))
