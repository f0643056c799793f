"""The incremental load as a stream: each micro-batch of landed files is one committed run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans.ingest import ensure_tables, land, now, process
from tallyforge.plans.store import TableStore
from tallyforge.schemas import BUSINESS


def load_stream(spark: SparkSession, store: TableStore, folder: str, checkpoint: str) -> list[dict]:
    """Takes in the CSV files that are new in ``folder`` and returns the runs' counts.

    A micro-batch that is repeated after a failure brings its records again; they
    turn out as duplicates, so raw holds each record once.
    """
    ensure_tables(store)
    runs: list[dict] = []

    def take(batch: DataFrame, _: int) -> None:
        run_ts = now()
        land(store, batch, run_ts)
        runs.append(process(store, run_ts))

    schema = ", ".join(f"{c} string" for c in BUSINESS)
    stream = spark.readStream.schema(schema).option("header", True).csv(folder)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return runs
