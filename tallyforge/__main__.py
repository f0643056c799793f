"""python -m tallyforge STORE {full,incremental,build,show,export} [CSV]: runs the pipeline from a CSV file or the REST endpoint in API_URL; export writes the daily accounts and the quarantine as CSV below the folder CSV."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import functions as F

from tallyforge.plans.dag import MART, build
from tallyforge.plans.ingest import LAND, REFUSED, full_load, incremental_load, reconcile
from tallyforge.plans.store import TableStore
from tallyforge.schemas import LANDING
from tallyforge.session import session
from tallyforge.sources.files import first_with_rows, read_csv, write_csv
from tallyforge.sources.rest import PagedRest


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("store")
    p.add_argument("what", choices=["full", "incremental", "build", "show", "export"])
    p.add_argument("csv", nargs="?")
    args = p.parse_args()
    spark = session()
    spark.dataSource.register(PagedRest)
    store = TableStore(spark, args.store)

    def source(since):
        ways = []
        if url := os.environ.get("API_URL"):
            reader = spark.read.format("paged_rest").schema(LANDING).option("url", url).option("keyEnv", "API_KEY")
            ways.append(lambda: (reader.option("fromDate", since) if since else reader).load())
        if args.csv:
            ways.append(lambda: read_csv(spark, args.csv))
        return first_with_rows(*ways)

    if args.what in ("full", "incremental"):
        print(json.dumps((full_load if args.what == "full" else incremental_load)(store, source)))
        reconcile(store).show()
    elif args.what == "build":
        print(build(store))
    elif args.what == "export":
        for name in (MART, REFUSED):
            write_csv(store.read(name).drop("batch_id"), f"{args.csv}/{name}")
    else:
        store.read(LAND).limit(10).show()
        store.read(MART).orderBy(F.col("account_id"), F.col("transaction_date")).show()


if __name__ == "__main__":
    main()
