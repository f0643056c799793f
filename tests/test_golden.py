"""The known outcomes of a set of records that may lie in a folder beside the repository, found by the columns of its files."""

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.dedup import annotate
from tallyforge.plans import ingest as I
from tallyforge.plans import warehouse as w
from tallyforge.plans.store import TableStore
from tallyforge.schemas import BUSINESS, LANDING, NATURAL_KEY
from tallyforge.sources.files import read_csv



def _files() -> dict[str, str]:
    """The CSV files there, by what their columns say they hold."""
    at = os.environ.get("RECORDS_DIR", os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "reference"))
    out = {}
    for path in sorted(glob.glob(f"{at}/**/*.csv", recursive=True)):
        with open(path, newline="") as f:
            names = next(csv.reader(f), [])
        kind = "records" if names == list(BUSINESS) else "refused" if "error_reason" in names else "accounts" if "net_amount" in names else None
        if kind:
            out.setdefault(kind, path)
    return out


FILES = _files()
pytestmark = pytest.mark.skipif(len(FILES) < 3, reason="the records are not here")


def test_records_of_the_file(spark, tmp_path):
    """344 clean, 3 invalid and 5 duplicates, with their reasons."""
    store = TableStore(spark, f"file://{tmp_path}/store")
    with open(FILES["records"], newline="") as f:
        rows = [(i, *[r[c] for c in BUSINESS], "2024-05-01T00:00:00Z") for i, r in enumerate(csv.DictReader(f), 1)]
    # Numbered by line, so that the first in the file wins.
    landing = spark.createDataFrame(rows, LANDING)
    assert read_csv(spark, f"file://{FILES['records']}").count() == len(rows) == 352
    got = annotate(landing, spark.createDataFrame([], "natural_key_hash string"))
    reasons = {r.transaction_id: r.error_reason for r in got.filter("error_reason is not null").collect()}
    assert got.count() == 352 and len(reasons) == 8
    assert reasons["TXN-0345"] == "invalid_transaction_date:2024-11-31T14:22:00Z; invalid_merchant_category:fast_food; invalid_country_code:UK"
    assert reasons["TXN-0346"] == "invalid_transaction_date:2024-04-15 09:30:00; non_positive_amount:-127.5; blank_merchant_name; invalid_status:Completed"
    assert reasons["TXN-0347"] == "non_positive_amount:0.0; invalid_transaction_type:Credit; invalid_merchant_category:Finance; invalid_country_code:EN"
    assert {k: v for k, v in reasons.items() if "duplicate" in v} == {f"TXN-{a:04d}": f"duplicate_of:TXN-{b:04d}" for a, b in ((62, 348), (68, 350), (37, 352), (351, 245), (349, 217))}
    told = I.full_load(store, lambda since: landing.drop("ingestion_timestamp"), "2024-05-01T00:00:00Z")
    assert (told["read"], told["inserted"], told["invalid"], told["duplicates"]) == (352, 344, 3, 5)
    assert I.reconcile(store).first().difference == 0


def test_daily_accounts_of_march(spark):
    """The 87 account days of March 2024 that follow from the records at hand."""
    with open(FILES["refused"], newline="") as f:
        rows = list(csv.DictReader(f))[3:129]
    records = spark.createDataFrame([tuple(r[c] for c in BUSINESS) for r in rows], ", ".join(f"{c} string" for c in BUSINESS)).dropDuplicates(list(NATURAL_KEY))
    assert len(rows) == 126 and records.count() == 123
    raw = records.withColumn("amount", F.col("amount").cast("double")).withColumn("natural_key_hash", F.sha2(F.concat_ws("|", *NATURAL_KEY), 256)).withColumn("ingestion_timestamp", F.lit("2026-03-24T14:08:58Z")).withColumn("id", F.lit(1))
    # One version for each record, whatever its id.
    raw = raw.withColumn("transaction_id", F.col("natural_key_hash"))
    history = w.silver(raw)
    merchants = w.dim_merchant(history)
    got = {(r.account_id, str(r.transaction_date)): r for r in w.daily_account_summary(w.fact_transaction(history, merchants, w.dim_currency(spark)), merchants).collect()}
    with open(FILES["accounts"], newline="") as f:
        want = [r for r in csv.DictReader(f) if "2024-03-02" <= r["transaction_date"] <= "2024-03-31"]
    assert len(want) == 87
    for r in want:
        x = got[r["account_id"], r["transaction_date"]]
        assert all(abs(float(r[c]) - float(x[c])) < 0.005 for c in ("total_debit_amount", "total_credit_amount", "net_amount"))
        assert (int(r["transaction_count"]), int(r["distinct_merchants"]), r["top_category"], r["currencies"]) == (x.transaction_count, x.distinct_merchants, x.top_category, x.currencies)
