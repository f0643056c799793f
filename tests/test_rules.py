import hashlib

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.keys import shown, surrogate_key
from tallyforge.operators.dedup import key_hash
from tallyforge.operators.rules import validate
from tallyforge.schemas import BUSINESS, NATURAL_KEY

GOOD = dict(transaction_id="TXN-0001", account_id="ACC-1001", transaction_date="2024-02-29T10:00:00Z", amount="12.5", currency="USD", transaction_type="debit", merchant_name="IKEA", merchant_category="retail", status="completed", country_code="NA")
SCHEMA = ", ".join(f"{c} string" for c in BUSINESS)

CASES = [
    ({}, None),
    ({"transaction_id": "TXN-001"}, "invalid_transaction_id:TXN-001"),
    ({"transaction_id": "TXN-0001\n"}, "invalid_transaction_id:TXN-0001\n"),
    ({"transaction_id": "TXN-٠٠٠١"}, "invalid_transaction_id:TXN-٠٠٠١"),
    ({"account_id": "acc-1001"}, "invalid_account_id:acc-1001"),
    ({"transaction_date": "2024-11-31T14:22:00Z"}, "invalid_transaction_date:2024-11-31T14:22:00Z"),
    ({"transaction_date": "2024-04-15 09:30:00"}, "invalid_transaction_date:2024-04-15 09:30:00"),
    ({"transaction_date": "2024-1-5T1:2:3Z"}, "invalid_transaction_date:2024-1-5T1:2:3Z"),
    ({"transaction_date": "2024-02-29T10:00:00+00:00"}, None),
    ({"amount": "0.00"}, "non_positive_amount:0.0"),
    ({"amount": "-127.50"}, "non_positive_amount:-127.5"),
    ({"amount": "nan"}, "invalid_amount:nan"),
    ({"amount": "inf"}, "invalid_amount:inf"),
    ({"amount": "1e999"}, "invalid_amount:1e999"),
    ({"amount": "1.5d"}, "invalid_amount:1.5d"),
    ({"amount": "ten"}, "invalid_amount:ten"),
    ({"currency": "usd"}, "invalid_currency:usd"),
    ({"transaction_type": "Credit"}, "invalid_transaction_type:Credit"),
    ({"merchant_name": " \t "}, "blank_merchant_name"),
    ({"merchant_category": "Finance"}, "invalid_merchant_category:Finance"),
    ({"status": "Completed"}, "invalid_status:Completed"),
    ({"country_code": "UK"}, "invalid_country_code:UK"),
    ({"currency": None, "status": None, "amount": "x"}, "missing_field:currency; missing_field:status"),
    ({"amount": "-1", "status": "x", "country_code": "EN"}, "non_positive_amount:-1.0; invalid_status:x; invalid_country_code:EN"),
]


def test_rules_and_their_order(spark):
    rows = [tuple((GOOD | change)[c] for c in BUSINESS) + (i,) for i, (change, _) in enumerate(CASES)]
    got = {r.i: r.error_reason for r in validate(spark.createDataFrame(rows, SCHEMA + ", i int")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_hash_is_of_the_fields_joined_by_bars(spark):
    rows = [tuple((GOOD | {"transaction_date": d, "amount": a})[c] for c in BUSINESS) for d, a in (("2024-02-29T10:00:00Z", "12.50"), ("2024-02-29T10:00:00+00:00", "12.5"))]
    got = [r[0] for r in spark.createDataFrame(rows, SCHEMA).select(key_hash()).collect()]
    want = hashlib.sha256("|".join((GOOD | {"amount": "12.5"})[c] for c in NATURAL_KEY).encode()).hexdigest()
    assert got == [want, want]


@pytest.mark.parametrize("x", [0.01, 7943.57, 1e7, 123456789.12, 0.0001, 5.0, 1e9])
def test_amounts_show_as_plain_decimals(spark, x):
    text = spark.range(1).select(shown(F.lit(x))).first()[0]
    assert float(text) == x and "e" not in text.lower() and "." in text


def test_surrogate_key_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", "b")], "x string, y string")
    keys = [r[0] for r in df.select(surrogate_key("x", "y")).collect()]
    assert len(set(keys)) == 3 and keys[2] == hashlib.md5(b"a-b").hexdigest()
