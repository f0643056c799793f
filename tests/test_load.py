import pytest

from tallyforge.operators.checks import ChecksFailed
from tallyforge.plans import dag
from tallyforge.plans import ingest as I
from tallyforge.plans.store import TableStore
from tallyforge.schemas import BUSINESS
from tallyforge.streaming.landing import load_stream

SCHEMA = "id string, " + ", ".join(f"{c} string" for c in BUSINESS)


def txn(n, date="2024-03-01T10:00:00Z", amount="10.00", currency="EUR", kind="debit", category="retail", status="completed", account="ACC-1001", merchant="Shop", tid=None):
    return (str(n), tid or f"TXN-{n:04d}", account, date, amount, currency, kind, merchant, category, status, "NL")


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/store")


def rows(spark, *records):
    return lambda since: spark.createDataFrame([r for r in records if not since or r[3] >= since], SCHEMA)


def test_loads(spark, store):
    first = [txn(1), txn(2, amount="-5"), txn(3, date="2024-03-20T00:00:00Z"), txn(4)]  # 4 repeats 1 but for its id
    got = I.full_load(store, rows(spark, *first), "2024-04-01T00:00:00Z")
    assert (got["read"], got["inserted"], got["invalid"], got["duplicates"], got["watermark"]) == (4, 2, 1, 1, "2024-03-20T00:00:00Z")
    reasons = {r.transaction_id: r.error_reason for r in store.read(I.REFUSED).collect()}
    assert reasons == {"TXN-0002": "non_positive_amount:-5.0", "TXN-0004": "duplicate_of:TXN-0001"}
    again = I.incremental_load(store, rows(spark, *first), "2024-04-02T00:00:00Z")
    assert (again["inserted"], again["duplicates"]) == (0, 3)
    # Late, within the lookback; changed; and too old to be fetched.
    late = I.incremental_load(store, rows(spark, txn(5, date="2024-03-05T00:00:00Z"), txn(1, amount="99", date="2024-03-02T00:00:00Z"), txn(6, date="2024-01-01T00:00:00Z")), "2024-04-03T00:00:00Z")
    assert late["inserted"] == 2 and late["watermark"] == "2024-03-20T00:00:00Z"
    assert I.reconcile(store).first().difference == 0
    history = dag.w.silver(store.read(I.CLEAN).drop("batch_id")).filter("transaction_id = 'TXN-0001'").collect()
    assert sorted((r.version_number, r.amount, r.is_current) for r in history) == [(1, 10.0, False), (2, 99.0, True)]


def test_a_run_that_dies_leaves_the_tables_and_can_be_repeated(spark, store, monkeypatch):
    I.ensure_tables(store)
    I.land(store, rows(spark, txn(1))(None), "t")
    with pytest.raises(ZeroDivisionError), store.commit() as c:
        c.append(I.CLEAN, store.read(I.CLEAN).drop("batch_id"))
        1 / 0  # noqa: B018
    assert store.batches(I.CLEAN) == [] and I.watermark(store) is None
    assert I.process(store, "t")["inserted"] == 1 and I.process(store, "t")["read"] == 0


def test_one_writer_at_a_time_and_no_nulls(spark, store):
    I.ensure_tables(store)
    with store.commit(), pytest.raises(RuntimeError, match="another writer"), store.commit():
        pass
    with pytest.raises(Exception, match="null in"), store.commit() as c:
        c.append(I.MARK, spark.createDataFrame([(None, "x", 1)], "max_transaction_date string, last_run_timestamp string, records_ingested int"))


def test_warehouse_and_daily_accounts(spark, store):
    I.full_load(
        store,
        rows(
            spark,
            txn(1, amount="10", currency="EUR"), txn(2, amount="5.55", currency="USD", kind="credit", category="travel", merchant="Air"), txn(3, amount="3", currency="GBP", category="travel"),
            txn(4, amount="7", status="pending"), txn(5, amount="1", currency="USD", date="2024-03-02T00:00:00Z"),
        ),
        "2024-04-01T00:00:00Z",
    )
    made = dag.build(store)
    assert made.index(dag.SILVER) < made.index("gold.fact_transaction") < made.index(dag.MART)
    got = {str(r.transaction_date): r for r in store.read(dag.MART).collect()}
    day = got["2024-03-01"]
    assert (day.total_debit_amount, day.total_credit_amount) == (10.85 + 3.81, 5.55)
    assert abs(day.net_amount - (5.55 - 14.66)) < 1e-9
    assert (day.transaction_count, day.distinct_merchants, day.top_category, day.currencies) == (3, 2, "retail", "EUR, GBP, USD")
    assert got["2024-03-02"].total_credit_amount == 0 and got["2024-03-02"].currencies == "USD"
    assert {r.day_of_week for r in store.read("gold.dim_date").collect()} == {6, 7}


def test_a_failed_check_stops_the_build(spark, store):
    I.full_load(store, rows(spark, txn(1, date="2025-01-01T00:00:00Z")), "2025-02-01T00:00:00Z")
    with pytest.raises(ChecksFailed, match="between"):
        dag.build(store)
    assert not store.exists(dag.MART)


def test_overwrite_and_compact(spark, store):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    with store.commit() as c:
        c.overwrite("x.t", df)
    with store.commit() as c:
        c.append("x.t", df)
        c.insert_new("x.t", spark.createDataFrame([(1, "z"), (2, "b"), (2, "c")], df.schema), "k", ["v"])
    assert sorted((r.k, r.v) for r in store.read("x.t").collect()) == [(1, "a"), (1, "a"), (2, "b")]
    with store.commit() as c:
        c.compact("x.t")
    assert len(store.batches("x.t")) == 1 and store.read("x.t").count() == 3


def test_stream(spark, store, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    head = ",".join(BUSINESS)
    (inbox / "a.csv").write_text(head + "\n" + ",".join(txn(1)[1:]) + "\n")
    assert [r["inserted"] for r in load_stream(spark, store, f"file://{inbox}", f"file://{tmp_path}/cp")] == [1]
    (inbox / "b.csv").write_text(head + "\n" + ",".join(txn(1)[1:]) + "\n" + ",".join(txn(2, amount="4")[1:]) + "\n")
    assert [(r["inserted"], r["duplicates"]) for r in load_stream(spark, store, f"file://{inbox}", f"file://{tmp_path}/cp")] == [(1, 1)]


def test_compaction_keeps_what_was_processed(spark, store):
    I.full_load(store, rows(spark, txn(1)), "2024-04-01T00:00:00Z")
    I.incremental_load(store, rows(spark, txn(1), txn(2, date="2024-03-02T00:00:00Z")), "2024-04-02T00:00:00Z")
    I.land(store, rows(spark, txn(3, date="2024-03-03T00:00:00Z"))(None), "2024-04-03T00:00:00Z")  # not processed yet
    with store.commit() as c:
        assert len(c.compact(I.LAND)) == 2 and len(c.compact(I.CLEAN)) == 1
    got = I.process(store, "2024-04-03T00:00:00Z")
    assert (got["read"], got["inserted"], got["duplicates"]) == (1, 1, 0)
    assert I.process(store, "2024-04-04T00:00:00Z")["read"] == 0
    assert I.reconcile(store).first().difference == 0 and store.read(I.CLEAN).count() == 3


def test_two_writers(spark, store):
    I.full_load(store, rows(spark, txn(1)), "2024-04-01T00:00:00Z")
    I.land(store, rows(spark, txn(2))(None), "2024-04-02T00:00:00Z")
    with store.commit(), pytest.raises(RuntimeError, match="another writer"):
        I.process(store, "2024-04-02T00:00:00Z")
    assert I.process(store, "2024-04-02T00:00:00Z")["read"] == 1
    assert I.process(store, "2024-04-02T00:00:00Z")["read"] == 0


def test_stored_records_are_searched_once_and_by_date(spark, store, capsys):
    from tallyforge.operators.dedup import classify

    I.full_load(store, rows(spark, *[txn(n, date=f"2024-03-{n:02d}T00:00:00Z") for n in range(1, 20)]), "2024-04-01T00:00:00Z")
    stored = store.read(I.CLEAN).filter("transaction_date between '2024-03-05T00:00:00Z' and '2024-03-06T00:00:00Z'")
    landed = store.read(I.LAND).drop("batch_id")
    classify(landed, stored, "x")[1].explain("formatted")
    plan = capsys.readouterr().out
    tree = plan[: plan.index("\n\n")]
    assert tree.count("Join") == 1 and "GreaterThanOrEqual(transaction_date,2024-03-05" in plan


def test_vacuum(spark, store, tmp_path):
    for day in (1, 2, 3):
        I.incremental_load(store, rows(spark, txn(day, date=f"2024-03-0{day}T00:00:00Z")), f"2024-04-0{day}T00:00:00Z")
    before = {t: store.read(t).count() for t in I.TABLES}
    gone = store.vacuum(keep=1)
    assert gone and all(x.startswith(I.MARK) for x in gone) and store.vacuum(keep=1) == []
    assert {t: store.read(t).count() for t in I.TABLES} == before
    assert len(list((tmp_path / "store/_manifest").glob("*.json"))) == 1


def test_tables_are_made_once_and_described(spark, store):
    I.ensure_tables(store)
    versions = store._versions()
    I.ensure_tables(store)
    assert store._versions() == versions
    told = {r.name: r for r in store.describe(I.CLEAN).collect()}
    assert told[I.CLEAN].comment and told["amount"].required and told["amount"].type == "double" and all(told[c].comment for c in BUSINESS)


def test_three_made_up_records(spark, store):
    """One new record, one that breaks two rules, and one with an id that exists but another key; a second run adds none of them."""
    I.full_load(store, rows(spark, txn(160, merchant="IKEA")), "2024-04-01T00:00:00Z")
    made_up = [
        ("1", "TXN-9901", "ACC-1001", "2024-04-05T10:30:00Z", "250.00", "USD", "debit", "SyntheticMerchant", "retail", "completed", "US"),
        ("2", "TXN-9902", "ACC-1002", "2024-04-10T14:00:00Z", "-999.99", "INVALID_CUR", "debit", "BadMerchant", "retail", "completed", "US"),
        ("3", "TXN-0160", "ACC-1005", "2024-04-15T09:00:00Z", "5000.00", "USD", "credit", "IKEA", "home_and_garden", "completed", "NL"),
    ]

    def insert(run_ts):
        if store.read(I.LAND).filter("transaction_id in ('TXN-9901', 'TXN-9902')").isEmpty():
            I.land(store, spark.createDataFrame(made_up, SCHEMA), run_ts)
        return I.process(store, run_ts)

    got = insert("2024-04-16T00:00:00Z")
    assert (got["read"], got["inserted"], got["invalid"], got["watermark"]) == (3, 2, 1, "2024-04-15T09:00:00Z")
    assert [r.error_reason for r in store.read(I.REFUSED).collect()] == ["non_positive_amount:-999.99; invalid_currency:INVALID_CUR"]
    assert store.read(I.CLEAN).filter("transaction_id = 'TXN-0160'").select("natural_key_hash").distinct().count() == 2
    assert insert("2024-04-17T00:00:00Z")["read"] == 0
