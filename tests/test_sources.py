import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tallyforge.schemas import LANDING
from tallyforge.sources.files import NoRecords, first_with_rows, read_csv, write_csv
from tallyforge.sources.rest import PagedRest, get_page

ROWS = [{"id": i, "transaction_id": f"TXN-{i:04d}", "transaction_date": f"2024-01-{i % 28 + 1:02d}T00:00:00Z", "amount": i + 0.5, "ingestion_timestamp": "x"} for i in range(250)]


class Server(BaseHTTPRequestHandler):
    fails = 0
    asked: list = []

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        if self.headers.get("apikey") != "k" or self.headers.get("Authorization") != "Bearer k":
            return self.send(401, b"")
        if Server.fails:
            Server.fails -= 1
            return self.send(503, b"")
        Server.asked.append(q)
        rows = [r for r in ROWS if "transaction_date" not in q or r["transaction_date"] >= q["transaction_date"][4:]]
        self.send(200, json.dumps(rows[int(q["offset"]) : int(q["offset"]) + int(q["limit"])]).encode())

    def send(self, status, body):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture
def url(spark, monkeypatch):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedRest)
    Server.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}/t"
    server.shutdown()


def load(spark, url, **options):
    # Workers see the environment in which the session began, so the key's name leads to what is set there.
    return spark.read.format("paged_rest").schema(LANDING).options(url=url, keyEnv="TALLYFORGE_TEST_KEY", waitScale="0", **options).load()


@pytest.fixture(autouse=True)
def key(monkeypatch):
    monkeypatch.setattr("tallyforge.sources.rest.os.environ", {"TALLYFORGE_TEST_KEY": "k"}, raising=False)


def reader(url, **options):
    return PagedRest({"url": url, "keyEnv": "TALLYFORGE_TEST_KEY", "waitScale": "0", **options}).reader(LANDING)


def scan(r):
    return [x for p in r.partitions() for x in r.read(p)]


def test_pages(url):
    got = scan(reader(url))
    assert [x[0] for x in got] == list(range(250)) and got[0][4] == "0.5" and got[0][2] is None
    assert [q["offset"] for q in Server.asked] == ["0", "100", "200"] and Server.asked[0]["order"] == "transaction_date.asc"


def test_retry_bound_and_split(url):
    Server.fails = 2
    assert {x[3][:10] for x in scan(reader(url, fromDate="2024-01-27T00:00:00Z"))} == {"2024-01-27", "2024-01-28"}
    split = reader(url, total="250", partitions="3", pageSize="50")
    assert len(split.partitions()) == 3 and sorted(x[0] for x in scan(split)) == list(range(250))


def test_pushed_bound(url):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

    r = reader(url)
    left = list(r.pushFilters([GreaterThanOrEqual(("transaction_date",), "2024-01-28T00:00:00Z"), EqualTo(("id",), 1)]))
    assert len(left) == 2 and {x[3][:10] for x in scan(r)} == {"2024-01-28"}


def test_status_codes():
    answers = iter([(429, b""), (500, b""), (200, b"[1]")])
    waits = []
    assert get_page("u", {}, get=lambda *a: next(answers), sleep=waits.append) == [1] and waits == [1, 2]
    assert get_page("u", {}, get=lambda *a: (400, b"")) == []
    with pytest.raises(PermissionError):
        get_page("u", {}, get=lambda *a: (401, b""))
    with pytest.raises(RuntimeError, match="404"):
        get_page("u", {}, get=lambda *a: (404, b""))
    waits.clear()

    def broken(*a):
        raise TimeoutError

    with pytest.raises(RuntimeError, match="tries"):
        get_page("u", {}, get=broken, sleep=waits.append, tries=8)
    assert waits == [1, 2, 4, 8, 16, 32, 60, 60]


def test_through_spark_and_failover(spark, url, tmp_path):
    (tmp_path / "a.csv").write_text("transaction_id,account_id,transaction_date,amount,currency,transaction_type,merchant_name,merchant_category,status,country_code\r\nTXN-0001,A,d,1.0,USD,debit,m,retail,completed,NA\r\n")
    csv = lambda: read_csv(spark, f"file://{tmp_path}/a.csv")
    # The workers lack the key, so the endpoint refuses them and the file steps in.
    got = first_with_rows(lambda: load(spark, url), csv)
    assert [(r.transaction_id, r.country_code) for r in got.collect()] == [("TXN-0001", "NA")]
    with pytest.raises(NoRecords):
        first_with_rows(lambda: csv().filter("false"))


def test_csv_out(spark, tmp_path):
    write_csv(spark.createDataFrame([(None, "x")], "id int, v string").coalesce(1), f"file://{tmp_path}/out")
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == "id,v\nnull,x\n"
