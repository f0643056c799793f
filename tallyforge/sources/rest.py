"""A paginated REST endpoint as a Python data source.

    spark.dataSource.register(PagedRest)
    spark.read.format("paged_rest").schema(...).option("url", ...).option("keyEnv", "API_KEY").load()

Pages are asked for by limit and offset until one is short. The total is unknown
beforehand, so it is one partition by default; a known ``total`` splits the
offsets over ``partitions`` tasks.
"""

from __future__ import annotations

import json
import math
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

TRIES, TIMEOUT, LONGEST_WAIT, PAGE = 5, 30, 60, 100


def http_get(url: str, headers: dict[str, str], timeout: float) -> tuple[int, bytes]:
    """Status and body; connection errors and timeouts raise OSError."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def get_page(url: str, headers: dict[str, str], get: Callable = http_get, sleep: Callable = time.sleep, tries: int = TRIES, timeout: float = TIMEOUT) -> list[dict]:
    """One page. 429, 5xx, timeouts and broken connections are tried again after 1, 2, 4 ... seconds; 400 ends the scan; any other status is an error."""
    for n in range(tries):
        try:
            status, body = get(url, headers, timeout)
        except OSError:
            status, body = 0, b""
        if status == 200:
            return json.loads(body)
        if status == 400:
            return []
        if status == 401:
            raise PermissionError("HTTP 401: the key was refused")
        if status not in (0, 429) and status < 500:
            raise RuntimeError(f"HTTP {status}")
        sleep(min(2**n, LONGEST_WAIT))
    raise RuntimeError(f"no answer after {tries} tries")


class _Span(InputPartition):
    def __init__(self, first: int, end: int | None) -> None:
        self.first, self.end = first, end


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options
        self.since = options.get("fromDate")
        self.column = options.get("dateColumn", "transaction_date")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes a lower bound on the date column; Spark applies it again, so an endpoint that ignores it does no harm."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == (self.column,) and isinstance(f.value, str):
                self.since = max(self.since or "", f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        total, n = int(self.options.get("total", 0)), int(self.options.get("partitions", 1))
        if not total or n <= 1:
            return [_Span(0, None)]
        page = int(self.options.get("pageSize", PAGE))
        step = math.ceil(total / n / page) * page
        return [_Span(a, a + step if a + step < total else None) for a in range(0, total, step)]

    def read(self, span: _Span) -> Iterator[tuple]:
        o = self.options
        page, at = int(o.get("pageSize", PAGE)), span.first
        key = os.environ.get(o.get("keyEnv", ""), "")  # keys stay in the environment, out of plans and logs
        headers = {"apikey": key, "Authorization": f"Bearer {key}"} if key else {}
        scale = float(o.get("waitScale", 1))
        while span.end is None or at < span.end:
            params = {"limit": page, "offset": at, "order": f"{o.get('orderColumn', self.column)}.{o.get('orderDirection', 'asc')}"}
            if self.since:
                params[self.column] = f"gte.{self.since}"
            rows = get_page(f"{o['url']}?{urllib.parse.urlencode(params)}", headers, sleep=lambda s: time.sleep(s * scale), timeout=float(o.get("timeout", TIMEOUT)))
            for r in rows:
                yield tuple(_typed(r.get(f.name), f.dataType) for f in self.schema)
            if len(rows) < page:
                return
            at += page


def _typed(x, kind):
    if x is None:
        return None
    if isinstance(kind, StringType):
        return x if isinstance(x, str) else json.dumps(x)
    if isinstance(kind, IntegerType | LongType):
        return int(x)
    return float(x) if isinstance(kind, DoubleType) else x


class PagedRest(DataSource):
    """Options: url, keyEnv, pageSize, orderColumn, orderDirection, fromDate, dateColumn, timeout, total, partitions, waitScale."""

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        raise ValueError("give the schema with .schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))
