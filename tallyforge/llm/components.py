"""Connected components of a table of links, by alternating star steps.

Each step is a minimum per node, aggregated before the shuffle, and a join; no
node's links are gathered in one place, and nothing comes to the driver but
whether a step changed anything. A table that a count shows to be small goes
through a union-find in one task instead, which saves the steps' many stages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import release, staged


#: Links, two numbers each, that one task joins.
SMALL_LINKS = 1 << 18


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, comp) of all ids in the links (u, v) of one task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    if ids:
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(map(root, ids), pa.int64())], names=["id", "comp"])


def _step(links: DataFrame, large: bool) -> DataFrame:
    """One star step on links (u, v) with u > v."""
    if large:  # every neighbour larger than u goes to the smallest of u and its neighbours
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its smaller neighbours go to the smallest of them
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        joined = links.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for each id in links (a, b); comp is the smallest id that can be reached. Ids are not null."""
    now = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    if now.count() <= SMALL_LINKS:
        out = staged(now.repartition(1).mapInArrow(_joined, "id long, comp long"), "components")
        release(now)
        return out
    state = None
    while True:
        last, now = now, staged(_step(_step(now, large=True), large=False), "links")
        release(last)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == state:
            break
        state = seen
    out = now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
    return staged(out, "components")
