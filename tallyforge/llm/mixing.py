"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target number of words. A document is taken as many times as the
target holds its source whole, and once more with the probability that is left.
These draws are balanced: the vector of inclusion probabilities moves through the
null space of the constraints (words and documents of the source) until it is a
vertex of the cube, so that each source's totals come out as planned, but for a
landing problem of a dozen documents.

The flight runs apart in blocks of bounded size. Each block leaves at most two
fractional documents; the left ones of a source fly on in blocks of the next level
until one block is left, in which they land.
"""

from __future__ import annotations

import bisect
import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import few, staged, word_count

#: Weights of the sources in order, repeating; words that the mix has for each word there is; the most copies of a word.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Documents that fly in one task.
BLOCK = 4096
#: Documents of a source that are kept for the landing, besides those that the flight leaves.
LANDING = 10
SEED = 20
EPS = 1e-9


def flight(p: list[float], size: list[int], draw: random.Random) -> list[float]:
    """Moves probabilities to 0 or 1, keeping their sum and their sum weighted by size, until at most two are in between.

    Only three units are active at a time: two constraints leave one direction.
    """
    p = list(p)
    wait = iter([i for i in range(len(p)) if EPS < p[i] < 1 - EPS])
    active = list(itertools.islice(wait, 3))
    while len(active) > 1:
        s = [size[i] for i in active]
        if len(active) == 3:
            u = [s[2] - s[1], s[0] - s[2], s[1] - s[0]]
            if not any(u):
                u = [1, -1, 0]
        elif s[0] == s[1]:
            u = [1, -1]
        else:
            break
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(active, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(active, u, strict=True) if x)
        step = up if draw.random() * (up + down) < down else -down
        for i, x in zip(active, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
        active = [i for i in active if EPS < p[i] < 1 - EPS]
        active += itertools.islice(wait, 3 - len(active))
    return [0.0 if x <= EPS else 1.0 if x >= 1 - EPS else x for x in p]


def reserve(p: list[float], size: list[int]) -> set[int]:
    """Up to LANDING fractional units with sizes as near as can be to the largest, its half, its quarter and so on."""
    wait = sorted((size[i], i) for i in range(len(p)) if EPS < p[i] < 1 - EPS)
    out, goal = set(), float(wait[-1][0]) if wait else 0.0
    while wait and len(out) < LANDING:
        at = bisect.bisect_left(wait, (goal, -1))
        at = min((k for k in (at - 1, at) if 0 <= k < len(wait)), key=lambda k: abs(wait[k][0] - goal))
        out.add(wait.pop(at)[1])
        goal /= 2
    return out


def land(p: list[float], size: list[int]) -> list[float]:
    """The few that are left: the choice nearest to the planned words, then to the planned documents."""
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    s, q = np.array([size[i] for i in left], dtype=float), np.array([p[i] for i in left])
    choice = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    words_off, docs_off = np.abs(choice @ s - q @ s), np.abs(choice.sum(axis=1) - q.sum())
    best = choice[np.lexsort((docs_off, np.round(words_off, 6)))[0]]
    out = list(p)
    for i, x in zip(left, best, strict=True):
        out[i] = float(x)
    return out


def _fly(last: bool):
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["order", "id", "h", "nth"], kind="stable")
        p, size = df["p"].tolist(), df["size"].tolist()
        kept = reserve(p, size) if last else set()
        fly = [i for i in range(len(p)) if i not in kept]
        for i, x in zip(fly, flight([p[i] for i in fly], [size[i] for i in fly], random.Random(f"{SEED}:{key}")), strict=True):
            p[i] = x
        return df.assign(p=land(p, size) if last else p)

    return run


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``at``, each row's place by source in code-point order, null last, from 0.

    Ranges of the order are numbered apart; only the ranges' counts come to the
    driver, one number for each partition.
    """
    order = [F.col("source").isNull(), F.col("source")]
    spread = staged(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = sorted((r.part, r["count"]) for r in spread.groupBy("part").count().collect())
    before = dict(zip([k for k, _ in counts], itertools.accumulate([0, *(n for _, n in counts)]), strict=False))
    start = F.coalesce(*[F.when(F.col("part") == k, F.lit(n)) for k, n in before.items()], F.lit(0))
    return spread.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1 + start).drop("part")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to rows (source, source_size).

    ``share`` times all words go to the sources by weight. A target stops at
    ``most`` times its source's size; what is over goes to the others by weight
    until none is above. With one common level L for the others, targets are
    min(most * size, L * weight), and L is found in rounds of sums.
    """
    at = numbered(sources)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("at") % len(weights) + 1).cast("int"))
    rows = staged(at.withColumn("weight", weight).withColumn("top", F.col("source_size") * F.lit(most)), "mix-weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, n_full = 0.0, -1
    while True:
        full = F.lit(False) if n_full < 0 else F.col("top") < F.col("weight") * F.lit(level)
        got = rows.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("top"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if got.n == n_full or not got.w:
            break
        n_full, level = got.n, (share * total - (got.held or 0.0)) / got.w
    target = F.least(F.col("top"), F.col("weight") * F.lit(level))
    return rows.withColumn("target", target).drop("top", "at")


def plan(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, source, h, size, source_size, target, times (copies taken) and taken (words).

    Blocks and draws follow from what is in the rows, h being a hash of the text,
    and from a number among rows that are equal in these. So the plan is the same
    however the table is cut into files and tasks.
    """
    narrow = docs.select("doc_id", "source", F.xxhash64("text").alias("h"), word_count(F.col("text")).alias("size"))
    alike = staged(narrow.groupBy("doc_id", "source", "h", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    sums = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    goals = staged(targets(sums), "mix-targets")
    rows = alike.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    rows = rows.join(few(goals.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + EPS)
    part = F.greatest(F.lit(0.0), ratio - whole)
    rows = rows.withColumn("whole", whole).withColumn("p", F.when(part > EPS, part).otherwise(0.0))
    # pandas has no null numbers, so a null id goes as 0 with a mark.
    rows = rows.withColumn("no_id", F.col("doc_id").isNull()).withColumn("id", F.coalesce("doc_id", F.lit(0).cast("long")))
    rows = rows.withColumn("order", F.xxhash64("doc_id", "h", "nth", F.lit(SEED)))
    kinds = "id long, no_id boolean, source string, h long, nth long, size long, source_size long, target double, whole long, p double, order long, n_blocks long"
    blocks = goals.agg(F.max("n_docs")).first()[0] or 0
    done = rows.filter("p = 0").withColumn("n_blocks", F.lit(0).cast("long"))
    here = rows.filter("p > 0").withColumn("n_blocks", F.ceil(F.col("n_docs") / block))
    cols = [c.split()[0] for c in kinds.split(", ")]
    outs = [done.select(cols)]
    most = -(-blocks // block)
    while True:
        last = most <= 1
        # A level's blocks are dealt by a hash, so they hold about `block` rows whatever the source's size.
        dealt = here.select(cols).withColumn("block", F.pmod("order", F.greatest(F.col("n_blocks"), F.lit(1))))
        flown = staged(dealt.groupBy("source", "block").applyInPandas(_fly(last), kinds + ", block long").select(cols), "mix-flight")
        if last:
            outs.append(flown)
            break
        fixed = (F.col("p") == 0) | (F.col("p") == 1)
        outs.append(flown.filter(fixed))
        here = flown.filter(~fixed).withColumn("n_blocks", F.ceil(F.col("n_blocks") * 2 / block))
        most = -(-most * 2 // block)
    every = outs[0]
    for x in outs[1:]:
        every = every.unionByName(x)
    times = F.col("whole") + F.col("p").cast("long")
    return every.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "source", "h", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, each as many times as the plan takes it (0, 1 or 2), with all their columns.

    A null source is a source of its own, the last in order; a null text has size
    0. Rows equal in doc_id, text and source are drawn apart, and one of them comes
    out as often as all of them together. An empty table gives no rows. Reruns
    agree, whatever the files and partitions. Columns may have any names.
    """
    key = F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("h"), docs["source"])
    whole = docs.select(key.alias("key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    counts = plan(docs, block).groupBy(F.struct("doc_id", "h", "source").alias("k")).agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows")).filter("times > 0")
    taken = whole.join(counts, F.col("key").eqNullSafe(F.col("k"))).select("key", "row", "times", "rows")
    once = taken.filter("rows = 1")
    again = taken.filter("rows > 1").dropDuplicates(["key"])
    return once.unionByName(again).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
