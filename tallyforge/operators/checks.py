"""Declarative data checks. Row checks of a table share one aggregate; the others are one job each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowCheck:
    """Counts the rows where ``bad`` is true."""

    name: str
    column: str
    bad: Column


@dataclass(frozen=True)
class GroupCheck:
    """Counts the combinations of columns that occur more than once; ones with a null don't count."""

    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class ForeignKey:
    """Counts the rows whose value has no parent; nulls have none to have."""

    name: str
    column: str
    parent: DataFrame = field(compare=False)
    parent_column: str


def not_null(c: str) -> RowCheck:
    return RowCheck("not_null", c, F.col(c).isNull())


def accepted(c: str, values) -> RowCheck:
    return RowCheck("accepted_values", c, ~F.col(c).isin(*values))


def matches(c: str, pattern: str) -> RowCheck:
    return RowCheck("matches", c, ~F.col(c).rlike(pattern))


def between(c: str, low=None, high=None, strictly: bool = False) -> RowCheck:
    """Bounds may be missing. NaN is outside any bounds."""
    x, bad = F.col(c), F.isnan(F.col(c).cast("double")) if isinstance(low if low is not None else high, int | float) else F.lit(False)
    if low is not None:
        bad = bad | ((x <= low) if strictly else (x < low))
    if high is not None:
        bad = bad | ((x >= high) if strictly else (x > high))
    return RowCheck("between", c, bad)


def length_is(c: str, n: int) -> RowCheck:
    return RowCheck("length", c, F.length(c) != n)


def unique(*cs: str) -> GroupCheck:
    return GroupCheck("unique", cs)


def relates(c: str, parent: DataFrame, parent_column: str) -> ForeignKey:
    return ForeignKey("relationship", c, parent, parent_column)


def run(df: DataFrame, checks: list) -> DataFrame:
    """A row for each check: check, on, violations."""
    parts = []
    rows = [c for c in checks if isinstance(c, RowCheck)]
    if rows:
        sums = df.agg(*[F.count(F.when(c.bad, 1)).alias(f"c{i}") for i, c in enumerate(rows)])
        told = F.array(*[F.struct(F.lit(c.name).alias("check"), F.lit(c.column).alias("on"), F.col(f"c{i}").alias("violations")) for i, c in enumerate(rows)])
        parts.append(sums.select(F.inline(told)))
    for c in checks:
        if isinstance(c, GroupCheck):
            many = df.dropna(subset=list(c.columns)).groupBy(*c.columns).count().filter("count > 1")
            parts.append(many.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(c.name).alias("check"), F.lit(", ".join(c.columns)).alias("on"), "violations"))
        elif isinstance(c, ForeignKey):
            child = df.select(F.col(c.column).alias("_k")).dropna()
            lost = child.join(c.parent.select(F.col(c.parent_column).alias("_k")), "_k", "left_anti")
            parts.append(lost.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(c.name).alias("check"), F.lit(c.column).alias("on"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class ChecksFailed(RuntimeError):
    pass


def enforce(df: DataFrame, checks: list, name: str) -> None:
    """Raises where a check has violations. The report has a row for each check."""
    if checks and (bad := run(df, checks).filter("violations > 0").collect()):
        raise ChecksFailed(f"{name}: " + ", ".join(f"{r['check']}({r['on']}): {r.violations}" for r in bad))
