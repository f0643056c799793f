from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.operators.dedup import first_wins, insert_new
from tallyforge.operators.scd2 import scd2


def versions(spark, rows):
    df = spark.createDataFrame(rows, "k string, t string, h string")
    return sorted((r.k, r.t, r.h, r.version_number, str(r.valid_to)[:10], r.is_current) for r in scd2(df, "k", "t", "h").collect())


def day(n):
    return f"2024-01-0{n}"


def test_cases(spark):
    assert versions(spark, [("k", day(1), "a")]) == [("k", day(1), "a", 1, "9999-12-31", True)]
    assert versions(spark, [("k", day(1), "a"), ("k", day(2), "b")]) == [("k", day(1), "a", 1, day(2), False), ("k", day(2), "b", 2, "9999-12-31", True)]
    assert [v[1] for v in versions(spark, [("k", day(1), "a"), ("k", day(2), "a"), ("k", day(3), "b")])] == [day(1), day(3)]
    assert len(versions(spark, [("k", day(1), "a"), ("k", day(2), "b"), ("k", day(3), "a")])) == 3
    assert versions(spark, [("k", day(1), "b"), ("k", day(1), "a")]) == [("k", day(1), "a", 1, "9999-12-31", True)]
    assert versions(spark, []) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.integers(1, 9).map(day), st.sampled_from("abc")), max_size=25))
def test_intervals_join_and_one_is_current(spark, rows):
    got = versions(spark, rows) if rows else []
    for k in {r[0] for r in rows}:
        own = [v for v in got if v[0] == k]
        assert sum(v[5] for v in own) == 1 and own[-1][5]
        assert all(a[4] == b[1] and a[2] != b[2] for a, b in zip(own, own[1:], strict=False))
        assert [v[3] for v in own] == list(range(1, len(own) + 1))


def test_one_shuffle_for_the_whole_history(spark):
    df = spark.createDataFrame([("k", day(1), "a")], "k string, t string, h string")
    plan = scd2(df, "k", "t", "h")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_first_wins_and_insert_only_merge(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3)], "k int, name string, o int")
    got = {(r.name, r.nth, r.winner) for r in first_wins(df, ["k"], ["o"], "name").collect()}
    assert got == {("a", 1, "a"), ("b", 2, "a"), ("c", 1, "c")}
    new = insert_new(df, spark.createDataFrame([(2,)], "k int"), "k", ["o"])
    assert [r.name for r in new.collect()] == ["a"]
    assert insert_new(df.filter(F.lit(False)), df, "k", ["o"]).count() == 0
