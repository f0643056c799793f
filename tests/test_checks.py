import datetime

import pytest

from tallyforge.operators import checks as c


@pytest.fixture
def df(spark):
    d = datetime.date
    return spark.createDataFrame([(1, "aa", 1.0, d(2024, 1, 1)), (1, "b", 0.0, d(2025, 1, 1)), (None, None, float("nan"), None)], "k int, s string, x double, d date")


@pytest.mark.parametrize(
    ("check", "n"),
    [
        (lambda: c.not_null("k"), 1), (lambda: c.unique("k"), 1), (lambda: c.unique("k", "s"), 0), (lambda: c.accepted("s", ["aa"]), 1), (lambda: c.matches("s", "^a+$"), 1), (lambda: c.between("x", 0, strictly=True), 2), (lambda: c.between("x", 0), 1),
        (lambda: c.between("x", high=0.5), 2), (lambda: c.between("d", "2024-01-01", "2024-12-31"), 1), (lambda: c.length_is("s", 2), 1),
    ],
)
def test_counts(df, check, n):
    assert [r.violations for r in c.run(df, [check()]).collect()] == [n]


def test_relationship_and_enforce(spark, df):
    parent = spark.createDataFrame([(2,)], "id int")
    assert c.run(df, [c.relates("k", parent, "id")]).first().violations == 2
    with pytest.raises(c.ChecksFailed, match=r"t: not_null\(k\): 1"):
        c.enforce(df, [c.not_null("k"), c.not_null("k")], "t")
    c.enforce(df.filter("k = 1"), [c.not_null("k")], "t")


def test_row_checks_share_one_pass(df):
    plan = c.run(df, [c.not_null("k"), c.length_is("s", 2), c.between("x", 0)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
