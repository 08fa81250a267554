import pytest
from pyspark.sql import functions as F

from skillbridge.operators import accounts
from skillbridge.operators.numbering import append_numbered, numbered, read_numbered
from skillbridge.sources import listings


def test_numbers_are_dense(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("x"))
    rows, n = numbered(df, "n", 5)
    assert n == 1000 and sorted(r.n for r in rows.collect()) == list(range(5, 1005))
    ordered, _ = numbered(df, "n", order=["x"])
    assert all(r.n == r.x for r in ordered.collect())
    empty, n = numbered(df.filter("x < 0"))
    assert n == 0 and empty.collect() == []


def test_many_equal_rows(spark):
    rows, n = numbered(spark.range(3000).select(F.lit(1).alias("x")), order=["x"])
    assert n == 3000 and rows.select("number").distinct().count() == 3000


def test_loads_go_on_and_are_repeated(spark, folder):
    def load(name, lo, hi):
        rows = spark.range(lo, hi, 1, 4).withColumnRenamed("id", "x")
        return append_numbered(rows, folder, name, order=["x"])

    assert load("a", 0, 10) == (1, 10)
    assert load("b", 10, 25) == (11, 15)
    assert load("a", 0, 10) == (1, 10)
    assert load("c", 25, 25) == (26, 0)
    assert load("d", 25, 30) == (26, 5)
    assert load("d", 25, 33) == (26, 8)  # the last load may change
    table = sorted((r.id, r.x) for r in read_numbered(spark, folder).collect())
    assert table == [(k + 1, k) for k in range(33)]
    with pytest.raises(ValueError, match="others follow"):
        load("b", 10, 26)
    assert read_numbered(spark, folder).count() == 33


def test_page_after(spark, folder, plan_of):
    spark.range(0, 500, 1, 5).selectExpr("id * 3 AS id", "'x' AS v").write.parquet(folder)
    df = spark.read.parquet(folder)
    after, seen = None, []
    while rows := accounts.page_after(df, after, 70).collect():
        seen += [r.id for r in rows]
        after = seen[-1]
    assert seen == [3 * k for k in range(500)]
    plan = plan_of(accounts.page_after(df, 600, 10))
    assert "TakeOrderedAndProject" in plan and "GreaterThan(id,600)" in plan


@pytest.mark.parametrize("landed", [[], [0], [20], [5, 6, 7], [0, 1, 3, 3, 9, 20, 25, -4], list(range(21))])
def test_gap_runs(spark, landed):
    pages = spark.createDataFrame([(n, "") for n in landed], "page bigint, body string").repartition(3)
    runs = sorted(tuple(r) for r in listings.gap_runs(pages, 0, 20).collect())
    missing = [n for n in range(21) if n not in landed]
    assert [n for a, b in runs for n in range(a, b + 1)] == missing
    assert all(a <= b for a, b in runs) and all(x[1] + 1 < y[0] for x, y in zip(runs, runs[1:]))


def test_gap_runs_over_several_ranges(spark):
    pages = spark.range(0, 5000, 1, 8).selectExpr("id * 2 AS page").filter("page % 10 <> 4")
    runs = listings.gap_runs(pages, 0, 10_000).collect()
    listed = {n for r in runs for n in range(r.gap_first, r.gap_last + 1)}
    assert listed == set(range(10_001)) - {2 * k for k in range(5000) if 2 * k % 10 != 4}


def test_rows_stay_where_they_were_dealt(spark, plan_of):
    """A row per partition goes to the rows, whatever Spark broadcasts by itself."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        rows, n = numbered(spark.range(0, 100, 1, 7))
        assert "SortMergeJoin" not in plan_of(rows)
        assert n == 100 and sorted(r.number for r in rows.collect()) == list(range(100))
    finally:
        spark.conf.set(name, before)
