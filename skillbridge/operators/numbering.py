"""Consecutive numbers for rows that no single task sees.

Rows are written as they were dealt, each with its partition and place there. Counting the rows of
every partition and adding up the counts tells where a partition's numbers begin; only one row per
partition takes part in that sum.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillbridge.session import scratch_path

_AT = "_dealt_at"  # partition in the high bits, place in it in the low 33


def partition_of(at: Column) -> Column:
    return F.shiftright(at, 33)


def dealt(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``df`` written once, with ``_dealt_at``; in ranges of ``order`` and sorted there, if given.

    From here on partitions and places are fixed, so a lost executor can't change a number.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "dealt")
    placed = df.withColumn(_AT, F.monotonically_increasing_id())
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def numbered(
    df: DataFrame, name: str = "number", first: int = 0, order: list[str] | None = None
) -> tuple[DataFrame, int]:
    """``df`` with the numbers ``first``, ``first + 1``, ... in column ``name``, and their count.

    Numbers follow ``order``, if given; rows that it leaves equal follow each other in any order.
    """
    rows = dealt(df, order)
    counts = rows.groupBy(partition_of(F.col(_AT)).alias("_part")).agg(
        F.min(_AT).alias("_first"), F.count("*").alias("_n")
    )
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(counts.withColumn("_before", F.coalesce(before, F.lit(0))))  # else all rows would be shuffled
    number = F.lit(first).cast("bigint") + F.col(_AT) - F.col("_first") + F.col("_before")
    out = rows.join(starts, partition_of(F.col(_AT)) == F.col("_part")).withColumn(name, number)
    return out.select(*df.columns, name), rows.count()


MARK = "first bigint, n bigint"


def _marks(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """First number and count of every load of a table, one small row each."""
    try:
        rows = spark.read.schema(f"load string, {MARK}").parquet(f"{path}/marks").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r["load"]: (r["first"], r["n"]) for r in rows}


def append_numbered(
    rows: DataFrame, path: str, load: str, name: str = "id", order: list[str] | None = None
) -> tuple[int, int]:
    """Append a load whose rows get the numbers behind those of all loads before; from 1 on.

    Returns the load's first number and its count. The high-water mark is stored with the table, in
    ``path/marks``, before the rows are, in ``path/rows``. A load that is repeated after a failure
    gets its own numbers again and replaces its rows, so numbers stay unique and without gaps. One
    load at a time.
    """
    spark = rows.sparkSession
    marks = _marks(spark, path)
    behind = max((a + n for other, (a, n) in marks.items() if other != load), default=1)
    first = marks[load][0] if load in marks else behind
    made, n = numbered(rows, name, first, order)
    if load in marks and marks[load][1] != n and first < behind:
        raise ValueError(f"load {load!r} had {marks[load][1]} rows, not {n}, and others follow it")
    mark = spark.createDataFrame([(first, n)], MARK).coalesce(1)
    mark.write.mode("overwrite").parquet(f"{path}/marks/load={load}")
    made.write.mode("overwrite").parquet(f"{path}/rows/load={load}")
    return first, n


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table that :func:`append_numbered` fills."""
    return spark.read.parquet(f"{path}/rows").drop("load")
