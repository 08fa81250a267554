"""From landed requests to outbound notifications, as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skillbridge.plans.recommend import recommend
from skillbridge.sources.requests import parse_requests, read_requests, route, split_requests
from skillbridge.sources.sinks import read_notifications, write_notifications
from skillbridge.streaming.jobs import dead_letters
from skillbridge.streaming.poison import MOST, isolate

COLUMNS = ["address", "subject", "message"]


def answer_landed(
    spark: SparkSession, landed: str, index: DataFrame, operator_address: str, out: str, most_raising: int = MOST, **options: object
) -> DataFrame:
    """Answer all requests below ``landed`` and write ``out/outbound``; returns what was sent.

    Every routed message leads to one notification: to its sender, with the courses found for it, or to
    the operator, if it can't be read or its answer raises. Answers, with contexts, sources and
    prompts, lie in ``out/answers``. ``options`` are those of
    :func:`~skillbridge.plans.recommend.recommend`.
    """
    usable, failed = split_requests(parse_requests(route(read_requests(spark, landed))))
    folder = f"{out}/answers"

    def answer(rows: DataFrame) -> DataFrame:
        return recommend(rows.withColumnRenamed("message_id", "request_id"), index, **options)

    whole = answer(usable)

    def reset() -> None:
        spark.createDataFrame([], whole.schema).write.mode("overwrite").parquet(folder)

    def work(rows: DataFrame) -> None:
        (whole if rows is usable else answer(rows)).write.mode("append").parquet(folder)

    _, raising = isolate(usable, work, reset, most_raising)
    letters = dead_letters(failed.unionByName(raising), operator_address)
    write_notifications(spark.read.parquet(folder).select(COLUMNS).unionByName(letters.select(COLUMNS)), f"{out}/outbound")
    return read_notifications(spark, f"{out}/outbound")
