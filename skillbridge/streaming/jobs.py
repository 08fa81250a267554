"""Streams over landed files. All of them are stateless and call the batch operators.

``foreachBatch`` may replay a batch after a failure, so each batch goes to a folder named
by its id that a replay overwrites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skillbridge.functions.text import ERROR_SUBJECT, error_text
from skillbridge.operators.keys import few_sent
from skillbridge.plans.ingest import courses_of, judge, rejects_of
from skillbridge.plans.recommend import nearest_courses, recommend
from skillbridge.session import stored
from skillbridge.sources.listings import SourceSpec, read_pages
from skillbridge.sources.requests import (
    ROUTING_KEY,
    parse_requests,
    read_requests,
    route,
    split_requests,
)
from skillbridge.sources.sinks import put_load, write_batch, write_notification_batch
from skillbridge.streaming.poison import MOST, Suspects, isolate

FILES_PER_BATCH = 100  # a backlog is worked off in batches of so many files
Trigger = dict[str, bool | str]
ONCE: Trigger = {"availableNow": True}


def request_stream(
    spark: SparkSession, path: str, key: str = ROUTING_KEY, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """Routed and decoded requests; the checkpoint takes the place of acknowledgements."""
    return parse_requests(route(read_requests(spark, path, True, files_per_batch), key))


def enrich_requests(stream: DataFrame, static: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join a stream with a table as it stands when the micro-batch runs."""
    if how in ("left_semi", "left_anti"):
        static = static.select(key).distinct()
    return stream.join(static, key, how)


def dead_letters(failed: DataFrame, operator_address: str, *extra: str) -> DataFrame:
    """One notification to the operator for each failed request."""
    return failed.select(
        *extra,
        F.lit(operator_address).alias("address"),
        F.lit(ERROR_SUBJECT).alias("subject"),
        error_text(F.col("error")).alias("message"),
    )


def run_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: Trigger | None = None,
) -> StreamingQuery:
    """Process what has landed in micro-batches, then stop; or go on, with another trigger.

    ``trigger`` are the arguments of Spark's trigger, such as ``{"processingTime": "10 seconds"}``.
    """
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def ingest_stream(
    spark: SparkSession,
    path: str,
    spec: SourceSpec,
    out: str,
    checkpoint: str,
    files_per_batch: int = 5,
    trigger: Trigger | None = None,
    table: str | None = None,
) -> StreamingQuery:
    """Listing pages in micro-batches of five files, to ``out/courses`` and ``out/rejects``.

    With ``table`` courses go to that course table instead (its files lie in ``out/courses`` if the
    stream makes it). A batch is a load of its own there, named by provider and number.
    """

    def handle(pages: DataFrame, batch_id: int) -> None:
        judged = judge(pages, spec).persist()
        try:
            if table is None:
                write_batch(courses_of(judged), f"{out}/courses", batch_id)
            else:
                put_load(courses_of(judged), table, f"{spec.name}-{batch_id}", f"{out}/courses")
            write_batch(rejects_of(judged), f"{out}/rejects", batch_id)
        finally:
            judged.unpersist()

    pages = read_pages(spark, path, streaming=True, files_per_batch=files_per_batch)
    return run_batches(pages, handle, checkpoint, trigger)


def answer_stream(
    requests: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    trigger: Trigger | None = None,
) -> StreamingQuery:
    """Apply a batch job to each micro-batch of requests."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(answer(batch), out, batch_id)

    return run_batches(requests, handle, checkpoint, trigger)


def course_answers(index: DataFrame, **options: object) -> Callable[[DataFrame], DataFrame]:
    """The job for :func:`recommend_stream`: the catalogue is searched here, once per stream."""
    keep = {k: v for k, v in options.items() if k in ("k", "question", "embedder")}
    nearest = nearest_courses(index, **keep)

    def answer(batch: DataFrame) -> DataFrame:
        asked = batch.withColumnRenamed("message_id", "request_id")
        return recommend(asked, index, nearest=nearest, **options)

    return answer


def _unanswered(usable: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests whose id no answer has. Ids are compared by themselves, so that bodies stay where they lie."""
    got = answers.select(F.col("request_id").cast("string").alias("_got")).distinct()
    ids = usable.select(F.col("message_id").cast("string").alias("_id")).distinct()
    left = stored(ids.join(got, F.col("_id").eqNullSafe(F.col("_got")), "left_anti"), "unanswered")
    n, size = left.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_id")), F.lit(0))).first()
    same = F.col("message_id").cast("string").eqNullSafe(F.col("_id"))
    return usable.join(few_sent(left, n, size), same, "left_semi")


def recommend_stream(
    parsed: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    operator_address: str,
    out: str,
    checkpoint: str,
    trigger: Trigger | None = None,
    most_raising: int = MOST,
    suspects: Suspects | None = None,
) -> StreamingQuery:
    """Answer usable requests and turn the others into dead letters; the stream goes on.

    Writes ``out/answers``, ``out/dead`` (with the id and body of the failed message) and
    ``out/outbound``, the notifications of both. A usable request for which ``answer`` has
    no row (by ``request_id``) is a dead letter as well, and so is one whose answer raises: it is
    set aside by :func:`~skillbridge.streaming.poison.isolate`, and the rest of its batch is
    answered. A batch with more than ``most_raising`` of these stops the stream. ``suspects`` names raising
    rows at once, which a batch may have many of.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # on disk, as texts held in memory would take it from the tasks
        usable, failed = split_requests(stored(batch, "request-batch"))
        spark, folder = batch.sparkSession, f"{out}/answers/batch_id={batch_id}"
        every, whole = usable, answer(usable)

        def reset() -> None:
            spark.createDataFrame([], whole.schema).write.mode("overwrite").parquet(folder)

        def work(rows: DataFrame) -> None:
            (whole if rows is every else answer(rows)).write.mode("append").parquet(folder)

        usable, raising = isolate(every, work, reset, most_raising, suspects)
        answers = spark.read.parquet(folder)
        silent = _unanswered(usable, answers)
        failed = failed.unionByName(silent.withColumn("error", F.lit("there is no answer"))).unionByName(raising)
        write_batch(dead_letters(failed, operator_address, "message_id", "body"), f"{out}/dead", batch_id)
        letters = spark.read.parquet(f"{out}/dead/batch_id={batch_id}")
        rows = ["address", "subject", "message"]
        write_notification_batch(answers.select(rows).unionByName(letters.select(rows)), f"{out}/outbound", batch_id)

    return run_batches(parsed, handle, checkpoint, trigger)
