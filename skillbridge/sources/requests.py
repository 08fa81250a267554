"""Upload request messages: encode, land, read, route, parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillbridge.functions.text import base64_text
from skillbridge.schemas import MESSAGE, REQUEST_BODY

# Fixed value: the key that upload messages are bound to.
ROUTING_KEY = "resume_pdf"


def encode_requests(uploads: DataFrame, routing_key: str = ROUTING_KEY) -> DataFrame:
    """Uploads ``(id, email, pdf_resume, job_description)`` as queue messages."""
    body = F.to_json(
        F.struct(
            F.col("email"),
            base64_text(F.col("pdf_resume")).alias("file_content"),
            F.col("job_description").alias("job_desc"),
        )
    )
    return uploads.select(
        F.col("id").cast("string").alias("message_id"),
        F.lit(routing_key).alias("routing_key"),
        body.alias("body"),
    )


def write_requests(messages: DataFrame, path: str) -> None:
    messages.select("message_id", "routing_key", "body").write.json(path)


def read_requests(
    spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """Landed messages as ``(message_id, routing_key, body)``, as a batch or a stream."""
    reader = spark.readStream if streaming else spark.read
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.schema(MESSAGE).json(path)


def route(messages: DataFrame, key: str = ROUTING_KEY) -> DataFrame:
    """Only the messages bound to ``key``."""
    return messages.filter(F.col("routing_key") == key)


def parse_requests(messages: DataFrame) -> DataFrame:
    """Decode message bodies; a message that cannot be used gets an ``error`` text.

    Adds ``email``, ``resume`` (text of the file), ``job_desc`` and ``error``. A row is
    never dropped here, so that a bad message cannot hold up the ones behind it.
    """
    schema = T.StructType([*REQUEST_BODY, T.StructField("_corrupt_record", T.StringType())])
    # as a generator the body is parsed once, not once per field and condition
    parsed = messages.select("*", F.inline(F.array(F.from_json("body", schema))))
    resume = F.try_to_binary("file_content", F.lit("base64"))
    error = F.coalesce(
        F.when(
            F.col("body").isNull() | F.col("_corrupt_record").isNotNull(),
            F.lit("body is not JSON"),
        ),
        F.when(F.col("email").isNull(), F.lit("email is missing")),
        F.when(F.col("job_desc").isNull(), F.lit("job_desc is missing")),
        F.when(F.col("file_content").isNull(), F.lit("file_content is missing")),
        F.when(F.col("resume").isNull(), F.lit("file_content cannot be decoded")),
    )
    return (
        # bytes that are no text become NULL instead of failing the job
        parsed.withColumn("resume", F.try_validate_utf8(resume.cast("string")))
        .withColumn("error", error)
        .select(*messages.columns, "email", "resume", "job_desc", "error")
    )


def split_requests(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable requests, and the failed ones."""
    return (
        parsed.filter(F.col("error").isNull()).drop("error"),
        parsed.filter(F.col("error").isNotNull()),
    )
