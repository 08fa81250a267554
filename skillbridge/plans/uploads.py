"""Uploads from the form to the queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillbridge.operators.accounts import fk_split
from skillbridge.operators.quality import check, upload_rules
from skillbridge.session import scratch_path
from skillbridge.sources.requests import encode_requests, write_requests
from skillbridge.sources.sinks import append_rows

UPLOAD = ["id", "email", "pdf_resume", "job_description"]


def publish_uploads(forms: DataFrame, users: DataFrame, table: str, queue: str) -> DataFrame:
    """Admit uploads, store them in ``table`` and send each to ``queue`` as a request.

    ``forms`` has the columns of an upload and ``content_type``. Returns the rejects with
    their ``errors``: what the file rules say, or ``unknown_user``. Forms are judged once and
    stored with the verdict; table, messages and rejects are all made from what is stored.
    """
    checked = check(forms, upload_rules())
    known, orphans = fk_split(checked.filter(F.size("errors") == 0), users)
    judged = (
        checked.filter(F.size("errors") > 0)
        .unionByName(orphans.withColumn("errors", F.array(F.lit("unknown_user"))))
        .unionByName(known)
    )
    spark = forms.sparkSession
    load = scratch_path(spark, "uploads")
    judged.write.parquet(load)
    judged = spark.read.schema(judged.schema).parquet(load)
    admitted = judged.filter(F.size("errors") == 0).select(UPLOAD)
    append_rows(admitted, table)
    write_requests(encode_requests(admitted), queue)
    return judged.filter(F.size("errors") > 0)
