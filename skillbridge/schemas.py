"""Table and message schemas.

Length limits and required columns are kept in the schema itself (nullability and
``max_length`` metadata), so that the constraint rules can be derived from it. Column names, their
order and the limits are fixed values: stored tables and messages must match them.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _text(name: str, max_length: int | None = None, required: bool = False) -> T.StructField:
    meta = {} if max_length is None else {"max_length": max_length}
    return T.StructField(name, T.StringType(), not required, meta)


COURSES = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        _text("title", 255, required=True),
        _text("headline"),
        T.StructField("rating", T.DoubleType()),
        T.StructField("enrolled", T.IntegerType()),
        _text("url"),
        _text("duration", 10),
        _text("section", 50),
        _text("sub_category", 50),
        _text("price", 20),
    ]
)

USERS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        _text("email", required=True),
        _text("password", required=True),
    ]
)

UPLOADS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        _text("email", required=True),
        T.StructField("pdf_resume", T.BinaryType(), False),
        _text("job_description", required=True),
    ]
)

# What is landed from the queue: one JSON line per message, the body being JSON text.
MESSAGE = T.StructType([_text("message_id"), _text("routing_key"), _text("body")])

REQUEST_BODY = T.StructType([_text("email"), _text("file_content"), _text("job_desc")])

NOTIFICATION = T.StructType([_text("address"), _text("subject"), _text("message")])

# One landed listing page per JSON line.
PAGE = T.StructType([T.StructField("page", T.LongType()), _text("body")])
