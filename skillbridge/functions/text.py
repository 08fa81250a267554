"""Text, encoding and template functions; all of them built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the answer prompt and the standing question.
PROMPT_TEMPLATE = """Use the following pieces of context to answer the user's question.
        The example of your response should be:

        Context: {context}
        Question: {question}

        Only return the helpful answer below and nothing else.
        Helpful answer:
        """
STANDING_QUESTION = (
    "Based on the job description, the resume, find the interests and recommend "
    "the exact courses you know name 3"
)
CONTEXT_SEPARATOR = "\n\n"
ANSWER_SUBJECT = "Courses"
ERROR_SUBJECT = "Service Error"
ERROR_PREFIX = "Error occurred: "


def strip_space(col: Column) -> Column:
    """Strip any white space (``trim`` would leave newlines and tabs)."""
    space = r"[\s\x1c-\x1f]+"
    return F.regexp_replace(col, rf"(?U)^{space}|{space}\z", "")


def base64_text(col: Column) -> Column:
    """Base64 without the line breaks Spark inserts after every 76 characters."""
    return F.translate(F.base64(col), "\r\n", "")


def course_text(title: Column, headline: Column) -> Column:
    """Title and headline with nothing between; NULL if either is missing."""
    return F.concat(title, headline)


def error_text(reason: Column) -> Column:
    return F.concat(F.lit(ERROR_PREFIX), reason)


def fill_template(template: str, **values: Column) -> Column:
    """Put columns into the ``{name}`` places of a template.

    The literal parts are concatenated rather than replaced by pattern, because the
    values are free text that may hold ``$``, ``\\`` or braces.
    """
    parts = [
        values[part] if i % 2 else F.lit(part)
        for i, part in enumerate(re.split(r"\{(\w+)\}", template))
    ]
    return F.concat(*parts)
