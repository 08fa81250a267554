"""Listing pages to typed courses and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillbridge.operators.quality import check, conform, table_rules
from skillbridge.schemas import COURSES
from skillbridge.sources.listings import SourceSpec, flatten_listing, map_fields, read_items

TRACE = ("_source", "_page")


def typed_listing(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    """Pages of one provider as typed course rows, not yet checked."""
    return conform(map_fields(flatten_listing(pages, spec), spec), COURSES, keep=TRACE)


def judge(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    """All items and unreadable pages of one provider in one pass, with their ``errors``.

    Course columns, provider, page, ``raw`` (the JSON as it came) and ``errors``, which is
    empty for a course that satisfies the table's constraints.
    """
    typed = conform(map_fields(read_items(pages, spec), spec), COURSES, keep=(*TRACE, "_item", "_broken"))
    checked = check(typed, table_rules(COURSES))
    errors = F.when(F.col("_broken").isNull(), F.col("errors")).otherwise(F.array("_broken"))
    return checked.select(*COURSES.names, *TRACE, F.col("_item").alias("raw"), errors.alias("errors"))


def courses_of(judged: DataFrame) -> DataFrame:
    return judged.filter(F.size("errors") == 0).select(COURSES.names)


def rejects_of(judged: DataFrame) -> DataFrame:
    return judged.filter(F.size("errors") > 0).select(*TRACE, "raw", "errors")


def ingest(pages: DataFrame, spec: SourceSpec) -> tuple[DataFrame, DataFrame]:
    """Courses that satisfy the table's constraints, and rejects with their reasons.

    A bad row or page does not stop its batch; the reject keeps provider, page and the
    raw JSON. Both are filters of :func:`judge`; a job that writes both stores that first.
    """
    judged = judge(pages, spec)
    return courses_of(judged), rejects_of(judged)


def all_courses(*providers: DataFrame) -> DataFrame:
    """One bag of courses; equal rows and equal ids of different providers are kept."""
    first, *others = providers
    for other in others:
        first = first.unionByName(other)
    return first
