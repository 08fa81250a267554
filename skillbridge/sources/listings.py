"""Landed listing pages of course providers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillbridge.operators.numbering import dealt, partition_of
from skillbridge.schemas import PAGE


@dataclass(frozen=True)
class SourceSpec:
    """A provider: where its list of courses sits in a page, and how fields are named.

    ``fields`` maps the provider's name of a field to the column of the course table.
    A new provider needs a new spec and no code.
    """

    name: str
    envelope: tuple[str, ...]
    fields: dict[str, str]

    @property
    def page_schema(self) -> T.StructType:
        """A page's envelope; its items stay JSON, so that one bad item spoils no other."""
        node: T.DataType = T.ArrayType(T.StringType())
        for key in reversed(self.envelope):
            node = T.StructType([T.StructField(key, node)])
        return node

    @property
    def item_schema(self) -> T.StructType:
        """Every leaf is read as text: casting is a later step that can report failures."""
        return T.StructType([T.StructField(f, T.StringType()) for f in self.fields])


# The two providers' page layout and field names.
PROVIDER_A = SourceSpec(
    name="a",
    envelope=("data", "courseData"),
    fields={
        "productId": "id",
        "title": "title",
        "headline": "headline",
        "avgRating": "rating",
        "totalEnrollment": "enrolled",
        "url": "url",
        "durationHours": "duration",
        "courseSection": "section",
        "subCategory": "sub_category",
        "priceType": "price",
    },
)
PROVIDER_B = SourceSpec(
    name="b",
    envelope=("results",),
    fields={
        "id": "id",
        "name": "title",
        "short_description": "headline",
        "rating": "rating",
        "students": "enrolled",
        "url": "url",
        "lectures": "duration",
        "category": "section",
        "subcategory": "sub_category",
        "price": "price",
    },
)


def read_pages(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    layout: str = "lines",
    files_per_batch: int = 5,
) -> DataFrame:
    """Landed pages as ``(page, body)``.

    ``lines``: JSON lines of page number and response text, many pages per file; the
    layout to use for large crawls. ``files``: one response per file, the page number
    being the last number in the file's name.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if layout == "lines":
        return reader.schema(PAGE).json(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\D*$", 1)
    return reader.text(path, wholetext=True).select(
        number.try_cast("bigint").alias("page"), F.col("value").alias("body")
    )


def write_pages(pages: DataFrame, path: str) -> None:
    """Land ``(page, body)`` rows as JSON lines."""
    pages.select("page", "body").write.json(path)


def read_items(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    """One row per listed item, or per page that has none to read, in one pass.

    ``_source, _page, _item`` (the item's JSON, or the page's body), ``_broken`` and the
    provider's fields. ``_broken`` is ``bad_envelope`` for a page that is not JSON or lacks
    the list, ``bad_item`` for an item that is no object, and else NULL. Text behind the end
    of a page's JSON is ignored, as is a page with an empty list.
    """
    items = F.from_json("body", spec.page_schema)
    for key in spec.envelope:
        items = items.getField(key)
    # generators parse a page once and an item once, not once per field and condition
    listed = (
        pages.select("page", "body", F.explode(F.array(items)).alias("items"))
        .select(
            "page",
            F.when(F.col("items").isNull(), F.col("body")).alias("body"),
            F.col("items").isNull().alias("lost"),
            F.posexplode_outer("items").alias("pos", "item"),
        )
        .filter(F.col("lost") | F.col("pos").isNotNull())
    )
    broken = F.when(F.col("lost"), F.lit("bad_envelope")).when(
        ~F.ltrim("item").startswith("{"), F.lit("bad_item")
    )
    return listed.select(
        F.lit(spec.name).alias("_source"),
        F.col("page").alias("_page"),
        F.when(F.col("lost"), F.col("body")).otherwise(F.coalesce("item", F.lit("null"))).alias("_item"),
        broken.alias("_broken"),
        F.inline_outer(F.array(F.from_json("item", spec.item_schema))),
    )


def flatten_listing(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    """One row per listed course, with the provider's field names."""
    return read_items(pages, spec).filter(F.col("_broken").isNull()).drop("_item", "_broken")


def bad_pages(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    """Pages that are not JSON or lack the envelope, as reject rows."""
    rows = read_items(pages, spec).filter(F.col("_broken") == "bad_envelope")
    return rows.select("_source", "_page", F.col("_item").alias("raw"), F.array("_broken").alias("errors"))


def map_fields(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Rename the provider's fields to the columns of the course table."""
    kept = [c for c in df.columns if c.startswith("_")]
    return df.select(*kept, *[F.col(src).alias(dst) for src, dst in spec.fields.items()])


def page_gaps(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Pages ``first..last`` that have not landed."""
    wanted = pages.sparkSession.range(first, last + 1).withColumnRenamed("id", "page")
    return wanted.join(pages.select("page"), "page", "left_anti")


def gap_runs(pages: DataFrame, first: int, last: int) -> DataFrame:
    """The pages of ``first..last`` that have not landed, as runs ``gap_first, gap_last``.

    Nothing lists all pages. Landed ones are dealt by ranges; a page's follower within its range
    tells a gap, and the ends of neighbouring ranges, one row each, tell those in between. Pages
    may come twice, or lie outside of the bounds.
    """
    spark = pages.sparkSession
    here = pages.filter(F.col("page").between(first, last)).select("page").distinct()
    rows = dealt(here, ["page"]).withColumn("_part", partition_of(F.col("_dealt_at")))
    follower = F.lead("page").over(Window.partitionBy("_part").orderBy("page"))
    inside = rows.select((F.col("page") + 1).alias("gap_first"), (follower - 1).alias("gap_last"))
    ends = rows.groupBy("_part").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    # the bounds are ranges of their own, without pages
    bounds = spark.createDataFrame([(first - 1, first - 1), (last + 1, last + 1)], "lo bigint, hi bigint")
    ends = ends.select("lo", "hi").unionByName(bounds)
    beyond = F.lead("lo").over(Window.orderBy("lo"))
    between = ends.select((F.col("hi") + 1).alias("gap_first"), (beyond - 1).alias("gap_last"))
    return inside.unionByName(between).filter(F.col("gap_first") <= F.col("gap_last"))


def scan_course_text(spark: SparkSession, path: str) -> DataFrame:
    """The two course columns that retrieval needs; the scan reads no others."""
    return spark.read.parquet(path).select("title", "headline")
