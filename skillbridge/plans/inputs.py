"""The shared test tables as listings, accounts, uploads, messages and an index.

Every mapping takes a table whole. Whatever a check needs to fail (missing keys, text
where a number belongs, orphans, gaps) comes from how the tables' own columns fall out.

* provider A lists ``part``, provider B lists ``documents`` with their ``labels``;
* users are ``customer``, active users the ``user_id`` of ``events``, uploads ``orders``;
* the index is ``embeddings`` with the texts of ``documents``, both whole: label 0 is shared,
  any other label is an owner.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillbridge.session import spread_scan
from skillbridge.sources.listings import PROVIDER_A, PROVIDER_B, SourceSpec

PAGE_ROWS = 10
OPERATOR_ADDRESS = "operator@example.com"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """For work that is heavy per row: a small table is spread over all cores first."""
    return spread_scan(table(spark, sf_dir, name))


def email(key: str | Column) -> Column:
    col = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("user"), col.cast("string"), F.lit("@example.com"))


def pages_of(items: DataFrame, page: Column, spec: SourceSpec) -> DataFrame:
    """Put listing items into pages of JSON; a NULL field is left out of its object.

    The page number groups ``PAGE_ROWS`` consecutive keys, so a page is always short.
    """
    fields = F.struct(*list(spec.fields))
    body = F.array_sort(F.collect_list(fields))
    for key in reversed(spec.envelope):
        body = F.struct(body.alias(key))
    return items.groupBy(page.alias("page")).agg(F.to_json(body).alias("body"))


def pages_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    items = table(spark, sf_dir, "part").select(
        key.alias("productId"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("headline"),
        (size / 10).alias("avgRating"),
        size.alias("totalEnrollment"),
        F.concat(F.lit("https://courses.example/"), key.cast("string")).alias("url"),
        size.cast("string").alias("durationHours"),
        F.col("p_brand").alias("courseSection"),
        F.col("p_type").alias("subCategory"),
        (size * 10).cast("string").alias("priceType"),
    )
    return pages_of(items, F.expr(f"productId div {PAGE_ROWS}"), PROVIDER_A)


def pages_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents are listed without a name, unlabelled ones with no count of students."""
    key = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    items = docs.select(
        key.alias("id"),
        F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 0, F.col("text")).alias("name"),
        F.col("source").alias("short_description"),
        (F.col("n_chars") / 8).alias("rating"),
        F.coalesce(F.col("quality").cast("string"), F.lit("unrated")).alias("students"),
        F.concat(F.lit("https://docs.example/"), key.cast("string")).alias("url"),
        F.col("n_chars").cast("string").alias("lectures"),
        F.col("lang").alias("category"),
        F.col("source").alias("subcategory"),
        (F.col("n_chars") * 10).cast("string").alias("price"),
    )
    return pages_of(items, F.expr(f"id div {PAGE_ROWS}"), PROVIDER_B)


def pages_of_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per turn of a conversation; only assistants answer in the listing's format."""
    item = F.struct(F.col("conv_id").alias("id"), F.col("text").alias("name"))
    body = F.to_json(F.struct(F.array(item).alias("results")))
    page = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        page.alias("page"),
        F.when(F.col("role") == "assistant", body).otherwise(F.col("text")).alias("body"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), email("c_custkey").alias("email"), F.col("c_name").alias("password")
    )


def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, so every key occurs many times."""
    return table(spark, sf_dir, "events").select(email("user_id").alias("email"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        email("o_custkey").alias("email"),
        F.encode(priority, "UTF-8").alias("pdf_resume"),
        F.concat(F.col("o_orderstatus"), F.lit(" "), priority).alias("job_description"),
    )


def upload_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads with the content type the browser sent: PDF, plain text or none."""
    status = F.col("o_orderstatus")
    kind = F.when(
        status == "O", F.concat(F.lit("application/pdf;name="), F.col("o_orderpriority"))
    ).when(status == "F", F.lit("text/plain"))
    file = F.when(F.col("o_orderpriority") != "5-LOW", F.encode("o_orderpriority", "UTF-8"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), file.alias("pdf_resume"), kind.alias("content_type")
    )


def full_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload forms with the columns of an upload."""
    own = uploads(spark, sf_dir).select("id", "email", "job_description")
    return upload_forms(spark, sf_dir).join(own, "id")


def turn_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a request of its own sender; the turns of a conversation share an id."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return table(spark, sf_dir, "conversations").select(
        conv.alias("request_id"),
        email(F.concat_ws("-", conv, turn)).alias("email"),
        F.col("text").alias("resume"),
        F.col("role").alias("job_desc"),
    )


def resume_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an upload: its whole text is the file."""
    return wide_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        email("doc_id").alias("email"),
        F.encode("text", "UTF-8").alias("pdf_resume"),
        F.concat(F.col("lang"), F.lit(" "), F.col("source")).alias("job_description"),
    )


def event_messages(events: DataFrame) -> DataFrame:
    """Events as queue messages: a purchase is an upload, anything else goes elsewhere.

    The body of a small purchase is the event's own properties, which are no request; that
    of a middling one is no JSON at all.
    """
    body = F.to_json(
        F.struct(
            email("user_id").alias("email"),
            F.base64(F.encode("event_type", "UTF-8")).alias("file_content"),
            F.col("props").alias("job_desc"),
        )
    )
    value = F.col("value")
    return events.select(
        F.col("event_id").cast("string").alias("message_id"),
        F.when(F.col("event_type") == "purchase", F.lit("resume_pdf"))
        .otherwise(F.col("event_type"))
        .alias("routing_key"),
        F.when(value < 10, F.col("props"))
        .when(value < 20, F.col("event_type"))
        .otherwise(body)
        .alias("body"),
    )


TEXT_BYTES = 1 << 20  # of texts whose letters are counted at once
LONGEST_TEXT = 17_000  # characters that the model below takes


def load_counter(model_name: str, device: str):
    """A tiny model, fully determined: the characters of a text and its spaces.

    It takes texts up to a length only, as models do, and raises for longer ones.
    """

    def model(texts):
        for text in texts:
            if len(text) > LONGEST_TEXT:
                raise ValueError(f"{len(text)} characters are too many")
        return np.array([[len(text), text.count(" ")] for text in texts], dtype=np.float32).reshape(-1, 2)

    return model


class LetterEmbedder:
    """Unit vectors of letter counts; an embedder that plain SQL can state as well."""

    letters = "abcdefghijklmnopqrstuvwxyz"

    def embed(self, df: DataFrame, text: str) -> DataFrame:
        first, n, most = ord(self.letters[0]), len(self.letters), TEXT_BYTES

        def count(texts: pa.Array) -> pa.Array:
            """The letters of all texts in one pass over their bytes; no byte of another character is a letter."""
            texts = texts.cast(pa.large_string())
            _, places, data = texts.buffers()
            ends = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
            out, lo = np.zeros((len(texts), n), np.int32), 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
                some = raw[ends[lo] : ends[hi]].astype(np.int32) - first
                row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                own = (some >= 0) & (some < n)
                out[lo:hi] = np.bincount(row[own] * n + some[own], minlength=(hi - lo) * n).reshape(-1, n)
                lo = hi
            return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * n, pa.array(out.ravel()))

        counts = F.arrow_udf(count, "array<int>")
        norm = F.sqrt(F.aggregate("_counts", F.lit(0), lambda s, n: s + n * n))
        # the outer lambda binds the norm, as the optimizer would put it into the inner one, once per component
        unit = F.transform(F.array(norm), lambda s: F.transform("_counts", lambda n: (n / s).cast("float")))
        return (
            df.filter(F.col(text).rlike("[a-z]"))  # as a filter on the norm would count twice
            .withColumn("_counts", counts(F.col(text)))
            .withColumn("embedding", unit[0])
            .drop("_counts")
        )


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, owner, text, embedding``: all vectors and all documents.

    Row ``r`` has the vector numbered ``r`` modulo their count and the document likewise, so
    the larger table is there once and the smaller one is gone through again. Ids must be
    the numbers from 0 on, as a gap would lose rows; that is checked.
    """
    vectors = scoped_vectors(spark, sf_dir)
    text = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_vectors, n_texts = dense_count(vectors, "vec_id"), dense_count(text, "doc_id")
    if n_vectors >= n_texts:
        rows = vectors.withColumn("doc_id", F.pmod("vec_id", F.lit(max(1, n_texts))))
        return rows.join(text, "doc_id").drop("doc_id")
    rows = text.withColumn("number", F.pmod("doc_id", F.lit(max(1, n_vectors))))
    named = vectors.withColumnRenamed("vec_id", "number")
    return rows.join(named, "number").select(F.col("doc_id").alias("vec_id"), "owner", "embedding", "text")


def dense_count(rows: DataFrame, key: str) -> int:
    """How many rows there are, if their keys are 0, 1, 2, ...; else an error."""
    n, keys, lo, hi = rows.agg(F.count("*"), F.countDistinct(key), F.min(key), F.max(key)).first()
    if n and (keys, lo, hi) != (n, 0, n - 1):
        raise ValueError(f"{key} must go from 0 to {n - 1} without gaps")
    return n


def scoped_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label 0 is open to everybody; another label is the owner of its vectors."""
    owner = F.when(F.col("label") != 0, F.concat(F.lit("owner"), F.col("label").cast("string")))
    return wide_table(spark, sf_dir, "embeddings").select("vec_id", owner.alias("owner"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector asks, on behalf of the owner its label names."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("qid"),
        F.concat(F.lit("owner"), F.col("label").cast("string")).alias("owner"),
        "embedding",
    )
