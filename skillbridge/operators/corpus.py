"""Documents, chunks and vectors."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillbridge.functions.text import course_text, strip_space

CHUNK_SIZE = 256
CHUNK_OVERLAP = 64
RUN_WINDOWS = 32  # neighbouring windows cut from one part of a text
SEPARATORS = ("\n\n", "\n", " ", "")


def plain_meta(meta: Column) -> Column:
    """The plain values of a VARIANT object, as a map of texts.

    What a value is is decided by its own type, row by row: objects and lists are left out, as is
    NULL; texts, numbers and booleans stay.
    """
    kept = F.map_filter(
        meta.cast("map<string,variant>"),
        lambda _, v: v.isNotNull() & ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)"),
    )
    return F.transform_values(kept, lambda _, v: v.cast("string"))


def meta_of(*columns: str | Column) -> Column:
    """Columns as the metadata of a document, by their names; nested and NULL ones are left out."""
    return plain_meta(F.to_variant_object(F.struct(*columns)))


def course_documents(courses: DataFrame, doc_id: str | Column = "id") -> DataFrame:
    """Courses as documents everybody may see; a course without text is left out.

    Their metadata are the columns that the text is made of.
    """
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = course_text(F.col("title"), F.col("headline"))
    return (
        courses.select(
            key.cast("string").alias("doc_id"), text.alias("text"), meta_of("title", "headline").alias("meta")
        )
        .filter(F.col("text").isNotNull())
        .select(
            "doc_id", F.lit(None).cast("string").alias("owner"), F.lit("course").alias("kind"), "text", "meta"
        )
    )


def owned_documents(
    df: DataFrame, kind: str, doc_id: Column, owner: Column, text: Column, meta: Column | None = None
) -> DataFrame:
    """Texts of one owner, such as resumes and job descriptions, with a VARIANT of metadata."""
    plain = F.create_map().cast("map<string,string>") if meta is None else plain_meta(meta)
    return df.select(
        doc_id.cast("string").alias("doc_id"),
        owner.cast("string").alias("owner"),
        F.lit(kind).alias("kind"),
        text.alias("text"),
        plain.alias("meta"),
    ).filter(F.col("text").isNotNull())


def request_documents(requests: DataFrame, owner: str = "request_id") -> DataFrame:
    """Resume and job description of each request, in one pass, owned by column ``owner``."""
    texts = F.array(
        F.struct(F.lit("resume").alias("kind"), F.col("resume").alias("text")),
        F.struct(F.lit("job").alias("kind"), F.col("job_desc").alias("text")),
    )
    return (
        requests.select(F.col(owner).alias("owner"), "request_id", F.inline(texts))
        .filter(F.col("text").isNotNull())
        .withColumn("doc_id", F.concat_ws("-", "kind", "request_id"))
        .select("doc_id", "owner", "kind", "text", F.create_map(F.lit("source"), "doc_id").alias("meta"))
    )


def corpus_docs(courses: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """All documents; columns that only one kind has are NULL for the others."""
    return courses.unionByName(resumes, allowMissingColumns=True).unionByName(
        jobs, allowMissingColumns=True
    )


def atomic_columns(df: DataFrame) -> DataFrame:
    """Only the columns with plain values: no arrays, maps or structs."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return df.select([f.name for f in df.schema if not isinstance(f.dataType, nested)])


def chunk_fixed(
    docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Windows of ``size`` characters that overlap by ``overlap``, cut anywhere.

    A text is cut into runs of windows first: finding a place takes a walk from the start, which is
    then the run's and not the text's.
    """
    stride = size - overlap
    count = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(stride)), F.lit(1)).cast("int")

    def windows(run: Column) -> Column:
        here = F.least(F.lit(RUN_WINDOWS), count - run["first"])
        cut = lambda i: F.substring(run["part"], i * stride + 1, F.lit(size))
        return F.transform(F.sequence(F.lit(0), here - 1), cut)

    long = (RUN_WINDOWS - 1) * stride + size
    runs = F.transform(
        F.sequence(F.lit(0), count - 1, F.lit(RUN_WINDOWS)),
        lambda i: F.struct(i.alias("first"), F.substring(F.col(text), i * stride + 1, F.lit(long)).alias("part")),
    )
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(F.flatten(F.transform(runs, windows))).alias("chunk_idx", "chunk"))


def _starts(text: str, lo: int, hi: int, separator: str) -> Iterator[int]:
    """Where the pieces of a stretch of text begin: at its start and at each separator."""
    if not separator:
        yield from range(lo, hi)
        return
    yield lo
    at = text.find(separator, lo, hi)
    while at >= 0:
        if at > lo:
            yield at
        at = text.find(separator, at + len(separator), hi)


def _spans(
    text: str, lo: int, hi: int, separators: tuple[str, ...], size: int, overlap: int
) -> Iterator[tuple[int, int]]:
    """Stretches of at most ``size``, made of neighbouring pieces.

    A stretch starts again inside the last one, at the first piece from which at most
    ``overlap`` characters are repeated and the new piece still fits. A piece that is too
    long by itself is cut at the finer separators. Only the starts of the current
    stretch's pieces are held, however long the text.
    """
    level = next(i for i, s in enumerate(separators) if not s or text.find(s, lo, hi) >= 0)
    finer = separators[level + 1 :]
    held: deque[int] = deque()
    starts = _starts(text, lo, hi, separators[level])
    start = next(starts, hi)
    while start < hi:
        end = next(starts, hi)
        if end - start >= size and finer:
            if held:
                yield held[0], start
                held.clear()
            yield from _spans(text, start, end, finer, size, overlap)
        else:
            if held and end - held[0] > size:
                yield held[0], start
                while held and (start - held[0] > overlap or end - held[0] > size):
                    held.popleft()
            held.append(start)
        start = end
    if held:
        yield held[0], hi


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Chunks of one text: cut at blank lines, else lines, else words, else anywhere."""
    chunks = (text[a:b].strip() for a, b in _spans(text, 0, len(text), SEPARATORS, size, overlap))
    return [c for c in chunks if c]


def chunk_text(
    docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Chunks of at most ``size`` characters cut at separators, overlapping by ``overlap``.

    A text that fits into one chunk is one, and never leaves the JVM.
    """
    rest = [c for c in docs.columns if c != text]

    def split(series: pd.Series) -> pd.Series:
        return series.map(lambda t: split_text(t, size, overlap), na_action="ignore")

    chunks = F.pandas_udf(split, T.ArrayType(T.StringType()))
    fits = F.length(text) <= size
    short = docs.filter(fits).select(*rest, F.lit(0).alias("chunk_idx"), strip_space(F.col(text)).alias("chunk"))
    long = docs.filter(~fits).select(*rest, F.posexplode(chunks(F.col(text))).alias("chunk_idx", "chunk"))
    return short.filter(F.col("chunk") != "").unionByName(long)


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    """Add ``chunk_id``, which sorts like document and position."""
    position = F.lpad(F.col("chunk_idx").cast("string"), 9, "0")
    return chunks.withColumn("chunk_id", F.concat("doc_id", F.lit("#"), position))


class Embedder(Protocol):
    """Turns a text column into a vector column ``embedding``."""

    def embed(self, df: DataFrame, text: str) -> DataFrame: ...


class HashingEmbedder:
    """Unit vectors of hashed word counts. Needs no model and runs inside the JVM."""

    def __init__(self, dimension: int = 256) -> None:
        self.dimension = dimension

    def counts(self, df: DataFrame, text: str, name: str = "_counts") -> DataFrame:
        """``df`` with the counts of hashed words, as a vector; without rows that have no word."""
        # (?U): letters with accents are part of a word
        tokens = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"(?U)\W+")
        hashed = HashingTF(inputCol="_tokens", outputCol=name, numFeatures=self.dimension)
        # asked of the text: a filter on the tokens would tokenise every text twice
        worded = df.filter(F.col(text).rlike(r"(?U)\w"))
        return hashed.transform(tokens.transform(worded)).drop("_tokens")

    def embed(self, df: DataFrame, text: str) -> DataFrame:
        unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
        vectors = unit.transform(self.counts(df, text))
        return vectors.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_counts", "_unit")


class ModelEmbedder:
    """Vectors of a model that ``load(model_name, device)`` brings up once per worker.

    ``load`` returns a function from an array of texts to a matrix, one row per text.
    """

    def __init__(
        self,
        load: Callable[[str, str], Callable[[np.ndarray], np.ndarray]],
        model_name: str,
        device: str = "cpu",
        batch_size: int = 64,
    ) -> None:
        self.load = load
        self.model_name = model_name
        self.device = device
        self.batch_size = batch_size

    def embed(self, df: DataFrame, text: str) -> DataFrame:
        load, model_name, device = self.load, self.model_name, self.device
        vector = predict_batch_udf(
            lambda: load(model_name, device),
            return_type=T.ArrayType(T.FloatType()),
            batch_size=self.batch_size,
        )
        return df.filter(F.col(text).isNotNull()).withColumn("embedding", vector(F.col(text)))

    def raising(self, df: DataFrame, text: str) -> DataFrame:
        """The rows whose text makes the model raise, with ``error``, the reason; found where they lie.

        A batch that raises is halved in its task until each such text stands alone.
        """
        load, model_name, device, size = self.load, self.model_name, self.device, self.batch_size

        def errors(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load(model_name, device)

            def run(texts: np.ndarray) -> list[str | None]:
                try:
                    model(texts)
                except Exception as error:  # whatever a model may raise is this row's reason
                    if len(texts) > 1:
                        middle = len(texts) // 2
                        return run(texts[:middle]) + run(texts[middle:])
                    return [str(error).strip() or type(error).__name__]
                return [None] * len(texts)

            for texts in series:
                values = texts.to_numpy()
                found = [e for lo in range(0, len(values), size) for e in run(values[lo : lo + size])]
                yield pd.Series(found, dtype=object)

        reason = F.pandas_udf(errors, T.StringType())
        told = df.filter(F.col(text).isNotNull()).withColumn("error", reason(F.col(text)))
        return told.filter(F.col("error").isNotNull())


def embed(df: DataFrame, text: str = "chunk", embedder: Embedder | None = None) -> DataFrame:
    """Add ``embedding``; rows whose text has no word are left out."""
    return (embedder or HashingEmbedder()).embed(df, text)
