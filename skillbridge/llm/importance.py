"""Importance resampling: documents that look like a target, drawn by weight.

Two bags of hashed word 1- and 2-grams are counted, one over the target and one over all raw
documents. A document's log weight is the log ratio of its likelihoods under the two. Adding
Gumbel noise to it and keeping the largest is a draw without replacement in proportion to the
weights.

The target is every document labelled as good; the raw counts, the weights and the draw cover
every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillbridge.llm.spans import Texts, chunks, mix, span_hashes, spans, windows
from skillbridge.llm.store import small_batches, written

BUCKETS = 10_000
SMOOTHING = 1.0
BINS = 1024  # ranges counted in a step towards the k-th largest

_WORDLIKE = np.ones(256, dtype=bool)
_WORDLIKE[[*range(0, 33)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gram_buckets(texts: Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every 1- and 2-gram, and the number of its text; with repeats."""
    found = spans(texts, _WORDLIKE)
    words = span_hashes(_LOWER[texts.data], found.start, found.stop)
    pairs, at = windows(words, found.text, 2)
    hashes = np.concatenate([words, mix(pairs)])
    return (hashes % np.uint64(buckets)).astype(np.int64), np.concatenate([found.text, found.text[at]])


def _counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Columns ``target, text`` to counts per bucket, a row for each and task."""
    raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        wanted = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for texts in chunks(batch.column(1)):
            bucket, text = gram_buckets(texts, buckets)
            raw += np.bincount(bucket, minlength=buckets)
            target += np.bincount(bucket[wanted[texts.first + text]], minlength=buckets)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])


def target_ids(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The distinct ids labelled as good (``quality`` 1)."""
    return labels.filter("quality = 1").select(F.col(f"`{doc_id}`").alias("id")).dropna().distinct()


def log_ratios(docs: DataFrame, ids: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket the log of its probability in the target over that in all documents.

    ``ids`` are distinct (:func:`target_ids`). They grow with the labels, so they are joined by a
    shuffle and not sent to all tasks; the hash table is of the ids, the texts are not sorted.
    """
    small_batches(docs.sparkSession)
    flagged = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(
        ids.withColumn("target", F.lit(True)).hint("shuffle_hash"), "id", "left"
    )
    rows = flagged.select(F.coalesce("target", F.lit(False)).alias("target"), "text")
    counts = rows.mapInArrow(lambda b: _counts(b, buckets), "bucket long, raw long, target long")
    summed = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = summed["bucket"].to_numpy(np.int64)
    raw[at], target[at] = summed["raw"], summed["target"]
    if not target.sum():
        return np.zeros(buckets)  # nothing to prefer
    raw, target = raw + SMOOTHING, target + SMOOTHING
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, th, n_grams, log_weight`` of every row; the weight is NULL without grams."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(ratios)
    value = F.col(f"`{text}`")
    source = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.coalesce(value, F.lit(""))).alias("th"), value.alias("text")
    )
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for texts in chunks(batch.column(2)):
                bucket, at = gram_buckets(texts, len(sent.value))
                n = np.bincount(at, minlength=len(texts))
                weight = np.bincount(at, weights=sent.value[bucket], minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, len(texts)),
                        batch.column(1).slice(texts.first, len(texts)),
                        pa.array(n),
                        pa.array(weight, mask=n == 0),
                    ],
                    ["id", "th", "n_grams", "log_weight"],
                )

    return source.mapInArrow(run, f"id {kind}, th long, n_grams long, log_weight double").withColumnRenamed("id", doc_id)


def gumbel(seed: int, *columns: str | Column) -> Column:
    """Standard Gumbel noise that depends on the values only, so it survives a lost task."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12)
    uniform = (bits.cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The ``k``-th largest value, NULL aside; None if there are fewer.

    Counts values in ranges and goes on in the range that holds it; what reaches the driver
    are ``BINS`` rows a step.
    """
    values = df.select(F.col(column).alias("x")).dropna()
    stats = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
    if k < 1 or stats["n"] < k:
        return None
    lo, hi = stats["lo"], stats["hi"]
    while lo < hi:
        width = (hi - lo) / BINS
        # so near to each other that no width is left: by value, of which there are few
        place = F.least(F.floor((F.col("x") - lo) / width), F.lit(BINS - 1)) if width > 0 else F.col("x")
        bins = (
            values.filter((F.col("x") >= lo) & (F.col("x") <= hi))
            .groupBy(place.alias("bin"))
            .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .orderBy(F.desc("bin"))
            .collect()
        )
        for b in bins:
            if b["n"] >= k:
                lo, hi = b["lo"], b["hi"]
                break
            k -= b["n"]
    return hi


def resample(
    docs: DataFrame,
    ids: DataFrame,
    share: float = 0.8,
    seed: int = 17,
    text: str = "text",
    doc_id: str = "doc_id",
    buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id, n_grams, log_weight, key, kept`` of every row.

    ``kept`` marks the ``share`` of all documents with grams, rounded up, whose key (log
    weight and noise) is largest; rows that tie with the last of them are kept as well, so
    repeated rows are kept or not together. Texts that are NULL, empty or blank have no
    weight and are never kept. Without target documents all weights are 0 and the draw is
    uniform. An empty table gives an empty one. Texts of any length are counted whole; other columns
    are not read.
    """
    ratios = log_ratios(docs, ids, text, doc_id, buckets)
    noise = F.when(F.col("log_weight").isNotNull(), F.col("log_weight") + gumbel(seed, F.col(doc_id), F.col("th")))
    keyed = written(weigh(docs, ratios, text, doc_id).withColumn("key", noise), "weights")
    weighed = keyed.filter("key IS NOT NULL").count()
    least = kth_largest(keyed, "key", int(np.ceil(share * weighed)))
    kept = F.lit(False) if least is None else F.coalesce(F.col("key") >= least, F.lit(False))
    return keyed.select(doc_id, "n_grams", "log_weight", "key", kept.alias("kept"))
