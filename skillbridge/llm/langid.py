"""Language identification by n-gram filters whose slots are bitmasks of languages.

One table of slots serves all languages: bit ``l`` of a slot is set if an n-gram of language
``l`` falls on it, under any of ``HASHES`` hash functions. The AND of an n-gram's slots is
thus the set of languages that may contain it. A text's n-grams are counted per language by
these bits; each count is corrected for what the language's filter says by mistake, and the
largest decides.

An n-gram belongs to a language if enough of the language's documents contain it, counted
over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillbridge.llm.spans import Texts, chunks, mix
from skillbridge.llm.store import small_batches

SLOTS = 1 << 20
HASHES = 3
SHARE = 0.003  # of a language's documents must contain an n-gram
MIN_DOCS = 2
MAX_LANGUAGES = 63  # bits of a mask
COUNTED = 4_000_000  # n-grams that a task counts before it sends
UNKNOWN = "und"

_PLAIN = np.full(256, 32, dtype=np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[0x80:] = np.arange(0x80, 0x100)


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 4-grams of each text and the number of the text.

    Bytes of letters, in lower case a-z; all else is a blank, as are both ends. An n-gram may
    begin and end with a blank, but has none inside.
    """
    size = texts.end - texts.begin
    text = np.repeat(np.arange(len(texts)), size)
    data = np.full(len(texts.data) + len(texts) + 1, 32, dtype=np.uint8)
    at = np.arange(len(texts.data)) + text + 1
    data[at] = _PLAIN[texts.data]
    owner = np.zeros(len(data), dtype=np.int64)
    owner[at] = text
    if len(data) < 4:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    inner = (data[1:-2] != 32) & (data[2:-1] != 32)
    first = np.flatnonzero(inner)
    value = np.zeros(len(first), dtype=np.uint64)
    for k in range(4):
        value = (value << np.uint64(8)) | data[first + k]
    cell = (owner[first + 1].astype(np.uint64) << np.uint64(32)) | value
    cell = np.unique(cell)
    return cell & np.uint64(0xFFFFFFFF), (cell >> np.uint64(32)).astype(np.int64)


def slots(gram: np.ndarray) -> list[np.ndarray]:
    keys = [mix(gram + np.uint64(k << 40)) for k in range(1, HASHES + 1)]
    return [(k % np.uint64(SLOTS)).astype(np.int64) for k in keys]


@dataclass
class Filters:
    languages: list[str]
    usual: int  # the language of most documents
    masks: np.ndarray

    def __post_init__(self) -> None:
        bits = [(self.masks >> np.uint64(k)) & np.uint64(1) for k in range(len(self.languages))]
        full = np.array([b.mean() for b in bits]) if bits else np.empty(0)
        self.mistaken = full**HASHES

    def containing(self, gram: np.ndarray) -> np.ndarray:
        """The languages that may contain each n-gram, as bits."""
        out = None
        for at in slots(gram):
            out = self.masks[at] if out is None else out & self.masks[at]
        return out

    def predict(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of each text, and its share of all corrected counts."""
        gram, text = grams(texts)
        mask = self.containing(gram)
        total = np.bincount(text, minlength=len(texts))
        counts = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            hit = ((mask >> np.uint64(k)) & np.uint64(1)).astype(float)
            hits = np.bincount(text, weights=hit, minlength=len(texts))
            counts[:, k] = np.maximum(0.0, (hits - total * self.mistaken[k]) / max(1e-9, 1 - self.mistaken[k]))
        best = counts.argmax(axis=1)
        every = counts.sum(axis=1)
        score = np.divide(counts.max(axis=1), every, out=np.zeros(len(texts)), where=every > 0)
        return np.where(every > 0, best, self.usual), score


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: CRC-32 of the id's text modulo 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns ``lang`` (a number), ``text`` to ``lang, gram, n``."""
    held, total = [], 0

    def flush():
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        lang, gram = (cell >> np.uint64(32)).astype(np.int32), (cell & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        lang = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        for texts in chunks(batch.column(1)):
            gram, text = grams(texts)
            held.append((lang[texts.first + text] << np.uint64(32)) | gram)
            total += len(gram)
            if total >= COUNTED:
                yield flush()
                held, total = [], 0
    if held:
        yield flush()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bit = np.int64(1) << batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in slots(batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bit)], ["slot", "bit"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters of all languages of ``docs``; rows without a language or text teach nothing."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).dropna()
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    masks = np.zeros(SLOTS, dtype=np.uint64)
    if not languages:
        return Filters([], 0, masks)
    number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1
    counts = known.select(number.cast("int").alias("lang"), "text").mapInArrow(_counts, "lang int, gram long, n long")
    least = F.array(*[F.lit(max(MIN_DOCS, int(np.ceil(SHARE * sizes[name])))) for name in languages])
    enough = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.get(least, F.col("lang")))
    filled = (
        enough.select("lang", "gram")
        .mapInArrow(_placed, "slot long, bit long")
        .groupBy("slot")
        .agg(F.bit_or("bit").alias("mask"))
        .toPandas()
    )
    masks[filled["slot"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64).view(np.uint64)
    return Filters(languages, max(range(len(languages)), key=lambda k: sizes[languages[k]]), masks)


def predict(docs: DataFrame, filters: Filters, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row.

    ``und`` and 0 for a text that is NULL or has no letter, or if nothing was learned. A text
    whose n-grams no language knows, or that has none, is given the language of most
    documents, with score 0; ties go to the language first in order. Repeated rows get equal
    results, an empty table none. Texts of any length are looked at whole, and nothing but the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # plain values, as executors need not have the package to read a broadcast
    sent = spark.sparkContext.broadcast((filters.languages, filters.usual, filters.masks))
    value = F.col(f"`{text}`")
    letters = F.coalesce(value.rlike(r"\p{L}"), F.lit(False))
    source = docs.select(F.col(f"`{doc_id}`").alias("id"), F.when(letters, value).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        learned = Filters(*sent.value)
        names = np.array([*learned.languages, UNKNOWN], dtype=object)
        for batch in batches:
            missing = batch.column(1).is_null().to_numpy(zero_copy_only=False) | (len(names) == 1)
            for texts in chunks(batch.column(1)):
                part = slice(texts.first, texts.first + len(texts))
                best, score = learned.predict(texts) if len(names) > 1 else (np.zeros(len(texts), int), np.zeros(len(texts)))
                best, score = np.where(missing[part], len(names) - 1, best), np.where(missing[part], 0.0, score)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts)), pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                    ["id", "lang_pred", "score"],
                )

    return source.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", doc_id)
