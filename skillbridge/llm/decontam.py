"""Benchmark decontamination by templates.

Texts become templates: numbers, units and names turn into typed placeholders, all else into
lower case. Windows of template words of the benchmark are joined by hash with those of the
documents, so a question is found though it was given other numbers or names. A match by
placeholders stands only if its slots agree: wherever the benchmark repeats a value, the document
repeats its own one; a match word by word always stands. Texts are read three ways, each with windows of its own: with names inside sentences as
placeholders, with all capitalised words as such, and word by word in case-folded letters
without any placeholder, so that copies in another case are found.

Every window of every document is hashed where the text lies. Those that a bit set of fixed
size rules out go no further, the rest are shuffled to the benchmark's. A window that fills
many documents is split by Spark, as the benchmark holds each (window, item, place) once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillbridge.llm.spans import Texts, chunks, mix, span_hashes, spans, windows
from skillbridge.llm.store import bit_filter, may_hold, same, small_batches, tidied, unused, written

WINDOW = 13  # template words of a window; an item with fewer is one window
SHORTEST = 5  # items with fewer words are no evidence
LITERALS = 5  # words of a window that must not be placeholders

# Units that become a placeholder.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms "
    "oz ounce ounces lb lbs pound pounds ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur gbp kmh mph percent degree degrees meter meters metre metres"
).split()

_WORDLIKE = np.zeros(256, dtype=bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_LETTER = _WORDLIKE & ~_DIGIT
# what ends a sentence, or the line before: the next word may be a capital without being a name
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?:;\n\"'("]] = True
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
# readings of a text, as bits: names inside sentences, all capitals as names, no placeholders
TYPED, INITIAL, LITERAL = 1, 2, 4
# letters that lower case leaves apart from the capitals of the same word
_FOLDED = (("ß", "ss"), ("ς", "σ"))
_PLACEHOLDERS = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _unit_hashes() -> np.ndarray:
    joined = np.frombuffer(" ".join(UNITS).encode(), dtype=np.uint8)
    one = Texts(0, joined, np.array([0]), np.array([len(joined)]))
    found = spans(one, _WORDLIKE)
    return np.sort(span_hashes(joined, found.start, found.stop))


def _one_piece(column: pa.Array) -> Texts:
    return next(chunks(column, 1 << 40))


def _capital(data: np.ndarray, at: np.ndarray, lower: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Which words begin with a letter that is another one in lower case."""
    out = data[at] != lower[there]
    behind = np.searchsorted([0xC0, 0xE0, 0xF0], data[at], side="right")  # bytes of the letter after its first
    for k in (1, 2, 3):
        more = (behind >= k) & ~out
        out[more] = data[at[more] + k] != lower[there[more] + k]
    return out


def readings(texts: Texts, column: pa.Array, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Per word: its text, hash of the value, and for each reading its kind.

    ``column`` holds the strings of ``texts``. A number is a word with a digit and no letter; a
    unit is one of :data:`UNITS` behind a number; a name starts with a capital and, unless all
    capitals are read as names, follows a word of its sentence. Values are case-folded.
    """
    found = spans(texts, _WORDLIKE)
    none = np.empty(0, dtype=np.int64)
    if not len(found.start):
        return none, none.astype(np.uint64), {r: none for r in (TYPED, INITIAL, LITERAL)}
    data = texts.data
    lowered = pc.utf8_lower(pc.fill_null(column, ""))
    lower = _one_piece(lowered)
    there = spans(lower, _WORDLIKE)  # the same words, at other places
    folded = lowered
    for letter, other in _FOLDED:
        folded = pc.replace_substring(folded, letter, other)
    fold = _one_piece(folded)
    within = spans(fold, _WORDLIKE)
    value = span_hashes(fold.data, within.start, within.stop)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    ends = np.concatenate([[0], np.cumsum(_ENDS[data])])
    a, b = found.start, found.stop
    number = (digits[b] > digits[a]) & (letters[b] == letters[a])
    follows = np.zeros(len(a), dtype=bool)
    follows[1:] = found.text[1:] == found.text[:-1]
    after_number = np.zeros(len(a), dtype=bool)
    after_number[1:] = number[:-1]
    at = np.minimum(np.searchsorted(units, value), len(units) - 1)
    unit = ~number & (units[at] == value) & follows & after_number
    inside = np.zeros(len(a), dtype=bool)
    inside[1:] = ends[a[1:]] == ends[b[:-1]]
    capital = _capital(data, a, lower.data, there.start) & ~unit
    typed = np.select([number, unit, capital & follows & inside], [NUMBER, UNIT, NAME], WORD)
    kinds = {TYPED: typed, INITIAL: np.where(capital, NAME, typed), LITERAL: np.zeros_like(typed)}
    return found.text, value, kinds


def _windows(text, value, kind, reading: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of the windows with enough words that are no placeholders."""
    key, at = windows(np.where(kind == WORD, value, _PLACEHOLDERS[kind]), text, size)
    plain = np.concatenate([[0], np.cumsum(kind == WORD)])
    enough = plain[at + size] - plain[at] >= min(LITERALS, size)
    return mix(key[enough] + np.uint64(size + 256 * reading)), at[enough]


_COLUMNS = "window long, place long, size int, reading int, kinds array<tinyint>, vals array<long>"


def _rows(ids: pa.Array, text, value, kinds, sizes, keep) -> Iterator[pa.RecordBatch]:
    """Windows that ``keep`` accepts, with their slots: kinds and values of all their words."""
    begin = np.searchsorted(text, np.arange(len(ids)))
    for size, (reading, kind) in product(sizes, kinds.items()):
        key, at = _windows(text, value, kind, reading, size)
        good = keep(key, at, size)
        key, at = key[good], at[good]
        if not len(key):
            continue
        for lo in range(0, len(key), 10_000):
            k, p = key[lo : lo + 10_000], at[lo : lo + 10_000]
            cells = (p[:, None] + np.arange(size)).ravel()
            ends = pa.array(np.arange(len(k) + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(text[p])),
                    pa.array(k.view(np.int64)),
                    pa.array((p - begin[text[p]]).astype(np.int64)),
                    pa.array(np.full(len(k), size, dtype=np.int32)),
                    pa.array(np.full(len(k), reading, dtype=np.int32)),
                    pa.ListArray.from_arrays(ends, pa.array(kind[cells].astype(np.int8))),
                    pa.ListArray.from_arrays(ends, pa.array(value[cells].view(np.int64))),
                ],
                ["id", "window", "place", "size", "reading", "kinds", "vals"],
            )


def _item_windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Columns ``id, text`` of a benchmark to its windows; a short item is one window."""
    units = _unit_hashes()
    for batch in batches:
        for texts in chunks(batch.column(1)):
            text, value, kinds = readings(texts, batch.column(1).slice(texts.first, len(texts)), units)
            ids = batch.column(0).slice(texts.first, len(texts))
            words = np.bincount(text, minlength=len(texts))

            def fits(key, at, n, text=text, words=words):
                return (n == size) | (words[text[at]] == n)

            yield from _rows(ids, text, value, kinds, range(SHORTEST, size + 1), fits)


def _doc_windows(batches: Iterator[pa.RecordBatch], sizes: list[int], wanted) -> Iterator[pa.RecordBatch]:
    """Columns ``doc, th, text`` to the windows that the bit set lets pass."""
    units = _unit_hashes()
    for batch in batches:
        ids = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["doc", "th"])
        for texts in chunks(batch.column(2)):
            parts = readings(texts, batch.column(2).slice(texts.first, len(texts)), units)

            def fits(key, at, n):
                return may_hold(wanted.value, key)

            yield from _rows(ids.slice(texts.first, len(texts)), *parts, sizes, fits)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    window: int = WINDOW,
) -> DataFrame:
    """``doc_id, th, item_id, n_windows, n_slots, exact`` for each document and item that match.

    ``n_windows`` counts windows of the item in the document, in any reading whose slots agree,
    ``n_slots`` its distinct slot values, and ``exact`` says that all values are the item's
    own, case aside. ``th`` is a hash of the text. Windows are ``window`` words; an item of fewer
    words is one window, and one of fewer than :data:`SHORTEST` matches nothing, as do NULL
    and empty texts. Windows with fewer than :data:`LITERALS` plain words match word by word only.
    Windows that are equal word by word always count; those with placeholders count unless the slots of
    their passage disagree. Items and documents that repeat an id are
    reported under it; rows equal in id and text count once. Empty tables give no matches. Texts of any
    length are read whole; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.select(F.col(f"`{doc_id}`")).schema[0].dataType.simpleString()
    item_kind = benchmark.select(F.col(f"`{item_id}`")).schema[0].dataType.simpleString()
    items = benchmark.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{item_text}`").alias("text"))
    items = written(
        items.mapInArrow(lambda b: _item_windows(b, window), f"id {item_kind}, {_COLUMNS}").distinct(), "item-windows"
    )
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    wanted = spark.sparkContext.broadcast(bit_filter(items.select("window").distinct(), "window"))
    source = docs.select(
        F.col(f"`{doc_id}`").alias("doc"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("th"),
        F.col(f"`{text}`").alias("text"),
    )
    found = source.mapInArrow(
        tidied(lambda b: _doc_windows(b, sizes, wanted)), f"id struct<doc: {kind}, th: bigint>, {_COLUMNS}"
    ).distinct()
    theirs = items.select(
        F.col("id").alias("item"), "window", "size", "reading", "kinds", F.col("place").alias("at"), F.col("vals").alias("asked")
    )
    joined = found.join(theirs, ["window", "size", "reading", "kinds"])
    # words that are no slots must be equal, whatever the hashes say
    pairs = F.arrays_zip("kinds", "vals", "asked")
    plain = F.forall(pairs, lambda p: (p["kinds"] != WORD) | (p["vals"] == p["asked"]))
    slots = F.filter(pairs, lambda p: p["kinds"] != WORD)
    joined = joined.filter(plain).select(
        "id", "item", "reading", "at", (F.col("place") - F.col("at")).alias("shift"), slots.alias("slots")
    )
    # one value of the item stands for one value of the document, over all windows of the passage
    match = ["id", "item", "shift"]
    values = joined.select(*match, "reading", F.explode("slots").alias("s")).groupBy(
        *match, "reading", "s.kinds", "s.asked"
    ).agg(F.min("s.vals").alias("lo"), F.max("s.vals").alias("hi"))
    own = (F.col("lo") == F.col("asked")) & (F.col("hi") == F.col("asked"))
    agreed = values.groupBy(*match).agg(
        F.bit_or(F.when(F.col("lo") != F.col("hi"), F.col("reading")).otherwise(0)).alias("torn"),
        F.bit_or(F.when(own, 0).otherwise(F.col("reading"))).alias("changed"),
        F.count_if(F.col("reading") == TYPED).alias("typed"),
        F.count_if(F.col("reading") == INITIAL).alias("initial"),
    )
    held = joined.groupBy(*match, "at").agg(F.bit_or("reading").alias("held"))
    per_choice = [F.count_if(F.col("held").bitwiseAND(r) != 0) for r in range(2 * LITERAL)]
    counted = held.groupBy(*match).agg(F.bit_or("held").alias("held"), F.array(*per_choice).alias("per_choice"))
    null = [same(counted[c], agreed[c]) for c in match]
    bad = F.coalesce("torn", F.lit(0))  # never the reading word by word, which has no slots
    judged = counted.join(agreed, null[0] & null[1] & null[2], "left").select(
        *[counted[c] for c in match],
        "per_choice",
        F.col("held").bitwiseAND(F.bitwise_not(bad)).alias("good"),
        F.coalesce("changed", F.lit(0)).alias("changed"),
        F.coalesce("typed", F.lit(0)).alias("typed"),
        F.coalesce("initial", F.lit(0)).alias("initial"),
    )
    good = F.col("good")
    judged = judged.filter(good != 0).select(
        *match,
        F.col("per_choice")[good].alias("n_windows"),
        F.when(good.bitwiseAND(TYPED) != 0, F.col("typed"))
        .when(good.bitwiseAND(INITIAL) != 0, F.col("initial"))
        .otherwise(0)
        .alias("n_slots"),
        (good.bitwiseAND(F.col("changed")) == 0).alias("exact"),
    )
    best = F.max_by(F.struct("n_windows", "n_slots", "exact"), F.struct("n_windows", "exact", "shift"))
    out = judged.groupBy("id", "item").agg(best.alias("best"))
    return out.select(
        F.col("id.doc").alias(doc_id),
        F.col("item").alias(item_id),
        F.col("best.n_windows").alias("n_windows"),
        F.col("best.n_slots").alias("n_slots"),
        F.col("best.exact").alias("exact"),
        F.col("id.th").alias("th"),
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **kw
) -> DataFrame:
    """``docs`` without those that match an item; all other rows stay as they are.

    NULL and empty texts stay, repeated rows go or stay together. All columns are kept, whatever their
    names; an empty table gives an empty one.
    """
    hits = matches(docs, benchmark, text, doc_id, **kw)
    doc, th = unused(docs.columns, "_doc", "_th")
    hits = hits.select(F.col(f"`{doc_id}`").alias(doc), F.col("th").alias(th)).distinct()
    here = same(F.col(f"`{doc_id}`"), F.col(doc)) & (
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))) == F.col(th)
    )
    return docs.join(written(hits, "contaminated").hint("shuffle_hash"), here, "left_anti")
