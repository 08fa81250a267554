"""Token counts of the sections of a document, by the offsets of its tokens.

A document is encoded once and as a whole. Each token covers a span of characters, which is
joined with the spans of the sections; both are in order, so a binary search does it. A token
that crosses a boundary is given to one section by a stated rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillbridge.llm.store import small_batches

RULES = ("first", "last", "largest")


def line_sections(text: str) -> np.ndarray:
    """Character spans of the lines of a text; a line break belongs to the line it ends."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ends = np.flatnonzero(codes == 10) + 1
    if not len(ends) or ends[-1] < len(codes):
        ends = np.append(ends, len(codes))
    return np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1)


def token_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters that tokens of so many bytes cover: all of which they hold a byte."""
    chars = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
    ends = np.cumsum(lengths)
    return chars[ends - lengths] - 1, chars[ends - 1]


def allocate(start: np.ndarray, stop: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """How many tokens each section gets.

    ``first`` and ``last`` go by the section of a token's first or last character, ``largest``
    by the section that holds most of its characters, the earlier one if several do. Sections
    are in order and don't overlap; a token that none touches (by the rule) is not counted.
    """
    out = np.zeros(len(sections), dtype=np.int64)
    if not len(sections) or not len(start):
        return out
    lo, hi = sections[:, 0], sections[:, 1]
    first = np.searchsorted(hi, start, side="right")  # the first section that ends behind it
    last = np.searchsorted(lo, stop - 1, side="right") - 1
    if rule == "last":
        inside = (last >= 0) & (hi[np.maximum(last, 0)] > stop - 1)
        return np.bincount(last[inside], minlength=len(sections))
    inside = first < len(sections)
    inside &= lo[np.minimum(first, len(lo) - 1)] <= start
    if rule == "first":
        return np.bincount(first[inside], minlength=len(sections))
    alone = (first == last) & (first < len(sections))
    out += np.bincount(first[alone], minlength=len(sections))
    for token in np.flatnonzero(first < last):
        a, b = first[token], last[token] + 1
        shared = np.minimum(hi[a:b], stop[token]) - np.maximum(lo[a:b], start[token])
        out[a + int(np.argmax(shared))] += 1
    return out


def section_counts(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text: str = "text",
    doc_id: str = "doc_id",
    sections: str | None = None,
    rule: str = "largest",
) -> DataFrame:
    """``doc_id, section, start, stop, n_tokens``: a row for each section of each row.

    ``sections`` names a column of ``array<struct<start, stop>>`` (characters, in order, not
    overlapping); without it every line is a section. By the rules of :func:`allocate` a
    token is counted once, so the lines of a text add up to its tokens. NULL and empty texts
    have one empty section with no tokens (given sections: those, with no tokens); repeated
    rows and NULL ids are counted as any. Texts of any length are encoded whole. Other columns are
    not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    small_batches(spark)
    size = max(ranks.values(), default=-1) + 1
    lengths = np.zeros(size, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    sent = spark.sparkContext.broadcast((ranks, lengths))
    columns = [F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")]
    if sections:
        a, b = docs.select(F.col(f"`{sections}`")).schema[0].dataType.elementType.fieldNames()[:2]
        spans = F.transform(F.col(f"`{sections}`"), lambda s: F.array(s[a].cast("long"), s[b].cast("long")))
        columns.append(F.coalesce(F.flatten(spans), F.array().cast("array<bigint>")).alias("spans"))
    source = docs.select(*columns)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sizes = sent.value
        encoding = tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            own, spans, counts = [], [], []
            for k in range(batch.num_rows):
                value = batch.column(1)[k].as_py() or ""
                if sections:
                    mine = np.array(batch.column(2)[k].as_py(), dtype=np.int64).reshape(-1, 2)
                else:
                    mine = line_sections(value)
                tokens = encoding.encode_to_numpy(value, disallowed_special=())
                start, stop = token_spans(value.encode(), sizes[tokens])
                own.append(np.full(len(mine), k))
                spans.append(mine)
                counts.append(allocate(start, stop, mine, rule))
            if not own:
                continue
            row, at = np.concatenate(own), np.concatenate(spans)
            number = np.concatenate([np.arange(len(s)) for s in spans])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(number.astype(np.int32)),
                    pa.array(at[:, 0].astype(np.int64)),
                    pa.array(at[:, 1].astype(np.int64)),
                    pa.array(np.concatenate(counts)),
                ],
                ["id", "section", "start", "stop", "n_tokens"],
            )

    out = source.mapInArrow(run, f"id {kind}, section int, start long, stop long, n_tokens long")
    return out.withColumnRenamed("id", doc_id)
