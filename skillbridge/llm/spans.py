"""Words and shingles of many texts at once, as arrays.

Texts stay UTF-8 bytes. A word is hashed eight bytes at a time: each group is mixed with its place
in the word, the mixed groups are summed up and mixed again with the length. A task handles about a
million bytes at a time, and one text at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
# masks of the first 0 to 8 bytes of a group, as read from memory
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Texts:
    """Some texts laid end to end."""

    first: int  # number of the first text in its batch
    data: np.ndarray  # uint8
    begin: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.begin)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """A string column in pieces of about ``limit`` bytes; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset :][: len(column) + 1]
    data = np.frombuffer(data_buffer or b"", dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        part = offsets[lo : hi + 1]
        yield Texts(lo, data[part[0] : part[-1]], part[:-1] - part[0], part[1:] - part[0])
        lo = hi


@dataclass
class Spans:
    """Words of :class:`Texts`: where they are, and in which text."""

    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray  # number of the text within the chunk


def spans(texts: Texts, is_word: np.ndarray) -> Spans:
    """Runs of bytes that the table ``is_word`` (256 booleans) marks; none crosses texts."""
    inside = is_word[texts.data]
    if not len(inside):
        none = np.empty(0, dtype=np.int64)
        return Spans(none, none, none)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    filled = texts.end > texts.begin
    before[texts.begin[filled]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[texts.end[filled] - 1] = False
    start = np.flatnonzero(inside & ~before)
    stop = np.flatnonzero(inside & ~after) + 1
    return Spans(start, stop, np.searchsorted(texts.end, start, side="right"))


def span_hashes(
    codes: np.ndarray, start: np.ndarray, stop: np.ndarray, base: np.uint64 = _BASE
) -> np.ndarray:
    """A 64-bit hash of each span of ``codes`` (unsigned integers of 1, 2, 4 or 8 bytes).

    Another ``base`` gives another hash. No two spans of one length up to eight bytes share one.
    """
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    width = codes.dtype.itemsize
    each = 8 // width  # codes in a group
    padded = np.concatenate([codes, np.zeros(each, dtype=codes.dtype)]).view(np.uint8)
    # the eight bytes from each code on
    from_here = np.ndarray(len(codes) + 1, dtype="<u8", buffer=padded, strides=(width,))
    length = stop - start
    count = np.maximum(1, -(-length // each))
    group, at, left = np.zeros(len(start), dtype=np.int64), start, length
    several = bool((count > 1).any())
    if several:
        first = np.cumsum(count) - count
        group = np.arange(int(count.sum())) - np.repeat(first, count)
        at = np.repeat(start, count) + group * each
        left = np.repeat(length, count) - group * each
    inside = _FIRST_BYTES[np.minimum(left, each) * width]
    value = mix((from_here[at] & inside) ^ ((group + 1).astype(np.uint64) * base))
    if several:
        value = np.add.reduceat(value, first)
    return mix(value + length.astype(np.uint64) * base)


def windows(word: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size`` consecutive words of one text, and the number of the first."""
    count = len(word) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    at = np.flatnonzero(text[:count] == text[size - 1 :])
    out = word[at]
    for k in range(1, size):
        out = mix(out * _BASE + word[at + k])
    return out, at
