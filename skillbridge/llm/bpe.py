"""Byte-level BPE over a table: every distinct word is encoded once, by a shuffle of words.

1. Texts are cut into *blocks* of some million characters. A block is split into pre-tokens
   (words, numbers, punctuation, white space) by the vocabulary's pattern, and keeps each
   text as a sequence of numbers of the block's distinct words: the exploded pre-tokens with
   their positions, packed. Both are written, so block numbers are fixed from there on.
2. Words are shuffled by a hash of the word. The task that meets a word first applies the
   merges to it; all other blocks get the same ids. A word is sent once per block, so the
   most frequent word of the corpus makes no key hot.
3. Ids return to their block, where texts are put together again by position. Blocks are
   written in buckets, so only the ids are shuffled for it.

Decoding joins ids with the table of token bytes, which the vocabulary bounds.

The splitting is done on arrays of code points; the pattern's rules are restated there, and
the classes of characters come from the pattern's own library. Two independent 64-bit hashes
together identify a word within its block; from there on words are compared by their bytes.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillbridge.llm.spans import Texts, chunks, span_hashes
from skillbridge.llm.store import small_batches, tidied, written_by_key

BLOCK_CHARS = 4_000_000
PACK_TOKENS = 1 << 16  # pre-tokens in one packed row, or one text
CACHE_BYTES = 64 << 20  # of distinct words and their ids that a task remembers at once, about
MAX_BUCKETS = 2048
_ENTRY_BYTES = 170  # what an entry of a dict of bytes takes besides its bytes, about
_OTHER_BASE = np.uint64(0xD6E8FEB86659FD93)
OTHER, LETTER, NUMBER, SPACE, EDGE = 0, 1, 2, 3, 255

# The pattern that pretoken_starts restates.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed values of the format: what follows an apostrophe in a token of its own.
ENDINGS_1 = "stmd"
ENDINGS_2 = ("re", "ve", "ll")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, from a rank file; read by the driver only."""
    with open(path, "rb") as file:
        pairs = (line.split() for line in file if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.zeros(0x110000, dtype=np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    where = np.array(points)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for found in regex.finditer(pattern, every):
            out[where[found.start() : found.end()]] = kind
    return out


def pretoken_starts(
    codes: np.ndarray, begin: np.ndarray, end: np.ndarray, classes: np.ndarray
) -> np.ndarray:
    """Where pre-tokens start. ``begin`` and ``end`` are the bounds of texts lying end to end.

    A pre-token is an English ending after an apostrophe; or a run of letters, of numbers or
    of other characters, with a blank before it if there is one; or white space, of which
    the last character is left for what follows.
    """
    if not len(codes):
        return np.empty(0, dtype=np.int64)
    kind = classes[codes]
    filled = end > begin
    before = np.empty_like(kind)
    before[0], before[1:] = EDGE, kind[:-1]
    before[begin[filled]] = EDGE
    after = np.empty_like(kind)
    after[-1], after[:-1] = EDGE, kind[1:]
    after[end[filled] - 1] = EDGE
    space = kind == SPACE
    run = kind != before
    start = run | (space & (after != SPACE) & (after != EDGE))
    blank_before = np.zeros(len(codes), dtype=bool)
    blank_before[1:] = codes[:-1] == 0x20
    start &= ~(run & ~space & (before == SPACE) & blank_before)
    # endings: the apostrophe must start a token, and what follows be in the same text
    at = np.flatnonzero(start & (codes == 0x27) & (after == LETTER))
    if len(at):
        padded = np.concatenate([codes, np.zeros(3, dtype=codes.dtype)])
        one = np.isin(padded[at + 1], [ord(c) for c in ENDINGS_1])
        inner = np.concatenate([after, [EDGE, EDGE]])[at + 1] == LETTER
        two = np.zeros(len(at), dtype=bool)
        for a, b in ENDINGS_2:
            two |= (padded[at + 1] == ord(a)) & (padded[at + 2] == ord(b))
        two &= inner & ~one
        at, length = at[one | two], np.where(one, 1, 2)[one | two]
        start[at + 1] = False
        rest = at + length + 1
        rest = rest[np.concatenate([after, [EDGE] * 3])[at + length] == LETTER]
        start[rest] = True
    return np.flatnonzero(start)


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers below 2**32, byte plane by byte plane, compressed."""
    raw = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return zstandard.compress(np.ascontiguousarray(raw.T).tobytes(), 3)


def _numbers(payload: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(payload), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def _gather(source: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices ``first .. first + length`` of ``source``, end to end."""
    total = int(length.sum())
    base = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else length
    return source[np.arange(total) + np.repeat(first - base, length)]


PRE_SCHEMA = pa.schema(
    [
        ("block", pa.int64()),
        ("kind", pa.int8()),  # 0: words for a bucket, 1: texts
        ("part", pa.int32()),
        ("counts", pa.list_(pa.int32())),
        ("words", pa.binary()),
        ("payload", pa.binary()),
    ]
)


@dataclass
class _Piece:
    """Some texts of a block: their words, and which word is where."""

    ids: pa.Array
    counts: np.ndarray
    hashes: np.ndarray
    check: np.ndarray
    word: np.ndarray  # per pre-token, number within ``hashes``
    codes: np.ndarray
    length: np.ndarray


def _distinct(hashes: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each pair of hashes, and for every place the number of its pair."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    if np.array_equal(check, check[first][number]):
        return first, number
    # words share the first hash: the second one tells them apart
    order = np.lexsort((check, hashes))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (check[order][1:] != check[order][:-1])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _piece(texts: Texts, ids: pa.Array, classes: np.ndarray) -> _Piece:
    # bounds in characters: count the bytes that start one
    starts = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    begin, end = starts[texts.begin], starts[texts.end]
    codes = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
    start = pretoken_starts(codes, begin, end, classes)
    stop = np.append(start[1:], len(codes))
    hashes = span_hashes(codes, start, stop)
    check = span_hashes(codes, start, stop, _OTHER_BASE)
    first, word = _distinct(hashes, check)
    length = (stop - start)[first]
    counts = np.searchsorted(start, end) - np.searchsorted(start, begin)
    return _Piece(ids, counts, hashes[first], check[first], word.astype(np.int32), _gather(codes, start[first], length), length)


def _block_rows(block: int, pieces: list[_Piece], buckets: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    hashes = np.concatenate([p.hashes for p in pieces])
    check = np.concatenate([p.check for p in pieces])
    first, merged = _distinct(hashes, check)
    unique = hashes[first]
    offset = np.cumsum([0] + [len(p.hashes) for p in pieces])
    used = np.zeros(len(unique), dtype=np.int64)
    for p, lo in zip(pieces, offset, strict=False):
        used += np.bincount(merged[lo : lo + len(p.hashes)][p.word], minlength=len(unique))
    order = np.argsort(-used, kind="stable")  # frequent words get small numbers
    number = np.empty(len(unique), dtype=np.int64)
    number[order] = np.arange(len(order))
    bucket = (unique[order] % np.uint64(buckets)).astype(np.int64)
    # characters of the distinct words, in the order of their numbers
    codes = np.concatenate([p.codes for p in pieces])
    length = np.concatenate([p.length for p in pieces])
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])[first][order] if len(first) else first
    length = length[first][order]
    rows: list[tuple] = []
    for b in np.unique(bucket):
        mine = np.flatnonzero(bucket == b)
        text = _gather(codes, begin[mine], length[mine])
        wide = 1 + (text > 0x7F) + (text > 0x7FF) + (text > 0xFFFF)
        ends = np.concatenate([[0], np.cumsum(length[mine])])
        size = np.diff(np.concatenate([[0], np.cumsum(wide)])[ends])
        utf8 = text.astype("<u4").tobytes().decode("utf-32-le").encode()
        rows.append((block, 0, int(b), [], zstandard.compress(utf8, 3), _planes(size), None))
    rows.append((block, 1, -1, [], _planes(bucket), b"", None))
    for n, (p, lo) in enumerate(zip(pieces, offset, strict=False)):
        words = number[merged[lo : lo + len(p.hashes)]][p.word]
        ends = np.cumsum(p.counts)
        at = 0
        while at < len(p.counts):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PACK_TOKENS, side="right")))
            to = min(to, len(p.counts))
            rows.append((block, 1, n, p.counts[at:to].tolist(), b"", _planes(words[done : ends[to - 1]]), p.ids.slice(at, to - at)))
            at = to
    for lo in range(0, len(rows), 64):
        some = rows[lo : lo + 64]
        ids = [r[6].to_pylist() if r[6] is not None else [] for r in some]
        columns = [pa.array([r[k] for r in some], PRE_SCHEMA.field(k).type) for k in range(6)]
        names = [*PRE_SCHEMA.names, "ids"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(id_type))], names)


def _split(batches: Iterator[pa.RecordBatch], classes, buckets: int, block_chars: int) -> Iterator[pa.RecordBatch]:
    """Columns ``id, text`` to rows of :data:`PRE_SCHEMA` with ``ids``."""
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    block, size, pieces = task << 32, 0, []
    id_type = None
    for batch in batches:
        id_type = batch.schema.field(0).type
        for texts in chunks(batch.column(1)):
            pieces.append(_piece(texts, batch.column(0).slice(texts.first, len(texts)), classes.value))
            size += len(texts.data)
            if size >= block_chars:
                yield from _block_rows(block, pieces, buckets, id_type)
                block, size, pieces = block + 1, 0, []
    if pieces:
        yield from _block_rows(block, pieces, buckets, id_type)


def _encode_words(batches: Iterator[pa.RecordBatch], ranks, pattern: str) -> Iterator[pa.RecordBatch]:
    """Rows of words to rows of ids; a word already met in the task is not encoded again."""
    encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
    known: dict[bytes, bytes] = {}
    held = 0
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in ("block", "part", "words", "payload")}
            text, ends = zstandard.decompress(row["words"]), np.cumsum(_numbers(row["payload"]).astype(np.int64))
            words = [text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]
            if held > CACHE_BYTES:
                known, held = {}, 0
            for word in words:
                if word not in known:
                    known[word] = ids = array("I", encoding.encode_ordinary(word.decode())).tobytes()
                    held += len(word) + len(ids) + _ENTRY_BYTES
            found = [known[w] for w in words]
            count = np.fromiter(map(len, found), dtype=np.uint32, count=len(found)) // np.uint32(4)
            ids = np.frombuffer(b"".join(found), dtype=np.uint32)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([row["block"]], pa.int64()),
                    "part": pa.array([row["part"]], pa.int32()),
                    "words": pa.array([_planes(count)], pa.binary()),
                    "payload": pa.array([_planes(ids)], pa.binary()),
                }
            )


def _reassemble(texts: pa.Table, words: pa.Table) -> pa.Table:
    """A block's packed texts and the ids of its words to ``id, n_tokens, ids``."""
    rows = texts.sort_by("part").to_pylist()
    parts = [(_numbers(r["words"]), _numbers(r["payload"])) for r in words.sort_by("part").to_pylist()]
    count, ids = (np.concatenate([np.empty(0, np.uint32), *[p[k] for p in parts]]) for k in (0, 1))
    # the words of a bucket came in the order of their numbers
    place = np.argsort(_numbers(rows[0]["words"]), kind="stable") if rows else np.empty(0, np.int64)
    if not rows or rows[0]["part"] != -1 or len(count) != len(place):
        raise ValueError("a block is not complete")
    offset, length = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    offset[place], length[place] = np.cumsum(count, dtype=np.int64) - count, count
    found, keys = [], []
    for row in rows[1:]:
        word = _numbers(row["payload"])
        raw = _gather(ids, offset[word], length[word]).astype("<u4").tobytes()
        ends = np.concatenate([[0], np.cumsum(length[word])])
        ends = 4 * ends[np.cumsum([0, *row["counts"]])]
        found += [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        keys += row["ids"]
    kind = texts.schema.field("ids").type.value_type
    sizes = [len(x) // 4 for x in found]
    return pa.table({"id": pa.array(keys, kind), "n_tokens": pa.array(sizes, pa.int64()), "ids": pa.array(found, pa.binary())})


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text: str = "text",
    doc_id: str = "doc_id",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row: ids as little-endian 32-bit numbers.

    A NULL or empty text has no tokens, a NULL id is kept, repeated rows are encoded each; an
    empty table gives an empty one. Other columns are not read. Any UTF-8 text is accepted,
    whole; one of more than ``block_chars`` is a block of its own. Texts are split by the rules
    of :data:`PATTERN`, so another ``pattern`` is refused.
    """
    if pattern != PATTERN:
        raise ValueError(f"texts are split by {PATTERN!r} only, not by {pattern!r}")
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    buckets = min(max(8, source.rdd.getNumPartitions()), MAX_BUCKETS)
    classes, sent = spark.sparkContext.broadcast(character_classes()), spark.sparkContext.broadcast(ranks)
    pre = written_by_key(
        source.mapInArrow(
            tidied(lambda b: _split(b, classes, buckets, block_chars)),
            f"block long, kind tinyint, part int, counts array<int>, words binary, payload binary, ids array<{kind}>",
        ),
        "bpe-blocks",
        "block",
        max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))),
    )
    words = pre.filter("kind = 0").select("block", "part", "words", "payload").repartition(buckets, "part")
    ids = words.mapInArrow(
        tidied(lambda b: _encode_words(b, sent, pattern)), "block long, part int, words binary, payload binary"
    )
    texts = pre.filter("kind = 1").groupBy("block")
    out = texts.cogroup(ids.groupBy("block")).applyInArrow(_reassemble, f"id {kind}, n_tokens long, ids binary")
    return out.withColumnRenamed("id", doc_id)


def _decode(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    data, first, length = table.value
    for batch in batches:
        column = batch.column(batch.schema.names.index("ids"))
        out = []
        for ids in column:
            raw = ids.as_py()
            tokens = np.frombuffer(raw or b"", dtype="<u4")
            out.append(None if raw is None else _gather(data, first[tokens], length[tokens]).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``ids``; NULL ids decode to NULL."""
    spark = encoded.sparkSession
    small_batches(spark)
    size = max(ranks.values(), default=-1) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    length = np.array([len(t) for t in tokens], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(length)[:-1]]) if size else length
    data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    table = spark.sparkContext.broadcast((data, first, length))
    names = [c for c in encoded.columns if c != "decoded"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*names).schema)
    return encoded.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(
        tidied(lambda b: _decode(b, table)), f"{fields}, decoded binary"
    )


def digests(decoded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return decoded.select(
        F.col(f"`{doc_id}`"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
