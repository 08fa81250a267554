"""Audit of how filters interact, by sorted posting lists.

Filters remove documents one after another, so what a filter removes depends on those before it.
The audit tells for every order of the filters and every step what is kept and removed there.

1. **Places.** Documents are dealt by ranges of part and id and numbered in that order. Repeated ids
   get a number each.
2. **Posting lists.** For a part and a range of numbers, each filter has the sorted list of numbers
   that fail it, each mark (such as a good label) the list of those that bear it. A range holds
   :data:`RANGE` numbers, so lists are bounded however large a part is.
3. **Merges.** Within a range, the failures of every set of filters are a k-way union; what a filter
   removes after a set is a difference, what it costs an intersection. The shorter list leaps through
   the longer one to where its next number must stand, and skips what lies between.
4. **Sums.** Ranges share no numbers, so sizes of all ranges of a part are added up by a partial
   aggregate; orders and steps only look them up.

Lists are written: they are the operator's result as much as the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillbridge.llm.store import batches_of, same, written

RANGE = 1 << 13
BATCH = 64  # ranges handed to Python at once
MOST = 8  # filters: all their orders are listed
BLANK = r"[\x20\x09-\x0D]+"
FILTERS, MARKS = ["A", "B", "C", "D", "E"], ["good", "toxic"]


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of either sorted list."""
    short, long = (a, b) if len(a) < len(b) else (b, a)
    if not len(short):
        return long
    at = np.searchsorted(long, short)
    new = long[np.minimum(at, len(long) - 1)] != short
    return np.insert(long, at[new], short[new])


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of ``a`` that ``b`` lacks; both sorted."""
    if not len(a) or not len(b):
        return a
    if len(a) <= len(b):
        return a[b[np.minimum(np.searchsorted(b, a), len(b) - 1)] != a]
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    keep = np.ones(len(a), dtype=bool)
    keep[at[a[at] == b]] = False
    return a[keep]


def unions(lists: list[np.ndarray]) -> list[np.ndarray]:
    """The union of every set of lists; a set is the bits of its place."""
    out = [np.empty(0, dtype=np.int64)]
    for members in range(1, 1 << len(lists)):
        last = members.bit_length() - 1
        out.append(union(out[members ^ (1 << last)], lists[last]))
    return out


def posting_lists(
    rows: DataFrame, filters: list[str], marks: list[str], part: str = "part", doc_id: str = "doc_id", size: int = RANGE
) -> DataFrame:
    """``part, first, docs, fails, marked`` of every part and range: its sorted lists.

    ``rows`` is one row per document, with a boolean column for each filter that it fails and
    each mark. ``fails`` and ``marked`` hold a list for each of ``filters`` and ``marks``, of
    numbers that follow the order of ``part`` and ``doc_id``; ``first`` is the least number of the
    range and ``docs`` their count. NULL flags are false.
    """
    q = {c: F.col(f"`{c}`") for c in {*filters, *marks}}
    rows = rows.select(
        F.col(f"`{part}`").alias("part"),
        F.col(f"`{doc_id}`").alias("id"),
        F.array(*[F.coalesce(q[c], F.lit(False)) for c in filters]).alias("fails"),
        F.array(*[F.coalesce(q[c], F.lit(False)) for c in marks]).alias("marked"),
    )
    rows = written(rows, "audit-rows").withColumn("salt", F.monotonically_increasing_id())
    order = ["part", "id", "salt"]
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = numbered.withColumn("number", F.monotonically_increasing_id())

    def listed(flag: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(flag, F.col("number"))))

    lists = numbered.groupBy("part", F.expr(f"number div {size}").alias("range")).agg(
        F.min("number").alias("first"),
        F.count("*").alias("docs"),
        F.array(*[listed(F.col("fails")[k]) for k in range(len(filters))]).alias("fails"),
        F.array(*[listed(F.col("marked")[k]) for k in range(len(marks))]).alias("marked"),
    )
    return written(lists.drop("range"), "audit-lists")


def _lists(column: pa.Array) -> list[list[np.ndarray]]:
    """A column of lists of lists of numbers, as arrays."""
    inner = column.flatten()
    values = np.asarray(inner.flatten(), dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(np.asarray(inner.value_lengths(), dtype=np.int64))])
    single = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    outer = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths(), dtype=np.int64))])
    return [single[a:b] for a, b in zip(outer[:-1], outer[1:], strict=True)]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`posting_lists` to the sizes for each filter and set of filters before it."""
    for batch in batches:
        fails, marked = _lists(batch.column("fails")), _lists(batch.column("marked"))
        for k in range(batch.num_rows):
            before = unions(fails[k])
            filters = range(len(fails[k]))
            pairs = [(f, s) for f in filters for s in range(len(before)) if not s >> f & 1]
            gone = [minus(fails[k][f], before[s]) for f, s in pairs]
            lost = [[len(g) - len(minus(g, m)) for m in marked[k]] for g in gone]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": batch.column("part").take(pa.array([k] * len(pairs))),
                    "filter": pa.array([f for f, _ in pairs], pa.int32()),
                    "before": pa.array([s for _, s in pairs], pa.int32()),
                    "docs": batch.column("docs").take(pa.array([k] * len(pairs))),
                    "failing": pa.array([len(fails[k][f]) for f, _ in pairs], pa.int64()),
                    "removed": pa.array([len(g) for g in gone], pa.int64()),
                    "dropped": pa.array([len(before[s | 1 << f]) for f, s in pairs], pa.int64()),
                    "lost": pa.array(lost, pa.list_(pa.int64())),
                }
            )


def sizes(lists: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """Per part, filter and set of filters ``before`` it (as bits): sums of the merged sizes.

    ``docs`` in the part, ``failing`` the filter, ``removed`` by it after those before, ``dropped`` by
    all of these, and ``lost_<mark>`` among the removed.
    """
    kind = lists.schema["part"].dataType.simpleString()
    merged = lists.select("part", "docs", "fails", "marked").mapInArrow(
        _merge,
        f"part {kind}, filter int, before int, docs long, failing long, removed long, dropped long, lost array<bigint>",
    )
    sums = [F.sum(c).alias(c) for c in ("docs", "failing", "removed", "dropped")]
    sums += [F.sum(F.col("lost")[k]).alias(f"lost_{m}") for k, m in enumerate(marks)]
    return merged.groupBy("part", "filter", "before").agg(*sums)


def audit(lists: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step; ``filters`` are single letters.

    ``filter_order``, ``step`` (from 1) and counts of documents of the part: ``kept`` after the step,
    ``removed`` by it, ``redundant`` (failing its filter, but removed before), ``unique_fails`` (failing
    this filter only), ``<mark>_lost`` among the removed, and ``shapley``: what the step's filter
    removes, summed over all orders. Counts without documents are 0.
    """
    if len(filters) > MOST:
        raise ValueError(f"{len(filters)} filters have too many orders to list them")
    steps = [
        ("".join(filters[f] for f in order), k + 1, order[k], sum(1 << f for f in order[:k]))
        for order in permutations(range(len(filters)))
        for k in range(len(filters))
    ]
    spark, every = lists.sparkSession, (1 << len(filters)) - 1
    orders = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    with batches_of(spark, BATCH):
        merged = written(sizes(lists, filters, marks), "audit-sizes")
    # of all orders, so many have just this set before the filter
    ways = [factorial(s.bit_count()) * factorial(len(filters) - 1 - s.bit_count()) if s != every else 0 for s in range(every + 1)]
    weight = F.array(*map(F.lit, ways))[F.col("before")]
    others = F.lit(every) - F.element_at(F.array(*[F.lit(1 << f) for f in range(len(filters))]), F.col("filter") + 1)
    overall = merged.groupBy(F.col("part").alias("_part"), F.col("filter").alias("_filter")).agg(
        F.sum(F.col("removed") * weight).alias("shapley"),
        F.max(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"),
    )
    here = same(F.col("part"), F.col("_part")) & (F.col("filter") == F.col("_filter"))
    return merged.join(overall, here).join(orders, ["filter", "before"]).select(
        "part",
        "filter_order",
        "step",
        (F.col("docs") - F.col("dropped")).alias("kept"),
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails",
        *[F.col(f"lost_{m}").alias(f"{m}_lost") for m in marks],
        "shapley",
    )


def five_filters(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang"
) -> DataFrame:
    """``part, doc_id, A, B, C, D, E, good, toxic`` of every row of ``docs``.

    A: under 200 words. B: of 100 words, under 50 are distinct. C: over 3 of 100 characters are
    A-Z. D: holds one of ``#$%&*|``. E: the text is that of a smaller id. Words are what blanks
    (space, tab to carriage return) leave, in their case. NULL texts are empty, and equal to other empty
    ones; a NULL part is the empty one. A NULL id isn't larger than any; rows that repeat an id are
    documents each and not smaller than one another. A document is good or toxic if a row of ``labels`` with
    its id says so. Texts of any length are read whole, other columns not at all; an empty table
    gives an empty one.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    seen = docs.select(
        F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), F.col(f"`{doc_id}`").alias("doc_id"), whole.alias("text")
    )
    # written, so that texts are read once for their own flags and for the search of equal ones
    judged = seen.select(
        "part",
        "doc_id",
        F.unhex(F.sha2("text", 256)).alias("same"),
        F.array_remove(F.split("text", BLANK), "").alias("words"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > 3 * F.length("text")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    )
    distinct = F.size(F.array_distinct("words"))
    judged = judged.withColumn("A", F.size("words") < 200).withColumn("B", 100 * distinct < 50 * F.size("words"))
    judged = written(judged.drop("words"), "audit-judged")
    # texts that come once need no look-up; one row for each that comes again
    first = judged.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    first = written(first.filter("n > 1").drop("n"), "audit-repeated")
    told = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    told = written(told, "audit-labels")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E")
    flagged = judged.join(first, "same", "left").select("part", "doc_id", "A", "B", "C", "D", again)
    return flagged.join(told, "doc_id", "left").select("part", "doc_id", *FILTERS, *MARKS)


def audit_documents(docs: DataFrame, labels: DataFrame, size: int = RANGE) -> DataFrame:
    """:func:`audit` of the five filters over ``docs``, in parts by language."""
    return audit(posting_lists(five_filters(docs, labels), FILTERS, MARKS, size=size), FILTERS, MARKS)


def oracle() -> str:
    """DuckDB SQL for :func:`audit_documents`, by the set of filters that each document fails."""
    letters = ", ".join(f"('{f}', {1 << k})" for k, f in enumerate(FILTERS))
    aliases = [f"l{k}" for k in range(5)]
    differ = " AND ".join(f"{a}.f <> {b}.f" for k, a in enumerate(aliases) for b in aliases[:k])
    steps = " UNION ALL ".join(
        f"SELECT {' || '.join(f'{a}.f' for a in aliases)} AS filter_order, {k + 1} AS step, l{k}.bit AS bit, "
        f"{' + '.join(['0', *(f'{a}.bit' for a in aliases[:k])])} AS seen "
        f"FROM {', '.join(f'letters {a}' for a in aliases)} WHERE {differ}"
        for k in range(5)
    )
    return rf"""
WITH letters(f, bit) AS (VALUES {letters}), steps AS ({steps}),
told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
read AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
counted AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS again FROM read
), judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN again THEN 16 ELSE 0 END AS fails
  FROM counted c LEFT JOIN told t ON t.doc_id = c.doc_id
), grouped AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM judged GROUP BY ALL
), stepped AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & (seen + bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & bit > 0 AND fails & seen = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & bit > 0 AND fails & seen > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN good AND fails & bit > 0 AND fails & seen = 0 THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN toxic AND fails & bit > 0 AND fails & seen = 0 THEN n ELSE 0 END) AS toxic_lost
  FROM grouped, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM stepped"""
