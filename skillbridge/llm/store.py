"""Tables between the steps of an operator, and small bit sets made by Spark."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillbridge.session import scratch_path

FILTER_BITS = 1 << 25  # 4 MB, whatever the size of the set


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again.

    Cuts the lineage: a lost executor costs later steps a read, not the work before. Values
    that depend on how rows were dealt (block numbers) are fixed by it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by_key(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As :func:`written`, in buckets of ``key``: a later join on it doesn't shuffle the table."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = "t" + uuid.uuid4().hex
    df.write.option("path", path).bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    # the files stay, the frame knows them; only the name goes
    spark.sql(f"DROP TABLE {table}")
    return out


def bit_filter(hashes: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A one-hash Bloom filter over a ``bigint`` column of hashes, as 64-bit words.

    Its size is fixed, so it may be sent to all tasks however large the set is; a set too
    large for it lets more rows pass, which the join behind it removes.
    """
    place = F.pmod(F.col(column), F.lit(bits))
    words = (
        hashes.filter(F.col(column).isNotNull())
        .groupBy(F.floor(place / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def may_hold(bit_words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (64-bit, unsigned) the filter of :func:`bit_filter` lets pass."""
    place = hashes & np.uint64(len(bit_words) * 64 - 1)
    word = bit_words[(place >> np.uint64(6)).astype(np.int64)]
    return (word >> (place & np.uint64(63))) & np.uint64(1) == 1


def same(left: Column, right: Column) -> Column:
    """Equal, with NULL equal to NULL."""
    return left.eqNullSafe(right)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand rows to Python in batches small enough for long texts (results don't change)."""
    if not 0 < int(spark.conf.get(_BATCH, "10000")) <= rows:
        spark.conf.set(_BATCH, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Another batch size, for jobs that run within; for rows of a few numbers."""
    before = spark.conf.get(_BATCH, "10000")
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def give_back() -> None:
    """Return memory that this process has freed but holds on to."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library: it trims by itself
        pass


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], every: int = 16 << 20):
    """``work`` for ``mapInArrow``, which gives back memory after so many bytes of input and at its end.

    Workers live on from one task to the next, and would keep what the largest of them took.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            for batch in batches:
                yield batch
                seen += batch.nbytes
                if seen >= every:
                    seen = 0
                    give_back()

        yield from work(counted())
        give_back()

    return run


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores in front until no column (in any case) has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
