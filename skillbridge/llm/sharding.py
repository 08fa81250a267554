"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillbridge.llm.store import unused

SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The shard number of every slot.

    Every shard has a preference order of all slots: it starts at an offset and goes on by a
    step, both from a digest of its name; as the number of slots is prime, the order visits
    each slot once. Shards take turns to claim the first free slot of their order, so shares
    differ by one slot at most, and a shard that comes or goes moves few of the others' slots.
    """
    if not _is_prime(slots):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, at least one and no more than slots")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    table = np.full(slots, -1, dtype=np.int32)
    left = slots
    while left:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            table[at[shard]] = shard
            left -= 1
            if not left:
                break
    return table


def key_slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text, modulo the number of slots.

    NULL is treated as a key of its own (the empty text).
    """
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    rows = [(slot, shards[s]) for slot, s in enumerate(fill_table(shards, slots).tolist())]
    return spark.createDataFrame(rows, "_slot int, _shard string")


def place(
    df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, column: str = "shard"
) -> DataFrame:
    """``df`` with the shard of every row, in constant time and without a shuffle.

    The table has ``slots`` rows, whatever the data, and is broadcast. Rows with one key go
    to one shard, repeated rows alike; a NULL key has a shard as any other; an empty table
    stays empty. A column already named ``column`` is replaced, all others are kept.
    """
    names = [c for c in df.columns if c != column]
    slot, shard = unused(df.columns, "_slot", "_shard")
    table = F.broadcast(table_frame(df.sparkSession, shards, slots).toDF(slot, shard))
    keyed = df.withColumn(slot, key_slot(F.col(f"`{key}`"), slots))
    return keyed.join(table, slot, "left").select(*[F.col(f"`{c}`") for c in names], F.col(shard).alias(column))


def write_shards(placed: DataFrame, path: str, column: str = "shard") -> None:
    """One folder per shard, written where the rows lie."""
    placed.write.partitionBy(column).parquet(path)
