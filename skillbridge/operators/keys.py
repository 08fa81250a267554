"""Joins of a table with a set of keys.

The set is made distinct by a partial aggregate, so a key that fills the set costs nothing. A
set the optimizer knows to be small is broadcast by its size in bytes; otherwise both sides
are shuffled, and Spark splits a partition of the table that a hot key makes too large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW = 1 << 18  # keys that are sent to all tasks, whatever a cluster broadcasts by itself
FEW_BYTES = 16 << 20  # and the texts beside them


def matching(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``keys``."""
    return df.join(keys.select(key).distinct(), key, "left_semi").select(df.columns)


def missing(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys``, or NULL."""
    return df.join(keys.select(key).distinct(), key, "left_anti").select(df.columns)


def few_sent(keys: DataFrame, n: int, size: int = 0) -> DataFrame:
    """``n`` keys with texts of ``size`` bytes, to be sent to all tasks if they are few, so that the other side stays where it lies."""
    return F.broadcast(keys) if n <= FEW and size <= FEW_BYTES else keys
