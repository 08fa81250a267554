"""Keyed operations on users and uploads.

A key may be hot (one key holding a third of the rows). Filters by key are semi and anti joins
with distinct keys; what is first or last of a key is found by an aggregate, which has a
map-side part; nothing else is grouped by the key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillbridge.functions.text import base64_text
from skillbridge.operators.keys import matching, missing


def lookup(
    df: DataFrame,
    keys: DataFrame,
    key: str = "email",
    columns: list[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys``; whole rows, or some columns.

    With ``unique`` the job fails if a key matches more than one row.
    """
    found = matching(df, keys, key)
    if unique:
        n = F.col("n")
        once = F.when(n > 1, F.raise_error(F.concat(F.lit(f"several rows for {key} "), F.col(key))))
        counted = found.groupBy(key).agg(F.count("*").alias("n"))
        found = found.join(counted.filter(once.isNull()).select(key), key, "left_semi")
        found = found.select(df.columns)
    return found if columns is None else found.select(columns)


def user_uploads(
    uploads: DataFrame, users: DataFrame, keys: DataFrame | None = None, key: str = "email"
) -> DataFrame:
    """Uploads of existing users, optionally of the given ones only."""
    owners = users.select(key)
    if keys is not None:
        owners = matching(owners, keys, key)
    return matching(uploads, owners, key)


def project_upload(uploads: DataFrame, *extra: str) -> DataFrame:
    """An upload as it is returned to its owner: base64 file and description."""
    return uploads.select(
        *extra, base64_text(F.col("pdf_resume")).alias("pdf_resume"), "job_description"
    )


def fk_split(child: DataFrame, parent: DataFrame, key: str = "email") -> tuple[DataFrame, DataFrame]:
    """Rows with a parent, and orphans. A NULL key is an orphan."""
    return matching(child, parent, key), missing(child, parent, key)


def erase(
    users: DataFrame, uploads: DataFrame, keys: DataFrame, key: str = "email"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove the given users and all of their uploads.

    Returns the remaining users, the remaining uploads and a one-row report of how many of
    each went. Unknown keys change nothing. Write the results to new folders.
    """
    removed_users, removed_uploads = matching(users, keys, key), matching(uploads, keys, key)
    report = (
        removed_users.select(F.lit(1).alias("u"), F.lit(0).alias("f"))
        .unionAll(removed_uploads.select(F.lit(0), F.lit(1)))
        .agg(
            F.coalesce(F.sum("u"), F.lit(0)).alias("users_removed"),
            F.coalesce(F.sum("f"), F.lit(0)).alias("uploads_removed"),
        )
    )
    return missing(users, keys, key), missing(uploads, keys, key), report


def admit_unique(
    new: DataFrame, existing: DataFrame, key: str, order: str
) -> tuple[DataFrame, DataFrame]:
    """Sign-ups whose key is new; of several with one key the first by ``order`` wins.

    A NULL order comes last, rows of one order are told apart by a hash of their columns, and
    of rows equal in all columns one is admitted. Rejects carry a ``reason``: ``key_null``,
    ``key_taken`` or ``key_repeated``.

    The first row of a key is found by a partial aggregate, and the check against the
    existing keys then sees each key once, however often it occurs in the batch. Rows are
    told from winners by joining on key and place together, which is never hot: equal rows
    are counted before.
    """
    known = new.filter(F.col(key).isNotNull()).groupBy(new.columns).agg(F.count("*").alias("_n"))
    place = F.struct(
        F.isnull(order).alias("_last"), F.col(order).alias("_order"), F.xxhash64(*new.columns).alias("_row")
    )
    known = known.withColumn("_place", place)
    first = known.groupBy(key).agg(F.min("_place").alias("_first"))
    taken = existing.select(key).distinct().withColumn("_taken", F.lit(True))
    verdict = F.when(F.col("_taken"), F.lit("key_taken")).otherwise(F.lit("ok"))
    judgement = first.join(taken, key, "left").select(
        key, F.col("_first._row").alias("_row"), verdict.alias("_verdict")
    )
    judged = known.withColumn("_row", F.col("_place._row")).join(judgement, [key, "_row"], "left")
    admitted = F.col("_verdict").eqNullSafe("ok")
    ok = judged.filter(admitted).select(new.columns)
    reason = F.when(F.col("_verdict") == "key_taken", F.lit("key_taken")).otherwise(F.lit("key_repeated"))
    # of equal rows the first has the verdict, the others repeat its key
    reasons = F.concat(
        F.when(admitted, F.array().cast("array<string>")).otherwise(F.array(reason)),
        F.array_repeat(F.lit("key_repeated"), (F.col("_n") - 1).cast("int")),
    )
    rejects = judged.select(*new.columns, F.explode(reasons).alias("reason")).unionByName(
        new.filter(F.col(key).isNull()).withColumn("reason", F.lit("key_null"))
    )
    return ok, rejects


def upsert(
    base: DataFrame, changes: DataFrame, key: str, order: str, insert_missing: bool = True
) -> DataFrame:
    """Apply a batch of changes to a keyed table; the last change of a key wins.

    ``changes`` has the columns of ``base`` plus ``order``. Without ``insert_missing`` a
    change to an unknown key is left out, as a plain update would do.
    """
    values = F.struct(*[c for c in base.columns if c != key])
    tagged = base.select(
        key, values.alias("_row"), F.lit(0).alias("_new"), F.lit(None).alias("_seq")
    ).unionAll(changes.select(key, values, F.lit(1), F.col(order)))
    # NULL sorts lowest, so a base row loses against any change
    last = tagged.groupBy(key).agg(
        F.max_by("_row", F.struct("_new", "_seq")).alias("_row"), F.min("_new").alias("_only_new")
    )
    if not insert_missing:
        last = last.filter(F.col("_only_new") == 0)
    return last.select(key, "_row.*").select(base.columns)


def assign_ids(df: DataFrame, start: int, name: str = "id") -> DataFrame:
    """Unique ids above ``start``; increasing but not dense, so no global ordering is needed."""
    new_id = F.lit(start + 1).cast("bigint") + F.monotonically_increasing_id()
    return df.withColumn(name, new_id)


def page_after(df: DataFrame, after: object | None, limit: int, key: str = "id") -> DataFrame:
    """The next ``limit`` rows behind ``after``, the last key of the page before (None: the first page).

    A page costs the same wherever it is: the scan skips what lies before the key, and each task keeps
    ``limit`` rows. ``key`` must be unique; rows without one are on no page.
    """
    rest = df.filter(F.col(key).isNotNull()) if after is None else df.filter(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(limit)


def page_rows(
    df: DataFrame, order: str | Column = "id", skip: int | None = None, limit: int | None = None
) -> DataFrame:
    """Rows in order, optionally a page of them; by default all."""
    if skip is None and limit is None:
        return df.orderBy(order)
    page = df.orderBy(order)
    if skip:
        page = page.offset(skip)
    return page if limit is None else page.limit(limit)
