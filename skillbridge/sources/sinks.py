"""Table, index and notification writers.

Plain parquet has no UPDATE or DELETE: changes are written as new folders, and a folder
that is being read is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillbridge.schemas import COURSES, NOTIFICATION


LOAD = "_load"  # the hidden column by which the course table is partitioned


def _declared(field: T.StructField) -> str:
    limit = field.metadata.get("max_length")
    kind = field.dataType.simpleString() if limit is None else f"varchar({limit})"
    return f"`{field.name}` {kind}{'' if field.nullable else ' NOT NULL'}"


def _quoted(text: str) -> str:
    return "'{}'".format(text.replace("\\", "\\\\").replace("'", "\\'"))


def _required(field: T.StructField) -> Column:
    col = F.col(field.name)
    if field.nullable:
        return col
    missing = F.raise_error(F.lit(f"{field.name} is NULL")).cast(field.dataType)
    return F.coalesce(col, missing).alias(field.name)


def append_courses(courses: DataFrame, table: str, path: str | None = None) -> None:
    """Create the course table if it is absent, then append by name; duplicates are kept.

    Columns are declared with their lengths, so a text that is too long fails the load; a
    required column that is NULL fails it as well. The table may have its columns in any
    order.
    """
    spark = courses.sparkSession
    location = "" if path is None else f" LOCATION {_quoted(path)}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(map(_declared, COURSES))}) USING parquet{location}")
    rows = courses.select([_required(f) for f in COURSES])
    rows.select(spark.table(table).columns).write.mode("append").insertInto(table)


def put_load(courses: DataFrame, table: str, load: str, path: str | None = None) -> None:
    """Put a named load into the course table; a repeated load replaces its own rows only.

    The table is made if it is absent, with constraints as in :func:`append_courses`, and is
    partitioned by the load's name. A load is one partition, replaced when its job commits, so
    a batch that is replayed after a failure leaves every course there once. Read the table by
    :func:`read_courses`.
    """
    spark = courses.sparkSession
    made = not spark.catalog.tableExists(table)
    if made:
        location = "" if path is None else f" LOCATION {_quoted(path)}"
        columns = ", ".join([*map(_declared, COURSES), f"`{LOAD}` string"])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY ({LOAD}){location}")
    rows = courses.select([_required(f) for f in COURSES])
    rows = rows.select([c for c in spark.table(table).columns if c != LOAD])
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({LOAD} = {_quoted(load)}) SELECT * FROM {{rows}}", rows=rows)
    if made:  # in a catalog that doesn't last, files of earlier loads may lie there
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")


def read_courses(spark: SparkSession, table: str) -> DataFrame:
    """The course table as it stands now, without the column that tells its loads apart."""
    spark.catalog.refreshTable(table)  # streams write it in sessions of their own
    return spark.table(table).drop(LOAD)


def append_rows(df: DataFrame, path: str) -> None:
    """Append users or uploads that have passed their admission checks."""
    df.write.mode("append").parquet(path)


def write_version(df: DataFrame, path: str, version: str) -> str:
    """Write a table's next version, such as after an erasure or an upsert.

    Fails if the version exists, so the folder that is being read cannot be hit.
    """
    folder = f"{path}/{version}"
    df.write.parquet(folder)
    return folder


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch to its own folder; a replay replaces it, so nothing doubles."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_index(chunks: DataFrame, path: str, version: str) -> str:
    """Store chunks with their vectors; returns the folder of this version.

    Partitioned by ``kind`` only. Owners are far too many for folders, so rows are dealt by
    ranges of kind and owner: a file holds few owners, and row groups can be skipped. Within an owner
    they go by ``chunk_id``, if there is one: all shared rows have the same owner, none, and must not be one task's.
    """
    folder = f"{path}/{version}"
    ids = [c for c in ("chunk_id",) if c in chunks.columns]
    dealt = chunks.repartitionByRange("kind", "owner", *ids)
    dealt.sortWithinPartitions("kind", "owner").write.partitionBy("kind").parquet(folder)
    return folder


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def notifications(df: DataFrame, address: Column, subject: Column, message: Column) -> DataFrame:
    """Rows ``(address, subject, message)``, ready for the outbound sink."""
    values = (address, subject, message)
    return df.select(*[v.alias(f.name) for v, f in zip(values, NOTIFICATION)])


def write_notifications(rows: DataFrame, path: str) -> None:
    """One JSON object of three strings per line."""
    rows.select(F.to_json(F.struct(*NOTIFICATION.names)).alias("value")).write.text(path)


def write_notification_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """A micro-batch of notifications in a folder of its own, which a replay replaces."""
    text = rows.select(F.to_json(F.struct(*NOTIFICATION.names)).alias("value"))
    text.write.mode("overwrite").text(f"{path}/batch_id={batch_id}")


def read_notifications(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NOTIFICATION).json(path)
