"""Month-partitioned fact tables: pruned scans, append, keyed upsert, lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import as_of_month
from tidemark.operators.dedupe import latest_per_key, upsert

MONTH = "as_of_month"


def append_facts(rows: DataFrame, path: str, day: str = "as_of_date") -> None:
    """Append only. Rows are rebalanced by month so that each month gets few, well-sized files
    and a heavy month is split over several tasks."""
    staged = rows.withColumn(MONTH, as_of_month(F.col(day)))
    staged.hint("rebalance", MONTH).write.mode("append").partitionBy(MONTH).parquet(path)


def read_facts(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table, or None when nothing was written yet (an empty frame if a schema is given).

    Only a missing or empty folder counts as no table; any other trouble is raised.
    """
    if _stored(spark, path) is None:
        return spark.createDataFrame([], f"{schema}, {MONTH} string") if schema else None
    # Months look like numbers to partition inference; the declared schema keeps them text.
    reader = spark.read.schema(f"{schema}, {MONTH} string") if schema else spark.read
    return reader.parquet(path).drop(MONTH) if schema is None else reader.parquet(path)


def in_months(start: dt.date, end: dt.date) -> Column:
    """Partition filter implied by a date range; the date filter itself stays in place."""
    return F.col(MONTH).between(f"{start:%Y-%m}", f"{end:%Y-%m}")


def date_range(
    table: DataFrame, start: dt.date, end: dt.date, day: str = "as_of_date",
    newest_first: bool = False, **equals: object,
) -> DataFrame:
    """Inclusive range scan with optional equality filters; prunes months, pushes the rest down."""
    out = table.filter(F.col(day).between(F.lit(start), F.lit(end)))
    if MONTH in table.columns:
        out = out.filter(in_months(start, end))
    for name, value in equals.items():
        if value is not None:
            out = out.filter(F.col(name) == F.lit(value))
    return out.orderBy(F.col(day).desc()) if newest_first else out


def visible_at(table: DataFrame, day: Column) -> DataFrame:
    """Rows observed by the end of ``day`` (UTC)."""
    return table.filter(F.col("observed_at") < F.date_add(day, 1).cast("timestamp"))


def lookup(table: DataFrame, order: list[str] | None = None, **key: object) -> DataFrame:
    out = table
    for name, value in key.items():
        out = out.filter(F.col(name) == F.lit(value))
    return out.orderBy(*order) if order else out


def latest_snapshot(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return latest_per_key(table, keys, order)


def upsert_months(
    spark: SparkSession, path: str, updates: DataFrame, keys: list[str], order: list[str],
    day: str = "as_of_date",
) -> None:
    """Insert or replace by key, rewriting only the months that the updates touch.

    The day is part of the key, so a key never moves between months. Of updates that repeat a key
    the last by ``order`` counts. The merged months are written to a side folder first, as a job
    cannot overwrite what it reads, then moved in by dynamic partition overwrite. If that breaks
    off, the whole side folder is still there and the next call moves it in before anything else.
    """
    side = f"{path}__merge"
    _finish(spark, side, path, by_month=True)
    staged = updates.withColumn(MONTH, as_of_month(F.col(day)))
    stored = _stored(spark, path)
    if stored is None:
        merged = latest_per_key(staged, keys, order)
    else:
        months = staged.select(MONTH).distinct()
        touched = stored.withColumn(MONTH, F.col(MONTH).cast("string")).join(
            months, MONTH, "left_semi"
        )
        merged = upsert(touched.select(*staged.columns), staged, keys, order)
    # Static overwrite leaves the mark of a whole write; dynamic does not.
    writer = merged.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(MONTH).parquet(side)
    _finish(spark, side, path, by_month=True)


def upsert_table(
    spark: SparkSession, path: str, updates: DataFrame, keys: list[str], order: list[str]
) -> None:
    """Keyed upsert of an unpartitioned table (dimensions, metrics).

    The same two steps: a whole side folder, then its move; a move that broke off is finished
    by the next call.
    """
    side = f"{path}__merge"
    _finish(spark, side, path)
    stored = _stored(spark, path)
    if stored is None:
        merged = latest_per_key(updates, keys, order)
    else:
        merged = upsert(stored.select(*updates.columns), updates, keys, order)
    merged.write.mode("overwrite").parquet(side)
    _finish(spark, side, path)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds, if it is there."""
    files, at = _path(spark, path)
    files.delete(at, True)


def _written(spark: SparkSession, path: str) -> bool:
    """A job that wrote the folder ended well: its mark is there."""
    files, at = _path(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None if its folder is not there or has no data; other errors are raised."""
    files, at = _path(spark, path)
    if not files.exists(at) or not any(
        not s.getPath().getName().startswith(("_", ".")) for s in files.listStatus(at)
    ):
        return None
    return spark.read.parquet(path)


def _finish(spark: SparkSession, side: str, path: str, by_month: bool = False) -> None:
    """Move a whole side folder into the table; one without its mark is a broken write and stays out.

    The side folder goes only after the table was written, so this may be repeated at any point.
    """
    if not _written(spark, side):
        return
    rows = _stored(spark, side)
    if rows is not None:
        if by_month:
            rows = rows.withColumn(MONTH, F.col(MONTH).cast("string"))
        writer = rows.write.mode("overwrite")
        if by_month:
            writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(MONTH)
        writer.parquet(path)
    files, at = _path(spark, side)
    files.delete(at, True)
