"""Per-entity coverage and gaps in the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entity_coverage(
    rows: DataFrame, expected: DataFrame, entity: str, day: str = "as_of_date"
) -> DataFrame:
    """Row count, distinct days and bounds per expected entity; silent ones get zeros."""
    # Daily counts first: a hot entity is reduced to one row per day before the distinct count.
    daily = rows.groupBy(entity, day).agg(F.count(F.lit(1)).alias("_rows"))
    stats = daily.groupBy(entity).agg(
        F.sum("_rows").alias("row_count"),
        F.count(F.lit(1)).alias("distinct_days"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
    )
    return (
        expected.select(entity)
        .distinct()
        .join(stats, entity, "left")
        .select(
            entity,
            F.coalesce("row_count", F.lit(0)).alias("row_count"),
            F.coalesce("distinct_days", F.lit(0)).alias("distinct_days"),
            "first_day",
            "last_day",
        )
    )


def coverage_total(
    rows: DataFrame, expected: DataFrame, entity: str, day: str = "as_of_date"
) -> DataFrame:
    """Global row of the coverage: entities with data, distinct days, bounds, row count."""
    known = rows.join(expected.select(entity).distinct(), entity, "left_semi")
    daily = known.groupBy(entity, day).agg(F.count(F.lit(1)).alias("_rows"))
    return daily.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("row_count"),
        F.count_distinct(entity).alias("entities_with_data"),
        F.count_distinct(day).alias("distinct_days"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
    )


def missing_periods(
    rows: DataFrame,
    expected: DataFrame,
    entity: str,
    start: Column,
    end: Column,
    day: str = "as_of_date",
) -> DataFrame:
    """Contiguous days inside [start, end] without a row, per expected entity.

    Only observed days enter, one per entity and day, with a sentinel on either side of the
    window; a gap is a step of more than one day to the next observed day.
    """
    entities = expected.select(entity).distinct()
    present = (
        rows.filter(F.col(day).between(start, end))
        .select(entity, F.col(day).alias("_day"))
        .distinct()
        .join(entities, entity, "left_semi")
    )
    edges = entities.select(
        entity, F.explode(F.array(F.date_sub(start, 1), F.date_add(end, 1))).alias("_day")
    )
    order = Window.partitionBy(entity).orderBy("_day")
    return (
        present.unionByName(edges)
        .withColumn("_next", F.lead("_day").over(order))
        .filter(F.datediff("_next", "_day") > 1)
        .select(
            entity,
            F.date_add("_day", 1).alias("gap_start"),
            F.date_sub("_next", 1).alias("gap_end"),
            (F.datediff("_next", "_day") - 1).alias("gap_days"),
        )
    )
