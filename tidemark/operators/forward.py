"""Levels at later days: exact horizon and first on-or-after."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators.basket import DAY, SERIES


def horizon_targets(
    basket: DataFrame, horizons: tuple[int, ...] = fixed.HORIZONS, value: str = "level"
) -> DataFrame:
    """One row per (series, day, horizon) with the level exactly that many days later.

    Each target is a one-day frame ahead, so all horizons share one sort and no self-join.
    """
    order = Window.partitionBy(SERIES).orderBy(F.unix_date(DAY))
    ahead = [F.first(value).over(order.rangeBetween(h, h)).alias(f"_t{h}") for h in horizons]
    staged = basket.select(SERIES, DAY, value, *ahead)
    pairs = F.array(
        *[
            F.struct(F.lit(h).alias("horizon_days"), F.col(f"_t{h}").alias("target"))
            for h in horizons
        ]
    )
    return staged.select(SERIES, DAY, F.col(value), F.explode(pairs).alias("_p")).select(
        SERIES,
        DAY,
        F.col("_p.horizon_days").alias("horizon_days"),
        F.col(value).alias("spot_price_level"),
        F.col("_p.target").alias("target_price_level"),
    )


def first_on_or_after(
    basket: DataFrame, horizons: tuple[int, ...] = fixed.FORWARD_HORIZONS, value: str = "level"
) -> DataFrame:
    """First observed level on or after day + h, per (series, day, h).

    Observations and questions are merged on one timeline and read backwards, so each question
    takes the last level seen: one linear pass instead of a scan ahead of every row.
    """
    levels = basket.filter(F.col(value).isNotNull())
    seen = levels.select(
        SERIES,
        F.unix_date(DAY).alias("_at"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("int").alias("horizon_days"),
        F.lit(None).cast("date").alias(DAY),
        F.col(value).alias("_level"),
    )
    asked = levels.select(
        SERIES, DAY, F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_days")
    ).select(
        SERIES,
        (F.unix_date(DAY) + F.col("horizon_days")).alias("_at"),
        F.lit(1).alias("_kind"),
        "horizon_days",
        DAY,
        F.lit(None).cast("double").alias("_level"),
    )
    backwards = (
        Window.partitionBy(SERIES)
        .orderBy(F.col("_at").desc(), "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        seen.unionByName(asked)
        .withColumn("forward_level", F.last("_level", ignorenulls=True).over(backwards))
        .filter(F.col("_kind") == 1)
        .select(SERIES, DAY, "horizon_days", "forward_level")
    )
