"""Denormalised daily summary: snapshot, newest published forecast and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators.dedupe import latest_per_key

KEY = ["commodity_id", "as_of_date", "registry_id"]


def published(forecasts: DataFrame) -> DataFrame:
    """Newest published forecast per key."""
    return latest_per_key(
        forecasts.filter("is_published"), KEY, ["generated_at", "forecast_version_id"]
    )


def horizon_summaries() -> Column:
    entries = [
        F.when(
            F.col(f"horizon_{h}").isNotNull(),
            F.struct(F.lit(str(h)).alias("horizon"), F.col(f"horizon_{h}").alias("forecast")),
        )
        for h in fixed.HORIZONS
    ]
    return F.array_compact(F.array(*entries))


def daily_summary(snapshots: DataFrame, forecasts: DataFrame, quality: DataFrame) -> DataFrame:
    """One row per snapshot; a missing forecast or quality row leaves NULLs."""
    forecast = published(forecasts).select(
        *KEY, "forecast_version_id", *[f"horizon_{h}" for h in fixed.HORIZONS]
    )
    scores = quality.select("quality_snapshot_id", "overall_quality_score").withColumnRenamed(
        "quality_snapshot_id", "data_quality_snapshot_id"
    )
    joined = snapshots.join(forecast, KEY, "left").join(scores, "data_quality_snapshot_id", "left")
    summaries = horizon_summaries()
    return joined.select(
        *KEY,
        "snapshot_id",
        "snapshot_hash",
        "forecast_version_id",
        F.when(F.size(summaries) > 0, summaries).alias("horizon_summaries"),
        *[
            F.col(f"horizon_{h}.forecast_confidence").alias(f"forecast_confidence_{h}")
            for h in fixed.HORIZONS
        ],
        "data_quality_snapshot_id",
        F.col("overall_quality_score").cast("double").alias("overall_quality_score"),
    )
