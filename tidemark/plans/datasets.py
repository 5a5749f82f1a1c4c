"""Supervised datasets: spot, target at each horizon, snapshot features, coverage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import scores as S
from tidemark.operators.basket import DAY, SERIES
from tidemark.operators.dedupe import latest_per_key
from tidemark.operators.forward import horizon_targets
from tidemark.plans.snapshots import flat_features


def candidates(
    basket: DataFrame,
    window: tuple[dt.date, dt.date] | None = None,
    horizons: tuple[int, ...] = fixed.HORIZONS,
) -> DataFrame:
    """(series, day, horizon) rows inside the window, targets NULL where none was observed.

    The last usable day is ``window end - horizon``; without a window the series' own bounds hold.
    """
    rows = horizon_targets(basket, horizons)
    if window is not None:
        start, end = F.lit(window[0]), F.lit(window[1])
        last = F.date_sub(end, F.col("horizon_days"))
        return rows.filter((F.col(DAY) >= start) & (F.col(DAY) <= last))
    from pyspark.sql import Window

    end = F.max(DAY).over(Window.partitionBy(SERIES))
    return (
        rows.withColumn("_end", end)
        .filter(F.col(DAY) <= F.date_sub("_end", F.col("horizon_days")))
        .drop("_end")
    )


def attach_snapshots(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Latest snapshot of the day by creation time, then id; absent ones leave NULLs."""
    newest = latest_per_key(snapshots, [SERIES, DAY], ["created_at", "snapshot_id"])
    return rows.join(
        newest.select(
            SERIES, DAY, "registry_id", "snapshot_hash", flat_features(newest).alias("features")
        ),
        [SERIES, DAY],
        "left",
    )


def supervised(candidate_rows: DataFrame) -> DataFrame:
    """Rows with both ends observed and their log return."""
    both = F.col("spot_price_level").isNotNull() & F.col("target_price_level").isNotNull()
    return candidate_rows.filter(both).withColumn(
        "target_log_return",
        S.log_return(F.col("spot_price_level"), F.col("target_price_level")),
    )


def dataset_stats(candidate_rows: DataFrame) -> DataFrame:
    """Rows, candidate days and coverage per (series, horizon)."""
    both = F.col("spot_price_level").isNotNull() & F.col("target_price_level").isNotNull()
    stats = candidate_rows.groupBy(SERIES, "horizon_days").agg(
        F.count_if(both).alias("row_count"),
        F.count(F.lit(1)).alias("candidate_dates"),
    )
    return stats.withColumn(
        "coverage_ratio", F.round(F.col("row_count") / F.col("candidate_dates"), 6)
    )


def missing_counts(rows: DataFrame, features: str | None = "features") -> DataFrame:
    """NULL or empty cells of the required fields per (series, horizon)."""
    fields = ("spot_price_level", "target_price_level", "target_log_return")
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    counts = [F.count_if(empty(c)).alias(f"missing_{c}") for c in fields]
    if features:
        bare = F.col(features).isNull() | (F.size(features) == 0)
        counts.append(F.count_if(bare).alias("missing_features"))
    return rows.groupBy(SERIES, "horizon_days").agg(*counts)
