"""Futures curve: near and far contract and the near contract's open-interest history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.basket import DAY, SERIES


def near_far(contracts: DataFrame, all_days: bool = False) -> DataFrame:
    """Two nearest live expiries per (series, day).

    Days with fewer than two are absent, or kept with NULL contracts when ``all_days`` is set. The
    rank filter lets Spark keep only two rows per key in each map task before the shuffle.
    """
    live = F.col("expiry_date") > F.col(DAY)
    order = Window.partitionBy(SERIES, DAY).orderBy(
        F.when(live, 0).otherwise(1), "expiry_date", "contract_symbol"
    )
    rows = contracts if all_days else contracts.filter(live)
    ranked = rows.withColumn("_pos", F.row_number().over(order)).filter(F.col("_pos") <= 2)
    pick = lambda pos, name: F.max(F.when(live & (F.col("_pos") == pos), F.col(name)))
    curve = ranked.groupBy(SERIES, DAY).agg(
        F.struct(
            pick(1, "contract_symbol").alias("near_symbol"),
            pick(1, "expiry_date").alias("near_expiry"),
            pick(1, "settle_price").alias("near_settle"),
            pick(1, "observed_at").alias("near_observed_at"),
            pick(2, "contract_symbol").alias("far_symbol"),
            pick(2, "expiry_date").alias("far_expiry"),
            pick(2, "settle_price").alias("far_settle"),
        ).alias("_curve"),
        F.count_if(live).alias("_live"),
    )
    kept = curve if all_days else curve.filter(F.col("_live") == 2)
    return kept.select(
        SERIES, DAY, F.when(F.col("_live") == 2, F.col("_curve")).alias("_curve")
    ).select(SERIES, DAY, "_curve.*")


def open_interest_history(contracts: DataFrame) -> DataFrame:
    """One open interest per (series, expiry, day); of several symbols the greatest counts."""
    return (
        contracts.filter(F.col("open_interest").isNotNull())
        .groupBy(SERIES, "expiry_date", DAY)
        .agg(F.max_by("open_interest", "contract_symbol").alias("open_interest"))
    )
