"""Weather signal formulas: driver and its direction by season."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import scores as S

COMPONENTS = (
    "rainfall_deviation", "rainfall_shock", "temperature_stress", "harvest_risk_indicator",
)


def weighted_scores(row: dict[str, Column], stage: Column) -> dict[str, Column]:
    return {name: F.abs(row[name]) * stage for name in COMPONENTS}


def top_score(scores: dict[str, Column]) -> Column:
    return F.greatest(*scores.values())


def driver_direction(driver: Column, row: dict[str, Column], day: Column) -> Column:
    """Season rule of the leading component."""
    edge = S.dec(fixed.DRIVER_THRESHOLD)
    growth = S.month_in(day, fixed.GROWTH_MONTHS)
    harvest = S.month_in(day, fixed.HARVEST_MONTHS)
    deviation, risk = row["rainfall_deviation"], row["harvest_risk_indicator"]
    stressed = row["temperature_stress"] > edge
    is_driver = lambda name: driver == name
    return (
        F.when(is_driver("rainfall_deviation") & (deviation < -edge) & growth, fixed.BULLISH)
        .when(is_driver("rainfall_deviation") & (deviation > edge), fixed.BEARISH)
        .when(is_driver("rainfall_shock") & (row["rainfall_shock"] > edge), fixed.BEARISH)
        .when(is_driver("temperature_stress") & stressed & growth, fixed.BULLISH)
        .when(is_driver("temperature_stress") & stressed, fixed.BEARISH)
        .when(
            is_driver("harvest_risk_indicator") & ((risk > edge) | ((risk < edge) & harvest)),
            fixed.BEARISH,
        )
        .otherwise(fixed.NEUTRAL)
    )


def direction(driver: Column, top: Column, row: dict[str, Column], day: Column) -> Column:
    strong = top >= S.dec(fixed.DRIVER_THRESHOLD)
    return F.when(strong, driver_direction(driver, row, day)).otherwise(fixed.NEUTRAL)
