"""Weather family: regional roll-up, rolling features, composite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql as Q
from checks.base import check
from tidemark import fixed
from tidemark.adapters import Tables
from tidemark.operators import basket as B
from tidemark.operators import rolling
from tidemark.plans.weather_signal import weather_signal


@check(
    f"""WITH {Q.REGIONAL}
SELECT region_id, CAST(as_of_date AS VARCHAR) AS as_of_date, validation_status, observation_id, rainfall_mm FROM picked"""
)
def preferred_weather_rows(t: Tables) -> DataFrame:
    rows = B.usable_rows(t.weather(), statuses=fixed.WEATHER_USABLE_STATUSES)
    rows = rows.filter(F.col("rainfall_mm").isNotNull())
    picked = B.prefer_status(rows, ["series_id", "region_id", "as_of_date"], fixed.STATUS_RANK)
    return picked.select(
        "region_id", "as_of_date", "validation_status", "observation_id", "rainfall_mm"
    )


@check(
    f"""WITH {Q.REGIONAL}
SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, round(rainfall_mm, 6) AS rainfall_mm,
  round(temperature_mean_c, 6) AS temperature_mean_c,
  round(relative_humidity_pct, 6) AS relative_humidity_pct, regions_reporting, regions_expected FROM regional"""
)
def regional_weather(t: Tables) -> DataFrame:
    daily = B.regional_weather(t.weather())
    six = [F.round(c, 6).alias(c) for c in
           ("rainfall_mm", "temperature_mean_c", "relative_humidity_pct")]
    return daily.select("as_of_date", *six, "regions_reporting", "regions_expected")


def _span(first: int, last: int) -> str:
    end = f"INTERVAL {last} DAYS PRECEDING" if last else "CURRENT ROW"
    return f"(ORDER BY as_of_date RANGE BETWEEN INTERVAL {first} DAYS PRECEDING AND {end})"


FEATURES_SQL = f"""frames AS (
  SELECT *, avg(rainfall_mm) OVER {_span(29, 0)} AS recent, avg(rainfall_mm) OVER {_span(59, 30)} AS norm,
    avg(rainfall_mm) OVER {_span(7, 1)} AS prior, sum(rainfall_mm) OVER {_span(6, 0)} AS week,
    month(as_of_date) AS m FROM regional),
parts AS (
  SELECT *, CASE WHEN norm IS NULL THEN 0 ELSE
      {Q.signed('(recent - norm) / CASE WHEN norm > 0 THEN norm ELSE 1 END')} END AS rainfall_deviation,
    CASE WHEN prior IS NULL THEN 0 ELSE {Q.unit('abs(rainfall_mm - prior) / greatest(prior, 5.0::DOUBLE)')} END AS rainfall_shock,
    coalesce({Q.unit('abs(temperature_mean_c - 28.0::DOUBLE) / 10.0::DOUBLE')}, 0) AS temperature_stress,
    {Q.unit('week / 80.0::DOUBLE')} AS rain_part,
    coalesce({Q.unit('(relative_humidity_pct - 50.0::DOUBLE) / 40.0::DOUBLE')}, 0) AS humid_part,
    CAST(CASE WHEN m IN (8, 9, 10, 11, 12, 1, 2) THEN 1.0 WHEN m IN (3, 6, 7) THEN 0.6 ELSE 0.3 END AS DECIMAL(5,4)) AS stage_weight
  FROM frames),
features AS (
  SELECT *, CASE WHEN m IN (10, 11, 12, 1, 2, 3)
      THEN CAST(round(0.6 * rain_part + 0.4 * humid_part, 4) AS DECIMAL(5,4))
      ELSE {Q.unit('0.3 * CAST(round(0.6 * rain_part + 0.4 * humid_part, 4) AS DECIMAL(5,4))')}
    END AS harvest_risk_indicator FROM parts)"""
PART_COLUMNS = ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in
    ("rainfall_deviation", "rainfall_shock", "temperature_stress", "harvest_risk_indicator",
     "stage_weight")
)


@check(
    f"""WITH {Q.REGIONAL}, {FEATURES_SQL}
SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, {PART_COLUMNS} FROM features"""
)
def weather_features(t: Tables) -> DataFrame:
    daily = rolling.rainfall_features(B.regional_weather(t.weather()))
    return daily.select("as_of_date", "rainfall_deviation", "rainfall_shock",
                        "temperature_stress", "harvest_risk_indicator", "stage_weight")


WEATHER_SIGNAL_SQL = f"""WITH {Q.REGIONAL}, {FEATURES_SQL},
weighed AS (
  SELECT *, abs(rainfall_deviation) * stage_weight AS w1, rainfall_shock * stage_weight AS w2,
    temperature_stress * stage_weight AS w3, harvest_risk_indicator * stage_weight AS w4 FROM features),
topped AS (
  SELECT *, greatest(w1, w2, w3, w4) AS top,
    CASE greatest(w1, w2, w3, w4) WHEN w3 THEN 'temperature_stress' WHEN w2 THEN 'rainfall_shock'
      WHEN w1 THEN 'rainfall_deviation' ELSE 'harvest_risk_indicator' END AS primary_driver FROM weighed),
directed AS (
  SELECT *, CASE WHEN top < 0.15 THEN 'neutral'
    WHEN primary_driver = 'rainfall_deviation' AND rainfall_deviation < -0.15 AND m IN (8, 9) THEN 'bullish'
    WHEN primary_driver = 'rainfall_deviation' AND rainfall_deviation > 0.15 THEN 'bearish'
    WHEN primary_driver = 'rainfall_shock' AND rainfall_shock > 0.15 THEN 'bearish'
    WHEN primary_driver = 'temperature_stress' AND temperature_stress > 0.15 AND m IN (8, 9) THEN 'bullish'
    WHEN primary_driver = 'temperature_stress' AND temperature_stress > 0.15 THEN 'bearish'
    WHEN primary_driver = 'harvest_risk_indicator' AND (harvest_risk_indicator > 0.15
      OR (harvest_risk_indicator < 0.15 AND m IN (10, 11, 12, 1, 2))) THEN 'bearish'
    ELSE 'neutral' END AS direction, {Q.unit('top')} AS magnitude FROM topped)
SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, primary_driver, direction,
  CAST(magnitude AS DOUBLE) AS magnitude,
  CAST({Q.unit('regions_reporting / regions_expected::DOUBLE * 0.9::DOUBLE')} AS DOUBLE) AS confidence,
  CAST(({Q.sign('direction')}) * magnitude AS DOUBLE) AS value,
  strftime(as_of_date + INTERVAL 12 HOURS, '%Y-%m-%d %H:%M:%S') AS as_of_timestamp FROM directed"""


@check(WEATHER_SIGNAL_SQL)
def weather_signal_daily(t: Tables) -> DataFrame:
    return weather_signal(t.weather()).select(
        "as_of_date", "primary_driver", "direction", "magnitude", "confidence", "value",
        "as_of_timestamp",
    )
