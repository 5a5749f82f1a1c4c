"""Snapshots of all three signals from raw observations to hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql as Q
from checks.base import check
from checks.futures import FUTURES_SIGNAL_SQL
from checks.market import SIGNAL_SQL
from checks.weather import WEATHER_SIGNAL_SQL
from tidemark import fixed
from tidemark.adapters import Tables
from tidemark.plans import combined

LAST = fixed.MARKET_WINDOW_DAYS - 1


def signals(t: Tables) -> DataFrame:
    series = t.rules().select("series_id")
    return combined.combined_signals(
        t.prices(), t.arrivals(), t.markets(), t.rules(), t.weather(), t.futures(),
        series.select(F.col("series_id").alias("commodity_id"), F.lit("r1").alias("registry_id")),
        series.withColumn("weather_series", F.lit("belt")),
    )


@check(
    f"""WITH market AS ({SIGNAL_SQL}), curve AS ({FUTURES_SIGNAL_SQL}), sky AS ({WEATHER_SIGNAL_SQL}),
refs AS (
  WITH {Q.PRICES}, {Q.ARRIVALS}
  SELECT series_id, as_of_date, 'price:' || observation_id AS ref FROM prices WHERE validation_status = 'validated'
  UNION ALL SELECT series_id, as_of_date, 'arrival:' || observation_id FROM arrivals WHERE validation_status = 'validated'),
days AS (
  SELECT series_id, as_of_date, count(*) AS n, sum(CAST('0x' || left(md5(ref), 15) AS BIGINT)) AS s FROM refs GROUP BY ALL),
provenance AS (
  SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(CAST(sum(s) OVER w AS HUGEINT) AS VARCHAR) AS s
  FROM days WINDOW w AS (PARTITION BY series_id ORDER BY as_of_date RANGE BETWEEN INTERVAL {LAST} DAYS PRECEDING AND CURRENT ROW))
SELECT m.series_id AS commodity_id, CAST(m.as_of_date AS VARCHAR) AS as_of_date,
  CAST(CASE WHEN k.as_of_date IS NULL THEN 2 ELSE 3 END AS BIGINT) AS signal_count,
  m.direction AS market_direction, CAST(m.confidence AS DOUBLE) AS market_confidence,
  coalesce(c.direction, 'neutral') AS futures_direction, k.direction AS weather_direction,
  CAST(k.confidence AS DOUBLE) AS weather_confidence, coalesce(p.n, 0) AS reference_count, coalesce(p.s, '0') AS reference_digest
FROM market m LEFT JOIN curve c ON c.series_id = m.series_id AND CAST(c.as_of_date AS VARCHAR) = CAST(m.as_of_date AS VARCHAR)
LEFT JOIN sky k ON CAST(k.as_of_date AS VARCHAR) = CAST(m.as_of_date AS VARCHAR)
LEFT JOIN provenance p ON p.series_id = m.series_id AND p.as_of_date = CAST(m.as_of_date AS VARCHAR)"""
)
def combined_snapshots(t: Tables) -> DataFrame:
    """Market, futures and weather rows of a day in one hashed snapshot, provenance as a digest."""
    snap = combined.combined_snapshots(signals(t))
    of = lambda agent: F.get(F.filter("signals", lambda s: s["agent_type"] == agent), F.lit(0))
    market, curve, sky = of(combined.MARKET), of(combined.FUTURES), of(combined.WEATHER)
    return snap.filter(F.length("snapshot_hash") == 64).select(
        "commodity_id", "as_of_date", "signal_count",
        market["direction"].alias("market_direction"), market["confidence"].cast("double").alias("market_confidence"),
        curve["direction"].alias("futures_direction"), sky["direction"].alias("weather_direction"),
        sky["confidence"].cast("double").alias("weather_confidence"),
        F.element_at(market["inputs"], "reference_count").cast("long").alias("reference_count"),
        F.element_at(market["inputs"], "reference_digest").alias("reference_digest"),
    )
