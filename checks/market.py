"""Market family: baskets, momentum, acceleration, floor distance, composite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql as Q
from checks.base import check
from tidemark import fixed
from tidemark.adapters import Tables
from tidemark.functions import market
from tidemark.operators import basket as B
from tidemark.operators import ranks, rolling
from tidemark.plans.market_signal import market_signal


def basket(t: Tables) -> DataFrame:
    return B.price_basket(B.usable_rows(t.prices(), t.markets()))


@check(
    f"""WITH {Q.PRICES}
SELECT series_id, market_id, price_type, count(*) AS row_count, round(sum(value), 2) AS total
FROM prices WHERE validation_status IN ('validated', 'published') AND price_type = 'modal'
GROUP BY ALL"""
)
def usable_modal_rows(t: Tables) -> DataFrame:
    rows = B.usable_rows(t.prices(), t.markets(), price_type=fixed.MODAL)
    return rows.groupBy("series_id", "market_id", "price_type").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("value"), 2).alias("total")
    )


@check(f"WITH {Q.BASKET} SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, level FROM basket")
def price_basket(t: Tables) -> DataFrame:
    return basket(t)


@check(
    f"""WITH {Q.PRICES}
SELECT series_id, market_id, median(value) AS level FROM prices GROUP BY ALL"""
)
def split_group_median(t: Tables) -> DataFrame:
    """Groups whose middle blocks have to be read again."""
    rows = t.prices().select("series_id", "market_id", "value")
    return ranks.exact_median(rows, ["series_id", "market_id"], "value", "level")


@check(
    f"""WITH {Q.PRICES}, ranked AS (
  SELECT series_id, value, rank() OVER (PARTITION BY series_id ORDER BY value) AS first_rank,
    count(*) OVER (PARTITION BY series_id, value) AS ties FROM prices)
SELECT DISTINCT series_id, value, first_rank + (ties - 1) / 2.0::DOUBLE AS average_rank FROM ranked"""
)
def pooled_average_rank(t: Tables) -> DataFrame:
    rows = t.prices().select("series_id", "value")
    return ranks.average_ranks(rows, ["series_id"], "value", "average_rank")


@check(
    f"WITH {Q.VOLUMES} SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, volume FROM volumes"
)
def arrival_totals(t: Tables) -> DataFrame:
    return B.arrival_totals(B.usable_rows(t.arrivals(), t.markets())).drop("arrival_seen_at")


@check(
    f"""WITH {Q.BASKET}
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, markets_reporting,
  round(markets_reporting / (SELECT count(*) FROM supplier)::DOUBLE, 4) AS reporting_pct FROM basket"""
)
def reporting_ratio(t: Tables) -> DataFrame:
    daily = B.daily_prices(B.usable_rows(t.prices(), t.markets(), price_type=fixed.MODAL))
    return B.with_reporting_ratio(daily, t.markets()).drop("level", "price_seen_at")


W30 = "(PARTITION BY series_id ORDER BY as_of_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)"
MOMENTUM_SQL = f"""momentum0 AS (
  SELECT *, count(level) OVER w AS n, avg(level) OVER w AS mean, stddev_pop(level) OVER w AS dev
  FROM basket WINDOW w AS {W30}),
momentum1 AS (
  SELECT series_id, as_of_date, level, markets_reporting, n,
    CAST(CASE WHEN n >= 2 AND dev > 0 THEN round((level - mean) / dev, 4) ELSE 0 END AS DECIMAL(12,4)) AS z
  FROM momentum0),
momentum AS (
  SELECT series_id, as_of_date, level, markets_reporting, z AS momentum_raw,
    {Q.band('z', '0.05')} AS momentum_direction,
    {Q.unit('abs(z) / 3.0::DOUBLE')} AS momentum_magnitude,
    CAST(CASE WHEN n < 2 THEN 0 WHEN n >= 7 THEN 1 ELSE 0.5 END AS DECIMAL(5,4)) AS momentum_confidence
  FROM momentum1)"""


@check(
    f"""WITH {Q.BASKET}, {MOMENTUM_SQL}
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, level,
  CAST(momentum_raw AS DOUBLE) AS momentum_raw, momentum_direction,
  CAST(momentum_magnitude AS DOUBLE) AS momentum_magnitude,
  CAST(momentum_confidence AS DOUBLE) AS momentum_confidence FROM momentum"""
)
def price_momentum(t: Tables) -> DataFrame:
    return rolling.price_momentum(basket(t))


ARRIVAL_SQL = f"""arrival0 AS (
  SELECT *, count(volume) OVER w AS n, avg(volume) OVER w AS mean, stddev_pop(volume) OVER w AS dev
  FROM volumes WINDOW w AS {W30}),
arrival1 AS (
  SELECT series_id, as_of_date, volume, n,
    CASE WHEN month(as_of_date) IN (10, 11, 12, 1, 2, 3) THEN 1 ELSE 0 END AS gate,
    CAST(CASE WHEN n >= 2 AND dev > 0 THEN round((volume - mean) / dev, 4) ELSE 0 END AS DECIMAL(12,4)) AS z
  FROM arrival0),
arrival AS (
  SELECT series_id, as_of_date, volume, z AS arrival_raw,
    {Q.band('-z', '0.05')} AS arrival_direction,
    {Q.unit('gate * ' + Q.unit('abs(z) / 3.0::DOUBLE'))} AS arrival_magnitude,
    CAST(CASE WHEN n < 2 THEN 0 WHEN n >= 7 THEN gate ELSE 0.5 * gate END AS DECIMAL(5,4)) AS arrival_confidence
  FROM arrival1)"""


@check(
    f"""WITH {Q.VOLUMES}, {ARRIVAL_SQL}
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, volume,
  CAST(arrival_raw AS DOUBLE) AS arrival_raw, arrival_direction,
  CAST(arrival_magnitude AS DOUBLE) AS arrival_magnitude,
  CAST(arrival_confidence AS DOUBLE) AS arrival_confidence FROM arrival"""
)
def arrival_momentum(t: Tables) -> DataFrame:
    totals = B.arrival_totals(B.usable_rows(t.arrivals(), t.markets()))
    return rolling.arrival_momentum(totals).drop("arrival_seen_at")


# Built per frame from the list of levels, independently of the integer sums used on Spark.
ACCELERATION_SQL = f"""accel0 AS (
  SELECT series_id, as_of_date, list(level ORDER BY as_of_date) OVER {W30} AS p FROM basket),
accel1 AS (
  SELECT *, [round((p[i] - p[i-1]) / p[i-1], 4) FOR i IN range(2, len(p) + 1)] AS m FROM accel0),
accel2 AS (
  SELECT *, [round(m[i] - m[i-1], 4) FOR i IN range(2, len(m) + 1)] AS a FROM accel1),
accel3 AS (
  SELECT *, list_avg(a) AS mean, list_avg([(x - list_avg(a)) * (x - list_avg(a)) FOR x IN a]) AS var
  FROM accel2),
accel4 AS (
  SELECT series_id, as_of_date, len(a) AS n,
    CAST(CASE WHEN len(a) = 0 THEN 0 WHEN len(a) = 1 THEN a[1]
      WHEN var > 1e-18 THEN round((a[-1] - mean) / sqrt(var), 4) ELSE 0 END AS DECIMAL(12,4)) AS z
  FROM accel3),
acceleration AS (
  SELECT series_id, as_of_date, z AS acceleration_raw,
    {Q.band('z', '0.05')} AS acceleration_direction,
    {Q.unit('abs(z) / 3.0::DOUBLE')} AS acceleration_magnitude,
    CAST(CASE WHEN n = 0 THEN 0 WHEN n >= 5 THEN 1 ELSE 0.5 END AS DECIMAL(5,4)) AS acceleration_confidence
  FROM accel4)"""


@check(
    f"""WITH {Q.BASKET}, {ACCELERATION_SQL}
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date,
  CAST(acceleration_raw AS DOUBLE) AS acceleration_raw, acceleration_direction,
  CAST(acceleration_magnitude AS DOUBLE) AS acceleration_magnitude,
  CAST(acceleration_confidence AS DOUBLE) AS acceleration_confidence FROM acceleration"""
)
def price_acceleration(t: Tables) -> DataFrame:
    return rolling.price_acceleration(basket(t)).drop("level")


# Levels are quarters of a cent at most, so the half-up quotient is exact in whole numbers.
FLOOR_SQL = f"""rules AS (
  SELECT DISTINCT p_type AS series_id,
    CASE WHEN length(p_type) > 5 THEN length(p_type) * 25000.0::DOUBLE END AS msp FROM part),
floor0 AS (
  SELECT series_id, as_of_date, level, coalesce(msp, 7121.0::DOUBLE) AS floor_price,
    msp IS NULL AS floor_is_stub, CASE WHEN msp IS NULL THEN 300 ELSE 4000 END AS near
  FROM basket JOIN rules USING (series_id)),
floor1 AS (
  SELECT *, CAST(sign(level - floor_price) * ((CAST(abs(level - floor_price) * 4 AS BIGINT) * 20000 + CAST(floor_price * 4 AS BIGINT)) // (2 * CAST(floor_price * 4 AS BIGINT))) * 0.0001 AS DECIMAL(12,4)) AS d FROM floor0),
floors AS (
  SELECT series_id, as_of_date, level, floor_price, floor_is_stub, d AS floor_raw,
    {Q.band('-d', '0.05')} AS floor_direction, CAST(least(10000, (CAST(abs(d) * 10000 AS BIGINT) * 20000 + near) // (2 * near)) * 0.0001 AS DECIMAL(5,4)) AS floor_magnitude,
    CAST(CASE WHEN floor_is_stub THEN 0.65 ELSE 0.75 END AS DECIMAL(5,4)) AS floor_confidence
  FROM floor1)"""


@check(
    f"""WITH {Q.BASKET}, {FLOOR_SQL}
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, level, floor_price, floor_is_stub,
  CAST(floor_raw AS DOUBLE) AS floor_raw, floor_direction,
  CAST(floor_magnitude AS DOUBLE) AS floor_magnitude,
  CAST(floor_confidence AS DOUBLE) AS floor_confidence FROM floors"""
)
def floor_distance(t: Tables) -> DataFrame:
    rows = basket(t).join(t.rules(), "series_id")
    floor, is_stub = market.floor_price(F.col("decision_rules"))
    near = market.proximity(F.col("decision_rules"))
    parts = market.floor_distance(F.col("level"), floor, near, is_stub)
    return rows.select(
        "series_id",
        "as_of_date",
        "level",
        floor.alias("floor_price"),
        is_stub.alias("floor_is_stub"),
        *[c.alias(f"floor_{name}") for name, c in parts.items()],
    )


_N = "coalesce({0}_direction, 'neutral') AS {0}_direction, coalesce({0}_magnitude, 0) AS {0}_magnitude, coalesce({0}_confidence, 0) AS {0}_confidence, coalesce({0}_raw, 0) AS {0}_raw"
VOTE = " + ".join(
    f"{w} * ({Q.sign(p + '_direction')})"
    for w, p in (("0.35", "momentum"), ("0.25", "arrival"), ("0.25", "floor"), ("0.15", "acceleration"))
)
STRENGTH = (
    "0.35 * momentum_magnitude + 0.25 * arrival_magnitude + 0.25 * floor_magnitude "
    "+ 0.15 * acceleration_magnitude"
)
TRUST = "momentum_confidence + arrival_confidence + floor_confidence + acceleration_confidence"
SIGNAL_SQL = f"""WITH {Q.BASKET}, {MOMENTUM_SQL}, {ACCELERATION_SQL}, {FLOOR_SQL},
{Q.VOLUMES}, {ARRIVAL_SQL},
seen AS (
  SELECT series_id, as_of_date, max(observed_at) AS seen_at FROM (
    SELECT series_id, as_of_date, observed_at FROM prices WHERE validation_status = 'validated'
    UNION ALL SELECT series_id, as_of_date, observed_at FROM arrivals WHERE validation_status = 'validated')
  GROUP BY ALL),
joined AS (
  SELECT s.series_id, s.as_of_date, s.seen_at, m.level, v.volume, r.msp IS NULL AS floor_is_stub,
    {_N.format('momentum')}, {_N.format('arrival')}, {_N.format('acceleration')}, {_N.format('floor')},
    coalesce(round(m.markets_reporting / (SELECT count(*) FROM supplier)::DOUBLE, 4), 0) AS reporting_pct
  FROM seen s LEFT JOIN momentum m USING (series_id, as_of_date)
  LEFT JOIN acceleration USING (series_id, as_of_date)
  LEFT JOIN floors f USING (series_id, as_of_date)
  LEFT JOIN arrival v USING (series_id, as_of_date) JOIN rules r USING (series_id)),
scored AS (
  SELECT *, {Q.band('(' + VOTE + ')', '0.05')} AS direction, {Q.unit(STRENGTH)} AS magnitude,
    {Q.unit('0.75 * CAST(reporting_pct AS DECIMAL(5,4)) * CAST((' + TRUST + ') * 0.25 AS DECIMAL(5,4))'
            ' * CASE WHEN floor_is_stub THEN 0.90 ELSE 1.00 END')} AS confidence
  FROM joined)
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, level, volume, direction,
  CAST(momentum_raw AS DOUBLE) AS momentum_raw, CAST(arrival_raw AS DOUBLE) AS arrival_raw,
  CAST(acceleration_raw AS DOUBLE) AS acceleration_raw, CAST(floor_raw AS DOUBLE) AS floor_raw,
  CAST(magnitude AS DOUBLE) AS magnitude, CAST(confidence AS DOUBLE) AS confidence,
  CAST(({Q.sign('direction')}) * magnitude AS DOUBLE) AS value, reporting_pct,
  strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS as_of_timestamp FROM scored"""


@check(SIGNAL_SQL)
def market_signal_daily(t: Tables) -> DataFrame:
    signal = market_signal(t.prices(), t.arrivals(), t.markets(), t.rules())
    return signal.select(
        "series_id", "as_of_date", "level", "volume", "direction", "momentum_raw", "arrival_raw",
        "acceleration_raw", "floor_raw", "magnitude", "confidence", "value", "reporting_pct",
        "as_of_timestamp",
    )


@check(
    f"""WITH {Q.BASKET}, spine AS (
  SELECT series_id, CAST(unnest(generate_series(min(as_of_date), max(as_of_date), INTERVAL 1 DAY)) AS DATE) AS as_of_date
  FROM basket GROUP BY series_id)
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, level FROM spine LEFT JOIN basket USING (series_id, as_of_date)"""
)
def calendar_spine(t: Tables) -> DataFrame:
    from tidemark.functions.dates import date_spine

    level = basket(t)
    bounds = level.groupBy("series_id").agg(
        F.min("as_of_date").alias("first_day"), F.max("as_of_date").alias("last_day")
    )
    return date_spine(bounds, "first_day", "last_day").join(
        level, ["series_id", "as_of_date"], "left"
    )


@check(
    f"""WITH {Q.BASKET}, refs AS (
  SELECT b.series_id, b.as_of_date, p.observation_id FROM basket b JOIN prices p
    ON p.series_id = b.series_id AND p.as_of_date BETWEEN b.as_of_date - 29 AND b.as_of_date
  WHERE p.price_type = 'modal' AND p.validation_status = 'validated')
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date,
  count(DISTINCT observation_id) AS ref_count, min(observation_id) AS first_ref,
  max(observation_id) AS last_ref FROM refs GROUP BY ALL"""
)
def source_references(t: Tables) -> DataFrame:
    rows = B.usable_rows(t.prices(), t.markets(), price_type=fixed.MODAL)
    return B.reference_counts(rows, B.source_refs(rows, [rows]))
