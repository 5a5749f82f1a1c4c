"""Coverage, lag, health class and quality score expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed


def ratio(part: Column, whole: Column) -> Column:
    """min(1, part / whole); an empty denominator gives 0."""
    return F.when(whole > 0, F.least(F.lit(1.0), part / whole)).otherwise(F.lit(0.0))


def lag_hours(latest: Column, now: Column) -> Column:
    """Hours between the two, not below 0; NULL while nothing was observed."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(latest.cast("timestamp"))
    hours = micros / F.lit(3_600_000_000.0)
    return F.when(hours > 0, hours).when(hours.isNotNull(), F.lit(0.0))


def health_class(
    coverage: Column,
    completeness: Column,
    lag: Column,
    has_data: Column,
    stale_after: float = fixed.STALE_LAG_HOURS,
) -> Column:
    return (
        F.when(~has_data | (coverage <= 0), "missing")
        .when(lag.isNotNull() & (lag > stale_after), "stale")
        .when((coverage < 0.5) | (completeness < 0.25), "stale")
        .otherwise("fresh")
    )


def signal_freshness(lag: Column, has_signals: Column) -> Column:
    one = F.when(has_signals, 1.0).otherwise(0.0)
    return health_class(one, one, lag, has_signals)


def quality_score(
    coverage: Column, completeness: Column, lag: Column, anomalies: Column, rows: Column
) -> Column:
    """0.4 coverage + 0.35 completeness + 0.25 freshness - anomaly share, clipped to [0, 1]."""
    freshness = F.when(
        lag.isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - lag / fixed.FRESHNESS_HOURS)
    ).otherwise(F.lit(1.0))
    raw = (
        F.lit(0.4) * coverage
        + F.lit(0.35) * completeness
        + F.lit(0.25) * freshness
        - anomaly_penalty(anomalies, rows)
    )
    return F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 4)


def anomaly_penalty(anomalies: Column, rows: Column) -> Column:
    return F.when(
        (rows > 0) & (anomalies > 0), F.least(F.lit(0.3), anomalies / rows)
    ).otherwise(F.lit(0.0))


def score_penalty(score: Column) -> Column:
    return F.round(F.least(F.greatest(F.lit(1.0) - score, F.lit(0.0)), F.lit(1.0)), 4)


def blended_score(market: Column, weather: Column, weather_reporting: Column) -> Column:
    """Mean of both tiers when the second tier reports, else the first alone."""
    four = lambda c: c.cast("decimal(9,4)")
    mean = F.round((four(market) + four(weather)) * F.lit(Decimal("0.5")), 4).cast("double")
    return F.when(weather_reporting > 0, mean).otherwise(market)


def lag_penalty(hours: Column) -> Column:
    share = F.least(F.lit(fixed.MAX_LAG_PENALTY), hours / fixed.LAG_HOURS_CAP)
    # least() skips NULLs, so an unknown lag is told apart first.
    return F.when(hours.isNull(), F.lit(0.0)).otherwise(F.round(share, 4))


def lag_penalty_from_json(source_health: Column, source: str = fixed.MARKET_SOURCE) -> Column:
    """Lag looked up at ``$.<source>`` or its ``detail``; a missing path means no penalty."""
    name = f"{source}_lag_hours"
    direct = F.get_json_object(source_health, f"$.{source}.{name}")
    nested = F.get_json_object(source_health, f"$.{source}.detail.{name}")
    return lag_penalty(F.coalesce(direct, nested).try_cast("double"))
