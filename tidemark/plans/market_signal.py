"""Market signal of every series and day in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import dates, market
from tidemark.functions import scores as S
from tidemark.functions.quality import lag_penalty
from tidemark.operators import basket as B
from tidemark.operators import rolling

FEATURES = {
    "price_momentum": "momentum",
    "arrival_momentum": "arrival",
    "price_vs_msp_distance": "floor",
    "price_acceleration": "acceleration",
}


def market_signal(
    prices: DataFrame,
    arrivals: DataFrame,
    expected: DataFrame,
    rules: DataFrame | None = None,
    requested: DataFrame | None = None,
    lag: DataFrame | None = None,
) -> DataFrame:
    """Four features and their composite per (series, day).

    ``requested`` names the (series, day) rows to emit (default: days with any usable row); a
    requested day without observations gets the neutral row. ``rules`` holds one decision-rules
    map per series, ``lag`` optional source lag hours per (series, day).
    """
    keys = [B.SERIES, B.DAY]
    prices = B.usable_rows(prices, expected)
    arrivals = B.usable_rows(arrivals, expected)
    daily = B.with_reporting_ratio(B.daily_prices(prices), expected)
    priced = rolling.price_acceleration(rolling.price_momentum(daily))
    joined = priced.join(rolling.arrival_momentum(B.arrival_totals(arrivals)), keys, "full")
    if requested is not None:
        joined = requested.select(*keys).distinct().join(joined, keys, "left")
    joined = _with_rules(joined, rules)
    if lag is not None:
        joined = joined.join(lag.select(*keys, "lag_hours"), keys, "left")
        penalty = lag_penalty(F.col("lag_hours"))
    else:
        penalty = F.lit(0.0)
    floor, is_stub = market.floor_price(F.col("decision_rules"))
    near = market.proximity(F.col("decision_rules"))
    distance = market.floor_distance(F.col("level"), floor, near, is_stub)
    staged = joined.select(
        *keys,
        F.greatest("price_seen_at", "arrival_seen_at").alias("last_observed_at"),
        "level",
        "volume",
        *[_or_neutral(f"{p}_{part}") for p in ("momentum", "arrival", "acceleration")
          for part in ("raw", "direction", "magnitude", "confidence")],
        *[c.alias(f"floor_{part}") for part, c in distance.items()],
        F.coalesce("reporting_pct", F.lit(0.0)).alias("reporting_pct"),
        floor.alias("floor_price"),
        is_stub.alias("floor_is_stub"),
        near.alias("floor_proximity"),
        penalty.alias("lag_penalty"),
    )
    return _composite(staged)


def _with_rules(joined: DataFrame, rules: DataFrame | None) -> DataFrame:
    if rules is None:
        return joined.withColumn("decision_rules", F.create_map().cast("map<string,string>"))
    return joined.join(rules.select(B.SERIES, "decision_rules"), B.SERIES, "left")


def _or_neutral(name: str) -> Column:
    default = F.lit(fixed.NEUTRAL) if name.endswith("direction") else S.dec(0)
    return F.coalesce(F.col(name), default).alias(name)


def _composite(staged: DataFrame) -> DataFrame:
    part = lambda kind: {f: F.col(f"{p}_{kind}") for f, p in FEATURES.items()}
    direction = market.vote(fixed.MARKET_WEIGHTS, part("direction"), fixed.MARKET_BAND)
    magnitude = S.clip_unit(S.weighted_sum(fixed.MARKET_WEIGHTS, part("magnitude")))
    confidence = market.composite_confidence(
        list(part("confidence").values()),
        F.col("reporting_pct"),
        F.col("lag_penalty"),
        F.col("floor_is_stub"),
    )
    close = dates.at_time(F.col(B.DAY), dates.MARKET_SIGNAL_HOUR)
    scored = staged.select(
        "*", direction.alias("direction"), magnitude.alias("magnitude"),
        confidence.alias("confidence"),
    )
    return scored.select(
        *[c for c in scored.columns if c != "last_observed_at"],
        S.signed_value(F.col("direction"), F.col("magnitude")).alias("value"),
        F.coalesce("last_observed_at", close).alias("as_of_timestamp"),
    )


def components(signal: DataFrame) -> Column:
    """Component map of the signal as ordered text pairs, for snapshots and features."""
    pairs: list[Column] = []
    for feature, prefix in FEATURES.items():
        for part in ("raw", "direction", "magnitude", "confidence"):
            pairs += [F.lit(f"{feature}.{part}"), F.col(f"{prefix}_{part}").cast("string")]
    pairs += [F.lit("primary_markets_reporting_pct"), F.col("reporting_pct").cast("string")]
    pairs += [F.lit("msp_inr_quintal"), F.col("floor_price").cast("string")]
    pairs += [F.lit("msp_is_stub"), F.col("floor_is_stub").cast("string")]
    return F.create_map(*pairs)
