"""Futures signal of every series and day in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import dates, futures
from tidemark.functions import scores as S
from tidemark.operators import basket as B
from tidemark.operators import contracts as C
from tidemark.operators import rolling


def futures_signal(
    observations: DataFrame,
    spot: DataFrame,
    requested: DataFrame | None = None,
    feed_ok: DataFrame | None = None,
) -> DataFrame:
    """Curve, basis and open-interest features with their composite.

    ``spot`` is the price basket (series, day, level). Days without a near and a far contract get
    the neutral row. The feed flag only feeds the confidence; the emitted flag stays false.
    """
    keys = [B.SERIES, B.DAY]
    usable = B.usable_rows(observations)
    # Without a request the curve pass itself names the days, so no further scan is needed.
    curve = C.near_far(usable, all_days=True)
    # The near expiry is a property of the day, so each expiry's history is scored at its marked
    # days (equal keys, calendar frame) instead of joining a date range.
    marks = curve.filter(F.col("near_expiry").isNotNull()).select(
        B.SERIES, F.col("near_expiry").alias("expiry_date"), B.DAY
    )
    history = rolling.open_interest_change(C.open_interest_history(usable), marks).drop(
        "expiry_date"
    )
    if requested is not None:
        curve = requested.select(*keys).distinct().join(curve, keys, "left")
    joined = (
        curve.join(history, keys, "left")
        .join(spot.select(*keys, F.col("level").alias("spot_level")), keys, "left")
    )
    if feed_ok is not None:
        joined = joined.join(feed_ok.select(*keys, "feed_ok"), keys, "left")
        ok = F.coalesce("feed_ok", F.lit(False)) & F.col("near_settle").isNotNull()
    else:
        ok = F.lit(False)
    return _score(joined, ok)


def _score(joined: DataFrame, ok: Column) -> DataFrame:
    near, far, spot = F.col("near_settle"), F.col("far_settle"), F.col("spot_level")
    has_curve = near.isNotNull() & far.isNotNull()
    zero = S.dec(0)
    staged = joined.select(
        "*",
        has_curve.alias("_curve"),
        F.when(has_curve, futures.curve_slope(near, far)).otherwise(zero).alias("curve_slope"),
        F.when(has_curve, futures.basis(near, spot)).otherwise(zero).alias("basis_futures_spot"),
        F.when(has_curve, F.coalesce("open_interest_z", zero)).otherwise(zero)
        .alias("open_interest_change"),
        F.when(has_curve, futures.thin_penalty(F.coalesce("latest_open_interest", F.lit(0))))
        .otherwise(S.dec("0.00")).alias("thin_oi_penalty"),
        futures.spot_gap_penalty(spot).alias("spot_gap_penalty"),
        F.when(has_curve, ok).otherwise(F.lit(False)).alias("feed_ok_input"),
    )
    slope, basis_, oi = (F.col(c) for c in
                         ("curve_slope", "basis_futures_spot", "open_interest_change"))
    staged = staged.withColumn("curve_regime", futures.regime(slope))
    curve = F.col("curve_regime")
    driver = futures.primary_driver(slope, basis_, oi, curve)
    staged = staged.withColumn(
        "primary_driver", F.when(F.col("_curve"), driver).otherwise("curve_slope")
    )
    scored = staged.select(
        "*",
        F.when(
            F.col("_curve"), futures.direction(F.col("primary_driver"), slope, basis_, oi, curve)
        ).otherwise(fixed.NEUTRAL).alias("direction"),
        futures.magnitude(slope, basis_, oi, curve).alias("magnitude"),
        futures.confidence(
            F.col("feed_ok_input"), F.col("thin_oi_penalty"), F.col("spot_gap_penalty")
        ).alias("confidence"),
    )
    close = dates.at_time(F.col(B.DAY), dates.FUTURES_CLOSE)
    return scored.select(
        B.SERIES, B.DAY, "near_symbol", "near_expiry", "far_symbol", "far_expiry",
        F.col("near_settle").alias("near_settle_quintal"),
        F.col("far_settle").alias("far_settle_quintal"),
        F.col("spot_level").alias("spot_modal_quintal"),
        "curve_slope", "basis_futures_spot", "open_interest_change", "curve_regime",
        "primary_driver", "thin_oi_penalty", "spot_gap_penalty", "direction", "magnitude",
        "confidence",
        S.signed_value(F.col("direction"), F.col("magnitude")).alias("value"),
        F.lit(False).alias("futures_feed_ok"),
        "feed_ok_input",
        F.coalesce("near_observed_at", close).alias("as_of_timestamp"),
    )


def components() -> Column:
    names = ["curve_slope", "basis_futures_spot", "open_interest_change", "curve_regime",
             "primary_driver", "near_settle_quintal", "far_settle_quintal",
             "spot_modal_quintal", "thin_oi_penalty", "spot_gap_penalty"]
    pairs: list[Column] = []
    for name in names:
        pairs += [F.lit(name), F.col(name).cast("string")]
    return F.create_map(*pairs)
