"""Futures signal formulas: slope, basis, regime, driver and composites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import scores as S
from tidemark.functions.market import vote

BACKWARDATION, CONTANGO, FLAT = "backwardation", "contango", "flat"


def curve_slope(near: Column, far: Column) -> Column:
    return F.when(near > 0, S.exact((near - far) / near)).otherwise(S.dec(0))


def basis(near: Column, spot: Column) -> Column:
    return F.when(spot > 0, S.exact((near - spot) / spot)).otherwise(S.dec(0))


def regime(slope: Column) -> Column:
    edge = S.dec(fixed.FUTURES_BAND)
    return F.when(slope > edge, BACKWARDATION).when(slope < -edge, CONTANGO).otherwise(FLAT)


def regime_strength(curve: Column) -> Column:
    return F.when(curve == FLAT, S.dec(0)).otherwise(S.dec(1))


def primary_driver(slope: Column, basis_: Column, oi_z: Column, curve: Column) -> Column:
    weight = {name: S.dec(w) for name, w in fixed.FUTURES_WEIGHTS.items()}
    return S.top_component(
        {
            "curve_slope": F.abs(slope) * weight["curve_slope"],
            "basis": F.abs(basis_) * weight["basis"],
            "open_interest": S.z_magnitude(oi_z) * weight["open_interest"],
            "curve_regime": regime_strength(curve) * weight["curve_regime"],
        }
    )


def direction(driver: Column, slope: Column, basis_: Column, oi_z: Column, curve: Column) -> Column:
    """The driver's own direction; a neutral driver leaves it to the weighted vote."""
    band = fixed.FUTURES_BAND
    own = {
        "curve_slope": S.band_direction(slope, band),
        "basis": S.band_direction(basis_, band),
        "open_interest": S.band_direction(oi_z, band),
        "curve_regime": F.when(curve == BACKWARDATION, fixed.BULLISH)
        .when(curve == CONTANGO, fixed.BEARISH)
        .otherwise(fixed.NEUTRAL),
    }
    chosen = F.lit(fixed.NEUTRAL)
    for name, value in own.items():
        chosen = F.when(driver == name, value).otherwise(chosen)
    return F.when(chosen != fixed.NEUTRAL, chosen).otherwise(
        vote(fixed.FUTURES_WEIGHTS, own, band)
    )


def magnitude(slope: Column, basis_: Column, oi_z: Column, curve: Column) -> Column:
    return S.clip_unit(
        S.weighted_sum(
            fixed.FUTURES_WEIGHTS,
            {
                "curve_slope": F.abs(S.clip_signed(slope)),
                "basis": F.abs(S.clip_signed(basis_)),
                "open_interest": S.z_magnitude(oi_z),
                "curve_regime": regime_strength(curve),
            },
        )
    )


def thin_penalty(latest: Column) -> Column:
    thin = (latest > 0) & (latest < fixed.THIN_OPEN_INTEREST)
    return F.when(thin, S.dec(fixed.THIN_OPEN_INTEREST_PENALTY)).otherwise(S.dec("0.00"))


def spot_gap_penalty(spot: Column) -> Column:
    return F.when(spot.isNull(), S.dec(fixed.SPOT_GAP_PENALTY)).otherwise(S.dec("0.00"))


def confidence(feed_ok: Column, thin: Column, gap: Column) -> Column:
    feed = F.when(feed_ok, S.dec("1.00")).otherwise(S.dec(fixed.FUTURES_FEED_FACTOR))
    raw = S.dec(fixed.FUTURES_CONFIDENCE_BASE) * feed * (S.dec(1) - thin) * (S.dec(1) - gap)
    return S.clip_unit(F.least(raw, S.dec(fixed.FUTURES_CONFIDENCE_CAP)))
