"""Rounding, clipping, bands and z magnitudes on columns."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.schemas import EXACT, UNIT_SCORE


def dec(value: str | int) -> Column:
    """Exact decimal literal."""
    return F.lit(Decimal(str(value)))


def quantize(x: Column, places: int = 4) -> Column:
    """Half-up rounding; Spark rounds the decimal text of a double, not its binary value."""
    return F.round(x, places)


def exact(x: Column) -> Column:
    """Quantised score as a four-place decimal, so weighted sums have no binary noise."""
    return F.round(x, 4).cast(EXACT)


def clip_unit(x: Column) -> Column:
    """Into [0, 1] at four places; NULL stays NULL (least and greatest alone would skip it)."""
    held = F.round(F.least(F.greatest(x, F.lit(0)), F.lit(1)), 4).cast(UNIT_SCORE)
    return F.when(x.isNotNull(), held)


def clip_signed(x: Column) -> Column:
    held = F.round(F.least(F.greatest(x, F.lit(-1)), F.lit(1)), 4).cast(UNIT_SCORE)
    return F.when(x.isNotNull(), held)


def band_direction(value: Column, band: float | str, invert: bool = False) -> Column:
    """bullish above the band, bearish below its negative, otherwise neutral."""
    signed = -value if invert else value
    edge = dec(str(band))
    return (
        F.when(signed > edge, fixed.BULLISH)
        .when(signed < -edge, fixed.BEARISH)
        .otherwise(fixed.NEUTRAL)
    )


def direction_sign(direction: Column) -> Column:
    return (
        F.when(direction == fixed.BULLISH, F.lit(1))
        .when(direction == fixed.BEARISH, F.lit(-1))
        .otherwise(F.lit(0))
    )


def signed_value(direction: Column, magnitude: Column) -> Column:
    return exact(direction_sign(direction) * magnitude)


def z_magnitude(z: Column) -> Column:
    """|z| on the [0, 1] scale that treats three deviations as full strength."""
    return clip_unit(F.abs(z) / F.lit(float(fixed.Z_SCALE)))


def month_in(day: Column, months: Iterable[int]) -> Column:
    return F.month(day).isin(*months)


def season_gate(day: Column) -> Column:
    return F.when(month_in(day, fixed.ARRIVAL_SEASON_MONTHS), dec(1)).otherwise(dec(0))


def weighted_sum(weights: dict[str, str], terms: dict[str, Column]) -> Column:
    """Sum of weight x term; terms are four-place unit scores, so the sum is exact."""
    products = [dec(weight) * terms[name].cast(UNIT_SCORE) for name, weight in weights.items()]
    return sum(products[1:], products[0])


def top_component(scores: dict[str, Column]) -> Column:
    """Name of the largest score; equal scores go to the greatest name."""
    entries = [
        F.struct(score.cast("decimal(24,8)").alias("score"), F.lit(name).alias("name"))
        for name, score in scores.items()
    ]
    return F.greatest(*entries).getField("name")


def log_return(spot: Column, target: Column) -> Column:
    return F.when((spot <= 0) | (target <= 0), F.lit(0.0)).otherwise(F.log(target / spot))


def percent_return(spot: Column, future: Column) -> Column:
    return F.when(spot > 0, (future - spot) / spot)


def number_or_null(x: Column) -> Column:
    """Numeric text, number text or boolean text to double; anything else is NULL."""
    text = F.trim(x.cast("string"))
    return (
        F.when(F.lower(text) == "true", F.lit(1.0))
        .when(F.lower(text) == "false", F.lit(0.0))
        .otherwise(text.try_cast("double"))
    )


def coded_number(x: Column) -> Column:
    """Like :func:`number_or_null` with direction codes; unparsable values become 0."""
    text = x.cast("string")
    return (
        F.when(text == fixed.BULLISH, F.lit(1.0))
        .when(text == fixed.BEARISH, F.lit(-1.0))
        .when(text == fixed.NEUTRAL, F.lit(0.0))
        .otherwise(F.coalesce(number_or_null(x), F.lit(0.0)))
    )
