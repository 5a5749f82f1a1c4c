"""Market signal formulas: floor-price distance and composites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import scores as S
from tidemark.schemas import UNIT_SCORE


def rule_number(rules: Column, key: str) -> Column:
    """Numeric entry of a rules map; NULL when absent or not a number."""
    return F.try_element_at(rules, F.lit(key)).try_cast("double")


def floor_price(rules: Column) -> tuple[Column, Column]:
    """Floor price from the rules, else the stub; second column tells which."""
    ruled = rule_number(rules, fixed.FLOOR_RULE_KEY)
    return F.coalesce(ruled, F.lit(float(fixed.FLOOR_STUB_PRICE))), ruled.isNull()


def proximity(rules: Column) -> Column:
    return F.coalesce(
        rule_number(rules, fixed.PROXIMITY_RULE_KEY), F.lit(fixed.PROXIMITY_DEFAULT)
    )


def floor_distance(spot: Column, floor: Column, near: Column, is_stub: Column) -> dict[str, Column]:
    """Signed distance from the floor; below the floor is bullish support."""
    known = spot.isNotNull() & (floor > 0)
    raw = F.when(known, S.exact((spot - floor) / floor)).otherwise(S.dec(0))
    # Decimal division: a binary quotient can fall on the wrong side of a rounding tie.
    reach = F.greatest(near.cast("decimal(9,4)"), S.dec("0.0001"))
    strength = S.clip_unit(F.abs(raw) / reach)
    trust = F.when(is_stub, S.dec("0.65")).otherwise(S.dec("0.75"))
    return {
        "raw": raw,
        "direction": S.band_direction(raw, fixed.MARKET_BAND, invert=True),
        "magnitude": strength,
        "confidence": F.when(known, trust).otherwise(S.dec(0)),
    }


def vote(weights: dict[str, str], directions: dict[str, Column], band: float | str) -> Column:
    """Direction of the weighted sum of signs."""
    parts = [S.dec(w) * S.direction_sign(directions[name]) for name, w in weights.items()]
    return S.band_direction(sum(parts[1:], parts[0]), band)


def composite_confidence(
    factors: list[Column], coverage: Column, lag: Column, is_stub: Column
) -> Column:
    unit = lambda c: c.cast(UNIT_SCORE)
    total = sum((unit(f) for f in factors[1:]), unit(factors[0]))
    mean = unit(total * S.dec("0.25"))
    stub = F.when(is_stub, S.dec(1) - S.dec(fixed.FLOOR_STUB_PENALTY)).otherwise(S.dec("1.00"))
    raw = (
        S.dec(fixed.MARKET_CONFIDENCE_BASE)
        * unit(coverage)
        * mean
        * unit(F.lit(1) - lag)
        * unit(stub)
    )
    return S.clip_unit(raw)
