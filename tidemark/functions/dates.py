"""Date parsing, session-close defaults, calendar windows and spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKET_CLOSE = (18, 30)
FUTURES_CLOSE = (17, 30)
WEATHER_NOON = (12, 0)
MARKET_SIGNAL_HOUR = (18, 0)


def day_first_date(raw: Column) -> Column:
    """DD/MM/YYYY with one- or two-digit day and month; impossible dates are NULL."""
    return F.try_to_date(F.trim(raw), "d/M/yyyy")


def any_format_date(raw: Column) -> Column:
    """First match of Y-m-d, d-m-Y, d/m/Y, Y/m/d.

    A format is tried only on texts of its shape: a failed parse raises inside the parser, which costs
    far more than the test. Days and months have at most two digits behind leading zeros.
    """
    text, small = F.trim(raw), "0*[0-9]{1,2}"
    shapes = {
        "y-M-d": f"^-?[0-9]+-{small}-{small}$", "d-M-y": f"^{small}-{small}--?[0-9]+$",
        "d/M/y": f"^{small}/{small}/-?[0-9]+$", "y/M/d": f"^-?[0-9]+/{small}/{small}$",
    }
    return F.coalesce(*[F.when(text.rlike(s), F.try_to_date(text, f)) for f, s in shapes.items()])


def decimal_text(raw: Column, kind: str = "decimal(18,4)") -> Column:
    """Decimal from text with thousands commas; blanks and '-' are NULL."""
    return F.regexp_replace(F.trim(raw), ",", "").try_cast(kind)


def at_time(day: Column, clock: tuple[int, int]) -> Column:
    return F.make_timestamp(
        F.year(day), F.month(day), F.dayofmonth(day), F.lit(clock[0]), F.lit(clock[1]), F.lit(0)
    )


def window_start(day: Column, days: int) -> Column:
    """First day of the inclusive ``days``-day window that ends on ``day``."""
    return F.date_sub(day, days - 1)


def month_window_start(day: Column, months: int) -> Column:
    """First day of the month ``months`` calendar months before ``day``."""
    return F.trunc(F.add_months(day, -months), "MM").cast("date")


def date_spine(bounds: DataFrame, start: str, end: str, day: str = "as_of_date") -> DataFrame:
    """One row per calendar day between two columns of ``bounds``, both ends included."""
    keep = [c for c in bounds.columns if c not in (start, end)]
    return bounds.select(*keep, F.explode(F.sequence(start, end)).alias(day))


def as_of_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")
