"""Usable rows and daily series: price baskets, arrivals, reporting ratio, regional weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators.dedupe import first_per_key
from tidemark.operators.ranks import exact_median

SERIES = "series_id"
DAY = "as_of_date"


def usable_rows(
    df: DataFrame,
    allowed: DataFrame | None = None,
    entity: str = "market_id",
    statuses: tuple[str, ...] = fixed.USABLE_STATUSES,
    price_type: str | None = None,
) -> DataFrame:
    """Rows with a usable status and, when given, of an allowed entity and price type."""
    out = df.filter(F.col("validation_status").isin(*statuses))
    if price_type is not None:
        out = out.filter(F.col("price_type") == price_type)
    if allowed is not None:
        out = out.join(allowed.select(entity).distinct(), entity, "left_semi")
    return out


def daily_prices(prices: DataFrame) -> DataFrame:
    """Basket level, reporting markets and latest source time per series and day.

    The level is the median per market of the modal prices, then the median across markets. Both
    medians spread a group over value blocks, so neither a hot market nor a day with millions of
    markets meets in one task.
    """
    modal = F.when(F.col("price_type") == fixed.MODAL, F.col("value"))
    per_market = exact_median(
        prices.withColumn("_modal", modal), [SERIES, DAY, "market_id"], "_modal", "_level",
        latest={"_seen": "observed_at"},
    )
    return exact_median(
        per_market, [SERIES, DAY], "_level", "level",
        latest={"price_seen_at": "_seen"}, count="markets_reporting",
    )


def price_basket(prices: DataFrame) -> DataFrame:
    """Two-level median of the modal prices per series and day."""
    modal = prices.filter(F.col("price_type") == fixed.MODAL)
    per_market = exact_median(modal, [SERIES, DAY, "market_id"], "value", "_level")
    return exact_median(per_market, [SERIES, DAY], "_level", "level")


def arrival_totals(arrivals: DataFrame) -> DataFrame:
    """Daily volume sum with the latest source time."""
    return arrivals.groupBy(SERIES, DAY).agg(
        F.sum("volume").alias("volume"), F.max("observed_at").alias("arrival_seen_at")
    )


def with_reporting_ratio(daily: DataFrame, expected: DataFrame) -> DataFrame:
    """Adds the share of the expected markets that report a modal price, four places.

    ``daily`` comes from rows already restricted to the expected markets.
    """
    total = expected.agg(F.count_distinct("market_id")).scalar()
    share = F.round(F.col("markets_reporting") / total, 4)
    return daily.withColumn("reporting_pct", F.coalesce(F.when(total > 0, share), F.lit(0.0)))


def source_refs(
    requested: DataFrame, tables: list[DataFrame], window_days: int = fixed.MARKET_WINDOW_DAYS
) -> DataFrame:
    """Observations behind the requested (series, day) rows, each once, under its own day.

    A requested day rests on the references of the ``window_days`` up to it; a reader takes that
    range. Only days are expanded to their windows, never observations.
    """
    ids = None
    for table in tables:
        part = table.select(SERIES, DAY, "observation_id")
        ids = part if ids is None else ids.unionByName(part)
    covered = requested.select(SERIES, DAY).distinct().select(
        SERIES, F.explode(F.sequence(F.date_sub(DAY, window_days - 1), F.col(DAY))).alias(DAY)
    ).distinct()
    return ids.join(covered, [SERIES, DAY], "left_semi").distinct()


def reference_counts(
    requested: DataFrame, refs: DataFrame, window_days: int = fixed.MARKET_WINDOW_DAYS
) -> DataFrame:
    """Number, first and last id of the references of each requested day's window.

    References are counted per day first; the frame runs over days.
    """
    daily = refs.groupBy(SERIES, DAY).agg(
        F.count(F.lit(1)).alias("_n"), F.min("observation_id").alias("_first"),
        F.max("observation_id").alias("_last"),
    )
    days = requested.select(SERIES, DAY).distinct().withColumn("_asked", F.lit(True))
    frame = Window.partitionBy(SERIES).orderBy(F.unix_date(DAY)).rangeBetween(1 - window_days, 0)
    return days.join(daily, [SERIES, DAY], "full").select(
        SERIES, DAY, "_asked",
        F.coalesce(F.sum("_n").over(frame), F.lit(0)).alias("ref_count"),
        F.min("_first").over(frame).alias("first_ref"),
        F.max("_last").over(frame).alias("last_ref"),
    ).filter("_asked").drop("_asked")


def prefer_status(rows: DataFrame, keys: list[str], ranks: dict[str, int]) -> DataFrame:
    """One row per key: highest status rank, then smallest observation id.

    A grouped minimum of the ordering struct combines before the shuffle, so a key that repeats
    without end still sends one row per map task.
    """
    rank = F.lit(0)
    for status, value in ranks.items():
        rank = F.when(F.col("validation_status") == status, F.lit(value)).otherwise(rank)
    staged = rows.withColumn("_order", -rank)
    return first_per_key(staged, keys, ["_order", "observation_id"]).drop("_order")


def regional_weather(weather: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Equal-weight daily mean over regions after keeping the preferred row per region and day.

    ``regions_expected`` counts the expected regions (all regions seen when none are given).
    """
    rows = usable_rows(
        weather, expected, entity="region_id", statuses=fixed.WEATHER_USABLE_STATUSES
    ).filter(F.col("rainfall_mm").isNotNull())
    picked = prefer_status(rows, [SERIES, "region_id", DAY], fixed.STATUS_RANK)
    regions = expected if expected is not None else weather
    total = regions.agg(F.count_distinct("region_id")).scalar()
    return (
        picked.groupBy(SERIES, DAY)
        .agg(
            F.avg(F.col("rainfall_mm").cast("double")).alias("rainfall_mm"),
            F.avg(F.col("temperature_mean_c").cast("double")).alias("temperature_mean_c"),
            F.avg(F.col("relative_humidity_pct").cast("double")).alias("relative_humidity_pct"),
            F.count(F.lit(1)).alias("regions_reporting"),
        )
        .withColumn("regions_expected", total)
    )
