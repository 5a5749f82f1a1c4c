"""Snapshots of the engine's own market, weather and futures signals, with their provenance.

The three signals of a (commodity, day) become agent rows with their component maps, and one hashed
snapshot. A signal rests on all observations of its window; the snapshot states them as a count and
an order-free digest, so millions of references need no list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators.basket import DAY, SERIES, price_basket, usable_rows
from tidemark.plans import futures_signal as futures
from tidemark.plans import market_signal as market
from tidemark.plans import snapshots
from tidemark.plans import weather_signal as weather
from tidemark.session import cut_lineage

MARKET, WEATHER, FUTURES = "Market", "Weather", "Futures"


def reference_digests(
    tables: dict[str, DataFrame], window_days: int = fixed.MARKET_WINDOW_DAYS
) -> DataFrame:
    """``ref_count`` and ``ref_digest`` of the window up to each (series, day) with observations.

    ``tables`` maps a kind to observations; a reference is (kind, observation_id), and ids are
    unique within a kind. Each reference is a number from its md5; the numbers are summed by day in
    the map tasks. A window's sum is the difference of two running sums over days, so neither the
    order of rows nor the length of the window matters. Sums have 38 digits.
    """
    rows = None
    for kind, table in tables.items():
        part = table.select(SERIES, DAY, F.concat(F.lit(f"{kind}:"), F.col("observation_id").cast("string")).alias("_ref"))
        rows = part if rows is None else rows.unionByName(part)
    number = F.conv(F.substring(F.md5("_ref"), 1, 15), 16, 10).cast("decimal(20,0)")
    daily = rows.groupBy(SERIES, DAY).agg(F.count(F.lit(1)).alias("_n"), F.sum(number).alias("_sum"))
    at = F.unix_date(DAY)
    upto = Window.partitionBy(SERIES).orderBy(at)
    running = daily.select(
        SERIES, DAY,
        F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias("_n"),
        F.sum("_sum").over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"),
    )
    before = upto.rangeBetween(Window.unboundedPreceding, -window_days)
    left = running.select(
        "*", F.coalesce(F.last("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.last("_sum").over(before), F.lit(0)).alias("_sum0"),
    )
    return left.select(
        SERIES, DAY, (F.col("_n") - F.col("_n0")).alias("ref_count"),
        (F.col("_sum") - F.col("_sum0")).cast("string").alias("ref_digest"),
    )


def agent_rows(signal: DataFrame, agent: str, components: Column, refs: DataFrame | None = None) -> DataFrame:
    """A signal's (series, day) rows in the shape of stored agent signals.

    Components that are NULL are left out; with ``refs`` the provenance joins them.
    """
    pairs = components
    rows = signal
    if refs is not None:
        rows = rows.join(refs.select(SERIES, DAY, "ref_count", "ref_digest"), [SERIES, DAY], "left")
        pairs = F.map_concat(components, F.create_map(
            F.lit("reference_count"), F.coalesce("ref_count", F.lit(0)).cast("string"),
            F.lit("reference_digest"), F.coalesce("ref_digest", F.lit("0")),
        ))
    return rows.select(
        F.col(SERIES).alias("commodity_id"), DAY, F.lit(agent).alias("agent_type"), "direction",
        F.col("magnitude").cast("decimal(5,4)").alias("magnitude"),
        F.col("confidence").cast("decimal(5,4)").alias("confidence"),
        F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("signal_components"), "as_of_timestamp",
    )


def combined_signals(
    prices: DataFrame, arrivals: DataFrame, expected: DataFrame, rules: DataFrame | None,
    observations: DataFrame, contracts: DataFrame, registries: DataFrame, belts: DataFrame,
) -> DataFrame:
    """Agent rows of all three signals for every (series, day) with a market signal.

    ``belts`` maps a series to its weather series; a weather row counts for all series of its belt.
    Futures give a neutral row where there is no curve, weather gives none without observations.
    ``registries`` holds the active (commodity_id, registry_id).
    """
    own = market.market_signal(prices, arrivals, expected, rules)
    refs = reference_digests({
        "price": usable_rows(prices, expected), "arrival": usable_rows(arrivals, expected)
    })
    # Each signal's daily rows are checkpointed: the days of the market signal are asked of the others,
    # and plans of that depth would otherwise be planned and run again with every use.
    rows = cut_lineage(agent_rows(own, MARKET, market.components(own), refs))
    days = rows.select(F.col("commodity_id").alias(SERIES), DAY)
    curve = futures.futures_signal(contracts, price_basket(usable_rows(prices)), requested=days)
    rows = rows.unionByName(cut_lineage(agent_rows(curve, FUTURES, futures.components())))
    sky = weather.weather_signal(observations)
    seen = usable_rows(observations, entity="region_id", statuses=fixed.WEATHER_USABLE_STATUSES)
    belt = cut_lineage(agent_rows(sky, WEATHER, weather.components(), reference_digests({"weather": seen})))
    shared = belt.withColumnRenamed("commodity_id", "weather_series").join(
        belts.select(F.col(SERIES).alias("commodity_id"), "weather_series"), "weather_series"
    )
    asked = days.withColumnRenamed(SERIES, "commodity_id")
    rows = rows.unionByName(shared.drop("weather_series").join(asked, ["commodity_id", DAY], "left_semi"))
    return rows.join(registries.select("commodity_id", "registry_id").distinct(), "commodity_id")


def combined_snapshots(signals: DataFrame) -> DataFrame:
    """One hashed snapshot per (commodity, day, registry) of the rows of ``combined_signals``."""
    return snapshots.snapshots(signals)
