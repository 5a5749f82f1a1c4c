"""Signal effectiveness: evaluable days, forward returns and correlations per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import scores as S
from tidemark.operators import basket as B
from tidemark.operators import rolling
from tidemark.operators.basket import DAY, SERIES
from tidemark.operators.forward import first_on_or_after
from tidemark.operators.ranks import windowed_average_rank


def evaluable(basket: DataFrame) -> DataFrame:
    """Days with 29 days behind them and 30 ahead inside the observed span."""
    whole = Window.partitionBy(SERIES)
    span = basket.select(
        "*", F.min(DAY).over(whole).alias("_first"), F.max(DAY).over(whole).alias("_last")
    )
    ahead = max(fixed.FORWARD_HORIZONS)
    inside = (F.date_sub(DAY, fixed.MARKET_WINDOW_DAYS - 1) >= F.col("_first")) & (
        F.date_add(DAY, ahead) <= F.col("_last")
    )
    return span.filter(inside).drop("_first", "_last")


def forward_returns(basket: DataFrame) -> DataFrame:
    """Percent change to the first level on or after each forward horizon, one column each."""
    ahead = first_on_or_after(basket)
    wide = ahead.groupBy(SERIES, DAY).agg(
        *[
            F.max(F.when(F.col("horizon_days") == h, F.col("forward_level"))).alias(f"_f{h}")
            for h in fixed.FORWARD_HORIZONS
        ]
    )
    joined = basket.select(SERIES, DAY, "level").join(wide, [SERIES, DAY])
    return joined.select(
        SERIES,
        DAY,
        "level",
        *[
            S.percent_return(F.col("level"), F.col(f"_f{h}")).alias(f"forward_return_{h}d")
            for h in fixed.FORWARD_HORIZONS
        ],
    )


def daily_panel(
    prices: DataFrame, arrivals: DataFrame, weather: DataFrame, expected: DataFrame,
    regions: DataFrame | None = None,
) -> DataFrame:
    """Four tracked signals and forward returns of every evaluable day.

    Weather is read by day: one belt serves every series.
    """
    prices = B.usable_rows(prices, expected, price_type=fixed.MODAL)
    level = B.price_basket(prices)
    momentum = evaluable(rolling.price_momentum(level)).select(
        SERIES, DAY, F.col("momentum_raw").cast("double").alias("price_momentum")
    )
    volume = rolling.arrival_momentum(B.arrival_totals(B.usable_rows(arrivals, expected)))
    belt = rolling.rainfall_features(B.regional_weather(weather, regions)).select(
        DAY,
        F.col("rainfall_shock").cast("double").alias("rainfall_shock"),
        F.col("temperature_stress").cast("double").alias("temperature_stress"),
    )
    return (
        momentum.join(
            volume.select(SERIES, DAY, F.col("arrival_raw").cast("double").alias("_arrival")),
            [SERIES, DAY],
            "left",
        )
        .join(belt, DAY, "left")
        .join(forward_returns(level), [SERIES, DAY])
        .select(
            SERIES,
            DAY,
            "price_momentum",
            F.coalesce("_arrival", F.lit(0.0)).alias("arrival_momentum"),
            "rainfall_shock",
            "temperature_stress",
            F.col("level").alias("basket_modal"),
            *[f"forward_return_{h}d" for h in fixed.FORWARD_HORIZONS],
        )
    )


def long_pairs(panel: DataFrame) -> DataFrame:
    """(series, signal, horizon, signal value, forward return), both finite."""
    signals = panel.unpivot(
        [SERIES, DAY, *[f"forward_return_{h}d" for h in fixed.FORWARD_HORIZONS]],
        list(fixed.TRACKED_SIGNALS),
        "signal",
        "signal_value",
    )
    pairs = signals.unpivot(
        [SERIES, DAY, "signal", "signal_value"],
        [f"forward_return_{h}d" for h in fixed.FORWARD_HORIZONS],
        "_horizon",
        "forward_return",
    )
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return pairs.filter(finite("signal_value") & finite("forward_return")).select(
        SERIES,
        "signal",
        F.regexp_extract("_horizon", r"(\d+)", 1).cast("int").alias("horizon_days"),
        "signal_value",
        "forward_return",
    )


def guarded_corr(x: str, y: str) -> Column:
    """Pearson r from three pairs on, NULL when either side does not vary."""
    enough = (F.count(F.lit(1)) >= fixed.MIN_PAIRS) & (F.stddev(x) > 0) & (F.stddev(y) > 0)
    return F.when(enough, F.corr(x, y))


def correlations(pairs: DataFrame) -> DataFrame:
    """Pearson and Spearman per (series, signal, horizon).

    Ranks are windows over one series' days; pairs never mix series.
    """
    keys = [SERIES, "signal", "horizon_days"]
    ranked = pairs.select(
        *keys,
        "signal_value",
        "forward_return",
        windowed_average_rank("signal_value", keys).alias("_rx"),
        windowed_average_rank("forward_return", keys).alias("_ry"),
    )
    return ranked.groupBy(*keys).agg(
        guarded_corr("signal_value", "forward_return").alias("pearson_r"),
        guarded_corr("_rx", "_ry").alias("spearman_rho"),
        F.count(F.lit(1)).alias("sample_size"),
        F.avg("signal_value").alias("mean_signal"),
        F.avg("forward_return").alias("mean_forward_return"),
    )


def best_and_worst(results: DataFrame, horizon_days: int = 30) -> DataFrame:
    """Signals with the largest and smallest (|r|, r) per series; Pearson, else Spearman."""
    r = F.coalesce("pearson_r", "spearman_rho")
    scoped = results.filter((F.col("horizon_days") == horizon_days) & r.isNotNull())
    rank = F.struct(F.abs(r), r)
    return scoped.groupBy(SERIES).agg(
        F.max_by("signal", rank).alias("best_signal"), F.min_by("signal", rank).alias("worst_signal")
    )


def panel_summary(panel: DataFrame) -> DataFrame:
    """Evaluable days, filled cells and date bounds per series."""
    cells = [*fixed.TRACKED_SIGNALS, *[f"forward_return_{h}d" for h in fixed.FORWARD_HORIZONS]]
    return panel.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("evaluable_days"),
        *[F.count(c).alias(f"n_{c}") for c in cells],
        F.min(DAY).alias("date_min"),
        F.max(DAY).alias("date_max"),
    )


def sufficient_series(prices: DataFrame, panel: DataFrame) -> DataFrame:
    """Series with enough validated prices and evaluable days for the study."""
    enough = (
        prices.filter(F.col("validation_status").isin(*fixed.USABLE_STATUSES))
        .groupBy(SERIES)
        .agg(F.count(F.lit(1)).alias("validated_prices"))
        .filter(F.col("validated_prices") >= fixed.MIN_VALIDATED_PRICES)
    )
    days = (
        panel.groupBy(SERIES)
        .agg(F.count(F.lit(1)).alias("evaluable_days"))
        .filter(F.col("evaluable_days") >= fixed.MIN_EVALUABLE_DAYS)
    )
    return enough.join(days, SERIES)
