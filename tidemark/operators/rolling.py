"""Rolling-window features over daily series.

Every window is partitioned by series and runs over daily rows, so a partition holds at most one
row per calendar day no matter how many raw observations the series has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import scores as S
from tidemark.operators.basket import DAY, SERIES


def days_back(first: int, last: int = 0, keys: tuple[str, ...] = (SERIES,)) -> WindowSpec:
    """Calendar frame from ``first`` days back to ``last`` days back (0 is the row's own day)."""
    return Window.partitionBy(*keys).orderBy(F.unix_date(DAY)).rangeBetween(-first, -last)


def with_rolling_z(df: DataFrame, value: str, frame: WindowSpec) -> DataFrame:
    """Adds ``_n`` and the population z-score ``_z`` of the row inside its frame (0 without variance).

    Window results are named once and combined afterwards; repeating a window expression inside a
    formula would evaluate it again.
    """
    x = F.col(value).cast("double")
    staged = df.select(
        "*",
        F.count(x).over(frame).alias("_n"),
        F.avg(x).over(frame).alias("_mean"),
        F.stddev_pop(x).over(frame).alias("_deviation"),
    )
    scored = (F.col("_n") >= 2) & (F.col("_deviation") > 0)
    z = F.when(scored, (x - F.col("_mean")) / F.col("_deviation")).otherwise(F.lit(0.0))
    return staged.select(*df.columns, "_n", S.exact(z).alias("_z"))


def price_momentum(basket: DataFrame, window_days: int = fixed.MARKET_WINDOW_DAYS) -> DataFrame:
    """Adds the momentum columns to a daily frame; days with a NULL level get the neutral row."""
    frame = days_back(window_days - 1)
    staged = with_rolling_z(basket, "level", frame)
    known = (F.col("_n") >= 2) & F.col("level").isNotNull()
    z = F.when(known, F.col("_z")).otherwise(S.dec(0))
    return staged.select(
        *basket.columns,
        z.alias("momentum_raw"),
        S.band_direction(z, fixed.MARKET_BAND).alias("momentum_direction"),
        S.z_magnitude(z).alias("momentum_magnitude"),
        F.when(~known, S.dec(0))
        .when(F.col("_n") >= 7, S.dec(1))
        .otherwise(S.dec("0.5"))
        .alias("momentum_confidence"),
    )


def arrival_momentum(totals: DataFrame, window_days: int = fixed.MARKET_WINDOW_DAYS) -> DataFrame:
    """As price momentum, with inverted direction and strength gated to the arrival season."""
    frame = days_back(window_days - 1)
    staged = with_rolling_z(totals, "volume", frame)
    known = F.col("_n") >= 2
    gate = S.season_gate(F.col(DAY))
    z = F.when(known, F.col("_z")).otherwise(S.dec(0))
    return staged.select(
        *totals.columns,
        z.alias("arrival_raw"),
        S.band_direction(z, fixed.MARKET_BAND, invert=True).alias("arrival_direction"),
        S.clip_unit(S.z_magnitude(z) * gate).alias("arrival_magnitude"),
        F.when(~known, S.dec(0))
        .when(F.col("_n") >= 7, gate)
        .otherwise(S.exact(gate * S.dec("0.5")))
        .alias("arrival_confidence"),
    )


def with_change_z(
    df: DataFrame, change: str, present: Column, frame: WindowSpec, lead_in: int
) -> DataFrame:
    """Adds ``_z``, the last change of the frame scored against the frame's own changes, and ``_n``.

    Rows where ``present`` is false are calendar marks without a value. The first ``lead_in``
    present rows of a frame have no change inside it (their predecessors lie before the frame), so
    they are taken out of the sums. Changes are whole ten-thousandths: integer sums make zero
    variance exact and need no array per row.
    """
    ticks = F.col(change)
    cell = F.when(present, F.struct(ticks.alias("ticks")))
    heads = [
        F.nth_value(cell, i, ignoreNulls=True).over(frame).alias(f"_head{i}")
        for i in range(1, lead_in + 1)
    ]
    staged = df.select(
        "*",
        F.count(cell).over(frame).alias("_cells"),
        F.sum(ticks).over(frame).alias("_sum"),
        F.sum(ticks * ticks).over(frame).alias("_squares"),
        F.last(cell, ignorenulls=True).over(frame).alias("_last"),
        *heads,
    )
    total, squares = F.coalesce("_sum", F.lit(0)), F.coalesce("_squares", F.lit(0))
    for i in range(1, lead_in + 1):
        head = F.coalesce(F.col(f"_head{i}.ticks"), F.lit(0))
        total, squares = total - head, squares - head * head
    sums = staged.select(
        *df.columns,
        (F.col("_cells") - lead_in).alias("_n"),
        F.col("_last.ticks").alias("_tick"),
        total.alias("_total"),
        squares.alias("_square_total"),
    )
    n, total = F.col("_n"), F.col("_total")
    spread = n * F.col("_square_total") - total * total
    z = F.when(
        (n >= 2) & (spread > 0), (n * F.col("_tick") - total) / F.sqrt(spread.cast("double"))
    ).otherwise(F.lit(0.0))
    return sums.select(*df.columns, "_n", S.exact(z).alias("_z"))


def _ticks(x: Column) -> Column:
    """Four-place change as a count of ten-thousandths."""
    return F.round(F.round(x, 4) * 10000, 0).cast("long")


def price_acceleration(basket: DataFrame, window_days: int = fixed.MARKET_WINDOW_DAYS) -> DataFrame:
    """Change of the relative daily change, scored against the frame's own accelerations."""
    earlier = (
        Window.partitionBy(SERIES)
        .orderBy(F.unix_date(DAY))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.last("level", ignorenulls=True).over(earlier)
    change = _ticks(F.when(before == 0, F.lit(0.0)).otherwise((F.col("level") - before) / before))
    staged = (
        basket.withColumn("_change", change)
        .withColumn(
            "_accel",
            F.col("_change") - F.last("_change", ignorenulls=True).over(earlier),
        )
    )
    present = F.col("level").isNotNull()
    scored = with_change_z(staged, "_accel", present, days_back(window_days - 1), lead_in=2)
    known = (F.col("_n") >= 1) & F.col("level").isNotNull()
    raw = (
        F.when(~known, S.dec(0))
        .when(F.col("_n") >= 2, F.col("_z"))
        .otherwise(S.exact(F.col("_accel") / F.lit(10000.0)))
    )
    return scored.select(
        *basket.columns,
        raw.alias("acceleration_raw"),
        S.band_direction(raw, fixed.MARKET_BAND).alias("acceleration_direction"),
        S.z_magnitude(raw).alias("acceleration_magnitude"),
        F.when(~known, S.dec(0))
        .when(F.col("_n") >= 5, S.dec(1))
        .otherwise(S.dec("0.5"))
        .alias("acceleration_confidence"),
    )


def open_interest_change(
    history: DataFrame, marks: DataFrame, window_days: int = fixed.FUTURES_WINDOW_DAYS
) -> DataFrame:
    """z of the latest relative open-interest change and latest value, per marked day.

    ``history`` has one row per (series, expiry, day) with a known open interest; ``marks`` are
    the (series, expiry, day) rows to answer. A marked day without a value of its own takes the
    last session of its frame.
    """
    keys = (SERIES, "expiry_date")
    order = Window.partitionBy(*keys).orderBy(F.unix_date(DAY))
    prior = F.lag("open_interest").over(order)
    change = F.when(prior.isNull(), F.lit(None)).when(prior <= 0, F.lit(0.0)).otherwise(
        (F.col("open_interest") - prior) / prior
    )
    timeline = history.withColumn("_change", _ticks(change)).join(
        marks.select(*keys, DAY).distinct().withColumn("_mark", F.lit(True)),
        [*keys, DAY],
        "full",
    )
    frame = days_back(window_days, keys=keys)
    known = F.col("open_interest").isNotNull()
    latest = F.last("open_interest", ignorenulls=True).over(frame)
    timeline = timeline.withColumn("latest_open_interest", latest)
    return (
        with_change_z(timeline, "_change", known, frame, lead_in=1)
        .filter("_mark")
        .select(
            *keys,
            DAY,
            F.col("_z").alias("open_interest_z"),
            (F.col("_n") + 1).alias("sessions"),
            "latest_open_interest",
        )
    )


def rainfall_features(daily: DataFrame) -> DataFrame:
    """Deviation, shock, temperature stress and harvest risk of each regional day."""
    rain = F.col("rainfall_mm")
    recent, norm = F.avg(rain).over(days_back(29)), F.avg(rain).over(days_back(59, 30))
    week_before = F.avg(rain).over(days_back(7, 1))
    week_sum = F.sum(rain).over(days_back(6))
    floor = F.lit(float(fixed.SHOCK_FLOOR_MM))
    staged = daily.select(
        "*",
        recent.alias("_recent"),
        norm.alias("_norm"),
        week_before.alias("_prior"),
        week_sum.alias("_week"),
    )
    deviation = F.when(F.col("_norm").isNull(), S.dec(0)).otherwise(
        S.clip_signed(
            (F.col("_recent") - F.col("_norm"))
            / F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(F.lit(1.0))
        )
    )
    shock = F.when(F.col("_prior").isNull(), S.dec(0)).otherwise(
        S.clip_unit(F.abs(rain - F.col("_prior")) / F.greatest(F.col("_prior"), floor))
    )
    return staged.select(
        *daily.columns,
        deviation.alias("rainfall_deviation"),
        shock.alias("rainfall_shock"),
        temperature_stress(F.col("temperature_mean_c")).alias("temperature_stress"),
        harvest_risk(F.col("_week"), F.col("relative_humidity_pct"), F.col(DAY)).alias(
            "harvest_risk_indicator"
        ),
        stage_weight(F.col(DAY)).alias("stage_weight"),
    )


def temperature_stress(mean_c: Column) -> Column:
    gap = F.abs(mean_c - float(fixed.OPTIMAL_TEMPERATURE)) / float(fixed.TEMPERATURE_BAND)
    return F.coalesce(S.clip_unit(gap), S.dec(0))


def harvest_risk(week_rain: Column, humidity: Column, day: Column) -> Column:
    """Weekly rain and humidity excess; damped outside the harvest and storage months."""
    rain_part = F.coalesce(S.clip_unit(week_rain / float(fixed.HARVEST_RAIN_MM)), S.dec(0))
    humid_part = F.coalesce(S.clip_unit((humidity - 50.0) / 40.0), S.dec(0))
    base = S.exact(S.dec("0.6") * rain_part + S.dec("0.4") * humid_part)
    in_season = S.month_in(day, sorted({*fixed.HARVEST_MONTHS, *fixed.STORAGE_MONTHS}))
    return F.when(in_season, S.clip_unit(base)).otherwise(S.clip_unit(base * S.dec(fixed.STAGE_LOW)))


def stage_weight(day: Column) -> Column:
    return (
        F.when(S.month_in(day, fixed.HARVEST_MONTHS + fixed.GROWTH_MONTHS), S.dec(fixed.STAGE_HIGH))
        .when(S.month_in(day, fixed.SOWING_MONTHS + fixed.STORAGE_MONTHS), S.dec(fixed.STAGE_MEDIUM))
        .otherwise(S.dec(fixed.STAGE_LOW))
    )
