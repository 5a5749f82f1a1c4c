"""Source quality per day and data-quality snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import quality as Q
from tidemark.operators.basket import DAY, SERIES
from tidemark.operators.rolling import days_back


def daily_source(rows: DataFrame, entity: str, anomalies: list[DataFrame] | None = None) -> DataFrame:
    """Reporting entities, latest source time and unusable rows per (series, day).

    ``anomalies`` are further tables whose unusable rows count against the same source.
    """
    pending = ~F.col("validation_status").isin(*fixed.USABLE_STATUSES)
    base = rows.select(SERIES, DAY, F.col(entity).alias("_entity"), "observed_at",
                       pending.alias("_bad"))
    for other in anomalies or []:
        base = base.unionByName(
            other.filter(pending).select(SERIES, DAY, F.lit(True).alias("_bad")),
            allowMissingColumns=True,
        )
    # Per entity first, so that the distinct count sees one row per entity and day.
    per_entity = base.groupBy(SERIES, DAY, "_entity").agg(
        F.max("observed_at").alias("_seen"), F.count_if("_bad").alias("_bad_rows")
    )
    return per_entity.groupBy(SERIES, DAY).agg(
        F.count("_entity").alias("_reporting"),
        F.max("_seen").alias("_seen"),
        F.sum("_bad_rows").alias("_bad_rows"),
    )


def calendar_anchors(series: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every day from ``start`` to ``end`` (columns of ``series`` or literals) of each series."""
    return series.select(SERIES, F.explode(F.sequence(start, end)).alias(DAY))


def touched_anchors(
    changed: DataFrame, through: Column, window_days: int = fixed.QUALITY_WINDOW_DAYS
) -> DataFrame:
    """The (series, day) up to ``through`` whose window holds one of the changed (series, day)."""
    last = F.least(F.date_add(DAY, window_days - 1), through)
    days = changed.select(SERIES, DAY).distinct().filter(F.col(DAY) <= through)
    return days.select(SERIES, F.explode(F.sequence(F.col(DAY), last)).alias(DAY)).distinct()


def source_metrics(
    daily: DataFrame, expected: DataFrame, window_days: int = fixed.QUALITY_WINDOW_DAYS,
    now: Column | None = None, anchors: DataFrame | None = None,
) -> DataFrame:
    """Quality metrics of the window ending on each (series, day) of ``daily`` or ``anchors``.

    Every metric is a frame over daily counts: latest reporting day, days with data, latest source
    time and unusable rows. ``now`` defaults to the end of the day itself. Anchors are questions
    merged with the days on one timeline, so a silent day gets its row and nothing is multiplied:
    frames by value see the day's counts from either row.
    """
    total = expected.agg(F.count_distinct(*expected.columns)).scalar()
    frame = days_back(window_days - 1)
    asked = F.lit(True) if anchors is None else F.lit(False)
    line = daily.select(SERIES, DAY, "_reporting", "_seen", "_bad_rows", asked.alias("_asked"))
    if anchors is not None:
        questions = anchors.select(SERIES, DAY, F.lit(True).alias("_asked"))
        line = line.unionByName(questions, allowMissingColumns=True)
    has = F.col("_reporting") > 0
    cell = F.when(has, F.struct("_reporting", F.col(DAY).alias("_day")))
    staged = line.select(
        SERIES,
        DAY,
        "_asked",
        F.last(cell, ignorenulls=True).over(frame).alias("_latest"),
        F.count(cell).over(frame).alias("days_with_data"),
        F.max("_seen").over(frame).alias("latest_observed_at"),
        F.coalesce(F.sum("_bad_rows").over(frame), F.lit(0)).alias("anomaly_count"),
    ).filter("_asked").withColumn("expected", total)
    clock = now if now is not None else F.date_add(DAY, 1).cast("timestamp")
    whole = F.lit(window_days)
    reporting = F.coalesce("_latest._reporting", F.lit(0))
    return staged.select(
        SERIES,
        DAY,
        "expected",
        reporting.alias("reporting"),
        F.col("_latest._day").alias("latest_day"),
        "days_with_data",
        "latest_observed_at",
        "anomaly_count",
        Q.ratio(reporting, F.col("expected")).alias("coverage"),
        Q.ratio(F.col("days_with_data"), whole).alias("completeness"),
        Q.lag_hours(F.col("latest_observed_at"), clock).alias("lag_hours"),
    )


def scored(metrics: DataFrame) -> DataFrame:
    """Adds health class, score before blending and the proxy row count."""
    rows = F.greatest(
        F.col("days_with_data") * F.greatest("reporting", F.lit(1)), F.lit(1)
    )
    args = (F.col("coverage"), F.col("completeness"), F.col("lag_hours"))
    return metrics.select(
        "*",
        rows.alias("proxy_rows"),
        Q.health_class(*args, F.col("reporting") > 0).alias("health"),
        Q.quality_score(*args, F.col("anomaly_count"), rows).alias("score"),
    )


def quality_snapshots(market: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """One row per (series, day): market tier, optionally blended with the weather tier by day."""
    base = scored(market)
    if weather is None:
        joined = base.withColumn("weather_health", F.lit(None).cast("string"))
        overall = F.col("score")
    else:
        other = scored(weather).select(
            DAY,
            F.col("health").alias("weather_health"),
            F.col("score").alias("_weather_score"),
            F.col("reporting").alias("_weather_reporting"),
        )
        joined = base.join(other, DAY, "left")
        overall = Q.blended_score(
            F.col("score"), F.col("_weather_score"),
            F.coalesce("_weather_reporting", F.lit(0)),
        )
    return joined.select(
        SERIES,
        DAY,
        F.col("health").alias("market_health"),
        "weather_health",
        F.round("coverage", 4).alias("coverage_ratio"),
        F.round("completeness", 4).alias("completeness_ratio"),
        F.round("lag_hours", 2).alias("lag_hours"),
        "anomaly_count",
        overall.alias("overall_quality_score"),
        Q.score_penalty(overall).alias("confidence_penalty_factor"),
        F.lit(False).alias("futures_feed_ok"),
    )


def promotion_impact(metrics: DataFrame, validated: Column, rejected: Column) -> DataFrame:
    """Anomaly penalty and score before and after a promotion run."""
    base = scored(metrics)
    after = F.greatest(F.lit(0), F.col("anomaly_count") - validated) + rejected
    args = (F.col("coverage"), F.col("completeness"), F.col("lag_hours"))
    rows = F.col("proxy_rows")
    return base.select(
        SERIES,
        DAY,
        F.round(Q.anomaly_penalty(F.col("anomaly_count"), rows), 4).alias("penalty_before"),
        F.round(Q.anomaly_penalty(after, rows), 4).alias("penalty_after"),
        F.col("score").alias("score_before"),
        Q.quality_score(*args, after, rows).alias("score_after"),
    )


def signal_quality(
    signals: DataFrame, registries: DataFrame, snapshots: DataFrame, now: Column | None = None
) -> DataFrame:
    """Agent coverage, missing lists, freshness and confidence roll-up per day.

    ``signals`` has one row per (commodity, day, registry, agent) at most once the latest version
    is kept, so the collected map is bounded by the number of agents.
    """
    key = ["commodity_id", DAY, "registry_id"]
    grouped = signals.groupBy(*key).agg(
        F.array_sort(F.collect_set("agent_type")).alias("agents_present"),
        F.max("as_of_timestamp").alias("latest_as_of_timestamp"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.round(F.avg(F.col("confidence").cast("double")), 4).alias("mean_confidence"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("agent_type", F.col("confidence").cast("string"))))
        ).alias("confidence_by_agent"),
    )
    joined = grouped.join(
        registries.select("registry_id", "required_agents", "optional_agents"), "registry_id", "left"
    ).join(
        snapshots.select(*key, "snapshot_hash", F.col("signal_count").alias("_in_snapshot")),
        key,
        "left",
    )
    none = F.array().cast("array<string>")
    need, may = F.coalesce("required_agents", none), F.coalesce("optional_agents", none)
    have = F.col("agents_present")
    count = F.size(have).cast("long")
    hits = F.size(F.array_intersect(need, have))
    clock = now if now is not None else F.date_add(DAY, 1).cast("timestamp")
    lag = Q.lag_hours(F.col("latest_as_of_timestamp"), clock)
    return joined.select(
        *key,
        count.alias("signal_count"),
        F.col("_in_snapshot").isNotNull().alias("snapshot_present"),
        (F.coalesce("_in_snapshot", F.lit(-1)) == count).alias("snapshot_aligned"),
        Q.ratio(count, F.size(need) + F.size(may)).alias("coverage_ratio"),
        Q.ratio(hits, F.size(need)).alias("required_coverage_ratio"),
        F.array_except(need, have).alias("signals_missing"),
        F.array_except(may, have).alias("optional_agents_missing"),
        "agents_present",
        F.round(lag, 2).alias("signal_lag_hours"),
        Q.signal_freshness(lag, count > 0).alias("freshness"),
        "min_confidence",
        "max_confidence",
        "mean_confidence",
        "confidence_by_agent",
    )


def snapshot_rows(
    market: DataFrame, registries: DataFrame, weather: DataFrame | None = None,
    window_days: int = fixed.QUALITY_WINDOW_DAYS,
) -> DataFrame:
    """Stored quality snapshots: one row per (commodity, day, registry).

    ``market`` and ``weather`` are source metrics, the latter by day alone; ``registries`` holds the
    active (commodity_id, registry_id), and commodities without one get no snapshot.
    """
    base = scored(market)
    overall, health = F.col("score"), [F.col("health").alias(fixed.MARKET_SOURCE)]
    details = [_detail("markets", window_days).alias(f"{fixed.MARKET_SOURCE}_detail")]
    if weather is not None:
        other = scored(weather)
        own = {c: f"_w_{c}" for c in other.columns if c not in (SERIES, DAY)}
        base = base.join(other.drop(SERIES).withColumnsRenamed(own), DAY, "left")
        overall = Q.blended_score(
            F.col("score"), F.col("_w_score"), F.coalesce("_w_reporting", F.lit(0))
        )
        health.append(F.col("_w_health").alias("weather"))
        details.append(_detail("regions", window_days, "_w_").alias("weather_detail"))
    # A health that was not measured is left out of the document by to_json.
    named = base.withColumn("source_health", F.to_json(F.struct(*health, *details)))
    active = registries.select(F.col("commodity_id").alias(SERIES), "registry_id").distinct()
    return named.withColumn("_overall", overall).join(active, SERIES).select(
        F.col(SERIES).alias("commodity_id"),
        DAY,
        "registry_id",
        "source_health",
        F.col("_overall").alias("overall_quality_score"),
        F.round("lag_hours", 2).alias("lag_hours"),
        F.lit(False).alias("futures_feed_ok"),
        Q.score_penalty(F.col("_overall")).alias("confidence_penalty_factor"),
    )


def _detail(entities: str, window_days: int, mark: str = "") -> Column:
    col = lambda name: F.col(mark + name)
    there = F.struct(
        col("expected").alias(f"{entities}_expected"),
        col("reporting").alias(f"{entities}_reporting"),
        F.round(col("coverage"), 4).alias("coverage_ratio"),
        F.lit(window_days).alias("window_days"),
        col("days_with_data").alias("days_with_data"),
        F.round(col("completeness"), 4).alias("completeness_ratio"),
        col("latest_day").alias("latest_as_of_date"),
        col("anomaly_count").alias("anomaly_count"),
    )
    return F.when(col("expected").isNotNull(), there)
