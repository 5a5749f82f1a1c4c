"""Weather signal of every series and day in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import dates, weather
from tidemark.functions import scores as S
from tidemark.operators import basket as B
from tidemark.operators import rolling


def weather_signal(observations: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Regional roll-up, rolling features and composite; days without usable rows are absent."""
    daily = B.regional_weather(observations, expected)
    return score_weather(rolling.rainfall_features(daily))


def score_weather(features: DataFrame) -> DataFrame:
    day = F.col(B.DAY)
    row = {name: F.col(name) for name in weather.COMPONENTS}
    scores = weather.weighted_scores(row, F.col("stage_weight"))
    coverage = F.col("regions_reporting") / F.col("regions_expected")
    staged = features.select(
        "*",
        S.top_component(scores).alias("primary_driver"),
        weather.top_score(scores).alias("_top"),
    )
    scored = staged.select(
        "*",
        weather.direction(F.col("primary_driver"), F.col("_top"), row, day).alias("direction"),
        S.clip_unit(F.col("_top")).alias("magnitude"),
        S.clip_unit(coverage * float(fixed.WEATHER_CONFIDENCE_BASE)).alias("confidence"),
    ).drop("_top")
    return scored.select(
        "*",
        S.signed_value(F.col("direction"), F.col("magnitude")).alias("value"),
        dates.at_time(day, dates.WEATHER_NOON).alias("as_of_timestamp"),
    )


def components() -> Column:
    names = [*weather.COMPONENTS, "primary_driver", "regions_reporting", "regions_expected",
             "stage_weight"]
    pairs: list[Column] = []
    for name in names:
        pairs += [F.lit(name), F.col(name).cast("string")]
    return F.create_map(*pairs)
