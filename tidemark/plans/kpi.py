"""Forecast quality: KPIs per horizon, regression metrics, handoff rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed


def horizon_kpis(
    pairs: DataFrame, horizons: tuple[int, ...] = fixed.HORIZONS, keys: list[str] | None = None
) -> DataFrame:
    """MAE, RMSE, MAPE (near-zero actuals left out) and band coverage per horizon.

    Horizons without pairs keep a row with no samples and NULL metrics.
    """
    keys = keys or []
    error = F.col("predicted") - F.col("actual")
    banded = F.col("band_low").isNotNull() & F.col("band_high").isNotNull()
    inside = F.col("actual").between(F.col("band_low"), F.col("band_high"))
    measured = pairs.groupBy(*keys, "horizon_days").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.abs(error)).alias("_mae"),
        F.sqrt(F.avg(error * error)).alias("_rmse"),
        F.avg(
            F.when(
                F.abs(F.col("actual")) >= fixed.MAPE_EPSILON,
                F.abs(error / F.col("actual")) * 100.0,
            )
        ).alias("_mape"),
        F.avg(F.when(banded, inside.cast("double"))).alias("_coverage"),
    )
    wanted = F.explode(F.array(*[F.lit(h).cast("long") for h in horizons])).alias("horizon_days")
    groups = pairs.select(*keys).distinct() if keys else pairs.sparkSession.range(1)
    frame = groups.select(*keys, wanted)
    return frame.join(measured, [*keys, "horizon_days"], "left").select(
        *keys,
        "horizon_days",
        F.coalesce("_n", F.lit(0)).alias("sample_count"),
        F.round("_mae", 4).alias("mae"),
        F.round("_rmse", 4).alias("rmse"),
        F.round("_mape", 4).alias("mape"),
        F.round("_coverage", 4).alias("coverage"),
    )


def regression_metrics(
    rows: DataFrame, keys: list[str], truth: str = "y", guess: str = "prediction",
    distinct: dict[str, str] | None = None,
) -> DataFrame:
    """MAE, RMSE and MAPE with the denominator held away from zero.

    ``distinct`` maps new columns to columns whose different values are counted beside them.
    """
    error = F.col(guess) - F.col(truth)
    floor = F.greatest(F.abs(F.col(truth)), F.lit(fixed.MAPE_EPSILON))
    return rows.groupBy(*keys).agg(
        F.round(F.avg(F.abs(error)), 6).alias("mae"),
        F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"),
        F.round(F.avg(F.abs(error) / floor) * 100.0, 6).alias("mape_pct"),
        F.count(F.lit(1)).alias("n_samples"),
        *[F.count_distinct(c).alias(name) for name, c in (distinct or {}).items()],
    )


def beats_naive(results: DataFrame, keys: list[str], metric: str = "rmse") -> DataFrame:
    """Does any model score strictly below naive persistence?"""
    naive = F.col("model_name") == fixed.NAIVE
    best = F.min(F.when(~naive, F.col(metric)))
    base = F.max(F.when(naive, F.col(metric)))
    return results.groupBy(*keys).agg(F.coalesce(best < base, F.lit(False)).alias("beats_naive"))


def model_version(model: Column, mode: Column, seed: int = fixed.MODEL_SEED) -> Column:
    return F.concat(model, F.lit(fixed.MODEL_VERSION_MARK), mode, F.lit(f"-seed{seed}"))


def quality_rows(kpis: DataFrame, identity: dict[str, Column]) -> DataFrame:
    """Rows to upsert: horizons with samples, keyed by the identity columns."""
    return kpis.filter(F.col("sample_count") > 0).select(
        *[col.alias(name) for name, col in identity.items()], *kpis.columns
    )


def handoff(metrics: DataFrame, identity: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Registry rows and quality rows from one set of evaluation metrics."""
    version = model_version(F.col("model_name"), F.col("mode"))
    ids = [col.alias(name) for name, col in identity.items()]
    registry = metrics.select(
        *ids,
        version.alias("model_version"),
        "model_name",
        "horizon_days",
        F.create_map(
            F.lit("mae"), F.col("mae"), F.lit("rmse"), F.col("rmse"),
            F.lit("mape"), F.col("mape_pct"),
        ).alias("metrics"),
    )
    quality = metrics.select(
        *ids,
        version.alias("model_version"),
        "horizon_days",
        F.col("n_samples").alias("sample_count"),
        F.col("mae"),
        F.col("rmse"),
        F.col("mape_pct").alias("mape"),
        F.lit(None).cast("double").alias("coverage"),
    ).filter(F.col("sample_count") > 0)
    return registry, quality
