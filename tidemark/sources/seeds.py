"""Seed documents to dimension tables and policy events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed, schemas
from tidemark.operators.dedupe import POLICY_KEY, new_rows
from tidemark.operators.mapping import observation_id


def seed_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SEED_DOCUMENT).option("multiLine", True).json(path)


def seed_tables(document: DataFrame) -> dict[str, DataFrame]:
    """Commodity, profile, region, market and registry rows of seed documents."""
    commodity = F.col("commodity.commodity_id").alias("commodity_id")
    return {
        "commodity": document.select("commodity.*").withColumn(
            "status", F.coalesce("status", F.lit("active"))
        ),
        "commodity_profile": document.select(commodity, "commodity_profile.*")
        .withColumn("unit", F.coalesce("unit", F.lit(fixed.UNIT)))
        .withColumn("currency", F.coalesce("currency", F.lit(fixed.CURRENCY))),
        "region": document.select(commodity, F.explode("regions").alias("r")).select(
            "r.*", "commodity_id"
        ),
        "market": document.select(commodity, F.explode("markets").alias("m")).select(
            "m.*", "commodity_id"
        ),
        "registry": document.select(commodity, "registry.*").select(
            F.sha2(F.concat_ws("|", "commodity_id", "version"), 256).alias("registry_id"),
            "commodity_id",
            "version",
            "effective_from",
            F.lit(None).cast("date").alias("effective_to"),
            F.coalesce("is_active", F.lit(False)).alias("is_active"),
            "required_agents",
            "optional_agents",
            "signal_weights",
            "decision_rules",
            F.coalesce(
                "forecast_horizons", F.array(*[F.lit(h) for h in fixed.HORIZONS])
            ).alias("forecast_horizons"),
            "regime_priority",
        ),
    }


def identifiers(source: str = fixed.MARKET_SOURCE) -> Column:
    return F.col(f"source_identifiers.{source}")


def expected_markets(markets: DataFrame, source: str = fixed.MARKET_SOURCE) -> DataFrame:
    """Markets that the source can report, with their lookup key."""
    known = markets.filter(identifiers(source).isNotNull())
    return known.select("market_id", "region_id", F.col(f"source_identifiers.{source}.*"))


def expected_states(markets: DataFrame, source: str = fixed.MARKET_SOURCE) -> DataFrame:
    """Distinct states the source covers, in order."""
    states = expected_markets(markets, source).select("state").distinct()
    return states.filter(F.col("state").isNotNull()).orderBy("state")


def policy_events(spark: SparkSession, path: str) -> DataFrame:
    document = spark.read.schema(schemas.POLICY_DOCUMENT).option("multiLine", True).json(path)
    rows = document.select("commodity_id", F.explode("observations").alias("o")).select(
        "commodity_id", "o.*"
    )
    return rows.select(
        "commodity_id", "policy_type", "source", "published_date", "effective_date",
        "impact_direction", F.col("confidence").try_cast("decimal(5,4)").alias("confidence"),
        "summary",
        F.coalesce("provenance", F.create_map().cast("map<string,string>")).alias("provenance"),
        F.lit(fixed.VALIDATED).alias("validation_status"),
    ).withColumn("observation_id", observation_id(POLICY_KEY))


def new_policy_events(events: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """First event by ``order`` of each business key that is not stored.

    A missing summary equals an empty one.
    """
    keyed = lambda df: df.withColumn("summary", F.coalesce("summary", F.lit("")))
    key = F.coalesce("summary", F.lit(""))
    fresh = events.withColumn("_summary", F.col("summary")).withColumn("summary", key)
    kept = new_rows(fresh, keyed(stored), POLICY_KEY, order)
    return kept.withColumn("summary", F.col("_summary")).drop("_summary").select(*events.columns)
