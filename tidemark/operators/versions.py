"""Versioned dimensions, append-only registries and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.canonical import row_digest
from tidemark.operators.dedupe import new_rows
from tidemark.operators.validation import MODEL_REGISTRY, constraints, registry_rules

MODEL_KEY = [
    "commodity_id", "registry_id", "model_version", "training_window_start",
    "training_window_end", "feature_set_hash",
]


def add_versions(registry: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Valid new versions appended as inactive; known (commodity, version) pairs are left alone.

    Of a pair that the batch repeats, the first row by ``order`` counts.
    """
    good, _ = constraints(incoming, registry_rules())
    fresh = new_rows(good, registry, ["commodity_id", "version"], order)
    return registry.unionByName(fresh.withColumn("is_active", F.lit(False)))


def activate(registry: DataFrame, targets: DataFrame, prior_end: Column) -> DataFrame:
    """Flag the target version per commodity and close the one it replaces.

    ``targets`` holds (commodity_id, target_id), one row per commodity to switch.
    """
    joined = registry.join(targets.select("commodity_id", "target_id"), "commodity_id", "left")
    switched = F.col("target_id").isNotNull()
    chosen = F.col("registry_id") == F.col("target_id")
    replaced = switched & F.col("is_active") & ~chosen
    columns = [
        F.when(switched, chosen).otherwise(F.col("is_active")).alias("is_active")
        if c == "is_active"
        else F.when(replaced, prior_end).otherwise(F.col("effective_to")).alias("effective_to")
        if c == "effective_to"
        else F.col(c)
        for c in registry.columns
    ]
    return joined.select(*columns)


def active_versions(registry: DataFrame) -> DataFrame:
    return registry.filter("is_active")


def required_agents(registry: DataFrame, commodities: DataFrame) -> DataFrame:
    """Required agents of the active version; empty where there is none."""
    active = active_versions(registry).select("commodity_id", "required_agents")
    return (
        commodities.select("commodity_id")
        .distinct()
        .join(active, "commodity_id", "left")
        .select(
            "commodity_id",
            F.coalesce("required_agents", F.array().cast("array<string>")).alias("required_agents"),
        )
    )


def register_models(registry: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Valid incoming models whose unique key is new, the first of each by ``order``: rows to append."""
    good, _ = constraints(incoming, MODEL_REGISTRY())
    return new_rows(good, registry, MODEL_KEY, order)


def resolve_model(registry: DataFrame, **key: object) -> DataFrame:
    out = registry
    for name, value in key.items():
        out = out.filter(F.col(name) == F.lit(value))
    return out


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that vanished or whose content differs; empty for an append-only table."""
    columns = [c for c in before.columns if c not in keys]
    old = before.select(*keys, row_digest(columns).alias("_old"))
    new = after.select(*keys, row_digest(columns).alias("_new"))
    both = old.join(new, keys, "full")
    kind = F.when(F.col("_new").isNull(), "vanished").when(
        F.col("_old") != F.col("_new"), "changed"
    )
    return both.select(*keys, kind.alias("violation")).filter(F.col("violation").isNotNull())
