"""Signal snapshots: normalised agent rows per day with a content hash, and flat features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import canonical as J
from tidemark.operators.dedupe import latest_per_key
from tidemark.operators.validation import SIGNAL, constraints

KEY = ["commodity_id", "as_of_date", "registry_id"]
_ALTERNATIVES = {
    "agent_type": ("signal_type", "agent_type"),
    "direction": ("signal_direction", "direction"),
    "magnitude": ("signal_magnitude", "magnitude"),
    "confidence": ("signal_confidence", "confidence"),
    "signal_components": ("signal_inputs", "signal_components"),
}


def normalise(payloads: DataFrame) -> DataFrame:
    """Either key style to one set of columns; the first style wins where both are present."""
    merged = {}
    for name, options in _ALTERNATIVES.items():
        present = [F.col(c) for c in options if c in payloads.columns]
        merged[name] = F.coalesce(*present) if present else F.lit(None)
    used = {c for options in _ALTERNATIVES.values() for c in options}
    rest = [c for c in payloads.columns if c not in used]
    return payloads.select(*rest, *[col.alias(name) for name, col in merged.items()])


def signal_json(trailing: dict[str, Column] | None = None) -> Column:
    return J.json_object(
        {
            "as_of_date": J.quoted(F.col("as_of_date").cast("string")),
            "signal_confidence": J.quoted(F.col("confidence").cast("string")),
            "signal_direction": J.quoted(F.col("direction")),
            "signal_inputs": J.json_map(F.col("signal_components")),
            "signal_magnitude": J.quoted(F.col("magnitude").cast("string")),
            "signal_type": J.quoted(F.col("agent_type")),
            **(trailing or {}),
        }
    )


def snapshots(payloads: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One snapshot per (commodity, day, registry): agent rows sorted by type, hashed.

    Several versions of an agent's row collapse to the latest by ``order`` before anything is
    collected, so a list never holds more than one entry per agent.
    """
    good, _ = constraints(normalise(payloads), SIGNAL())
    if order:
        good = latest_per_key(good, [*KEY, "agent_type"], order)
    entry = F.struct(
        "agent_type",
        "direction",
        F.col("magnitude").cast("string").alias("magnitude"),
        F.col("confidence").cast("string").alias("confidence"),
        F.coalesce("signal_components", F.create_map().cast("map<string,string>")).alias("inputs"),
        signal_json().alias("json"),
    )
    grouped = good.groupBy(*KEY).agg(F.collect_list(entry).alias("_entries"))
    by_agent = F.array_sort(
        "_entries",
        lambda a, b: F.when(a["agent_type"] < b["agent_type"], -1)
        .when(a["agent_type"] > b["agent_type"], 1)
        .otherwise(0),
    )
    ordered = grouped.select(*KEY, by_agent.alias("signals"))
    payload = J.json_object(
        {
            "as_of_date": J.quoted(F.col("as_of_date").cast("string")),
            "commodity_id": J.quoted(F.col("commodity_id")),
            "registry_id": J.quoted(F.col("registry_id")),
            "signals": J.json_list(F.transform("signals", lambda s: s.getField("json"))),
        }
    )
    return ordered.select(
        *KEY,
        F.transform("signals", lambda s: s.dropFields("json")).alias("signals"),
        F.size("signals").cast("long").alias("signal_count"),
        J.digest(payload).alias("snapshot_hash"),
    ).withColumn("snapshot_id", J.digest(F.concat_ws("|", *KEY, "snapshot_hash")))


def flat_features(snapshot: DataFrame, signals: str = "signals") -> Column:
    """``signal_<agent>_confidence`` and ``signal_<agent>_<input>`` as one string map."""

    def of_agent(s: Column) -> Column:
        prefix = F.concat(F.lit("signal_"), F.lower(s.getField("agent_type")), F.lit("_"))
        own = F.map_from_arrays(
            F.array(F.concat(prefix, F.lit("confidence"))), F.array(s.getField("confidence"))
        )
        inputs = F.transform_keys(s.getField("inputs"), lambda k, _: F.concat(prefix, k))
        # An input named like the confidence key overrides it, so it is taken out first.
        kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(inputs, k))
        return F.map_entries(F.map_concat(kept, inputs))

    entries = F.flatten(F.transform(F.col(signals), of_agent))
    return F.coalesce(F.map_from_entries(entries), F.create_map().cast("map<string,string>"))
