"""Determinism replay: runs compared by order-free fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.canonical import digest, json_object, quoted, row_digest


def replay_inputs(registry_id: str, snapshot_hash: str, formula_version: str) -> Column:
    """Digest of the canonical replay input map."""
    parts = {
        "registry_id": F.lit(registry_id),
        "snapshot_hash": F.lit(snapshot_hash),
        "formula_version": F.lit(formula_version),
    }
    return digest(json_object({k: quoted(v) for k, v in parts.items()}))


def comparable(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows without generated ids, one digest each."""
    columns = [c for c in df.columns if c not in drop]
    return df.select(row_digest(columns).alias("row_digest"))


def fingerprint(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Row count and order-free 128-bit sum of row hashes; sums combine in the map tasks."""
    rows = comparable(df, drop)
    half = lambda seed: F.sum(
        F.xxhash64(F.concat(F.lit(seed), F.col("row_digest"))).cast("decimal(38,0)")
    ).cast("string")
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.concat_ws(":", half("a"), half("b")).alias("fingerprint"),
    )


def mismatches(first: DataFrame, second: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Row digests that only one of two runs has."""
    a, b = comparable(first, drop), comparable(second, drop)
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(
        b.exceptAll(a).withColumn("only_in", F.lit("second"))
    )


def validate_cycles(
    runner: Callable[[], DataFrame], cycles: int = 5, drop: tuple[str, ...] = ()
) -> list[dict]:
    """Run the producer repeatedly; each entry says whether it equals the first run."""
    prints = [fingerprint(runner(), drop).first().asDict() for _ in range(cycles)]
    return [{**p, "cycle": i, "matches_first": p == prints[0]} for i, p in enumerate(prints)]
