"""Append-only store of feature sets: contents by digest, and which was valid since when.

``contents`` holds each feature set once, under its hash; ``versions`` holds a row for every time
that the set of a (commodity, day, registry) changed. Nothing is ever rewritten, so a read as of an
earlier time gives what was stored then. Both tables become visible with one commit.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.dedupe import latest_per_key, new_rows, null_safe
from tidemark.session import cut_lineage
from tidemark.sources import commits
from tidemark.sources.tables import MONTH, in_months

KEY = ["commodity_id", "as_of_date", "registry_id"]
CONTENTS, VERSIONS = "contents", "versions"
_KEYS = "commodity_id string, as_of_date date, registry_id string, feature_hash string, created_at timestamp"
CONTENT_SCHEMA = (
    f"{_KEYS}, feature_values map<string,string>, "
    "feature_lineage struct<assembly_version:string,agents:array<struct<agent:string,is_stub:boolean>>>"
)
VERSION_SCHEMA = _KEYS


def append_sets(
    spark: SparkSession, folder: str, sets: DataFrame, writer: str | None = None, number: int = 0
) -> dict[str, int]:
    """Store feature sets (KEY, feature_values, feature_lineage, feature_hash, created_at).

    A set equal to the one in force at its ``created_at`` adds nothing, so a repeated write leaves the
    store as it was; one that returns to an earlier content adds a version but no content. Rows
    without a day or a hash are refused. Of two sets of one key and time the larger hash is read.
    A number that ``writer`` committed before gives its old result. Returns the rows added.
    """
    log = commits.Batch(spark, folder)
    if writer is not None and (done := log.result_of(writer, number)) is not None:
        return done
    offered = cut_lineage(
        sets.select(*KEY, "feature_hash", F.col("created_at").cast("timestamp").alias("created_at"),
                    "feature_values", "feature_lineage")
    )
    missing = F.col("as_of_date").isNull() | F.col("feature_hash").isNull() | F.col("created_at").isNull()
    seen = offered.agg(
        F.min("as_of_date").alias("first"), F.max("as_of_date").alias("last"), F.count_if(missing).alias("missing")
    ).first()
    if seen["missing"]:
        raise ValueError(f"{seen['missing']} feature sets lack a day, a hash or a time")
    result = {"versions_added": 0, "contents_added": 0}
    if seen["first"] is not None:
        span = in_months(seen["first"], seen["last"])
        log.append(VERSIONS, _changed(offered, log.stored(VERSIONS, VERSION_SCHEMA).filter(span)))
        added = log.own(VERSIONS, VERSION_SCHEMA)
        # Only contents of the added versions can be new; a hash names one key, so its month is known.
        used = offered.join(added.select("feature_hash").distinct(), "feature_hash", "left_semi")
        known = log.stored(CONTENTS, CONTENT_SCHEMA).filter(span)
        fresh = new_rows(used, known, ["feature_hash"], ["created_at"])
        log.append(CONTENTS, fresh.select(*offered.columns))
        result = {
            "versions_added": added.count(), "contents_added": log.own(CONTENTS, CONTENT_SCHEMA).count(),
        }
    log.commit(writer, number, result)
    return result


def _changed(offered: DataFrame, stored: DataFrame) -> DataFrame:
    """Offered versions that differ from the one before them, stored or offered."""
    columns = [*KEY, "feature_hash", "created_at"]
    versions = offered.select(*columns).distinct()
    keys, known = versions.select(*KEY).distinct(), stored.select(*columns)
    touched = known.join(keys, null_safe(known, keys, KEY), "left_semi")
    both = versions.withColumn("_offered", F.lit(True)).unionByName(touched.withColumn("_offered", F.lit(False)))
    # A key has as many rows here as it had versions.
    order = Window.partitionBy(*KEY).orderBy("created_at", "feature_hash", "_offered")
    return (
        both.withColumn("_before", F.lag("feature_hash").over(order))
        .filter(F.col("_offered") & ~F.col("feature_hash").eqNullSafe(F.col("_before")))
        .select(*columns)
    )


def read_sets(
    spark: SparkSession, folder: str, at: dt.datetime | None = None, first: dt.date | None = None,
    last: dt.date | None = None,
) -> DataFrame:
    """The set of every key in force at ``at`` (default: the newest), within a range of days if given.

    The time filter and the months reach both scans; ``created_at`` is that of the version read.
    """
    of = commits.state(spark, folder)
    versions = commits.read(spark, folder, VERSIONS, VERSION_SCHEMA, of)
    contents = commits.read(spark, folder, CONTENTS, CONTENT_SCHEMA, of)
    if first is not None or last is not None:
        first, last = first or dt.date(1, 1, 1), last or dt.date(9999, 12, 31)
        span = in_months(first, last) & F.col("as_of_date").between(first, last)
        versions, contents = versions.filter(span), contents.filter(span)
    if at is not None:
        versions = versions.filter(F.col("created_at") <= F.lit(at))
    newest = latest_per_key(versions.drop(MONTH), KEY, ["created_at", "feature_hash"])
    return newest.join(
        contents.select("feature_hash", "feature_values", "feature_lineage"), "feature_hash"
    ).select(*KEY, "feature_hash", "created_at", "feature_values", "feature_lineage")
