"""Readers of landed files. Every reader states its schema; bad rows are kept with a reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed, schemas
from tidemark.operators.mapping import parse_futures, parse_records

ORDER = ["source_file", "position"]


class SourceError(ValueError):
    """A landed document does not have the required shape."""


def market_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed document with its ``records`` as raw JSON texts."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("source_file"), F.col("value").alias("body")
    )


def raw_market_records(envelopes: DataFrame) -> DataFrame:
    """Records of each document with file and position; non-objects carry no fields.

    ``envelope_error`` tells documents without a ``records`` list apart.
    """
    # Behind a generator the list is looked up once, however often it is named.
    listed = F.struct(F.trim(F.get_json_object("body", "$.records")).alias("_text"))
    found = envelopes.select("source_file", F.inline(F.array(listed)))
    text = F.col("_text")
    error = F.when(text.isNull(), "document without records").when(
        ~text.startswith("["), "records are not a list"
    )
    # Elements stay JSON text first, so one odd element cannot null its neighbours.
    elements = F.when(error.isNull(), F.from_json(text, "array<string>"))
    exploded = found.select(
        "source_file", error.alias("envelope_error"),
        F.posexplode_outer(elements).alias("position", "_record"),
    )
    is_object = F.trim("_record").startswith("{")
    fields = F.from_json(F.when(is_object, F.col("_record")), schemas.MARKET_RECORD)
    return exploded.select(
        "source_file",
        "position",
        "envelope_error",
        F.when(F.col("_record").isNotNull(), F.coalesce(is_object, F.lit(False))).alias(
            "is_object"
        ),
        F.inline(F.array(fields)),
    )


def market_records(spark: SparkSession, path: str) -> DataFrame:
    """Parsed records of all documents under ``path``, rejects included with their reason."""
    return parse_market(raw_market_records(market_envelopes(spark, path)))


def parse_market(raw: DataFrame) -> DataFrame:
    parsed = parse_records(raw)
    reason = (
        F.when(F.col("envelope_error").isNotNull(), F.col("envelope_error"))
        .when(F.col("is_object").isNull(), "no records")
        .when(~F.col("is_object"), "expected object")
        .otherwise(F.col("reject_reason"))
    )
    return parsed.withColumn("reject_reason", reason).drop("envelope_error", "is_object")


def require_some(parsed: DataFrame, what: str = "record") -> None:
    """Raise when there are rejects and not a single good row, or a document has no list."""
    good, bad, shape = parsed.agg(
        F.count_if(F.col("reject_reason").isNull()),
        F.count_if(F.col("reject_reason").isNotNull() & (F.col("reject_reason") != "no records")),
        F.count_if(F.col("reject_reason").contains("'records'")),
    ).first()
    if shape:
        raise SourceError("a document has no 'records' list")
    if bad and not good:
        raise SourceError(f"no readable {what}")


def _first_present(columns: list[str], candidates: tuple[str, ...]) -> Column:
    """First non-blank value of the candidate headers a file has."""
    by_name = {c.lstrip("﻿").strip(): c for c in columns}
    found = [
        F.nullif(F.trim(F.col(f"`{by_name[c]}`")), F.lit("")) for c in candidates if c in by_name
    ]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def canonical_futures(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Exchange headers to canonical text columns, next to the columns to keep."""
    return raw.select(
        *(keep or []),
        *[_first_present(raw.columns, heads).alias(name)
          for name, heads in fixed.FUTURES_HEADERS.items()]
    )


def futures_file(spark: SparkSession, path: str, default_day: Column | None = None) -> DataFrame:
    """Contracts of one file layout; sort with :func:`futures_order` at the sink."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    if not raw.columns:
        raise SourceError("the file has no header line")
    return parse_futures(canonical_futures(raw), default_day)


def futures_order(contracts: DataFrame) -> DataFrame:
    return contracts.orderBy("expiry_date", "contract_symbol")


def weather_grid(spark: SparkSession, path: str, district: Column | None = None) -> DataFrame:
    """Daily points of gridded weather documents; the district is the file's stem by default."""
    documents = spark.read.schema(schemas.WEATHER_GRID).option("multiLine", True).json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return grid_points(documents.withColumn("district_name", district if district is not None else stem))


def grid_points(documents: DataFrame) -> DataFrame:
    """One row per day with all three parameters; a day with any fill value is dropped."""
    block = "properties.parameter"
    days = documents.select(
        "district_name",
        F.col("header.fill_value").alias("_fill"),
        F.col("geometry.coordinates").alias("_at"),
        F.col(f"{block}.T2M").alias("_t"),
        F.col(f"{block}.RH2M").alias("_h"),
        F.explode(f"{block}.PRECTOTCORR").alias("_day", "rainfall_mm"),
    )
    values = days.select(
        "district_name",
        F.to_date("_day", "yyyyMMdd").alias("as_of_date"),
        "rainfall_mm",
        F.try_element_at("_t", F.col("_day")).alias("temperature_mean_c"),
        F.try_element_at("_h", F.col("_day")).alias("relative_humidity_pct"),
        "_fill",
        F.create_map(
            F.lit("api"), F.lit("daily_point"),
            F.lit("longitude"), F.try_element_at("_at", F.lit(1)).cast("string"),
            F.lit("latitude"), F.try_element_at("_at", F.lit(2)).cast("string"),
            F.lit("parameters"), F.lit("PRECTOTCORR,T2M,RH2M"),
        ).alias("provenance"),
    )
    names = ("rainfall_mm", "temperature_mean_c", "relative_humidity_pct")
    filled = [F.coalesce(F.col(c) == F.col("_fill"), F.lit(False)) for c in names]
    return values.filter(~reduce(lambda a, b: a | b, filled)).drop("_fill")


CORE = tuple(part.strip().split(" ")[0] for part in schemas.SUPERVISED_CORE.split(", "))


def supervised_rows(lines: DataFrame) -> DataFrame:
    """JSON lines (column ``value``) to typed core columns and an open feature map."""
    text = lines.filter(F.trim("value") != "")
    # Numbers arrive as text or number; reading every value as text accepts both.
    raw = F.from_json("value", "map<string,string>")
    at = lambda k: F.try_element_at(F.col("_m"), F.lit(k))
    core = F.array(*[F.lit(k) for k in CORE])
    return text.select(F.col("value"), raw.alias("_m")).select(
        at("as_of_date").try_cast("date").alias("as_of_date"),
        F.coalesce(at("commodity_id"), F.lit(fixed.COMMODITY)).alias("commodity_id"),
        F.coalesce(at("horizon_days").try_cast("int"), F.lit(30)).alias("horizon_days"),
        at("spot_price_level").try_cast("decimal(18,4)").alias("spot_price_level"),
        at("target_price_level").try_cast("decimal(18,4)").alias("target_price_level"),
        F.coalesce(at("target_log_return").try_cast("double"), F.lit(0.0)).alias(
            "target_log_return"
        ),
        at("registry_id").alias("registry_id"),
        at("snapshot_hash").alias("snapshot_hash"),
        F.map_filter("_m", lambda k, _: ~F.array_contains(core, k)).alias("features"),
        F.when(F.col("_m").isNull(), "invalid JSON").alias("_broken"),
    ).select(
        "*",
        F.when(F.col("_broken").isNotNull(), F.col("_broken"))
        .when(F.col("as_of_date").isNull(), "as_of_date must be an ISO date")
        .when(F.col("spot_price_level").isNull(), "spot_price_level is required")
        .when(F.col("target_price_level").isNull(), "target_price_level is required")
        .alias("reject_reason"),
    ).drop("_broken")


def read_supervised(spark: SparkSession, path: str) -> DataFrame:
    """Whole corpus; any unreadable row or an empty corpus is an error."""
    rows = supervised_rows(spark.read.text(path))
    total, bad = rows.agg(
        F.count(F.lit(1)), F.count_if(F.col("reject_reason").isNotNull())
    ).first()
    if bad or not total:
        raise SourceError(f"{bad} unreadable rows of {total} under {path}")
    return rows.drop("reject_reason")


def supervised_json(rows: DataFrame, features: str = "features") -> Column:
    """One JSON line with sorted keys; decimals as text, log return at eight places."""
    shown = F.map_from_arrays(
        F.array(*[F.lit(c) for c in CORE]),
        F.array(
            *[
                F.round(F.col(c), 8).cast("string")
                if c == "target_log_return"
                else F.col(c).cast("string")
                for c in CORE
            ]
        ),
    )
    merged = F.map_concat(
        F.map_filter(shown, lambda _, v: v.isNotNull()),
        F.coalesce(F.col(features), F.create_map().cast("map<string,string>")),
    )
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged))))


def write_supervised(rows: DataFrame, path: str) -> None:
    """One folder of JSON lines per horizon."""
    rows.select("horizon_days", supervised_json(rows).alias("value")).write.mode(
        "overwrite"
    ).partitionBy("horizon_days").text(path)


def metrics_rows(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation metrics documents flattened: an array, one object, or an object on every line."""
    body = F.trim("value")
    lines = F.filter(F.split(body, "\n"), lambda line: F.trim(line) != "")
    by_line = F.forall(lines, lambda line: F.trim(line).like("{%}"))
    documents = (
        F.when(body.startswith("["), F.from_json(body, f"array<struct<{schemas.METRICS_ROW}>>"))
        .when(by_line, F.transform(lines, lambda line: F.from_json(line, schemas.METRICS_ROW)))
        .otherwise(F.array(F.from_json(body, schemas.METRICS_ROW)))
    )
    return spark.read.text(path, wholetext=True).select(F.inline(documents)).select(
        "model_name",
        "horizon_days",
        "metrics.mae",
        "metrics.rmse",
        "metrics.mape_pct",
        "metrics.n_samples",
        F.coalesce("mode", F.lit("fixture")).alias("mode"),
        F.coalesce("fold_count", F.lit(0)).alias("fold_count"),
        "model_path",
    )


def write_metrics(results: DataFrame, path: str) -> None:
    """Nested metrics with sorted keys, one JSON object per row."""
    has_path = "model_path" in results.columns
    results.select(
        "fold_count",
        "horizon_days",
        F.struct("mae", "mape_pct", "n_samples", "rmse").alias("metrics"),
        "mode",
        "model_name",
        (F.col("model_path") if has_path else F.lit(None).cast("string")).alias("model_path"),
    ).write.mode("overwrite").option("ignoreNullFields", False).json(path)
