"""Ingests, backfills and snapshots through stored tables that are written and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql as Q
from checks.base import check
from checks.forecast import FITS, TARGETS, dataset, results
from checks.observations import MAPPED, landed
from checks.signals import dense_quality_sql
from tidemark import fixed, schemas
from tidemark.adapters import Landed, Tables
from tidemark.operators import mapping as M
from tidemark.plans import ingest, models
from tidemark.session import scratch_folder
from tidemark.sources import commits, files, seeds, tables


def keep_quality(at: Landed) -> ingest.Quality:
    registry = at.dimension_commodities().filter(F.col("commodity_id") == fixed.COMMODITY)
    return ingest.Quality(at.market_places().select("market_id"), registry.withColumn("registry_id", F.lit("r1")))


@check(
    f"""WITH {MAPPED},
quotes AS (
  SELECT as_of_date, count(DISTINCT market_id) AS reporting, count(*) AS bad, max(as_of_date + INTERVAL 1110 MINUTES) AS seen
  FROM kept GROUP BY ALL),
loaded AS (SELECT as_of_date, count(*) AS bad FROM kept_loads GROUP BY ALL),
span AS (SELECT min(as_of_date) AS lo, max(as_of_date) AS hi FROM (SELECT as_of_date FROM kept UNION ALL SELECT as_of_date FROM kept_loads)),
spine AS (SELECT 'cotton' AS series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS as_of_date FROM span),
days AS (
  SELECT 'cotton' AS series_id, as_of_date, q.reporting, q.seen, coalesce(q.bad, 0) + coalesce(l.bad, 0) AS bad
  FROM quotes q FULL JOIN loaded l USING (as_of_date)),
""" + dense_quality_sql("spine", "days", "SELECT count(*) FROM supplier WHERE s_suppkey % 5 <> 0") + """
SELECT series_id AS commodity_id, CAST(as_of_date AS VARCHAR) AS as_of_date, 'r1' AS registry_id, health AS market_health,
  reporting AS markets_reporting, days_with_data, anomaly_count, score AS overall_quality_score, round(lag_hours, 2) AS lag_hours,
  round(1.0::DOUBLE - score, 4) AS confidence_penalty_factor, false AS futures_feed_ok FROM scored"""
)
def ingest_quality(t: Tables) -> DataFrame:
    """Snapshots kept up by two ingests, the second with a year before the end and a month once more."""
    at, folder = landed(t), scratch_folder(t.spark)
    parsed, keep = M.parse_records(at.raw_records()), keep_quality(landed(t))
    late = F.coalesce(F.year("as_of_date") == 1995, F.lit(False))
    again = F.trunc("as_of_date", "MM") == F.lit(dt.date(1996, 1, 1))
    for number, rows in ((1, parsed.filter(~late)), (2, parsed.filter(late | again)), (2, parsed.filter(late))):
        ingest.ingest_market(
            t.spark, rows, at.market_places(), folder, keep_quality=keep, writer="check", number=number
        )
    detail = lambda name: F.get_json_object(
        "source_health", f"$.{fixed.MARKET_SOURCE}_detail.{name}"
    ).cast("long")
    return ingest.quality_table(t.spark, folder).select(
        "commodity_id", "as_of_date", "registry_id",
        F.get_json_object("source_health", f"$.{fixed.MARKET_SOURCE}").alias("market_health"),
        detail("markets_reporting").alias("markets_reporting"), detail("days_with_data").alias("days_with_data"),
        detail("anomaly_count").alias("anomaly_count"), "overall_quality_score", "lag_hours",
        "confidence_penalty_factor", "futures_feed_ok",
    )


@check(
    f"""WITH {MAPPED}
SELECT strftime(as_of_date, '%Y-%m') AS as_of_month, count(*) AS price_rows, sum(CAST(value AS DOUBLE)) AS price_sum,
  count(DISTINCT market_id) AS markets, any_value(loaded.n) AS arrival_rows, any_value(loaded.volume) AS volume_sum,
  (SELECT count(DISTINCT as_of_date) FROM kept WHERE as_of_date BETWEEN DATE '1994-02-10' AND DATE '1996-11-20') AS window_days_with_data
FROM kept LEFT JOIN (
  SELECT strftime(as_of_date, '%Y-%m') AS m, count(*) AS n, sum(CAST(volume AS DOUBLE)) AS volume FROM kept_loads
  WHERE as_of_date BETWEEN DATE '1994-02-10' AND DATE '1996-11-20' GROUP BY ALL) loaded ON m = strftime(as_of_date, '%Y-%m')
WHERE as_of_date BETWEEN DATE '1994-02-10' AND DATE '1996-11-20' GROUP BY 1"""
)
def backfill_window(t: Tables) -> DataFrame:
    """A backfill that stops after its first steps and is run again; both tables by month."""
    at, folder = landed(t), scratch_folder(t.spark)
    parsed, places = M.parse_records(at.raw_records()), at.market_places()
    start, end = dt.date(1994, 2, 10), dt.date(1996, 11, 20)
    ingest.backfill_market(t.spark, parsed, places, folder, start, dt.date(1995, 3, 5), step_days=400)
    ingest.backfill_market(
        t.spark, parsed, places, folder, start, end, keep_quality=keep_quality(at), step_days=400
    )
    prices = commits.read(t.spark, folder, ingest.PRICES, schemas.PRICE_OBSERVATION)
    arrivals = commits.read(t.spark, folder, ingest.ARRIVALS, schemas.ARRIVAL_OBSERVATION)
    window = ingest.quality_table(t.spark, folder).filter(F.col("as_of_date") == F.lit(end)).agg(
        F.max(F.get_json_object("source_health", f"$.{fixed.MARKET_SOURCE}_detail.days_with_data").cast("long"))
        .alias("days")
    ).scalar()
    by_month = prices.groupBy("as_of_month").agg(
        F.count(F.lit(1)).alias("price_rows"), F.sum("value").alias("price_sum"),
        F.count_distinct("market_id").alias("markets"),
    )
    loads = arrivals.groupBy("as_of_month").agg(
        F.count(F.lit(1)).alias("arrival_rows"), F.sum("volume").alias("volume_sum")
    )
    return by_month.join(loads, "as_of_month", "left").withColumn("window_days_with_data", window)


DISTRICTS = dict(zip("12345", fixed.DISTRICT_REGIONS, strict=True))


@check(
    f"""WITH {Q.WEATHER},
pick AS (
  SELECT * FROM weather WHERE rainfall_mm IS NOT NULL AND temperature_mean_c IS NOT NULL AND relative_humidity_pct IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY region_id, as_of_date ORDER BY observation_id DESC) = 1)
SELECT CASE left(region_id, 1) {' '.join(f"WHEN '{k}' THEN '{fixed.DISTRICT_REGIONS[v]}'" for k, v in DISTRICTS.items())} END AS region_id,
  CAST(as_of_date AS VARCHAR) AS as_of_date, CASE WHEN month(as_of_date) % 2 = 0 THEN rainfall_mm ELSE rainfall_mm + 1 END AS rainfall_mm,
  floor(temperature_mean_c * 100 + 0.5) / 100 AS temperature_mean_c, relative_humidity_pct, strftime(as_of_date + INTERVAL 12 HOURS, '%Y-%m-%d %H:%M:%S') AS observed_at,
  'nasa_power' AS source FROM pick"""
)
def weather_ingest(t: Tables) -> DataFrame:
    """Points of the even months, then points of all months with other values: stored keys stay."""
    folder = scratch_folder(t.spark)
    values = ["rainfall_mm", "temperature_mean_c", "relative_humidity_pct"]
    day = t.weather().dropna(subset=values).groupBy("region_id", "as_of_date").agg(
        F.max_by(F.struct(*values), "observation_id").alias("w")
    )
    names = F.create_map(*[F.lit(x) for pair in DISTRICTS.items() for x in pair])
    points = day.select(
        names[F.left("region_id", F.lit(1))].alias("district_name"), "as_of_date", "w.*",
        F.lit(None).cast("map<string,string>").alias("provenance"),
    )
    ingest.ingest_weather(t.spark, points.filter(F.month("as_of_date") % 2 == 0), folder)
    ingest.ingest_weather(t.spark, points.withColumn("rainfall_mm", F.col("rainfall_mm") + 1), folder)
    return commits.read(t.spark, folder, ingest.WEATHER, schemas.WEATHER_OBSERVATION).select(
        "region_id", "as_of_date", *values, "observed_at", "source"
    )


@check(f"WITH {FITS} SELECT model_name, horizon_days, round(avg(mae), 2) AS mae, count(*) AS n_rows, sum(n_samples)::BIGINT AS n_samples, "
       "max(fold_count) AS fold_count, 'database' AS mode FROM results GROUP BY ALL")
def metrics_documents(t: Tables) -> DataFrame:
    """Evaluation results written as metrics documents and read back."""
    path = scratch_folder(t.spark)
    files.write_metrics(results(t), path)
    rows = files.metrics_rows(t.spark, path)
    return rows.groupBy("model_name", "horizon_days", "mode").agg(
        F.round(F.avg(F.round("mae", 2)), 2).alias("mae"), F.count(F.lit(1)).alias("n_rows"),
        F.sum("n_samples").alias("n_samples"), F.max("fold_count").alias("fold_count"),
    )


@check(
    f"""WITH {TARGETS}
SELECT 'spot' AS feature, round(regr_slope(target, spot), 6) AS slope, round(regr_intercept(target, spot), 2) AS intercept FROM dataset"""
)
def saved_line_model(t: Tables) -> DataFrame:
    """Least squares on all rows, saved with its feature names and read back from its files."""
    from pyspark.ml import PipelineModel

    folder = scratch_folder(t.spark)
    matrix = dataset(t).select("series_id", "horizon_days", "as_of_date", "spot_price_level", "target_price_level",
                               F.col("spot_price_level").alias("spot"))
    models.fit_full(matrix, ["spot"], fixed.LINEAR, folder)
    line = PipelineModel.load(f"{folder}/model").stages[-1]
    names = models.saved_features(t.spark, folder)
    fitted = list(zip(names, [float(c) for c in line.coefficients], strict=True))
    return t.spark.createDataFrame(fitted, "feature string, slope double").select(
        "feature", F.round("slope", 6).alias("slope"), F.round(F.lit(float(line.intercept)), 2).alias("intercept")
    )


@check(
    """SELECT 'm' || s_suppkey AS market_id, 'n' || s_nationkey AS region_id, n_name AS state, s_name AS market, 2::BIGINT AS loads
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 3 <> 0"""
)
def seeded_markets(t: Tables) -> DataFrame:
    """A seed document per nation, read into dimension tables that are upserted twice."""
    folder = scratch_folder(t.spark)
    place = F.struct(F.col("n_name").alias("state"), F.col("n_name").alias("district"), F.col("s_name").alias("market"))
    market = F.struct(
        F.concat(F.lit("m"), "s_suppkey").alias("market_id"), F.concat(F.lit("n"), "s_nationkey").alias("region_id"),
        F.lit("mandi").alias("market_type"), F.col("s_name").alias("name"),
        F.struct(F.when(F.col("s_suppkey") % 3 != 0, place).alias(fixed.MARKET_SOURCE)).alias("source_identifiers"),
    )
    rows = t.read("supplier").join(t.read("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    document = rows.groupBy("s_nationkey").agg(F.to_json(F.struct(
        F.struct(F.concat(F.lit("c"), F.first("s_nationkey")).alias("commodity_id")).alias("commodity"),
        F.collect_list(market).alias("markets"),
    )).alias("value"))
    document.write.partitionBy("s_nationkey").text(f"{folder}/seed")
    path = f"{folder}/market"
    for load in (1, 2):
        markets = seeds.seed_tables(seeds.seed_document(t.spark, f"{folder}/seed"))["market"].withColumn("loads", F.lit(load))
        tables.upsert_table(t.spark, path, markets, ["market_id"], ["loads"])
    stored = t.spark.read.parquet(path)
    return seeds.expected_markets(stored).join(stored.select("market_id", "loads"), "market_id").select(
        "market_id", "region_id", "state", "market", "loads"
    )
