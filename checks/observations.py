"""Landed records, validation, deduplication, coverage and gaps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql as Q
from checks.base import check
from tidemark.adapters import Landed, Tables
from tidemark.operators import coverage as C
from tidemark.operators import dedupe as D
from tidemark.operators import mapping as M
from tidemark.operators import validation as V
from tidemark.plans import ingest
from tidemark.sources import files, tables

RAW = f"""raw AS (
  SELECT {Q.LINE_ID} AS source_file, l_linenumber AS position, r_name AS state, n_name AS district,
    s_name AS market, l_suppkey, l_orderkey % 7 < 5 AS is_cotton, l_orderkey % 7 = 6 OR l_orderkey % 7 = 5 AS other,
    CASE WHEN l_partkey % 3 = 0 THEN 'A' END AS variety, CASE WHEN l_partkey % 4 = 0 THEN 'FAQ' END AS grade,
    CAST(l_shipdate AS DATE) AS as_of_date,
    CASE WHEN l_partkey % 50 = 0 THEN 'invalid arrival_date'
      WHEN l_orderkey % 97 = 0 THEN 'invalid numeric value min_price' END AS reject_reason,
    CASE WHEN l_orderkey % 5 <> 0 THEN {Q.CENTS} END AS min_price,
    CASE WHEN l_returnflag <> 'R' THEN {Q.CENTS} + 200 END AS max_price, {Q.CENTS} + 100 AS modal_price,
    CASE WHEN l_linestatus = 'F' THEN floor(l_quantity) WHEN l_linenumber % 2 = 0 THEN 7 END AS tonnes
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey)"""
MAPPED = RAW + """, mapped AS (
  SELECT *, 'm' || CAST(l_suppkey AS VARCHAR) AS market_id,
    CASE WHEN variety IS NULL AND grade IS NULL THEN NULL
      ELSE concat_ws('|', variety, grade) END AS quality_grade
  FROM raw WHERE reject_reason IS NULL AND is_cotton AND l_suppkey % 5 <> 0),
drafts AS (
  SELECT source_file, position, market_id, as_of_date, quality_grade, 'modal' AS price_type, modal_price AS value FROM mapped
  UNION ALL SELECT source_file, position, market_id, as_of_date, quality_grade, 'min', min_price FROM mapped WHERE min_price IS NOT NULL
  UNION ALL SELECT source_file, position, market_id, as_of_date, quality_grade, 'max', max_price FROM mapped WHERE max_price IS NOT NULL),
kept AS (
  SELECT * FROM drafts QUALIFY row_number() OVER (
    PARTITION BY market_id, as_of_date, price_type, quality_grade ORDER BY source_file, position) = 1),
loads AS (
  SELECT source_file, position, market_id, as_of_date, tonnes * 10 AS volume FROM mapped WHERE tonnes IS NOT NULL),
kept_loads AS (
  SELECT * FROM loads QUALIFY row_number() OVER (PARTITION BY market_id, as_of_date ORDER BY source_file, position) = 1)"""


def landed(t: Tables) -> Landed:
    return Landed(t.spark, t.folder)


def mapped(t: Tables) -> DataFrame:
    at = landed(t)
    return M.map_records(M.parse_records(at.raw_records()), at.market_places())


@check(
    f"""WITH {RAW}
SELECT source_file, state, coalesce(reject_reason, 'good') AS reject_reason,
  CASE WHEN reject_reason IS DISTINCT FROM 'invalid arrival_date' THEN CAST(as_of_date AS VARCHAR) END AS as_of_date,
  CASE WHEN reject_reason IS DISTINCT FROM 'invalid numeric value min_price' AND NOT source_file IN
    (SELECT {Q.LINE_ID} FROM lineitem WHERE l_orderkey % 97 = 0) THEN min_price END AS min_price,
  max_price, modal_price, CAST(tonnes AS DOUBLE) AS arrival_tonnes, variety, grade FROM raw"""
)
def parsed_market_records(t: Tables) -> DataFrame:
    return M.parse_records(landed(t).raw_records()).select(
        "source_file", "state", F.coalesce("reject_reason", F.lit("good")).alias("reject_reason"),
        "as_of_date", "min_price", "max_price", "modal_price", "arrival_tonnes", "variety", "grade",
    )


@check(
    f"""WITH {RAW}, texts AS (
  SELECT source_file, CASE WHEN reject_reason IS NULL THEN 'good' ELSE reject_reason END AS outcome FROM raw)
SELECT outcome, count(*) AS row_count FROM texts GROUP BY ALL"""
)
def market_envelope_outcomes(t: Tables) -> DataFrame:
    """Records written as JSON documents, then read back through the envelope source."""
    raw = landed(t).raw_records()
    record = F.struct(*[c for c in raw.columns if c not in ("source_file", "position")])
    documents = raw.select(
        "source_file", F.to_json(F.struct(F.array(record).alias("records"))).alias("body")
    )
    parsed = files.parse_market(files.raw_market_records(documents))
    return parsed.groupBy(F.coalesce("reject_reason", F.lit("good")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


@check(
    f"""WITH {MAPPED}
SELECT source_file, market_id, CAST(as_of_date AS VARCHAR) AS as_of_date, quality_grade, price_type, value,
  strftime(as_of_date + INTERVAL 1110 MINUTES, '%Y-%m-%d %H:%M:%S') AS observed_at FROM drafts"""
)
def price_drafts(t: Tables) -> DataFrame:
    return M.price_rows(mapped(t), files.ORDER).select(
        "source_file", "market_id", "as_of_date", "quality_grade", "price_type", "value",
        "observed_at",
    )


@check(
    f"""WITH {MAPPED}
SELECT source_file, market_id, CAST(as_of_date AS VARCHAR) AS as_of_date, CAST(volume AS DOUBLE) AS volume FROM loads"""
)
def arrival_drafts(t: Tables) -> DataFrame:
    return M.arrival_rows(mapped(t), files.ORDER).select(
        "source_file", "market_id", "as_of_date", "volume"
    )


@check(
    f"""WITH {RAW}
SELECT CASE WHEN l_suppkey % 5 <> 0 THEN 'm' || CAST(l_suppkey AS VARCHAR) END AS market_id, count(*) AS row_count
FROM raw WHERE reject_reason IS NULL GROUP BY ALL"""
)
def market_lookup(t: Tables) -> DataFrame:
    at = landed(t)
    good = M.parse_records(at.raw_records()).filter("reject_reason IS NULL")
    return M.resolve_markets(good, at.market_places()).groupBy("market_id").agg(
        F.count(F.lit(1)).alias("row_count")
    )


@check(
    f"""WITH {MAPPED}
SELECT market_id, CAST(as_of_date AS VARCHAR) AS as_of_date, quality_grade, price_type, value, source_file FROM kept
ANTI JOIN stored0 s ON s.market_id = kept.market_id AND s.as_of_date = kept.as_of_date
  AND s.price_type = kept.price_type AND coalesce(s.quality_grade, '~') = coalesce(kept.quality_grade, '~')""".replace(
        "kept_loads AS",
        "stored0 AS (SELECT * FROM drafts WHERE as_of_date < DATE '1996-01-01'), kept_loads AS",
    )
)
def new_price_rows(t: Tables) -> DataFrame:
    return _new_prices(t, 0)


def _new_prices(t: Tables, filter_bits: int) -> DataFrame:
    """First price of every key, minus the keys before 1996, which count as stored."""
    rows = mapped(t)
    stored = M.price_rows(rows.filter(F.col("as_of_date") < F.lit(dt.date(1996, 1, 1))), files.ORDER)
    first = M.first_price_rows(rows, files.ORDER)
    return D.without_stored(first, stored, D.PRICE_KEY, filter_bits).select(
        "market_id", "as_of_date", "quality_grade", "price_type", "value", "source_file"
    )


@check(
    f"""WITH {MAPPED.replace("drafts AS (", "drafts AS MATERIALIZED (").replace("kept AS (", "kept AS MATERIALIZED (")}
SELECT k.market_id, CAST(k.as_of_date AS VARCHAR) AS as_of_date, k.quality_grade, k.price_type, k.value, k.source_file
FROM kept k WHERE k.as_of_date >= DATE '1996-01-01'"""
)
def new_price_rows_by_filter(t: Tables) -> DataFrame:
    """The same rows where the stored side is thinned by a filter of the batch's keys; a key holds its day."""
    return _new_prices(t, D.FILTER_BITS)


@check(
    f"""WITH {MAPPED}
SELECT market_id, CAST(as_of_date AS VARCHAR) AS as_of_date, CAST(volume AS DOUBLE) AS volume, source_file FROM kept_loads"""
)
def new_arrival_rows(t: Tables) -> DataFrame:
    drafts = M.arrival_rows(mapped(t), files.ORDER)
    return D.new_rows(drafts, None, D.ARRIVAL_KEY, files.ORDER).select(
        "market_id", "as_of_date", "volume", "source_file"
    )


@check(
    f"""WITH {MAPPED}
SELECT (SELECT count(*) FROM raw) AS rows_fetched,
  (SELECT count(*) FROM raw WHERE reject_reason IS NULL) AS rows_parsed,
  (SELECT count(*) FROM drafts) AS price_drafts, (SELECT count(*) FROM loads) AS arrival_drafts,
  (SELECT count(*) FROM kept) AS prices_inserted, (SELECT count(*) FROM kept_loads) AS arrivals_inserted,
  (SELECT count(*) FROM drafts) - (SELECT count(*) FROM kept) AS prices_skipped,
  (SELECT count(*) FROM loads) - (SELECT count(*) FROM kept_loads) AS arrivals_skipped"""
)
def ingest_counters(t: Tables) -> DataFrame:
    at = landed(t)
    return ingest.counters(ingest.market_batch(M.parse_records(at.raw_records()), at.market_places()))


FUTURES_RAW = f"""fut_raw AS (
  SELECT *, {Q.CENTS} AS cents FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@check(
    f"""WITH {FUTURES_RAW}
SELECT {Q.LINE_ID} AS line, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS as_of_date,
  CASE WHEN l_partkey % 2 = 0 THEN 'KAPAS' ELSE 'SHANKRKPAS' END AS contract_symbol,
  CAST(CAST(l_shipdate AS DATE) + 30 AS VARCHAR) AS expiry_date, cents AS settle_price,
  cents * 5 AS settle_price_quintal, CASE WHEN CAST(l_quantity AS BIGINT) > 9 THEN CAST(l_quantity AS BIGINT) * 1000 END AS open_interest
FROM fut_raw WHERE l_partkey % 3 <> 2 AND l_orderkey % 6 <> 5"""
)
def parsed_futures_rows(t: Tables) -> DataFrame:
    """Exchange columns with mixed date formats, commas and markers."""
    day = F.to_date("l_shipdate")
    order, part, size = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity").cast("long")
    from tidemark.adapters import line_id, unit_cents

    fmt = lambda d: (
        F.when(order % 4 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(order % 4 == 1, F.date_format(d, "dd-MM-yyyy"))
        .when(order % 4 == 2, F.date_format(d, "dd/MM/yyyy"))
        .otherwise(F.date_format(d, "yyyy/MM/dd"))
    )
    raw = t.read("lineitem").select(
        fmt(day).alias("TradDt"),
        F.when(part % 3 == 2, "JUTE").when(part % 2 == 0, "kapas").otherwise("SHANKRKPAS")
        .alias("TckrSymb"),
        F.when(order % 6 == 5, "OPT").when(order % 6 == 4, "").otherwise("FUTCOM")
        .alias("SctySrs"),
        fmt(F.date_add(day, 30)).alias("XpryDt"),
        F.lit("").alias("SttlPric"),
        F.format_number(unit_cents(), 2).alias("Settle Price"),
        F.when(size < 5, "0").when(size <= 9, "-").otherwise(F.format_number(size * 1000, 0))
        .alias("OpnIntrst"),
        line_id().alias("line"),
    )
    parsed = M.parse_futures(files.canonical_futures(raw, keep=["line"]))
    return parsed.filter("reject_reason IS NULL").select(
        "line", "as_of_date", "contract_symbol", "expiry_date", "settle_price",
        "settle_price_quintal", "open_interest",
    )


VALIDATION = f"""obs AS (
  SELECT {Q.LINE_ID} AS observation_id,
    CASE WHEN l_suppkey % 17 = 0 THEN NULL WHEN l_suppkey % 13 = 0 THEN 'x' || l_suppkey ELSE 'm' || l_suppkey END AS market_id,
    CASE WHEN l_orderkey % 11 = 0 THEN 'jute' WHEN l_orderkey % 23 = 0 THEN 'unknown' ELSE 'cotton' END AS commodity_id,
    CASE l_returnflag WHEN 'A' THEN 'modal' WHEN 'N' THEN 'min' ELSE 'max' END AS price_type,
    l_extendedprice AS value, l_partkey % 19 = 0 AS no_unit, l_partkey % 29 = 0 AS wrong_source,
    l_linenumber - 2 AS lag, CAST(l_shipdate AS DATE) AS as_of_date,
    CASE WHEN l_partkey % 3 = 0 THEN 'A' END AS quality_grade, {Q.LINE_STATUS} AS validation_status FROM lineitem),
issues AS (
  SELECT *, CAST(market_id IS NULL AS INT) + CAST(no_unit AS INT) AS nulls,
    CAST(value < 100 OR value > 100000 AS INT) AS price_range,
    CAST(value * 10 < 0 OR value * 10 > 500000 AS INT) AS arrival_range,
    CAST(commodity_id <> 'cotton' AS INT) AS commodity_mapping,
    CAST(coalesce(market_id LIKE 'x%', false) AS INT) AS market_mapping,
    CAST(wrong_source AS INT) AS source, CAST(lag < 0 OR lag > 1 AS INT) AS dates FROM obs)"""


def _checked_prices(t: Tables) -> DataFrame:
    at = landed(t)
    return V.check_observations(
        at.stored_prices(), V.price_rules,
        {"market": ("market_id", at.dimension_markets()),
         "commodity": ("commodity_id", at.dimension_commodities())},
    )


def _checked_arrivals(t: Tables) -> DataFrame:
    at = landed(t)
    return V.check_observations(
        at.stored_arrivals(), V.arrival_rules,
        {"market": ("market_id", at.dimension_markets()),
         "commodity": ("commodity_id", at.dimension_commodities())},
    )


@check(
    f"""WITH {VALIDATION}
SELECT observation_id,
  CAST(nulls + price_range + commodity_mapping + market_mapping + source + dates AS BIGINT) AS issue_count,
  CASE WHEN validation_status <> 'received' THEN validation_status
    WHEN nulls + price_range + commodity_mapping + market_mapping + source + dates = 0 THEN 'validated' ELSE 'rejected' END AS new_status
FROM issues"""
)
def price_validation(t: Tables) -> DataFrame:
    promoted = V.promote(_checked_prices(t))
    return promoted.select(
        "observation_id", F.size("issues").cast("long").alias("issue_count"), "new_status"
    )


@check(
    f"""WITH {VALIDATION}
SELECT "check", sum(n)::BIGINT AS issue_count FROM (
  SELECT 'null_fields' AS "check", nulls AS n FROM issues UNION ALL SELECT 'arrival_range', arrival_range FROM issues
  UNION ALL SELECT 'commodity_mapping', commodity_mapping FROM issues UNION ALL SELECT 'market_mapping', market_mapping FROM issues
  UNION ALL SELECT 'source', source FROM issues UNION ALL SELECT 'date_consistency', dates FROM issues)
GROUP BY ALL HAVING sum(n) > 0"""
)
def arrival_issue_histogram(t: Tables) -> DataFrame:
    return V.issue_histogram(_checked_arrivals(t))


@check(
    f"""WITH {VALIDATION}
SELECT 'price' AS table_name, count(*) AS examined,
  count(*) FILTER (nulls + price_range + commodity_mapping + market_mapping + source + dates = 0) AS validated,
  count(*) FILTER (nulls + price_range + commodity_mapping + market_mapping + source + dates > 0) AS rejected
FROM issues WHERE validation_status = 'received'
UNION ALL SELECT 'arrival', count(*),
  count(*) FILTER (nulls + arrival_range + commodity_mapping + market_mapping + source + dates = 0),
  count(*) FILTER (nulls + arrival_range + commodity_mapping + market_mapping + source + dates > 0)
FROM issues WHERE validation_status = 'received'"""
)
def promotion_summary(t: Tables) -> DataFrame:
    return V.promotion_summary(V.promote(_checked_prices(t)), "price").unionByName(
        V.promotion_summary(V.promote(_checked_arrivals(t)), "arrival")
    )


@check(
    f"""WITH {VALIDATION}
SELECT table_name, count(*) AS pending FROM (SELECT 'price' AS table_name, validation_status FROM obs
  UNION ALL SELECT 'arrival', validation_status FROM obs) WHERE validation_status = 'received' GROUP BY ALL"""
)
def pending_counts(t: Tables) -> DataFrame:
    at = landed(t)
    return V.pending_counts({"price": at.stored_prices(), "arrival": at.stored_arrivals()})


@check(
    f"""WITH {VALIDATION}, cats AS (
  SELECT 'price' AS tab, price_type, market_id, validation_status, nulls > 0 AS c1, commodity_mapping + market_mapping + source > 0 AS c2,
    dates > 0 AS c3, price_range > 0 AS c4, validation_status <> 'validated' AS c5 FROM issues
  UNION ALL SELECT 'arrival', NULL, market_id, validation_status, nulls > 0, commodity_mapping + market_mapping + source > 0,
    dates > 0, arrival_range > 0, validation_status <> 'validated' FROM issues)
SELECT 'category' AS breakdown, label, count(*) AS row_count FROM (
  SELECT unnest(list_filter([CASE WHEN c1 THEN 'missing_fields' END, CASE WHEN c2 THEN 'mapping_failures' END,
    CASE WHEN c3 THEN 'stale_observations' END, CASE WHEN c4 THEN 'value_range' END, CASE WHEN c5 THEN 'non_validated_status' END,
    CASE WHEN NOT (c1 OR c2 OR c3 OR c4 OR c5) THEN 'clean_data_pending_validation' END], lambda x: x IS NOT NULL)) AS label FROM cats) GROUP BY ALL
UNION ALL SELECT 'validation_status', validation_status, count(*) FROM cats GROUP BY ALL
UNION ALL SELECT 'price_type', price_type, count(*) FROM cats WHERE price_type IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'market_id', market_id, count(*) FROM cats WHERE market_id IS NOT NULL GROUP BY ALL"""
)
def anomaly_breakdown(t: Tables) -> DataFrame:
    both = V.categorise(_checked_prices(t), "price").unionByName(
        V.categorise(_checked_arrivals(t), "arrival"), allowMissingColumns=True
    )
    return V.anomaly_breakdown(both)


@check(
    f"""WITH {VALIDATION}, d AS (
  SELECT count(*) AS n FROM obs GROUP BY market_id, as_of_date, price_type HAVING count(*) > 1),
e AS (SELECT count(*) AS n FROM obs GROUP BY market_id, as_of_date HAVING count(*) > 1)
SELECT 'price' AS table_name, count(*) AS duplicate_keys, sum(n - 1)::BIGINT AS surplus_rows FROM d
UNION ALL SELECT 'arrival', count(*), sum(n - 1)::BIGINT FROM e"""
)
def duplicate_statistics(t: Tables) -> DataFrame:
    at = landed(t)
    return V.duplicate_keys(
        at.stored_prices(), ["market_id", "as_of_date", "price_type"], "price"
    ).unionByName(V.duplicate_keys(at.stored_arrivals(), ["market_id", "as_of_date"], "arrival"))


@check(
    f"""WITH {VALIDATION}
SELECT DISTINCT market_id FROM obs WHERE market_id IS NULL OR market_id NOT IN (SELECT 'm' || s_suppkey FROM supplier)"""
)
def missing_references(t: Tables) -> DataFrame:
    at = landed(t)
    return V.missing_references(at.stored_prices(), "market_id", at.dimension_markets())


@check(
    f"""WITH {VALIDATION}
SELECT 'price' AS table_name, count(*) FILTER (as_of_date < DATE '1998-01-01') AS rows_before,
  count(*) FILTER (as_of_date >= DATE '1998-01-01') AS rows_inserted, count(*) AS rows_after FROM obs"""
)
def load_reconciliation(t: Tables) -> DataFrame:
    rows, cut = landed(t).stored_prices(), F.lit(dt.date(1998, 1, 1))
    return V.reconcile(
        rows.filter(F.col("as_of_date") < cut), rows.filter(F.col("as_of_date") >= cut), "price"
    )


@check(
    f"""WITH {VALIDATION}
SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, market_id, price_type, observation_id FROM obs
WHERE market_id IS NOT NULL ORDER BY as_of_date, market_id, price_type, observation_id LIMIT 5"""
)
def ordered_samples(t: Tables) -> DataFrame:
    order = ["as_of_date", "market_id", "price_type", "observation_id"]
    rows = landed(t).stored_prices().filter("market_id IS NOT NULL").select(*order)
    return V.ordered_sample(rows, order)


@check(
    f"""WITH {Q.WEATHER}
SELECT observation_id, CASE WHEN rainfall_mm IS NULL OR rainfall_mm > 500 THEN 'rain'
  WHEN temperature_mean_c IS NULL THEN 'temperature' ELSE 'good' END AS outcome FROM (
  SELECT observation_id, CASE WHEN rainfall_mm > 35 THEN 999.0 ELSE rainfall_mm END AS rainfall_mm, temperature_mean_c FROM weather) """
)
def weather_validation(t: Tables) -> DataFrame:
    """First failing rule only; heavy rain is blown up to fail its range."""
    rows = t.weather().select(
        "observation_id",
        F.lit("cotton").alias("commodity_id"),
        "region_id",
        F.lit("nasa_power").alias("source"),
        F.when(F.col("rainfall_mm") > 35, 999.0).otherwise(F.col("rainfall_mm")).alias("rainfall_mm"),
        "temperature_mean_c",
    )
    checked = V.check_observations(
        rows, V.weather_rules,
        {"commodity": ("commodity_id", landed(t).dimension_commodities()),
         "region": ("region_id", t.weather().select("region_id"))},
        first_only=True,
    )
    message = F.try_element_at(F.col("issues.message"), F.lit(1))
    outcome = (
        F.when(message.startswith("rain"), "rain")
        .when(message.startswith("temperature"), "temperature")
        .otherwise(F.coalesce(message, F.lit("good")))
    )
    return checked.select("observation_id", outcome.alias("outcome"))


@check(
    f"""WITH {Q.SIGNALS}
SELECT signal_id, magnitude > 0.02 AS rejected FROM signals"""
)
def signal_constraints(t: Tables) -> DataFrame:
    """Scaled magnitudes leave the unit range above 0.02."""
    rows = t.signals().withColumn("magnitude", F.col("magnitude") * 50)
    good, bad = V.constraints(rows, V.SIGNAL())
    return good.select("signal_id", F.lit(False).alias("rejected")).unionByName(
        bad.select("signal_id", F.lit(True).alias("rejected"))
    )


WINDOW = (dt.date(1997, 1, 1), dt.date(1997, 12, 31))
IN_WINDOW = "CAST(l_shipdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"


@check(
    f"""SELECT s_suppkey AS market_id, count(l_suppkey) AS row_count, count(DISTINCT l_shipdate) AS distinct_days,
  CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last_day
FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE {IN_WINDOW}) ON l_suppkey = s_suppkey GROUP BY ALL"""
)
def entity_coverage(t: Tables) -> DataFrame:
    rows = t.arrivals().filter(F.col("as_of_date").between(*map(F.lit, WINDOW)))
    return C.entity_coverage(rows, t.markets(), "market_id")


@check(
    f"""SELECT count(*) AS row_count, count(DISTINCT l_suppkey) AS entities_with_data,
  count(DISTINCT l_shipdate) AS distinct_days, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS first_day,
  CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last_day FROM lineitem WHERE {IN_WINDOW}"""
)
def coverage_total(t: Tables) -> DataFrame:
    rows = t.arrivals().filter(F.col("as_of_date").between(*map(F.lit, WINDOW)))
    return C.coverage_total(rows, t.markets(), "market_id")


@check(
    f"""WITH present AS (SELECT DISTINCT l_suppkey AS market_id, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE {IN_WINDOW}),
days AS (SELECT CAST(unnest(generate_series(DATE '1997-01-01', DATE '1997-12-31', INTERVAL 1 DAY)) AS DATE) AS d),
absent AS (
  SELECT s_suppkey AS market_id, days.d FROM supplier CROSS JOIN days
  LEFT JOIN present p ON p.market_id = s_suppkey AND p.d = days.d WHERE p.d IS NULL),
runs AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY market_id ORDER BY d) AS INTEGER) AS grp FROM absent)
SELECT market_id, CAST(min(d) AS VARCHAR) AS gap_start, CAST(max(d) AS VARCHAR) AS gap_end, count(*) AS gap_days
FROM runs GROUP BY market_id, grp"""
)
def missing_periods(t: Tables) -> DataFrame:
    return C.missing_periods(t.arrivals(), t.markets(), "market_id", *map(F.lit, WINDOW))


@check(
    f"""WITH {Q.PRICES}
SELECT observation_id, series_id, CAST(as_of_date AS VARCHAR) AS as_of_date FROM prices
WHERE as_of_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND series_id = 'ECONOMY'"""
)
def date_range_scan(t: Tables) -> DataFrame:
    return tables.date_range(t.prices(), *WINDOW, series_id="ECONOMY").select(
        "observation_id", "series_id", "as_of_date"
    )


@check(
    f"""WITH {Q.PRICES}
SELECT observation_id, CAST(as_of_date AS VARCHAR) AS as_of_date FROM prices WHERE observed_at <= TIMESTAMP '1997-06-30 23:59:59.999999'"""
)
def visible_at_cutoff(t: Tables) -> DataFrame:
    return tables.visible_at(t.prices(), F.lit(dt.date(1997, 6, 30))).select(
        "observation_id", "as_of_date"
    )


@check(
    f"""WITH {Q.WEATHER}, changed AS (SELECT region_id, as_of_date, max(observation_id) AS observation_id FROM weather GROUP BY ALL)
SELECT region_id, CAST(as_of_date AS VARCHAR) AS as_of_date,
  CASE WHEN as_of_date >= DATE '1998-01-01' THEN 'new' ELSE 'old' END AS version FROM changed"""
)
def keyed_upsert(t: Tables) -> DataFrame:
    keys = ["region_id", "as_of_date"]
    old = t.weather().select(*keys).distinct().withColumn("version", F.lit("old"))
    cut = F.lit(dt.date(1998, 1, 1))
    new = old.filter(F.col("as_of_date") >= cut).withColumn("version", F.lit("new"))
    return D.upsert(old, new, keys, ["version"])
