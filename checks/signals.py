"""Quality, snapshots, features, signal quality and daily summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql as Q
from checks.base import check
from tidemark.adapters import Tables
from tidemark.functions import canonical as J
from tidemark.functions import quality as K
from tidemark.functions import scores as S
from tidemark.operators import dedupe as D
from tidemark.plans import features as X
from tidemark.plans import quality as P
from tidemark.plans import snapshots as N
from tidemark.plans.summary import daily_summary

AGENT_KEY = ["commodity_id", "as_of_date", "registry_id", "agent_type"]
ORDER = ["as_of_timestamp", "signal_id"]

LATEST = Q.SIGNALS + """,
latest AS (
  SELECT * FROM signals QUALIFY row_number() OVER (
    PARTITION BY commodity_id, as_of_date, registry_id, agent_type ORDER BY as_of_timestamp DESC, signal_id DESC) = 1)"""


def latest_signals(t: Tables) -> DataFrame:
    return D.latest_per_key(t.signals(), AGENT_KEY, ORDER)


QUALITY_RAW = """least(greatest(0.4::DOUBLE * coverage + 0.35::DOUBLE * completeness + 0.25::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - lag_hours / 168.0::DOUBLE)
      - CASE WHEN anomaly_count > 0 THEN least(0.3::DOUBLE, anomaly_count / proxy_rows::DOUBLE) ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 1.0::DOUBLE)"""


def quality_sql(entity: str, source: str, expected: str, extra: str = "") -> str:
    """30-day quality window ending on each day with rows."""
    return f"""day0 AS (
  SELECT series_id, as_of_date, count(DISTINCT {entity}) AS reporting, max(observed_at) AS seen,
    count(*) FILTER (validation_status NOT IN ('validated', 'published')) AS bad FROM {source} GROUP BY ALL),
day1 AS (
  SELECT d.* EXCLUDE (bad), bad {extra} AS bad FROM day0 d),
framed AS (
  SELECT series_id, as_of_date, ({expected}) AS expected, reporting, count(*) OVER w AS days_with_data,
    max(seen) OVER w AS latest_observed_at, CAST(sum(bad) OVER w AS BIGINT) AS anomaly_count
  FROM day1 WINDOW w AS (PARTITION BY series_id ORDER BY as_of_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)),
metrics AS (
  SELECT *, least(1.0::DOUBLE, reporting / expected::DOUBLE) AS coverage, least(1.0::DOUBLE, days_with_data / 30.0::DOUBLE) AS completeness,
    greatest(0.0::DOUBLE, (epoch_us(CAST(as_of_date + 1 AS TIMESTAMP)) - epoch_us(latest_observed_at)) / 3600000000.0::DOUBLE) AS lag_hours,
    greatest(days_with_data * greatest(reporting, 1), 1) AS proxy_rows FROM framed),
scored AS (
  SELECT *, CASE WHEN reporting = 0 THEN 'missing' WHEN lag_hours > 48 THEN 'stale'
      WHEN coverage < 0.5 OR completeness < 0.25 THEN 'stale' ELSE 'fresh' END AS health,
    {Q.text_round(QUALITY_RAW)} AS score FROM metrics)"""


def dense_quality_sql(spine: str, days: str, expected: str) -> str:
    """Quality of every (series, day) of ``spine`` from ``days`` (reporting, seen, bad), silent days included."""
    return f"""timeline AS (
  SELECT s.series_id, s.as_of_date, d.reporting, d.seen, coalesce(d.bad, 0) AS bad
  FROM {spine} s LEFT JOIN {days} d ON d.series_id = s.series_id AND d.as_of_date = s.as_of_date),
framed AS (
  SELECT series_id, as_of_date, ({expected}) AS expected,
    coalesce(last_value(CASE WHEN reporting > 0 THEN reporting END IGNORE NULLS) OVER w, 0) AS reporting,
    count(CASE WHEN reporting > 0 THEN 1 END) OVER w AS days_with_data, max(seen) OVER w AS latest_observed_at,
    CAST(sum(bad) OVER w AS BIGINT) AS anomaly_count
  FROM timeline WINDOW w AS (PARTITION BY series_id ORDER BY as_of_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)),
metrics AS (
  SELECT *, least(1.0::DOUBLE, reporting / expected::DOUBLE) AS coverage, least(1.0::DOUBLE, days_with_data / 30.0::DOUBLE) AS completeness,
    CASE WHEN latest_observed_at IS NOT NULL THEN greatest(0.0::DOUBLE, (epoch_us(CAST(as_of_date + 1 AS TIMESTAMP)) - epoch_us(latest_observed_at)) / 3600000000.0::DOUBLE) END AS lag_hours,
    greatest(days_with_data * greatest(reporting, 1), 1) AS proxy_rows FROM framed),
scored AS (
  SELECT *, CASE WHEN reporting = 0 THEN 'missing' WHEN lag_hours > 48 THEN 'stale'
      WHEN coverage < 0.5 OR completeness < 0.25 THEN 'stale' ELSE 'fresh' END AS health,
    {Q.text_round(QUALITY_RAW.replace('lag_hours', 'coalesce(lag_hours, 0)'))} AS score FROM metrics)"""


MARKET_QUALITY = f"""WITH {Q.PRICES}, {Q.ARRIVALS}, """ + quality_sql(
    "market_id", "prices", "SELECT count(*) FROM supplier",
    "+ (SELECT count(*) FROM arrivals a WHERE a.series_id = d.series_id AND a.as_of_date = d.as_of_date AND a.validation_status = 'received')",
)


def market_metrics(t: Tables) -> DataFrame:
    daily = P.daily_source(t.prices(), "market_id", [t.arrivals()])
    return P.source_metrics(daily, t.markets())


@check(
    MARKET_QUALITY + """
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, expected, reporting, CAST(as_of_date AS VARCHAR) AS latest_day, days_with_data,
  strftime(latest_observed_at, '%Y-%m-%d %H:%M:%S') AS latest_observed_at, anomaly_count, round(coverage, 4) AS coverage,
  round(completeness, 4) AS completeness, round(lag_hours, 2) AS lag_hours FROM scored"""
)
def market_source_metrics(t: Tables) -> DataFrame:
    four = {"coverage": 4, "completeness": 4, "lag_hours": 2}
    metrics = market_metrics(t)
    return metrics.select(
        *[F.round(c, four[c]).alias(c) if c in four else F.col(c) for c in metrics.columns]
    )


@check(
    f"""WITH {Q.PRICES}, {Q.ARRIVALS},
loads AS (SELECT series_id, as_of_date, count(*) FILTER (validation_status = 'received') AS bad FROM arrivals GROUP BY ALL),
quotes AS (
  SELECT series_id, as_of_date, count(DISTINCT market_id) AS reporting, max(observed_at) AS seen,
    count(*) FILTER (validation_status = 'received') AS bad FROM prices GROUP BY ALL),
days AS (SELECT q.* EXCLUDE (bad), q.bad + l.bad AS bad FROM quotes q JOIN loads l USING (series_id, as_of_date)),
span AS (SELECT series_id, min(as_of_date) AS lo, (SELECT max(as_of_date) + 30 FROM prices) AS hi FROM prices GROUP BY ALL),
spine AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS as_of_date FROM span),
""" + dense_quality_sql("spine", "days", "SELECT count(*) FROM supplier") + """
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, health, days_with_data, reporting, anomaly_count,
  round(completeness, 4) AS completeness, round(lag_hours, 2) AS lag_hours, score FROM scored"""
)
def silent_day_quality(t: Tables) -> DataFrame:
    """Quality of every calendar day of a series, until 30 days behind the last day of all."""
    prices = t.prices()
    last = prices.agg(F.date_add(F.max("as_of_date"), 30).alias("_end")).scalar()
    spans = prices.groupBy("series_id").agg(F.min("as_of_date").alias("_start")).withColumn("_end", last)
    metrics = P.source_metrics(
        P.daily_source(prices, "market_id", [t.arrivals()]), t.markets(),
        anchors=P.calendar_anchors(spans, F.col("_start"), F.col("_end")),
    )
    return P.scored(metrics).select(
        "series_id", "as_of_date", "health", "days_with_data", "reporting", "anomaly_count",
        F.round("completeness", 4).alias("completeness"), F.round("lag_hours", 2).alias("lag_hours"), "score",
    )


@check(
    f"""WITH {Q.WEATHER}, """ + quality_sql("region_id", "weather", "SELECT count(DISTINCT region_id) FROM weather") + """
SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, expected, reporting, days_with_data, anomaly_count,
  round(coverage, 4) AS coverage, health, score FROM scored"""
)
def weather_source_quality(t: Tables) -> DataFrame:
    daily = P.daily_source(t.weather(), "region_id")
    metrics = P.scored(P.source_metrics(daily, t.weather().select("region_id")))
    return metrics.select(
        "as_of_date", "expected", "reporting", "days_with_data", "anomaly_count",
        F.round("coverage", 4).alias("coverage"), "health", "score",
    )


@check(
    MARKET_QUALITY + """
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, health AS market_health, anomaly_count, round(lag_hours, 2) AS lag_hours,
  score AS overall_quality_score, round(1.0::DOUBLE - score, 4) AS confidence_penalty_factor, false AS futures_feed_ok FROM scored"""
)
def quality_snapshots(t: Tables) -> DataFrame:
    return P.quality_snapshots(market_metrics(t)).select(
        "series_id", "as_of_date", "market_health", "anomaly_count", "lag_hours",
        "overall_quality_score", "confidence_penalty_factor", "futures_feed_ok",
    )


@check(
    MARKET_QUALITY + f""", {Q.WEATHER.replace('weather0', 'w0').replace('weather AS', 'belt_rows AS')},
wday AS (
  SELECT as_of_date, count(DISTINCT region_id) AS reporting, max(observed_at) AS seen,
    count(*) FILTER (validation_status NOT IN ('validated', 'published')) AS bad FROM belt_rows GROUP BY ALL),
wframe AS (
  SELECT *, count(*) OVER w AS days, max(seen) OVER w AS latest, sum(bad) OVER w AS anomalies FROM wday
  WINDOW w AS (ORDER BY as_of_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)),
wscore AS (
  SELECT as_of_date, {Q.text_round('''least(greatest(0.4::DOUBLE * least(1.0::DOUBLE, reporting / 5.0::DOUBLE) + 0.35::DOUBLE * least(1.0::DOUBLE, days / 30.0::DOUBLE)
    + 0.25::DOUBLE * (1.0::DOUBLE - ((epoch_us(CAST(as_of_date + 1 AS TIMESTAMP)) - epoch_us(latest)) / 3600000000.0::DOUBLE) / 168.0::DOUBLE)
    - CASE WHEN anomalies > 0 THEN least(0.3::DOUBLE, CAST(anomalies AS BIGINT) / greatest(days * reporting, 1)::DOUBLE) ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 1.0::DOUBLE)''')} AS wscore FROM wframe)
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date,
  CASE WHEN wscore IS NULL THEN score
    ELSE CAST(round((CAST(score AS DECIMAL(9,4)) + CAST(wscore AS DECIMAL(9,4))) * 0.5, 4) AS DOUBLE) END AS blended_score
FROM scored LEFT JOIN wscore USING (as_of_date)"""
)
def blended_quality(t: Tables) -> DataFrame:
    weather = P.source_metrics(
        P.daily_source(t.weather(), "region_id"), t.weather().select("region_id")
    )
    rows = P.quality_snapshots(market_metrics(t), weather)
    return rows.select(
        "series_id", "as_of_date",
        F.col("overall_quality_score").alias("blended_score"),
    )


@check(
    MARKET_QUALITY + """, impact AS (
  SELECT *, anomaly_count // 2 AS validated, anomaly_count // 5 AS rejected,
    greatest(0, anomaly_count - anomaly_count // 2) + anomaly_count // 5 AS after FROM scored)
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date,
  round(CASE WHEN anomaly_count > 0 THEN least(0.3::DOUBLE, anomaly_count / proxy_rows::DOUBLE) ELSE 0.0::DOUBLE END, 4) AS penalty_before,
  round(CASE WHEN after > 0 THEN least(0.3::DOUBLE, after / proxy_rows::DOUBLE) ELSE 0.0::DOUBLE END, 4) AS penalty_after, score AS score_before
FROM impact"""
)
def promotion_impact(t: Tables) -> DataFrame:
    half = F.floor(F.col("anomaly_count") / 2)
    fifth = F.floor(F.col("anomaly_count") / 5)
    return P.promotion_impact(market_metrics(t), half, fifth).drop("score_after")


@check(
    f"""WITH {LATEST}, snap AS (
  SELECT commodity_id, as_of_date, registry_id, count(*) AS signal_count,
    string_agg('{{"as_of_date":"' || CAST(as_of_date AS VARCHAR) || '","signal_confidence":"' || CAST(confidence AS VARCHAR)
      || '","signal_direction":"' || direction || '","signal_inputs":{{"k":"' || k || '"}},"signal_magnitude":"' || CAST(magnitude AS VARCHAR)
      || '","signal_type":"' || agent_type || '"}}', ',' ORDER BY agent_type) AS body FROM latest GROUP BY ALL)
SELECT commodity_id, CAST(as_of_date AS VARCHAR) AS as_of_date, registry_id, signal_count,
  sha256('{{"as_of_date":"' || CAST(as_of_date AS VARCHAR) || '","commodity_id":"' || commodity_id || '","registry_id":"' || registry_id
    || '","signals":[' || body || ']}}') AS snapshot_hash FROM snap"""
)
def signal_snapshots(t: Tables) -> DataFrame:
    return N.snapshots(t.signals(), ORDER).select(
        "commodity_id", "as_of_date", "registry_id", "signal_count", "snapshot_hash"
    )


@check(
    f"""WITH {LATEST}
SELECT commodity_id, CAST(as_of_date AS VARCHAR) AS as_of_date, 'signal_' || lower(agent_type) || '_confidence' AS name, CAST(confidence AS VARCHAR) AS value FROM latest
UNION ALL SELECT commodity_id, CAST(as_of_date AS VARCHAR), 'signal_' || lower(agent_type) || '_k', k FROM latest"""
)
def snapshot_features(t: Tables) -> DataFrame:
    rows = N.snapshots(t.signals(), ORDER)
    return rows.select(
        "commodity_id", "as_of_date", F.explode(N.flat_features(rows)).alias("name", "value")
    )


REQUIRED = "'Market', 'Futures'"


@check(
    f"""WITH {LATEST}, grp AS (
  SELECT commodity_id, as_of_date, registry_id, count(*) AS signal_count, min(confidence) AS lo, max(confidence) AS hi,
    round(avg(confidence::DOUBLE), 4) AS mean_confidence, max(as_of_timestamp) AS newest,
    count(*) FILTER (agent_type IN ({REQUIRED})) AS hits,
    list(agent_type ORDER BY agent_type) AS agents,
    string_agg(agent_type || '=' || CAST(confidence AS VARCHAR), ',' ORDER BY agent_type) AS by_agent FROM latest GROUP BY ALL)
SELECT commodity_id, CAST(as_of_date AS VARCHAR) AS as_of_date, signal_count, true AS snapshot_present, true AS snapshot_aligned,
  signal_count / 6.0::DOUBLE AS coverage_ratio, hits / 2.0::DOUBLE AS required_coverage_ratio,
  array_to_string(list_filter(['Market', 'Futures'], lambda a: NOT list_contains(agents, a)), ',') AS signals_missing,
  array_to_string(list_filter(['Weather', 'Policy', 'Demand', 'Global'], lambda a: NOT list_contains(agents, a)), ',') AS optional_missing,
  round((epoch_us(CAST(as_of_date + 1 AS TIMESTAMP)) - epoch_us(newest)) / 3600000000.0::DOUBLE, 2) AS signal_lag_hours, 'fresh' AS freshness,
  CAST(lo AS DOUBLE) AS min_confidence, CAST(hi AS DOUBLE) AS max_confidence, mean_confidence, by_agent FROM grp"""
)
def signal_quality(t: Tables) -> DataFrame:
    registries = t.signals().select("registry_id").distinct().select(
        "registry_id",
        F.array(F.lit("Market"), F.lit("Futures")).alias("required_agents"),
        F.array(*[F.lit(a) for a in ("Weather", "Policy", "Demand", "Global")]).alias(
            "optional_agents"
        ),
    )
    rows = P.signal_quality(latest_signals(t), registries, N.snapshots(t.signals(), ORDER))
    pairs = F.transform(
        F.array_sort(F.map_entries("confidence_by_agent")),
        lambda e: F.concat_ws("=", e.getField("key"), e.getField("value")),
    )
    return rows.select(
        "commodity_id", "as_of_date", "signal_count", "snapshot_present", "snapshot_aligned",
        "coverage_ratio", "required_coverage_ratio",
        F.array_join("signals_missing", ",").alias("signals_missing"),
        F.array_join("optional_agents_missing", ",").alias("optional_missing"),
        "signal_lag_hours", "freshness", "min_confidence", "max_confidence", "mean_confidence",
        F.array_join(pairs, ",").alias("by_agent"),
    )


def assembled(t: Tables) -> DataFrame:
    rows = latest_signals(t).withColumn(
        "value", S.signed_value(F.col("direction"), F.col("magnitude")).cast("decimal(5,4)")
    )
    return X.assemble(X.agent_rows(rows))


STUB = """SELECT unnest(['futures.direction', 'futures.magnitude', 'futures.confidence', 'futures.value', 'futures.stub',
    'futures.components.curve_slope', 'futures.components.curve_level_near', 'futures.components.open_interest_change',
    'futures.components.basis_futures_spot', 'futures.components.carry_implied_30', 'futures.components.carry_implied_60',
    'futures.components.carry_implied_90', 'futures.components.stub']) AS name,
  unnest(['neutral', '0', '0', '0', 'true', '0.0', NULL, '0.0', '0.0', '0.0', '0.0', '0.0', 'true']) AS value"""


FEATURE_ROWS = f"""{LATEST}, three AS (SELECT *, lower(agent_type) AS p FROM latest WHERE agent_type IN ('Market', 'Weather', 'Futures')),
days AS (SELECT DISTINCT commodity_id, as_of_date FROM latest), stub AS ({STUB}),
feature_rows AS (
  SELECT commodity_id, as_of_date, p || '.direction' AS name, direction AS value FROM three
  UNION ALL SELECT commodity_id, as_of_date, p || '.magnitude', CAST(magnitude AS VARCHAR) FROM three
  UNION ALL SELECT commodity_id, as_of_date, p || '.confidence', CAST(confidence AS VARCHAR) FROM three
  UNION ALL SELECT commodity_id, as_of_date, p || '.value', CAST(CAST(({Q.sign('direction')}) * magnitude AS DECIMAL(5,4)) AS VARCHAR) FROM three
  UNION ALL SELECT commodity_id, as_of_date, p || '.components.k', k FROM three
  UNION ALL SELECT d.commodity_id, d.as_of_date, s.name, s.value FROM days d CROSS JOIN stub s
    WHERE NOT EXISTS (SELECT 1 FROM three x WHERE x.p = 'futures' AND x.commodity_id = d.commodity_id AND x.as_of_date = d.as_of_date))"""


@check(
    f"""WITH {FEATURE_ROWS}
SELECT commodity_id, CAST(as_of_date AS VARCHAR) AS as_of_date, name, value FROM feature_rows"""
)
def feature_vectors(t: Tables) -> DataFrame:
    return X.feature_vectors(assembled(t)).drop("registry_id")


@check(
    f"""WITH {FEATURE_ROWS}, sets AS (
  SELECT commodity_id, as_of_date, count(*) AS feature_count,
    string_agg('"' || name || '":' || coalesce('"' || value || '"', 'null'), ',' ORDER BY name) AS body,
    count(*) FILTER (name = 'market.value') AS m, count(*) FILTER (name = 'weather.value') AS w,
    count(*) FILTER (name = 'futures.stub') AS s FROM feature_rows GROUP BY ALL)
SELECT commodity_id, CAST(as_of_date AS VARCHAR) AS as_of_date, feature_count,
  sha256('{{"as_of_date":"' || CAST(as_of_date AS VARCHAR) || '","assembly_version":"1","commodity_id":"' || commodity_id
    || '","feature_values":{{' || body || '}},"registry_id":"r1"}}') AS feature_hash,
  '{{"assembly_version":"1","agents":[' || CASE WHEN m = 1 THEN '{{"agent":"market","is_stub":false}},' ELSE '' END
    || CASE WHEN w = 1 THEN '{{"agent":"weather","is_stub":false}},' ELSE '' END
    || '{{"agent":"futures","is_stub":' || CASE WHEN s = 1 THEN 'true' ELSE 'false' END || '}}]}}' AS lineage FROM sets"""
)
def feature_sets(t: Tables) -> DataFrame:
    rows = assembled(t)
    return rows.select(
        "commodity_id", "as_of_date", F.size("feature_values").alias("feature_count"),
        "feature_hash", F.to_json("feature_lineage").alias("lineage"),
    )


@check(
    f"""WITH {Q.SIGNALS}
SELECT signal_id, CASE direction WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END::DOUBLE AS coded,
  CAST(k AS DOUBLE) AS number, CAST(NULL AS DOUBLE) AS bad, 0.0::DOUBLE AS bad_coded FROM signals"""
)
def coerced_values(t: Tables) -> DataFrame:
    k = F.col("signal_components").getItem("k")
    return t.signals().select(
        "signal_id",
        S.coded_number(F.col("direction")).alias("coded"),
        S.number_or_null(k).alias("number"),
        S.number_or_null(F.col("agent_type")).alias("bad"),
        S.coded_number(F.col("agent_type")).alias("bad_coded"),
    )


@check(
    """SELECT event_id, sha256('{"k":' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '"' || CAST(json_extract(props, '$.k') AS VARCHAR) || '"' END
  || ',"user":"' || user_id || '"}') AS config_hash FROM events"""
)
def canonical_digest(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    text = J.json_object(
        {
            "user": J.quoted(F.col("user_id").cast("string")),
            "k": J.quoted(F.when(F.col("event_id") % 5 != 0, k)),
        }
    )
    return t.read("events").select("event_id", J.digest(text).alias("config_hash"))


@check(
    """SELECT event_id, round(least(0.3::DOUBLE, CAST(json_extract(props, '$.k') AS DOUBLE) / 72.0::DOUBLE), 4) AS nested_penalty,
  0.0::DOUBLE AS text_penalty FROM events"""
)
def lag_penalty_lookup(t: Tables) -> DataFrame:
    """Lag found under the source's detail; a plain health word means no penalty."""
    k = F.get_json_object("props", "$.k")
    nested = F.concat(
        F.lit('{"agmarknet":{"detail":{"agmarknet_lag_hours":'), k, F.lit("}}}")
    )
    plain = F.lit('{"agmarknet":"fresh"}')
    return t.read("events").select(
        "event_id",
        K.lag_penalty_from_json(nested).alias("nested_penalty"),
        K.lag_penalty_from_json(plain).alias("text_penalty"),
    )


def forecasts(t: Tables) -> DataFrame:
    """Forecast versions per commodity and day, several generations, some unpublished."""
    horizon = lambda h: F.when(
        F.col("event_id") % (h // 10) != 0,
        F.struct(
            F.round(F.col("value") * h, 2).alias("point"),
            F.round(F.col("value") * h - 10, 2).alias("band_low"),
            F.round(F.col("value") * h + 10, 2).alias("band_high"),
            F.lit("neutral").alias("direction"),
            F.round(F.col("value") / 500.0, 4).alias("forecast_confidence"),
        ),
    )
    return t.read("events").select(
        F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("commodity_id"),
        F.to_date("ts").alias("as_of_date"),
        F.lit("r1").alias("registry_id"),
        F.col("event_id").alias("forecast_version_id"),
        F.col("ts").alias("generated_at"),
        (F.col("event_id") % 4 == 1).alias("is_published"),
        *[horizon(h).alias(f"horizon_{h}") for h in (30, 60, 90)],
    )


@check(
    f"""WITH {LATEST}, snap AS (SELECT commodity_id, as_of_date, count(*) AS n FROM latest GROUP BY ALL),
fc AS (
  SELECT *, 'c' || CAST(user_id % 4 AS VARCHAR) AS commodity_id, CAST(ts AS DATE) AS as_of_date FROM events WHERE event_id % 4 = 1
  QUALIFY row_number() OVER (PARTITION BY user_id % 4, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1)
SELECT snap.commodity_id, CAST(snap.as_of_date AS VARCHAR) AS as_of_date, event_id AS forecast_version_id,
  NULLIF(CAST(event_id % 3 <> 0 AS BIGINT) + CAST(event_id % 6 <> 0 AS BIGINT) + CAST(event_id % 9 <> 0 AS BIGINT), 0) AS horizon_count,
  CASE WHEN event_id % 3 <> 0 THEN round(value / 500.0::DOUBLE, 4) END AS forecast_confidence_30,
  CASE WHEN event_id % 6 <> 0 THEN round(value / 500.0::DOUBLE, 4) END AS forecast_confidence_60,
  CASE WHEN event_id % 9 <> 0 THEN round(value / 500.0::DOUBLE, 4) END AS forecast_confidence_90,
  CASE WHEN n > 4 THEN n / 10.0::DOUBLE END AS overall_quality_score
FROM snap LEFT JOIN fc USING (commodity_id, as_of_date)"""
)
def daily_summaries(t: Tables) -> DataFrame:
    snap = N.snapshots(t.signals(), ORDER).withColumn("data_quality_snapshot_id", F.col("snapshot_id"))
    quality = snap.filter("signal_count > 4").select(
        F.col("snapshot_id").alias("quality_snapshot_id"),
        (F.col("signal_count") / 10.0).alias("overall_quality_score"),
    )
    rows = daily_summary(snap, forecasts(t), quality)
    return rows.select(
        "commodity_id", "as_of_date", "forecast_version_id",
        F.when(F.col("horizon_summaries").isNotNull(), F.size("horizon_summaries")).alias("horizon_count"),
        *[f"forecast_confidence_{h}" for h in (30, 60, 90)], "overall_quality_score",
    )
