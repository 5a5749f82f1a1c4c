"""Round trips through file formats, registries, audits and lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql as Q
from checks.base import check
from checks.forecast import TARGETS, dataset
from checks.signals import LATEST, ORDER, assembled, forecasts, latest_signals
from tidemark import fixed, schemas
from tidemark.adapters import Tables
from tidemark.functions import canonical as J
from tidemark.operators import basket as B
from tidemark.operators import replay as R
from tidemark.operators import validation as V
from tidemark.operators import versions as X
from tidemark.plans import features as P
from tidemark.plans import snapshots as N
from tidemark.plans.summary import published
from tidemark.session import scratch_folder
from tidemark.sources import feature_store as store
from tidemark.sources import files, seeds, tables


@check(
    f"""WITH {Q.WEATHER}, day AS (
  SELECT region_id, as_of_date, max_by(rainfall_mm, observation_id) FILTER (true) AS r, max(observation_id) AS k FROM weather GROUP BY ALL),
pick AS (SELECT w.* FROM weather w JOIN day d ON w.observation_id = d.k)
SELECT region_id AS district_name, CAST(as_of_date AS VARCHAR) AS as_of_date, rainfall_mm, temperature_mean_c, relative_humidity_pct
FROM pick WHERE rainfall_mm IS NOT NULL AND temperature_mean_c IS NOT NULL AND relative_humidity_pct IS NOT NULL"""
)
def weather_grid_points(t: Tables) -> DataFrame:
    """Daily values written as gridded documents per region and year, then read back."""
    keys = ["region_id", "as_of_date"]
    day = t.weather().groupBy(*keys).agg(
        F.max_by(
            F.struct("rainfall_mm", "temperature_mean_c", "relative_humidity_pct"),
            "observation_id",
        ).alias("w")
    )
    key = F.date_format("as_of_date", "yyyyMMdd")
    values = lambda name: F.map_from_entries(
        F.collect_list(F.struct(key, F.coalesce(F.col(f"w.{name}"), F.lit(-999.0))))
    )
    # A document holds one region's year: at most 366 entries.
    documents = day.groupBy("region_id", F.year("as_of_date").alias("_year")).agg(
        F.to_json(
            F.struct(
                F.struct(F.lit(-999.0).alias("fill_value")).alias("header"),
                F.struct(
                    F.struct(
                        values("rainfall_mm").alias("PRECTOTCORR"),
                        values("temperature_mean_c").alias("T2M"),
                        values("relative_humidity_pct").alias("RH2M"),
                    ).alias("parameter")
                ).alias("properties"),
            )
        ).alias("body")
    )
    parsed = documents.select(
        F.col("region_id").alias("district_name"),
        F.from_json("body", schemas.WEATHER_GRID).alias("d"),
    ).select("district_name", "d.*")
    return files.grid_points(parsed).drop("provenance")


@check(
    f"""WITH {TARGETS}
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, horizon_days, spot AS spot_price_level, target AS target_price_level,
  round(ln(target / spot), 8) AS target_log_return, 'v' || CAST(month(as_of_date) AS VARCHAR) AS extra FROM dataset"""
)
def supervised_lines(t: Tables) -> DataFrame:
    """Dataset rows written as JSON lines and read back with their open feature map."""
    rows = dataset(t).select(
        "as_of_date",
        F.col("series_id").alias("commodity_id"),
        "horizon_days",
        F.col("spot_price_level").cast("decimal(18,4)").alias("spot_price_level"),
        F.col("target_price_level").cast("decimal(18,4)").alias("target_price_level"),
        "target_log_return",
        F.lit(None).cast("string").alias("registry_id"),
        F.lit(None).cast("string").alias("snapshot_hash"),
        F.create_map(
            F.lit("extra"), F.concat(F.lit("v"), F.month("as_of_date").cast("string"))
        ).alias("features"),
    )
    back = files.supervised_rows(rows.select(files.supervised_json(rows).alias("value")))
    return back.filter("reject_reason IS NULL").select(
        F.col("commodity_id").alias("series_id"), "as_of_date", "horizon_days",
        "spot_price_level", "target_price_level",
        "target_log_return",
        F.col("features")["extra"].alias("extra"),
    )


@check(
    f"""WITH {LATEST}
SELECT commodity_id, CAST(as_of_date AS VARCHAR) AS as_of_date, 1.0::DOUBLE AS spot_price_level,
  coalesce(max(CAST(confidence AS DOUBLE)) FILTER (agent_type = 'Market'), 0) AS market_confidence,
  coalesce(max(CAST(k AS DOUBLE)) FILTER (agent_type = 'Futures'), 0) AS futures_k, 11::BIGINT AS columns FROM latest GROUP BY ALL"""
)
def training_matrix(t: Tables) -> DataFrame:
    """Snapshot features as a wide numeric matrix; five agents give ten columns and the spot."""
    snap = N.snapshots(t.signals(), ORDER)
    rows = snap.select(
        "commodity_id", "as_of_date", F.lit(1.0).alias("spot_price_level"),
        N.flat_features(snap).alias("features"),
    )
    matrix, names = P.training_matrix(rows)
    return matrix.select(
        "commodity_id", "as_of_date", "spot_price_level",
        F.col("signal_market_confidence").alias("market_confidence"),
        F.col("signal_futures_k").alias("futures_k"),
        F.lit(len(names)).cast("long").alias("columns"),
    )


def policy_rows(t: Tables) -> DataFrame:
    kind = F.element_at(
        F.array(*[F.lit(p) for p in fixed.POLICY_TYPES]),
        (F.col("o_custkey") % 4 + 1).cast("int"),
    )
    return t.read("orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.lit("cotton").alias("commodity_id"),
        kind.alias("policy_type"),
        F.lit("pib_manual").alias("source"),
        F.to_date("o_orderdate").alias("published_date"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderstatus")).alias("summary"),
    )


@check(
    """WITH p AS (
  SELECT o_orderkey AS event_id, o_custkey % 4 AS kind, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_custkey % 3 <> 0 THEN o_orderstatus ELSE '' END AS s FROM orders)
SELECT event_id FROM p WHERE event_id % 2 = 0
  AND NOT EXISTS (SELECT 1 FROM p q WHERE q.event_id % 2 = 1 AND q.kind = p.kind AND q.d = p.d AND q.s = p.s)
QUALIFY row_number() OVER (PARTITION BY kind, d, s ORDER BY event_id) = 1"""
)
def new_policy_events(t: Tables) -> DataFrame:
    """Even orders are incoming events, odd ones are stored."""
    rows = policy_rows(t)
    stored = rows.filter("event_id % 2 = 1")
    fresh = rows.filter("event_id % 2 = 0")
    return seeds.new_policy_events(fresh, stored, ["event_id"]).select("event_id")


def registry_rows(t: Tables) -> DataFrame:
    """Registry versions: suppliers are versions of their nation's commodity."""
    key = F.col("s_suppkey")
    agents = lambda *names: F.array(*[F.lit(n) for n in names])
    return t.read("supplier").select(
        F.concat(F.lit("r"), key.cast("string")).alias("registry_id"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("commodity_id"),
        key.cast("string").alias("version"),
        F.lit(dt.date(2024, 1, 1)).alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to"),
        F.lit(False).alias("is_active"),
        F.when(key % 7 == 0, agents("Market", "Nobody")).otherwise(agents("Market", "Futures"))
        .alias("required_agents"),
        F.when(key % 5 == 0, agents("Market", "Weather")).otherwise(agents("Weather"))
        .alias("optional_agents"),
        F.create_map(
            F.lit("Market"), F.when(key % 11 == 0, 0.6).otherwise(0.5), F.lit("Weather"), F.lit(0.5)
        ).alias("signal_weights"),
        F.when(key % 13 == 0, F.create_map(F.lit("formula_version"), F.lit("1")))
        .otherwise(
            F.create_map(
                F.lit("msp_proximity_pct"), F.lit("0.03"), F.lit("default_partial_sell_pct"),
                F.lit("0.5"), F.lit("formula_version"), F.lit("1"),
            )
        )
        .alias("decision_rules"),
        F.array(F.lit(30), F.lit(60), F.lit(90)).alias("forecast_horizons"),
        F.array(F.lit("NORMAL")).alias("regime_priority"),
    )


@check(
    """SELECT 'r' || s_suppkey AS registry_id,
  CAST(s_suppkey % 7 = 0 AS BIGINT) + CAST(s_suppkey % 5 = 0 AS BIGINT) + CAST(s_suppkey % 11 = 0 AS BIGINT) + CAST(s_suppkey % 13 = 0 AS BIGINT) AS issue_count FROM supplier"""
)
def registry_constraints(t: Tables) -> DataFrame:
    rows = registry_rows(t).withColumn("issues", V.issues(V.registry_rules()))
    return rows.select("registry_id", F.size("issues").alias("issue_count"))


GOOD_REGISTRY = "s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0"


@check(
    f"""WITH good AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE {GOOD_REGISTRY}),
pick AS (SELECT s_nationkey, min(s_suppkey) AS first, max(s_suppkey) AS last FROM good GROUP BY ALL)
SELECT 'r' || s_suppkey AS registry_id, s_suppkey = last AS is_active,
  CASE WHEN s_suppkey = first AND first <> last THEN '2024-06-30' END AS effective_to FROM good JOIN pick USING (s_nationkey)"""
)
def registry_activation(t: Tables) -> DataFrame:
    """Every commodity activates its first valid version, then its last."""
    empty = registry_rows(t).limit(0)
    registry = X.add_versions(empty, registry_rows(t), ["registry_id"])
    number = F.col("version").cast("int")
    targets = lambda pick: registry.groupBy("commodity_id").agg(
        pick("registry_id", number).alias("target_id")
    )
    end = F.lit(dt.date(2024, 6, 30))
    once = X.activate(registry, targets(F.min_by), end)
    return X.activate(once, targets(F.max_by), end).select(
        "registry_id", "is_active", "effective_to"
    )


@check(
    f"""WITH good AS (SELECT s_nationkey, max(s_suppkey) AS k FROM supplier WHERE {GOOD_REGISTRY} GROUP BY ALL)
SELECT 'n' || n_nationkey AS commodity_id, CASE WHEN k IS NULL THEN '' ELSE 'Market,Futures' END AS required
FROM nation LEFT JOIN good ON s_nationkey = n_nationkey"""
)
def active_required_agents(t: Tables) -> DataFrame:
    registry = X.add_versions(registry_rows(t).limit(0), registry_rows(t), ["registry_id"])
    last = registry.groupBy("commodity_id").agg(
        F.max_by("registry_id", F.col("version").cast("int")).alias("target_id")
    )
    active = X.activate(registry, last, F.lit(None).cast("date"))
    commodities = t.read("nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("commodity_id")
    )
    return X.required_agents(active, commodities).select(
        "commodity_id", F.array_join("required_agents", ",").alias("required")
    )


@check(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'vanished' ELSE 'changed' END AS violation
FROM orders WHERE o_orderkey % 101 = 0 OR o_orderkey % 37 = 0"""
)
def append_only_audit(t: Tables) -> DataFrame:
    """A later version of the table lost some keys and altered others."""
    before = t.read("orders")
    key = F.col("o_orderkey")
    after = before.filter(key % 101 != 0).withColumn(
        "o_orderstatus", F.when(key % 37 == 0, "?").otherwise(F.col("o_orderstatus"))
    )
    return X.changed_rows(before, after, ["o_orderkey"])


@check("SELECT 0::BIGINT AS mismatched, true AS same_fingerprint")
def replay_determinism(t: Tables) -> DataFrame:
    """The price basket from differently partitioned input, twice."""
    def run(parts: int) -> DataFrame:
        return B.price_basket(B.usable_rows(t.prices().repartition(parts)))

    first, second = run(3), run(11)
    prints = R.fingerprint(first).unionByName(R.fingerprint(second))
    same = prints.agg((F.count_distinct("fingerprint", "row_count") == 1).alias("same_fingerprint"))
    wrong = R.mismatches(first, second).agg(F.count(F.lit(1)).alias("mismatched"))
    return wrong.select("mismatched", same.scalar().alias("same_fingerprint"))


@check(
    """SELECT 'c' || CAST(user_id % 4 AS VARCHAR) AS commodity_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS as_of_date,
  max_by(event_id, ts) AS forecast_version_id FROM events WHERE event_id % 4 = 1 GROUP BY ALL"""
)
def newest_published_forecast(t: Tables) -> DataFrame:
    return published(forecasts(t)).select("commodity_id", "as_of_date", "forecast_version_id")


@check(
    f"""WITH {LATEST}
SELECT commodity_id, CAST(as_of_date AS VARCHAR) AS as_of_date, agent_type, direction FROM latest WHERE commodity_id = 'c2' AND registry_id = 'r1'"""
)
def signals_by_key(t: Tables) -> DataFrame:
    found = tables.lookup(
        latest_signals(t), ["as_of_date", "agent_type"], commodity_id="c2", registry_id="r1"
    )
    return found.select("commodity_id", "as_of_date", "agent_type", "direction")


@check(
    """SELECT 'm' || s_suppkey AS market_id, r_name AS state FROM supplier JOIN nation ON n_nationkey = s_nationkey
JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey % 5 <> 0"""
)
def expected_markets(t: Tables) -> DataFrame:
    """Markets with an identifier of the source, read from a nested dimension."""
    places = (
        t.read("supplier")
        .join(t.read("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
        .join(t.read("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    )
    identity = F.struct(
        F.col("r_name").alias("state"), F.col("n_name").alias("district"),
        F.col("s_name").alias("market"),
    )
    markets = places.select(
        F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("market_id"),
        F.col("n_name").alias("region_id"),
        F.struct(F.when(F.col("s_suppkey") % 5 != 0, identity).alias("agmarknet")).alias(
            "source_identifiers"
        ),
    )
    return seeds.expected_markets(markets).select("market_id", "state")


@check(
    """WITH m AS (
  SELECT o_orderkey, o_custkey, o_orderkey % 9 = 0 AS negative, o_orderkey % 8 = 0 AS bad_horizon FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey FROM m WHERE NOT negative AND NOT bad_horizon
  AND NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderkey % 2 = 1 AND s.o_custkey = m.o_custkey)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"""
)
def registered_models(t: Tables) -> DataFrame:
    """Even orders are incoming models, odd ones registered; the customer is the version."""
    key = F.col("o_orderkey")
    rows = t.read("orders").select(
        "o_orderkey",
        F.lit("cotton").alias("commodity_id"),
        F.lit("r1").alias("registry_id"),
        F.col("o_custkey").cast("string").alias("model_version"),
        F.lit(dt.date(2024, 1, 1)).alias("training_window_start"),
        F.lit(dt.date(2024, 6, 30)).alias("training_window_end"),
        J.digest(F.lit("spot_price_level")).alias("feature_set_hash"),
        F.when(key % 8 == 0, 45).otherwise(30).alias("horizon_days"),
        F.create_map(
            F.lit("mae"), F.when(key % 9 == 0, -1.0).otherwise(1.0), F.lit("rmse"), F.lit(1.0),
            F.lit("mape"), F.lit(1.0),
        ).alias("metrics"),
    )
    stored = rows.filter("o_orderkey % 2 = 1")
    incoming = rows.filter("o_orderkey % 2 = 0")
    return X.register_models(stored, incoming, ["o_orderkey"]).select("o_orderkey")


@check(
    f"""WITH {LATEST}, days AS (SELECT commodity_id, as_of_date, count(*) FILTER (agent_type IN ('Market', 'Weather', 'Futures')) AS n,
    count(*) FILTER (agent_type = 'Futures') AS f FROM latest GROUP BY ALL)
SELECT commodity_id, CAST(as_of_date AS VARCHAR) AS as_of_date, horizon_days, CASE WHEN f = 1 THEN 5 * n ELSE 5 * n + 13 END AS feature_count
FROM days CROSS JOIN (SELECT unnest([30, 60])::BIGINT AS horizon_days) h WHERE commodity_id <> 'c3'"""
)
def importance_panel(t: Tables) -> DataFrame:
    """Two generations of feature sets per day: the older one is empty and must not be picked."""
    now = assembled(t).withColumn("created_at", F.lit(2))
    nothing = F.create_map().cast("map<string,string>")
    older = now.withColumn("created_at", F.lit(1)).withColumn("feature_values", nothing)
    rows = now.filter("commodity_id <> 'c3'").select(
        *P.KEY, F.explode(F.array(F.lit(30), F.lit(60))).alias("horizon_days")
    )
    panel = P.importance_panel(rows, older.unionByName(now))
    return panel.select(
        "commodity_id", "as_of_date", "horizon_days", F.size("feature_values").alias("feature_count")
    )


@check(
    f"""WITH {LATEST}, days AS (SELECT commodity_id, as_of_date, count(*) FILTER (agent_type IN ('Market', 'Weather', 'Futures')) AS n,
    count(*) FILTER (agent_type = 'Futures') AS f FROM latest GROUP BY ALL)
SELECT commodity_id, CAST(as_of_date AS VARCHAR) AS as_of_date, horizon_days, CASE WHEN f = 1 THEN 5 * n ELSE 5 * n + 13 END AS feature_count
FROM days CROSS JOIN (SELECT unnest([30, 60])::BIGINT AS horizon_days) h"""
)
def importance_panel_all_commodities(t: Tables) -> DataFrame:
    """Every commodity, and one without feature sets, which gives no row."""
    now = assembled(t).withColumn("created_at", F.lit(2))
    nothing = F.create_map().cast("map<string,string>")
    older = now.withColumn("created_at", F.lit(1)).withColumn("feature_values", nothing)
    keys = now.select(*P.KEY)
    keys = keys.unionByName(keys.withColumn("commodity_id", F.lit("unknown")))
    rows = keys.withColumn("horizon_days", F.explode(F.array(F.lit(30), F.lit(60))))
    panel = P.importance_panel(rows, older.unionByName(now))
    return panel.select(
        "commodity_id", "as_of_date", "horizon_days", F.size("feature_values").alias("feature_count")
    )


STORED = f"""{LATEST}, days AS (SELECT commodity_id, as_of_date, count(*) FILTER (agent_type IN ('Market', 'Weather', 'Futures')) AS n,
    count(*) FILTER (agent_type = 'Futures') AS f FROM latest GROUP BY ALL),
versions AS (
  SELECT commodity_id, as_of_date, CASE WHEN f = 1 THEN 5 * n ELSE 5 * n + 13 END AS full_count, extract(day FROM as_of_date) % 3 AS k FROM days)"""


@check(
    f"""WITH {STORED}
SELECT commodity_id, CAST(as_of_date AS VARCHAR) AS as_of_date, r AS read_day,
  CASE WHEN r = 1 OR k = 0 OR (k = 2 AND r >= 3) THEN full_count ELSE 0 END AS feature_count,
  CASE WHEN k = 0 OR r = 1 THEN 1::BIGINT WHEN k = 2 AND r >= 3 THEN 3::BIGINT ELSE 2 END AS version_day
FROM versions CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS r) t"""
)
def feature_store(t: Tables) -> DataFrame:
    """Sets written twice, emptied for two days of three, restored for one of them; read at three times."""
    folder = scratch_folder(t.spark)
    sets = assembled(t).withColumn("_k", F.day("as_of_date") % 3)
    on = lambda day: F.lit(dt.datetime(2025, 1, day, 12)).alias("created_at")
    first = sets.select(*P.KEY, "feature_values", "feature_lineage", "feature_hash", on(1))
    emptied = sets.filter("_k > 0").withColumn("feature_values", F.create_map().cast("map<string,string>"))
    emptied = emptied.withColumn("feature_hash", J.digest(P.feature_json())).select(*first.columns[:-1], on(2))
    restored = sets.filter("_k = 2").select(*first.columns[:-1], on(3))
    for number, rows in enumerate((first, first.withColumn("created_at", on(2)), emptied, emptied, restored, restored), 1):
        store.append_sets(t.spark, folder, rows, "check", number)
    reads = [
        store.read_sets(t.spark, folder, dt.datetime(2025, 1, day, 23)).withColumn("read_day", F.lit(day))
        for day in (1, 2, 3)
    ]
    return reads[0].unionByName(reads[1]).unionByName(reads[2]).select(
        "commodity_id", "as_of_date", "read_day", F.size("feature_values").alias("feature_count"),
        F.day("created_at").alias("version_day"),
    )
