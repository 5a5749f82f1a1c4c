"""Constraint sets of the tables as masks: one query per set, every rule failing somewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.base import check
from tidemark import fixed
from tidemark.adapters import Tables
from tidemark.operators import validation as V


def _key() -> Column:
    return F.col("o_orderkey")


def _cust() -> Column:
    return F.col("o_custkey")


def _sql(*fails: str) -> str:
    """Orders with the bits of the conditions that fail."""
    bits = " + ".join(f"CASE WHEN {f} THEN {1 << k} ELSE 0 END" for k, f in enumerate(fails))
    count = " + ".join(f"CASE WHEN {f} THEN 1 ELSE 0 END" for f in fails)
    return f"SELECT o_orderkey AS row_id, CAST({bits} AS BIGINT) AS issue_mask, CAST({count} AS BIGINT) AS issue_count FROM orders"


def _case(key: Column, values: dict[int, object], other: object) -> Column:
    out = F.lit(other) if not isinstance(other, Column) else other
    for k, value in values.items():
        out = F.when(key == k, F.lit(value)).otherwise(out)
    return out


def _masks(t: Tables, columns: dict[str, Column], rules: list[V.Rule]) -> DataFrame:
    rows = t.read("orders").select(_key().alias("row_id"), *[c.alias(n) for n, c in columns.items()])
    masked = V.masked(rows, rules)
    return masked.select(
        "row_id", "issue_mask", F.size(V.mask_issues(F.col("issue_mask"), rules)).cast("long").alias("issue_count")
    )


@check(_sql("o_orderkey % 3 = 0", "o_orderkey % 5 = 0", "o_custkey % 7 = 0", "o_custkey % 11 IN (0, 1, 2) OR o_totalprice > 1000000"))
def futures_constraints(t: Tables) -> DataFrame:
    return _masks(t, {
        "source": _case(_key() % 3, {0: "elsewhere"}, fixed.FUTURES_SOURCE),
        "environment": _case(_key() % 5, {0: None, 1: "production"}, "prototype"),
        "validation_status": _case(_cust() % 7, {0: "odd"}, fixed.RECEIVED),
        "settle_price": _case(_cust() % 11, {0: None, 1: 0.0, 2: 2e6}, F.col("o_totalprice")),
    }, V.FUTURES())


@check(_sql("o_orderkey % 3 = 0", "o_orderkey % 5 = 0", "o_custkey % 7 = 0", "o_custkey % 11 IN (0, 1, 2)", "o_custkey % 13 = 0"))
def policy_constraints(t: Tables) -> DataFrame:
    return _masks(t, {
        "policy_type": _case(_key() % 3, {0: "other"}, fixed.POLICY_TYPES[0]),
        "source": _case(_key() % 5, {0: None}, fixed.POLICY_SOURCES[0]),
        "impact_direction": _case(_cust() % 7, {0: "up"}, fixed.BULLISH),
        "confidence": _case(_cust() % 11, {0: None, 1: -0.1, 2: 1.1}, 0.5),
        "validation_status": _case(_cust() % 13, {0: None}, fixed.RECEIVED),
    }, V.POLICY())


@check(_sql("o_orderkey % 3 IN (0, 1)", "o_custkey % 7 = 1"))
def quality_constraints(t: Tables) -> DataFrame:
    return _masks(t, {
        "overall_quality_score": _case(_key() % 3, {0: None, 1: 1.5}, 0.5),
        "confidence_penalty_factor": _case(_cust() % 7, {0: None, 1: -0.5}, 0.2),
    }, V.QUALITY())


@check(_sql(
    "o_orderkey % 3 = 0", "o_orderkey % 5 IN (0, 1)", "o_custkey % 7 = 0", "o_custkey % 11 IN (0, 1)",
    "o_custkey % 11 IN (2, 3)", "o_custkey % 11 = 3",
))
def model_registry_constraints(t: Tables) -> DataFrame:
    metric = lambda name, value: F.create_map(F.lit(name), value)
    metrics = F.map_concat(
        F.when(_cust() % 11 != 0, metric("mae", _case(_cust() % 11, {1: -1.0}, 1.0))).otherwise(F.create_map().cast("map<string,double>")),
        F.when(_cust() % 11 != 2, metric("rmse", _case(_cust() % 11, {3: -1.0}, 1.0))).otherwise(F.create_map().cast("map<string,double>")),
        F.when(_cust() % 11 != 3, metric("mape", F.lit(0.5))).otherwise(F.create_map().cast("map<string,double>")),
    )
    day = F.to_date("o_orderdate")
    return _masks(t, {
        "training_window_start": day,
        "training_window_end": F.date_sub(day, F.when(_key() % 3 == 0, 1).otherwise(0)),
        "feature_set_hash": _case(_key() % 5, {0: "zz", 1: None}, F.sha2(_key().cast("string"), 256)),
        "horizon_days": _case(_cust() % 7, {0: 45}, 30),
        "metrics": metrics,
    }, V.MODEL_REGISTRY())


@check(_sql("o_orderkey % 3 IN (0, 1)", "o_custkey % 5 = 0"))
def user_context_constraints(t: Tables) -> DataFrame:
    return _masks(t, {
        "persona_type": _case(_key() % 3, {0: "broker", 1: None}, fixed.PERSONAS[0]),
        "liquidity_need": _case(_cust() % 5, {0: None}, fixed.LIQUIDITY_NEEDS[0]),
    }, V.USER_CONTEXT())


@check(_sql("o_orderkey % 4 = 0", "o_custkey % 5 IN (0, 1)"))
def recommendation_constraints(t: Tables) -> DataFrame:
    return _masks(t, {
        "action_type": _case(_key() % 4, {0: "WAIT"}, fixed.ACTIONS[0]),
        "recommendation_confidence": _case(_cust() % 5, {0: None, 1: 2.0}, 1.0),
    }, V.RECOMMENDATION())


@check(_sql("o_orderkey % 3 IN (0, 1)"))
def snapshot_constraints(t: Tables) -> DataFrame:
    return _masks(t, {"trace_id": _case(_key() % 3, {0: None, 1: ""}, "t")}, V.SNAPSHOT())


@check(_sql("o_orderkey % 3 = 1", "o_custkey % 5 = 0", "o_custkey % 7 = 0"))
def forecast_constraints(t: Tables) -> DataFrame:
    """A horizon that is absent is fine; a present one needs all of its parts."""
    horizon = lambda direction, trust, point: F.struct(
        direction.alias("direction"), trust.alias("forecast_confidence"), point.alias("point")
    )
    fine, half, level = F.lit(fixed.NEUTRAL), F.lit(0.5), F.col("o_totalprice")
    return _masks(t, {
        "horizon_30": F.when(_key() % 3 != 0, horizon(_case(_key() % 3, {1: "up"}, fixed.NEUTRAL), half, level)),
        "horizon_60": horizon(fine, _case(_cust() % 5, {0: 1.5}, 1.0), level),
        "horizon_90": horizon(fine, half, F.when(_cust() % 7 != 0, level)),
    }, V.forecast_rules())


@check(
    """WITH s AS (
  SELECT l_suppkey % 17 = 0 AS no_market, l_suppkey % 13 = 0 AND l_suppkey % 17 <> 0 AS odd_market, l_partkey % 19 = 0 AS no_unit,
    l_partkey % 29 = 0 AS odd_source, l_extendedprice AS v, l_linenumber - 2 AS lag,
    l_orderkey % 11 = 0 AS jute, l_orderkey % 11 <> 0 AND l_orderkey % 23 = 0 AS unknown FROM lineitem),
n AS (
  SELECT count(*) FILTER (no_market) AS a, count(*) FILTER (no_unit) AS b, count(*) FILTER (v < 100 OR v > 100000) AS c,
    count(*) FILTER (unknown) AS d, count(*) FILTER (jute) AS e, count(*) FILTER (odd_market) AS f, count(*) FILTER (odd_source) AS g,
    count(*) FILTER (lag < 0 OR lag > 1) AS h FROM s)
SELECT * FROM (SELECT unnest(['null_fields', 'null_fields', 'null_fields', 'null_fields', 'null_fields', 'null_fields', 'null_fields', 'null_fields', 'null_fields',
    'price_range', 'commodity_mapping', 'commodity_mapping', 'market_mapping', 'source', 'date_consistency']) AS "check",
  unnest(['market_id is required', 'commodity_id is required', 'price_type is required', 'value is required', 'unit is required', 'currency is required',
    'observed_at is required', 'as_of_date is required', 'source is required', 'value out of range', 'commodity_id not in registry',
    'expected cotton commodity_id', 'market_id not in registry', 'expected source agmarknet', 'observed_at date must be within one day after as_of_date']) AS message,
  unnest([a, 0, 0, 0, b, 0, 0, 0, 0, c, d, e, f, g, h]) AS issue_count FROM n)"""
)
def price_issue_counts(t: Tables) -> DataFrame:
    """Every price rule with the number of rows that break it."""
    from checks.observations import landed

    at, rules = landed(t), V.price_rules()
    rows = V.masked(at.stored_prices(), rules, {
        "market": ("market_id", at.dimension_markets()), "commodity": ("commodity_id", at.dimension_commodities()),
    })
    return V.issue_counts(rows, rules)
