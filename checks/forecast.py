"""Datasets, folds, baselines, KPIs and signal effectiveness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql as Q
from checks.base import check
from checks.market import ARRIVAL_SQL, MOMENTUM_SQL, basket
from checks.signals import ORDER
from checks.weather import FEATURES_SQL
from tidemark.adapters import Tables
from tidemark.operators import folds as W
from tidemark.operators.forward import first_on_or_after, horizon_targets
from tidemark.plans import datasets as D
from tidemark.plans import effectiveness as E
from tidemark.plans import kpi as K
from tidemark.plans import models as M
from tidemark.plans import snapshots as N

TARGETS = Q.BASKET + """,
targets AS (
  SELECT b.series_id, b.as_of_date, h.horizon_days, b.level AS spot, x.level AS target
  FROM basket b CROSS JOIN (SELECT unnest([30, 60, 90])::BIGINT AS horizon_days) h
  LEFT JOIN basket x ON x.series_id = b.series_id AND x.as_of_date = b.as_of_date + CAST(h.horizon_days AS INTEGER)),
ends AS (SELECT series_id, max(as_of_date) AS last_day FROM basket GROUP BY ALL),
candidates AS (
  SELECT t.* FROM targets t JOIN ends USING (series_id) WHERE t.as_of_date <= last_day - CAST(horizon_days AS INTEGER)),
dataset AS (SELECT * FROM candidates WHERE target IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY series_id, horizon_days ORDER BY as_of_date) - 1 AS idx,
    count(*) OVER (PARTITION BY series_id, horizon_days) AS n FROM dataset),
folds AS (
  SELECT series_id, horizon_days, f AS fold_index, 60 + 20 * f AS train_end, 80 + 20 * f AS test_end FROM (
    SELECT DISTINCT series_id, horizon_days, unnest(range(0, (n - 80) // 20 + 1)) AS f FROM numbered WHERE n >= 80)
  UNION ALL SELECT DISTINCT series_id, horizon_days, 0, least(60, n - 1), n FROM numbered WHERE n BETWEEN 2 AND 79)"""


def dataset(t: Tables) -> DataFrame:
    return D.supervised(D.candidates(basket(t)))


@check(
    f"""WITH {TARGETS}
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, horizon_days, spot AS spot_price_level, target AS target_price_level FROM targets"""
)
def horizon_target_rows(t: Tables) -> DataFrame:
    return horizon_targets(basket(t))


@check(
    f"""WITH {TARGETS}
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, horizon_days, spot AS spot_price_level, target AS target_price_level,
  round(ln(target / spot), 6) AS target_log_return FROM dataset"""
)
def supervised_dataset(t: Tables) -> DataFrame:
    return dataset(t).withColumn("target_log_return", F.round("target_log_return", 6))


@check(
    f"""WITH {TARGETS}
SELECT series_id, horizon_days, count(target) AS row_count, count(*) AS candidate_dates,
  round(count(target) / count(*)::DOUBLE, 6) AS coverage_ratio FROM candidates GROUP BY ALL"""
)
def dataset_coverage(t: Tables) -> DataFrame:
    return D.dataset_stats(D.candidates(basket(t)))


@check(
    f"""WITH {TARGETS}
SELECT series_id, horizon_days, count(*) FILTER (spot IS NULL) AS missing_spot_price_level,
  count(*) FILTER (target IS NULL) AS missing_target_price_level,
  count(*) FILTER (target IS NULL) AS missing_target_log_return FROM candidates GROUP BY ALL"""
)
def dataset_missing_counts(t: Tables) -> DataFrame:
    rows = D.candidates(basket(t)).withColumn(
        "target_log_return",
        F.when(F.col("target_price_level").isNotNull(), F.lit(0.0)),
    )
    return D.missing_counts(rows, features=None)


@check(
    f"""WITH {TARGETS}, {Q.SIGNALS}, agents AS (
  SELECT as_of_date, count(DISTINCT agent_type) AS agents FROM signals WHERE commodity_id = 'c1' GROUP BY ALL)
SELECT d.series_id, CAST(d.as_of_date AS VARCHAR) AS as_of_date, d.horizon_days, coalesce(2 * agents, 0) AS feature_count
FROM dataset d LEFT JOIN agents a ON a.as_of_date = DATE '2024-01-01' + CAST((d.as_of_date - DATE '1970-01-01') % 30 AS INTEGER)"""
)
def dataset_with_snapshots(t: Tables) -> DataFrame:
    """Thirty days of snapshots repeated along the price calendar."""
    snap = N.snapshots(t.signals().filter("commodity_id = 'c1'"), ORDER).select(
        F.col("as_of_date").alias("_day"), "registry_id", "snapshot_hash", "snapshot_id", "signals",
        F.lit(0).alias("created_at"),
    )
    rows = dataset(t)
    days = rows.select("series_id", "as_of_date").distinct().withColumn(
        "_day",
        F.date_add(F.lit("2024-01-01").cast("date"), F.unix_date("as_of_date") % 30),
    )
    placed = days.join(snap, "_day").drop("_day")
    return D.attach_snapshots(rows, placed).select(
        "series_id", "as_of_date", "horizon_days",
        F.coalesce(F.size("features"), F.lit(0)).alias("feature_count"),
    )


@check(
    f"""WITH {TARGETS}, {Q.SIGNALS}, agents AS (
  SELECT commodity_id, as_of_date, count(DISTINCT agent_type) AS agents FROM signals GROUP BY ALL),
mapped AS (
  SELECT *, CASE WHEN series_id = 'PROMO' THEN 'c4' ELSE 'c' || CAST(length(series_id) % 5 AS VARCHAR) END AS commodity_id FROM dataset)
SELECT d.series_id, d.commodity_id, CAST(d.as_of_date AS VARCHAR) AS as_of_date, d.horizon_days, coalesce(2 * agents, 0) AS feature_count
FROM mapped d LEFT JOIN agents a ON a.commodity_id = d.commodity_id
  AND a.as_of_date = DATE '2024-01-01' + CAST((d.as_of_date - DATE '1970-01-01') % 30 AS INTEGER)"""
)
def dataset_with_all_snapshots(t: Tables) -> DataFrame:
    """Snapshots of every commodity on the series mapped to it; ``c4`` has none."""
    snap = N.snapshots(t.signals(), ORDER).select(
        "commodity_id", F.col("as_of_date").alias("_day"), "registry_id", "snapshot_hash", "snapshot_id", "signals",
        F.lit(0).alias("created_at"),
    )
    by_length = F.concat(F.lit("c"), (F.length("series_id") % 5).cast("string"))
    commodity = F.when(F.col("series_id") == "PROMO", "c4").otherwise(by_length)
    rows = dataset(t)
    days = rows.select("series_id", "as_of_date").distinct().withColumn(
        "_day",
        F.date_add(F.lit("2024-01-01").cast("date"), F.unix_date("as_of_date") % 30),
    )
    placed = days.withColumn("commodity_id", commodity).join(snap, ["commodity_id", "_day"]).drop("_day", "commodity_id")
    return D.attach_snapshots(rows, placed).select(
        "series_id", commodity.alias("commodity_id"), "as_of_date", "horizon_days",
        F.coalesce(F.size("features"), F.lit(0)).alias("feature_count"),
    )


@check(
    f"""WITH {Q.BASKET}, asked AS (
  SELECT series_id, as_of_date, unnest([7, 30])::BIGINT AS horizon_days FROM basket)
SELECT a.series_id, CAST(a.as_of_date AS VARCHAR) AS as_of_date, horizon_days, b.level AS forward_level
FROM asked a ASOF LEFT JOIN basket b ON a.series_id = b.series_id AND a.as_of_date + CAST(a.horizon_days AS INTEGER) <= b.as_of_date"""
)
def forward_levels(t: Tables) -> DataFrame:
    return first_on_or_after(basket(t))


@check(
    f"""WITH {TARGETS}
SELECT series_id, horizon_days, fold_index, train_end, test_end FROM folds"""
)
def rolling_folds(t: Tables) -> DataFrame:
    return M.fold_bounds(dataset(t)).drop("n_rows")


@check(
    f"""WITH {TARGETS}, elig AS (
  SELECT a.series_id, a.horizon_days, a.as_of_date, a.idx, count(b.idx) AS eligible FROM numbered a LEFT JOIN numbered b
    ON a.series_id = b.series_id AND a.horizon_days = b.horizon_days AND b.as_of_date + CAST(b.horizon_days AS INTEGER) < a.as_of_date GROUP BY ALL)
SELECT series_id, horizon_days, row_number() OVER (PARTITION BY series_id, horizon_days ORDER BY as_of_date) - 1 AS fold_index,
  CAST(as_of_date AS VARCHAR) AS test_date, idx AS test_index, 0::BIGINT AS train_start, eligible AS train_end, eligible AS train_rows
FROM elig WHERE eligible >= 24"""
)
def walk_forward_folds(t: Tables) -> DataFrame:
    return W.walk_forward(dataset(t))


@check(
    f"""WITH RECURSIVE {TARGETS}, elig AS (
  SELECT a.series_id, a.horizon_days, a.as_of_date, count(b.idx) AS eligible FROM numbered a JOIN numbered b
    ON a.series_id = b.series_id AND a.horizon_days = b.horizon_days AND b.as_of_date + CAST(b.horizon_days AS INTEGER) < a.as_of_date GROUP BY ALL),
ready AS (SELECT * FROM elig WHERE eligible >= 24),
steps AS (
  SELECT series_id, horizon_days, min(as_of_date) AS as_of_date FROM ready GROUP BY ALL
  UNION ALL
  SELECT series_id, horizon_days, nxt FROM (
    SELECT s.series_id, s.horizon_days, (SELECT min(r.as_of_date) FROM ready r WHERE r.series_id = s.series_id
      AND r.horizon_days = s.horizon_days AND r.as_of_date >= s.as_of_date + 45) AS nxt FROM steps s) WHERE nxt IS NOT NULL)
SELECT series_id, horizon_days, CAST(as_of_date AS VARCHAR) AS test_date, least(eligible, 40) AS train_rows
FROM steps JOIN ready USING (series_id, horizon_days, as_of_date)"""
)
def sliding_stepped_folds(t: Tables) -> DataFrame:
    spec = W.WalkForward(step_days=45, train_window=40)
    return W.walk_forward(dataset(t), spec).select(
        "series_id", "horizon_days", "test_date", "train_rows"
    )


@check("SELECT 0::BIGINT AS leaking, 0::BIGINT AS repeated")
def fold_guards(t: Tables) -> DataFrame:
    """No train label is realised on or after its test day; no day repeats."""
    rows = dataset(t)
    leaks = W.leaking_rows(rows, W.walk_forward(rows)).agg(F.count(F.lit(1)).alias("leaking"))
    twice = W.duplicate_days(rows).agg(F.count(F.lit(1))).scalar()
    return leaks.select("leaking", twice.alias("repeated"))


@check(
    f"""WITH {TARGETS}
SELECT b.series_id, b.horizon_days, b.fold_index, count(*) FILTER (idx < train_end) AS train_rows,
  count(*) FILTER (idx >= train_end) AS test_rows FROM folds b JOIN numbered n USING (series_id, horizon_days)
WHERE idx < test_end GROUP BY ALL"""
)
def fold_members(t: Tables) -> DataFrame:
    rows = dataset(t)
    folds = M.fold_bounds(rows)
    totals = W.fold_totals(rows, folds, {})
    of = lambda role: F.sum(F.when(F.col("role") == role, F.col("n_rows")))
    return totals.groupBy(*W.GROUP, "fold_index").agg(
        of("train").alias("train_rows"), of("test").alias("test_rows")
    )


@check(
    f"""WITH {TARGETS}, cents AS (SELECT *, CAST(round(target * 100) AS BIGINT) AS c FROM numbered),
sums AS (
  SELECT a.series_id, a.horizon_days, a.as_of_date, any_value(a.c) AS test_cents, count(b.idx) AS train_rows, sum(b.c)::BIGINT AS train_cents
  FROM cents a JOIN cents b ON a.series_id = b.series_id AND a.horizon_days = b.horizon_days
    AND b.as_of_date + CAST(b.horizon_days AS INTEGER) < a.as_of_date GROUP BY ALL)
SELECT series_id, horizon_days, row_number() OVER (PARTITION BY series_id, horizon_days ORDER BY as_of_date) - 1 AS fold_index,
  train_rows, train_cents, 1::BIGINT AS test_rows, test_cents FROM sums WHERE train_rows >= 24"""
)
def walk_forward_totals(t: Tables) -> DataFrame:
    """Train and test sums of every walk-forward fold, one fold a day."""
    rows = dataset(t)
    cents = F.round(F.col("target_price_level") * 100).cast("long")
    totals = W.fold_totals(rows, W.walk_forward(rows), {"cents": cents})
    of = lambda role, name: F.sum(F.when(F.col("role") == role, F.col(name)))
    return totals.groupBy(*W.GROUP, "fold_index").agg(
        *[of(role, f).alias(f"{role}_{n}") for role in ("train", "test") for f, n in (("n_rows", "rows"), ("cents", "cents"))]
    )


@check(
    f"""WITH RECURSIVE {TARGETS}, elig AS (
  SELECT a.series_id, a.horizon_days, a.as_of_date, a.idx, count(b.idx) AS eligible FROM numbered a JOIN numbered b
    ON a.series_id = b.series_id AND a.horizon_days = b.horizon_days AND b.as_of_date + CAST(b.horizon_days AS INTEGER) < a.as_of_date GROUP BY ALL),
ready AS (SELECT * FROM elig WHERE eligible >= 24),
steps AS (
  SELECT series_id, horizon_days, min(as_of_date) AS as_of_date FROM ready GROUP BY ALL
  UNION ALL
  SELECT series_id, horizon_days, nxt FROM (
    SELECT s.series_id, s.horizon_days, (SELECT min(r.as_of_date) FROM ready r WHERE r.series_id = s.series_id
      AND r.horizon_days = s.horizon_days AND r.as_of_date >= s.as_of_date + 45) AS nxt FROM steps s) WHERE nxt IS NOT NULL),
bounds AS (
  SELECT series_id, horizon_days, row_number() OVER (PARTITION BY series_id, horizon_days ORDER BY as_of_date) - 1 AS fold_index, idx AS test_index, eligible
  FROM steps JOIN ready USING (series_id, horizon_days, as_of_date))
SELECT b.series_id, b.horizon_days, fold_index, CASE WHEN idx = test_index THEN 'test' ELSE 'train' END AS role, CAST(as_of_date AS VARCHAR) AS as_of_date
FROM bounds b JOIN numbered n ON n.series_id = b.series_id AND n.horizon_days = b.horizon_days
  AND (idx = test_index OR (idx < eligible AND idx >= eligible - 40))"""
)
def sliding_fold_members(t: Tables) -> DataFrame:
    rows = dataset(t)
    return W.members(rows, W.walk_forward(rows, W.WalkForward(step_days=45, train_window=40)))


FITS = TARGETS + """,
fits AS (
  SELECT f.series_id, f.horizon_days, f.fold_index, f.train_end, f.test_end,
    regr_slope(n.target, n.spot) AS slope, regr_intercept(n.target, n.spot) AS base
  FROM folds f JOIN numbered n ON n.series_id = f.series_id AND n.horizon_days = f.horizon_days AND n.idx < f.train_end GROUP BY ALL),
predictions AS (
  SELECT n.series_id, n.horizon_days, f.fold_index, n.target AS y, n.spot AS naive,
    f.base + f.slope * n.spot AS line FROM fits f JOIN numbered n
  ON n.series_id = f.series_id AND n.horizon_days = f.horizon_days AND n.idx >= f.train_end AND n.idx < f.test_end),
results AS (
  SELECT series_id, horizon_days, model_name, round(avg(abs(p - y)), 2) AS mae, round(sqrt(avg((p - y) * (p - y))), 2) AS rmse,
    round(avg(abs(p - y) / greatest(abs(y), 1e-6)) * 100.0::DOUBLE, 4) AS mape_pct, count(*) AS n_samples, count(DISTINCT fold_index) AS fold_count
  FROM (SELECT series_id, horizon_days, fold_index, y, 'naive_persistence' AS model_name, naive AS p FROM predictions
    UNION ALL SELECT series_id, horizon_days, fold_index, y, 'linear_regression', line FROM predictions) GROUP BY ALL)"""


def results(t: Tables) -> DataFrame:
    return M.evaluation(M.baseline_predictions(dataset(t)))


@check(f"WITH {FITS} SELECT * FROM results")
def baseline_evaluation(t: Tables) -> DataFrame:
    return results(t).select(
        "series_id", "horizon_days", "model_name", F.round("mae", 2).alias("mae"),
        F.round("rmse", 2).alias("rmse"), F.round("mape_pct", 4).alias("mape_pct"), "n_samples",
        "fold_count",
    )


@check(
    f"""WITH {FITS}
SELECT series_id, horizon_days, coalesce(min(rmse) FILTER (model_name <> 'naive_persistence') < max(rmse) FILTER (model_name = 'naive_persistence'), false) AS beats_naive
FROM results GROUP BY ALL"""
)
def beats_naive(t: Tables) -> DataFrame:
    return K.beats_naive(results(t), ["series_id", "horizon_days"])


@check(
    f"""WITH {FITS}
SELECT series_id, horizon_days, model_name || '@pi11-database-seed42' AS model_version, n_samples AS sample_count, mae, rmse, mape_pct AS mape FROM results"""
)
def model_handoff(t: Tables) -> DataFrame:
    _, quality = K.handoff(results(t), {"series_id": F.col("series_id")})
    return quality.select(
        "series_id", "horizon_days", "model_version", "sample_count",
        F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"),
        F.round("mape", 4).alias("mape"),
    )


def dated_matrix(t: Tables) -> DataFrame:
    """Matrix of all horizons: spot, month and weekday of the day."""
    return dataset(t).select(
        "series_id", "as_of_date", "horizon_days", "spot_price_level", "target_price_level",
        F.month("as_of_date").cast("double").alias("month"),
        F.dayofweek("as_of_date").cast("double").alias("weekday"),
    )


@check(
    f"""WITH {TARGETS},
dated AS (SELECT *, month(as_of_date)::DOUBLE AS u, (dayofweek(as_of_date) + 1)::DOUBLE AS v FROM numbered),
moments AS (
  SELECT f.series_id, f.horizon_days, f.fold_index, f.train_end, f.test_end, avg(d.spot) AS ms, avg(d.u) AS mu, avg(d.v) AS mv, avg(d.target) AS mt,
    covar_pop(d.spot, d.spot) AS ss, covar_pop(d.spot, d.u) AS su, covar_pop(d.spot, d.v) AS sv, covar_pop(d.u, d.u) AS uu, covar_pop(d.u, d.v) AS uv,
    covar_pop(d.v, d.v) AS vv, covar_pop(d.spot, d.target) AS st, covar_pop(d.u, d.target) AS ut, covar_pop(d.v, d.target) AS vt
  FROM folds f JOIN dated d ON d.series_id = f.series_id AND d.horizon_days = f.horizon_days AND d.idx < f.train_end GROUP BY ALL),
fits AS (
  SELECT *, ss * (uu * vv - uv * uv) - su * (su * vv - uv * sv) + sv * (su * uv - uu * sv) AS det FROM moments),
solved AS (
  SELECT *, (st * (uu * vv - uv * uv) - su * (ut * vv - uv * vt) + sv * (ut * uv - uu * vt)) / det AS bs,
    (ss * (ut * vv - uv * vt) - st * (su * vv - uv * sv) + sv * (su * vt - ut * sv)) / det AS bu,
    (ss * (uu * vt - ut * uv) - su * (su * vt - ut * sv) + st * (su * uv - uu * sv)) / det AS bv FROM fits),
guesses AS (
  SELECT d.series_id, d.horizon_days, s.fold_index, d.target AS y, mt + bs * (d.spot - ms) + bu * (d.u - mu) + bv * (d.v - mv) AS p
  FROM solved s JOIN dated d ON d.series_id = s.series_id AND d.horizon_days = s.horizon_days AND d.idx >= s.train_end AND d.idx < s.test_end)
SELECT series_id, horizon_days, 'ols' AS model_name, round(avg(abs(p - y)), 2) AS mae, round(sqrt(avg((p - y) * (p - y))), 2) AS rmse,
  count(*) AS n_samples, count(DISTINCT fold_index) AS fold_count FROM guesses GROUP BY ALL"""
)
def grouped_fit_evaluation(t: Tables) -> DataFrame:
    """Least squares on spot, month and weekday over every series' folds, all horizons."""
    matrix = dated_matrix(t)
    guesses = M.least_squares_predictions(
        matrix, ["spot_price_level", "month", "weekday"], M.fold_bounds(matrix), "ols"
    )
    return M.evaluation(guesses).select(
        "series_id", "horizon_days", "model_name", F.round("mae", 2).alias("mae"),
        F.round("rmse", 2).alias("rmse"), "n_samples", "fold_count",
    )


@check(
    f"""WITH {TARGETS},
bounds AS (
  SELECT series_id, horizon_days, f AS fold_index, 120 + 100 * f AS train_end, 220 + 100 * f AS test_end FROM (
    SELECT DISTINCT series_id, horizon_days, unnest(range(0, (n - 220) // 100 + 1)) AS f FROM numbered WHERE n >= 220)
  UNION ALL SELECT DISTINCT series_id, horizon_days, 0, least(120, n - 1), n FROM numbered WHERE n BETWEEN 2 AND 219),
cells AS (
  SELECT series_id, horizon_days, as_of_date, idx, target, CAST(round(target * 10000) AS BIGINT) AS y, feature,
    CASE feature WHEN 0 THEN spot ELSE month(as_of_date)::DOUBLE END AS x FROM numbered CROSS JOIN (SELECT unnest([0, 1]) AS feature)),
trained AS (
  SELECT b.series_id, b.horizon_days, fold_index, feature, x, count(*) AS n, sum(y) AS s FROM bounds b JOIN cells c
    ON c.series_id = b.series_id AND c.horizon_days = b.horizon_days AND c.idx < b.train_end GROUP BY ALL),
summed AS (
  SELECT *, sum(n) OVER up AS nl, sum(s) OVER up AS sl, sum(n) OVER al AS nn, sum(s) OVER al AS ss FROM trained
  WINDOW up AS (PARTITION BY series_id, horizon_days, fold_index, feature ORDER BY x ROWS UNBOUNDED PRECEDING),
    al AS (PARTITION BY series_id, horizon_days, fold_index, feature)),
edges AS (
  SELECT DISTINCT m.series_id, m.horizon_days, m.fold_index, m.feature, m.x, CAST(nl AS BIGINT) AS nl, CAST(sl AS DOUBLE) AS sl,
    CAST(nn AS BIGINT) AS nn, CAST(ss AS DOUBLE) AS ss FROM summed m CROSS JOIN (SELECT unnest(range(1, 32)) AS j)
  WHERE ceil(j / 32.0::DOUBLE * nn) BETWEEN nl - n + 1 AND nl),
gains AS (
  SELECT *, nl / nn * (nn - nl) * ((sl / nl - (ss - sl) / (nn - nl)) * (sl / nl - (ss - sl) / (nn - nl))) AS gain FROM edges WHERE nn > nl),
picks AS (
  SELECT * FROM gains WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY series_id, horizon_days, fold_index ORDER BY gain DESC, feature, x) = 1),
roots AS (SELECT DISTINCT series_id, horizon_days, fold_index, CAST(nn AS BIGINT) AS nn, CAST(ss AS DOUBLE) AS ss FROM summed WHERE feature = 0),
guesses AS (
  SELECT c.series_id, c.horizon_days, b.fold_index, c.target AS y,
    CASE WHEN p.x IS NULL THEN r.ss / r.nn WHEN c.x <= p.x THEN p.sl / p.nl ELSE (p.ss - p.sl) / (p.nn - p.nl) END / 10000 AS p
  FROM bounds b JOIN roots r USING (series_id, horizon_days, fold_index) LEFT JOIN picks p USING (series_id, horizon_days, fold_index)
  JOIN cells c ON c.series_id = b.series_id AND c.horizon_days = b.horizon_days AND c.idx >= b.train_end AND c.idx < b.test_end
    AND c.feature = coalesce(p.feature, 0))
SELECT series_id, horizon_days, round(avg(abs(p - y)), 2) AS mae, round(sqrt(avg((p - y) * (p - y))), 2) AS rmse,
  count(*) AS n_samples, count(DISTINCT fold_index) AS fold_count FROM guesses GROUP BY ALL"""
)
def stump_evaluation(t: Tables) -> DataFrame:
    """The forest's growth with one tree of depth one on all rows; folds of a hundred days."""
    spec = M.ForestSpec(trees=1, depth=1, bins=32, bootstrap=False)
    guesses = M.forest_predictions(
        dated_matrix(t), ["spot_price_level", "month"], spec, min_train=120, test_size=100
    )
    return M.evaluation(guesses).select(
        "series_id", "horizon_days", F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"),
        "n_samples", "fold_count",
    )


@check()
def forest_importance(t: Tables) -> DataFrame:
    """Forest importances under lineage prefixes with their position."""
    matrix = dated_matrix(t).select(
        "target_price_level", F.col("spot_price_level").alias("market.spot"),
        F.col("month").alias("weather.month"), F.col("weekday").alias("futures.weekday"),
    )
    names = ["market.spot", "weather.month", "futures.weekday"]
    return M.top_per_lineage(M.feature_importance(matrix, names, "target_price_level"), k=2)


@check(
    """WITH scores AS (
  SELECT CASE event_type WHEN 'click' THEN 'market' WHEN 'view' THEN 'weather' WHEN 'purchase' THEN 'futures' ELSE 'other' END || '.u' || user_id AS name,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS score FROM events GROUP BY ALL)
SELECT split_part(name, '.', 1) AS lineage, name, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY split_part(name, '.', 1) ORDER BY score DESC, name) AS position
FROM scores WHERE split_part(name, '.', 1) IN ('market', 'weather', 'futures') QUALIFY position <= 3"""
)
def top_features_per_lineage(t: Tables) -> DataFrame:
    return M.top_per_lineage(_scores(t), k=3)


@check(
    """WITH scores AS (
  SELECT CASE event_type WHEN 'click' THEN 'market' WHEN 'view' THEN 'weather' WHEN 'purchase' THEN 'futures' ELSE 'other' END AS lineage,
    CAST(round(value * 100) AS BIGINT) AS score FROM events)
SELECT lineage, CAST(sum(score) AS DOUBLE) AS total FROM scores WHERE lineage <> 'other' GROUP BY ALL"""
)
def lineage_totals(t: Tables) -> DataFrame:
    return M.lineage_totals(_scores(t))


def _scores(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    prefix = (
        F.when(kind == "click", "market").when(kind == "view", "weather")
        .when(kind == "purchase", "futures").otherwise("other")
    )
    cents = F.round(F.col("value") * 100).cast("long")
    return t.read("events").groupBy(
        F.concat(prefix, F.lit(".u"), F.col("user_id").cast("string")).alias("name")
    ).agg(F.sum(cents).cast("double").alias("score"))


@check(
    f"""WITH {Q.PAIRS}
SELECT series_id, h.horizon_days, count(p.pair_id) AS sample_count, round(avg(abs(predicted - actual)), 4) AS mae,
  round(sqrt(avg((predicted - actual) * (predicted - actual))), 4) AS rmse,
  round(avg(CASE WHEN abs(actual) >= 1e-6 THEN abs((predicted - actual) / actual) * 100.0::DOUBLE END), 4) AS mape,
  round(avg(CASE WHEN band_low IS NOT NULL AND band_high IS NOT NULL THEN CAST(actual BETWEEN band_low AND band_high AS DOUBLE) END), 4) AS coverage
FROM (SELECT DISTINCT series_id FROM pairs) CROSS JOIN (SELECT unnest([30, 60, 90, 120])::BIGINT AS horizon_days) h
LEFT JOIN pairs p USING (series_id, horizon_days) GROUP BY ALL"""
)
def forecast_kpis(t: Tables) -> DataFrame:
    return K.horizon_kpis(t.pairs(), horizons=(30, 60, 90, 120), keys=["series_id"])


@check(
    f"""WITH {Q.PAIRS}
SELECT series_id, horizon_days, round(avg(abs(predicted - actual)), 4) AS mae,
  round(avg(abs(predicted - actual) / greatest(abs(actual), 1e-6)) / 1e6, 4) AS mape_millions, count(*) AS n_samples FROM pairs GROUP BY ALL"""
)
def clamped_regression_metrics(t: Tables) -> DataFrame:
    rows = K.regression_metrics(t.pairs(), ["series_id", "horizon_days"], "actual", "predicted")
    return rows.select(
        "series_id", "horizon_days", F.round("mae", 4).alias("mae"),
        F.round(F.col("mape_pct") / 1e8, 4).alias("mape_millions"), "n_samples",
    )


@check(
    f"""WITH {Q.PAIRS}
SELECT series_id, horizon_days, count(*) AS sample_count, round(avg(abs(predicted - actual)), 4) AS mae FROM pairs WHERE horizon_days <> 60 GROUP BY ALL"""
)
def forecast_quality_rows(t: Tables) -> DataFrame:
    kpis = K.horizon_kpis(t.pairs().filter("horizon_days <> 60"), keys=["series_id"])
    rows = K.quality_rows(kpis, {"assessment_source": F.lit("pairs")})
    return rows.select("series_id", "horizon_days", "sample_count", "mae")


@check(
    f"""WITH {Q.PAIRS}
SELECT series_id, horizon_days, count(*) AS sample_count, round(avg(abs(predicted - actual)), 4) AS mae,
  round(sqrt(avg((predicted - actual) * (predicted - actual))), 4) AS rmse,
  round(avg(CASE WHEN abs(actual) >= 1e-6 THEN abs((predicted - actual) / actual) * 100.0::DOUBLE END), 4) AS mape,
  round(avg(CASE WHEN band_low IS NOT NULL AND band_high IS NOT NULL THEN CAST(actual BETWEEN band_low AND band_high AS DOUBLE) END), 4) AS coverage
FROM pairs GROUP BY ALL"""
)
def forecast_quality_all_horizons(t: Tables) -> DataFrame:
    """Horizon 120 is asked for and has no pairs, so it gives no row."""
    kpis = K.horizon_kpis(t.pairs(), horizons=(30, 60, 90, 120), keys=["series_id"])
    return K.quality_rows(kpis, {"assessment_source": F.lit("pairs")}).drop("assessment_source")


PANEL = Q.BASKET + f""", {MOMENTUM_SQL}, bounds AS (
  SELECT series_id, min(as_of_date) AS a, max(as_of_date) AS z FROM basket GROUP BY ALL),
fwd AS (
  SELECT x.series_id, x.as_of_date, x.level, f7.level AS l7, f30.level AS l30 FROM basket x
  ASOF LEFT JOIN basket f7 ON x.series_id = f7.series_id AND x.as_of_date + 7 <= f7.as_of_date
  ASOF LEFT JOIN basket f30 ON x.series_id = f30.series_id AND x.as_of_date + 30 <= f30.as_of_date),
panel AS (
  SELECT m.series_id, m.as_of_date, m.momentum_raw::DOUBLE AS s, (l7 - f.level) / f.level AS r7, (l30 - f.level) / f.level AS r30
  FROM momentum m JOIN bounds USING (series_id) JOIN fwd f USING (series_id, as_of_date)
  WHERE m.as_of_date - 29 >= a AND m.as_of_date + 30 <= z)"""


def panel(t: Tables) -> DataFrame:
    return E.daily_panel(t.prices(), t.arrivals(), t.weather(), t.markets())


@check(
    f"""WITH {PANEL}
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, s AS price_momentum, round(r7, 6) AS forward_return_7d, round(r30, 6) AS forward_return_30d FROM panel"""
)
def effectiveness_panel(t: Tables) -> DataFrame:
    return panel(t).select(
        "series_id", "as_of_date", "price_momentum",
        F.round("forward_return_7d", 6).alias("forward_return_7d"),
        F.round("forward_return_30d", 6).alias("forward_return_30d"),
    )


@check(
    f"""WITH {PANEL}, long AS (
  SELECT series_id, 7::BIGINT AS horizon_days, s, r7 AS r FROM panel UNION ALL SELECT series_id, 30, s, r30 FROM panel),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY series_id, horizon_days ORDER BY s) + (count(*) OVER (PARTITION BY series_id, horizon_days, s) - 1) / 2.0::DOUBLE AS rs,
    rank() OVER (PARTITION BY series_id, horizon_days ORDER BY r) + (count(*) OVER (PARTITION BY series_id, horizon_days, r) - 1) / 2.0::DOUBLE AS rr
  FROM long WHERE r IS NOT NULL)
SELECT series_id, horizon_days, round(corr(s, r), 6) AS pearson_r, round(corr(rs, rr), 6) AS spearman_rho, count(*) AS sample_size,
  round(avg(s), 6) AS mean_signal, round(avg(r), 6) AS mean_forward_return FROM ranked GROUP BY ALL"""
)
def momentum_correlations(t: Tables) -> DataFrame:
    rows = E.correlations(E.long_pairs(panel(t))).filter("signal = 'price_momentum'")
    six = ("pearson_r", "spearman_rho", "mean_signal", "mean_forward_return")
    return rows.select(
        "series_id", "horizon_days", "sample_size", *[F.round(c, 6).alias(c) for c in six]
    )


_LONG = " UNION ALL ".join(
    f"SELECT series_id, '{name}' AS signal, {h}::BIGINT AS horizon_days, {column} AS s, r{h} AS r FROM wide"
    for name, column in (("price_momentum", "s"), ("arrival_momentum", "arrival_s"),
                         ("rainfall_shock", "shock_s"), ("temperature_stress", "stress_s"))
    for h in (7, 30)
)


@check(
    f"""WITH {PANEL}, {Q.VOLUMES}, {ARRIVAL_SQL}, {Q.REGIONAL}, {FEATURES_SQL},
wide AS (
  SELECT p.*, coalesce(a.arrival_raw, 0)::DOUBLE AS arrival_s, f.rainfall_shock::DOUBLE AS shock_s, f.temperature_stress::DOUBLE AS stress_s
  FROM panel p LEFT JOIN arrival a ON a.series_id = p.series_id AND a.as_of_date = p.as_of_date
  LEFT JOIN features f ON f.as_of_date = p.as_of_date),
long AS ({_LONG}),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY series_id, signal, horizon_days ORDER BY s) + (count(*) OVER (PARTITION BY series_id, signal, horizon_days, s) - 1) / 2.0::DOUBLE AS rs,
    rank() OVER (PARTITION BY series_id, signal, horizon_days ORDER BY r) + (count(*) OVER (PARTITION BY series_id, signal, horizon_days, r) - 1) / 2.0::DOUBLE AS rr
  FROM long WHERE r IS NOT NULL AND s IS NOT NULL)
SELECT series_id, signal, horizon_days, count(*) AS sample_size, round(corr(s, r), 6) AS pearson_r, round(corr(rs, rr), 6) AS spearman_rho
FROM ranked GROUP BY ALL"""
)
def signal_correlation_table(t: Tables) -> DataFrame:
    """All tracked signals and horizons."""
    rows = E.correlations(E.long_pairs(panel(t)))
    return rows.select(
        "series_id", "signal", "horizon_days", "sample_size",
        F.round("pearson_r", 6).alias("pearson_r"), F.round("spearman_rho", 6).alias("spearman_rho"),
    )


@check(
    f"""WITH {Q.PAIRS}, r AS (
  SELECT series_id, 's' || (pair_id % 5) AS signal, round(corr(predicted - actual, actual), 4) AS c FROM pairs GROUP BY ALL)
SELECT series_id, max_by(signal, [abs(c), c]) AS best_signal, min_by(signal, [abs(c), c]) AS worst_signal FROM r GROUP BY ALL"""
)
def best_and_worst_signal(t: Tables) -> DataFrame:
    corr = F.round(F.corr(F.col("predicted") - F.col("actual"), F.col("actual")), 4)
    rows = t.pairs().groupBy(
        "series_id", F.concat(F.lit("s"), (F.col("pair_id") % 5).cast("string")).alias("signal")
    ).agg(corr.alias("pearson_r"))
    rows = rows.select(
        "*", F.lit(None).cast("double").alias("spearman_rho"), F.lit(30).alias("horizon_days")
    )
    return E.best_and_worst(rows)


@check(
    f"""WITH {PANEL}
SELECT series_id, count(*) AS evaluable_days, count(s) AS n_price_momentum, count(r7) AS n_forward_return_7d, count(r30) AS n_forward_return_30d,
  CAST(min(as_of_date) AS VARCHAR) AS date_min, CAST(max(as_of_date) AS VARCHAR) AS date_max FROM panel GROUP BY ALL"""
)
def panel_summary(t: Tables) -> DataFrame:
    return E.panel_summary(panel(t)).select(
        "series_id", "evaluable_days", "n_price_momentum", "n_forward_return_7d",
        "n_forward_return_30d", "date_min", "date_max",
    )


@check(
    f"""WITH {PANEL}, p AS (SELECT series_id, count(*) AS validated_prices FROM prices WHERE validation_status = 'validated' GROUP BY ALL)
SELECT series_id, validated_prices, count(*) AS evaluable_days FROM panel JOIN p USING (series_id) WHERE validated_prices >= 100 GROUP BY ALL HAVING count(*) >= 30"""
)
def sufficient_series(t: Tables) -> DataFrame:
    return E.sufficient_series(t.prices(), panel(t))
