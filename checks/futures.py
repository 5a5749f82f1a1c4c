"""Futures family: curve, basis, open-interest history, composite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql as Q
from checks.base import check
from tidemark.adapters import Tables
from tidemark.functions import futures as X
from tidemark.operators import basket as B
from tidemark.operators import contracts as C
from tidemark.operators import rolling
from tidemark.plans.futures_signal import futures_signal

NEAR_FAR_SQL = """ordered AS (
  SELECT *, row_number() OVER (PARTITION BY series_id, as_of_date ORDER BY expiry_date, contract_symbol) AS pos
  FROM futures WHERE expiry_date > as_of_date),
curve AS (
  SELECT n.series_id, n.as_of_date, n.contract_symbol AS near_symbol, n.expiry_date AS near_expiry,
    n.settle_price AS near_settle, f.contract_symbol AS far_symbol, f.expiry_date AS far_expiry,
    f.settle_price AS far_settle
  FROM ordered n JOIN ordered f USING (series_id, as_of_date) WHERE n.pos = 1 AND f.pos = 2)"""

# Per marked day the near contract's own history as a list, independent of the integer sums.
HISTORY_SQL = """sessions AS (
  SELECT series_id, expiry_date, as_of_date, max_by(open_interest, contract_symbol) AS oi
  FROM futures WHERE open_interest IS NOT NULL GROUP BY ALL),
history0 AS (
  SELECT c.series_id, c.as_of_date, list(s.oi ORDER BY s.as_of_date) FILTER (s.oi IS NOT NULL) AS h
  FROM curve c LEFT JOIN sessions s ON s.series_id = c.series_id AND s.expiry_date = c.near_expiry
    AND s.as_of_date BETWEEN c.as_of_date - 20 AND c.as_of_date GROUP BY ALL),
history1 AS (
  SELECT *, coalesce(len(h), 0) AS sessions,
    [CASE WHEN h[i-1] <= 0 THEN 0 ELSE round((h[i] - h[i-1]) / h[i-1]::DOUBLE, 4) END
     FOR i IN range(2, coalesce(len(h), 0) + 1)] AS d FROM history0),
history2 AS (
  SELECT *, list_avg(d) AS mean, list_avg([(x - list_avg(d)) * (x - list_avg(d)) FOR x IN d]) AS var FROM history1),
history AS (
  SELECT series_id, as_of_date, sessions, h[-1] AS latest_open_interest,
    CAST(CASE WHEN len(d) >= 2 AND var > 1e-18 THEN round((d[-1] - mean) / sqrt(var), 4) ELSE 0 END AS DECIMAL(12,4)) AS oi_z
  FROM history2)"""


@check(
    f"""WITH {Q.FUTURES}, {NEAR_FAR_SQL}
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, near_symbol,
  CAST(near_expiry AS VARCHAR) AS near_expiry, near_settle, far_symbol,
  CAST(far_expiry AS VARCHAR) AS far_expiry, far_settle FROM curve"""
)
def near_far_contracts(t: Tables) -> DataFrame:
    return C.near_far(B.usable_rows(t.futures())).drop("near_observed_at")


@check(
    f"""WITH {Q.FUTURES}, {NEAR_FAR_SQL}, {HISTORY_SQL}
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, sessions, latest_open_interest,
  CAST(oi_z AS DOUBLE) AS open_interest_z FROM history"""
)
def open_interest_history(t: Tables) -> DataFrame:
    usable = B.usable_rows(t.futures())
    marks = C.near_far(usable).select(
        "series_id", F.col("near_expiry").alias("expiry_date"), "as_of_date"
    )
    return rolling.open_interest_change(C.open_interest_history(usable), marks).drop("expiry_date")


@check(
    f"""WITH {Q.FUTURES}, {NEAR_FAR_SQL}, {Q.BASKET}, joined AS (
  SELECT c.*, b.level AS spot, CAST(round((near_settle - far_settle) / near_settle, 4) AS DECIMAL(12,4)) AS slope,
    CASE WHEN b.level > 0 THEN CAST(round((near_settle - b.level) / b.level, 4) AS DECIMAL(12,4)) ELSE 0 END AS basis
  FROM curve c LEFT JOIN basket b USING (series_id, as_of_date))
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, CAST(slope AS DOUBLE) AS curve_slope,
  CAST(basis AS DOUBLE) AS basis_futures_spot, CASE WHEN slope > 0.01 THEN 'backwardation'
    WHEN slope < -0.01 THEN 'contango' ELSE 'flat' END AS curve_regime FROM joined"""
)
def curve_and_basis(t: Tables) -> DataFrame:
    spot = B.price_basket(B.usable_rows(t.prices())).withColumnRenamed("level", "spot")
    rows = C.near_far(B.usable_rows(t.futures())).join(spot, ["series_id", "as_of_date"], "left")
    slope = X.curve_slope(F.col("near_settle"), F.col("far_settle"))
    return rows.select(
        "series_id",
        "as_of_date",
        slope.alias("curve_slope"),
        X.basis(F.col("near_settle"), F.col("spot")).alias("basis_futures_spot"),
        X.regime(slope).alias("curve_regime"),
    )


FUTURES_SIGNAL_SQL = f"""WITH {Q.FUTURES}, {NEAR_FAR_SQL}, {HISTORY_SQL}, {Q.BASKET},
days AS (SELECT DISTINCT series_id, as_of_date FROM futures),
joined AS (
  SELECT d.series_id, d.as_of_date, c.near_settle, c.far_settle, b.level AS spot, h.latest_open_interest AS oi,
    c.near_settle IS NOT NULL AS has_curve, coalesce(h.oi_z, 0) AS z,
    CAST(CASE WHEN c.near_settle > 0 THEN round((near_settle - far_settle) / near_settle, 4) ELSE 0 END AS DECIMAL(12,4)) AS slope,
    CAST(CASE WHEN c.near_settle > 0 AND b.level > 0 THEN round((near_settle - b.level) / b.level, 4) ELSE 0 END AS DECIMAL(12,4)) AS basis
  FROM days d LEFT JOIN curve c USING (series_id, as_of_date) LEFT JOIN history h USING (series_id, as_of_date)
  LEFT JOIN basket b USING (series_id, as_of_date)),
parts AS (
  SELECT *, CASE WHEN slope > 0.01 THEN 'backwardation' WHEN slope < -0.01 THEN 'contango' ELSE 'flat' END AS regime,
    {Q.unit('abs(z) / 3.0::DOUBLE')} AS zm, CASE WHEN abs(slope) > 0.01 THEN 1 ELSE 0 END AS rm FROM joined),
weighed AS (
  SELECT *, abs(slope) * 0.35 AS w1, abs(basis) * 0.30 AS w2, zm * 0.20 AS w3, rm * 0.15 AS w4,
    {Q.band('slope', '0.01')} AS d1, {Q.band('basis', '0.01')} AS d2, {Q.band('z', '0.01')} AS d3 FROM parts),
driven AS (
  SELECT *, CASE WHEN NOT has_curve THEN 'curve_slope' ELSE
    (CASE greatest(w1, w2, w3, w4) WHEN w3 THEN 'open_interest' WHEN w1 THEN 'curve_slope'
      WHEN w4 THEN 'curve_regime' ELSE 'basis' END) END AS driver FROM weighed),
owned AS (
  SELECT *, CASE driver WHEN 'open_interest' THEN d3 WHEN 'basis' THEN d2 ELSE d1 END AS own,
    0.35 * ({Q.sign('d1')}) + 0.30 * ({Q.sign('d2')}) + 0.20 * ({Q.sign('d3')}) + 0.15 * ({Q.sign('d1')}) AS votes FROM driven),
scored AS (
  SELECT *, CASE WHEN NOT has_curve THEN 'neutral' WHEN own <> 'neutral' THEN own ELSE {Q.band('votes', '0.01')} END AS direction,
    {Q.unit('0.35 * ' + Q.unit('abs(slope)') + ' + 0.30 * ' + Q.unit('abs(basis)') + ' + 0.20 * zm + 0.15 * rm')} AS magnitude,
    CASE WHEN has_curve AND oi > 0 AND oi < 50 THEN 0.15 ELSE 0.00 END AS thin,
    CASE WHEN spot IS NULL THEN 0.20 ELSE 0.00 END AS gap FROM owned)
SELECT series_id, CAST(as_of_date AS VARCHAR) AS as_of_date, CAST(slope AS DOUBLE) AS curve_slope,
  CAST(basis AS DOUBLE) AS basis_futures_spot, CAST(z AS DOUBLE) AS open_interest_change,
  regime AS curve_regime, driver AS primary_driver, direction, CAST(magnitude AS DOUBLE) AS magnitude,
  CAST({Q.unit('least(0.35 * 0.35 * (1 - thin) * (1 - gap), 0.35)')} AS DOUBLE) AS confidence,
  CAST(({Q.sign('direction')}) * magnitude AS DOUBLE) AS value FROM scored"""


@check(FUTURES_SIGNAL_SQL)
def futures_signal_daily(t: Tables) -> DataFrame:
    spot = B.price_basket(B.usable_rows(t.prices()))
    return futures_signal(t.futures(), spot).select(
        "series_id", "as_of_date", "curve_slope", "basis_futures_spot", "open_interest_change",
        "curve_regime", "primary_driver", "direction", "magnitude", "confidence", "value",
    )
