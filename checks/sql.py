"""SQL text of the observation views that ``tidemark.adapters`` builds with DataFrames."""

CENTS = "CAST(floor(l_extendedprice * 100 / l_quantity) AS DOUBLE)"
LINE_STATUS = "CASE WHEN l_linestatus = 'F' THEN 'validated' ELSE 'received' END"
LINE_ID = (
    "concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
    "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), "
    f"CAST(CAST(l_shipdate AS DATE) AS VARCHAR), CAST(CAST({CENTS} AS BIGINT) AS VARCHAR))"
)

PRICES = f"""prices AS (
  SELECT p_type AS series_id, l_suppkey AS market_id, CAST(l_shipdate AS DATE) AS as_of_date,
    CASE l_returnflag WHEN 'A' THEN 'modal' WHEN 'N' THEN 'min' ELSE 'max' END AS price_type,
    {CENTS} AS value, {LINE_STATUS} AS validation_status, {LINE_ID} AS observation_id,
    l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS observed_at
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""

ARRIVALS = f"""arrivals AS (
  SELECT p_type AS series_id, l_suppkey AS market_id, CAST(l_shipdate AS DATE) AS as_of_date,
    l_quantity AS volume, {LINE_STATUS} AS validation_status, {LINE_ID} AS observation_id,
    l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS observed_at
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""

BASKET = PRICES + """,
permarket AS (
  SELECT series_id, as_of_date, market_id, median(value) AS level
  FROM prices WHERE price_type = 'modal' AND validation_status IN ('validated', 'published')
  GROUP BY ALL),
basket AS (
  SELECT series_id, as_of_date, median(level) AS level, count(*) AS markets_reporting
  FROM permarket GROUP BY ALL)"""

VOLUMES = ARRIVALS + """,
volumes AS (
  SELECT series_id, as_of_date, sum(volume) AS volume
  FROM arrivals WHERE validation_status IN ('validated', 'published') GROUP BY ALL)"""

WEATHER = """weather0 AS (
  SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
weather AS (
  SELECT 'belt' AS series_id, o_orderpriority AS region_id, CAST(o_orderdate AS DATE) AS as_of_date,
    CASE WHEN cents % 11 <> 0 THEN (cents % 640) / 16.0::DOUBLE END AS rainfall_mm,
    CASE WHEN cents % 13 <> 0 THEN 15.0::DOUBLE + (cents % 400) / 16.0::DOUBLE END AS temperature_mean_c,
    CASE WHEN cents % 17 <> 0 THEN 30.0::DOUBLE + (cents % 112) / 2.0::DOUBLE END AS relative_humidity_pct,
    CASE WHEN o_custkey % 10 = 0 THEN 'rejected' WHEN o_orderstatus = 'F' THEN 'validated'
      WHEN o_orderstatus = 'O' THEN 'received' ELSE 'published' END AS validation_status,
    o_orderkey AS observation_id, o_orderdate AS observed_at
  FROM weather0)"""

REGIONAL = WEATHER + """,
picked AS (
  SELECT * FROM weather WHERE validation_status <> 'rejected' AND rainfall_mm IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY series_id, region_id, as_of_date ORDER BY
    CASE validation_status WHEN 'validated' THEN 3 WHEN 'published' THEN 2 ELSE 1 END DESC,
    observation_id) = 1),
regional AS (
  SELECT series_id, as_of_date, avg(rainfall_mm) AS rainfall_mm,
    avg(temperature_mean_c) AS temperature_mean_c,
    avg(relative_humidity_pct) AS relative_humidity_pct, count(*) AS regions_reporting,
    (SELECT count(DISTINCT region_id) FROM weather) AS regions_expected
  FROM picked GROUP BY ALL)"""

FUTURES = f"""futures0 AS (
  SELECT p_type AS series_id, p_brand AS contract_symbol, CAST(o_orderdate AS DATE) AS as_of_date,
    CAST(last_day(l_shipdate) AS DATE) AS expiry_date, max({CENTS}) AS settle_price,
    CAST(sum(l_quantity) AS BIGINT) AS oi
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  WHERE CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) GROUP BY ALL),
futures AS (
  SELECT series_id, contract_symbol, as_of_date, expiry_date, settle_price,
    CASE WHEN oi % 7 <> 0 THEN oi END AS open_interest, 'validated' AS validation_status
  FROM futures0)"""

PAIRS = """pairs0 AS (
  SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
pairs AS (
  SELECT o_orderpriority AS series_id, o_orderkey AS pair_id,
    CAST(o_orderdate AS DATE) AS as_of_date,
    CAST((o_orderkey % 3 + 1) * 30 AS BIGINT) AS horizon_days,
    CASE WHEN cents % 37 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS actual,
    o_totalprice + (cents % 2001 - 1000) AS predicted,
    CASE WHEN cents % 5 <> 0 THEN o_totalprice + (cents % 2001 - 1000) - 500.0::DOUBLE END AS band_low,
    CASE WHEN cents % 7 <> 0 THEN o_totalprice + (cents % 2001 - 1000) + 500.0::DOUBLE END AS band_high
  FROM pairs0)"""

SIGNALS = """signals AS (
  SELECT 'c' || CAST(user_id % 4 AS VARCHAR) AS commodity_id, CAST(ts AS DATE) AS as_of_date,
    'r1' AS registry_id,
    CASE event_type WHEN 'click' THEN 'Market' WHEN 'view' THEN 'Weather'
      WHEN 'purchase' THEN 'Policy' WHEN 'signup' THEN 'Demand' ELSE 'Futures' END AS agent_type,
    CASE event_id % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS direction,
    CAST(round(least(value / 500.0::DOUBLE, 1.0), 4) AS DECIMAL(5,4)) AS magnitude,
    CAST(round(1.0 - least(value / 500.0::DOUBLE, 1.0), 4) AS DECIMAL(5,4)) AS confidence,
    CAST(json_extract(props, '$.k') AS VARCHAR) AS k, ts AS as_of_timestamp, event_id AS signal_id
  FROM events)"""


def unit(expression: str) -> str:
    """Clip to [0, 1] at four places, as a decimal."""
    return f"CAST(round(least(greatest({expression}, 0), 1), 4) AS DECIMAL(5,4))"


def signed(expression: str) -> str:
    return f"CAST(round(least(greatest({expression}, -1), 1), 4) AS DECIMAL(5,4))"


def band(expression: str, edge: str) -> str:
    return (
        f"CASE WHEN {expression} > {edge} THEN 'bullish' "
        f"WHEN {expression} < -{edge} THEN 'bearish' ELSE 'neutral' END"
    )


def sign(column: str) -> str:
    return f"CASE {column} WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END"


def text_round(expression: str) -> str:
    """Half-up at four places on the decimal text of a double, as Spark rounds."""
    text = f"CAST(CAST({expression} AS VARCHAR) AS DECIMAL(30,20))"
    return f"CAST(round({text}, 4) AS DOUBLE)"
