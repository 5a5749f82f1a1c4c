"""Table schemas of the data model, as DDL text."""

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 4)
MEASURE = T.DecimalType(10, 4)
UNIT_SCORE = T.DecimalType(5, 4)
# Four-place scores beyond [-1, 1], such as z-scores and relative distances.
EXACT = T.DecimalType(12, 4)


PRICE_OBSERVATION = (
    "observation_id string, market_id string, commodity_id string, price_type string, "
    "value decimal(18,4), unit string, currency string, as_of_date date, observed_at timestamp, "
    "source string, quality_grade string, supersedes_id string, validation_status string"
)
ARRIVAL_OBSERVATION = (
    "observation_id string, market_id string, commodity_id string, volume decimal(18,4), "
    "unit string, as_of_date date, observed_at timestamp, source string, supersedes_id string, "
    "validation_status string"
)
WEATHER_OBSERVATION = (
    "observation_id string, region_id string, commodity_id string, district_name string, "
    "as_of_date date, rainfall_mm decimal(10,4), temperature_mean_c decimal(10,4), "
    "relative_humidity_pct decimal(10,4), observed_at timestamp, source string, "
    "provenance map<string,string>, validation_status string"
)
FUTURES_OBSERVATION = (
    "observation_id string, commodity_id string, contract_symbol string, as_of_date date, "
    "expiry_date date, settle_price decimal(18,4), quote_unit string, "
    "settle_price_quintal decimal(18,4), open_interest bigint, volume decimal(18,4), "
    "series string, observed_at timestamp, source string, environment string, "
    "validation_status string"
)
POLICY_OBSERVATION = (
    "observation_id string, commodity_id string, policy_type string, source string, "
    "published_date date, effective_date date, impact_direction string, "
    "confidence decimal(5,4), summary string, provenance map<string,string>, "
    "validation_status string"
)
QUALITY_SNAPSHOT = (
    "commodity_id string, as_of_date date, registry_id string, source_health string, "
    "overall_quality_score double, lag_hours double, futures_feed_ok boolean, "
    "confidence_penalty_factor double, written bigint"
)
REGISTRY = (
    "registry_id string, commodity_id string, version string, effective_from date, "
    "effective_to date, is_active boolean, required_agents array<string>, "
    "optional_agents array<string>, signal_weights map<string,double>, "
    "decision_rules map<string,string>, forecast_horizons array<int>, "
    "regime_priority array<string>"
)

# Landed files.
MARKET_RECORD = (
    "state string, district string, market string, commodity string, variety string, "
    "grade string, arrival_date string, min_price string, max_price string, "
    "modal_price string, arrival_tonnes string, arrival string"
)
WEATHER_GRID = (
    "header struct<fill_value:double>, geometry struct<coordinates:array<double>>, "
    "properties struct<parameter:struct<PRECTOTCORR:map<string,double>,"
    "T2M:map<string,double>,RH2M:map<string,double>>>"
)
SEED_DOCUMENT = (
    "commodity struct<commodity_id:string,name:string,status:string,"
    "reference_implementation_flag:boolean>, "
    "commodity_profile struct<display_name:string,unit:string,currency:string,"
    "quality_dimensions:array<string>,storage_characteristics:map<string,string>,"
    "participant_roles_enabled:array<string>,phase_1_active_roles:array<string>>, "
    "registry struct<version:string,effective_from:date,is_active:boolean,"
    "required_agents:array<string>,optional_agents:array<string>,"
    "signal_weights:map<string,double>,regime_priority:array<string>,"
    "forecast_horizons:array<int>,decision_rules:map<string,string>>, "
    "regions array<struct<region_id:string,name:string,type:string,parent_region_id:string,"
    "external_refs:map<string,string>>>, "
    "markets array<struct<market_id:string,region_id:string,market_type:string,name:string,"
    "source_identifiers:struct<agmarknet:struct<state:string,district:string,market:string>>>>"
)
POLICY_DOCUMENT = (
    "commodity_id string, observations array<struct<policy_type:string,source:string,"
    "published_date:date,effective_date:date,impact_direction:string,confidence:string,"
    "summary:string,provenance:map<string,string>>>"
)
METRICS_ROW = (
    "model_name string, horizon_days int, fold_count int, mode string, model_path string, "
    "metrics struct<mae:double,rmse:double,mape_pct:double,n_samples:bigint>"
)
SUPERVISED_CORE = (
    "as_of_date date, commodity_id string, horizon_days int, spot_price_level decimal(18,4), "
    "target_price_level decimal(18,4), target_log_return double, registry_id string, "
    "snapshot_hash string"
)
