"""Names, thresholds and weights that results depend on."""

# Observation lifecycle.
RECEIVED = "received"
VALIDATED = "validated"
PUBLISHED = "published"
SUPERSEDED = "superseded"
REJECTED = "rejected"
STATUSES = (RECEIVED, VALIDATED, PUBLISHED, SUPERSEDED, REJECTED)
USABLE_STATUSES = (VALIDATED, PUBLISHED)
WEATHER_USABLE_STATUSES = (VALIDATED, PUBLISHED, RECEIVED)
STATUS_RANK = {VALIDATED: 3, PUBLISHED: 2, RECEIVED: 1}

# Signal vocabulary.
BULLISH = "bullish"
BEARISH = "bearish"
NEUTRAL = "neutral"
DIRECTIONS = (BULLISH, BEARISH, NEUTRAL)
AGENTS = ("Market", "Weather", "Policy", "Demand", "Futures", "Global")
LINEAGE_PREFIXES = ("market", "weather", "futures")
MODAL = "modal"

# Market signal.
MARKET_WINDOW_DAYS = 30
MARKET_BAND = 0.05
Z_SCALE = 3
MARKET_WEIGHTS = {
    "price_momentum": "0.35",
    "arrival_momentum": "0.25",
    "price_vs_msp_distance": "0.25",
    "price_acceleration": "0.15",
}
MARKET_CONFIDENCE_BASE = "0.75"
FLOOR_STUB_PENALTY = "0.10"
FLOOR_STUB_PRICE = 7121
FLOOR_RULE_KEY = "msp_inr_quintal"
PROXIMITY_RULE_KEY = "msp_proximity_pct"
PROXIMITY_DEFAULT = 0.03
LAG_HOURS_CAP = 72.0
MAX_LAG_PENALTY = 0.30
ARRIVAL_SEASON_MONTHS = (10, 11, 12, 1, 2, 3)

# Futures signal.
FUTURES_WINDOW_DAYS = 20
FUTURES_BAND = "0.01"
FUTURES_WEIGHTS = {
    "curve_slope": "0.35",
    "basis": "0.30",
    "open_interest": "0.20",
    "curve_regime": "0.15",
}
FUTURES_CONFIDENCE_BASE = "0.35"
FUTURES_CONFIDENCE_CAP = "0.35"
FUTURES_FEED_FACTOR = "0.35"
SPOT_GAP_PENALTY = "0.20"
THIN_OPEN_INTEREST = 50
THIN_OPEN_INTEREST_PENALTY = "0.15"
FUTURES_SYMBOLS = ("KAPAS", "SHANKRKPAS")
FUTURES_SERIES = ("FUT", "FUTCOM", "FUTIDX")

# Weather signal.
DRIVER_THRESHOLD = "0.15"
OPTIMAL_TEMPERATURE = "28"
TEMPERATURE_BAND = "10"
SHOCK_FLOOR_MM = 5
HARVEST_RAIN_MM = 80
STAGE_HIGH = "1.0"
STAGE_MEDIUM = "0.6"
STAGE_LOW = "0.3"
HARVEST_MONTHS = (10, 11, 12, 1, 2)
GROWTH_MONTHS = (8, 9)
SOWING_MONTHS = (6, 7)
STORAGE_MONTHS = (11, 12, 1, 2, 3)
WEATHER_CONFIDENCE_BASE = "0.9"

# Quality.
STALE_LAG_HOURS = 48.0
FRESHNESS_HOURS = 168.0
QUALITY_WINDOW_DAYS = 30

# Validation ranges.
PRICE_RANGE = (100, 100000)
VOLUME_RANGE = (0, 500000)
MAX_OBSERVED_LAG_DAYS = 1
RAINFALL_RANGE = (0.0, 500.0)
TEMPERATURE_RANGE = (-5.0, 55.0)
SETTLE_CAP = 1_000_000.0

# Ingest vocabulary.
COMMODITY = "cotton"
COMMODITY_LABELS = ("Cotton", "Kapas", "Cotton (Unginned)", "Cotton-Bags", "Cotton-Loose")
EXCLUDED_LABELS = ("Cotton Seed",)
MARKET_SOURCE = "agmarknet"
WEATHER_SOURCES = ("nasa_power", "imd")
FUTURES_SOURCE = "ncdex_public_bhav_prototype"
FUTURES_ENVIRONMENTS = ("prototype", "production")
POLICY_TYPES = (
    "msp_announcement",
    "cci_procurement",
    "export_ban",
    "export_restriction_lifted",
)
POLICY_SOURCES = ("pib_manual", "cci_manual", "seed_fixture")
UNIT = "quintal"
CURRENCY = "INR"
TONNES_TO_QUINTAL = 10
LOTS_TO_QUINTAL = 5
DISTRICT_REGIONS = {
    "Khammam": "reg_tg_khammam",
    "Warangal": "reg_tg_warangal",
    "Karimnagar": "reg_tg_karimnagar",
    "Nalgonda": "reg_tg_nalgonda",
    "Mahabubabad": "reg_tg_mahabubabad",
}
# Exchange file headers in order of preference.
FUTURES_HEADERS = {
    "trade_date": ("TradDt", "BizDt", "RptDt", "Trade Date", "Business Date"),
    "symbol": ("TckrSymb", "Symbol", "SYMBOL", "Ticker"),
    "series": ("SctySrs", "Series", "SERIES", "Instrument Type"),
    "expiry": ("XpryDt", "Expiry Date", "EXPIRY_DT", "ExpiryDt"),
    "settle": (
        "SttlPric", "Settle Price", "SETTLE_PR", "Settlement Price", "Close Price", "ClsPric",
    ),
    "open_interest": ("OpnIntrst", "Open Interest", "OPEN_INT", "OI"),
    "volume": ("TtlTradgVol", "Total Traded Volume", "VOLUME", "Traded Volume"),
}

# Forecasting.
HORIZONS = (30, 60, 90)
MIN_TRAIN_ROWS = 60
TEST_ROWS = 20
WALK_FORWARD_MIN_TRAIN = 24
MAPE_EPSILON = 1e-6
FOREST_TREES = 50
FOREST_DEPTH = 20
MODEL_SEED = 42
MODEL_VERSION_MARK = "@pi11-"
NAIVE = "naive_persistence"
LINEAR = "linear_regression"
FOREST = "random_forest"
FORWARD_HORIZONS = (7, 30)
TRACKED_SIGNALS = ("price_momentum", "arrival_momentum", "rainfall_shock", "temperature_stress")
MIN_PAIRS = 3
MIN_VALIDATED_PRICES = 100
MIN_EVALUABLE_DAYS = 30
WEIGHT_SUM_TOLERANCE = 0.001
PERSONAS = ("farmer", "trader")
LIQUIDITY_NEEDS = ("low", "medium", "high")
ACTIONS = ("SELL", "HOLD", "PARTIAL_SELL", "PARTIAL_HOLD")
