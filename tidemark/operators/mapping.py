"""Landed records to observation rows: parsing, label and market lookup, unpivot, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import dates
from tidemark.session import written_once

MARKET_KEY = ["state", "district", "market"]
REQUIRED = (*MARKET_KEY, "commodity", "arrival_date")
NUMBERS = ("min_price", "max_price", "modal_price")
# Exceeds the stored width so that rounding happens once, at the end.
_WIDE = "decimal(24,8)"


def text_or_null(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def parse_records(raw: DataFrame) -> DataFrame:
    """Typed market records with ``reject_reason``; NULL means the row is good.

    Empty strings count as missing; any number that is present but unreadable rejects the row.
    Extra columns (file name, position) pass through.
    """
    texts = (*REQUIRED, "variety", "grade")
    extra = [c for c in raw.columns if c not in (*texts, *NUMBERS, "arrival_tonnes", "arrival")]
    tonnage = F.coalesce(F.nullif("arrival_tonnes", F.lit("")), F.nullif("arrival", F.lit("")))
    given = {n: F.nullif(F.col(n), F.lit("")) for n in NUMBERS} | {"arrival_tonnes": tonnage}
    values = [
        *[F.trim(F.col(c)).alias(c) for c in texts if c != "arrival_date"],
        text_or_null("arrival_date").isNull().alias("_no_date"),
        dates.day_first_date(F.col("arrival_date")).alias("as_of_date"),
        *[F.trim(c).try_cast(_WIDE).alias(n) for n, c in given.items()],
        *[c.isNotNull().alias(f"_has_{n}") for n, c in given.items()],
    ]
    # A generator makes every value once: filters and reasons behind it would carry the parse with them,
    # once for every time they name such a column.
    made = raw.select(*extra, F.inline(F.array(F.struct(*values))))
    reason = F.lit(None).cast("string")
    for name in reversed(given):
        bad = F.col(f"_has_{name}") & F.col(name).isNull()
        reason = F.when(bad, f"invalid numeric value {name}").otherwise(reason)
    reason = F.when(F.col("as_of_date").isNull(), "invalid arrival_date").otherwise(reason)
    for name in reversed(REQUIRED):
        missing = F.col("_no_date") if name == "arrival_date" else F.nullif(F.col(name), F.lit("")).isNull()
        reason = F.when(missing, f"missing required field {name}").otherwise(reason)
    return made.select(
        *extra, *MARKET_KEY, "commodity",
        *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("variety", "grade")], "as_of_date",
        *[F.col(n).cast("decimal(18,4)").alias(n) for n in given],
        reason.alias("reject_reason"),
    )


def commodity_of(label: Column) -> Column:
    """Commodity of a known label; excluded and unknown labels are NULL."""
    text = F.trim(label)
    return F.when(
        text.isin(*fixed.COMMODITY_LABELS) & ~text.isin(*fixed.EXCLUDED_LABELS), fixed.COMMODITY
    )


def quality_grade(variety: Column, grade: Column) -> Column:
    return F.nullif(F.concat_ws("|", variety, grade), F.lit(""))


def resolve_markets(records: DataFrame, markets: DataFrame) -> DataFrame:
    """Market id by trimmed (state, district, market); unknown markets keep NULL for counting."""
    named = markets.select(*[F.trim(F.col(c)).alias(c) for c in MARKET_KEY], "market_id")
    # Should two markets share a name, the smaller id is taken in every run.
    # Written first: of known size, a small table meets the records where they are, without their shuffle.
    known = written_once(named.groupBy(*MARKET_KEY).agg(F.min("market_id").alias("market_id")))
    return records.join(known, MARKET_KEY, "left")


def map_records(parsed: DataFrame, markets: DataFrame) -> DataFrame:
    """Good records with commodity, market and grade; rows without either id are left out."""
    good = parsed.filter(F.col("reject_reason").isNull())
    named = good.withColumn("commodity_id", commodity_of(F.col("commodity"))).filter(
        F.col("commodity_id").isNotNull()
    )
    return (
        resolve_markets(named, markets)
        .filter(F.col("market_id").isNotNull())
        .withColumn("quality_grade", quality_grade(F.col("variety"), F.col("grade")))
    )


def _observed(observed_at: Column | None) -> Column:
    return observed_at if observed_at is not None else dates.at_time(
        F.col("as_of_date"), dates.MARKET_CLOSE
    )


def price_rows(
    mapped: DataFrame, order: list[str], source: str = fixed.MARKET_SOURCE,
    observed_at: Column | None = None,
) -> DataFrame:
    """One row per present price of modal, min, max."""
    wide = mapped.select(
        *order, "market_id", "commodity_id", "quality_grade", "as_of_date",
        F.col("modal_price").alias("modal"), F.col("min_price").alias("min"),
        F.col("max_price").alias("max"),
    )
    ids = [*order, "market_id", "commodity_id", "quality_grade", "as_of_date"]
    return (
        wide.unpivot(ids, ["modal", "min", "max"], "price_type", "value")
        .filter(F.col("value").isNotNull())
        .select(
            *ids, "price_type", "value",
            F.lit(fixed.UNIT).alias("unit"),
            F.lit(fixed.CURRENCY).alias("currency"),
            _observed(observed_at).alias("observed_at"),
            F.lit(source).alias("source"),
            F.lit(fixed.RECEIVED).alias("validation_status"),
        )
    )


def first_price_rows(
    mapped: DataFrame, order: list[str], source: str = fixed.MARKET_SOURCE,
    observed_at: Column | None = None,
) -> DataFrame:
    """What ``price_rows`` and then the first row of each key by ``order`` give, in one grouping.

    The three price types of a record share the rest of their key, so the first modal, min and max
    price of a key are found side by side before they become rows: a third of the rows is grouped.
    """
    keys = ["market_id", "as_of_date", "quality_grade"]
    named = {"modal": "modal_price", "min": "min_price", "max": "max_price"}
    wide = mapped.withColumn("observed_at", _observed(observed_at))
    first = lambda c: F.min(
        F.when(F.col(c).isNotNull(), F.struct(*order, "commodity_id", F.col(c).alias("value"), "observed_at"))
    )
    firsts = wide.groupBy(*keys).agg(*[first(c).alias(kind) for kind, c in named.items()])
    kinds = [F.struct(F.lit(kind).alias("price_type"), F.col(kind).alias("_first")) for kind in named]
    long = firsts.select(*keys, F.inline(F.array(*kinds))).filter(F.col("_first").isNotNull())
    return long.select(
        *[F.col("_first")[c].alias(c) for c in order], "market_id", F.col("_first")["commodity_id"].alias("commodity_id"),
        "quality_grade", "as_of_date", "price_type", F.col("_first")["value"].alias("value"),
        F.lit(fixed.UNIT).alias("unit"),
        F.lit(fixed.CURRENCY).alias("currency"),
        F.col("_first")["observed_at"].alias("observed_at"),
        F.lit(source).alias("source"),
        F.lit(fixed.RECEIVED).alias("validation_status"),
    )


def arrival_rows(
    mapped: DataFrame, order: list[str], source: str = fixed.MARKET_SOURCE,
    observed_at: Column | None = None,
) -> DataFrame:
    """Tonnage in quintals; rows without tonnage give none."""
    return mapped.filter(F.col("arrival_tonnes").isNotNull()).select(
        *order, "market_id", "commodity_id", "as_of_date",
        (F.col("arrival_tonnes") * fixed.TONNES_TO_QUINTAL).cast("decimal(18,4)").alias("volume"),
        F.lit(fixed.UNIT).alias("unit"),
        _observed(observed_at).alias("observed_at"),
        F.lit(source).alias("source"),
        F.lit(fixed.RECEIVED).alias("validation_status"),
    )


def lots_to_quintal(price: Column) -> Column:
    """Price per 20 kg to price per quintal."""
    return F.round(price * fixed.LOTS_TO_QUINTAL, 4)


def weather_rows(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Weather points as observations with ``reject_reason`` for out-of-range or unknown rows."""
    joined = points.join(
        regions.select("district_name", "region_id"), "district_name", "left"
    )
    rain, temp = F.col("rainfall_mm"), F.col("temperature_mean_c")
    reason = (
        F.when(rain.isNull() | ~rain.between(*fixed.RAINFALL_RANGE), "rainfall_mm out of range")
        .when(temp.isNull() | ~temp.between(*fixed.TEMPERATURE_RANGE),
              "temperature_mean_c out of range")
        .when(F.col("region_id").isNull(), "unknown weather district")
    )
    return joined.select(
        *[c for c in points.columns if c not in
          ("rainfall_mm", "temperature_mean_c", "relative_humidity_pct")],
        "region_id",
        F.lit(fixed.COMMODITY).alias("commodity_id"),
        F.round("rainfall_mm", 4).cast("decimal(10,4)").alias("rainfall_mm"),
        F.round("temperature_mean_c", 2).cast("decimal(10,4)").alias("temperature_mean_c"),
        F.round("relative_humidity_pct", 2).cast("decimal(10,4)").alias("relative_humidity_pct"),
        dates.at_time(F.col("as_of_date"), dates.WEATHER_NOON).alias("observed_at"),
        F.lit(fixed.WEATHER_SOURCES[0]).alias("source"),
        F.lit(fixed.RECEIVED).alias("validation_status"),
        reason.alias("reject_reason"),
    )


def district_regions(spark) -> DataFrame:
    """The fixed district to region table."""
    return spark.createDataFrame(
        list(fixed.DISTRICT_REGIONS.items()), "district_name string, region_id string"
    )


def observation_id(keys: list[str]) -> Column:
    """Deterministic id from the business key."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def parse_futures(raw: DataFrame, default_day: Column | None = None) -> DataFrame:
    """Exchange rows with canonical text columns to typed contracts.

    Other symbols and series leave silently; rows that cannot be read keep a ``reject_reason``.
    Extra columns pass through.
    """
    symbol = F.upper(text_or_null("symbol"))
    series = F.upper(text_or_null("series"))
    wanted = symbol.isin(*fixed.FUTURES_SYMBOLS) & (
        series.isNull() | series.isin(*fixed.FUTURES_SERIES)
    )
    extra = [c for c in raw.columns if c not in fixed.FUTURES_HEADERS]
    rows = raw.filter(wanted)
    if default_day is not None:
        rows = rows.withColumn("_default", default_day.cast("date"))
    skipped = lambda c, *marks: F.col(c).isNull() | F.col(c).isin(*marks)
    made = [
        dates.any_format_date(F.col("trade_date")).alias("_day"),
        dates.any_format_date(F.col("expiry")).alias("expiry_date"),
        dates.decimal_text(F.col("settle"), _WIDE).alias("_settle"),
        F.when(~skipped("open_interest", "-", "0"), dates.decimal_text(F.col("open_interest"), _WIDE).cast("long"))
        .alias("_interest"),
        F.when(~skipped("volume", "-"), dates.decimal_text(F.col("volume"), _WIDE)).alias("_volume"),
    ]
    kept = [*extra, *([] if default_day is None else ["_default"])]
    texts = rows.select(
        *kept, symbol.alias("contract_symbol"),
        *[text_or_null(c).alias(c) for c in ("trade_date", "expiry", "settle", "open_interest", "volume", "series")],
    )
    # Values are made once, behind a generator: filters on what follows would carry the parse with them.
    parsed = texts.select("*", F.inline(F.array(F.struct(*made))))
    day, settle = F.col("_day"), F.col("_settle")
    if default_day is not None:
        day = F.when(F.col("trade_date").isNull(), F.col("_default")).otherwise(day)
    reason = (
        F.when(day.isNull(), "missing or unreadable trade date")
        .when(F.col("expiry_date").isNull(), "missing or unreadable expiry date")
        .when(settle.isNull(), "missing or unreadable settlement price")
        .when(settle <= 0, "settlement price must be > 0")
        .when(~skipped("open_interest", "-", "0") & F.col("_interest").isNull(), "invalid open interest")
        .when(~skipped("volume", "-") & F.col("_volume").isNull(), "invalid volume")
    )
    return parsed.select(
        *extra,
        day.alias("as_of_date"),
        "contract_symbol",
        "expiry_date",
        settle.cast("decimal(18,4)").alias("settle_price"),
        lots_to_quintal(settle).cast("decimal(18,4)").alias("settle_price_quintal"),
        F.col("_interest").alias("open_interest"),
        F.col("_volume").cast("decimal(18,4)").alias("volume"),
        "series",
        dates.at_time(day, dates.FUTURES_CLOSE).alias("observed_at"),
        F.lit(fixed.FUTURES_SOURCE).alias("source"),
        F.lit(fixed.RECEIVED).alias("validation_status"),
        reason.alias("reject_reason"),
    )
