"""Rule arrays over observations: issues, status promotion, anomaly counts, constraints."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed

CATEGORIES = {
    "null_fields": "missing_fields",
    "market_mapping": "mapping_failures",
    "commodity_mapping": "mapping_failures",
    "source": "mapping_failures",
    "date_consistency": "stale_observations",
    "price_range": "value_range",
    "arrival_range": "value_range",
}


@dataclass(frozen=True)
class Rule:
    """A named failure condition; rows where ``fails`` is true carry the issue."""

    check: str
    message: str
    fails: Column


def blank(name: str) -> Column:
    col = F.col(name)
    return col.isNull() | (col.cast("string") == "")


def required(names: Iterable[str]) -> list[Rule]:
    return [Rule("null_fields", f"{n} is required", blank(n)) for n in names]


def _outside(name: str, bounds: tuple) -> Column:
    return (F.col(name) < bounds[0]) | (F.col(name) > bounds[1])


def _shared_rules(commodity: str, source: str) -> list[Rule]:
    known = ~blank("commodity_id")
    lag = F.datediff(F.to_date("observed_at"), F.col("as_of_date"))
    return [
        Rule(
            "commodity_mapping",
            "commodity_id not in registry",
            known & F.col("_known_commodity").isNull(),
        ),
        Rule(
            "commodity_mapping",
            f"expected {commodity} commodity_id",
            known & F.col("_known_commodity").isNotNull() & (F.col("commodity_id") != commodity),
        ),
        Rule(
            "market_mapping",
            "market_id not in registry",
            ~blank("market_id") & F.col("_known_market").isNull(),
        ),
        Rule("source", f"expected source {source}", ~blank("source") & (F.col("source") != source)),
        Rule(
            "date_consistency",
            "observed_at date must be within one day after as_of_date",
            (lag < 0) | (lag > fixed.MAX_OBSERVED_LAG_DAYS),
        ),
    ]


def price_rules(commodity: str = fixed.COMMODITY, source: str = fixed.MARKET_SOURCE) -> list[Rule]:
    names = ("market_id", "commodity_id", "price_type", "value", "unit", "currency",
             "observed_at", "as_of_date", "source")
    span = Rule("price_range", "value out of range", _outside("value", fixed.PRICE_RANGE))
    return [*required(names), span, *_shared_rules(commodity, source)]


def arrival_rules(
    commodity: str = fixed.COMMODITY, source: str = fixed.MARKET_SOURCE
) -> list[Rule]:
    names = ("market_id", "commodity_id", "volume", "unit", "observed_at", "as_of_date", "source")
    span = Rule("arrival_range", "volume out of range", _outside("volume", fixed.VOLUME_RANGE))
    return [*required(names), span, *_shared_rules(commodity, source)]


def weather_rules() -> list[Rule]:
    """Ordered: the first failing rule is the row's only issue."""
    rain, temp = F.col("rainfall_mm"), F.col("temperature_mean_c")
    return [
        Rule("commodity_mapping", "unknown commodity", F.col("_known_commodity").isNull()),
        Rule("region_mapping", "unknown region", F.col("_known_region").isNull()),
        Rule(
            "weather_fields",
            "unknown source",
            ~F.coalesce(F.col("source").isin(*fixed.WEATHER_SOURCES), F.lit(False)),
        ),
        Rule(
            "weather_fields",
            "rainfall_mm out of range",
            rain.isNull() | _outside("rainfall_mm", fixed.RAINFALL_RANGE),
        ),
        Rule(
            "weather_fields",
            "temperature_mean_c out of range",
            temp.isNull() | _outside("temperature_mean_c", fixed.TEMPERATURE_RANGE),
        ),
    ]


def issues(rules: list[Rule], first_only: bool = False) -> Column:
    """Array of (check, message) of the failing rules."""
    entries = [
        F.when(r.fails, F.struct(F.lit(r.check).alias("check"), F.lit(r.message).alias("message")))
        for r in rules
    ]
    if first_only:
        first = F.coalesce(*entries)
        return F.when(first.isNotNull(), F.array(first)).otherwise(F.array().cast(_ISSUES))
    # The filter keeps this projection out of whole-stage code, whose single method would grow
    # past what the JVM compiles; as an own projection it is split into small methods.
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


_ISSUES = "array<struct<check:string,message:string>>"


def rule_mask(rules: list[Rule]) -> Column:
    """The failing rules of a row as one number: rule k is bit k, at most 63 rules.

    Sets of issues are compared, grouped and counted as numbers; texts are looked up where they
    are shown (``mask_issues``), once per distinct mask if the rows are grouped by it first.
    """
    if len(rules) > 63:
        raise ValueError(f"a mask holds 63 rules, got {len(rules)}")
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def mask_issues(mask: Column, rules: list[Rule]) -> Column:
    """(check, message) of the bits of a mask, in the order of the rules."""
    names = F.array(*[F.struct(F.lit(r.check).alias("check"), F.lit(r.message).alias("message")) for r in rules])
    return F.filter(names, lambda _, k: F.getbit(mask, k) == 1)


def masked(
    df: DataFrame, rules: list[Rule], dimensions: dict[str, tuple[str, DataFrame]] | None = None
) -> DataFrame:
    """Rows with their ``issue_mask``."""
    tagged = with_reference(df, dimensions or {})
    return tagged.withColumn("issue_mask", rule_mask(rules)).select(*df.columns, "issue_mask")


def issue_counts(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``check``, ``message``, ``issue_count`` of every rule, those that never fail with 0.

    Rows are counted by mask in the map tasks; a rule's count is the sum over the masks that have
    its bit, of which there are few.
    """
    by_mask = rows.groupBy("issue_mask").agg(F.count(F.lit(1)).alias("_n"))
    sums = by_mask.agg(*[
        F.coalesce(F.sum(F.when(F.getbit("issue_mask", F.lit(k)) == 1, F.col("_n"))), F.lit(0)).alias(f"_{k}")
        for k in range(len(rules))
    ])
    named = [
        F.struct(F.lit(r.check).alias("check"), F.lit(r.message).alias("message"), F.col(f"_{k}").alias("issue_count"))
        for k, r in enumerate(rules)
    ]
    return sums.select(F.inline(F.array(*named)))


def with_reference(df: DataFrame, dimensions: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Adds ``_known_<name>`` columns by left joins on distinct dimension ids.

    No broadcast hint: Spark broadcasts a dimension only when its measured size allows, and
    otherwise the skew join splits hot ids.
    """
    for name, (column, dimension) in dimensions.items():
        ids = dimension.select(F.col(dimension.columns[0]).alias(column)).distinct()
        df = df.join(ids.withColumn(f"_known_{name}", F.lit(True)), column, "left")
    return df


def check_observations(
    df: DataFrame,
    rules: Callable[[], list[Rule]] | list[Rule],
    dimensions: dict[str, tuple[str, DataFrame]],
    first_only: bool = False,
) -> DataFrame:
    """Rows with their ``issues`` array."""
    listed = rules() if callable(rules) else rules
    tagged = with_reference(df, dimensions)
    return tagged.withColumn("issues", issues(listed, first_only)).select(*df.columns, "issues")


def promote(checked: DataFrame) -> DataFrame:
    """New status of pending rows: validated without issues, otherwise rejected."""
    clean = F.size("issues") == 0
    status = F.when(
        F.col("validation_status") == fixed.RECEIVED,
        F.when(clean, fixed.VALIDATED).otherwise(fixed.REJECTED),
    ).otherwise(F.col("validation_status"))
    return checked.withColumn("new_status", status)


def promotion_summary(promoted: DataFrame, table: str) -> DataFrame:
    pending = promoted.filter(F.col("validation_status") == fixed.RECEIVED)
    return pending.groupBy(F.lit(table).alias("table_name")).agg(
        F.count(F.lit(1)).alias("examined"),
        F.count_if(F.col("new_status") == fixed.VALIDATED).alias("validated"),
        F.count_if(F.col("new_status") == fixed.REJECTED).alias("rejected"),
    )


def pending_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Received rows per table."""
    union = None
    for name, df in tables.items():
        part = df.filter(F.col("validation_status") == fixed.RECEIVED).select(
            F.lit(name).alias("table_name")
        )
        union = part if union is None else union.unionByName(part)
    return union.groupBy("table_name").agg(F.count(F.lit(1)).alias("pending"))


def issue_histogram(checked: DataFrame) -> DataFrame:
    return (
        checked.select(F.explode("issues.check").alias("check"))
        .groupBy("check")
        .agg(F.count(F.lit(1)).alias("issue_count"))
    )


def categorise(checked: DataFrame, table: str) -> DataFrame:
    """Distinct anomaly categories of each row, including a status that is not usable yet."""
    found = F.array_distinct(F.concat(F.transform("issues", _category), _lifecycle()))
    return checked.withColumn("_found", found).select(
        F.lit(table).alias("table_name"),
        "observation_id",
        "market_id",
        "validation_status",
        *[F.col(c) for c in ("price_type", "quality_grade") if c in checked.columns],
        _or_clean("_found").alias("categories"),
    )


def _category(issue: Column) -> Column:
    name = F.lit("other_validation")
    for check, owner in CATEGORIES.items():
        name = F.when(issue.getField("check") == check, owner).otherwise(name)
    return name


def _lifecycle() -> Column:
    pending = ~F.col("validation_status").isin(*fixed.USABLE_STATUSES)
    return F.when(pending, F.array(F.lit("non_validated_status"))).otherwise(F.array().cast("array<string>"))


def _or_clean(found: str) -> Column:
    clean = F.array(F.lit("clean_data_pending_validation"))
    return F.when(F.size(found) > 0, F.col(found)).otherwise(clean)


CELL = ("validation_status", "price_type", "market_id")


def anomaly_cells(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Masked rows counted by mask, status, price type and market, then classified.

    Categories are worked out once per counted cell instead of once per row.
    """
    cell = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in CELL]
    counted = rows.select("issue_mask", *cell).groupBy("issue_mask", *CELL).agg(F.count(F.lit(1)).alias("_n"))
    found = F.array_distinct(F.concat(F.transform(mask_issues(F.col("issue_mask"), rules), _category), _lifecycle()))
    return counted.withColumn("_found", found).select(*CELL, "_n", _or_clean("_found").alias("categories"))


def anomaly_breakdown(classified: DataFrame) -> DataFrame:
    """Row counts by category, status, price type and market in one grouping-sets pass.

    ``classified`` has one row each (``categorise``) or cells with their count (``anomaly_cells``).
    """
    many = F.col("_n") if "_n" in classified.columns else F.lit(1).alias("_n")
    rows = classified.select(F.posexplode("categories").alias("_at", "category"), *CELL, many)
    # One row per combination before the four-fold expansion. A row shows up once per category;
    # the other breakdowns count it at its first category only.
    cells = rows.groupBy("category", "validation_status", "price_type", "market_id").agg(
        F.sum("_n").alias("_n"), F.sum(F.when(F.col("_at") == 0, F.col("_n")).otherwise(0)).alias("_first")
    )
    sets = cells.groupingSets(
        [[F.col("category")], [F.col("validation_status")], [F.col("price_type")],
         [F.col("market_id")]],
        "category", "validation_status", "price_type", "market_id",
    )
    counted = sets.agg(
        F.grouping_id().alias("_set"), F.sum("_n").alias("_all"), F.sum("_first").alias("_rows")
    )
    by = F.col("_set")
    names = {7: "category", 11: "validation_status", 13: "price_type", 14: "market_id"}
    kind, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for code, column in names.items():
        kind = F.when(by == code, column).otherwise(kind)
        label = F.when(by == code, F.col(column).cast("string")).otherwise(label)
    return counted.select(
        kind.alias("breakdown"),
        label.alias("label"),
        F.when(by == 7, F.col("_all")).otherwise(F.col("_rows")).alias("row_count"),
    ).filter(F.col("label").isNotNull())


def duplicate_keys(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """How many keys repeat and how many rows are surplus."""
    repeated = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    )
    return repeated.agg(
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("surplus_rows"),
    ).select(F.lit(table).alias("table_name"), "duplicate_keys", "surplus_rows")


def missing_references(df: DataFrame, column: str, dimension: DataFrame) -> DataFrame:
    """Referenced ids that the dimension does not have; empty means intact."""
    ids = df.select(column).distinct()
    known = dimension.select(F.col(dimension.columns[0]).alias(column)).distinct()
    return ids.join(known, column, "left_anti")


def reconcile(before: DataFrame, inserted: DataFrame, table: str) -> DataFrame:
    """Before, inserted and after counts of one load."""
    tagged = before.select(F.lit(1).alias("_old")).unionByName(
        inserted.select(F.lit(0).alias("_old"))
    )
    return tagged.agg(
        F.coalesce(F.sum("_old"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(1 - F.col("_old")), F.lit(0)).alias("rows_inserted"),
        F.count(F.lit(1)).alias("rows_after"),
    ).select(F.lit(table).alias("table_name"), "rows_before", "rows_inserted", "rows_after")


def ordered_sample(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by ``order``; Spark keeps only n rows per task."""
    return df.orderBy(*order).limit(n)


def constraints(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Split into rows that meet every rule and rejects with the reasons."""
    tagged = df.withColumn("issues", issues(rules))
    good = tagged.filter(F.size("issues") == 0).drop("issues")
    return good, tagged.filter(F.size("issues") > 0)


def in_set(column: str, values: Iterable[str]) -> Rule:
    ok = F.coalesce(F.col(column).isin(*values), F.lit(False))
    return Rule(column, f"{column} not allowed", ~ok)


def in_unit(column: str, nullable: bool = False) -> Rule:
    x = F.col(column)
    bad = (x < 0) | (x > 1)
    return Rule(column, f"{column} must be in [0, 1]", bad if nullable else bad | x.isNull())


SIGNAL = lambda: [
    in_set("agent_type", fixed.AGENTS), in_set("direction", fixed.DIRECTIONS),
    in_unit("magnitude"), in_unit("confidence"),
]
SNAPSHOT = lambda: [Rule("trace_id", "trace_id is required", blank("trace_id"))]
FEATURE_SNAPSHOT = SNAPSHOT
FUTURES = lambda: [
    in_set("source", (fixed.FUTURES_SOURCE,)),
    in_set("environment", fixed.FUTURES_ENVIRONMENTS),
    in_set("validation_status", fixed.STATUSES),
    Rule("settle_price", "settle_price must be in (0, cap]",
         F.col("settle_price").isNull() | (F.col("settle_price") <= 0)
         | (F.col("settle_price") > fixed.SETTLE_CAP)),
]
POLICY = lambda: [
    in_set("policy_type", fixed.POLICY_TYPES), in_set("source", fixed.POLICY_SOURCES),
    in_set("impact_direction", fixed.DIRECTIONS), in_unit("confidence"),
    in_set("validation_status", fixed.STATUSES),
]
QUALITY = lambda: [
    in_unit("overall_quality_score"), in_unit("confidence_penalty_factor", nullable=True),
]
MODEL_REGISTRY = lambda: [
    Rule("training_window", "start after end",
         F.col("training_window_start") > F.col("training_window_end")),
    Rule("feature_set_hash", "must be 64 hex characters",
         ~F.coalesce(F.lower("feature_set_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))),
    in_set("horizon_days", fixed.HORIZONS),
    *[Rule("metrics", f"{m} missing or negative",
           F.coalesce(F.try_element_at(F.col("metrics"), F.lit(m)) < 0, F.lit(True)))
      for m in ("mae", "rmse", "mape")],
]
USER_CONTEXT = lambda: [
    in_set("persona_type", fixed.PERSONAS), in_set("liquidity_need", fixed.LIQUIDITY_NEEDS),
]
RECOMMENDATION = lambda: [
    in_set("action_type", fixed.ACTIONS), in_unit("recommendation_confidence"),
]


def forecast_rules(names: Iterable[str] = ("horizon_30", "horizon_60", "horizon_90")) -> list[Rule]:
    """Each present horizon struct needs a known direction and a unit confidence."""
    rules = []
    for name in names:
        h = F.col(name)
        direction, trust = h.getField("direction"), h.getField("forecast_confidence")
        ok = direction.isin(*fixed.DIRECTIONS) & trust.between(0, 1) & h.getField("point").isNotNull()
        rules.append(
            Rule(name, f"{name} incomplete", h.isNotNull() & ~F.coalesce(ok, F.lit(False)))
        )
    return rules


def registry_rules(commodity: str = fixed.COMMODITY) -> list[Rule]:
    """Agent sets, weights, horizons and decision rules of a registry version."""
    need, may = F.col("required_agents"), F.coalesce("optional_agents", F.array().cast("array<string>"))
    known = F.array(*[F.lit(a) for a in fixed.AGENTS])
    weights, rules = F.col("signal_weights"), F.col("decision_rules")
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, b: a + b)
    stray = F.size(F.array_except(F.map_keys(weights), F.array_union(need, may))) > 0
    keys = F.array(F.lit("msp_proximity_pct"), F.lit("default_partial_sell_pct"),
                   F.lit("formula_version"))
    horizons = F.array(*[F.lit(h) for h in fixed.HORIZONS])
    core = F.array(F.lit("Market"), F.lit("Futures"))
    empty = lambda c: c.isNull() | (F.size(c) == 0)
    return [
        Rule("required_agents", "empty", empty(need)),
        Rule("required_agents", "unknown agent", F.size(F.array_except(need, known)) > 0),
        Rule("optional_agents", "unknown agent", F.size(F.array_except(may, known)) > 0),
        Rule("agents_disjoint", "required and optional overlap", F.arrays_overlap(need, may)),
        Rule("signal_weights", "unknown agents", weights.isNotNull() & stray),
        Rule("signal_weights", "must sum to 1",
             weights.isNotNull() & (F.abs(total - 1.0) > fixed.WEIGHT_SUM_TOLERANCE)),
        Rule("forecast_horizons", "missing 30, 60 or 90",
             F.col("forecast_horizons").isNotNull()
             & (F.size(F.array_except(horizons, F.col("forecast_horizons"))) > 0)),
        Rule("decision_rules", "missing keys",
             empty(rules) | (F.size(F.array_except(keys, F.map_keys(rules))) > 0)),
        Rule("commodity_agents", "Market and Futures are required",
             (F.col("commodity_id") == commodity) & (F.size(F.array_except(core, need)) > 0)),
    ]
