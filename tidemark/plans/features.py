"""Namespaced forecast features, lineage, feature store rows and training matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import canonical as J
from tidemark.functions.scores import number_or_null
from tidemark.operators.dedupe import latest_per_key
from tidemark.session import cut_lineage

KEY = ["commodity_id", "as_of_date", "registry_id"]
ASSEMBLY_VERSION = "1"
SPOT = "spot_price_level"

# Neutral stand-in when no futures row exists.
STUB_COMPONENTS = {
    "curve_slope": "0.0",
    "curve_level_near": None,
    "open_interest_change": "0.0",
    "basis_futures_spot": "0.0",
    "carry_implied_30": "0.0",
    "carry_implied_60": "0.0",
    "carry_implied_90": "0.0",
    "stub": "true",
}


def namespaced(agent: Column, row: Column) -> Column:
    """One agent's direction, scores and components under its prefix."""
    prefix = F.lower(agent)
    named = lambda part: F.concat(prefix, F.lit("."), F.lit(part))
    parts = ("direction", "magnitude", "confidence", "value")
    own = F.map_from_arrays(
        F.array(*[named(p) for p in parts]),
        F.array(*[row.getField(p).cast("string") for p in parts]),
    )
    inner = F.transform_keys(
        F.coalesce(row.getField("signal_components"), F.create_map().cast("map<string,string>")),
        lambda k, _: F.concat(prefix, F.lit(".components."), k),
    )
    return F.map_concat(own, inner)


def futures_input(explicit: Column, generated: Column | None = None, stub: bool = True) -> Column:
    """Explicit futures row, else the generated one, else the neutral stub, else NULL."""
    empty = F.struct(
        F.lit(fixed.NEUTRAL).alias("direction"),
        F.lit("0").alias("magnitude"),
        F.lit("0").alias("confidence"),
        F.lit("0").alias("value"),
        F.create_map(
            *[F.lit(x).cast("string") for pair in STUB_COMPONENTS.items() for x in pair]
        ).alias("signal_components"),
        F.lit(True).alias("is_stub"),
    )
    choices = [explicit] + ([generated] if generated is not None else [])
    return F.coalesce(*choices, empty) if stub else F.coalesce(*choices)


def agent_rows(signals: DataFrame) -> DataFrame:
    """One row per day with the market, weather and futures signals as structs."""
    body = F.struct(
        "direction",
        F.col("magnitude").cast("string").alias("magnitude"),
        F.col("confidence").cast("string").alias("confidence"),
        F.col("value").cast("string").alias("value"),
        "signal_components",
        F.lit(False).alias("is_stub"),
    )
    of = lambda agent: F.max_by(
        F.when(F.col("agent_type") == agent, body),
        F.when(F.col("agent_type") == agent, F.struct("as_of_timestamp", "signal_id")),
    )
    return signals.groupBy(*KEY).agg(
        of("Market").alias("market"), of("Weather").alias("weather"), of("Futures").alias("futures")
    )


def assemble(rows: DataFrame, use_stub: bool = True) -> DataFrame:
    """Feature map and lineage per day from market, weather and futures structs."""
    staged = rows.withColumn("futures", futures_input(F.col("futures"), stub=use_stub))
    nothing = F.create_map().cast("map<string,string>")
    maps = []
    for name in fixed.LINEAGE_PREFIXES:
        row = F.col(name)
        maps.append(F.when(row.isNotNull(), namespaced(F.lit(name), row)).otherwise(nothing))
    stub = F.when(
        F.col("futures.is_stub"), F.create_map(F.lit("futures.stub"), F.lit("true"))
    ).otherwise(nothing)
    lineage = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(name).isNotNull(),
                    F.struct(
                        F.lit(name).alias("agent"), F.col(f"{name}.is_stub").alias("is_stub")
                    ),
                )
                for name in fixed.LINEAGE_PREFIXES
            ]
        )
    )
    out = staged.select(
        *KEY,
        F.map_concat(*maps, stub).alias("feature_values"),
        F.struct(F.lit(ASSEMBLY_VERSION).alias("assembly_version"), lineage.alias("agents")).alias(
            "feature_lineage"
        ),
    )
    return out.withColumn("feature_hash", J.digest(feature_json()))


def feature_json() -> Column:
    return J.json_object(
        {
            "as_of_date": J.quoted(F.col("as_of_date").cast("string")),
            "assembly_version": J.quoted(F.lit(ASSEMBLY_VERSION)),
            "commodity_id": J.quoted(F.col("commodity_id")),
            "feature_values": J.json_map(F.col("feature_values")),
            "registry_id": J.quoted(F.col("registry_id")),
        }
    )


def feature_vectors(features: DataFrame) -> DataFrame:
    """Long form: one (day, name, value) row per feature."""
    return features.select(*KEY, F.explode("feature_values").alias("name", "value"))


def feature_names(rows: DataFrame, features: str = "features") -> DataFrame:
    """Distinct names that have a numeric value somewhere."""
    pairs = rows.select(F.explode(features).alias("name", "value"))
    return pairs.filter(number_or_null(F.col("value")).isNotNull()).select("name").distinct()


def names_hash(names: list[str]) -> str:
    """Digest of the ordered feature names."""
    import hashlib

    return hashlib.sha256(",".join(names).encode()).hexdigest()


def training_vectors(
    rows: DataFrame, keys: list[str], features: str = "features"
) -> tuple[DataFrame, DataFrame]:
    """Sparse numeric rows and their names, for any number of names.

    The first frame has ``keys``, the spot price, and ``indices`` and ``values`` of the features
    that have a number, in order; the second has ``name`` and ``index``, 0 for the spot price and
    the other names sorted behind it. ``keys`` identify a row. No name reaches the driver.
    """
    named = feature_names(rows, features).filter(F.col("name") != SPOT)
    parts = cut_lineage(
        named.repartitionByRange("name").sortWithinPartitions("name").select(
            "name", F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
        )
    )
    # One row per partition of the sorted names.
    starts = parts.groupBy("_part").count().select(
        "_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count") + 1).alias("_start")
    )
    index = parts.join(starts, "_part").select("name", (F.col("_start") + F.col("_at")).alias("index"))
    cells = rows.select(*keys, F.explode(features).alias("name", "value")).select(
        *keys, "name", number_or_null(F.col("value")).alias("value")
    )
    found = cells.filter(F.col("value").isNotNull()).join(index, "name").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("index", "value"))).alias("_cells")
    )
    kept = rows.select(*keys, F.col(SPOT).cast("double").alias(SPOT)).join(found, keys, "left")
    nothing = F.expr("cast(array() as array<struct<index:bigint,value:double>>)")
    filled = kept.withColumn("_cells", F.coalesce("_cells", nothing))
    spot = rows.sparkSession.range(1).select(F.lit(SPOT).alias("name"), F.lit(0).cast("long").alias("index"))
    return filled.select(
        *keys, SPOT, F.col("_cells.index").alias("indices"), F.col("_cells.value").alias("values")
    ), spot.unionByName(index)


def training_matrix(rows: DataFrame, features: str = "features") -> tuple[DataFrame, list[str]]:
    """Wide numeric matrix: spot first, then sorted feature names, missing as 0.

    Columns must be known to plan, so the distinct names come to the driver; they grow with the
    vocabulary, not with the rows. :func:`training_vectors` serves vocabularies of any size.
    """
    names = [r["name"] for r in feature_names(rows, features).collect()]
    ordered = sorted(n for n in names if n != SPOT)
    keep = [c for c in rows.columns if c not in (features, SPOT)]
    cells = [
        F.coalesce(number_or_null(F.try_element_at(F.col(features), F.lit(n))), F.lit(0.0)).alias(n)
        for n in ordered
    ]
    matrix = rows.select(*keep, F.col(SPOT).cast("double").alias(SPOT), *cells)
    return matrix, [SPOT, *ordered]


def importance_panel(rows: DataFrame, feature_sets: DataFrame) -> DataFrame:
    """Supervised rows with the newest feature set of their day and registry.

    ``rows`` carry (commodity_id, as_of_date, registry_id); days without a feature set are left out.
    """
    newest = latest_per_key(feature_sets, KEY, ["created_at", "feature_hash"])
    return rows.join(newest.select(*KEY, "feature_values", "feature_lineage"), KEY)
