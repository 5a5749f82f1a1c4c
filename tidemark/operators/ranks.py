"""Exact medians and positions that never gather a hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Value blocks in each power of two.
STEPS = 1024
#: Distinct values that a cell takes along.
CARRIED = 16
#: Block of the rows without a value.
NO_VALUE = -(10**8)


def exact_median(
    df: DataFrame, keys: list[str], value: str, out: str,
    latest: dict[str, str] | None = None, count: str | None = None,
) -> DataFrame:
    """Interpolating median of ``value`` per group.

    ``latest`` maps new columns to columns to maximise, ``count`` names a column for the values.

    Equal values of a group are counted in the map tasks first. A cell holds the distinct values of
    a (group, value block); a block is a narrow range of values, so cells stay small and those of
    one group lie in many tasks. The row counts of its cells tell which of them hold the middle
    ranks of a group. Small cells take their values along and answer by themselves; only the values
    of large ones stay behind and are asked for by (group, block). Spark makes the cells once and
    reuses their exchange, so the source is read once. There is one way for all groups.

    Rows with a NULL key belong to no group; NULL values count for ``latest`` only.
    """
    latest = latest or {}
    cells = _cells(df, keys, value, latest)
    small = F.size("_points") <= CARRIED
    narrow = cells.select(
        *keys, "_block", _rows("_points").alias("_rows"), F.when(small, F.col("_points")).alias("_points"),
        *[F.array_max(F.col("_points")[n]).alias(n) for n in latest],
    )
    whole, in_order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_block")
    placed = narrow.select(
        "*", (F.sum("_rows").over(in_order) - F.col("_rows")).alias("_before"), F.sum("_rows").over(whole).alias("_total")
    )
    spots = placed.select(
        *placed.columns,
        (F.floor((F.col("_total") + 1) / 2) - F.col("_before")).alias("_lower"),
        (F.floor(F.col("_total") / 2) + 1 - F.col("_before")).alias("_upper"),
    )
    here = lambda spot: (F.col(spot) >= 1) & (F.col(spot) <= F.col("_rows"))
    spots = spots if latest or count else spots.filter(here("_lower") | here("_upper") | (F.col("_total") == 0))
    large = cells.filter(~small).select(*keys, "_block", F.col("_points").alias("_left_behind"))
    # Cells that cannot be asked keep their rows apart from any block, so the join drops nothing.
    asked = F.when(F.col("_points").isNull() & (here("_lower") | here("_upper")), F.col("_block"))
    met = spots.withColumn("_block", asked).join(large, [*keys, "_block"], "left")
    points = F.coalesce("_points", "_left_behind")
    counted = [F.max("_total").alias(count)] if count else []
    found = met.select(
        *keys, *latest, "_total",
        F.when(here("_lower"), _value_at(points, "_lower")).alias("_low"),
        F.when(here("_upper"), _value_at(points, "_upper")).alias("_high"),
    )
    return found.groupBy(*keys).agg(
        *[F.max(n).alias(n) for n in latest], *counted, ((F.max("_low") + F.max("_high")) / 2).alias(out)
    )


def _cells(df: DataFrame, keys: list[str], value: str, latest: dict[str, str]) -> DataFrame:
    """``_points``: the distinct values of each (group, block) in order, with their rows."""
    x = F.col(value).cast("double")
    rows = df.filter(_all_known(keys)).select(*keys, x.alias("_x"), *[F.col(c).alias(n) for n, c in latest.items()])
    points = rows.groupBy(*keys, "_x").agg(F.count("_x").alias("_n"), *[F.max(n).alias(n) for n in latest])
    block = F.coalesce(value_block(F.col("_x")), F.lit(NO_VALUE).cast("long"))
    return points.groupBy(*keys, block.alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("_x", "_n", *latest))).alias("_points")
    )


def _rows(points: str) -> Column:
    one = F.get(points, F.lit(0))["_n"]
    return F.when(F.size(points) == 1, one).otherwise(
        F.aggregate(points, F.lit(0).cast("long"), lambda total, p: total + p["_n"])
    )


def _value_at(points: Column, spot: str) -> Column:
    """Value of the ``spot``-th row (from 1) of a cell: the last one that begins before it."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("x"))
    step = lambda at, p: F.struct(
        (at["upto"] + p["_n"]).alias("upto"), F.when(at["upto"] < F.col(spot), p["_x"]).otherwise(at["x"]).alias("x")
    )
    one = F.get(points, F.lit(0))["_x"]
    return F.when(F.size(points) == 1, one).otherwise(F.aggregate(points, start, step)["x"])


def _all_known(keys: list[str]) -> Column:
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known


def value_block(x: Column) -> Column:
    """Order-preserving block of a double: ``STEPS`` in each power of two, at any magnitude.

    Linear between powers of two, so rounding of the logarithm cannot break the order. Zero, the
    infinities and NaN (the greatest) have blocks of their own; NULL has none.
    """
    size = F.abs(x)
    power = F.floor(F.log2(size))
    steps = power * STEPS + F.floor((size / F.pow(F.lit(2.0), power) - 1) * STEPS) + 1100 * STEPS
    side = F.when(x < 0, -1).otherwise(1)
    return (
        F.when(F.isnan(x), F.lit(10**7 + 1))
        .when(size == F.lit(float("inf")), side * 10**7)
        .when(x == 0, F.lit(0))
        .when(x.isNotNull(), side * steps)
        .cast("long")
    )


def value_positions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per group with their row count, rows before them and group total.

    Counts are combined before the first shuffle; the running sum is taken inside one value block
    at a time and shifted by the block totals, so a hot group is spread over its blocks.
    """
    cells = (
        df.groupBy(*keys, value_block(F.col(value)).alias("_block"), F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    whole = Window.partitionBy(*keys)
    blocks = (
        cells.groupBy(*keys, "_block")
        .agg(F.sum("_rows").alias("_block_rows"))
        .select(
            *keys,
            "_block",
            (F.sum("_block_rows").over(over_blocks) - F.col("_block_rows")).alias("_offset"),
            F.sum("_block_rows").over(whole).alias("_total"),
            "_block_rows",
        )
    )
    return _within_blocks(cells, blocks, keys)


def _within_blocks(cells: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    inside = Window.partitionBy(*keys, "_block").orderBy("_value")
    return cells.join(blocks.drop("_block_rows"), [*keys, "_block"]).select(
        *keys,
        "_value",
        "_rows",
        (F.col("_offset") + F.sum("_rows").over(inside) - F.col("_rows")).alias("_before"),
        "_total",
    )


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Rank of each distinct value, ties averaged: (keys, value, rank)."""
    return value_positions(df, keys, value).select(
        *keys,
        F.col("_value").alias(value),
        (F.col("_before") + (F.col("_rows") + 1) / 2).alias(out),
    )


def windowed_average_rank(value: str, keys: list[str]) -> Column:
    """Average rank as a window, for groups bounded by calendar days."""
    by_value = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(by_value) + (F.count(F.lit(1)).over(ties) - 1) / 2
