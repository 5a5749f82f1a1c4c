"""Business-key deduplication, keyed upsert and latest-row selection."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written_once

PRICE_KEY = ["market_id", "as_of_date", "source", "price_type", "quality_grade"]
ARRIVAL_KEY = ["market_id", "as_of_date", "source", "commodity_id"]
WEATHER_KEY = ["region_id", "as_of_date", "source"]
POLICY_KEY = ["commodity_id", "policy_type", "source", "published_date", "summary"]


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key by ``order``; NULL key parts equal each other.

    A grouped extreme combines in the map tasks, so a key with any number of copies reaches its
    reducer as one row per task. The payload rides as one struct, so it may hold maps.
    """
    return _extreme(df, keys, order, F.min_by)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of each key by ``order``, combined before the shuffle like the above."""
    return _extreme(df, keys, order, F.max_by)


def _extreme(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col("_best").getField(c).alias(c) for c in rest]).select(
        *df.columns
    )


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def without_stored(
    batch: DataFrame, stored: DataFrame, keys: list[str], filter_bits: int = 0
) -> DataFrame:
    """Rows whose key is not stored yet. Stored keys are made distinct before the join.

    With ``filter_bits`` the stored side is thinned by a ``key_filter`` of the batch first, for which
    the batch is written to the shared folder: worth it where the stored side is much the larger one.
    """
    if filter_bits:
        # The filter and the join read the batch: it is made once.
        batch = written_once(batch)
        stored = stored.filter(key_filter(batch, keys, filter_bits))
    known = stored.select(*keys).distinct()
    return batch.join(known, null_safe(batch, known, keys), "left_anti")


#: Bits in one number of a key filter, and numbers of the filter by default: 2 MB.
WORD_BITS = 64
FILTER_BITS = 1 << 24


def key_filter(batch: DataFrame, keys: list[str], bits: int = FILTER_BITS) -> Column:
    """Condition on another table that holds for every key of ``batch`` and for few others.

    A Bloom filter with two hashes in plain columns: bits are set by ``bit_or`` in the map tasks, and
    at most ``bits`` / 64 numbers reach the driver, however many keys there are; a filter that is
    too full only lets more rows through. The test stays in generated code, in the scan's stage.
    """
    words = bits // WORD_BITS
    places = F.explode(F.array(*[_place(keys, seed, bits) for seed in (0, 1)])).alias("_at")
    rows = batch.select(places).groupBy(F.expr(f"_at div {WORD_BITS}").alias("_word")).agg(
        F.expr(f"bit_or(shiftleft(1L, CAST(pmod(_at, {WORD_BITS}) AS INT)))").alias("_bits")
    )
    held = rows.toArrow()
    table = np.zeros(words, dtype=np.int64)
    table[held.column("_word").to_numpy()] = held.column("_bits").to_numpy()
    filled = F.from_json(F.lit(json.dumps(table.tolist())), "array<bigint>")
    tests = []
    for seed in (0, 1):
        at = _place(keys, seed, bits)
        word = F.get(filled, F.floor(at / WORD_BITS).cast("int"))
        tests.append(F.getbit(word, F.pmod(at, F.lit(WORD_BITS)).cast("int")) == 1)
    return tests[0] & tests[1]


def _place(keys: list[str], seed: int, bits: int) -> Column:
    """Bit of a key; NULL parts are told from each other's places by the hash of their text."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(bits).cast("long"))


def new_rows(
    batch: DataFrame, stored: DataFrame | None, keys: list[str], order: list[str],
    filter_bits: int = 0,
) -> DataFrame:
    """First of each key in the batch, minus the keys already stored."""
    first = first_per_key(batch, keys, order)
    return first if stored is None else without_stored(first, stored, keys, filter_bits)


def upsert(
    existing: DataFrame, updates: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Existing rows whose key is not updated, plus the last update of each key by ``order``."""
    last = latest_per_key(updates, keys, order)
    return without_stored(existing, last, keys).unionByName(last)
