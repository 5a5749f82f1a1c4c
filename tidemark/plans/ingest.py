"""Landed market and weather files to stored facts and quality snapshots, with counters.

Facts and snapshots of a batch are committed as one (``sources.commits``): a run that breaks off
anywhere leaves the old state, and its repetition gives the result of one run.
"""

from __future__ import annotations

import datetime as dt
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed, schemas
from tidemark.functions import dates
from tidemark.operators import dedupe, mapping
from tidemark.operators.basket import DAY, SERIES
from tidemark.plans import quality
from tidemark.session import cut_lineage, scratch_folder, written_once
from tidemark.sources import commits, tables
from tidemark.sources.files import ORDER

PRICE_COLUMNS = [c.strip().split(" ")[0] for c in schemas.PRICE_OBSERVATION.split(", ")]
ARRIVAL_COLUMNS = [c.strip().split(" ")[0] for c in schemas.ARRIVAL_OBSERVATION.split(", ")]
SNAPSHOT_KEY = ["commodity_id", "as_of_date", "registry_id"]
PRICES, ARRIVALS, WEATHER, SNAPSHOTS = (
    "price_observation", "arrival_observation", "weather_observation", "data_quality_snapshot"
)
WEATHER_COLUMNS = [c.strip().split(" ")[0] for c in schemas.WEATHER_OBSERVATION.split(", ")]


@dataclass
class Quality:
    """What quality snapshots need besides the facts: who should report, under which registry."""

    markets: DataFrame
    registries: DataFrame
    regions: DataFrame | None = None
    window_days: int = fixed.QUALITY_WINDOW_DAYS


@dataclass
class Batch:
    """Plans of one ingest batch; nothing has run yet."""

    parsed: DataFrame
    prices: DataFrame
    arrivals: DataFrame
    new_prices: DataFrame
    new_arrivals: DataFrame


def _stored(columns: list[str], rows: DataFrame, keys: list[str]) -> DataFrame:
    shaped = rows.withColumn("observation_id", mapping.observation_id(keys)).withColumn(
        "supersedes_id", F.lit(None).cast("string")
    )
    return shaped.select(*columns)


def market_batch(
    parsed: DataFrame, markets: DataFrame, stored_prices: DataFrame | None = None,
    stored_arrivals: DataFrame | None = None, filter_bits: int = 0,
) -> Batch:
    """Map, unpivot and deduplicate parsed records against what is stored.

    ``filter_bits`` thins stored rows by a filter of the batch's keys (``dedupe.key_filter``).
    """
    mapped = mapping.map_records(parsed, markets)
    prices = mapping.price_rows(mapped, ORDER)
    arrivals = mapping.arrival_rows(mapped, ORDER)
    new_prices = mapping.first_price_rows(mapped, ORDER)
    if stored_prices is not None:
        new_prices = dedupe.without_stored(new_prices, stored_prices, dedupe.PRICE_KEY, filter_bits)
    new_arrivals = dedupe.new_rows(arrivals, stored_arrivals, dedupe.ARRIVAL_KEY, ORDER, filter_bits)
    return Batch(
        parsed,
        prices,
        arrivals,
        _stored(PRICE_COLUMNS, new_prices, dedupe.PRICE_KEY),
        _stored(ARRIVAL_COLUMNS, new_arrivals, dedupe.ARRIVAL_KEY),
    )


def counters(batch: Batch) -> DataFrame:
    """The eight counters of a batch in one row."""
    inserted = {"prices_inserted": batch.new_prices, "arrivals_inserted": batch.new_arrivals}
    n = F.col
    return _counted(_drafts(batch) | inserted).select(
        *DRAFTS, *inserted,
        (n("price_drafts") - n("prices_inserted")).alias("prices_skipped"),
        (n("arrival_drafts") - n("arrivals_inserted")).alias("arrivals_skipped"),
    )


DRAFTS = ("rows_fetched", "rows_parsed", "price_drafts", "arrival_drafts")


def _drafts(batch: Batch) -> dict[str, DataFrame]:
    fetched = batch.parsed.filter(
        F.col("reject_reason").isNull() | (F.col("reject_reason") != "no records")
    )
    parsed = batch.parsed.filter(F.col("reject_reason").isNull())
    return dict(zip(DRAFTS, (fetched, parsed, batch.prices, batch.arrivals), strict=True))


def _counted(parts: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several frames, and the latest day among the drafts, from one job."""
    tagged = [
        df.select(F.lit(name).alias("_what"), F.col("as_of_date").alias("_day"))
        for name, df in parts.items()
    ]
    union = tagged[0]
    for part in tagged[1:]:
        union = union.unionByName(part)
    drafts = F.col("_what").isin("price_drafts", "arrival_drafts")
    return union.agg(
        *(F.count_if(F.col("_what") == name).alias(name) for name in parts),
        F.max(F.when(drafts, F.col("_day"))).alias("last_day"),
    )


def stored_in_range(stored: DataFrame, batch_days: DataFrame) -> DataFrame:
    """Stored rows of the months that a batch touches; the month list is one tiny aggregate."""
    bounds = batch_days.agg(F.min("as_of_date"), F.max("as_of_date")).first()
    if bounds[0] is None:
        return stored.limit(0).drop(tables.MONTH)
    return tables.date_range(stored, bounds[0], bounds[1]).drop(tables.MONTH)


def ingest_market(
    spark: SparkSession, parsed: DataFrame, markets: DataFrame, folder: str, dry_run: bool = False,
    keep_quality: Quality | None = None, writer: str | None = None, number: int = 0,
    finished: tuple[str, dt.date, dt.date] | None = None, filter_bits: int = 0,
) -> dict:
    """Append new facts under ``folder`` and return the counters with the snapshot anchor day.

    The anchor is the latest day of the inserted rows, else of the batch, else None. The parsed
    records are written once, and the new rows are written before anything is counted: counters,
    anchor and snapshots read what was written. With ``keep_quality`` the quality snapshots whose
    window holds an inserted day are computed anew. All of it is committed as one. A batch
    ``number`` of a ``writer`` that is committed already returns the counters it had; ``finished``
    names the days of a ledger that the commit finishes. ``filter_bits`` is worth setting where the
    stored months are much larger than the batch.
    """
    log = commits.Batch(spark, folder)
    if writer is not None and (known := log.result_of(writer, number)) is not None:
        return known | {"anchor": known["anchor"] and dt.date.fromisoformat(known["anchor"])}
    landed = scratch_folder(spark)
    parsed = written_once(parsed, landed)
    days = parsed.select("as_of_date")
    batch = market_batch(
        parsed, markets,
        stored_in_range(log.stored(PRICES, schemas.PRICE_OBSERVATION), days),
        stored_in_range(log.stored(ARRIVALS, schemas.ARRIVAL_OBSERVATION), days),
        filter_bits,
    )
    new_prices, new_arrivals = batch.new_prices, batch.new_arrivals
    if not dry_run:
        log.append(PRICES, new_prices)
        log.append(ARRIVALS, new_arrivals)
        new_prices = log.own(PRICES, schemas.PRICE_OBSERVATION)
        new_arrivals = log.own(ARRIVALS, schemas.ARRIVAL_OBSERVATION)
    new = new_prices.select("commodity_id", "as_of_date").withColumn("_price", F.lit(True)).unionByName(
        new_arrivals.select("commodity_id", "as_of_date").withColumn("_price", F.lit(False))
    )
    counts = _counted(_drafts(batch)).first().asDict()
    prices, arrivals, first, last = new.agg(
        F.count_if("_price"), F.count_if(~F.col("_price")), F.min("as_of_date"), F.max("as_of_date")
    ).first()
    anchor = last or counts.pop("last_day")
    counts.pop("last_day", None)
    result = counts | {
        "prices_inserted": prices, "arrivals_inserted": arrivals,
        "prices_skipped": counts["price_drafts"] - prices,
        "arrivals_skipped": counts["arrival_drafts"] - arrivals, "anchor": anchor,
    }
    if not dry_run:
        notes = {}
        if keep_quality is not None and first is not None:
            notes = _refresh(log, keep_quality, new, first, last)
        log.commit(writer, number, result, finished, notes)
    tables.remove(spark, landed)
    return result


def _refresh(
    log: commits.Batch, keep: Quality, changed: DataFrame, first: dt.date, last: dt.date,
    weather: bool = False,
) -> dict[str, str]:
    """Write the snapshots that new rows of (commodity, day) change; notes for the commit.

    Snapshots run from the first to the last day that any batch inserted. Days in whose window an
    inserted day lies are computed anew; days by which that range grows get their first snapshot.
    """
    since = min(first, dt.date.fromisoformat(log.base.notes.get("since", str(first))))
    through = max(last, dt.date.fromisoformat(log.base.notes.get("through", str(last))))
    series = keep.registries.select(F.col("commodity_id").alias(SERIES)).distinct()
    anchors = quality.touched_anchors(
        changed.withColumnRenamed("commodity_id", SERIES), F.lit(through), keep.window_days
    )
    one = dt.timedelta(days=1)
    grown = [(since, through)]
    if "since" in log.base.notes:
        old = [dt.date.fromisoformat(log.base.notes[k]) for k in ("since", "through")]
        grown = [(since, old[0] - one), (old[1] + one, through)]
    for a, b in grown:
        if a <= b:
            anchors = anchors.unionByName(quality.calendar_anchors(series, F.lit(a), F.lit(b)))
    anchors = cut_lineage(anchors.join(series, SERIES, "left_semi").distinct())
    log.append(SNAPSHOTS, _snapshots(log, keep, anchors, weather))
    return {"since": str(since), "through": str(through)}


def _snapshots(
    log: commits.Batch, keep: Quality, anchors: DataFrame, weather: bool = False,
    window_days: int | None = None,
) -> DataFrame:
    """Snapshots of the anchors from stored and new rows; only the months of their windows are read."""
    frame = window_days or keep.window_days
    low, high = anchors.agg(F.min(DAY), F.max(DAY)).first()

    def of(table: str, schema: str) -> DataFrame:
        rows = log.both(table, schema)
        if low is not None:
            rows = tables.date_range(rows, low - dt.timedelta(days=frame - 1), high)
        return rows.withColumnRenamed("commodity_id", SERIES)

    known = keep.markets.select("market_id").distinct()
    prices = of(PRICES, schemas.PRICE_OBSERVATION).join(known, "market_id", "left_semi")
    arrivals = of(ARRIVALS, schemas.ARRIVAL_OBSERVATION).join(known, "market_id", "left_semi")
    market = quality.source_metrics(
        quality.daily_source(prices, "market_id", [arrivals]), known, frame, anchors=anchors
    )
    other = None
    if weather:
        rows = of(WEATHER, schemas.WEATHER_OBSERVATION).withColumn(SERIES, F.lit("weather"))
        other = quality.source_metrics(
            quality.daily_source(rows, "region_id"), keep.regions.select("region_id").distinct(), frame,
            anchors=anchors.select(F.lit("weather").alias(SERIES), DAY).distinct(),
        )
    rows = quality.snapshot_rows(market, keep.registries, other, frame)
    return rows.withColumn("written", F.lit(log.version).cast("long"))


def quality_table(spark: SparkSession, folder: str) -> DataFrame:
    """The current snapshot of every (commodity, day, registry)."""
    rows = commits.read(spark, folder, SNAPSHOTS, schemas.QUALITY_SNAPSHOT)
    return commits.current(rows, SNAPSHOT_KEY)


def all_snapshots(spark: SparkSession, folder: str, keep: Quality) -> DataFrame:
    """Every snapshot computed anew from the stored facts: what the upkept table must hold."""
    log = commits.Batch(spark, folder)
    notes = log.base.notes
    series = keep.registries.select(F.col("commodity_id").alias(SERIES)).distinct()
    bounds = [F.lit(dt.date.fromisoformat(notes[k])) for k in ("since", "through")]
    return _snapshots(log, keep, quality.calendar_anchors(series, *bounds))


def backfill_market(
    spark: SparkSession, parsed: DataFrame, markets: DataFrame, folder: str, start, end,
    dry_run: bool = False, keep_quality: Quality | None = None, step_days: int = 31,
    ledger: str = "market_backfill",
) -> dict:
    """Ingest the landed records of a window, ``step_days`` at a time, and resume where it broke off.

    Each step is one batch; its commit enters its days in the ledger, and only days that are not in
    it are planned, so a repeated run goes on behind the last whole step. The landed records of the
    window are written by month once, and each step reads its own months. At the end the snapshot
    of the last day is taken over the whole window. Returns the sum of the counters of this run.
    """
    window = parsed.filter(F.col("as_of_date").between(F.lit(start), F.lit(end)))
    if dry_run:
        return ingest_market(spark, window, markets, folder, True)
    steps = commits.unfinished(commits.state(spark, folder).days.get(ledger, []), start, end, step_days)
    total: Counter = Counter({"steps": len(steps)})
    anchor = None
    if steps:
        landed = f"{scratch_folder(spark)}/landed"
        tables.append_facts(window, landed)
        stored = tables.read_facts(spark, landed, _ddl(window))
        for first, last in steps:
            rows = tables.date_range(stored, first, last).drop(tables.MONTH)
            done = ingest_market(
                spark, rows, markets, folder, keep_quality=keep_quality, finished=(ledger, first, last)
            )
            anchor = max(filter(None, (anchor, done.pop("anchor"))), default=None)
            total.update(done)
        tables.remove(spark, landed)
    if keep_quality is not None:
        log = commits.Batch(spark, folder)
        series = keep_quality.registries.select(F.col("commodity_id").alias(SERIES)).distinct()
        at_end = quality.calendar_anchors(series, F.lit(end), F.lit(end))
        log.append(SNAPSHOTS, _snapshots(log, keep_quality, at_end, window_days=(end - start).days + 1))
        log.commit()
    return {**total, "anchor": anchor}


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)


def ingest_weather(
    spark: SparkSession, points: DataFrame, folder: str, dry_run: bool = False,
    keep_quality: Quality | None = None,
) -> dict:
    """Weather points to stored facts; unknown districts and values out of range are counted.

    With ``keep_quality`` the snapshots of the days that new points touch are computed anew, now
    with the mean of the market and weather scores, and committed with the points.
    """
    log = commits.Batch(spark, folder)
    mapped = cut_lineage(mapping.weather_rows(points, mapping.district_regions(spark)))
    good = mapped.filter(F.col("reject_reason").isNull())
    stored = log.stored(WEATHER, schemas.WEATHER_OBSERVATION)
    stored = stored_in_range(stored, good.select("as_of_date"))
    fresh = dedupe.new_rows(good, stored, dedupe.WEATHER_KEY, ["district_name"])
    new = fresh.withColumn(
        "observation_id", mapping.observation_id(dedupe.WEATHER_KEY)
    ).select(*WEATHER_COLUMNS)
    if not dry_run:
        log.append(WEATHER, new)
        new = log.own(WEATHER, schemas.WEATHER_OBSERVATION)
    drafts, rejected = mapped.agg(
        F.count_if(F.col("reject_reason").isNull()), F.count_if(F.col("reject_reason").isNotNull())
    ).first()
    inserted, first, last = new.agg(F.count(F.lit(1)), F.min("as_of_date"), F.max("as_of_date")).first()
    if not dry_run:
        notes = {}
        if keep_quality is not None and first is not None:
            notes = _refresh(log, keep_quality, new, first, last, weather=True)
        log.commit(notes=notes)
    return {"drafts": drafts, "rejected": rejected, "inserted": inserted,
            "skipped": drafts - inserted}


def backfill_days(start, end, spark: SparkSession) -> DataFrame:
    """Calendar days of a window."""
    bounds = spark.range(1).select(F.lit(start).alias("_a"), F.lit(end).alias("_b"))
    return dates.date_spine(bounds, "_a", "_b")
