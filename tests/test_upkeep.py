"""Commit log, quality snapshots kept up to date by ingests, silent days, backfills that resume."""

import datetime as dt
import json
from decimal import Decimal

import pytest

from tidemark import fixed, schemas
from tidemark.plans import ingest, quality
from tidemark.sources import commits

RECORD = ("source_file string, position int, state string, district string, market string, commodity string, variety string, "
          "grade string, as_of_date date, min_price decimal(18,4), max_price decimal(18,4), modal_price decimal(18,4), "
          "arrival_tonnes decimal(18,4), reject_reason string")
START = dt.date(2025, 11, 20)


def day(n):
    return START + dt.timedelta(days=n)


def records(spark, days, markets=("A", "B"), mark=""):
    rows = [(f"f{mark}{n}", 0, "S", "D", m, "Cotton", None, None, day(n), None, None, Decimal(6000 + n), Decimal(1) if m == "A" else None, None)
            for n in days for m in markets]
    return spark.createDataFrame(rows, RECORD)


@pytest.fixture
def keep(spark):
    return ingest.Quality(
        spark.createDataFrame([("m_a",), ("m_b",), ("m_c",)], "market_id string"),
        spark.createDataFrame([(fixed.COMMODITY, "r1"), ("wheat", "r9")], "commodity_id string, registry_id string"),
        spark.createDataFrame([(r,) for r in fixed.DISTRICT_REGIONS.values()], "region_id string"),
    )


@pytest.fixture
def places(spark):
    return spark.createDataFrame([("S", "D", "A", "m_a"), ("S", "D", "B", "m_b")],
                                 "state string, district string, market string, market_id string")


def content(rows, drop=("written",)):
    return sorted(map(tuple, rows.drop(*drop).collect()))


def test_old_day_changes_exactly_the_anchors_behind_it(spark, tmp_path, keep, places):
    store = str(tmp_path)
    present = [n for n in range(0, 75) if n not in (10, 11) and not 30 <= n < 64]
    ingest.ingest_market(spark, records(spark, present), places, store, keep_quality=keep)
    before = {(r.commodity_id, r.as_of_date): r for r in ingest.quality_table(spark, store).collect()}
    assert len(before) == 2 * 75
    ingest.ingest_market(spark, records(spark, [11]), places, store, keep_quality=keep)
    after = ingest.quality_table(spark, store)
    changed = {(r.commodity_id, r.as_of_date) for r in after.collect() if r.written == 2}
    assert changed == {(fixed.COMMODITY, day(n)) for n in range(11, 41)}
    columns = after.drop("written").columns
    full = ingest.all_snapshots(spark, store, keep)
    assert content(after.select(columns)) == content(full.select(columns))
    # A later day and an earlier one than all so far widen the range for every commodity.
    ingest.ingest_market(spark, records(spark, [-3, 78]), places, store, keep_quality=keep)
    grown = ingest.quality_table(spark, store)
    assert grown.count() == 2 * 82
    assert content(grown.select(columns)) == content(ingest.all_snapshots(spark, store, keep).select(columns))


def test_silent_days_fall_to_missing(spark, tmp_path, keep, places):
    store = str(tmp_path)
    ingest.ingest_market(spark, records(spark, [*range(0, 31), 80]), places, store, keep_quality=keep)
    got = {(r.as_of_date - START).days: r for r in ingest.quality_table(spark, store).filter("commodity_id = 'cotton'").collect()}
    health = {n: json.loads(r.source_health) for n, r in got.items()}
    assert health[30][fixed.MARKET_SOURCE] == "fresh" and health[40][fixed.MARKET_SOURCE] == "stale"
    assert [health[n][fixed.MARKET_SOURCE] for n in (59, 60, 79)] == ["stale", "missing", "missing"]
    detail = [health[n][f"{fixed.MARKET_SOURCE}_detail"] for n in (30, 40, 59, 60)]
    assert [d["days_with_data"] for d in detail] == [30, 20, 1, 0]
    assert detail[0]["markets_reporting"] == 2 and detail[3]["markets_reporting"] == 0
    assert "latest_as_of_date" not in detail[3] and got[60].lag_hours is None
    wheat = ingest.quality_table(spark, store).filter("commodity_id = 'wheat'").collect()
    assert {json.loads(r.source_health)[fixed.MARKET_SOURCE] for r in wheat} == {"missing"}


def test_batch_is_seen_whole_or_not_at_all(spark, tmp_path, keep, places, monkeypatch):
    store, straight = str(tmp_path / "a"), str(tmp_path / "b")
    ingest.ingest_market(spark, records(spark, range(3)), places, store, keep_quality=keep)
    real, calls = commits.Batch.append, []

    def broken(self, table, rows, day="as_of_date"):
        calls.append(table)
        if table == ingest.ARRIVALS:
            raise OSError("killed between the two appends")
        real(self, table, rows, day)

    monkeypatch.setattr(commits.Batch, "append", broken)
    with pytest.raises(OSError):
        ingest.ingest_market(spark, records(spark, range(2, 6)), places, store, keep_quality=keep)
    assert calls == [ingest.PRICES, ingest.ARRIVALS]
    monkeypatch.setattr(commits.Batch, "append", real)
    assert commits.read(spark, store, ingest.PRICES, schemas.PRICE_OBSERVATION).count() == 6
    again = ingest.ingest_market(spark, records(spark, range(2, 6)), places, store, keep_quality=keep)
    assert (again["prices_inserted"], again["prices_skipped"], again["arrivals_inserted"]) == (6, 2, 3)
    ingest.ingest_market(spark, records(spark, range(3)), places, straight, keep_quality=keep)
    once = ingest.ingest_market(spark, records(spark, range(2, 6)), places, straight, keep_quality=keep)
    assert once == again
    assert content(ingest.quality_table(spark, store)) == content(ingest.quality_table(spark, straight))


def test_replayed_batch_number_and_conflict(spark, tmp_path, places):
    store = str(tmp_path)
    first = ingest.ingest_market(spark, records(spark, [1, 2]), places, store, writer="w", number=5)
    same = ingest.ingest_market(spark, records(spark, [1, 2]), places, store, writer="w", number=5)
    assert same == first and first["anchor"] == day(2) and commits.state(spark, store).version == 1
    late = commits.Batch(spark, store)
    ingest.ingest_market(spark, records(spark, [3]), places, store, writer="w", number=6)
    late.append("t", spark.createDataFrame([("x", day(0))], "k string, as_of_date date"))
    with pytest.raises(commits.Conflict):
        late.commit()
    assert commits.read(spark, store, "t", "k string, as_of_date date").count() == 0
    commits.compact(spark, store, ingest.PRICES, schemas.PRICE_OBSERVATION)
    assert len(commits.state(spark, store).tables[ingest.PRICES]) == 1
    assert commits.read(spark, store, ingest.PRICES, schemas.PRICE_OBSERVATION).count() == 6


def test_backfill_goes_on_where_it_broke_off(spark, tmp_path, keep, places, monkeypatch):
    broken, straight = str(tmp_path / "a"), str(tmp_path / "b")
    rows, start, end = records(spark, [*range(0, 25), *range(40, 70)]), day(0), day(69)
    real, seen = ingest.ingest_market, []

    def limited(*args, **kw):
        seen.append(kw["finished"][1:])
        if len(seen) == 3:
            raise OSError("killed in the third step")
        return real(*args, **kw)

    monkeypatch.setattr(ingest, "ingest_market", limited)
    run = lambda folder: ingest.backfill_market(
        spark, rows, places, folder, start, end, keep_quality=keep, step_days=20)
    with pytest.raises(OSError):
        run(broken)
    rest = run(broken)
    assert [s[0] for s in seen] == [day(0), day(20), day(40), day(40), day(60)]
    assert (rest["steps"], rest["prices_inserted"], rest["anchor"]) == (2, 60, day(69))
    monkeypatch.setattr(ingest, "ingest_market", real)
    assert run(straight)["prices_inserted"] == 110
    for table, schema in ((ingest.PRICES, schemas.PRICE_OBSERVATION), (ingest.ARRIVALS, schemas.ARRIVAL_OBSERVATION)):
        assert content(commits.read(spark, broken, table, schema)) == content(commits.read(spark, straight, table, schema))
    assert content(ingest.quality_table(spark, broken)) == content(ingest.quality_table(spark, straight))
    last = ingest.quality_table(spark, straight).filter(f"as_of_date = '{end}' AND commodity_id = 'cotton'").first()
    detail = json.loads(last.source_health)[f"{fixed.MARKET_SOURCE}_detail"]
    assert (detail["window_days"], detail["days_with_data"]) == (70, 55)
    assert run(broken)["steps"] == 0
    assert commits.unfinished([], start, start, 5) == [(start, start)]


def test_weather_ingest_blends_the_snapshot(spark, tmp_path, keep, places):
    store = str(tmp_path)
    ingest.ingest_market(spark, records(spark, range(5)), places, store, keep_quality=keep)
    market = {r.as_of_date: r.overall_quality_score for r in ingest.quality_table(spark, store).filter("commodity_id = 'cotton'").collect()}
    schema = "district_name string, as_of_date date, rainfall_mm double, temperature_mean_c double, relative_humidity_pct double, provenance map<string,string>"
    points = [("Khammam", day(2), 1.0, 25.0, 50.0, {}), ("Nowhere", day(2), 1.0, 25.0, 50.0, {}), ("Warangal", day(3), 900.0, 25.0, 50.0, {})]
    out = ingest.ingest_weather(spark, spark.createDataFrame(points, schema), store, keep_quality=keep)
    assert out == {"drafts": 1, "rejected": 2, "inserted": 1, "skipped": 0}
    got = {r.as_of_date: r for r in ingest.quality_table(spark, store).filter("commodity_id = 'cotton'").collect()}
    assert [got[day(n)].written for n in range(5)] == [1, 1, 2, 2, 2]
    health = json.loads(got[day(2)].source_health)
    assert health["weather"] == "stale" and health["weather_detail"]["regions_reporting"] == 1
    weather_score = 0.4 * 0.2 + 0.35 / 30 + 0.25 * (1 - 12 / 168) - 0.3
    assert got[day(2)].overall_quality_score == pytest.approx((market[day(2)] + max(round(weather_score, 4), 0)) / 2, abs=1e-4)


def test_anchors_without_days(spark):
    none = spark.createDataFrame([], "series_id string, as_of_date date, _reporting bigint, _seen timestamp, _bad_rows bigint")
    asked = spark.createDataFrame([("s", day(0))], "series_id string, as_of_date date")
    rows = quality.scored(quality.source_metrics(none, spark.createDataFrame([("m",)], "market_id string"), anchors=asked)).collect()
    assert [(r.health, r.days_with_data, r.anomaly_count, r.lag_hours) for r in rows] == [("missing", 0, 0, None)]


def test_first_prices_of_a_key_equal_the_long_way(spark):
    import itertools

    from tidemark.operators import dedupe as D
    from tidemark.operators import mapping as M

    cells = itertools.product(("m1", "m2"), (day(0), day(1)), (None, "A|B"), range(4))
    rows = [(f"f{i % 3}", i, m, fixed.COMMODITY, g, d, Decimal(10 * i) if i % 3 else None, Decimal(i), None if i % 4 else Decimal(7), None)
            for i, (m, d, g, _) in enumerate(cells)]
    schema = ("source_file string, position int, market_id string, commodity_id string, quality_grade string, as_of_date date, "
              "min_price decimal(18,4), max_price decimal(18,4), modal_price decimal(18,4), arrival_tonnes decimal(18,4)")
    mapped = spark.createDataFrame(rows, schema)
    long = D.first_per_key(M.price_rows(mapped, ["source_file", "position"]), D.PRICE_KEY, ["source_file", "position"])
    wide = M.first_price_rows(mapped, ["source_file", "position"])
    assert content(wide.select(long.columns), ()) == content(long, ()) and wide.count() == 24
    stored = long.filter("price_type = 'max' AND quality_grade IS NULL")
    for bits in (0, 1 << 12, 64):
        assert D.without_stored(wide, stored, D.PRICE_KEY, bits).count() == 20


def test_key_filter_misses_no_key_and_holds_few_others(spark):
    from tidemark.operators import dedupe as D

    keys = spark.range(0, 3000, 3).selectExpr("id", "IF(id % 2 = 0, NULL, CAST(id AS STRING)) AS s")
    test = D.key_filter(keys, ["id", "s"], 1 << 16)
    assert keys.filter(test).count() == 1000
    assert spark.range(10_000, 60_000).selectExpr("id", "CAST(id AS STRING) AS s").filter(test).count() < 500
    none = D.key_filter(keys.limit(0), ["id", "s"], 1 << 16)
    assert keys.filter(none).count() == 0
