import datetime as dt
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import dedupe as D
from tidemark.operators import mapping, versions
from tidemark.plans import ingest
from tidemark.sources import commits, files, seeds, tables
from tidemark.streaming.file_ingest import market_stream


def record(**kw):
    base = dict(state="Telangana", district="Warangal", market="Warangal", commodity="Cotton",
                variety="Long", grade="FAQ", arrival_date="05/2/2026", min_price="6500",
                max_price=7200, modal_price="6900.5", arrival_tonnes=12.5)
    return {**base, **kw}


def places(spark):
    return spark.createDataFrame(
        [("Telangana", "Warangal", "Warangal", "mkt_w")],
        "state string, district string, market string, market_id string",
    )


def land(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"total": len(records), "records": records}))


def test_market_documents(spark, tmp_path):
    land(tmp_path / "in", "a.json", [
        record(), record(commodity="Cotton Seed"), record(market="Nowhere"),
        record(modal_price="abc"), record(arrival_date="31/02/2026"), record(state=" "), "text",
        record(min_price=None, max_price="", modal_price=None, grade=None, variety=" "),
    ])
    parsed = files.market_records(spark, str(tmp_path / "in"))
    reasons = {r["position"]: r["reject_reason"] for r in parsed.collect()}
    assert [reasons[i] is None for i in range(8)] == [True, True, True, False, False, False, False, True]
    assert reasons[6] == "expected object" and "state" in reasons[5]
    mapped = mapping.map_records(parsed, places(spark))
    prices = mapping.price_rows(mapped, files.ORDER).collect()
    assert {(r["price_type"], float(r["value"])) for r in prices} == {
        ("modal", 6900.5), ("min", 6500.0), ("max", 7200.0)}
    assert prices[0]["quality_grade"] == "Long|FAQ"
    assert prices[0]["observed_at"] == dt.datetime(2026, 2, 5, 18, 30)
    arrivals = mapping.arrival_rows(mapped, files.ORDER).collect()
    assert [float(r["volume"]) for r in arrivals] == [125.0, 125.0]
    files.require_some(parsed)


def test_broken_envelopes(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.json").write_text(json.dumps({"rows": []}))
    with pytest.raises(files.SourceError):
        files.require_some(files.market_records(spark, str(tmp_path / "bad")))
    land(tmp_path / "all", "a.json", [record(modal_price="x")])
    with pytest.raises(files.SourceError):
        files.require_some(files.market_records(spark, str(tmp_path / "all")))


def test_ingest_is_idempotent(spark, tmp_path):
    land(tmp_path / "in", "a.json", [record(), record(), record(arrival_date="6/2/2026", grade=None, variety=None)])
    parsed = files.market_records(spark, str(tmp_path / "in"))
    store = str(tmp_path / "store")
    dry = ingest.ingest_market(spark, parsed, places(spark), store, dry_run=True)
    first = ingest.ingest_market(spark, parsed, places(spark), store)
    again = ingest.ingest_market(spark, parsed, places(spark), store)
    assert dry == first
    assert (first["price_drafts"], first["prices_inserted"], first["prices_skipped"]) == (9, 6, 3)
    assert (first["arrivals_inserted"], first["arrivals_skipped"]) == (2, 1)
    assert first["anchor"] == dt.date(2026, 2, 6)
    assert again["prices_inserted"] == 0 and again["arrivals_inserted"] == 0
    stored = commits.read(spark, store, ingest.PRICES, schemas.PRICE_OBSERVATION)
    assert stored.count() == 6
    window = ingest.backfill_market(
        spark, parsed, places(spark), str(tmp_path / "other"), dt.date(2026, 2, 6), dt.date(2026, 2, 6))
    assert window["prices_inserted"] == 3


def test_file_stream_appends_once(spark, tmp_path):
    land(tmp_path / "in", "a.json", [record()])
    store, check = str(tmp_path / "store"), str(tmp_path / "check")
    market_stream(spark, str(tmp_path / "in"), places(spark), store, check).awaitTermination()
    land(tmp_path / "in", "b.json", [record(), record(arrival_date="07/02/2026")])
    market_stream(spark, str(tmp_path / "in"), places(spark), store, check).awaitTermination()
    stored = commits.read(spark, store, ingest.PRICES, schemas.PRICE_OBSERVATION)
    assert stored.count() == 6


def test_futures_csv(spark, tmp_path):
    path = tmp_path / "bhav.csv"
    path.write_text(
        "TradDt,TckrSymb,SctySrs,XpryDt,SttlPric,OpnIntrst,TtlTradgVol\n"
        "2026-02-10,KAPAS,FUTCOM,2026-04-30,\"1,345.50\",120,10\n"
        "10-02-2026,KAPAS,FUTCOM,27/02/2026,1310.25,0,-\n"
        "2026/02/10,SHANKRKPAS,,2026-06-30,1400,-,\n"
        "2026-02-10,GUAR,FUTCOM,2026-04-30,5000,1,1\n"
        "2026-02-10,KAPAS,OPTFUT,2026-04-30,5000,1,1\n"
        "2026-02-10,KAPAS,FUTCOM,2026-04-30,0,1,1\n")
    parsed = files.futures_file(spark, str(path))
    good = files.futures_order(parsed.filter("reject_reason IS NULL")).collect()
    assert [(str(r["expiry_date"]), r["contract_symbol"]) for r in good] == [
        ("2026-02-27", "KAPAS"), ("2026-04-30", "KAPAS"), ("2026-06-30", "SHANKRKPAS")]
    assert [float(r["settle_price_quintal"]) for r in good] == [6551.25, 6727.5, 7000.0]
    assert [r["open_interest"] for r in good] == [None, 120, None]
    assert parsed.filter("reject_reason IS NOT NULL").count() == 1


def test_weather_grid_drops_fill(spark, tmp_path):
    (tmp_path / "w").mkdir()
    block = {"PRECTOTCORR": {"20260101": 1.23456, "20260102": 2.0},
             "T2M": {"20260101": 25.111, "20260102": -999.0}, "RH2M": {"20260101": 60.0, "20260102": 61.0}}
    (tmp_path / "w" / "Khammam.json").write_text(json.dumps(
        {"header": {"fill_value": -999.0}, "properties": {"parameter": block}}, indent=1))
    points = files.weather_grid(spark, str(tmp_path / "w"))
    store = str(tmp_path / "store")
    assert ingest.ingest_weather(spark, points, store) == {
        "drafts": 1, "rejected": 0, "inserted": 1, "skipped": 0}
    assert ingest.ingest_weather(spark, points, store)["inserted"] == 0
    row = commits.read(spark, store, ingest.WEATHER, schemas.WEATHER_OBSERVATION).first()
    assert row["region_id"] == "reg_tg_khammam" and float(row["rainfall_mm"]) == 1.2346
    assert float(row["temperature_mean_c"]) == 25.11


def test_supervised_lines_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [(dt.date(2026, 1, 1), "cotton", h, 6000.0, 6450.0, 0.0723206616, None, None, {"a": "1.5", "b": "x"})
         for h in (30, 60)],
        "as_of_date date, commodity_id string, horizon_days int, spot_price_level double, "
        "target_price_level double, target_log_return double, registry_id string, "
        "snapshot_hash string, features map<string,string>")
    files.write_supervised(rows, str(tmp_path / "d"))
    back = files.read_supervised(spark, str(tmp_path / "d" / "horizon_days=30")).first()
    assert back["features"] == {"a": "1.5", "b": "x"} and float(back["spot_price_level"]) == 6000
    assert back["target_log_return"] == 0.07232066
    (tmp_path / "bad.jsonl").write_text("\n{oops\n")
    with pytest.raises(files.SourceError):
        files.read_supervised(spark, str(tmp_path / "bad.jsonl"))


def test_seeds_and_policy(spark, tmp_path):
    seed = {
        "commodity": {"commodity_id": "cotton", "name": "Cotton"},
        "commodity_profile": {"display_name": "Cotton"},
        "registry": {"version": "1", "effective_from": "2026-01-01", "required_agents": ["Market", "Futures"],
                     "decision_rules": {"msp_proximity_pct": 0.03}},
        "regions": [{"region_id": "r1", "name": "R", "type": "state"},
                    {"region_id": "r2", "name": "Q", "type": "district", "parent_region_id": "r1"}],
        "markets": [{"market_id": "m1", "region_id": "r2", "market_type": "mandi", "name": "M",
                     "source_identifiers": {"agmarknet": {"state": "T", "district": "D", "market": "M"}}},
                    {"market_id": "m2", "region_id": "r2", "market_type": "mandi", "name": "N"}],
    }
    (tmp_path / "seed.json").write_text(json.dumps(seed, indent=1))
    found = seeds.seed_tables(seeds.seed_document(spark, str(tmp_path / "seed.json")))
    assert found["region"].count() == 2 and found["registry"].first()["forecast_horizons"] == [30, 60, 90]
    assert [r["market_id"] for r in seeds.expected_markets(found["market"]).collect()] == ["m1"]
    assert [r["state"] for r in seeds.expected_states(found["market"]).collect()] == ["T"]
    path = str(tmp_path / "dim" / "market")
    for _ in range(2):
        tables.upsert_table(spark, path, found["market"], ["market_id"], ["market_id"])
    assert spark.read.parquet(path).count() == 2
    policy = {"commodity_id": "cotton", "observations": [
        {"policy_type": "export_ban", "source": "pib_manual", "published_date": "2026-01-01",
         "effective_date": "2026-01-02", "impact_direction": "bearish", "confidence": "0.9"}]}
    (tmp_path / "policy.json").write_text(json.dumps(policy))
    events = seeds.policy_events(spark, str(tmp_path / "policy.json"))
    assert seeds.new_policy_events(events.unionAll(events), events.limit(0), ["effective_date"]).count() == 1
    assert seeds.new_policy_events(events, events.withColumn("summary", F.lit("")), ["effective_date"]).count() == 0


def test_month_upsert_keeps_other_months(spark, tmp_path):
    path = str(tmp_path / "q")
    make = lambda rows: spark.createDataFrame(rows, "k string, as_of_date date, score double")
    jan, feb = dt.date(2026, 1, 5), dt.date(2026, 2, 5)
    tables.upsert_months(spark, path, make([("a", jan, 1.0), ("a", feb, 0.5), ("a", feb, 1.0)]), ["k", "as_of_date"], ["score"])
    tables.upsert_months(spark, path, make([("a", feb, 2.0), ("b", feb, 1.0), ("b", feb, 3.0)]), ["k", "as_of_date"], ["score"])
    got = {(r["k"], r["as_of_date"]): r["score"] for r in spark.read.parquet(path).collect()}
    assert got == {("a", jan): 1.0, ("a", feb): 2.0, ("b", feb): 3.0}


def test_upsert_survives_a_crash(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "k string, v int")
    tables.upsert_table(spark, path, make([("a", 1), ("b", 1)]), ["k"], ["v"])
    # The merge is whole, the move emptied the table and stopped.
    make([("a", 1), ("b", 2)]).write.parquet(f"{path}__merge")
    shutil.rmtree(path)
    tables.upsert_table(spark, path, make([("c", 3), ("c", 2)]), ["k"], ["v"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    # The merge itself stopped: what it left is no table.
    make([("z", 9)]).write.parquet(f"{path}__merge")
    os.remove(f"{path}__merge/_SUCCESS")
    tables.upsert_table(spark, path, make([("d", 4)]), ["k"], ["v"])
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "d"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        tables.upsert_table(spark, str(tmp_path / "bad"), make([("d", 4)]), ["k"], ["v"])


def test_repeated_keys_of_a_batch_count_once(spark):
    rows = [("c", "r", v, dt.date(2024, 1, 1), dt.date(2024, 6, 30), "h", i) for i, v in enumerate("aabba")]
    models = spark.createDataFrame(rows, "commodity_id string, registry_id string, model_version string, "
                                   "training_window_start date, training_window_end date, feature_set_hash string, i int")
    fresh = D.new_rows(models, models.limit(0), versions.MODEL_KEY, ["i"])
    assert sorted((r["model_version"], r["i"]) for r in fresh.collect()) == [("a", 0), ("b", 2)]


def test_range_scan_prunes_months(spark, tmp_path):
    rows = spark.range(60).select(
        F.date_add(F.lit(dt.date(2026, 1, 1)), F.col("id").cast("int")).alias("as_of_date"), "id")
    tables.append_facts(rows, str(tmp_path / "t"))
    table = tables.read_facts(spark, str(tmp_path / "t"), "as_of_date date, id long")
    scan = tables.date_range(table, dt.date(2026, 1, 10), dt.date(2026, 1, 12))
    assert scan.count() == 3
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "as_of_month" in plan.split("PartitionFilters")[1]


def test_metrics_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{
        "model_name": "naive_persistence", "horizon_days": 30, "fold_count": 3, "mode": "fixture",
        "model_path": None, "metrics": {"mae": 450.0, "rmse": 450.0, "mape_pct": 5.7812, "n_samples": 60}}]))
    rows = files.metrics_rows(spark, str(tmp_path / "m.json"))
    assert rows.first()["mae"] == 450.0
    files.write_metrics(rows, str(tmp_path / "out"))
    assert files.metrics_rows(spark, str(tmp_path / "out")).collect() == rows.collect()
