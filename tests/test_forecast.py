import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import frames as X
from tidemark import fixed
from tidemark.operators import basket as B
from tidemark.operators import folds as W
from tidemark.operators import validation as V
from tidemark.operators import versions as R
from tidemark.operators.coverage import missing_periods
from tidemark.operators.dedupe import new_rows
from tidemark.operators.replay import mismatches, validate_cycles
from tidemark.plans import datasets as D
from tidemark.plans import effectiveness as E
from tidemark.plans import features as P
from tidemark.plans import kpi as K
from tidemark.plans import models as M

WINDOW = (X.END - dt.timedelta(days=149), X.END)


@pytest.fixture(scope="module")
def rows(spark):
    level = B.price_basket(B.usable_rows(X.rising_prices(spark, 150, 6000.0, 15.0)))
    return D.supervised(D.candidates(level, WINDOW)).cache()


def test_dataset_sizes_and_leakage(spark, rows):
    sizes = {r["horizon_days"]: r["count"] for r in rows.groupBy("horizon_days").count().collect()}
    assert sizes == {30: 120, 60: 90, 90: 60}
    assert rows.filter("target_price_level <> spot_price_level + 15 * horizon_days").count() == 0
    changed = X.rising_prices(spark, 150, 6000.0, 15.0).withColumn(
        "value", F.when(F.col("as_of_date") == X.END, 1.0).otherwise(F.col("value")))
    other = D.supervised(D.candidates(B.price_basket(B.usable_rows(changed)), WINDOW))
    moved = mismatches(rows, other).count() // 2
    assert moved == 3  # only the rows whose target is the changed day


def test_baselines_reach_known_values(rows):
    folds = M.fold_bounds(rows)
    thirty = folds.filter("horizon_days = 30").orderBy("fold_index").collect()
    assert [(r["train_end"], r["test_end"]) for r in thirty] == [(60, 80), (80, 100), (100, 120)]
    guesses = M.naive_predictions(rows, folds).unionByName(M.spot_line_predictions(rows, folds))
    found = {r["model_name"]: r for r in M.evaluation(guesses).filter("horizon_days = 30").collect()}
    naive, line = found[fixed.NAIVE], found[fixed.LINEAR]
    assert (naive["mae"], naive["rmse"], naive["n_samples"], naive["fold_count"]) == (450, 450, 60, 3)
    assert naive["mape_pct"] == pytest.approx(5.7812, abs=5e-4)
    assert line["mae"] == pytest.approx(0, abs=1e-5)
    beats = K.beats_naive(M.evaluation(guesses), ["series_id", "horizon_days"])
    assert all(r["beats_naive"] for r in beats.collect())


def test_short_series_gets_one_fold(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 70), ("d", 80)], "g string, n_rows long")
    got = {(r["g"], r["fold_index"]): (r["train_end"], r["test_end"])
           for r in W.rolling_origin(sizes).collect()}
    assert got == {("b", 0): (1, 2), ("c", 0): (60, 70), ("d", 0): (60, 80)}


def test_grouped_and_forest_models(rows, tmp_path):
    matrix = rows.filter("horizon_days = 30").select(
        "series_id", "as_of_date", "horizon_days", "spot_price_level", "target_price_level",
        F.lit(1.0).alias("constant"))
    names = ["spot_price_level", "constant"]
    own = M.least_squares_predictions(matrix, names, M.fold_bounds(matrix), "ols")
    assert M.evaluation(own).first()["rmse"] == pytest.approx(0, abs=1e-5)
    fitted = M.fit_full(matrix, names, fixed.LINEAR, str(tmp_path / "m"))
    assert M.saved_features(matrix.sparkSession, str(tmp_path / "m")) == names
    assert fitted is not None
    _, reason = M.reuse_or_fit(matrix, names, str(tmp_path / "m"))
    assert reason == "saved_artifact"


def test_least_squares_against_numpy(spark):
    rng = random.Random(8)
    data = [("s", d, 30, rng.uniform(50, 90), rng.uniform(0, 1), 5.0) for d in X.days(130)]
    data = [(*r, 2 * r[4], 3 * r[3] - 7 * r[4] + rng.gauss(0, 2)) for r in data]
    df = spark.createDataFrame(data, "series_id string, as_of_date date, horizon_days int, spot_price_level double, "
                               "u double, constant double, twin double, target_price_level double")
    names = ["spot_price_level", "u", "constant", "twin"]
    got = M.least_squares_predictions(df, names, M.fold_bounds(df), "ols").collect()
    rows = sorted(data, key=lambda r: r[1])
    want = {}
    for end in (60, 80, 100):
        x = np.array([[1, r[3], r[4]] for r in rows])
        y = np.array([r[7] for r in rows])
        beta = np.linalg.lstsq(x[:end], y[:end], rcond=None)[0]
        want |= {rows[i][1]: x[i] @ beta for i in range(end, end + 20)}
    assert {r["as_of_date"]: pytest.approx(r["prediction"], rel=1e-9) for r in got} == want


def test_forest_lands_near_the_published_scores(rows):
    matrix = rows.filter("horizon_days = 30").select(
        "series_id", "as_of_date", "horizon_days", "spot_price_level", "target_price_level")
    result = M.evaluation(M.forest_predictions(matrix, ["spot_price_level"])).first()
    assert (result["fold_count"], result["n_samples"]) == (3, 60)
    assert 130 < result["mae"] < 210 and 150 < result["rmse"] < 230


def test_walk_forward_against_loop(spark):
    rng = random.Random(3)
    days = sorted(rng.sample(X.days(400), 150))
    df = spark.createDataFrame([("s", d, 30) for d in days], "series_id string, as_of_date date, horizon_days int")
    for spec in (W.WalkForward(), W.WalkForward(step_rows=3), W.WalkForward(step_days=10, step_rows=2),
                 W.WalkForward(min_train=10, train_window=12, step_days=15)):
        want, last, seen = [], None, 0
        for day in days:
            pool = [d for d in days if d + dt.timedelta(days=30) < day]
            pool = pool[-spec.train_window:] if spec.train_window else pool
            if len(pool) < spec.min_train:
                continue
            if last and spec.step_days and day < last + dt.timedelta(days=spec.step_days):
                continue
            seen += 1
            if seen % spec.step_rows:
                continue
            want.append((day, len(pool)))
            last = day
        folds = W.walk_forward(df, spec)
        got = [(r["test_date"], r["train_rows"]) for r in folds.orderBy("fold_index").collect()]
        assert got == want
        assert W.leaking_rows(df, folds).isEmpty()
    members = W.members(df, folds)
    assert members.filter("role = 'train'").count() == sum(n for _, n in want)


def test_duplicate_days_are_an_error(spark):
    df = spark.createDataFrame([("s", X.END, 30)] * 2, "series_id string, as_of_date date, horizon_days int")
    with pytest.raises(ValueError):
        W.require_unique_days(df)


def test_kpis_by_hand(spark):
    pairs = spark.createDataFrame(
        [(30, 110.0, 100.0, 90.0, 120.0), (30, 90.0, 100.0, 101.0, 120.0), (30, 5.0, 0.0, None, 9.0)],
        "horizon_days long, predicted double, actual double, band_low double, band_high double")
    by = {r["horizon_days"]: r for r in K.horizon_kpis(pairs).collect()}
    assert (by[30]["mae"], by[30]["mape"], by[30]["coverage"]) == (8.3333, 10.0, 0.5)
    assert by[30]["rmse"] == 8.6603
    assert by[60]["sample_count"] == 0 and by[60]["mae"] is None


def test_gaps(spark):
    d = dt.date(2026, 1, 1)
    at = lambda *n: [("m1", d + dt.timedelta(days=i)) for i in n]
    rows = spark.createDataFrame(at(0, 1, 4, 9), "market_id string, as_of_date date")
    gaps = missing_periods(rows, X.expected(spark), "market_id", F.lit(d), F.lit(d + dt.timedelta(days=9)))
    got = sorted((r["market_id"], r["gap_start"].day, r["gap_end"].day, r["gap_days"]) for r in gaps.collect())
    assert got == [("m1", 3, 4, 2), ("m1", 6, 9, 4), ("m2", 1, 10, 10)]


def test_forward_level_and_evaluable_days(spark):
    days = X.days(120)
    level = spark.createDataFrame(
        [("s", d, 100.0 + i) for i, d in enumerate(days) if i % 2 == 0],
        "series_id string, as_of_date date, level double")
    got = E.forward_returns(level).filter(F.col("as_of_date") == days[0]).first()
    assert got["forward_return_7d"] == pytest.approx(0.08)  # day 7 is missing, day 8 counts
    kept = [r["as_of_date"] for r in E.evaluable(level).collect()]
    assert min(kept) == days[30] and max(kept) == days[88]


def test_hot_key_dedupe_keeps_first_and_null_grade(spark):
    many = spark.range(5000).select(
        F.lit("m").alias("market_id"), F.lit(X.END).alias("as_of_date"), F.lit("x").alias("source"),
        F.lit("modal").alias("price_type"), F.lit(None).cast("string").alias("quality_grade"),
        F.lit("f").alias("source_file"), F.col("id").alias("position"),
        F.create_map(F.lit("k"), F.col("id").cast("string")).alias("payload"))
    keys = ["market_id", "as_of_date", "source", "price_type", "quality_grade"]
    only = new_rows(many, None, keys, ["source_file", "position"]).collect()
    assert len(only) == 1 and only[0]["payload"] == {"k": "0"}
    assert new_rows(many, many.limit(1), keys, ["source_file", "position"]).isEmpty()


def test_constraint_sets(spark):
    horizon = "struct<point:double,band_low:double,band_high:double,direction:string,forecast_confidence:double>"
    df = spark.createDataFrame(
        [(1, (1.0, 0.5, 2.0, "bullish", 0.4)), (2, (1.0, 0.5, 2.0, "up", 0.4)), (3, None)],
        f"id int, horizon_30 {horizon}")
    good, bad = V.constraints(df, V.forecast_rules(["horizon_30"]))
    assert sorted(r["id"] for r in good.collect()) == [1, 3] and bad.first()["id"] == 2
    users = spark.createDataFrame([("farmer", "low"), ("king", "low")], "persona_type string, liquidity_need string")
    assert V.constraints(users, V.USER_CONTEXT())[1].count() == 1
    policy = spark.createDataFrame([("export_ban", "pib_manual", "bearish", 1.2, "validated")],
                                   "policy_type string, source string, impact_direction string, "
                                   "confidence double, validation_status string")
    assert V.constraints(policy, V.POLICY())[0].isEmpty()
    quality = spark.createDataFrame([(0.5, None), (1.5, 0.1)], "overall_quality_score double, confidence_penalty_factor double")
    assert V.constraints(quality, V.QUALITY())[0].count() == 1
    deal = spark.createDataFrame([("SELL", 0.5), ("BUY", 0.5)], "action_type string, recommendation_confidence double")
    assert V.constraints(deal, V.RECOMMENDATION())[0].count() == 1
    futures = spark.createDataFrame([(fixed.FUTURES_SOURCE, "prototype", "validated", 0.0)],
                                    "source string, environment string, validation_status string, settle_price double")
    assert V.constraints(futures, V.FUTURES())[1].count() == 1


def test_training_matrix_and_names(spark):
    df = spark.createDataFrame([(1.0, {"b": "2", "a": "x"}), (3.0, {"c": "true"})],
                               "spot_price_level double, features map<string,string>")
    matrix, names = P.training_matrix(df)
    assert names == ["spot_price_level", "b", "c"]
    assert sorted(tuple(r) for r in matrix.collect()) == [(1.0, 2.0, 0.0), (3.0, 0.0, 1.0)]
    assert len(P.names_hash(names)) == 64


def test_training_vectors_have_no_limit(spark):
    long = "n" * 128
    first = {f"f{i:05d}": str(i) for i in range(20_000)} | {long + "a": "1", long + "b": "2", "word": "x"}
    df = spark.createDataFrame([(1, 1.0, first), (2, 3.0, {"f00002": "9", "spot_price_level": "5"}), (3, 4.0, {})],
                               "k int, spot_price_level double, features map<string,string>")
    vectors, index = P.training_vectors(df, ["k"])
    names = {r["index"]: r["name"] for r in index.collect()}
    assert [names[i] for i in range(len(names))] == ["spot_price_level", *sorted(n for n in first if n != "word")]
    got = {r["k"]: r for r in vectors.collect()}
    assert {names[i]: v for i, v in zip(got[1]["indices"], got[1]["values"])} == {n: float(v) for n, v in first.items() if n != "word"}
    assert ([names[i] for i in got[2]["indices"]], got[2]["values"], got[3]["indices"]) == (["f00002"], [9.0], [])


def test_feature_names_are_whole(spark):
    long = "n" * 128
    sets = spark.createDataFrame([("c", dt.date(2026, 1, 1), "r", {long + "a": "1", long + "b": "2"})],
                                 "commodity_id string, as_of_date date, registry_id string, feature_values map<string,string>")
    assert {r["name"] for r in P.feature_vectors(sets).collect()} == {long + "a", long + "b"}


def test_replay_is_stable_across_shuffle_settings(spark):
    prices = X.rising_prices(spark, 60)
    produce = lambda: B.price_basket(B.usable_rows(prices))
    assert all(c["matches_first"] for c in validate_cycles(produce, cycles=3))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = produce().collect()
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert sorted(produce().collect()) == sorted(first)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_registry_activation(spark):
    rows = [("r1", "c", "1", None, True), ("r2", "c", "2", None, False), ("r9", "d", "1", None, True)]
    registry = spark.createDataFrame(rows, "registry_id string, commodity_id string, version string, effective_to date, is_active boolean")
    target = spark.createDataFrame([("c", "r2")], "commodity_id string, target_id string")
    got = {r["registry_id"]: (r["is_active"], r["effective_to"]) for r in R.activate(registry, target, F.lit(X.END)).collect()}
    assert got == {"r1": (False, X.END), "r2": (True, None), "r9": (True, None)}


def test_sql_belongs_to_registered_queries():
    from checks import catalog

    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert all(callable(run) for run in catalog.QUERIES.values())


def test_queries_over_every_commodity_and_horizon(spark):
    from checks import catalog

    run = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    attached = {}
    for r in run("dataset_with_all_snapshots"):
        attached[r.commodity_id] = max(attached.get(r.commodity_id, 0), r.feature_count)
    assert {c for c, n in attached.items() if n > 0} == {"c0", "c1", "c2", "c3"} and attached["c4"] == 0
    assert {r.commodity_id for r in run("importance_panel_all_commodities")} == {"c0", "c1", "c2", "c3"}
    assert {r.horizon_days for r in run("forecast_quality_all_horizons")} == {30, 60, 90}


@pytest.mark.parametrize(("lengths", "min_train", "test_size", "step"), [
    ((1, 2, 7, 30, 61), 10, 5, None), ((40, 12, 3), 8, 6, 2), ((50,), 9, 4, 7)])
def test_both_baselines_equal_the_joined_ones(spark, lengths, min_train, test_size, step):
    rng = random.Random(7)
    start = dt.date(2024, 1, 1)
    rows = [(f"s{n}", h, start + dt.timedelta(days=2 * i), 100 + rng.random() * 20, 90 + rng.random() * 30)
            for n in lengths for h in (30, 60) for i in range(n)]
    frame = spark.createDataFrame(rows, "series_id string, horizon_days long, as_of_date date, spot_price_level double, target_price_level double")
    folds = M.fold_bounds(frame, min_train=min_train, test_size=test_size, step=step)
    want = M.naive_predictions(frame, folds).unionByName(M.spot_line_predictions(frame, folds))
    got = M.baseline_predictions(frame, min_train, test_size, step)
    flat = lambda df: sorted((*r[:5], round(r[5], 8)) for r in df.collect())
    assert flat(got) == flat(want) and got.count() > 0


def test_masks_hold_what_the_issue_arrays_hold(spark):
    rows = [(i, None if i % 2 else "x", float(i), None if i % 3 else 5) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, a string, v double, n int")
    rules = [V.Rule("a", "a missing", V.blank("a")), V.Rule("v", "v high", F.col("v") > 6), V.Rule("n", "n missing", V.blank("n")),
             V.Rule("z", "never", F.lit(False))]
    masked = V.masked(df, rules)
    both = masked.withColumn("issues", V.issues(rules)).withColumn("looked_up", V.mask_issues(F.col("issue_mask"), rules))
    got = both.collect()
    assert all(r.issues == r.looked_up for r in got)
    assert [r.issue_mask for r in sorted(got, key=lambda r: r.id)][:8] == [0, 5, 4, 1, 4, 5, 0, 7]
    counts = {r["check"]: r["issue_count"] for r in V.issue_counts(masked, rules).collect()}
    assert counts == {"a": 6, "v": 5, "n": 8, "z": 0}
    assert {r["issue_count"] for r in V.issue_counts(masked.limit(0), rules).collect()} == {0}
    with pytest.raises(ValueError):
        V.rule_mask(rules * 16)
