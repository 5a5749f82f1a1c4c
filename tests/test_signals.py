import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests import frames as X
from tidemark.functions import scores as S
from tidemark.operators import basket as B
from tidemark.operators import ranks, rolling
from tidemark.plans.futures_signal import futures_signal
from tidemark.plans.market_signal import market_signal
from tidemark.plans.weather_signal import weather_signal


def test_rising_prices_are_bullish(spark):
    signal = market_signal(X.rising_prices(spark), X.flat_arrivals(spark), X.expected(spark))
    last = signal.filter(F.col("as_of_date") == X.END).first()
    values = [6800.0 + 20 * i for i in range(30)]
    z = (values[-1] - statistics.mean(values)) / statistics.pstdev(values)
    assert last["momentum_direction"] == "bullish"
    assert float(last["momentum_raw"]) == pytest.approx(round(z, 4))
    assert float(last["arrival_raw"]) == 0.0  # flat volumes have no variance
    assert float(last["reporting_pct"]) == 1.0
    assert last["floor_is_stub"]
    assert last["as_of_timestamp"] == X.noon(X.END)


def test_composite_by_hand(spark):
    last = market_signal(
        X.rising_prices(spark), X.flat_arrivals(spark), X.expected(spark)
    ).filter(F.col("as_of_date") == X.END).first()
    # floor: (7380 - 7121) / 7121 = 0.0364 -> neutral band, strength clipped at 1
    assert float(last["floor_raw"]) == 0.0364 and last["floor_direction"] == "neutral"
    total = (0.35 * float(last["momentum_magnitude"]) + 0.25
             + 0.15 * float(last["acceleration_magnitude"]))
    assert float(last["magnitude"]) == pytest.approx(total, abs=5e-5)
    # 0.75 * 1 * (1 + 1 + 0.65 + 1) / 4 * 0.9
    assert float(last["confidence"]) == 0.6159


def test_rejected_rows_have_no_effect(spark):
    bad = [("s", "m1", X.END, "modal", 9999.0, "rejected", "bad", X.noon(X.END))]
    clean = B.price_basket(B.usable_rows(X.rising_prices(spark, 5))).collect()
    mixed = B.price_basket(B.usable_rows(X.rising_prices(spark, 5, extra=bad))).collect()
    assert sorted(clean) == sorted(mixed)


def test_requested_day_without_rows_is_neutral(spark):
    ask = spark.createDataFrame([("s", dt.date(2030, 1, 1))], "series_id string, as_of_date date")
    row = market_signal(
        X.rising_prices(spark), X.flat_arrivals(spark), X.expected(spark), requested=ask
    ).first()
    assert (row["direction"], float(row["magnitude"]), float(row["confidence"])) == ("neutral", 0, 0)
    assert row["as_of_timestamp"] == dt.datetime(2030, 1, 1, 18)


def test_lag_lowers_confidence(spark):
    lag = spark.createDataFrame([("s", X.END, 36.0)], "series_id string, as_of_date date, lag_hours double")
    row = market_signal(
        X.rising_prices(spark), X.flat_arrivals(spark), X.expected(spark), lag=lag
    ).filter(F.col("as_of_date") == X.END).first()
    assert float(row["confidence"]) == pytest.approx(0.6159375 * 0.7, abs=5e-5)


def test_acceleration_matches_frame_local_loop(spark):
    rng = random.Random(5)
    all_days = sorted(rng.sample(X.days(200), 90))
    levels = [round(rng.uniform(5000, 9000), 0) for _ in all_days]
    basket = spark.createDataFrame(
        [("s", d, v) for d, v in zip(all_days, levels)], "series_id string, as_of_date date, level double"
    )
    got = {r["as_of_date"]: float(r["acceleration_raw"])
           for r in rolling.price_acceleration(basket).collect()}
    for end, day in enumerate(all_days):
        frame = [levels[i] for i in range(end + 1) if (day - all_days[i]).days <= 29]
        moves = [round((b - a) / a, 4) for a, b in zip(frame, frame[1:])]
        accel = [round(b - a, 4) for a, b in zip(moves, moves[1:])]
        if not accel:
            want = 0.0
        elif len(accel) == 1:
            want = accel[0]
        else:
            spread = statistics.pstdev(accel)
            want = round((accel[-1] - statistics.mean(accel)) / spread, 4) if spread > 1e-12 else 0.0
        assert got[day] == pytest.approx(want, abs=2e-4)


def test_futures_backwardation(spark):
    spot = B.price_basket(B.usable_rows(X.rising_prices(spark)))
    row = futures_signal(X.curve(spark), spot).filter(F.col("as_of_date") == X.END).first()
    assert row["curve_regime"] == "backwardation"
    assert float(row["curve_slope"]) == round((1345.5 - 1310.25) / 1345.5, 4)
    assert float(row["confidence"]) <= 0.35
    assert (row["near_symbol"], row["far_symbol"]) == ("A", "B")
    assert float(row["thin_oi_penalty"]) == 0.15  # open interest 49 is below 50
    assert row["futures_feed_ok"] is False


def test_futures_without_curve_is_neutral(spark):
    one = X.curve(spark).filter("contract_symbol = 'A'")
    spot = B.price_basket(B.usable_rows(X.rising_prices(spark))).limit(0)
    row = futures_signal(one, spot).first()
    assert row["direction"] == "neutral" and row["primary_driver"] == "curve_slope"
    assert float(row["confidence"]) == pytest.approx(0.35 * 0.35 * 0.8, abs=5e-5)


def test_weather_stable_then_wet(spark):
    calm = weather_signal(X.weather(spark, [5.0] * 60)).filter(F.col("as_of_date") == X.END).first()
    assert float(calm["rainfall_deviation"]) == 0 and float(calm["rainfall_shock"]) == 0
    wet = weather_signal(X.weather(spark, [5.0] * 59 + [60.0])).filter(
        F.col("as_of_date") == X.END).first()
    assert float(wet["rainfall_shock"]) == 1.0 and wet["direction"] == "bearish"


def test_heat_and_season(spark):
    hot = X.weather(spark, [5.0] * 60, temps=[28.0] * 59 + [40.0])
    row = weather_signal(hot).filter(F.col("as_of_date") == X.END).first()
    assert float(row["temperature_stress"]) == 1.0
    rain = [20.0] * 60
    october = weather_signal(X.weather(spark, rain, end=dt.date(2025, 10, 15)))
    may = weather_signal(X.weather(spark, rain, end=dt.date(2025, 5, 15)))
    risk = lambda df: max(float(r[0]) for r in df.select("harvest_risk_indicator").collect()[-5:])
    assert risk(october) > risk(may)


def test_preferred_status_wins(spark):
    rows = [("belt", "r1", X.END, r, 28.0, 50.0, s, i, X.noon(X.END)) for r, s, i in
            ((1.0, "received", "a"), (2.0, "validated", "b"), (3.0, "published", "c"), (9.0, "rejected", "d"))]
    daily = B.regional_weather(spark.createDataFrame(rows, X.WEATHER)).first()
    assert daily["rainfall_mm"] == 2.0 and daily["regions_reporting"] == 1


def test_exact_median_of_any_group(spark):
    rng = random.Random(1)
    groups = {"large": 5000, "one": 1, "two": 2, "some": 37, "small": 3000, "same": 400}
    pick = {"small": lambda: rng.uniform(0, 0.001), "same": lambda: 7.0}
    other = lambda: float(rng.choice((rng.randint(-50, 50), rng.uniform(-1e6, 1e6), 0.0)))
    rows = [(g, pick.get(g, other)(), i) for g, n in groups.items() for i in range(n)]
    rows += [("none", None, 3), ("none", None, 9), ("one", None, 8), (None, 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, t int").repartition(5)
    out = {r["g"]: r for r in ranks.exact_median(df, ["g"], "v", "m", {"last": "t"}, "n").collect()}
    assert set(out) == {*groups, "none"}
    for g in groups:
        assert out[g]["m"] == statistics.median(v for k, v, _ in rows if k == g and v is not None)
        assert out[g]["n"] == groups[g]
    assert out["none"]["m"] is None and out["none"]["last"] == 9 and out["one"]["last"] == 8


def test_value_blocks_keep_the_order(spark):
    values = sorted({s * m * 2.0**e for s in (-1, 1) for e in range(-30, 31, 3) for m in (1, 1 - 2**-52, 1 + 2**-52, 1.3, 1.99)})
    values = [float("-inf"), *values[: len(values) // 2], 0.0, *values[len(values) // 2 :], float("inf"), float("nan")]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    blocks = [r["b"] for r in df.orderBy("i").select(ranks.value_block(F.col("v")).alias("b")).collect()]
    assert blocks == sorted(blocks)


def test_hot_group_is_spread_over_tasks(spark):
    """One group of 2 million rows in 8 tasks: what is shuffled is blocks, and no task gets a large share."""
    df = spark.range(0, 2_000_000, 1, 8).select(F.lit("hot").alias("g"), (F.rand(4) * 0.001).alias("v"))
    blocks = df.groupBy(ranks.value_block(F.col("v")).alias("b")).count().agg(F.count("*"), F.max("count")).first()
    assert blocks[0] > 100 and blocks[1] < 40_000
    median = ranks.exact_median(df, ["g"], "v", "m").first()["m"]
    low, high = df.agg(F.sum((F.col("v") < median).cast("int")), F.sum((F.col("v") > median).cast("int"))).first()
    assert low == high == 1_000_000


def test_references_of_a_window(spark):
    day = lambda k: dt.date(2026, 1, 1) + dt.timedelta(days=k)
    rows = [("s", day(k), f"o{k:02d}") for k in (0, 0, 1, 5, 40)] + [("s", day(1), "o99"), ("t", day(1), "x")]
    table = spark.createDataFrame(rows, "series_id string, as_of_date date, observation_id string")
    asked = spark.createDataFrame([("s", day(5)), ("s", day(31)), ("u", day(1))], "series_id string, as_of_date date")
    refs = B.source_refs(asked, [table, table])
    assert sorted(r["observation_id"] for r in refs.collect()) == ["o00", "o01", "o05", "o99"]
    got = sorted(tuple(r) for r in B.reference_counts(asked, refs).collect())
    assert got == [("s", day(5), 4, "o00", "o99"), ("s", day(31), 1, "o05", "o05"), ("u", day(1), 0, None, None)]


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([("g", v) for v in (5.0, 1.0, 5.0, 2.0)], "g string, v double")
    got = {r["v"]: r["rank"] for r in ranks.average_ranks(df, ["g"], "v", "rank").collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 5.0: 3.5}


def test_scalar_rounding_and_codes(spark):
    row = spark.range(1).select(
        S.quantize(F.lit(0.00005)).alias("half_up"),
        S.clip_unit(F.lit(1.7)).alias("clip"),
        S.clip_unit(F.lit(None).cast("double")).alias("unknown"),
        S.band_direction(F.lit(-0.06), 0.05).alias("down"),
        S.coded_number(F.lit("bearish")).alias("code"),
        S.number_or_null(F.lit("x")).alias("none"),
        S.log_return(F.lit(0.0), F.lit(5.0)).alias("lr"),
    ).first()
    assert row["half_up"] == 0.0001 and float(row["clip"]) == 1.0 and row["unknown"] is None
    assert (row["down"], row["code"], row["none"], row["lr"]) == ("bearish", -1.0, None, 0.0)
