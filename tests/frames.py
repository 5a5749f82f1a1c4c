"""Small observation frames with known results."""

import datetime as dt

END = dt.date(2026, 2, 15)
PRICE = ("series_id string, market_id string, as_of_date date, price_type string, value double, "
         "validation_status string, observation_id string, observed_at timestamp")
ARRIVAL = ("series_id string, market_id string, as_of_date date, volume double, "
           "validation_status string, observation_id string, observed_at timestamp")
WEATHER = ("series_id string, region_id string, as_of_date date, rainfall_mm double, "
           "temperature_mean_c double, relative_humidity_pct double, validation_status string, "
           "observation_id string, observed_at timestamp")
FUTURES = ("series_id string, contract_symbol string, as_of_date date, expiry_date date, "
           "settle_price double, open_interest long, validation_status string, "
           "observed_at timestamp")


def days(n, end=END):
    return [end - dt.timedelta(days=n - 1 - i) for i in range(n)]


def noon(day):
    return dt.datetime(day.year, day.month, day.day, 12)


def rising_prices(spark, n=30, start=6800.0, step=20.0, markets=("m1", "m2"), extra=()):
    rows = [
        ("s", m, d, "modal", start + step * i, "validated", f"p{m}{d}", noon(d))
        for i, d in enumerate(days(n)) for m in markets
    ]
    return spark.createDataFrame(rows + list(extra), PRICE)


def flat_arrivals(spark, n=30, markets=("m1", "m2")):
    rows = [("s", m, d, 100.0, "validated", f"a{m}{d}", noon(d)) for d in days(n) for m in markets]
    return spark.createDataFrame(rows, ARRIVAL)


def expected(spark, markets=("m1", "m2")):
    return spark.createDataFrame([(m,) for m in markets], "market_id string")


def curve(spark, n=20):
    rows = []
    for i, d in enumerate(days(n)):
        for symbol, gap, price in (("A", 30, 1345.5), ("B", 60, 1310.25), ("C", 90, 1300.0)):
            expiry = END + dt.timedelta(days=gap)
            rows.append(("s", symbol, d, expiry, price * 5, 30 + i, "validated", noon(d)))
    return spark.createDataFrame(rows, FUTURES)


def weather(spark, rain, temps=None, n=60, end=END):
    rows = []
    for i, d in enumerate(days(n, end)):
        t = temps[i] if temps else 28.0
        rows.append(("belt", "r1", d, rain[i], t, 50.0, "validated", f"w{d}", noon(d)))
    return spark.createDataFrame(rows, WEATHER)
