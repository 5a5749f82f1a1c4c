"""Values are parsed once a row, whatever is filtered behind the parse."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import mapping as M
from tidemark.sources import files


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


FUTURES = "trade_date string, symbol string, series string, expiry string, settle string, open_interest string, volume string"


def test_futures_dates_are_parsed_once(spark):
    rows = [("05-01-2024", "kapas", "FUT", "2024/2/5", "1,500.5", "-", None), ("30/02/2024", "KAPAS", "", "2024-02-05", "1", "x", "2"),
            (None, "KAPAS", None, "5/2/2024", "7", "12", "-")]
    good = M.parse_futures(spark.createDataFrame(rows, FUTURES), F.lit(dt.date(2024, 1, 9))).filter("reject_reason IS NULL")
    # Four formats of two dates.
    assert plan(good).count("gettimestamp") == 8
    got = sorted((r.as_of_date, r.expiry_date, float(r.settle_price), r.open_interest) for r in good.collect())
    assert got == [(dt.date(2024, 1, 5), dt.date(2024, 2, 5), 1500.5, None), (dt.date(2024, 1, 9), dt.date(2024, 2, 5), 7.0, 12)]


def test_date_shapes_lose_no_date(spark):
    texts = ["2024-01-05", "2024-1-5", "05-01-2024", "5/1/2024", "2024/01/05", "0005-0001-02024", "31-12-24", "1-2-3", "12-13-2024",
             "2024-13-01", "2024-02-30", "30/02/2024", "2024/5", "a-b-c", "", " 2024-01-05 ", "-5-1-1", "2024-01-05x", "2024-1-005", "99/1/1", "1/1/-5", "1-1--5"]
    formats = ("y-M-d", "d-M-y", "d/M/y", "y/M/d")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", dates.any_format_date(F.col("t")).cast("string").alias("got"),
        F.coalesce(*[F.try_to_date(F.trim("t"), f) for f in formats]).cast("string").alias("want"),
    )
    assert [(r.t, r.got) for r in df.collect()] == [(r.t, r.want) for r in df.collect()]


def test_market_documents_are_parsed_once(spark):
    bodies = [('{"records": [{"state": "S", "district": "D", "market": "M", "commodity": "Cotton", "arrival_date": "5/1/2024"}, 7]}',),
              ('{"records": []}',), ('{"records": 3}',), ("{}",)]
    envelopes = spark.createDataFrame([("f", b) for (b,) in bodies], "source_file string, body string")
    parsed = files.parse_market(files.raw_market_records(envelopes))
    reasons = parsed.select(F.coalesce("reject_reason", F.lit("good")).alias("r"))
    text = plan(parsed.filter("reject_reason IS NULL").groupBy("as_of_date", "state").count())
    assert (text.count("get_json_object"), text.count("gettimestamp")) == (1, 1)
    assert sorted(r.r for r in reasons.collect()) == [
        "document without records", "expected object", "good", "no records", "records are not a list"]
