"""Rows that need not move stay, and rows written once are made once."""

from pyspark.sql import functions as F

from tidemark.adapters import Landed
from tidemark.operators import mapping as M
from tidemark.session import written_once

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_meet_places_and_markets_without_a_shuffle(spark):
    at = Landed(spark, FOLDER)
    raw = at.raw_records()
    assert "hashpartitioning" not in plan(raw)
    assert raw.count() == at.read("lineitem").count()
    mapped = M.map_records(M.parse_records(raw), at.market_places())
    assert "hashpartitioning" not in plan(mapped) and mapped.count() > 0


def test_rows_written_once_equal_the_rows(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    rows = spark.range(20).select("id", F.udf(seen, "bigint")("id").alias("k"), F.lit(None).cast("decimal(18,4)").alias("d"))
    kept = written_once(rows)
    assert kept.schema.simpleString() == rows.schema.simpleString()
    assert kept.where("k >= 10").count() + kept.where("k < 10").count() == 20 and made.value == 20
