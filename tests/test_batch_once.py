"""A batch that a filter and a join read is made once."""

from pyspark.sql import functions as F

from tidemark.operators import dedupe as D


def test_a_filtered_batch_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    rows = spark.range(50).select(F.udf(seen, "bigint")("id").alias("k"), F.lit("v").alias("value"))
    stored = spark.range(40, 60).select(F.col("id").alias("k"))
    left = D.without_stored(rows, stored, ["k"], 1 << 12)
    assert sorted(r.k for r in left.collect()) == list(range(40))
    assert made.value == 50
