"""Incremental market ingest driven by newly landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.ingest import ingest_market
from tidemark.sources.files import parse_market, raw_market_records


def market_stream(
    spark: SparkSession, landing: str, markets: DataFrame, folder: str, checkpoint: str
) -> StreamingQuery:
    """Run the batch ingest on every micro-batch of new documents until none are left.

    Deduplication is against the stored keys inside ``foreachBatch``, so no unbounded streaming
    state is kept and late documents are ordinary appends. A micro-batch is committed once under
    its number: a replayed one is known by it and appends nothing.
    """
    documents = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .load(landing)
        .select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("body"))
    )

    def handle(batch: DataFrame, number: int) -> None:
        parsed = parse_market(raw_market_records(batch))
        ingest_market(spark, parsed, markets, folder, writer=f"stream:{checkpoint}", number=number)

    return (
        documents.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
