"""Reading tables, staging between passes and small column helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for a session on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="tidemark-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_alone(df: DataFrame, label: str) -> DataFrame:
    """As ``staged``; the shuffle files of the job that writes go when it ends, not when the driver
    collects its garbage, so that those of jobs that follow each other never lie on disk together."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return staged(df, label)
    finally:
        conf.set(key, before)


def dropped(df: DataFrame) -> None:
    """Delete the folders of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """All columns as ``doc`` beside the named ones, so that extra names never clash with ours."""
    return df.select(F.struct("*").alias("doc")).select(
        "doc", *(F.col("doc")[c].alias(c) for c in columns)
    )


def fenced(df: DataFrame, keep: list[str], columns: list[Column]) -> DataFrame:
    """``keep`` and computed ``columns``, made once.

    A filter on a computed column would be pushed down and carry the whole computation with it, again
    for each time it is named. The outer generator stops that.
    """
    made = F.explode_outer(F.array(F.struct(*columns))).alias("made")
    return df.select(*keep, made).select(*keep, "made.*")


def words_of(text: Column) -> Column:
    """Words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")

