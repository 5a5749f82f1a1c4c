"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC clocks and adaptive execution.

    Shuffle parallelism is left to the cluster: adaptive execution starts from
    ``initialPartitionNum`` and coalesces by measured size, so the same setting serves a
    laptop and a thousand executors.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a session on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return (folder or tempfile.mkdtemp(prefix="tidemark-ckpt-")).rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def written_once(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Rows written once to a new name in the shared folder, or to ``folder``, and read back.

    Unlike a checkpoint the columns can be read one by one, and Spark knows the size of what it reads:
    a small table is broadcast by that size, where an estimate over joins and groups is far too high.
    """
    path = folder or scratch_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names; survives lost executors.

    ``spark.checkpoint.dir`` is read from the session. A folder of one machine would lose data with
    that machine, so on a cluster the setting must be there; a local session, which is one machine,
    falls back to a temporary folder.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
