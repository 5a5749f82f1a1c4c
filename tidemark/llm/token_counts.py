"""Token counts of documents in flat token files that have no index.

A token file is nothing but ids, two bytes each, with an end id behind every document. Blocks of
the files are scanned on their own: one vectorised search finds the end ids of a block, and all
documents that begin and end in the block are counted there. A prefix scan over one row per block
then gives each block the number of documents before it and the tokens of the document that runs
into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import store, tokens
from tidemark.llm.common import new_folder, staged

WIDTH = 2
BLOCK_TOKENS = 1 << 21
SUFFIX = ".tokens"


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    name = f"part-{TaskContext.get().partitionId():06d}{SUFFIX}"
    held, place = [], 0
    batch = next(batches, None)
    if batch is None:
        return
    with store.whole_file(folder, name) as out:
        while batch is not None:
            for text in batch.column("text"):
                ids = np.append(tokens.encode_array(text.as_py(), path), np.uint32(tokens.END_OF_TEXT))
                out.write(ids.astype("<u2").tobytes())
            n = batch.num_rows
            held.append(pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([name] * n), pa.array(range(place, place + n), pa.int64())],
                names=["doc_id", "file", "ordinal"],
            ))
            place += n
            batch = next(batches, None)
    # Only once the file is in place: what a failed task named is not seen.
    yield from held


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Token files of ``docs`` in ``folder``; which document is which in them (``file``, ``ordinal``).

    The result is written beside the files, so it always speaks of the files that are there.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = rows.mapInArrow(
        lambda batches: _write(batches, folder, vocabulary), "doc_id bigint, file string, ordinal bigint"
    )
    return staged(named, "token-manifest")


def _scan(batches: Iterator[pa.RecordBatch], folder: str, block: int, end: int) -> Iterator[pa.RecordBatch]:
    files, base = store.open_store(folder)
    for batch in batches:
        for row in batch.to_pylist():
            start = row["block"] * block
            size = min(block, row["n"] - start)
            with files.open_input_file(f"{base}/{row['file']}") as source:
                ids = np.frombuffer(source.read_at(size * WIDTH, start * WIDTH), dtype="<u2")
            ends = np.flatnonzero(ids == end).astype("int64")
            # One row for each end, and one for what lies behind the last.
            lengths = np.diff(np.concatenate([[-1], ends, [size]])) - 1
            k = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["file"]] * k), pa.array([row["block"]] * k, pa.int64()),
                    pa.array(range(k), pa.int64()), pa.array(lengths), pa.array([k - 1] * k, pa.int64()),
                ],
                names=["file", "block", "k", "length", "ends"],
            )


def scan_token_files(
    spark: SparkSession, folder: str, block: int = BLOCK_TOKENS, end: int = tokens.END_OF_TEXT
) -> DataFrame:
    """``file``, ``ordinal``, ``n_tokens`` of every document in the token files of ``folder``.

    Lengths leave out the end id. Ids behind the last end id of a file are no document. Blocks may
    be of any size; documents may span many. The windows hold one row per block of a file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)
    sizes = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("length") / WIDTH).cast("long").alias("n"))
    blocks = sizes.where("n > 0").select(
        "file", "n", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("n") - 1) / block).cast("long"))).alias("block")
    )
    dealt = blocks.repartition(F.col("file"), F.col("block"))
    parts = staged(
        dealt.mapInArrow(
            lambda batches: _scan(batches, folder, block, end),
            "file string, block bigint, k bigint, length bigint, ends bigint",
        ),
        "token-blocks",
    )
    # One row per block: documents that end in it, and the ids behind its last end.
    behind = parts.where("k = ends").select("file", "block", "ends", F.col("length").alias("tail"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("tail").over(Window.partitionBy("file").orderBy("block"))
    summed = behind.withColumn("tails", total)
    # Tails run on until a block with an end: those since the last such block are carried over.
    reset = F.max(F.when(F.col("ends") > 0, F.col("tails") - F.col("tail"))).over(before)
    carried = summed.select(
        "file", "block",
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("ends_before"),
        (F.coalesce(F.max("tails").over(before), F.lit(0)) - F.coalesce(reset, F.lit(0))).alias("carry"),
    )
    rows = parts.where("k < ends").join(carried, ["file", "block"])
    counted = rows.select(
        "file", (F.col("ends_before") + F.col("k")).alias("ordinal"),
        (F.col("length") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"),
    )
    return counted


def count_tokens(docs: DataFrame, vocabulary: str | None = None, block: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id``, ``file``, ``ordinal``, ``n_tokens`` of every row, counted in its token file.

    A null or empty text has no tokens; repeated rows and null ids each keep a row; an empty table
    gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    manifest = write_token_files(docs, folder, vocabulary)
    if manifest.isEmpty():
        return manifest.withColumn("n_tokens", F.lit(0).cast("long"))
    return manifest.join(scan_token_files(spark, folder, block), ["file", "ordinal"]).select(
        "doc_id", "file", "ordinal", "n_tokens"
    )
