"""Inverse document frequencies of hashed features over a whole corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash slots of the document frequencies; the table of weights has this many numbers at any size.
SLOTS = 1 << 18


def slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(40)).astype(np.int64) % SLOTS


def _count(batches: Iterator[pa.RecordBatch], keys: Callable) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(SLOTS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            found = keys(text.as_py())
            if len(found):
                total[np.unique(slots(found))] += 1
                docs += 1
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1, *held.tolist()], pa.int64()), pa.array([docs, *total[held].tolist()], pa.int64())],
        names=["slot", "n"],
    )


def inverse_frequencies(docs: DataFrame, keys: Callable[[str | None], np.ndarray]) -> tuple[np.ndarray, float]:
    """Of each slot log((1 + documents) / (1 + documents with a key in it)), and that of no document.

    ``keys`` gives the 64-bit hashes of a text. All documents count. Each task sums its own slots
    first, and the result has ``SLOTS`` numbers however many documents there are.
    """
    counted = docs.select("text").mapInArrow(lambda batches: _count(batches, keys), "slot bigint, n bigint")
    rows = counted.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    total = rows.loc[rows["slot"] == -1, "n"].sum()
    held = np.zeros(SLOTS)
    real = rows[rows["slot"] >= 0]
    held[real["slot"].to_numpy()] = real["n"].to_numpy()
    return np.log((1 + total) / (1 + held)), float(np.log(1 + total))
