"""Running sums over sorted rows of any number.

Rows are dealt by range, so that a part of any size spreads over many tasks; each task sums its own
rows in one stream. Only the first part of a task can have begun in an earlier one, so one offset a
task makes the sums whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import staged


def _sums(batches: Iterator[pa.RecordBatch], values: list[str]) -> Iterator[pa.RecordBatch]:
    carried, last = dict.fromkeys(values, 0), None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("sum_part").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        runs = np.diff(np.append(starts, len(part)))
        for name in values:
            x = batch.column(name).to_numpy()
            before = np.cumsum(x) - x
            base = before[starts]
            if part[0] == last:
                base[0] -= carried[name]
            before -= np.repeat(base, runs)
            carried[name] = before[-1] + x[-1]
            batch = batch.append_column(f"before_{name}", pa.array(before))
        last = part[-1]
        yield batch


def running_sums(rows: DataFrame, part: Column, order: list[Column], values: list[str]) -> DataFrame:
    """``rows`` with ``before_<value>``: the sum of the value over the earlier rows of the same part.

    ``part`` is a whole number, never null; ``values`` are longs or doubles without nulls (doubles
    that are whole numbers sum exactly). Rows that tie in ``order`` come in any order. An empty
    table gives an empty one. The sorted rows are written once; besides them, one row for each task
    and part moves.
    """
    names = rows.columns
    keyed = rows.select("*", part.cast("long").alias("sum_part"), *(c.alias(f"order_{k}") for k, c in enumerate(order)))
    by = ["sum_part", *(f"order_{k}" for k in range(len(order)))]
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = dealt.select(*names, "sum_part", F.spark_partition_id().alias("sum_task"))
    schema = T.StructType([*dealt.schema, *(T.StructField(f"before_{v}", rows.schema[v].dataType) for v in values)])
    summed = staged(dealt.mapInArrow(lambda batches: _sums(batches, values), schema), "running")
    totals = summed.groupBy("sum_part", "sum_task").agg(*(F.sum(v).alias(v) for v in values))
    earlier = Window.partitionBy("sum_part").orderBy("sum_task")
    offsets = totals.select(
        "sum_part", "sum_task", F.row_number().over(earlier).alias("nth"),
        *(F.sum(v).over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias(f"offset_{v}") for v in values),
    ).where("nth > 1")
    # At most one row a task: what the first part of the task has in earlier tasks.
    whole = summed.join(F.broadcast(offsets), ["sum_part", "sum_task"], "left")
    return whole.select(
        *names,
        *((F.col(f"before_{v}") + F.coalesce(F.col(f"offset_{v}"), F.lit(0))).alias(f"before_{v}") for v in values),
    )
