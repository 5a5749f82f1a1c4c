"""Backtest folds: rolling origin and walk-forward with a label embargo."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators.basket import DAY, SERIES

GROUP = [SERIES, "horizon_days"]


def rolling_origin(
    sizes: DataFrame,
    min_train: int = fixed.MIN_TRAIN_ROWS,
    test_size: int = fixed.TEST_ROWS,
    step: int | None = None,
    count: str = "n_rows",
) -> DataFrame:
    """Fold bounds per group: train rows [0, train_end), test rows [train_end, test_end).

    A group too short for a full fold gets one fold that tests on its tail; below two rows none.
    """
    stride = step or test_size
    n = F.col(count).cast("int")
    ends = F.sequence(F.lit(min_train), n - test_size, F.lit(stride))
    short = F.least(F.lit(min_train), n - 1)
    bounds = F.when(n < 2, F.array().cast("array<int>")).when(
        n < min_train + test_size, F.array(short)
    ).otherwise(ends)
    keep = [c for c in sizes.columns]
    folds = sizes.select(*keep, F.posexplode(bounds).alias("fold_index", "train_end"))
    return folds.withColumn("test_end", F.least(n, F.col("train_end") + test_size)).withColumn(
        "test_end", F.when(n < min_train + test_size, n).otherwise(F.col("test_end"))
    )


def numbered(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Row position by day inside each (series, horizon): bounded by calendar days."""
    keys = keys or GROUP
    order = Window.partitionBy(*keys).orderBy(DAY)
    return rows.withColumn("row_index", F.row_number().over(order) - 1)


@dataclass(frozen=True)
class WalkForward:
    """Walk-forward settings; ``train_window`` set means a sliding window of that many rows."""

    min_train: int = fixed.WALK_FORWARD_MIN_TRAIN
    step_rows: int = 1
    step_days: int | None = None
    train_window: int | None = None

    def __post_init__(self) -> None:
        for name in ("min_train", "step_rows", "step_days", "train_window"):
            value = getattr(self, name)
            if value is not None and value < 1:
                raise ValueError(f"{name} must be >= 1, got {value}")


def walk_forward(rows: DataFrame, spec: WalkForward = WalkForward()) -> DataFrame:
    """Fold bounds per test day: (fold_index, train rows [train_start, train_end), test row).

    A row may train for a test day only when its label is realised before it
    (day + horizon < test day). Membership follows from the bounds by row position, so the
    quadratic train sets are not written out; see :func:`members` and :func:`fold_totals`.
    """
    indexed = numbered(rows)
    at = F.unix_date(DAY)
    # Horizon varies by group, so the embargo is a search in the group's ordered days.
    eligible = _eligible_counts(indexed, at)
    window = spec.train_window
    train_rows = F.least("_eligible", F.lit(window)) if window else F.col("_eligible")
    ready = eligible.withColumn("train_rows", train_rows).filter(
        F.col("train_rows") >= spec.min_train
    )
    chosen = _stepped(ready, spec)
    order = Window.partitionBy(*GROUP).orderBy(DAY)
    return chosen.select(
        *GROUP,
        (F.row_number().over(order) - 1).alias("fold_index"),
        F.col(DAY).alias("test_date"),
        F.col("row_index").alias("test_index"),
        (F.col("_eligible") - F.col("train_rows")).alias("train_start"),
        F.col("_eligible").alias("train_end"),
        "train_rows",
    )


def _eligible_counts(indexed: DataFrame, at: Column) -> DataFrame:
    """Rows whose label day lies before each row's day, by one ordered pass.

    Label days and test days are merged on one timeline; the running count of labels before a
    test day is the answer. Both are ordered by the same rows, so the first k rows are the ones.
    """
    labels = indexed.select(
        *GROUP,
        (at + F.col("horizon_days")).alias("_at"),
        F.lit(1).alias("_kind"),
        F.lit(1).alias("_label"),
        F.lit(None).cast("date").alias(DAY),
        F.lit(None).cast("int").alias("row_index"),
    )
    tests = indexed.select(
        *GROUP,
        at.alias("_at"),
        F.lit(0).alias("_kind"),
        F.lit(0).alias("_label"),
        DAY,
        F.col("row_index").cast("int").alias("row_index"),
    )
    # Tests sort before labels of the same day: a label realised on the test day does not count.
    timeline = (
        Window.partitionBy(*GROUP)
        .orderBy("_at", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        labels.unionByName(tests)
        .withColumn("_eligible", F.sum("_label").over(timeline))
        .filter(F.col("_kind") == 0)
        .select(*GROUP, DAY, "row_index", "_eligible")
    )


def _stepped(ready: DataFrame, spec: WalkForward) -> DataFrame:
    """Rows kept by the day step (measured from the last accepted fold) and the row step.

    The steps feed back on accepted folds, so they are folded over the group's ordered days; the
    array holds at most one entry per calendar day of one series.
    """
    if spec.step_days is None and spec.step_rows == 1:
        return ready
    if spec.step_days is None:
        order = Window.partitionBy(*GROUP).orderBy(DAY)
        return (
            ready.withColumn("_seen", F.row_number().over(order))
            .filter(F.col("_seen") % spec.step_rows == 0)
            .drop("_seen")
        )
    days = ready.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.unix_date(DAY))).alias("_days"))
    start = F.struct(
        F.lit(None).cast("int").alias("last"),
        F.lit(0).alias("seen"),
        F.array().cast("array<int>").alias("kept"),
    )

    def accept(state: Column, day: Column) -> Column:
        last, seen, kept = (state.getField(f) for f in ("last", "seen", "kept"))
        open_ = last.isNull() | (day >= last + spec.step_days)
        counted = seen + F.when(open_, 1).otherwise(0)
        take = open_ & (counted % spec.step_rows == 0)
        return F.struct(
            F.when(take, day).otherwise(last).alias("last"),
            counted.alias("seen"),
            F.when(take, F.concat(kept, F.array(day))).otherwise(kept).alias("kept"),
        )

    kept = days.select(
        *GROUP,
        F.explode(F.aggregate("_days", start, accept, lambda s: s.getField("kept"))).alias("_d"),
    ).select(*GROUP, F.date_from_unix_date("_d").alias(DAY))
    return ready.join(kept, [*GROUP, DAY], "left_semi")


#: Positions in one block of the interval join.
SPAN = 64


def fold_spans(folds: DataFrame) -> DataFrame:
    """Every fold as intervals of row positions: (fold_index, role, from_row, to_row), end excluded.

    Takes the bounds of :func:`rolling_origin` and of :func:`walk_forward`.
    """
    has = set(folds.columns)
    first = F.col("train_start") if "train_start" in has else F.lit(0)
    single = "test_index" in has
    test = (F.col("test_index"), F.col("test_index") + 1) if single else (F.col("train_end"), F.col("test_end"))
    span = lambda role, low, high: F.struct(
        F.lit(role).alias("role"), low.cast("long").alias("from_row"), high.cast("long").alias("to_row")
    )
    both = F.array(span("train", first, F.col("train_end")), span("test", *test))
    return folds.select(*GROUP, "fold_index", F.inline(both))


def interval_rows(rows: DataFrame, spans: DataFrame, block: int = SPAN) -> DataFrame:
    """The rows of each interval [from_row, to_row) of positions, with ``row_index``.

    Positions are cut into blocks; an interval asks for the blocks that it touches, and only the
    first and the last of them hold rows that the interval leaves out. The work follows the rows
    that come out, not intervals x rows. An empty interval gives no row.
    """
    asked = spans.filter(F.col("from_row") < F.col("to_row")).withColumn(
        "_block", F.explode(F.expr(f"sequence(from_row div {block}, (to_row - 1) div {block})"))
    )
    placed = numbered(rows).withColumn("_block", F.expr(f"row_index div {block}"))
    at = F.col("row_index")
    return (
        asked.join(placed, [*GROUP, "_block"])
        .filter((at >= F.col("from_row")) & (at < F.col("to_row")))
        .drop("_block", "from_row", "to_row")
    )


def members(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of each fold with their role, written out on request (quadratic for expanding folds)."""
    return interval_rows(rows.select(*GROUP, DAY), fold_spans(folds)).select(
        *GROUP, "fold_index", "role", DAY
    )


def fold_totals(rows: DataFrame, folds: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Rows and sums of ``measures`` of each fold and role, without writing its members.

    One running pass per group sums the measures up to every position; a fold's sum is the
    difference at its two ends, so a fold costs two lookups however many rows it has. NULL adds
    nothing; whole numbers and decimals are exact, sums of doubles are good to rounding. An empty
    interval gives zeros.
    """
    running = Window.partitionBy(*GROUP).orderBy("row_index").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    named = {"n_rows": F.lit(1).cast("long"), **measures}
    valued = numbered(rows).select(
        *GROUP, "row_index", *[F.coalesce(c, F.lit(0)).alias(name) for name, c in named.items()]
    )
    sums = valued.select(
        *GROUP, (F.col("row_index") + 1).cast("long").alias("_at"),
        *[F.sum(name).over(running).alias(name) for name in named],
    )
    end = lambda at, sign: F.struct(F.col(at).alias("_at"), F.lit(sign).alias("_sign"))
    asked = fold_spans(folds).select(
        *GROUP, "fold_index", "role", F.inline(F.array(end("from_row", -1), end("to_row", 1)))
    )
    # No sum stands at position 0: it is zero.
    return asked.join(sums, [*GROUP, "_at"], "left").groupBy(*GROUP, "fold_index", "role").agg(
        *[F.sum(F.coalesce(F.col(name) * F.col("_sign"), F.lit(0))).alias(name) for name in named]
    )


def leaking_rows(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Last train row of each fold whose label is realised on or after the test day.

    Train rows are a prefix in day order, so only the last one can break the embargo.
    """
    indexed = numbered(rows).select(*GROUP, F.col(DAY).alias("train_date"), "row_index")
    last = folds.withColumn("row_index", F.col("train_end") - 1).join(indexed, [*GROUP, "row_index"])
    realised = F.date_add("train_date", F.col("horizon_days").cast("int"))
    return last.filter(realised >= F.col("test_date"))


def duplicate_days(rows: DataFrame) -> DataFrame:
    """(series, horizon, day) keys that occur more than once; folds need this to be empty."""
    return (
        rows.groupBy(*GROUP, DAY)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def require_unique_days(rows: DataFrame) -> None:
    """Raise when any day repeats inside a (series, horizon)."""
    if not duplicate_days(rows).limit(1).isEmpty():
        raise ValueError("duplicate as_of_date in dataset rows")
