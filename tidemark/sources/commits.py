"""Several fact tables appended as one: a batch becomes visible with its commit, or not at all.

A batch writes each table's rows, by month, to a folder of its own that no reader knows. Its commit
creates the next file of the log ``_log``, in one step that fails if the file is there. Each log
file is the whole state in one JSON document: the batch folders of every table, the last batch of
every writer with its result, the finished days of every ledger, and small notes. Readers take the
newest file, so they see whole batches only; a batch that broke off leaves a folder nobody reads.

Between reading the state and the commit nobody else may have committed, or ``Conflict`` is raised
and the batch starts over: what it took for new may be stored by now.
"""

from __future__ import annotations

import copy
import datetime as dt
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.dedupe import latest_per_key
from tidemark.sources.tables import MONTH, _path, append_facts

ONE_DAY = dt.timedelta(days=1)


class Conflict(RuntimeError):
    """Another batch was committed since this one read the state."""


@dataclass
class State:
    """What the newest log file says; version 0 is an empty store."""

    version: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    writers: dict[str, dict] = field(default_factory=dict)
    days: dict[str, list[list[str]]] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)


def state(spark: SparkSession, folder: str) -> State:
    files, at = _path(spark, f"{folder}/_log")
    if not files.exists(at):
        return State()
    names = [s.getPath().getName() for s in files.listStatus(at)]
    versions = sorted(n for n in names if n.endswith(".json"))
    if not versions:
        return State()
    text = spark.read.text(f"{folder}/_log/{versions[-1]}", wholetext=True).first()[0]
    return State(**json.loads(text))


def read(spark: SparkSession, folder: str, table: str, schema: str, of: State | None = None) -> DataFrame:
    """Committed rows of a table with their month; an empty frame if there are none."""
    found = state(spark, folder) if of is None else of
    return _read(spark, f"{folder}/{table}", found.tables.get(table, []), schema)


def _read(spark: SparkSession, path: str, batches: list[str], schema: str) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], f"{schema}, {MONTH} string")
    reader = spark.read.schema(f"{schema}, batch string, {MONTH} string").option("basePath", path)
    return reader.parquet(*(f"{path}/{b}" for b in batches)).drop("batch")


def current(rows: DataFrame, keys: list[str], order: str = "written") -> DataFrame:
    """Of rows that were appended again and again the last of each key by its batch's version."""
    return latest_per_key(rows.drop(MONTH), keys, [order])


class Batch:
    """Rows of one batch, invisible until ``commit``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.base = state(spark, folder)
        self.version = self.base.version + 1
        self.name = f"batch={self.version:09d}-{uuid.uuid4().hex}"
        self.written: list[str] = []

    def result_of(self, writer: str, number: int) -> dict | None:
        """What a batch of this writer returned, if it or a later one is committed already."""
        known = self.base.writers.get(writer)
        return dict(known["result"]) if known and known["number"] >= number else None

    def append(self, table: str, rows: DataFrame, day: str = "as_of_date") -> None:
        append_facts(rows, f"{self.folder}/{table}/{self.name}", day)
        self.written.append(table)

    def own(self, table: str, schema: str) -> DataFrame:
        """The rows that this batch wrote."""
        own = [self.name] if table in self.written else []
        return _read(self.spark, f"{self.folder}/{table}", own, schema)

    def stored(self, table: str, schema: str) -> DataFrame:
        """Rows committed before this batch."""
        return read(self.spark, self.folder, table, schema, self.base)

    def both(self, table: str, schema: str) -> DataFrame:
        every = [*self.base.tables.get(table, []), *([self.name] if table in self.written else [])]
        return _read(self.spark, f"{self.folder}/{table}", every, schema)

    def commit(
        self, writer: str | None = None, number: int = 0, result: dict | None = None,
        finished: tuple[str, dt.date, dt.date] | None = None, notes: dict[str, str] | None = None,
        replaces: tuple[str, ...] = (),
    ) -> State:
        """Make the batch visible; ``replaces`` names tables of which only this batch's rows stay."""
        new = copy.deepcopy(self.base)
        new.version = self.version
        for table in self.written:
            new.tables[table] = [*([] if table in replaces else new.tables.get(table, [])), self.name]
        if writer is not None:
            new.writers[writer] = {"number": number, "result": result or {}}
        if finished is not None:
            ledger, first, last = finished
            new.days[ledger] = merged(new.days.get(ledger, []), first, last)
        new.notes |= notes or {}
        _create(self.spark, f"{self.folder}/_log", f"{self.version:09d}.json", json.dumps(vars(new), default=str))
        return new


def compact(spark: SparkSession, folder: str, table: str, schema: str, keys: list[str] | None = None) -> None:
    """Rewrite a table's many batches as one; with ``keys`` only the current row of each key."""
    batch = Batch(spark, folder)
    rows = batch.stored(table, schema)
    batch.append(table, current(rows, keys) if keys else rows.drop(MONTH))
    batch.commit(replaces=(table,))


def merged(spans: list[list[str]], first: dt.date, last: dt.date) -> list[list[str]]:
    """Spans of days with one more, joined where they touch."""
    out: list[list[dt.date]] = []
    every = [[dt.date.fromisoformat(d) for d in s] for s in spans]
    for a, b in sorted([*every, [first, last]]):
        if out and a <= out[-1][1] + ONE_DAY:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [[a.isoformat(), b.isoformat()] for a, b in out]


def unfinished(spans: list[list[str]], first: dt.date, last: dt.date, most: int) -> list[tuple[dt.date, dt.date]]:
    """Windows of at most ``most`` days over the days of a range that no span covers."""
    gaps, at = [], first
    for a, b in ([dt.date.fromisoformat(d) for d in s] for s in spans):
        if at < a:
            gaps.append((at, min(a - ONE_DAY, last)))
        at = max(at, b + ONE_DAY)
        if at > last:
            break
    if at <= last:
        gaps.append((at, last))
    out = []
    for a, b in gaps:
        while a <= b:
            end = min(b, a + dt.timedelta(days=most - 1))
            out.append((a, end))
            a = end + ONE_DAY
    return out


def _create(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Create a file with all of its text; ``Conflict`` if it is there."""
    files, at = _path(spark, f"{folder}/{name}")
    _, part = _path(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    out = files.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(files.makeQualified(at).toUri(), spark._jsc.hadoopConfiguration())
    # Without an option a rename never replaces a file.
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(part), files.makeQualified(at), options)
    except Exception as error:
        files.delete(part, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"{name} was committed meanwhile") from error
        raise

