"""Conversation structure repair: the cheapest edits that give roles the order ``(s?(ua)+)?``.

Rows are dealt by conversation and sorted by turn; a task streams over them and carries only the
state of the dynamic program from batch to batch. The program runs backwards over narrow rows
without text, and leaves two bytes a row: for each state of the role grammar, which edits are best.
These backpointers go through Spark's shuffle, which spills them, and meet the texts in a second
stream that runs forwards and applies them. So a conversation of any length needs constant memory.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1

# States of the grammar: nothing yet, after s, after u, after a. What may come next, and leads where.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The one role that an inserted or re-roled row can take in a state.
TURN = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}
#: Inserts that end a conversation in each state: START and ASSISTANT may end as they are.
ENDING = ("", "II", "I", "")

MARKS = "conv_id bigint, turn bigint, role string, digest binary, fault string, moves int"
REPAIRED = (
    "conv_id bigint, place bigint, turn bigint, edit string, fault string, old_role string, role string, text string"
)
REPORT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)
WHITE = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
LONGEST = (1 << 63) - 1


def best_moves(after: list[int], initial: str, fault: str | None) -> tuple[list[int], list[str]]:
    """Cost and edits of each state in front of a row, given the costs ``after`` it.

    The edits are inserts and what becomes of the row; of equally cheap ones the least by ASCII.
    """
    extra = TRUNCATED if fault == "truncated" else 0
    best: list[tuple[int, str]] = []
    for state in range(4):
        ways = [(DELETE + after[state], "D")]
        if fault not in ("blank", "duplicate"):
            if initial in STEP[state]:
                ways.append((KEEP + extra + after[STEP[state][initial]], "K"))
            ways.append((REROLE + extra + after[STEP[state][TURN[state]]], "R"))
        best.append(min(ways))
    for _ in range(2):  # a third insert in a row only repeats a state
        best = [
            min(best[state], (INSERT + best[to][0], "I" + best[to][1]))
            for state, to in ((k, STEP[k][TURN[k]]) for k in range(4))
        ]
    return [b[0] for b in best], [b[1] for b in best]


CODES = [k * "I" + x for x in "DKR" for k in range(3)]
ENDINGS = [INSERT * len(e) for e in ENDING]


class _Planner:
    """The backward program; equal situations are worked out once."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple[tuple[int, ...], int]] = {}
        self.begin()

    def begin(self) -> None:
        self.costs = tuple(ENDINGS)

    def row(self, initial: str, fault: str | None) -> int:
        """The row's edits in each state, four bits a state; moves on to in front of the row."""
        key = self.costs, initial, fault
        if key not in self.known:
            costs, edits = best_moves(list(self.costs), initial, fault)
            low = min(costs)  # only differences matter, so there are few situations
            self.known[key] = tuple(c - low for c in costs), sum(CODES.index(e) << 4 * k for k, e in enumerate(edits))
        self.costs, moves = self.known[key]
        return moves


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    planner, conv, begun = _Planner(), None, False
    for batch in batches:
        moves = []
        for c, initial, fault in zip(
            batch.column("conv_id").to_pylist(), batch.column("initial").to_pylist(), batch.column("fault").to_pylist(),
            strict=True,
        ):
            if not begun or c != conv:
                planner.begin()
                conv, begun = c, True
            moves.append(planner.row(initial if initial in ("s", "u", "a") else "", fault))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "turn", "role", "digest", "fault")), pa.array(moves, pa.int32())],
            names=[c.split()[0] for c in MARKS.split(", ")],
        )


class _Applier:
    """The forward stream: edits of the marks, applied to the rows that follow them."""

    def __init__(self) -> None:
        self.out: list[tuple] = []
        self.conv, self.open = None, False

    def begin(self, conv: int | None) -> None:
        if self.open:
            self.end()
        self.conv, self.open, self.state, self.place = conv, True, START, 0

    def put(self, turn, edit, fault, old_role, role, text) -> None:
        self.out.append((self.conv, self.place, turn, edit, fault, old_role, role, text))
        self.place += 1

    def insert(self) -> None:
        letter = TURN[self.state]
        self.put(None, "I", None, None, ROLE[letter], "")
        self.state = STEP[self.state][letter]

    def end(self) -> None:
        for _ in ENDING[self.state]:
            self.insert()
        self.open = False

    def mark(self, moves: int, fault: str | None) -> None:
        self.moves, self.fault = moves, fault

    def row(self, turn, role: str, text: str) -> None:
        """The first row behind a mark has its edits; further ones are its copies, and go."""
        if self.moves is None:
            self.put(turn, "D", "blank" if self.fault == "blank" else "duplicate", role, None, None)
            return
        edits, self.moves = CODES[self.moves >> 4 * self.state & 15], None
        for _ in edits[:-1]:
            self.insert()
        if edits[-1] == "D":
            self.put(turn, "D", self.fault, role, None, None)
            return
        letter = role[:1] if edits[-1] == "K" else TURN[self.state]
        self.put(turn, edits[-1], self.fault, role, role if edits[-1] == "K" else ROLE[letter], text)
        self.state = STEP[self.state][letter]

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5)
        columns = list(zip(*self.out, strict=True)) or [()] * 8
        self.out = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=[c.split()[0] for c in REPAIRED.split(", ")],
        )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = _Applier()
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "moves", "fault", "turn", "role", "text"))
        for conv, moves, fault, turn, role, text in zip(*columns, strict=True):
            if not made.open or conv != made.conv:
                made.begin(conv)
            if moves is not None:
                made.mark(moves, fault)
            else:
                made.row(turn, role, text)
        yield made.batch()
    if made.open:
        made.end()
        yield made.batch()


def repair(talks: DataFrame) -> DataFrame:
    """The repaired conversations, row by row, with every edit.

    ``talks``: conv_id, turn, role, text. A conversation's rows come in the order of turn (nulls
    first), then role, then a hash of the text. The first fault of a row counts: ``blank`` (no
    character but white space), ``duplicate`` (role and text as in an earlier row), ``truncated``
    (the last such character is none of ``.!?``). Edits: K keeps a row, R gives it the role user or
    assistant (2), D deletes it (3; blank and duplicate rows must go), I inserts an empty turn of
    user or assistant (2); a truncated row that stays adds 1. The cheapest edits after which the
    roles' initials read ``(s?(ua)+)?`` are made, of equally cheap ones those with the least string.

    Rows: conv_id, place (from 0), turn and old_role (null for inserts), edit, fault, and the new
    role and text (null for deleted rows). The rows of a conversation lie in one partition, in
    order, so further streams need no sort. Null role or text count as one space, so such a row is
    blank or has a role that no conversation may keep; null conv_ids are one conversation. Repeated
    rows are duplicates. Texts are hashed and moved whole; an empty table gives no row; other
    columns are not read.
    """
    blank = F.lit(" ")
    rows = talks.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    key = ["conv_id", "role", "digest"]
    # One narrow row for equal rows of a turn: copies meet in the map tasks already.
    marks = staged(rows.groupBy(*key, "turn").agg(F.first(fault).alias("fault")), "marks")
    first = marks.groupBy(*key).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn")).alias("first"), F.count("*").alias("met")
    ).where("met > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    again = (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    judged = marks.join(first, again, "left").select(
        "conv_id", "turn", "role", "digest",
        F.when(F.col("fault") == "blank", "blank").when(later, "duplicate").otherwise(F.col("fault")).alias("fault"),
    )
    judged = staged(judged, "faults")
    down = [F.col("conv_id"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("digest")]
    dealt = judged.withColumn("initial", F.left("role", F.lit(1))).repartition("conv_id").sortWithinPartitions(*down)
    moves = dealt.mapInArrow(_plan, MARKS)
    both = moves.withColumn("text", F.lit(None).cast("string")).unionByName(
        rows.withColumn("moves", F.lit(None).cast("int")).withColumn("fault", F.lit(None).cast("string"))
    )
    up = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest"), F.col("moves").isNull()]
    return both.repartition("conv_id").sortWithinPartitions(*up).mapInArrow(_apply, REPAIRED)


class _Reporter:
    """Sums up the rows of one conversation after the other."""

    def __init__(self) -> None:
        self.out: list[tuple] = []
        self.conv, self.open = None, False

    def begin(self, conv: int | None) -> None:
        if self.open:
            self.end()
        self.conv, self.open = conv, True
        self.low = self.high = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.faults: Counter = Counter()
        self.audit, self.hash, self.empty = bytearray(), hashlib.sha256(), True

    def row(self, turn: int | None, edit: str, fault: str | None, old_role: str | None, role: str | None, text: str | None) -> None:
        self.audit += edit.encode()
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "I":
            self.faults[fault] += 1
            if self.before is not None and self.before + old_role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = old_role[:1]
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high = turn
                self.turns += 1
        if edit != "D":
            self.cost += TRUNCATED if fault == "truncated" else 0
            self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
            self.empty = False

    def end(self) -> None:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, LONGEST)
        counts = (self.faults[f] for f in FAULTS)
        self.out.append((self.conv, gaps, *counts, self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest()))
        self.open = False

    def batch(self) -> pa.RecordBatch:
        kinds = (*[pa.int64()] * 7, pa.string(), pa.string())
        columns = list(zip(*self.out, strict=True)) or [()] * len(kinds)
        self.out = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=[c.split()[0] for c in REPORT.split(", ")],
        )


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = _Reporter()
    for batch in batches:
        columns = ("conv_id", "turn", "edit", "fault", "old_role", "role", "text")
        for conv, *row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if not made.open or conv != made.conv:
                made.begin(conv)
            made.row(*row)
        yield made.batch()
    if made.open:
        made.end()
        yield made.batch()


def report(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s rows, as they come: no shuffle, no buffer.

    gaps: turn numbers missing between the least and the greatest; counts of first faults; illegal:
    neighbouring rows whose initials are not su, ua or au; cost; audit: the edits in order;
    repaired_sha256: digest of the repaired ``role:text`` lines. All but cost, audit and digest
    describe the rows before repair. Gaps stop at the greatest long.
    """
    return repaired.mapInArrow(_report, REPORT)


def whole_reports(reports: DataFrame, conversations: DataFrame) -> DataFrame:
    """``reports`` and, for the conversations without a row in them, zeros and the empty digest."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    zero = {c.split()[0]: F.lit(0).cast("long") for c in REPORT.split(", ") if "bigint" in c}
    zero |= {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    rows = ids.join(reports, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return rows.select(
        F.col("id").alias("conv_id"), *(F.coalesce(c, default).alias(c) for c, default in zero.items() if c != "conv_id")
    )


def damaged(talks: DataFrame) -> DataFrame:
    """``conversations`` with faults planted by crc32 of ``conv_id:turn`` modulo 20; nulls read as one space.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    blank = F.lit(" ")
    place = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    kind, role, text = F.col("kind"), F.coalesce("role", blank), F.coalesce("text", blank)
    return talks.withColumn("kind", F.pmod(F.crc32(place), F.lit(20))).where("kind <> 0").select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
