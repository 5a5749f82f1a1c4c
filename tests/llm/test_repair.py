import hashlib
import heapq
import random
import re
import zlib

import pytest

from tidemark.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place int, digest string"


def brute(rows):
    """Least (cost, audit) of a conversation by search over whole edit strings; rows: (role, text, fault)."""
    done, heap = {}, [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, roles, made = heapq.heappop(heap)
        if (i, roles) in done:
            continue
        done[i, roles] = True
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, made
        if not re.fullmatch("(s?(ua)*u?)?", roles):
            continue
        short = roles[:1] if roles[:1] == "s" and len(roles) < 2 else roles
        nexts = [(2, "I", i, x, (("user" if x == "u" else "assistant"), "")) for x in "ua"]
        if i < len(rows):
            role, text, fault = rows[i]
            extra = fault == "truncated"
            nexts.append((3, "D", i + 1, "", None))
            if fault not in ("blank", "duplicate"):
                nexts.append((extra, "K", i + 1, role[:1], (role, text)))
                nexts += [(2 + extra, "R", i + 1, x, (("user" if x == "u" else "assistant"), text)) for x in "ua"]
        for price, letter, at, x, row in nexts:
            grown = short + x
            if len(grown) > 2 * len(rows) + 3 or (x == "s" and roles) or (x == "" and letter != "D"):
                continue
            heapq.heappush(heap, (cost + price, audit + letter, at, grown, made + ((row,) if row else ())))
    raise AssertionError


def judge(rows):
    """Contract's columns of one conversation by plain code; rows: (turn, role, text) in order."""
    seen, judged = set(), []
    for _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = None
        if not kept:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif kept[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        judged.append((role, text, fault))
    cost, audit, made = brute(judged)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        gaps, *(sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), int(cost), audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
    )


def test_report_equals_brute_force(spark):
    rng, rows = random.Random(4), []
    for conv in [None, *range(1, 90)]:
        for turn in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "unit", None])
            text = rng.choice(["Hi.", "Yes!", "no", " \n", "", "Go on? \t", "x" * 9, None, "é…", "\x0b.\x0c"])
            rows.append((conv, (turn + rng.choice([0, 0, 3])) if turn else None, role, text, 7, "q"))
    # One row a (conversation, turn): the order within a turn is free otherwise.
    rows = list({(r[0], r[1]): r for r in rows}.values())
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = repair.whole_reports(repair.report(repair.repair(repair.damaged(frame))), frame).collect()
    by = {}
    for conv, turn, role, text, *_ in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = by.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    want = {c: judge(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0))) for c, own in by.items()}
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    assert len(got) == len(want)


def test_repaired_rows(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 1, "user", "Hi!"), (1, 2, "assistant", ""),
        (1, 3, "assistant", "It is"), (1, 4, "assistant", "Done."),
    ]
    got = repair.repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    assert [r.place for r in got] == list(range(len(got)))
    assert "".join(r.edit for r in got) == "KKDDDK"
    assert [(r.role, r.text) for r in got if r.edit != "D"] == [("system", "Be kind."), ("user", "Hi!"), ("assistant", "Done.")]
    assert [r.fault for r in got] == [None, None, "duplicate", "blank", "truncated", None]


def test_empty_table_and_dropped_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.whole_reports(repair.report(repair.repair(repair.damaged(none))), none).count() == 0
    one = spark.createDataFrame([(5, 1, "user", "x", 0, "")], SCHEMA)
    got = repair.whole_reports(repair.report(repair.repair(one.where("false"))), one).collect()
    assert tuple(got[0]) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


@pytest.mark.parametrize("length", [30_000])
def test_one_giant_conversation_over_many_batches(spark, length):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        rows = spark.range(length).selectExpr(
            "1L as conv_id", "id as turn", "IF(id % 2 = 0, 'user', 'assistant') as role",
            "concat('line ', id, IF(id % 10 = 9, '', '.')) as text",
        )
        got = repair.report(repair.repair(rows)).collect()[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.audit == "K" * length and got.cost == got.truncated == length // 10 and got.gaps == 0


def test_rows_of_one_text_are_one_turn(spark):
    rows = spark.range(2000).selectExpr("CAST(NULL AS BIGINT) AS conv_id", "1 AS turn", "'user' AS role", "'Same.' AS text")
    got = repair.report(repair.repair(rows)).collect()[0]
    assert got.duplicate == 1999 and got.audit == "KI" + "D" * 1999 or got.audit == "K" + "D" * 1999 + "I"


def test_very_long_text(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a " * 700_000 + "?"), (1, 1, "assistant", " " * 1_000_000)],
                                 "conv_id int, turn int, role string, text string")
    got = repair.report(repair.repair(rows)).collect()[0]
    assert (got.blank, got.truncated, got.audit) == (1, 0, "KDI")
