import json

import pytest

from tidemark.llm import chat

CALLS = "conv_id bigint, call_id string, name string, arguments string, after array<string>, place bigint, line string"
RESULTS = "conv_id bigint, call_id string, content string, place bigint"
SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}}}}


def rows(spark, calls, results):
    frame = spark.createDataFrame([(*c, "x") for c in calls], CALLS)
    return chat.link_calls(frame, spark.createDataFrame(results, RESULTS), SCHEMAS).collect()


def test_linking_order_and_checks(spark):
    calls = [
        (1, "a", "add", '{"b": 2, "a": 1.0}', None, 1),
        (1, "b", "add", '{"a": -1}', ["a", "zz"], 0),
        (1, "c", "sub", "{}", ["a", "b"], 2),
        (1, "a", "add", '{"a": 9}', None, 5),
        (1, "x", "add", '{"a": 1}', ["y"], 6),
        (1, "y", "add", '{"a": 1}', ["x"], 7),
        (1, "w", "add", "{bad", ["y"], 8),
        (1, None, "add", None, ["a"], 9),
        (2, "a", "add", '{"a": 1}', ["a"], 1),
        (3, "r", "add", '{"a": 3}', None, 1),
        (3, "r", "add", '{"a": 3}', None, 1),
        (None, "n", "add", '{"a": 3}', [], 1),
    ]
    results = [(1, "a", "late", 9), (1, "a", "early", 2), (1, "c", None, 3), (1, "gone", "x", 1), (None, "n", "ok", 2), (3, "r", "z", 1)]
    got = rows(spark, calls, results)
    state = sorted((r.conv_id or 0, r.call_id or "", r.status, -1 if r.level is None else r.level, r.valid) for r in got)
    assert state == sorted([
        (1, "a", "linked", 0, True), (1, "b", "open", 1, False), (1, "c", "linked", 2, False), (1, "a", "repeated", 0, True),
        (1, "x", "cyclic", -1, True), (1, "y", "cyclic", -1, True), (1, "w", "cyclic", -1, False), (1, "", "open", 0, False),
        (2, "a", "cyclic", -1, True), (3, "r", "linked", 0, True), (3, "r", "repeated", 0, True), (0, "n", "linked", 0, True),
    ])
    first = next(r for r in got if r.call_id == "a" and r.status == "linked")
    assert first.line == '{"after":[],"arguments":{"a":1,"b":2},"id":"a","name":"add","result":"early","status":"linked"}'
    assert next(r for r in got if r.call_id == "w").errors == ["arguments are not JSON"]


def test_a_long_chain_takes_few_rounds(spark):
    edges = [(f"n{i}", f"n{i - 1}") for i in range(1, 700)] + [("n5", "n0"), ("q", "n699"), ("q", "n3")]
    got = dict(map(tuple, chat.levels(spark.createDataFrame(edges, "node string, needs string")).collect()))
    assert got == {**{f"n{i}": i for i in range(1, 700)}, "q": 700}


def test_plain_conversations(spark):
    talk = [(1, 0, "system", "s", 0), (1, 1, "user", "hi", 0), (1, 2, "assistant", "yo", 0), (1, 3, "user", "", 0), (1, 5, "user", None, 0), (None, 0, "user", "x" * 50_000, 0)]
    frame = spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string, line int")
    got = chat.link_calls(*chat.turns_as_calls(frame), chat.REPLY).collect()
    state = sorted((r.conv_id or 0, r.call_id, r.level, r.status, r.valid) for r in got)
    assert state == [(0, "t0", 0, "open", True), (1, "t1", 0, "linked", True), (1, "t3", 1, "open", False), (1, "t5", 2, "open", False)]
    line = json.loads(next(r.line for r in got if r.call_id == "t1"))
    assert line["result"] == "yo" and line["arguments"] == {"turn": 1, "text": "hi"}


def test_canonical_json():
    assert chat.canonical({"b": 1.0, "a": ["é", None, True, 1.5]}) == '{"a":["é",null,true,1.5],"b":1}'
    with pytest.raises(ValueError):
        chat.canonical(float("nan"))


def test_schema_keywords():
    schema = {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": ["string", "null"], "maxLength": 2, "enum": ["a", None, "abc"]}}
    assert chat.violations(["a", None], schema) == []
    assert chat.violations([], schema) == ["$: shorter than minItems"]
    assert chat.violations(["abc", 1, "b"], schema) == ["$: longer than maxItems", "$[0]: longer than maxLength", "$[1]: not string or null", "$[2]: not in enum"]
    assert chat.violations(True, {"type": "integer"}) == ["$: not integer"]
    assert chat.violations({"z": 1}, {"additionalProperties": False, "properties": {}}) == ["$.z: not allowed"]


def test_empty_tables(spark):
    assert rows(spark, [], []) == []
