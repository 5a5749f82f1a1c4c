"""Tool-call linking: calls and results of conversations, in an order that respects dependencies.

Calls and results are joined by identifier. The order is topological: a call's level is the
longest chain of calls that it waits for, found by doubling the distance covered in each round, so
a chain of a thousand calls takes ten rounds. Arguments are checked against the tool's schema, and
each call becomes one line of canonical JSON.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

KINDS = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
}
LINE = "conv_id bigint, call_id string, level bigint, status string, valid boolean, errors array<string>, line string"


def canonical(value: object) -> str:
    """JSON with sorted keys, no white space, whole floats as integers; ValueError if not finite."""
    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 2**53:
            return int(x)
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is_kind(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or (isinstance(value, float) and value.is_integer())
        return not isinstance(value, bool) and (whole if kind == "integer" else isinstance(value, int | float))
    return isinstance(value, KINDS[kind])


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """Where ``value`` breaks a JSON schema, in document order.

    Known keywords: type, enum, required, properties, additionalProperties (as false), items,
    minimum, maximum, minLength, maxLength, minItems, maxItems.
    """
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is_kind(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above maximum")
    size = len(value) if isinstance(value, str | list) else 0
    word = "Length" if isinstance(value, str) else "Items"
    if isinstance(value, str | list):
        if size < schema.get(f"min{word}", 0):
            out.append(f"{at}: shorter than min{word}")
        if size > schema.get(f"max{word}", size):
            out.append(f"{at}: longer than max{word}")
    if isinstance(value, list) and "items" in schema:
        for k, item in enumerate(value):
            out += violations(item, schema["items"], f"{at}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, item in value.items():
            if k in known:
                out += violations(item, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    return out


def levels(edges: DataFrame) -> DataFrame:
    """``node``, ``level`` of every node with a dependency; ``edges`` has ``node`` and ``needs``.

    The level is the number of edges on the longest way up; null on or behind a cycle. With
    "reaches in exactly 2**r steps" as relation, a longest way of up to 2**(r+1) - 1 edges is 2**r
    steps and a longest way from there. Nodes with one dependency have one row in each round.
    """
    steps = staged(edges.select("node", "needs").distinct(), "steps")
    nodes = steps.select("node").distinct().count()
    known = staged(steps.select("node").distinct().withColumn("level", F.lit(0).cast("long")), "levels")
    length = 1
    while not steps.isEmpty():
        if length > nodes:  # longer than any way without a repeat
            cyclic = steps.select("node").distinct().withColumn("cyclic", F.lit(True))
            return known.join(cyclic, "node", "left").select(
                "node", F.when(F.col("cyclic").isNull(), F.col("level")).alias("level")
            )
        far = known.select(F.col("node").alias("needs"), F.col("level").alias("rest"))
        reached = steps.join(far, "needs", "left").groupBy("node").agg(
            F.max(length + F.coalesce("rest", F.lit(0))).alias("longer")
        )
        known = staged(
            known.join(reached, "node", "left").select("node", F.greatest("level", F.coalesce("longer", "level")).alias("level")),
            "levels",
        )
        onward = steps.select(F.col("node").alias("needs"), F.col("needs").alias("next"))
        steps = staged(steps.join(onward, "needs").select("node", F.col("next").alias("needs")).distinct(), "steps")
        length *= 2
    return known


def _lines(batches: Iterator[pa.RecordBatch], schemas: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        valid, errors, lines = [], [], []
        for row in batch.to_pylist():
            try:
                value = json.loads(row["arguments"] or "{}")
                canonical(value)
                found = (
                    violations(value, schemas[row["name"]]) if row["name"] in schemas else [f"unknown tool {row['name']}"]
                )
            except ValueError:
                value, found = row["arguments"], ["arguments are not JSON"]
            valid.append(not found)
            errors.append(found)
            lines.append(canonical({
                "id": row["call_id"], "name": row["name"], "arguments": value, "result": row["content"],
                "status": row["status"], "after": sorted(row["after"] or []),
            }))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "call_id", "level", "status")), pa.array(valid, pa.bool_()),
             pa.array(errors, pa.list_(pa.string())), pa.array(lines, pa.string())],
            names=[c.split()[0] for c in LINE.split(", ")],
        )


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call: level in the order, status, verdict on the arguments, canonical JSON line.

    ``calls``: conv_id, call_id, name, arguments (JSON text, null for none), after (call_ids it
    waits for, null for none), place. ``results``: conv_id, call_id, content, place. Identifiers
    are those of one conversation. The first call and the first result of an identifier (by place,
    then text) count; later ones have status ``repeated`` and no result, and a later result is
    not used. A call without result is ``open``; one on or behind a cycle of dependencies is
    ``cyclic``, with a null level; names of calls that don't exist in the conversation are no
    dependency. A null identifier links nothing. Results without a call give no row. Rows ordered
    by level, then place, are a valid order of the conversation. Other columns are not read.
    """
    calls = calls.select(F.col("conv_id").cast("long").alias("conv_id"), "call_id", "name", "arguments", "after", "place")
    key = ["conv_id", "call_id"]
    order = F.struct("place", "name", "arguments")
    # Equal rows meet as a count, so one identifier repeated in any number stays small.
    met = calls.groupBy(*key, "name", "arguments", "after", "place").count()
    first = met.where("call_id is not null").groupBy(*key).agg(F.min(order).alias("first"))
    same = lambda a, b: a.eqNullSafe(b)
    marked = met.join(
        first.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "first"),
        same(F.col("conv_id"), F.col("c")) & (F.col("call_id") == F.col("i")), "left",
    ).withColumn("is_first", F.col("first").isNotNull() & (F.struct("place", "name", "arguments") == F.col("first")))
    answer = results.where("call_id is not null").groupBy(F.col("conv_id").cast("long").alias("rc"), F.col("call_id").alias("ri")).agg(
        F.min(F.struct("place", "content")).alias("answer")
    )
    marked = marked.join(answer, same(F.col("conv_id"), F.col("rc")) & (F.col("call_id") == F.col("ri")), "left")
    marked = marked.select(*key, "name", "arguments", "after", "place", "is_first", "answer", "count")
    alike = Window.partitionBy(*key, "place", "name", "arguments").orderBy(F.to_json(F.struct("after")))
    ranked = marked.withColumn("rank", F.row_number().over(alike)).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))
    )
    leads = F.col("is_first") & (F.col("rank") == 1) & (F.col("copy") == 1)
    one = staged(ranked.withColumn("leads", leads).drop("is_first", "rank", "copy", "count"), "calls")
    node = lambda c: F.struct(F.col("conv_id"), F.col(c).alias("call_id"))
    wanted = one.where("leads").select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("needs"))
    edges = wanted.select(node("call_id").alias("node"), node("needs").alias("needs"))
    there = one.where("leads").select(node("call_id").alias("needs"))
    depth = levels(edges.join(there, "needs", "left_semi"))
    depth = depth.select(F.col("node.conv_id").alias("lc"), F.col("node.call_id").alias("li"), "level", F.lit(True).alias("waits"))
    placed = one.join(
        depth, same(F.col("conv_id"), F.col("lc")) & (F.col("call_id") == F.col("li")) & F.col("leads"), "left"
    )
    status = (
        F.when(F.col("call_id").isNotNull() & ~F.col("leads"), "repeated")
        .when(F.col("waits") & F.col("level").isNull(), "cyclic")
        .when(F.col("leads") & F.col("answer").isNotNull(), "linked")
        .otherwise("open")
    )
    rows = placed.select(
        "conv_id", "call_id", "name", "arguments", "after",
        F.when(F.col("waits").isNull(), F.lit(0).cast("long")).otherwise(F.col("level")).alias("level"),
        status.alias("status"), F.when(F.col("leads"), F.col("answer.content")).alias("content"),
    )
    return rows.mapInArrow(lambda batches: _lines(batches, schemas), LINE)


# The tool that a user's turn calls when plain conversations are read as calls and answers.
REPLY = {
    "reply": {
        "type": "object", "additionalProperties": False, "required": ["turn", "text"],
        "properties": {"turn": {"type": "integer", "minimum": 0}, "text": {"type": "string", "minLength": 1}},
    }
}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    A user's turn is a call of ``reply`` with the identifier ``t<turn>``; it waits for the call two
    turns before. An assistant's turn is the result of the call one turn before. Other roles are
    neither.
    """
    turn = F.col("turn").cast("long")
    name = lambda t: F.concat(F.lit("t"), t.cast("string"))
    calls = conversations.where("role = 'user'").select(
        "conv_id", name(turn).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(turn.alias("turn"), F.col("text").alias("text"))).alias("arguments"),
        F.array(name(turn - 2)).alias("after"), turn.alias("place"),
    )
    results = conversations.where("role = 'assistant'").select(
        "conv_id", name(turn - 1).alias("call_id"), F.col("text").alias("content"), turn.alias("place")
    )
    return calls, results
