"""Secret scan: rules as regular expressions, found through a trigram index.

DataFrame functions only. Each rule's pattern gives a Boolean query of trigrams that any match
must contain (an AND of ORs). The index holds postings of the trigrams that occur in some query;
intersecting them gives each text the rules that may match it, and only those rules' patterns
run. Rules without a mandatory trigram run on every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, staged

_parser, _const = re._parser, re._constants


@dataclass(frozen=True)
class Rule:
    """``pattern`` must read the same in Java and Python. ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules come first and define the order of kinds.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 8,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
)
# Published forms of keys and tokens.
ADDED = (
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", "[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", "-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)
RULES = BASE + ADDED

#: An OR of more trigrams than this is left out of a query: it would select nearly every text.
MAX_CHOICES = 64


def _strings(node) -> list[str] | None:
    """Exact lower-case strings of a parsed part, or None if they are too many to list."""
    op, arg = node
    if op == _const.LITERAL:
        return [chr(arg).lower()]
    if op == _const.IN and arg and arg[0][0] != _const.NEGATE:
        found: set[str] = set()
        for kind, value in arg:
            if kind == _const.LITERAL:
                found.add(chr(value).lower())
            elif kind == _const.RANGE and value[1] - value[0] < 10:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return sorted(found)
    if op == _const.SUBPATTERN:
        return _joined(arg[-1])
    if op == _const.BRANCH:
        parts = [_joined(p) for p in arg[1]]
        return None if None in parts else sorted({s for p in parts for s in p})
    if op == _const.MAX_REPEAT and arg[1] <= 2:
        once = _joined(arg[2])
        if once is None:
            return None
        return sorted({"".join(c) for n in range(arg[0], arg[1] + 1) for c in product(once, repeat=n)})
    return None


def _joined(parts) -> list[str] | None:
    out = [""]
    for node in parts:
        options = _strings(node)
        if options is None or len(out) * len(options) > MAX_CHOICES:
            return None
        out = [a + b for a in out for b in options]
    return out


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """What every match contains: for each mandatory stretch, one of some sets of trigrams.

    Each stretch of the pattern whose strings can be listed gives a clause, a list of alternatives;
    an alternative is the trigrams of one string. A stretch with a string shorter than three
    characters gives none. All trigrams are in lower case, as the index is. No clause: no trigram
    is mandatory.
    """
    clauses, run = [], [""]

    def close() -> None:
        if all(len(s) >= 3 for s in run):
            sets = {tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in run}
            least = [s for s in sets if not any(set(o) < set(s) for o in sets)]
            clauses.append([list(s) for s in sorted(least)])

    for node in _parser.parse(pattern):
        options = _strings(node)
        if options is not None and len(run) * len(options) <= MAX_CHOICES:
            run = [a + b for a in run for b in options]
        else:
            close()
            run = options if options is not None else [""]
    close()
    return clauses


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(``trigram``, ``id``) for each distinct text and each of the trigrams that it holds."""
    low = F.lower(F.col("text"))
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams)))
    held_rows = texts.select("id", low.alias("low")).select("id", F.explode(held).alias("trigram"))
    return held_rows.dropDuplicates(["trigram", "id"])


def candidates(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(``id``, ``kinds``): the rules with mandatory trigrams whose query a text meets.

    The postings are intersected per rule: all trigrams of an alternative, then any alternative of
    a clause, then all clauses. The table of query terms is as long as the rules, not the data.
    """
    terms = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        for c, clause in enumerate(query):
            for a, grams in enumerate(clause):
                terms += [(g, rule.kind, len(query), c, a, len(grams)) for g in grams]
    if not terms:
        return texts.select("id", F.array(F.lit("")).alias("kinds")).where("false")
    spark = texts.sparkSession
    query_terms = spark.createDataFrame(
        terms, "trigram string, kind string, n_clauses int, clause int, choice int, n_grams int"
    )
    index = postings(texts, sorted({t[0] for t in terms}))
    met = index.join(F.broadcast(query_terms), "trigram")
    choices = met.groupBy("id", "kind", "n_clauses", "clause", "choice", "n_grams").count().where("count = n_grams")
    clauses = choices.select("id", "kind", "n_clauses", "clause").distinct()
    kinds = clauses.groupBy("id", "kind", "n_clauses").count().where("count = n_clauses")
    return kinds.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule) -> Column:
    """Spans (start, end, kind) of a rule, leftmost and not overlapping, in code points.

    The text between the matches gives their places. Matches whose group is too short still take
    up their text.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    part = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda a, m: F.struct(
            (a["at"] + m["gap"] + F.coalesce(m["whole"], F.lit(0))).alias("at"),
            F.when(
                F.coalesce(m["part"], F.lit(-1)) >= rule.least,
                F.concat(
                    a["found"],
                    F.array(F.struct(
                        (a["at"] + m["gap"]).alias("start"), (a["at"] + m["gap"] + m["whole"]).alias("end")
                    )),
                ),
            ).otherwise(a["found"]).alias("found"),
        ),
        lambda a: a["found"],
    )
    return walked


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc`` (the row's columns) with ``found``: per rule, in order, its spans.

    A null text is empty. Rows with equal texts share the index entry; nothing else is merged, so
    the rows are those of ``docs``. ``found[k]`` holds the spans (start, end) of ``rules[k]``.
    """
    text = F.coalesce(F.col("doc")["text"], F.lit(""))
    base = packed(docs).withColumn("id", F.unhex(F.md5(text)))
    indexed = staged(candidates(base.select("id", text.alias("text")), rules), "secret-candidates")
    both = base.join(indexed, "id", "left").select("doc", "kinds", text.alias("text"))
    spans = []
    for rule in rules:
        # A cheap test first: only texts with a long enough match are split.
        may = F.col("text").rlike(_gate(rule))
        if trigram_query(rule.pattern):
            may = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) & may
        spans.append(F.when(may, _spans(F.col("text"), rule)).otherwise(
            F.expr("cast(array() as array<struct<start:int,end:int>>)")
        ))
    return both.select("doc", F.array(*spans).alias("found"))


def _gate(rule: Rule) -> str:
    """Pattern that any text with a span matches: a repeat at the end, if it is the group, has its length."""
    if rule.group == 0 and rule.pattern.endswith("]+") and rule.pattern.startswith("["):
        return f"{rule.pattern[:-1]}{{{rule.least}}}"
    return rule.pattern


def span_text(found: Column, rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` of the first ``len(rules)`` rules by start, then kind as listed, comma-joined."""
    def ranked(k: int) -> Column:
        return F.transform(
            F.get(found, F.lit(k)),
            lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), s["end"].alias("end")),
        )

    rows = F.concat(*(ranked(k) for k in range(len(rules))))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(
        F.transform(F.sort_array(rows), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ","
    )
