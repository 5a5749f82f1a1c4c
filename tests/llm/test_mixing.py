import hashlib
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.prefix import running_sums

SCHEMA = "doc_id bigint, text string, source string, size int, rank string"


def water(sizes, weights, share=1.5, epochs=2.0):
    """Targets by sharing the excess again and again."""
    open_, target = set(sizes), dict.fromkeys(sizes, 0.0)
    left = share * sum(sizes.values())
    while open_:
        weight = sum(weights[s] for s in open_)
        above = {s for s in open_ if left * weights[s] / weight > epochs * sizes[s]}
        for s in above or open_:
            target[s] = epochs * sizes[s] if above else left * weights[s] / weight
        if not above:
            break
        left -= sum(epochs * sizes[s] for s in above)
        open_ -= above
    return target


def rows_of(n=400):
    out = []
    for i in range(n):
        source = [None, "a", "b", "é", "z"][i % 17 % 5] if i % 3 else "a"
        out.append((i if i % 50 else None, " \n".join(["w"] * (i * 7 % 23)) if i % 11 else None, source, 1, "x"))
    return out + out[20:25] * 2


def test_mix_meets_targets_and_brute_force(spark):
    rows = rows_of()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    flat = lambda rs: sorted((repr(r.doc), r.size, r.taken) for r in rs)
    assert flat(got) == flat(again)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + words(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: [5, 2, 1][k % 3] for k, s in enumerate(order)})
    for s in order:
        own = [r for r in got if r.doc.source == s]
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
        assert sum(r.taken for r in own) == int(want[s] + 1e-9)
        budget = int(want[s] + 1e-9)
        left = budget % sizes[s]
        key = lambda r: (hashlib.md5(f"0:{'' if r.doc.doc_id is None else r.doc.doc_id}".encode()).hexdigest(), r.size)
        taken = []
        for r in sorted(own, key=key):
            part = max(0, min(r.size, left))
            left -= part
            taken.append((key(r), budget // sizes[s] * r.size + part))
        assert sorted(taken) == sorted((key(r), r.taken) for r in own)
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)


def test_mixture_holds_the_words_taken(spark):
    mixed = mixing.mix(spark.createDataFrame(rows_of(), SCHEMA), weights=(1.0, 3.0), share=1.2)
    taken = sum(r.taken for r in mixed.collect())
    out = mixing.mixture(mixed).collect()
    assert sum(len(r.text.split()) for r in out) == taken
    whole = [r for r in out if r.text == r.doc.text]
    assert len(out) - len(whole) <= 5


def test_weights_as_a_table(spark):
    rows = [(i, "a b c d", "s" + str(i % 3), 1, "") for i in range(30)]
    weights = spark.createDataFrame([("s0", 3.0), ("s1", 1.0)], "source string, weight double")
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights=weights, share=0.5).collect()
    by = {}
    for r in got:
        by[r.doc.source] = by.get(r.doc.source, 0) + r.taken
    assert by == {"s0": 45, "s1": 15, "s2": 0}


def test_empty_tables_and_texts(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a", 0, ""), (2, " \n", None, 0, "")], SCHEMA)).collect()
    assert {(r.doc.doc_id, r.size, r.taken, r.target) for r in got} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0)}


def test_one_long_text(spark):
    got = mixing.mix(spark.createDataFrame([(1, "ab " * 500_000, "a", 0, "")], SCHEMA)).collect()
    assert got[0].size == 500_000 and got[0].taken == 750_000


def test_running_sums_over_parts_that_span_tasks(spark):
    rows = [Row(p=p, n=n, v=n % 5) for p in (0, 3, 9) for n in range(700 if p == 3 else 40)]
    got = running_sums(spark.createDataFrame(rows).repartition(5), F.col("p"), [F.col("n")], ["v"]).collect()
    for p in (0, 3, 9):
        total = 0
        for r in sorted((r for r in got if r.p == p), key=lambda r: r.n):
            assert r.before_v == total
            total += r.v
