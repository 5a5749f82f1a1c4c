import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import quality_rules as Q

SCHEMA = "doc_id bigint, text string, lang string, n_words string"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    held = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held))


def histograms(text, lang):
    classes = [0] * 7
    for c in text or "":
        spots = ["a" <= c <= "z", "A" <= c <= "Z", "0" <= c <= "9", c in " \t\n\v\f\r", c.isalpha(), c in ".,;:!?'\"()-", True]
        classes[spots.index(True)] += 1
    words = Counter(w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    known = Q.COMMON_WORDS.get(lang)
    common = known and [*(words[w] for w in known), sum(words.values()) - sum(words[w] for w in known)]
    return classes, common


def distance(p, q):
    p, q = [x / max(sum(p), 1) for x in p], [x / max(sum(q), 1) for x in q]
    part = lambda x, m: x * math.log2(x / m) if x > 0 else 0
    return math.sqrt(max(sum((part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2 for x, y in zip(p, q)), 0))


def corpus():
    random.seed(2)
    rows = []
    for i in range(120):
        lang = random.choice(["en", "de", "xx", None])
        pool = [*Q.COMMON_WORDS.get(lang, ["a"]), *("".join(random.choices("abcdefgh", k=5)) for _ in range(300))]
        words = random.choices(pool, weights=[9] * (len(pool) - 300) + [1] * 300, k=random.choice([0, 2, 49, 50, 80, 300]))
        if i % 5 == 0:
            words = [w.upper() + "#$|" for w in words]
        if i % 7 == 0:
            words = words[:9] * (len(words) // 9 + 1)
        text = "".join(w + random.choice([" ", "  ", "\n", ".\n", "\t", "\x0b", " \n \n"]) for w in words)
        rows.append((i, text, lang, "n"))
    return rows + [(200, None, "en", None), (201, "a b c a b c a b", "en", None), (202, "    x", "en", ""), (5, rows[5][1], rows[5][2], "n"), (203, "w " * 60_000, "de", "")]


def test_counts_and_verdicts_equal_plain_code(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    counted = Q.count_text(docs)
    got = Q.judge(counted, Q.references(counted)).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common",
        "base_failed", "class_distance", "word_distance", "kept",
    ).collect()
    refs = {}
    for _, t, lang, _ in rows:
        n = counts(t)
        if lang in Q.COMMON_WORDS and n[0] >= 50 and 100 * n[4] <= 50 * n[0]:
            for old, new in zip(refs.setdefault(lang, ([0] * 7, [0] * 17)), histograms(t, lang)):
                old[:] = [a + b for a, b in zip(old, new)]
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    for r in got:
        _, text, lang, _ = by_id[r.doc_id]
        n, (classes, common) = counts(text), histograms(text, lang)
        assert tuple(r)[1:6] == n
        assert (r.classes, r.common) == (classes, common)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert r.base_failed == failed
        fine = True
        if lang in refs and n[0] >= 50:
            a, b = distance(classes, refs[lang][0]), distance(common, refs[lang][1])
            assert abs(r.class_distance - a) < 1e-9 and abs(r.word_distance - b) < 1e-9
            root = math.sqrt(n[0])
            fine = a <= Q.MAX_CLASS_DISTANCE + Q.CLASS_SLACK / root and b <= Q.MAX_WORD_DISTANCE + Q.WORD_SLACK / root
        else:
            assert r.class_distance is None and r.word_distance is None
        assert r.kept == (not failed and fine)
    assert {r.kept for r in got} == {True, False}
    kept = Q.keep_good(docs, Q.references(counted))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    counted = Q.count_text(docs)
    assert Q.judge(counted, Q.references(counted)).count() == 0


def test_no_python_in_the_plan(spark):
    counted = Q.count_text(spark.createDataFrame([(1, "a", "en", "")], SCHEMA))
    plan = Q.judge(counted, Q.references(counted)).where(F.col("kept"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
