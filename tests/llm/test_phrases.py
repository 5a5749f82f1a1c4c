import random
import re
from collections import Counter

import pytest

from tidemark.llm import phrases

SCHEMA = "lang string, text string, doc_id bigint, phrase int, chunk string, n string"


def brute(rows, least, most=2000, longest=5):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            inside = any(
                len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()
            )
            if not inside:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def corpus(seed=3, n=260):
    rng = random.Random(seed)
    words = ["The", "of", "to", "new", "york", "città", "x-1", "\U0001f600", "Ä", "in", "a" * 40]
    fixed = ["once upon a time there", "new york city", "of the of the of the", "as well as"]
    out = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words)
            text += rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b", "!?", "\r\n", " "])
        out.append((rng.choice(["en", "en", "de", None, "und"]), None if i % 40 == 0 else text))
    return out + out[5:9] * 6


@pytest.mark.parametrize(("least", "slice_bytes", "chunk", "bits"), [(5, 1 << 21, 512, 1 << 20), (12, 300, 7, 1 << 15), (100, 1 << 21, 512, 1 << 20)])
def test_equals_brute_force(spark, least, slice_bytes, chunk, bits):
    rows = corpus()
    frame = spark.createDataFrame([(*r, 1, 2, "c", "n") for r in rows], SCHEMA).repartition(3)
    chunks = phrases.dictionary(frame.select("lang", "text"), spacing=chunk // 3, most=chunk)
    found = phrases.frequent_phrases(chunks, least=least, filter_bits=bits, slice_bytes=slice_bytes)
    got = phrases.top_phrases(phrases.score(found)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == brute(rows, least)


def test_rank_limit_and_defaults(spark):
    rows = corpus(8) * 3
    got = phrases.collocations(spark.createDataFrame([(*r, 1, 2, "c", "n") for r in rows], SCHEMA), least=9, most=7)
    assert sorted(map(tuple, got.collect())) == brute(rows, 9, most=7)


def test_chunks_hold_every_phrase_once(spark):
    rows = [("en", " ".join(f"w{i % 97}" for i in range(5000)))] * 3
    chunks = phrases.dictionary(spark.createDataFrame(rows, "lang string, text string")).collect()
    assert sum(c.own * c.n for c in chunks) == 15000 == sum(c.words * c.n for c in chunks)
    pairs = Counter()
    for c in chunks:
        words = c.chunk.split(" ")
        for i in range(c.own):
            if i + 5 <= len(words):
                pairs[tuple(words[i : i + 5])] += c.n
    assert pairs == Counter(tuple(f"w{j % 97}" for j in range(i, i + 5)) for i in range(4996) for _ in range(3))


def test_empty_table_and_blank_texts(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("en", None), ("en", ""), ("en", " \t,.\n"), (None, "one word")]
    assert phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=1).collect()[0].phrase == "one word"


def test_very_long_text(spark):
    rows = [("en", "ping pong " * 150_000), ("en", "z" * 1_500_000), ("en", " " * 1_000_000)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string")).collect()
    best = {r.phrase: r for r in got}
    assert best["ping pong ping pong ping"].a == 149_998 and best["ping pong ping pong ping"].n == 300_001
