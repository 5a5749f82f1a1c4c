import hashlib
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import secrets


def by_hand(text):
    """Spans per rule by Python's own matching over the whole text."""
    out = []
    for k, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), k, m.end()))
    return out


def joined(spans, kinds):
    return ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(spans) if k < kinds)


def texts():
    random.seed(3)
    bits = [
        "token", "Secret", "API_KEY", "apikey", "passwd", "password", " = ", "=", ":", '"', "'", " ", "\n",
        "abcdefgh123", "short", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "deadbeef" * 5, "é\U0001f600",
        "ghp_" + "a1" * 18, "xoxb-1234567890-a", "AIza" + "x" * 35, "sk_live_" + "9" * 16, "eyJhbGciOi.eyJzdWIiOi.abcdefghij",
        "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "tok", "en",
    ]
    out = [None, "", "token=secret:abcdefghij", 'token : "aaaaaaaa"', "a" * 100_000 + " password=longenough1"]
    out += ["".join(random.choices(bits, k=random.randint(1, 30))) for _ in range(400)]
    return out + out[5:40]


def test_spans_equal_a_plain_scan(spark):
    rows = [(i % 300, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, found string")
    found = secrets.find_secrets(docs)
    got = found.select(
        "doc.doc_id", "doc.text",
        secrets.span_text(F.col("found"), secrets.BASE).alias("base"),
        secrets.span_text(F.col("found"), secrets.RULES).alias("spans"),
    ).collect()
    key = lambda r: (r[0], r[1] is not None, r[1] or "")
    want = [(d, t, joined(by_hand(t), 3), joined(by_hand(t), 99)) for d, t, _ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any("private" in r.spans for r in got) and any("assign" in r.base for r in got)


def test_every_match_meets_the_trigram_query():
    for rule in secrets.RULES:
        clauses = secrets.trigram_query(rule.pattern)
        for text in texts():
            for m in re.finditer(rule.pattern, text or ""):
                low = m.group().lower()
                assert all(any(all(g in low for g in alt) for alt in clause) for clause in clauses)
    assert secrets.trigram_query("[0-9a-f]+") == []
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [[["aki", "kia"]]]
    assert secrets.trigram_query("(abc|ab)x*de") == []


def test_empty_table_and_digest(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert secrets.find_secrets(docs).count() == 0
    one = secrets.find_secrets(spark.createDataFrame([(1, None)], "doc_id bigint, text string"))
    digest = one.select(F.sha2(secrets.span_text(F.col("found"), secrets.BASE), 256)).first()[0]
    assert digest == hashlib.sha256(b"").hexdigest()
