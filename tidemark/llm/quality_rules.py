"""Quality rules: divergence of character classes and common words from the language's reference.

DataFrame functions only. One pass counts every text; the references are sums of those counts over
all documents of a language; the verdict compares each document with its reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, fenced, packed, words_of

# Frequent function words of each language, the bins of the word histogram.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "this"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "qui", "dans", "du", "pour", "par", "aux"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una"],
}
CLASSES = ("lower", "upper", "digit", "space", "letter", "point", "sign")

MIN_WORDS = 50
#: Allowed distance: a level and a slack that falls with the root of the words, as sampling noise does.
MAX_CLASS_DISTANCE, CLASS_SLACK = 0.16, 1.0
MAX_WORD_DISTANCE, WORD_SLACK = 0.12, 1.5


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _common_found(lang: Column, text: Column) -> Column:
    """Common words of the row's language in its text, lower case, each in guard spaces; else null."""
    out = F.lit(None).cast("string")
    for name, words in COMMON_WORDS.items():
        found = F.regexp_extract_all(text, F.lit(rf"(?i)(?<!\S)(?:{'|'.join(words)})(?!\S)"), F.lit(0))
        out = F.when(lang == name, F.concat(F.lit(" "), F.lower(F.array_join(found, "  ")), F.lit(" "))).otherwise(out)
    return out


def _common_counts(lang: Column, found: Column, n_words: Column) -> Column:
    """Occurrences of each listed word, the remaining words last."""
    out = F.lit(None).cast("array<bigint>")
    for name, words in COMMON_WORDS.items():
        each = [
            ((F.length(found) - F.length(F.replace(found, F.lit(f" {w} ")))) / (len(w) + 2)).cast("long")
            for w in words
        ]
        counts = F.array(*each)
        all_found = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
        out = F.when(lang == name, F.concat(counts, F.array(n_words - all_found))).otherwise(out)
    return out


def count_text(docs: DataFrame) -> DataFrame:
    """``doc`` (all columns as a struct), ``lang`` and the counts of its text.

    Null text counts as empty. Every count is a long; ``classes`` holds characters by class and
    ``common`` the occurrences of each common word with the other words last (null for a language
    without a list).
    """
    base = packed(docs, "lang", "text").withColumn("text", F.coalesce("text", F.lit("")))
    split = base.select(
        "doc",
        "lang",
        words_of(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length("text").alias("n0"),
        _without(F.col("text"), "[a-z]+").alias("s1"),
        _common_found(F.col("lang"), F.col("text")).alias("found"),
    )
    some = split.select(
        "doc", "lang", "w", "n0", "found",
        F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length("s1").alias("n1"),
        _without(F.col("s1"), SPACES).alias("s2"),
        F.when(
            F.size("w") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("w") - 3),
                lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)),
            ),
        ).otherwise(F.expr("cast(array() as array<bigint>)")).alias("grams"),
    )
    # Only texts with a repeated window are sorted; positions of repeated windows are neighbours then.
    paired = some.select(
        "doc", "lang", "n0", "n1", "n_words", "n_dup_lines", "found",
        (F.col("n0") - F.col("n1") + F.length("s2")).cast("long").alias("word_chars"),
        F.length("s2").alias("n2"),
        _without(F.col("s2"), "[A-Z]+").alias("s3"),
        F.when(
            F.size(F.array_distinct("grams")) < F.size("grams"),
            F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).otherwise(F.expr("cast(array() as array<struct<g:bigint,i:int>>)")).alias("pairs"),
    )
    again = F.filter(
        "pairs",
        lambda p, i: (F.get("pairs", i - 1)["g"] == p["g"]) | (F.get("pairs", i + 1)["g"] == p["g"]),
    )
    placed = paired.select(
        "doc", "lang", "n0", "n1", "n2", "n_words", "n_dup_lines", "word_chars", "found",
        F.length("s3").alias("n3"),
        _without(F.col("s3"), "[0-9]+").alias("s4"),
        F.sort_array(F.transform(again, lambda p: p["i"])).alias("spots"),
    )
    rest = placed.select(
        "doc", "lang", "n0", "n1", "n2", "n3", "n_words", "n_dup_lines", "word_chars", "found",
        F.length("s4").alias("n4"),
        (F.length("s4") - F.length(_without(F.col("s4"), "[#*$%&|<>]+"))).cast("long").alias("n_symbols"),
        _without(F.col("s4"), r"\p{L}+").alias("s5"),
        F.aggregate(
            "spots",
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last")
            ),
            lambda a: a["n"],
        ).alias("n_repeat_words"),
    )
    points = F.length(_without(F.col("s5"), "[.,;:!?'\"()-]+"))
    classes = F.array(
        F.col("n0") - F.col("n1"), F.col("n2") - F.col("n3"), F.col("n3") - F.col("n4"),
        F.col("n1") - F.col("n2"), F.col("n4") - F.length("s5"), F.length("s5") - points, points,
    ).cast("array<bigint>")
    counts = [F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    common = _common_counts(F.col("lang"), F.col("found"), F.col("n_words"))
    return fenced(rest, ["doc", "lang"], [*counts, classes.alias("classes"), common.alias("common")])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(counted: DataFrame) -> DataFrame:
    """One row per listed language: shares of the classes and common words over all its documents.

    Documents that fail the base rules don't count. At most as many rows as ``COMMON_WORDS`` has
    languages, each of fixed width, however large the corpus is.
    """
    good = counted.where(~base_failed() & F.col("common").isNotNull())
    n_classes, n_words = len(CLASSES), 1 + max(len(v) for v in COMMON_WORDS.values())
    sums = good.groupBy("lang").agg(
        *(F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(n_classes)),
        *(F.sum(F.get("common", F.lit(k))).alias(f"w{k}") for k in range(n_words)),
    )
    return sums.select(
        "lang",
        F.array(*(F.col(f"c{k}") for k in range(n_classes))).alias("class_ref"),
        F.array(*(F.col(f"w{k}") for k in range(n_words))).alias("word_ref"),
    )


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits) of two count arrays of one length."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: F.transform(a, lambda x: x / F.greatest(total(a), F.lit(1.0)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(
        share(p), share(q), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2
    )
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def judge(counted: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds ``class_distance``, ``word_distance``, ``base_failed`` and ``kept``.

    A document that passes the base rules is dropped when its character classes or its common
    words lie further from its language than allowed. The guard for short texts is twofold: none
    under ``MIN_WORDS`` words is compared, and the allowed distance is larger for fewer words.
    Without a reference (null or unlisted language) only the base rules decide. Distances are null
    where they are not tested.
    """
    both = counted.join(F.broadcast(refs), "lang", "left")
    scored = both.select(
        "*",
        base_failed().alias("base_failed"),
        F.when(F.col("class_ref").isNotNull() & (F.col("n_words") >= MIN_WORDS),
               jensen_shannon(F.col("classes"), F.col("class_ref"))).alias("class_distance"),
        F.when(F.col("word_ref").isNotNull() & F.col("common").isNotNull()
               & (F.col("n_words") >= MIN_WORDS),
               jensen_shannon(F.col("common"), F.col("word_ref"))).alias("word_distance"),
    )
    noise = F.sqrt(F.greatest("n_words", F.lit(1)))
    fine = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE + CLASS_SLACK / noise) & (
        F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE + WORD_SLACK / noise
    )
    return scored.withColumn("kept", ~F.col("base_failed") & fine).drop("class_ref", "word_ref")


def keep_good(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose verdict is ``kept``."""
    return judge(count_text(docs), refs).where("kept").select("doc.*")
