"""Line dedup by a deletion neighbourhood: drop a line if an earlier one lies within one edit.

DataFrame functions only. Two lines within one edit are equal once the window that holds the edit
is cut out of both: the same window of two lines of one length, or a window that is one character
shorter in the shorter line. Cutting windows of a single character is the classical deletion
neighbourhood; a line of n characters has n such variants of n characters each. Here the windows
start as halves of the line and shrink level by level. Only variants that two different lines
share go on to the next level, so most lines emit four hashed keys and none emits n.

At the last level the lines of one variant are pairwise within one edit, so each is compared with
the earliest only; no pairs within a group are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fenced, packed, staged

#: Shorter lines (trimmed) are left alone: one edit says little about them.
MIN_CHARS = 20
#: Windows that a level cuts a window into.
FAN_OUT = 16


def _occurrences(docs: DataFrame) -> DataFrame:
    """Trimmed lines of at least ``MIN_CHARS`` with the place ``at`` = (doc_id, text hash, number)."""
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    lines = texts.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x))).alias("number", "line"),
    ).where(F.length("line") >= MIN_CHARS)
    return lines.select(
        F.struct("doc_id", "text_hash", "number").alias("at"), F.unhex(F.md5("line")).alias("id"), "line"
    )


def _cut(level: DataFrame, pieces: int) -> DataFrame:
    """Variants of each window: one of its smaller windows is cut out.

    ``size`` is the length of the window in the longer line of a pair; the window of a ``short``
    line has one character less, and so has the part that is cut from it.
    """
    width = F.ceil(F.col("size") / pieces).cast("int")
    stepped = level.withColumn("width", width).select(
        "*",
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / F.col("width")).cast("int") - 1)).alias("j"),
    )
    start = F.col("j") * F.col("width")
    inner = F.least(F.col("width"), F.col("size") - start)
    taken = inner - F.col("short").cast("int")
    return stepped.select(
        "id",
        "short",
        inner.alias("size"),
        F.xxhash64(
            "key", "j",
            F.substring(F.col("window"), F.lit(1), start),
            F.substring(F.col("window"), start + taken + 1, F.length("window")),
        ).alias("key"),
        F.substring(F.col("window"), start + 1, taken).alias("window"),
    )


def _roots(lines: DataFrame) -> DataFrame:
    """Every line twice: beside lines of its length, and as the shorter of a pair."""
    roles = F.explode(F.array(F.lit(False), F.lit(True))).alias("short")
    return lines.select("id", "line", roles).select(
        "id",
        "short",
        (F.length("line") + F.col("short").cast("int")).alias("size"),
        F.xxhash64(F.length("line") + F.col("short").cast("int")).alias("key"),
        F.col("line").alias("window"),
    )


def _half_keys(line: Column) -> Column:
    """The keys that ``_cut(_roots(line), 2)`` gives a line, as an array."""
    out = []
    for short in (0, 1):
        size = F.length(line) + short
        width = F.ceil(size / 2).cast("int")
        root = F.xxhash64(size)
        for j in (0, 1):
            start = F.lit(j) * width
            taken = F.least(width, size - start) - short
            out.append(
                F.xxhash64(
                    root, F.lit(j),
                    F.substring(line, F.lit(1), start),
                    F.substring(line, start + taken + 1, F.length(line)),
                )
            )
    return F.array(*out)


def _shared(level: DataFrame) -> DataFrame:
    """Rows whose key belongs to at least two different lines."""
    line = F.xxhash64("id")
    counts = level.groupBy("key").agg(F.min(line).alias("a"), F.max(line).alias("b")).where("a <> b")
    return level.join(counts.select("key"), "key", "left_semi")


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Ids of distinct lines with an earlier line exactly one edit away.

    ``lines`` has ``id``, ``first`` and ``keys`` of each distinct line.
    """
    keys = lines.select("id", F.explode("keys").alias("key"))
    ids = _shared(keys).select("id").distinct()
    # One text for each surviving line: that of its first place.
    survivors = lines.join(ids, "id", "left_semi").select("id", F.col("first").alias("at"))
    found = _occurrences(docs).join(survivors, ["at", "id"], "left_semi").dropDuplicates(["id"])
    texts = staged(found.select("id", "at", "line"), "line-texts")
    level = staged(_shared(_cut(_roots(texts.select("id", "line")), 2)), "line-variants")
    done = None
    while True:
        longest = level.agg(F.max("size")).first()[0]
        single = level.where("size = 1")
        done = single if done is None else done.unionByName(single)
        if longest is None or longest == 1:
            break
        level = staged(_shared(_cut(level.where("size > 1"), FAN_OUT)), "line-variants")
    placed = done.select("id", "key").distinct().join(texts.select("id", "at"), "id")
    first = placed.groupBy("key").agg(F.min(F.struct("at", "id")).alias("lead"))
    pairs = placed.join(first, "key").where(F.col("at") > F.col("lead.at"))
    pairs = pairs.select("id", F.col("lead.id").alias("lead")).distinct()
    checked = (
        pairs.join(texts.select("id", "line"), "id")
        .join(texts.select(F.col("id").alias("lead"), F.col("line").alias("other")), "lead")
        .where(F.levenshtein("line", "other", 1) >= 0)
    )
    return checked.select("id").distinct()


def kept_places(docs: DataFrame) -> DataFrame:
    """Per document (``doc_id``, ``text_hash``): numbers of the kept lines, and how many were near.

    A document without kept long lines has no row.
    """
    distinct = _occurrences(docs).groupBy("id").agg(
        F.min("at").alias("first"), F.min(_half_keys(F.col("line"))).alias("keys")
    )
    lines = staged(distinct, "lines")
    near = near_lines(docs, lines).withColumn("near", F.lit(True))
    judged = lines.select("id", "first").join(near, "id", "left")
    return judged.groupBy("first.doc_id", "first.text_hash").agg(
        F.collect_list(F.when(F.col("near").isNull(), F.col("first.number"))).alias("keep"),
        F.count("near").alias("n_near"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``doc`` (the row's columns as a struct) with its cleaned ``text`` and line counts.

    A line of at least ``MIN_CHARS`` trimmed characters is dropped if an earlier line (by doc_id,
    then number) equals it or lies within one edit; shorter and blank lines stay. Null and empty
    texts stay as they are. Rows repeated with the same id and text count as one document, and
    each keeps the same lines; rows of one id with different texts are ordered by a hash of the
    text. Counts are longs: ``n_lines``, ``n_long``, ``n_kept`` (long lines kept), ``n_near``.
    """
    marks = kept_places(docs).select(
        F.col("doc_id").alias("mark_id"), F.col("text_hash").alias("mark_hash"), "keep", "n_near"
    )
    text = F.col("doc")["text"]
    base = packed(docs, "doc_id").withColumn("text_hash", F.xxhash64(text))
    both = base.join(
        marks, F.col("doc_id").eqNullSafe(F.col("mark_id")) & (F.col("text_hash") == F.col("mark_hash")), "left"
    )
    # Markers sort right before the line they keep; a long line without one is dropped.
    merged = both.select(
        "doc", text.alias("text"), "n_near",
        F.size(F.coalesce("keep", F.expr("cast(array() as array<int>)"))).cast("long").alias("n_kept"),
        F.sort_array(
            F.concat(
                F.transform(
                    F.split(text, "\n", -1),
                    lambda x, i: F.struct(i.alias("i"), F.lit(1).alias("kind"), x.alias("line")),
                ),
                F.transform(
                    F.coalesce("keep", F.expr("cast(array() as array<int>)")),
                    lambda i: F.struct(i.alias("i"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("line")),
                ),
            )
        ).alias("marked"),
    )
    left = F.filter(
        "marked",
        lambda m, k: (m["kind"] == 1)
        & (
            (F.length(F.trim(m["line"])) < MIN_CHARS)
            | F.coalesce((F.get("marked", k - 1)["kind"] == 0), F.lit(False))
        ),
    )
    long_lines = F.filter("marked", lambda m: (m["kind"] == 1) & (F.length(F.trim(m["line"])) >= MIN_CHARS))
    zero = F.lit(0).cast("long")
    return fenced(merged, ["doc"], [
        F.when(F.col("text").isNotNull(), F.array_join(F.transform(left, lambda m: m["line"]), "\n")).alias("text"),
        (F.coalesce(F.size("marked").cast("long"), zero) - F.col("n_kept")).alias("n_lines"),
        F.coalesce(F.size(long_lines).cast("long"), zero).alias("n_long"),
        F.col("n_kept"),
        F.coalesce("n_near", zero).cast("long").alias("n_near"),
    ])


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs``, same columns, with cleaned texts; ``n_chars``, if there, follows the text.

    Documents that lost lines and have no word left go; those that had none before stay.
    """
    cleaned = dedup_lines(docs)
    emptied = (F.col("n_kept") < F.col("n_long")) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = cleaned.where(~F.coalesce(emptied, F.lit(False)))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("text"))
        elif name == "n_chars":
            kept = F.col("doc")["n_chars"]
            kind = docs.schema["n_chars"].dataType
            columns.append(F.when(kept.isNotNull(), F.length("text")).cast(kind).alias(name))
        else:
            columns.append(F.col("doc")[name].alias(name))
    return rows.select(*columns)
