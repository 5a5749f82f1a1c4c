"""Mixing sources to target weights: every source gives exactly its budget of words.

Documents get a hash-random key and are sorted by range within their source; running sums of their
sizes tell which of them lie before the cut. A source whose budget is above its size is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged, words_of
from tidemark.llm.prefix import running_sums

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[float, ...] | DataFrame = WEIGHTS, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """``source``, ``rank``, ``source_size`` and ``target`` of each row (``source``, ``source_size``).

    The targets share ``share`` of all sizes by weight. None is above ``epochs`` times its source's
    size; what that leaves over is shared by weight among the others. So a target is the smaller of
    its limit and weight x level; the level follows from running sums in the order of limit / weight.
    Weights repeat over the sources by code point, null last, or come as a table (``source``,
    ``weight``); a source without a weight above zero has the target 0. No source, no row.
    """
    ranked = running_sums(
        sources.withColumn("one", F.lit(1).cast("long")), F.lit(0), [F.col("source").isNull(), F.col("source")], ["one"]
    ).withColumnRenamed("before_one", "rank")
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("s"), F.col("weight").cast("double").alias("weight"))
        ranked = ranked.join(given, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    else:
        turn = F.array(*(F.lit(float(w)) for w in weights))
        ranked = ranked.withColumn("weight", F.get(turn, F.pmod("rank", F.lit(len(weights))).cast("int")))
    ranked = staged(
        ranked.select(
            "source", "rank", "source_size", (F.col("source_size") * F.lit(float(epochs))).alias("most"),
            F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0).alias("weight"),
        ),
        "sources",
    )
    size, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    if not weight:
        return ranked.select("source", "rank", "source_size", F.lit(0.0).alias("target"))
    limit = F.col("most") / F.col("weight")
    filled = running_sums(ranked.where("weight > 0"), F.lit(0), [limit, F.col("rank")], ["most", "weight"])
    # The level if all sources with a lower limit are at it: too low until the right one, and lower again behind it.
    level = (F.lit(float(share)) * F.lit(size) - F.col("before_most")) / (F.lit(weight) - F.col("before_weight"))
    level = filled.select(F.max(F.when(level <= limit, level))).first()[0]
    target = F.col("most") if level is None else F.least(F.col("most"), F.lit(level) * F.col("weight"))
    target = F.when(F.col("weight") > 0, target).otherwise(0.0)
    return ranked.select("source", "rank", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] | DataFrame = WEIGHTS,
    share: float = 1.5,
    epochs: float = 2.0,
    seed: int = 0,
    carry: list[str] | None = None,
) -> DataFrame:
    """``doc`` (the columns ``carry``, all by default) and how often the mix takes the document.

    ``size`` is the number of words; ``copies`` whole ones and ``part`` words of one more are taken,
    ``taken`` words in all; ``source_size`` and ``target`` are those of the source. Of each source
    the words taken are its target, rounded down. The order within a source is that of the md5 of
    seed and doc_id, so reruns agree; rows of one id are ordered by size, then by a hash of the text.

    A null or empty text has no words and takes none; null sources are a source of their own; a null
    doc_id counts as an empty one; each repeated row is a document of its own. Texts of any length
    are only counted. Names in ``doc`` may clash with the ones here. An empty table gives no row.
    """
    carry = docs.columns if carry is None else carry
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = staged(
        docs.select(
            F.struct(*carry).alias("doc"), F.col("source"),
            F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"),
            key.alias("key"), F.xxhash64("doc_id", "text").alias("tie"),
        ).withColumn("size", F.coalesce("size", F.lit(0).cast("long"))),
        "sizes",
    )
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    wanted = wanted.withColumnRenamed("source", "of")
    known = rows.join(wanted, F.col("source").eqNullSafe(F.col("of"))).drop("source", "of")
    placed = running_sums(known, F.col("rank"), [F.col("key"), F.col("size"), F.col("tie")], ["size"])
    budget, whole = F.floor("target"), F.expr("floor(target) div source_size")
    copies = F.when(F.col("source_size") > 0, whole).otherwise(0).cast("long")
    rest = budget - copies * F.col("source_size") - F.col("before_size")
    part = F.greatest(F.lit(0).cast("long"), F.least("size", rest)).cast("long")
    return placed.select(
        "doc", "size", "source_size", "target", copies.alias("copies"), part.alias("part"),
        (copies * F.col("size") + part).alias("taken"),
    )


def mixture(mixed: DataFrame) -> DataFrame:
    """The mixed corpus: one row for each copy taken, with ``epoch`` (from 0) and ``text``.

    A whole copy has the text as it is; the one that a budget cuts has its first words, joined by
    single spaces; documents without words are left out. ``mixed`` is what ``mix`` returns, with ``text`` among the carried columns.
    """
    text: Column = F.col("doc.text")
    cut = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    many = F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)
    rows = mixed.where((many > 0) & (F.col("size") > 0)).select(
        "doc", "part", "copies", cut.alias("cut"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("epoch")
    )
    shortened = F.concat_ws(" ", F.slice(words_of(text), F.lit(1), F.col("part").cast("int")))
    last = F.col("cut") & (F.col("epoch") == F.col("copies"))
    return rows.select("doc", "epoch", F.when(last, shortened).otherwise(text).alias("text"))
