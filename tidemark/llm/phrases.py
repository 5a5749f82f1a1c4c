"""Phrase collocation mining over a dictionary of content-triggered chunks.

Texts are cut in front of words whose hash triggers, wherever they stand, so repeated passages give
equal chunks. A chunk also carries the next four words, so that every phrase of up to five words
lies whole in the chunk in which it begins, and only there it is counted. The distinct chunks with
their frequencies are the dictionary; phrases are counted in it, weighted, length by length: a
phrase can only be frequent if both phrases one word shorter are. What is known to be too rare is
kept out by a Bloom filter of fixed size; the counts themselves are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

LONGEST = 5
LEAST = 100
#: One word in so many begins a chunk.
SPACING = 24
#: Words that a chunk begins at most: bounds rows where no word triggers.
CHUNK = 512
#: Bits of a filter; its size is fixed, and a filter that is too full only lets more be counted.
FILTER_BITS = 1 << 27
#: Bits of a filter that are put together in one task.
BLOCK = 1 << 15
#: Characters that are worked on at a time in a task.
SLICE = 1 << 21

BREAK = "\n"
CHUNKS = "lang string, chunk string, own int, words int, n bigint"
COUNTS = "lang string, phrase string, n bigint"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _slices(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, in parts of about ``most`` bytes of text."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _hash(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def _flat(tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of lists that are not empty strings, and the row of each."""
    rows = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
    words = tokens.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), rows[full.to_numpy(zero_copy_only=False)]


def _cut(batches: Iterator[pa.RecordBatch], longest: int, spacing: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in _slices(whole, "text", SLICE)):
        text = pc.ascii_lower(batch.column("text").fill_null(""))
        text = pc.replace_substring_regex(text, r"[.,;:!?\n-\r]+", f" {BREAK} ")
        words, rows = _flat(pc.split_pattern_regex(text, r"[ \t]+"))
        if not len(words):
            continue
        coded = words.dictionary_encode()
        ids, kinds = coded.indices.to_numpy(), coded.dictionary
        is_break = pc.equal(kinds, BREAK).to_numpy(zero_copy_only=False)
        triggers = (_hash(kinds) % np.uint64(spacing) == 0) & ~is_break
        begins = triggers[ids]
        begins[0] = True
        begins[1:] |= rows[1:] != rows[:-1]
        starts = np.flatnonzero(begins)
        runs = np.diff(np.append(starts, len(ids)))
        # Runs without a trigger are cut by length.
        more = -(-runs // most)
        starts = np.repeat(starts, more) + most * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
        own = np.diff(np.append(starts, len(ids)))
        # The overlap: words of the same text behind the chunk, up to a break.
        blocked = np.append(is_break[ids], np.ones(longest, bool))
        row = np.append(rows, np.full(longest, -1))
        tail, reach = np.zeros(len(starts), dtype=np.int64), np.ones(len(starts), dtype=bool)
        for k in range(longest - 1):
            at = starts + own + k
            reach &= ~blocked[at] & (row[at] == rows[starts])
            tail += reach
        size = own + tail
        first = np.cumsum(size) - size
        take = np.arange(size.sum()) - np.repeat(first - starts, size)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, size.sum()), pa.int32()), words.take(pa.array(take)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("lang").take(pa.array(rows[starts])), pc.binary_join(lists, " "),
                pa.array(own, pa.int32()), pa.array(np.add.reduceat(~is_break[ids], starts, dtype=np.int32)),
                pa.array(np.ones(len(own), dtype=np.int64)),
            ],
            names=[c.split()[0] for c in CHUNKS.split(", ")],
        )


def dictionary(docs: DataFrame, longest: int = LONGEST, spacing: int = SPACING, most: int = CHUNK) -> DataFrame:
    """``lang``, ``chunk`` (words and breaks, joined by spaces), ``own`` tokens and ``words`` of it, ``n`` chunks."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    chunks = rows.mapInArrow(lambda batches: _cut(batches, longest, spacing, most), CHUNKS)
    return chunks.groupBy("lang", "chunk", "own", "words").agg(F.sum("n").alias("n"))


class _Filter:
    """Set of 64-bit hashes that may claim a few too many, in a fixed number of bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return keys % np.uint64(size), (keys * _ODD >> np.uint64(20)) % np.uint64(size)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        size = len(self.bits) * 8
        out = np.ones(len(keys), dtype=bool)
        for at in self.places(keys, size):
            out &= self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
        return out


def _chain(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of phrases with one word more."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * _ODD
    return (mixed ^ (mixed >> np.uint64(32))) + words


def _phrase_hash(langs: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    out = langs
    for word in words:
        out = _chain(out, word)
    return out


def _count(batches: Iterator[pa.RecordBatch], length: int, known: _Filter | None, size: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in _slices(whole, "chunk", size)):
        words, rows = _flat(pc.split_pattern(batch.column("chunk"), " "))
        coded = words.dictionary_encode()
        ids, kinds = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        is_break = pc.equal(kinds, BREAK).to_numpy(zero_copy_only=False)[ids]
        sizes = np.bincount(rows, minlength=batch.num_rows)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = batch.column("own").to_numpy()[rows]
        # Own beginnings whose words all lie in the chunk and on this side of the next break.
        at = np.flatnonzero((place < own) & (place + length <= sizes[rows]))
        for k in range(length):
            at = at[~is_break[at + k]]
        langs = batch.column("lang").dictionary_encode()
        if known is not None:
            hashes, of = _hash(kinds)[ids], _hash(langs.dictionary)[langs.indices.to_numpy()][rows]
            for shift in (0, 1):
                at = at[known.holds(_phrase_hash(of[at], [hashes[at + shift + k] for k in range(length - 1)]))]
        if not len(at):
            continue
        # Phrases as exact numbers, one word after the other; equal ones of the slice are summed.
        phrase = langs.indices.to_numpy().astype(np.int64)[rows[at]]
        for k in range(length):
            _, phrase = np.unique(phrase * len(kinds) + ids[at + k], return_inverse=True)
        weights = batch.column("n").to_numpy()[rows[at]]
        order = np.argsort(phrase, kind="stable")
        begins = np.flatnonzero(np.diff(phrase[order], prepend=-1))
        total, one = np.add.reduceat(weights[order], begins), at[order[begins]]
        flat = (one[:, None] + np.arange(length)).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(one) + 1) * length, pa.int32()), words.take(pa.array(flat)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang").take(pa.array(rows[one])), pc.binary_join(lists, " "), pa.array(total, pa.int64())],
            names=[c.split()[0] for c in COUNTS.split(", ")],
        )


def _places(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        words = pc.split_pattern(batch.column("phrase"), " ")
        parts = _hash(words.flatten()).reshape(batch.num_rows, -1)
        keys = _phrase_hash(_hash(batch.column("lang")), [parts[:, k] for k in range(parts.shape[1])])
        places = np.unique(np.concatenate(_Filter.places(keys, size)))
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64))], names=["at"])


def _block(key: tuple, group: pa.Table) -> pa.Table:
    bits = np.zeros(BLOCK // 8, dtype=np.uint8)
    at = group.column("at").to_numpy() % BLOCK
    np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return pa.table([[key[0].as_py()], [bits.tobytes()]], schema=pa.schema([("block", pa.int64()), ("bits", pa.binary())]))


def _filter(phrases: DataFrame, size: int) -> _Filter:
    """Filter of phrases of one length, made in the tasks; at most ``size`` bits reach the driver."""
    places = phrases.mapInArrow(lambda batches: _places(batches, size), "at bigint").distinct()
    blocks = places.groupBy(F.expr(f"at div {BLOCK}").alias("block"))
    made = blocks.applyInArrow(_block, "block bigint, bits binary").toArrow()
    bits = np.zeros((size // BLOCK, BLOCK // 8), dtype=np.uint8)
    for block, own in zip(made.column("block").to_pylist(), made.column("bits").to_pylist(), strict=True):
        bits[block] = np.frombuffer(own, dtype=np.uint8)
    return _Filter(bits.ravel())


def frequent_phrases(
    chunks: DataFrame, longest: int = LONGEST, least: int = LEAST, filter_bits: int = FILTER_BITS, slice_bytes: int = SLICE
) -> DataFrame:
    """``lang``, ``phrase``, ``length``, ``n`` of every phrase with at least ``least`` occurrences; all words' sum as length 0."""
    spark = chunks.sparkSession
    total = chunks.groupBy("lang").agg(F.sum(F.col("n") * F.col("words")).alias("n"))
    levels, known = [total.select("lang", F.lit("").alias("phrase"), F.lit(0).alias("length"), "n")], None
    for length in range(1, longest + 1):
        shared = spark.sparkContext.broadcast(known) if known else None
        counted = chunks.mapInArrow(
            lambda batches, k=length, b=shared: _count(batches, k, b.value if b else None, slice_bytes), COUNTS
        )
        counted = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        level = staged(
            counted.where(F.col("n") >= least).select("lang", "phrase", F.lit(length).alias("length"), "n"), "phrases"
        )
        levels.append(level)
        if length < longest:
            known = _filter(level, filter_bits)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _words(phrase: Column, start: Column | int, length: Column | int) -> Column:
    return F.concat_ws(" ", F.slice(F.split(phrase, " "), start, length))


def score(phrases: DataFrame, share: int = 100) -> DataFrame:
    """Candidates that stay: ``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Each phrase of two words or more is cut once behind each word; the cut with the lowest score
    floor(1000 a n / (l r)) counts, the first of equal ones. Phrases that lie in a longer one with at
    least ``share`` percent of their frequency go. Whole numbers of 38 digits.
    """
    total = phrases.where("length = 0").select("lang", F.col("n").alias("total"))
    held = phrases.where("length > 0").select("lang", "phrase", "length", "n")
    candidates = held.where("length > 1")
    cuts = candidates.select(
        "lang", "phrase", "length", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")
    )
    cuts = cuts.withColumn("left", _words(F.col("phrase"), 1, F.col("k"))).withColumn(
        "right", _words(F.col("phrase"), F.col("k") + 1, F.col("length"))
    )
    left = held.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = held.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    value = F.expr(
        "(CAST(a AS DECIMAL(19,0)) * CAST(total AS DECIMAL(19,0)) * 1000BD) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
    )
    valued = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(total, "lang").select(
        "lang", "phrase", "a", "total", F.struct(value.alias("score"), "k", "l", "r").alias("cut")
    )
    lowest = valued.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("total").alias("n"), F.min("cut").alias("cut"))
    inner = candidates.where("length > 2").select(
        "lang", F.col("phrase").alias("longer"), "n", "length", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("size")
    )
    inner = inner.select("lang", "longer", "n", "size", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", _words(F.col("longer"), F.col("at"), F.col("size")).alias("phrase"), "n")
    inner = inner.groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    hidden = F.coalesce(100 * F.col("around") >= share * F.col("a"), F.lit(False))
    return lowest.join(inner, ["lang", "phrase"], "left").where(~hidden).select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )


def top_phrases(scored: DataFrame, most: int = 2000, lanes: int = 64) -> DataFrame:
    """The first ``most`` phrases of each language with ``rank``, by falling score, falling ``a``, phrase.

    A language's phrases are ranked in ``lanes`` first, so none has them all in one task.
    """
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    lane = F.pmod(F.xxhash64("phrase"), F.lit(lanes)).alias("lane")
    first = scored.select("*", lane)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*order)))
    first = first.where(F.col("rank") <= most).drop("rank", "lane")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most: int = 2000) -> DataFrame:
    """Best phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``docs``: lang, text. A to Z become lower case; texts are split at ``.,;:!?``, line feeds and the
    like into pieces, and those at spaces and tabs into words. A null language is ``und``; a null or
    empty text has no words; repeated rows count as often as they occur; texts of any length are cut
    into chunks of bounded length. Ties are settled by phrase. An empty table gives no row; other
    columns are not read.
    """
    chunks = staged(dictionary(docs, longest), "chunks")
    return top_phrases(score(staged(frequent_phrases(chunks, longest, least), "frequent")), most).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
