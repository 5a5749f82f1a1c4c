"""Quality classifier: perplexity under a Kneser-Ney model of the words of trusted text.

The model is an interpolated modified Kneser-Ney model of words, two at a time; its counts grow
with the trusted text. Each language has two, of one half of the trusted documents each, and a
document is read by the one that did not count its half: its own words tell nothing about it. A document's bits are a sum of one number for
each of its words and pairs, so the documents' words and pairs, counted by block of documents, are
joined with the model by their 64-bit hashes and summed up. Words that trusted text does not have
are spelled by a second Kneser-Ney model, of 64 symbols (letters, classes of other characters),
three at a time, which has at most 64**3 numbers a language. The limit is a quantile of the trusted
documents of the language.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, staged, staged_alone

LANGUAGES = ("en", "fr", "de", "es")
OTHER = "other"
ORDER, SYMBOLS = 3, 64
#: A document is kept up to this quantile of the trusted documents, and from the opposite one.
QUANTILE = 0.998
#: Bits per symbol that one symbol may deviate; the mean of n deviates by its root.
SLACK = 4.0
#: Texts of fewer symbols are kept: nothing can be said of them.
MIN_SYMBOLS = 20
#: Documents and characters of a block, whose equal words and pairs go to the model together.
BLOCK_DOCS, BLOCK_CHARS = 4096, 8 << 20
#: Characters of all texts for which there is one shard of the words and pairs.
SHARD_CHARS = 1 << 28
#: Parts of the documents and of the shards that are on disk one after the other.
ROUNDS, PARTS = 4, 4
#: Bits are summed as whole numbers of this part, so that no order of the sum shows.
UNIT = 1 << 20

# Words are runs of letters and digits, or single other characters.
_WORDS = re.compile(r"\w+|[^\w\s]")
_PAIR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# Symbols. 0 starts a text, 1 is white space, 2 a digit, 3 an upper-case letter.
_SMALL = "abcdefghijklmnopqrstuvwxyz" + "àâçèéêëîïôöùûüäßñáíóúœæ"
_MARKS = (".", ",", ";", ":", "!", "?", "'’", '"“”', "-–—", "()[]{}")
_REST = SYMBOLS - 1


def _symbol_table() -> np.ndarray:
    table = np.full(0x2100, _REST, dtype=np.int64)
    for code in range(len(table)):
        if (char := chr(code)).isdigit():
            table[code] = 2
        elif char.isupper():
            table[code] = 3
        elif char.isspace():
            table[code] = 1
    for k, char in enumerate(_SMALL, 4):
        table[ord(char)] = k
    for k, chars in enumerate(_MARKS, 4 + len(_SMALL)):
        for char in chars:
            table[ord(char)] = k
    return table


_TABLE = _symbol_table()


def symbols(text: str | None) -> np.ndarray:
    """Symbols of a text; a run of white space is one, and none stands at the ends."""
    codes = np.frombuffer((text or "").strip().encode("utf-32-le", "replace"), dtype="<u4")
    out = np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], _REST)
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = ~((out[1:] == 1) & (out[:-1] == 1))
    return out[keep]


def grams(text: str | None) -> np.ndarray:
    """Number of the three symbols that end at each symbol; two starts stand before the first."""
    s = np.concatenate([[0, 0], symbols(text)])
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def language(lang: Column) -> Column:
    return F.when(lang.isin(*LANGUAGES), lang).otherwise(OTHER)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for name, text in zip(batch.column("language"), batch.column("text"), strict=True):
            total = totals.setdefault(name.as_py(), np.zeros(SYMBOLS**ORDER, dtype=np.int64))
            found, counts = np.unique(grams(text.as_py()), return_counts=True)
            total[found] += counts
    for name, total in totals.items():
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(held)), pa.array(held), pa.array(total[held])], names=["language", "gram", "n"]
        )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of documents all of whose labels say good and not toxic."""
    judged = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return judged.where("doc_id is not null and q = 1 and t = 0").select("doc_id")


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``language``, ``text`` of the trusted documents that have a text."""
    rows = docs.select("doc_id", language(F.col("lang")).alias("language"), "text").where("text is not null")
    # One plan at every size: texts and ids are dealt by id, never sent around.
    return rows.join(trusted_ids(labels).hint("shuffle_hash"), "doc_id", "left_semi")


def count_grams(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``language``, ``gram``, ``n`` over all trusted documents; each task sums its own first."""
    return _gram_counts(trusted_texts(docs, labels))


def _gram_counts(texts: DataFrame) -> DataFrame:
    counted = texts.select("language", "text").mapInArrow(_count, "language string, gram bigint, n bigint")
    return counted.groupBy("language", "gram").agg(F.sum("n").alias("n"))


def model_name(half: int) -> Column:
    """Name of the word model of a row's language and half (0), or of the other half (1)."""
    own = F.pmod(F.xxhash64(F.col("doc_id").cast("long")) + half, F.lit(2))
    return F.concat_ws("/", "language", own.cast("string"))


def word_hash(name: str, word: str) -> int:
    """Hash of a word of a model; the empty word starts a text and a blank ends it."""
    key = hashlib.blake2b(f"{name} {word}".encode("utf-8", "replace"), digest_size=8).digest()
    return int.from_bytes(key, "little")


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashed words."""
    out = first * _PAIR + (second ^ (second >> np.uint64(29))) * _MIX
    return out ^ (out >> np.uint64(32))


class _Ids(dict):
    """Numbers of the words of one model; ``keys`` lists those of all models of a block."""

    def __init__(self, name: str, keys: list[tuple[str, str]]) -> None:
        super().__init__()
        self.name, self.keys_of_all = name, keys

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.keys_of_all)
        self.keys_of_all.append((self.name, word))
        return number


class _Block:
    """Words of a block of documents as numbers, with a start and an end for every text."""

    def __init__(self) -> None:
        self.keys: list[tuple[str, str]] = []
        self.ids: dict[str, _Ids] = {}
        self.lines: list[np.ndarray] = []
        self.heads: list[tuple] = []
        self.chars = 0

    def add(self, name: str, text: str | None, head: tuple) -> None:
        ids = self.ids.get(name)
        if ids is None:
            ids = self.ids[name] = _Ids(name, self.keys)
        words = ("", *_WORDS.findall(text or ""), " ")
        self.lines.append(np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words)))
        self.heads.append(head)
        self.chars += len(text or "")

    def full(self) -> bool:
        return len(self.lines) >= BLOCK_DOCS or self.chars >= BLOCK_CHARS

    def hashes(self) -> np.ndarray:
        return np.array([word_hash(*key) for key in self.keys], dtype=np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch], tables: dict[str, np.ndarray] | None = None) -> Iterator[_Block]:
    """Blocks of the rows; with ``tables`` heads of doc_id, model, symbols and their mean bits."""
    block = _Block()
    for batch in batches:
        ids = [None] * batch.num_rows if tables is None else batch.column("doc_id")
        for doc_id, name, text in zip(ids, batch.column("model"), batch.column("text"), strict=True):
            name, text, head = name.as_py(), text.as_py(), ()
            if tables is not None:
                found, bits = grams(text), tables.get(name.split("/")[0])
                mean = float(bits[found].mean(dtype=np.float64)) if bits is not None and len(found) else None
                head = (doc_id.as_py(), name, len(found), mean)
            block.add(name, text, head)
            if block.full():
                yield block
                block = _Block()
    if block.lines:
        yield block


def shard_bits(docs: DataFrame) -> int:
    """Bits of a hash that name its shard: there are as many shards as the texts ask for, 64 at least."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(6, (chars // SHARD_CHARS).bit_length())


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, the first byte of each, the second of each, and so on."""
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return len(flat).to_bytes(8, "little") + pa.compress(flat, codec="zstd", asbytes=True)


def _unpack(cell: bytes, kind: str) -> np.ndarray:
    size, width = int.from_bytes(cell[:8], "little"), np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(cell[8:], size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(width, size // width).T).view(kind).reshape(-1)


_PAIR_KINDS = {"words": "<u8", "v": "<u4", "w": "<u4", "n": "<i8"}
_PAIR_COLUMNS = ("model", "shard", *_PAIR_KINDS)
_PAIR_ROWS = "model string, shard int, words binary, v binary, w binary, n binary"


def _pack_pairs(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> dict[str, bytes]:
    """Pairs of hashed words: the words once, in order, and the places of both words and the count of each pair."""
    words, places = np.unique(np.concatenate([v, w]), return_inverse=True)
    places = places.reshape(-1).astype("<u4")
    first, second = places[: len(v)], places[len(v) :]
    order = np.lexsort((second, first))
    cells = {"words": words.astype("<u8"), "v": first[order], "w": second[order], "n": n[order].astype("<i8")}
    return {k: _pack(x) for k, x in cells.items()}


def _unpack_pairs(row: dict) -> list[np.ndarray]:
    return [_unpack(row[k], kind) for k, kind in _PAIR_KINDS.items()]


def _count_pairs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("model", pa.string()), ("shard", pa.int32()), *((k, pa.binary()) for k in _PAIR_KINDS)])
    for block in _blocks(batches):
        keys, size = block.keys, len(block.keys)
        first = np.concatenate([line[:-1] for line in block.lines])
        second = np.concatenate([line[1:] for line in block.lines])
        found, counts = np.unique(first * size + second, return_counts=True)
        at = block.hashes()
        v, w = at[found // size], at[found % size]
        models: dict[str, int] = {}
        of_word = np.array([models.setdefault(key[0], len(models)) for key in keys], dtype=np.int64)
        names = list(models)
        part = (of_word[found // size] << bits) + (_pairs(v, w) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rows = []
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            k = int(part[own[0]])
            rows.append({"model": names[k >> bits], "shard": k & ((1 << bits) - 1), **_pack_pairs(v[own], w[own], counts[own])})
        yield pa.RecordBatch.from_pylist(rows, schema)


def _merge_pairs(rows: pa.Table) -> pa.Table:
    """Counts of the blocks of a shard and model as one row, with the numbers of pairs counted one to four times."""
    parts = []
    for row in rows.to_pylist():
        words, v, w, n = _unpack_pairs(row)
        parts.append((words[v], words[w], n))
    v, w, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, at, same = np.unique(_pairs(v, w), return_index=True, return_inverse=True)
    total = np.zeros(len(at), dtype=np.int64)
    np.add.at(total, same.reshape(-1), n)
    kinds = {f"t{k}": int((total == k).sum()) for k in range(1, 5)}
    head = rows.select(["model", "shard"]).slice(0, 1).to_pylist()[0]
    kept = [("model", pa.string()), ("shard", pa.int32()), *((k, pa.binary()) for k in _PAIR_KINDS), *((k, pa.int64()) for k in kinds)]
    return pa.Table.from_pylist([{**head, **_pack_pairs(v[at], w[at], total), **kinds}], pa.schema(kept))


def count_pairs(texts: DataFrame, bits: int = 6) -> DataFrame:
    """A row for each ``model`` and ``shard`` with the packed counts of its pairs of hashed words.

    A pair lies in the shard that the first ``bits`` of its hash name. ``t1`` to ``t4`` are the
    numbers of pairs counted so many times.
    """
    counted = texts.select("model", "text").mapInArrow(lambda batches: _count_pairs(batches, bits), _PAIR_ROWS)
    kinds = ", ".join(f"t{k} bigint" for k in range(1, 5))
    return counted.groupBy("model", "shard").applyInArrow(_merge_pairs, f"{_PAIR_ROWS}, {kinds}")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word of a shard: its occurrences before others, the words seen after it once, twice
    and more often, and the words seen before it."""
    for batch in batches:
        for row in batch.to_pylist():
            words, v, w, n = _unpack_pairs(row)
            size = len(words)
            total = np.zeros(size, dtype=np.int64)
            np.add.at(total, v, n)
            after = [np.bincount(v[x], minlength=size) for x in (n == 1, n == 2, n > 2)]
            cells = [words.view(np.int64), total, *after, np.bincount(w, minlength=size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["model"]] * size), *(pa.array(x) for x in cells)],
                names=["model", "word", "total", "after1", "after2", "after3", "n"],
            )


def _words_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            words = _unpack(row["words"], "<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["model"]] * len(words)), pa.array(np.full(len(words), row["shard"], dtype=np.int32)), pa.array(words)],
                names=["model", "shard", "word"],
            )


_MODEL = pa.schema([("model", pa.string()), ("shard", pa.int32()), ("grams", pa.binary()), ("weights", pa.binary())])


def _units(bits: np.ndarray) -> np.ndarray:
    return np.round(bits * UNIT).astype("<i4")


def _weigh(row: pa.Table, values: pa.Table) -> pa.Table:
    """Weights of the pairs of a shard and model, from the values of their words."""
    own = row.to_pylist()[0]
    words, v, w, n = _unpack_pairs(own)
    order = np.argsort(values.column("word").to_numpy().view(np.uint64))
    p, given = (values.column(c).to_numpy()[order] for c in ("p", "given"))
    off = np.array([0.0, own["d1"], own["d2"], own["d3"]])[np.minimum(n, 3)]
    weights = -np.log2(1 + (n - off) / (given[v] * p[w]))
    grams = _pairs(words[v], words[w])
    order = np.argsort(grams)
    cells = {"model": own["model"], "shard": own["shard"], "grams": _pack(grams[order]), "weights": _pack(_units(weights[order]))}
    return pa.Table.from_pylist([cells], _MODEL)


def _pack_words(rows: pa.Table) -> pa.Table:
    grams = rows.column("word").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    weights = _units(rows.column("single").to_numpy()[order])
    head = rows.select(["model", "shard"]).slice(0, 1).to_pylist()[0]
    return pa.Table.from_pylist([{**head, "grams": _pack(grams[order]), "weights": _pack(weights)}], _MODEL)


def word_model(pairs: DataFrame, bits: int = 6) -> tuple[DataFrame, DataFrame]:
    """Packed ``grams`` and ``weights`` of the words and pairs of each ``model`` and ``shard``, and ``model``, ``unknown``.

    The bits of a text are the sum over its words of ``unknown`` and the bits of their spelling, and
    over its words and pairs that are in the model of their weights, where a word's weight takes
    ``unknown`` back (what finds a word takes back its spelling). A seen pair (v, w) has the
    probability share(v, w) + back(v) x p(w), any other back(v) x p(w), so what a word adds as the
    context of others is a part of its own weight, and that of a pair is what being seen saves:
    log2 of 1 + (n - off) / (given(v) x p(w)), where given(v) is what the pairs of v gave up. Pairs meet the
    values of their words a part of the shards at a time.
    """
    bits_of = lambda c: -F.log2(c)
    discounts = _discounts(pairs.groupBy("model").agg(*(F.sum(f"t{k}").alias(f"t{k}") for k in range(1, 5))), "model")
    discounts = staged(discounts, "pair-discounts")
    columns = ("total", "after1", "after2", "after3", "n")
    counted = pairs.select(*_PAIR_COLUMNS).mapInArrow(_word_counts, "model string, word bigint, " + ", ".join(f"{c} bigint" for c in columns))
    words = staged_alone(counted.groupBy("model", "word").agg(*(F.sum(c).alias(c) for c in columns)), "word-counts")
    seen = _smoothed(words.where("n > 0").withColumn("context", F.lit(0).cast("long")), "context", "model")
    one = staged_alone(seen.drop("context"), "word-shares")
    # The start of texts comes after no word.
    starts = words.where("n = 0").withColumns({c: F.lit(None).cast("double") for c in ("share", "back")})
    unknown = staged(one.groupBy("model").agg(bits_of(F.max("back")).alias("unknown")), "unknown")
    # One row per model: at most 2 x (len(LANGUAGES) + 1).
    every = one.unionByName(starts).join(F.broadcast(unknown), "model").join(F.broadcast(discounts), "model")
    given = F.col("after1") * F.col("d1") + F.col("after2") * F.col("d2") + F.col("after3") * F.col("d3")
    single = F.coalesce(bits_of(F.col("share")) - F.col("unknown"), F.lit(0.0)) + F.when(
        F.col("total") > 0, bits_of(given / F.col("total"))
    ).otherwise(0.0)
    values = staged(every.select("model", "word", single.alias("single"), F.col("share").alias("p"), given.alias("given")), "word-values")
    for done in (words, one):
        dropped(done)
    shard = F.shiftrightunsigned("word", 64 - bits).cast("int").alias("shard")
    rows = "model string, shard int, grams binary, weights binary"
    parts = [staged_alone(values.select("model", shard, "word", "single").groupBy("model", "shard").applyInArrow(_pack_words, rows), "word-weights")]
    for part in range(PARTS):
        own = pairs.where(F.col("shard") % PARTS == part).select(*_PAIR_COLUMNS)
        asked = own.select("model", "shard", "words").mapInArrow(_words_asked, "model string, shard int, word bigint")
        answers = asked.join(values.select("model", "word", "p", "given"), ["model", "word"])
        dealt = own.join(F.broadcast(discounts), "model").groupBy("model", "shard")
        weighed = dealt.cogroup(answers.groupBy("model", "shard")).applyInArrow(_weigh, rows)
        parts.append(staged_alone(weighed, "pair-weights"))
    dropped(values)
    model = parts[0]
    for each in parts[1:]:
        model = model.unionByName(each)
    return model, unknown


def _discounts(kinds: DataFrame, model: str) -> DataFrame:
    """``d1`` to ``d3`` of each model from ``t1`` to ``t4``, its numbers of rows with such counts."""
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    for_count = [
        F.when((F.col(f"t{k}") > 0) & (F.col("t1") > 0), k - (k + 1) * y * F.col(f"t{k + 1}") / F.col(f"t{k}")).otherwise(0.5)
        for k in (1, 2, 3)
    ]
    bounds = [F.least(F.greatest(d, F.lit(0.05)), F.lit(k - 0.05)) for k, d in enumerate(for_count, 1)]
    return kinds.select(model, *(b.alias(f"d{k}") for k, b in enumerate(bounds, 1)))


def _smoothed(counts: DataFrame, context: str, model: str = "language") -> DataFrame:
    """``share`` of each row left after its discount, and ``back``, the mass its context gives up.

    ``counts`` has ``model``, ``context`` and n; discounts are those of modified Kneser-Ney, from
    the numbers of rows with counts of one to four in the model. Missing ones give a discount
    of a half.
    """
    kinds = counts.groupBy(model).agg(
        *(F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"t{k}") for k in range(1, 5))
    )
    discounts = _discounts(kinds, model)
    each = counts.join(discounts, model).withColumn(
        "off", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    )
    sums = each.groupBy(model, context).agg(F.sum("n").alias("all"), F.sum("off").alias("given"))
    return each.join(sums, [model, context]).select(
        *counts.columns, ((F.col("n") - F.col("off")) / F.col("all")).alias("share"), (F.col("given") / F.col("all")).alias("back")
    )


def kneser_ney(counts: DataFrame) -> DataFrame:
    """Model rows ``language``, ``size`` (1 to 3), ``gram``, ``share``, ``back`` from trigram counts.

    The probability of a gram is its share plus its context's ``back`` times the probability of
    the gram without its first symbol; the shorter orders count the different symbols before.
    """
    three = counts.select("language", "gram", "n", F.expr(f"gram div {SYMBOLS}").alias("context"))
    two = three.groupBy("language", (F.col("gram") % SYMBOLS**2).alias("gram")).agg(F.count("*").alias("n"))
    two = two.withColumn("context", F.expr(f"gram div {SYMBOLS}"))
    one = two.groupBy("language", (F.col("gram") % SYMBOLS).alias("gram")).agg(F.count("*").alias("n"))
    one = one.withColumn("context", F.lit(0).cast("long"))
    rows = None
    for size, level in ((1, one), (2, two), (3, three)):
        made = _smoothed(level, "context").select("language", F.lit(size).alias("size"), "gram", "share", "back")
        rows = made if rows is None else rows.unionByName(made)
    return rows


def tables(model: DataFrame) -> dict[str, np.ndarray]:
    """Bits of every gram by language. At most 5 x (64 + 64**2 + 64**3) model rows are read."""
    out = {}
    rows = model.toPandas()
    for name, own in rows.groupby("language"):
        lower = np.full(1, 1 / SYMBOLS)
        for size in (1, 2, 3):
            level = own[own["size"] == size]
            at = level["gram"].to_numpy()
            share, back = np.zeros(SYMBOLS**size), np.ones(SYMBOLS ** (size - 1))
            share[at] = level["share"].to_numpy()
            back[at // SYMBOLS] = level["back"].to_numpy()
            tail = np.arange(SYMBOLS**size) % max(SYMBOLS ** (size - 1), 1)
            lower = share + np.repeat(back, SYMBOLS) * lower[tail]
        out[name] = -np.log2(lower).astype(np.float32)
    return out


def _spelled(keys: list[tuple[str, str]], tables: dict[str, np.ndarray]) -> np.ndarray:
    """Bits of the symbols of each word and of its end; none for the starts and ends of texts."""
    out = np.zeros(len(keys))
    named: dict[str, list[int]] = {}
    for i, (own, word) in enumerate(keys):
        if word.strip():
            named.setdefault(own, []).append(i)
    for own, at in named.items():
        bits = tables.get(own.split("/")[0])
        if bits is None:
            continue
        s = np.concatenate([[0, 1], symbols(" ".join(keys[i][1] for i in at)), [1]])
        before = np.where(s[1:-1] == 1, 0, s[:-2])
        each = bits[(before * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]].astype(np.float64)
        starts = np.flatnonzero(s[1:-1] == 1)
        out[at] = np.add.reduceat(each, starts)
    return out


_ROWS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("grams", "spelled", "sizes", "places", "head"))]
)
_SUMS = pa.schema([("block", pa.int64()), ("head", pa.bool_()), ("body", pa.binary())])
_HEADS = pa.schema(
    [("doc_id", pa.int64()), ("model", pa.string()), ("n_symbols", pa.int64()), ("symbol_bits", pa.float64()), ("n_words", pa.int64()), ("spelled", pa.float64())]
)


def _requests(batches: Iterator[pa.RecordBatch], tables, bits: int) -> Iterator[pa.RecordBatch]:
    """A row for every shard of a block: its words and pairs there, and the places of their documents.

    One more row holds the block's documents.
    """
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    for number, block in enumerate(_blocks(batches, tables.value)):
        name = (TaskContext.get().partitionId() << 32) + number
        keys, at = block.keys, block.hashes()
        spelled = np.round(_spelled(keys, tables.value) * UNIT).astype(np.int64)
        lengths = [len(line) for line in block.lines]
        doc = np.repeat(np.arange(len(lengths), dtype="<u2"), lengths)
        words = np.concatenate(block.lines)
        sums = np.add.reduceat(spelled[words], np.cumsum([0, *lengths[:-1]])) / UNIT
        heads = [
            (*head, n - 1, float(total))
            for head, n, total in zip(block.heads, lengths, sums, strict=True)
        ]
        table = pa.RecordBatch.from_pylist([dict(zip(_HEADS.names, h, strict=True)) for h in heads], _HEADS)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HEADS) as out:
            out.write_batch(table)
        rows = [{"shard": name % (1 << bits), "block": name, "head": sink.getvalue().to_pybytes()}]
        inner = np.ones(len(words), dtype=bool)
        inner[np.cumsum(lengths) - 1] = False
        left = np.flatnonzero(inner)
        grams = np.concatenate([at[words], _pairs(at[words[left]], at[words[left + 1]])])
        order = np.argsort(grams)
        grams = grams[order]
        starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        sizes = np.diff(starts, append=len(order)).astype("<u4")
        places = np.concatenate([doc, doc[left]])[order]
        first = order[starts]
        asked = np.zeros(len(first), dtype="<i8")
        single = first < len(words)
        asked[single] = spelled[words[first[single]]]
        grams = grams[starts]
        cuts = [0, *np.searchsorted(grams, edges).tolist(), len(grams)]
        ends = np.append(starts, len(places))
        for shard, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b:
                cells = {"grams": grams[a:b], "spelled": asked[a:b], "sizes": sizes[a:b], "places": places[ends[a] : ends[b]]}
                rows.append({"shard": shard, "block": name, **{k: _pack(x) for k, x in cells.items()}})
        yield pa.RecordBatch.from_pylist(rows, _ROWS)


def _add_up(asked: pa.Table, model: pa.Table) -> pa.Table:
    """Sums of a shard's weights for each document of a block; rows of documents pass."""
    grams = np.concatenate([np.zeros(0, "<u8"), *(_unpack(x, "<u8") for x in model.column("grams").to_pylist())])
    weights = np.concatenate([np.zeros(0, "<i4"), *(_unpack(x, "<i4") for x in model.column("weights").to_pylist())])
    order = np.argsort(grams)
    grams, weights = grams[order], weights[order].astype(np.int64)
    rows = []
    for k in range(asked.num_rows):
        row = asked.slice(k, 1).to_pylist()[0]
        if row["head"] is not None:
            rows.append({"block": row["block"], "head": True, "body": row["head"]})
            continue
        own, spelled, sizes, places = (_unpack(row[c], kind) for c, kind in (("grams", "<u8"), ("spelled", "<i8"), ("sizes", "<u4"), ("places", "<u2")))
        at = np.searchsorted(grams, own)
        met = at < len(grams)
        met[met] = grams[at[met]] == own[met]
        each = np.zeros(len(own), dtype=np.int64)
        each[met] = weights[at[met]] - spelled[met]
        # Whole numbers far below 2**53, so the sums are exact.
        total = np.bincount(places, weights=np.repeat(each, sizes)).astype(np.int64)
        rows.append({"block": row["block"], "head": False, "body": _pack(total)})
    return pa.Table.from_pylist(rows, _SUMS)


def _of_block(rows: pa.Table) -> pa.Table:
    """Documents of a block with ``saved``, the bits that the model's words and pairs change."""
    total = np.zeros(BLOCK_DOCS, dtype=np.int64)
    heads = None
    for head, body in zip(rows.column("head").to_pylist(), rows.column("body").to_pylist(), strict=True):
        if head:
            heads = pa.ipc.open_stream(body).read_all()
        else:
            own = _unpack(body, "<i8")
            total[: len(own)] += own
    return heads.append_column("saved", pa.array(total[: len(heads)] / UNIT))


def word_bits(rows: DataFrame, tables, model: DataFrame, bits: int = 6) -> DataFrame:
    """``doc_id``, ``model``, ``n_symbols``, ``symbol_bits`` (the mean of the whole text under the model
    of symbols), ``n_words`` (ends of texts are words), ``spelled``, ``saved``.

    A part of the documents meets the model at a time, so that only its words and pairs are on disk;
    the documents that one half of the models reads meet no other models.
    """
    asked = "shard int, block bigint, grams binary, spelled binary, sizes binary, places binary, head binary"
    out = None
    for part in range(ROUNDS):
        half = F.col("model").endswith("/1") == F.lit(part % 2 == 1)
        dealt = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(ROUNDS // 2)) == part // 2
        wanted = rows.where(half & dealt).mapInArrow(lambda batches: _requests(batches, tables, bits), asked)
        met = wanted.groupBy("shard").cogroup(model.where(half).groupBy("shard"))
        summed = met.applyInArrow(_add_up, "block bigint, head boolean, body binary")
        done = staged_alone(
            summed.groupBy("block").applyInArrow(
                _of_block, "doc_id bigint, model string, n_symbols bigint, symbol_bits double, n_words bigint, spelled double, saved double"
            ),
            "word-bits",
        )
        out = done if out is None else out.unionByName(done)
    return out


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``language``, ``n_symbols``, ``perplexity``, ``kept`` of every row of ``docs``.

    The perplexity is that of a symbol: the bits of all words and of the text's end by the number
    of symbols. A document is kept if its mean bits per symbol, less ``SLACK`` by the root of its
    symbols, are at most the ``QUANTILE`` of the trusted documents of its language, and more that
    much again are at least the opposite quantile (endless repeats lie below); the same holds for its
    mean bits under the model of symbols alone, which reads what stands between the words. Null and
    empty texts have no perplexity and are not kept; texts of fewer than ``MIN_SYMBOLS`` symbols, and
    languages without trusted documents to count or to judge by, are kept unjudged.
    Unlisted and null languages are one language, ``other``. Repeated rows each keep a row; other
    columns are not read.
    """
    spark = docs.sparkSession
    shards = shard_bits(docs)
    trusted = staged_alone(trusted_texts(docs, labels), "trusted-texts")
    spelling = staged(kneser_ney(staged_alone(_gram_counts(trusted), "gram-counts")), "spelling")
    bits = spark.sparkContext.broadcast(tables(spelling))
    pairs = staged_alone(count_pairs(trusted.withColumn("model", model_name(0)), shards), "pair-counts")
    dropped(trusted)
    model, unknown = word_model(pairs, shards)
    dropped(pairs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language(F.col("lang")).alias("language"), "text")
    found = word_bits(rows.select("doc_id", model_name(1).alias("model"), "text"), bits, model, shards)
    dropped(model)
    # One row per model: at most 2 x (len(LANGUAGES) + 1).
    found = found.join(F.broadcast(unknown), "model", "left")
    total = F.col("spelled") + F.col("n_words") * F.col("unknown") + F.col("saved")
    scored = staged(
        found.select(
            "doc_id", F.substring_index("model", "/", 1).alias("language"), "n_symbols", "symbol_bits",
            F.when(F.col("n_symbols") > 0, total / F.col("n_symbols")).alias("bits"),
        ),
        "scores",
    )
    noise = SLACK / F.sqrt("n_symbols")
    judges = scored.where(F.col("n_symbols") >= MIN_SYMBOLS).join(trusted_ids(labels), "doc_id", "left_semi")
    means = ("bits", "symbol_bits")
    limits = judges.groupBy("language").agg(
        *(F.percentile_approx(F.col(c) - noise, QUANTILE, 100_000).alias(f"most_{c}") for c in means),
        *(F.percentile_approx(F.col(c) + noise, 1 - QUANTILE, 100_000).alias(f"least_{c}") for c in means),
    )
    # One row per language: at most len(LANGUAGES) + 1.
    judged = scored.join(F.broadcast(limits), "language", "left")
    one, two = (
        (F.col(c) - noise <= F.col(f"most_{c}")) & (F.col(c) + noise >= F.col(f"least_{c}")) for c in means
    )
    return judged.select(
        "doc_id", "language", "n_symbols", F.pow(F.lit(2.0), F.col("bits")).alias("perplexity"),
        F.when(F.col("n_symbols") == 0, False)
        .when((F.col("n_symbols") < MIN_SYMBOLS) | F.col("most_bits").isNull() | F.col("bits").isNull(), True)
        .otherwise(one & two).alias("kept"),
    )
