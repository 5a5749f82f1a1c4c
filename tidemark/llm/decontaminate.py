"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of a window at most, dealt to blocks of bounded size. Each block gets a latent space: a randomised
SVD of the TF-IDF vectors of its passages, with document frequencies counted over the whole
corpus. Every window of every document is compared with every passage; windows that hold a part of its
own weight, whatever else they hold, or reach its cosine (``limits``) are candidates. The windows of
an item's passages are joined, and a longest common subsequence of words, each word weighing one
more than its inverse document frequency, then decides on the whole item, together with an answer
check for paraphrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shingles as S
from tidemark.llm.common import packed, staged
from tidemark.llm.frequencies import inverse_frequencies, slots

WINDOW, STRIDE = 48, 16
#: Part of a passage's squared weight that a window must hold to be a candidate. Where all words weigh
#: the same, a window that holds a part f of a passage of n words has a cosine of f x root(n / window).
PART = 0.4
#: Items of fewer words say too little to be looked for.
MIN_ITEM_WORDS = 8
#: Mean passages of a block, its rank, and blocks whose spaces are sent to the tasks at once.
BLOCK_ITEMS, RANK, BLOCKS_AT_ONCE = 192, 256, 8
POWER_STEPS = 2
#: Words of texts searched together, windows projected together, prepared items a task remembers.
WORDS_AT_ONCE, AT_ONCE, ITEMS_HELD = 1 << 15, 512, 4096
#: A near copy keeps this share of the item's words in order, weighted by rarity.
COPY = 0.8
#: A paraphrase keeps this share, and this share of the item's last words, its answer.
PARAPHRASE, ANSWER_WORDS, ANSWER = 0.5, 8, 0.75

SPACE = "block int, slots binary, basis binary, items binary, lengths binary, norms binary, latent binary"
FOUND = "doc_id bigint, id binary, item_row bigint, cosine double, region array<bigint>"


@dataclass(frozen=True)
class Space:
    """Latent space of a block: basis row of each slot, and the passages' unit vectors in it.

    ``items`` and ``lengths`` are those of the passages' whole items. A window is a candidate if its
    product with a passage's unit vector reaches ``parts``, or ``limits`` times the window's norm.
    ``held`` and ``near`` are the most that one word of a slot adds to the two quotients with any
    passage.
    """

    slots: np.ndarray
    basis: np.ndarray
    held: np.ndarray
    near: np.ndarray
    items: np.ndarray
    lengths: np.ndarray
    parts: np.ndarray
    limits: np.ndarray
    latent: np.ndarray


def _keys(text: str | None) -> np.ndarray:
    return S.words(text, plain=True)


def _fit(group: pa.Table, idf) -> pa.Table:
    """Randomised SVD of a block's TF-IDF matrix (passages x slots of its words).

    A row is passage ``part`` of ``parts`` of its item's text, the whole text without these columns.
    """
    order = [(c, "ascending") for c in ("item_row", "part") if c in group.column_names]
    rows, lengths = [], []
    for r in group.sort_by(order).to_pylist():
        words = _keys(r["text"])
        rows.append((r["item_row"], np.array_split(words, r.get("parts", 1))[r.get("part", 0)]))
        lengths.append((len(rows[-1][1]), len(words)))
    used = np.unique(np.concatenate([slots(w) for _, w in rows]))
    a = np.zeros((len(rows), len(used)), dtype=np.float64)
    for k, (_, w) in enumerate(rows):
        s = slots(w)
        np.add.at(a[k], np.searchsorted(used, s), idf.value[s])
    norms = np.maximum(np.linalg.norm(a, axis=1), 1e-12)
    a /= norms[:, None]
    rng = np.random.default_rng(8)
    y = a.T @ rng.standard_normal((len(rows), min(RANK, len(rows), len(used))))
    for _ in range(POWER_STEPS):
        y = a.T @ (a @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    _, values, right = np.linalg.svd(a @ q, full_matrices=False)
    basis = q @ right[values > 1e-9 * values[0]].T
    latent = a @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    cells = [
        used.astype("<i8"), basis.astype("<f4"), np.array([r for r, _ in rows], "<i8"),
        np.array(lengths, "<i8"), norms.astype("<f4"), latent.astype("<f4"),
    ]
    return pa.table(
        [pa.array([group.column("block")[0].as_py()], pa.int32()), *(pa.array([c.tobytes()]) for c in cells)],
        names=[c.split()[0] for c in SPACE.split(", ")],
    )


def _space(row) -> Space:
    used, items = np.frombuffer(row["slots"], "<i8"), np.frombuffer(row["items"], "<i8")
    basis = np.frombuffer(row["basis"], "<f4").reshape(len(used), -1)
    latent = np.frombuffer(row["latent"], "<f4").reshape(len(items), -1)
    own, lengths = np.frombuffer(row["lengths"], "<i8").reshape(-1, 2).T
    parts, least = PART * np.frombuffer(row["norms"], "<f4"), limits(own)
    adds = basis @ latent.T
    held, near = (np.maximum((adds / x).max(axis=1), 0) for x in (parts, least))
    return Space(used, basis, held, near, items, lengths, parts, least, latent)


def limits(lengths: np.ndarray) -> np.ndarray:
    """Cosine from which a window is a candidate for a passage of so many words."""
    return (PART * np.sqrt(np.minimum(lengths, WINDOW) / WINDOW)).astype(np.float32)


def _all_windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and last word of every window of texts that lie one behind the other."""
    free = np.maximum(lengths - WINDOW, 0)
    many = -(-free // STRIDE) + 1
    owner = np.repeat(np.arange(len(lengths)), many)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    base = (np.cumsum(lengths) - lengths)[owner]
    starts = base + np.minimum(number * STRIDE, free[owner])
    return owner, starts, np.minimum(starts + WINDOW, base + lengths[owner])


def _windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of every window of one text."""
    return _all_windows(np.array([n]))[1:]


def _places(starts: np.ndarray, ends: np.ndarray, length: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Stretches of words around windows that hit, neighbouring ones joined, within [low, high)."""
    starts, ends = starts - length, ends + length
    cuts = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    for a, b in zip([0, *cuts], [*cuts, len(starts)], strict=True):
        yield max(int(starts[a]), low), min(int(ends[b - 1]), high)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ranges that are not empty, one range behind the other, and where each begins."""
    sizes = high - low
    offsets = np.cumsum(sizes) - sizes
    return np.repeat(low - offsets, sizes) + np.arange(sizes.sum()), offsets


def _hits(
    space: Space, at: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray, norms: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, passages, cosines) that reach a threshold.

    A window is projected only if the most that its words can add up to reaches a threshold; these
    bounds are exact. Windows are projected ``AT_ONCE`` together, whatever the length of the text.
    """
    row = np.minimum(np.searchsorted(space.slots, at), len(space.slots) - 1)
    known = np.flatnonzero(space.slots[row] == at)
    held, near = np.zeros(len(at) + 1), np.zeros(len(at) + 1)
    held[known + 1] = weights[known] * space.held[row[known]]
    near[known + 1] = weights[known] * space.near[row[known]]
    held, near = np.cumsum(held), np.cumsum(near)
    first, last = np.searchsorted(known, starts), np.searchsorted(known, ends)
    opened = np.flatnonzero((last > first) & (
        (held[ends] - held[starts] >= 1 - 1e-6) | (near[ends] - near[starts] >= (1 - 1e-6) * norms)
    ))
    row, own = row[known], weights[known].astype(np.float32)
    for k in range(0, len(opened), AT_ONCE):
        some = opened[k : k + AT_ONCE]
        # Windows overlap: the words between two bounds are summed once, for all windows over them.
        a, b = first[some], last[some]
        cuts = np.unique(np.concatenate([a, b]))
        covered = b[np.searchsorted(a, cuts[:-1], "right") - 1] >= cuts[1:]
        parts = np.concatenate([[0], np.cumsum(covered)])
        words, offsets = _ranges(cuts[:-1][covered], cuts[1:][covered])
        sums = np.add.reduceat(own[words, None] * space.basis[row[words]], offsets, axis=0)
        pieces, offsets = _ranges(parts[np.searchsorted(cuts, a)], parts[np.searchsorted(cuts, b)])
        vectors = np.add.reduceat(sums[pieces], offsets, axis=0)
        products = vectors @ space.latent.T
        found = products >= np.minimum(space.parts, space.limits * norms[some, None])
        windows, passages = np.nonzero(found)
        if len(windows):
            yield some[windows], passages, products[windows, passages] / norms[some[windows]]


def search_all(
    texts: list[np.ndarray], idf: np.ndarray, spaces: list[Space]
) -> Iterator[tuple[int, int, float, np.ndarray]]:
    """(text, item, best cosine, words of the stretch) for the stretches of texts that resemble an item.

    ``texts`` are the hashed words of each, none of them empty. The norm of a window is that of its
    words' weights.
    """
    words, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    at = slots(words)
    weights = idf[at].astype(np.float64)
    owner, starts, ends = _all_windows(sizes)
    squares = np.concatenate([[0.0], np.cumsum(weights**2)])
    norms = np.sqrt(squares[ends] - squares[starts])
    hits = [
        (windows, space.items[passages], space.lengths[passages], cosines)
        for space in spaces for windows, passages, cosines in _hits(space, at, weights, starts, ends, norms)
    ]
    if not hits:
        return
    windows, items, lengths, cosines = (np.concatenate(c) for c in zip(*hits, strict=True))
    order = np.lexsort((windows, items, owner[windows]))
    windows, items, lengths, cosines = (c[order] for c in (windows, items, lengths, cosines))
    changed = (np.diff(items) != 0) | (np.diff(owner[windows]) != 0)
    cuts = np.concatenate([[0], np.flatnonzero(changed) + 1])
    best, bounds = np.maximum.reduceat(cosines, cuts), [*cuts.tolist(), len(items)]
    high = np.cumsum(sizes)
    low = high - sizes
    for k, cosine in enumerate(best.tolist()):
        a, b = bounds[k], bounds[k + 1]
        text = int(owner[windows[a]])
        for x, y in _places(starts[windows[a:b]], ends[windows[a:b]], int(lengths[a]), int(low[text]), int(high[text])):
            yield text, int(items[a]), cosine, words[x:y]


def search(text: str | None, idf: np.ndarray, spaces: list[Space]) -> Iterator[tuple[int, float, np.ndarray]]:
    """(item, best cosine, words of the stretch) for the stretches of one text."""
    words = _keys(text)
    if len(words):
        for _, item, cosine, region in search_all([words], idf, spaces):
            yield item, cosine, region


def _together(texts: pa.Array) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Whole texts with words, and their places, some ``WORDS_AT_ONCE`` words at a time."""
    places, held, n = [], [], 0
    for k, text in enumerate(texts):
        words = _keys(text.as_py())
        if len(words):
            places.append(k)
            held.append(words)
            n += len(words)
        if n >= WORDS_AT_ONCE:
            yield places, held
            places, held, n = [], [], 0
    if held:
        yield places, held


def _search_all(batches: Iterator[pa.RecordBatch], idf, spaces) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for places, texts in _together(batch.column("text")):
            found = list(search_all(texts, idf.value, spaces.value))
            at = pa.array([places[text] for text, *_ in found], pa.int64())
            ends = np.cumsum([0, *(len(region) for *_, region in found)])
            regions = np.concatenate([np.empty(0, np.uint64), *(region for *_, region in found)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at), batch.column("id").take(at),
                    pa.array([item for _, item, *_ in found], pa.int64()),
                    pa.array([cosine for _, _, cosine, _ in found], pa.float64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(regions.view(np.int64))),
                ],
                names=[c.split()[0] for c in FOUND.split(", ")],
            )


def common_weight(one: np.ndarray, other: np.ndarray, weights: np.ndarray) -> float:
    """Largest sum of ``weights`` of a subsequence of ``one`` that ``other`` has as well, in order."""
    row = np.zeros(len(other) + 1)
    for x, weight in zip(one, weights, strict=True):
        hit = np.flatnonzero(other == x)
        if len(hit):
            grown = row.copy()
            grown[hit + 1] = np.maximum(grown[hit + 1], row[hit] + weight)
            row = np.maximum.accumulate(grown)
    return float(row[-1])


def _judge(batches: Iterator[pa.RecordBatch], idf) -> Iterator[pa.RecordBatch]:
    @lru_cache(ITEMS_HELD)
    def prepared(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        item = _keys(text)
        weights, tail = idf.value[slots(item)].astype(np.float64), np.arange(len(item)) >= len(item) - ANSWER_WORDS
        return item, weights, tail, weights.sum(), weights[tail].sum()

    for batch in batches:
        shares, answers = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        column = batch.column("region")
        regions, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        for k, text in enumerate(batch.column("text").to_pylist()):
            item, weights, tail, whole, last = prepared(text)
            words = regions[ends[k] : ends[k + 1]]
            # What the stretch holds in any order bounds the share; below PARAPHRASE there is no leak.
            held = np.isin(item, words)
            if weights[held].sum() < (PARAPHRASE - 1e-6) * whole:
                continue
            own = held & tail
            shares[k] = common_weight(item[held], words, weights[held]) / whole
            answers[k] = common_weight(item[own], words, weights[own]) / last
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "id", "item_id", "cosine")), pa.array(shares), pa.array(answers)],
            names=["doc_id", "id", "item_id", "cosine", "share", "answer"],
        )


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``id`` (digest of the text), ``item_id``, ``cosine``, ``share``, ``answer`` of every leak.

    ``share`` is the part of the item's weight that a stretch of the text keeps in order; ``answer``
    that of the item's last ``ANSWER_WORDS`` words. A stretch is a leak with a share of ``COPY``,
    or of ``PARAPHRASE`` with an answer of ``ANSWER``. One row per document row's text and item.
    Null and empty texts have no leak; items that are null or shorter than ``MIN_ITEM_WORDS`` words
    are not looked for; repeated items count once; other columns are not read.
    """
    spark = docs.sparkSession
    base = packed(docs).select(
        F.col("doc")["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(F.col("doc")["text"], F.lit("")).alias("text"),
    ).withColumn("id", F.unhex(F.md5("text")))
    words = F.size(F.array_remove(F.split("text", r"[^\p{Alnum}\x{80}-\x{10FFFF}]+"), ""))
    items = benchmark.select("item_id", "text").where(words >= MIN_ITEM_WORDS).distinct()
    items = staged(items.withColumn("item_row", F.monotonically_increasing_id()), "items")
    parts = items.withColumn("parts", F.ceil(words / WINDOW).cast("int"))
    parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    n = parts.count()
    out_schema = "doc_id bigint, id binary, item_id bigint, cosine double, share double, answer double"
    if n == 0:
        return spark.createDataFrame([], out_schema)
    rarity, _ = inverse_frequencies(base, _keys)
    # One more for every word: an item that many documents leak must not lose its weight.
    idf = spark.sparkContext.broadcast((rarity + 1).astype(np.float32))
    n_blocks = -(-n // BLOCK_ITEMS)
    dealt = parts.withColumn("block", F.pmod(F.xxhash64("item_row", "part"), F.lit(n_blocks)).cast("int"))
    found = None
    for low in range(0, n_blocks, BLOCKS_AT_ONCE):
        some = dealt.where(F.col("block").between(low, low + BLOCKS_AT_ONCE - 1))
        fitted = some.groupBy("block").applyInArrow(lambda group: _fit(group, idf), SPACE).collect()
        spaces = spark.sparkContext.broadcast([_space(row) for row in sorted(fitted, key=lambda r: r["block"])])
        near = base.mapInArrow(lambda batches, spaces=spaces: _search_all(batches, idf, spaces), FOUND)
        near = staged(near, "leak-candidates")
        found = near if found is None else found.unionByName(near)
    judged = found.join(items, "item_row").select("doc_id", "id", "item_id", "cosine", "region", "text").mapInArrow(
        lambda batches: _judge(batches, idf), out_schema
    )
    leak = (F.col("share") >= COPY) | ((F.col("share") >= PARAPHRASE) & (F.col("answer") >= ANSWER))
    best = judged.where(leak).groupBy("doc_id", "id", "item_id").agg(
        *(F.max(c).alias(c) for c in ("cosine", "share", "answer"))
    )
    return staged(best, "leaks")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, same columns, without the rows whose text leaks an item."""
    leaked = find_leaks(docs, benchmark).select("id").distinct()
    text = F.coalesce(F.col("doc")["text"], F.lit(""))
    keyed = packed(docs).withColumn("id", F.unhex(F.md5(text)))
    return keyed.join(leaked, "id", "left_anti").select("doc.*")
