"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles, weight = occurrences x (1 + ``RARITY`` x
inverse document frequency, scaled to at most 1). The part that is the same for all keeps the
similarity of copies close to the unweighted one: without it, the shingles of a text that has
thousands of copies would weigh less than the few words in which two copies differ. Frequencies
are counted over all documents in a table of hash slots of fixed size, as with hashed features. Each of ``BANDS`` x ``ROWS`` samples picks one shingle of a document so that
two documents pick the same one with the probability of their weighted Jaccard similarity. Equal
bands make candidates, and every link is verified on the whole shingle sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shingles as S
from tidemark.llm.common import packed, staged
from tidemark.llm.components import components
from tidemark.llm.frequencies import inverse_frequencies, slots

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RARITY = 0.5
BANDS, ROWS = 12, 3
#: Texts of one side of a block that is compared at once.
CHUNK = 128
#: Draws that each sample's shingles choose from, as a power of two.
DRAW_BITS = 13
#: Shingles x samples that are worked on at once.
AT_ONCE = 200_000
REACH = 1 - SIMILARITY + 1e-9


def _keys(text: str | None) -> np.ndarray:
    return S.shingles(text, SHINGLE_WORDS)[0]


def shingle_weights(base: DataFrame) -> np.ndarray:
    rarity, most = inverse_frequencies(base, _keys)
    return (1 + RARITY * rarity / max(most, 1.0)).astype(np.float32)


def weighted(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = S.shingles(text, SHINGLE_WORDS)
    return keys, counts * idf[slots(keys)]


@functools.lru_cache(maxsize=2)
def _draws(samples: int) -> tuple[np.ndarray, ...]:
    """Gamma(2, 1), log Gamma(2, 1) and uniform draws of every sample, the same in every task."""
    rng, shape = np.random.default_rng(20), (samples, 1 << DRAW_BITS)
    r = np.maximum(rng.gamma(2.0, 1.0, shape), 1e-6).astype(np.float32)
    c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
    b = rng.random(shape).astype(np.float32)
    salts = rng.integers(1, 1 << 63, (samples, 1), dtype=np.uint64) | np.uint64(1)
    return r.ravel(), c.ravel(), b.ravel(), salts


def sample(keys: np.ndarray, weights: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    """For each sample the hash of the shingle it picks and of its quantised weight.

    Improved consistent weighted sampling: t = floor(ln w / r + b), ln a = ln c - r (t - b + 1),
    and the smallest a wins. A shingle's draws are found by its hash; shingles that share the
    winning draw and weight are told apart by hash order.
    """
    r, c, b, salts = _draws(samples)
    logs = np.log(weights).astype(np.float32)
    out = np.empty(samples, dtype=np.uint64)
    step = max(1, AT_ONCE // len(keys))
    for k in range(0, samples, step):
        own = keys * salts[k : k + step]
        rows = np.arange(len(own))
        at = (own >> np.uint64(64 - DRAW_BITS)).astype(np.int64)
        at += ((k + rows) << DRAW_BITS)[:, None]
        rk, bk = r.take(at), b.take(at)
        t = np.floor(logs / rk + bk)
        a = c.take(at) - rk * (t - bk + np.float32(1))
        won = np.where(a == a.min(axis=1, keepdims=True), own, np.uint64(2**64 - 1)).argmin(axis=1)
        out[k : k + step] = keys[won] * np.uint64(31) + t[rows, won].astype(np.int64).view(np.uint64)
    return S.mix(out)


def bands(keys: np.ndarray, weights: np.ndarray) -> list[int]:
    """One 64-bit key for each band."""
    picks = sample(keys, weights).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = S.mix(out * S.BASE + picks[:, k])
    return out.view(np.int64).tolist()


def similarity(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of the smaller weights over the sum of the larger."""
    _, i, j = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    low = np.minimum(one[1][i], other[1][j]).sum(dtype=np.float64)
    high = one[1].sum(dtype=np.float64) + other[1].sum(dtype=np.float64) - low
    return float(low / high) if high > 0 else 0.0


def _sign(batches: Iterator[pa.RecordBatch], idf) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text"):
            keys, weights = weighted(text.as_py(), idf.value)
            out.append(bands(keys, weights) if len(keys) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("id"), pa.array(out, pa.list_(pa.int64()))],
            names=["doc_id", "id", "bands"],
        )


def _verify(batches: Iterator[pa.RecordBatch], idf) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, tuple] = {}

    def sets(key: bytes, text: str) -> tuple:
        if key not in held:
            if len(held) > 64:
                held.clear()
            held[key] = weighted(text, idf.value)
        return held[key]

    for batch in batches:
        a, b, x, y = (batch.column(c) for c in ("a", "b", "text_a", "text_b"))
        scores = [
            similarity(sets(a[k].as_py(), x[k].as_py()), sets(b[k].as_py(), y[k].as_py())) for k in range(batch.num_rows)
        ]
        yield pa.RecordBatch.from_arrays([a, b, pa.array(scores, pa.float64())], names=["a", "b", "similarity"])


def _scores(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Similarity of each pair (``a``, ``b``) of text ids."""
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"
    )
    # The head's text joins last: its pairs lie together, and it is not shuffled once per pair.
    return both.mapInArrow(lambda batches: _verify(batches, idf), "a binary, b binary, similarity double")


def _with_text(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("doc")["text"], F.lit(""))
    base = packed(docs).select("doc", F.col("doc")["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    return base.withColumn("id", F.unhex(F.md5("text")))


def classes_of(base: DataFrame) -> DataFrame:
    """Of each text with words (``id``): ``class_id``, ``links``, and whether it ``leads`` its class.

    Candidates of a band's bucket are compared with the bucket's head first. What the head leaves
    open is compared in blocks (``_open_blocks``). No class is lost to a cap.
    """
    spark = base.sparkSession
    idf = spark.sparkContext.broadcast(shingle_weights(base))
    signed = staged(
        base.select("doc_id", "id", "text").mapInArrow(
            lambda batches: _sign(batches, idf), "doc_id bigint, id binary, bands array<bigint>"
        ),
        "signatures",
    )
    # Equal texts are one text from here on.
    one = signed.where("bands is not null").select("id", F.posexplode("bands").alias("band", "key"))
    entries = one.dropDuplicates(["id", "band", "key"])
    # Head of a bucket: the text that meets most others in all its buckets, so likely the original.
    sizes = entries.groupBy("band", "key").count().where("count > 1")
    sized = staged(entries.join(sizes, ["band", "key"]), "buckets")
    known = sized.groupBy("id").agg(F.sum("count").alias("met"))
    rank = F.struct("met", "id")
    heads = sized.join(known, "id").groupBy("band", "key").agg(F.max(rank).alias("lead"))
    members = sized.join(heads.select("band", "key", F.col("lead.id").alias("head")), ["band", "key"])
    stars = members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    wanted = members.select("id").distinct()
    texts = staged(
        base.select("id", "text").join(wanted, "id", "left_semi").dropDuplicates(["id"]), "candidate-texts"
    )
    scored = staged(_scores(stars, texts, idf), "star-scores")
    near = scored.where(F.col("similarity") >= SIMILARITY)
    labels = components(near)
    links = near.select("a", "b")
    blocks = staged(_open_blocks(members, scored, labels), "open-blocks")
    if not blocks.isEmpty():
        whole = blocks.join(texts, "id").groupBy("band", "key", "left", "right")
        more = staged(whole.applyInArrow(lambda group: _compare(group, idf), "a binary, b binary"), "open-links")
        links = links.unionByName(more).distinct()
        labels = components(links)
    counts = (
        links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id"))).groupBy("id").count()
    )
    named = signed.where("bands is not null").groupBy("id").agg(F.min("doc_id").alias("first"))
    named = named.join(labels, named["id"] == labels["node"], "left").select(
        "id", "first", F.coalesce("label", "id").alias("label")
    )
    # Null ids sort behind the others.
    order = F.struct(F.col("first").isNull().alias("unnamed"), "first", "id")
    led = named.groupBy("label").agg(F.min(order).alias("lead"))
    classes = named.join(led, "label").join(counts, "id", "left").select(
        "id", F.col("lead.first").alias("class_id"), F.coalesce("count", F.lit(0)).cast("long").alias("links"),
        (F.col("id") == F.col("lead.id")).alias("leads"),
    )
    return staged(classes, "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc`` (the row's columns), ``class_id`` and ``links`` of every row.

    Rows of one class are linked by weighted Jaccard similarities of at least ``SIMILARITY``
    (directly or through others) or have equal texts. ``class_id`` is the smallest doc_id of the
    class; ``links`` counts the links of the row's text that were verified to join the class. A row without
    words (null, empty, white space) is a class of its own under its doc_id. A null doc_id counts
    as larger than any other; a class of nulls has a null id. An empty table gives no row.
    """
    base = _with_text(docs)
    both = base.drop("text").join(classes_of(base), "id", "left")
    return both.select(
        "doc",
        F.when(F.col("links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0).cast("long")).alias("links"),
    )


def _open_blocks(members: DataFrame, scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks of texts that may be linked although they are not in one class yet.

    With distances x and y to the bucket's head, a link needs |x - y| <= 1 - ``SIMILARITY``. Texts
    linked to the head are of its class already, so one end of an open link is an outsider. Each
    bucket's outsiders and the members in their reach are dealt to chunks of about ``CHUNK``, and
    every chunk of outsiders meets every chunk of members as one block. The rows are blocks'
    members, not pairs, and no task holds more than one block.
    """
    known = members.join(
        scored.select(F.col("a").alias("head"), F.col("b").alias("id"), (1 - F.col("similarity")).alias("far")),
        ["head", "id"],
    )
    known = known.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select(
        "band", "key", "id", "far", F.coalesce("label", "id").alias("label")
    )
    out = known.where(F.col("far") > REACH)
    spots = out.groupBy("band", "key").agg(F.min("far").alias("nearest"), F.count("*").alias("n_out"))
    inner = known.join(spots, ["band", "key"]).where(F.col("far") >= F.col("nearest") - REACH)
    # A bucket whose open members are of one class has nothing left to link.
    mixed = inner.groupBy("band", "key").agg(
        F.count("*").alias("n_in"), F.min("label").alias("one"), F.max("label").alias("other")
    ).where("one <> other")
    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("id"), chunks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
    keyed = inner.join(mixed.select("band", "key", "n_in"), ["band", "key"])
    ours = keyed.where(F.col("far") > REACH).withColumn("left", own("n_out")).withColumn("right", every("n_in"))
    theirs = keyed.withColumn("right", own("n_in")).withColumn("left", every("n_out"))
    columns = ["band", "key", "left", "right", "id", "label"]
    return ours.select(*columns, F.lit(True).alias("ours")).unionByName(theirs.select(*columns, F.lit(False).alias("ours")))


def _compare(group: pa.Table, idf) -> pa.Table:
    """Linked pairs of a block: each text of one side against all of the other at once."""
    rows = group.select(["id", "label", "ours", "text"]).to_pylist()
    theirs = [r for r in rows if not r["ours"]]
    sets = [weighted(r["text"], idf.value) for r in theirs]
    keys = np.concatenate([k for k, _ in sets]) if sets else np.zeros(0, np.uint64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    weights = np.concatenate([w for _, w in sets])[order] if sets else np.zeros(0)
    owner = np.repeat(np.arange(len(sets)), [len(k) for k, _ in sets])[order]
    totals = np.array([w.sum() for _, w in sets])
    names = np.array([r["id"] for r in theirs], dtype=object)
    labels = np.array([r["label"] for r in theirs], dtype=object)
    found = set()
    for r in rows:
        if not r["ours"] or not sets:
            continue
        own_keys, own_weights = weighted(r["text"], idf.value)
        low, high = np.searchsorted(keys, own_keys), np.searchsorted(keys, own_keys, "right")
        runs = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        shared = np.bincount(owner[at], np.minimum(np.repeat(own_weights, runs), weights[at]), len(sets))
        near = shared >= SIMILARITY * (own_weights.sum() + totals - shared)
        for k in np.flatnonzero(near & (labels != r["label"])):
            found.add((min(r["id"], names[k]), max(r["id"], names[k])))
    pairs = sorted(found)
    return pa.table([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs``, same columns, one row of each class of near-duplicates.

    The row with the smallest doc_id stays, of equal rows one. Rows without words all stay.
    """
    base = _with_text(docs)
    lead = classes_of(base).where("leads").select("id", "class_id")
    kept = base.drop("text").join(lead, "id").where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    wordless = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    return kept.dropDuplicates(["id"]).select("doc.*").unionByName(docs.where(wordless))
