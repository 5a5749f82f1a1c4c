import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tidemark.llm import minhash, shingles
from tidemark.llm.components import components
from tidemark.llm.frequencies import SLOTS


def corpus():
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefgh", k=random.randint(3, 7)))
    common = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(random.randint(20, 150))]
        texts.append(" ".join(base))
        for _ in range(random.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(random.choice([0, 1, 2, 4, 9])):
                copy[random.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [t + " " + common for t in texts[:25]]
    texts += [None, "", "  \n", "two words", "Two  words", "two other", "x " * 40_000, "x " * 40_001]
    return [(i if i != 3 else None, t, "s") for i, t in enumerate(texts)] + [(5, texts[5], "s")] * 2


def by_hand(rows, idf):
    sets = {t: minhash.weighted(t, idf) for _, t, _ in rows if t and t.split()}
    names = list(sets)
    label = {t: t for t in names}
    links = dict.fromkeys(names, 0)

    def root(t):
        while label[t] != t:
            t = label[t]
        return t

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x = dict(zip(sets[a][0].tolist(), sets[a][1].tolist()))
            y = dict(zip(sets[b][0].tolist(), sets[b][1].tolist()))
            low = sum(min(x[k], y[k]) for k in x if k in y)
            if low / (sum(x.values()) + sum(y.values()) - low) >= 0.8:
                label[root(a)] = root(b)
                links[a] += 1
                links[b] += 1
    least = {}
    for d, t, _ in rows:
        if t in label and d is not None:
            least[root(t)] = min(d, least.get(root(t), d))
    return [(d, least.get(root(t)) if t in label else d, links.get(t, 0)) for d, t, _ in rows]


def key(row):
    return tuple((v is not None, v or 0) for v in row)


def test_classes_equal_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, class_id string").repartition(4)
    got = minhash.near_duplicates(docs).select("doc.doc_id", "class_id", "links").collect()
    want = by_hand(rows, minhash.shingle_weights(docs))
    classes = lambda out: sorted(((r[0], r[1]) for r in out), key=key)
    assert classes(got) == classes(want)
    assert len({r[1] for r in want}) < len(want) - 30
    assert all(a[2] <= b[2] for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)))
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda v: -1 if v is None else v)
    words = {d for d, t, _ in rows if t and t.split()}
    assert ids == sorted(
        [c for c in {w[1] for w in want if w[0] in words}] + [d for d, t, _ in rows if not (t and t.split())],
        key=lambda v: -1 if v is None else v,
    )


def test_samples_estimate_the_similarity():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    weights = rng.uniform(1, 9, len(keys))
    other = weights * rng.choice([1.0, 1.0, 0.5], len(keys))
    a = minhash.sample(keys, weights, 4000)
    b = minhash.sample(keys[:300], other[:300], 4000)
    true = minhash.similarity((keys, weights), (keys[:300], other[:300]))
    assert abs((a == b).mean() - true) < 0.03


def test_shingles_equal_a_plain_split():
    text = "Der  erste Satz\tist é kurz, der erste satz ist é kurz.\nEnde"
    words = text.lower().split()
    assert len(shingles.words(text)) == len(words)
    assert len(set(shingles.words(text).tolist())) == len(set(words))
    keys, counts = shingles.shingles(text)
    want = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    assert len(keys) == len(set(want)) and counts.sum() == len(want)
    assert np.array_equal(shingles.words("b a"), shingles.words("xx b A")[1:])


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (40, 40)]
    got = components(spark.createDataFrame(edges, "a int, b int")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(21)] + [(30, 30), (31, 30), (32, 30)]


def test_blocks_find_links_beside_the_head(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(100)]
    texts = {b"a": words, b"b": [*words[:96], *"pqrs"], b"c": [*words[10:96], *"pqrstuvwxyzklm"], b"d": [*"abcdefghij"]}
    idf = SimpleNamespace(value=np.ones(SLOTS, dtype=np.float32))
    sets = {k: minhash.weighted(" ".join(t), idf.value) for k, t in texts.items()}
    far = {k: 1 - minhash.similarity(sets[b"a"], s) for k, s in sets.items()}
    assert far[b"b"] < 0.2 < far[b"c"] and minhash.similarity(sets[b"b"], sets[b"c"]) > 0.8
    binary = lambda t: bytearray(t)
    members = spark.createDataFrame([(binary(t), 0, 1, binary(b"a")) for t in texts], "id binary, band int, key bigint, head binary")
    scored = spark.createDataFrame([(binary(b"a"), binary(t), 1 - f) for t, f in far.items() if f], "a binary, b binary, similarity double")
    labels = spark.createDataFrame([(binary(b"a"), binary(b"a")), (binary(b"b"), binary(b"a"))], "node binary, label binary")
    rows = [r.asDict() for r in minhash._open_blocks(members, scored, labels).collect()]
    assert {bytes(r["id"]) for r in rows if r["ours"]} == {b"c", b"d"}
    group = pa.Table.from_pylist([
        {"id": bytes(r["id"]), "label": bytes(r["label"]), "ours": r["ours"], "text": " ".join(texts[bytes(r["id"])])} for r in rows
    ])
    assert minhash._compare(group, idf).to_pylist() == [{"a": b"b", "b": b"c"}]


def test_fuzzy_group_becomes_the_classes_of_all_pairs(spark):
    random.seed(13)
    base = [f"w{random.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(260):
        copy = list(base)
        for _ in range(random.randint(1, 6)):
            copy[random.randrange(150)] = f"x{random.randrange(10**6)}"
        rows.append((i, " ".join(copy), "s"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, s string")
    got = minhash.near_duplicates(docs).select("doc.doc_id", "class_id").collect()
    want = by_hand(rows, minhash.shingle_weights(docs))
    assert sorted(map(tuple, got)) == sorted(w[:2] for w in want)
    assert len({w[1] for w in want}) > 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_duplicates(docs).count() == 0 and minhash.keep_first(docs).count() == 0
