import random

import numpy as np

from tidemark.llm import decontaminate as D
from tidemark.llm.frequencies import slots


def make(seed=6):
    random.seed(seed)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(3, 8))) for _ in range(3000)]
    common = ["the", "of", "and", "to", "in"]
    word = lambda: random.choice(common) if random.random() < 0.35 else random.choice(vocabulary)
    prose = lambda n: [word() for _ in range(n)]
    items = [(k, prose(random.randint(14, 60))) for k in range(30)]
    docs, leaks = [], []
    for k in range(200):
        words = prose(random.choice([5, 60, 200, 900]))
        if k % 4 == 0:
            item, body = random.choice(items)
            copy = list(body)
            if k % 8 == 0:  # paraphrase: the end stays, some words before it change
                for i in random.sample(range(len(copy) - 8), (len(copy) - 8) // 4):
                    copy[i] = word()
            at = random.randint(0, len(words))
            words[at:at] = [copy[0].upper(), *copy[1:]]
            leaks.append((k, item))
        docs.append((k, ", ".join(words)))
    return docs, [(k, " ".join(b)) for k, b in items], leaks


def test_planted_items_are_found_and_nothing_else(spark):
    docs, items, leaks = make()
    docs += [(500, None), (501, ""), (None, "x"), (502, items[0][1] * 3000), (leaks[0][0], docs[leaks[0][0]][1])]
    bench = items + [items[0], (90, None), (91, "the of")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    names = spark.createDataFrame([(*b, "z") for b in bench], "item_id bigint, text string, doc_id string")
    got = D.find_leaks(frame, names).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == sorted({*leaks, (502, 0)})
    kept = D.drop_leaks(frame, names)
    assert kept.columns == frame.columns
    gone = {d for d, _ in leaks} | {502}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in gone)


def test_search_meets_brute_force(spark):
    """Every window and item whose full TF-IDF cosine reaches the threshold is a candidate."""
    docs, items, _ = make(9)
    import pyarrow as pa

    class Held:
        value = np.random.default_rng(1).uniform(1, 8, 1 << 18).astype(np.float32)

    group = pa.table({"block": pa.array([0] * 30, pa.int32()), "item_row": list(range(30)), "text": [t for _, t in items]})
    space = D._space(D._fit(group, Held).to_pylist()[0])
    assert np.allclose(space.basis.T @ space.basis, np.eye(space.basis.shape[1]), atol=1e-3)
    have, want = set(), set()
    for doc, text in docs:
        have |= {(doc, item) for item, _, _ in D.search(text, Held.value, [space])}
        words = slots(D._keys(text))
        starts, ends = D._windows(len(words))
        for item, body in items:
            q = np.zeros(1 << 18)
            np.add.at(q, slots(D._keys(body)), Held.value[slots(D._keys(body))])
            q /= np.linalg.norm(q)
            for s, e in zip(starts, ends):
                w = Held.value[words[s:e]]
                if (w * q[words[s:e]]).sum() / np.sqrt((w.astype(float) ** 2).sum()) >= D.limits(np.array(len(D._keys(body)))):
                    want.add((doc, item))
    assert len(have & want) >= 0.99 * len(want) and len(want) > 30


def test_items_that_many_documents_leak_are_found(spark):
    """However many documents hold an item, each of them is found."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    items = [(k, rng.choices(words, k=rng.randint(14, 44))) for k in range(10)]
    bench = spark.createDataFrame([(k, " ".join(b)) for k, b in items], "item_id bigint, text string")
    for every in (3, 1):
        docs, want = [], set()
        for k in range(150):
            body = rng.choices(words, k=rng.choice([60, 200]))
            if k % every == 0:
                for item, copy in items:
                    at = rng.randint(0, len(body))
                    body[at:at] = [*rng.choices(words, k=48), *copy, *rng.choices(words, k=48)]
                    want.add((k, item))
            docs.append((k, " ".join(body)))
        # An insertion may split an earlier item; only whole ones count.
        texts = dict(docs)
        want = {(d, i) for d, i in want if " ".join(items[i][1]) in texts[d]}
        got = D.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench)
        got = set(map(tuple, got.select("doc_id", "item_id").collect()))
        assert len(want) > 300 / every and want <= got


def test_long_items_are_found_and_judged_whole(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(6000)]
    items = {n: rng.choices(words, k=n) for n in (300, 400, 600, 1000)}
    docs, want = [], set()
    for n, copy in items.items():
        for k in range(6):
            body = rng.choices(words, k=500)
            body[100 * k : 100 * k] = copy
            docs.append((len(docs), " ".join(body)))
            want.add((len(docs) - 1, n))
        docs.append((len(docs), " ".join(copy[: n // 3])))  # a third of an item is no leak
    bench = spark.createDataFrame([(n, " ".join(c)) for n, c in items.items()], "item_id bigint, text string")
    found = D.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(r.share > 0.999 and r.answer > 0.999 for r in found)


def test_common_subsequence():
    random.seed(1)
    for _ in range(50):
        a = random.choices("abcd", k=random.randint(0, 12))
        b = random.choices("abcd", k=random.randint(0, 12))
        w = [random.randint(1, 5) for _ in a]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + w[i] if x == y else 0)
        assert D.common_weight(np.array(a, "U1"), np.array(b, "U1"), np.array(w)) == t[-1][-1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id bigint, text string")
    assert D.find_leaks(none, bench).count() == 0
    assert D.find_leaks(bench.withColumnRenamed("item_id", "doc_id"), bench.where("false")).count() == 0


def test_texts_searched_together_give_what_each_gives():
    """Stretches keep to their own text, whatever its neighbours are, with several spaces and long texts."""
    import pyarrow as pa

    class Held:
        value = np.random.default_rng(2).uniform(1, 8, 1 << 18).astype(np.float32)

    docs, items, _ = make(11)
    spaces = []
    for block in (0, 1):
        part = items[block * 15 : block * 15 + 15]
        spaces.append(D._space(D._fit(pa.table({
            "block": pa.array([block] * 15, pa.int32()), "item_row": [k for k, _ in part], "text": [t for _, t in part],
        }), Held).to_pylist()[0]))
    texts = [None, "", *(t for _, t in docs), items[0][1], items[0][1], items[1][1] * 2000, "..."]
    flat = lambda k, item, cosine, region: (k, item, round(cosine, 4), tuple(region.tolist()))
    one = [flat(k, *found) for k, text in enumerate(texts) for found in D.search(text, Held.value, spaces)]
    together = [
        flat(places[k], *found)
        for places, held in D._together(pa.array(texts)) for k, *found in D.search_all(held, Held.value, spaces)
    ]
    assert sorted(one) == sorted(together) and len(one) > 50
    own = {k: set(D._keys(t).tolist()) for k, t in enumerate(texts)}
    assert all(set(region) <= own[k] for k, _, _, region in together)
