import math
import random
from collections import Counter, defaultdict

import numpy as np

from tidemark.llm import classifier as C
from tidemark.llm import common


def by_hand(texts):
    """Interpolated modified Kneser-Ney over symbols with plain dictionaries."""
    seen = Counter()
    for t in texts:
        s = [0, 0, *C.symbols(t).tolist()]
        for i in range(2, len(s)):
            seen[tuple(s[i - 2 : i + 1])] += 1
    levels = [seen]
    for _ in range(2):
        lower = Counter()
        for gram in levels[0]:
            lower[gram[1:]] += 1
        levels.insert(0, lower)

    def discounts(counts):
        t = [sum(1 for v in counts.values() if v == k) for k in range(5)]
        out = []
        for k in (1, 2, 3):
            d = 0.5
            if t[k] and t[1]:
                d = k - (k + 1) * t[1] / (t[1] + 2 * t[2]) * t[k + 1] / t[k]
            out.append(min(max(d, 0.05), k - 0.05))
        return out

    ds = [discounts(c) for c in levels]
    total = [defaultdict(int) for _ in levels]
    given = [defaultdict(float) for _ in levels]
    for k, counts in enumerate(levels):
        for gram, n in counts.items():
            total[k][gram[:-1]] += n
            given[k][gram[:-1]] += ds[k][min(n, 3) - 1]

    def p(gram):
        k = len(gram) - 1
        below = p(gram[1:]) if k else 1 / C.SYMBOLS
        context = gram[:-1]
        if not total[k][context]:
            return below
        n = levels[k].get(gram, 0)
        own = max(n - ds[k][min(n, 3) - 1], 0) if n else 0
        return own / total[k][context] + given[k][context] / total[k][context] * below

    return p


def prose(n, seed):
    random.seed(seed)
    return ["".join(random.choices(["the ", "of ", "Ring, ", "and ", "tion ", "er. "], k=random.randint(20, 60))) for _ in range(n)]


def junk(n, seed):
    random.seed(seed)
    return ["".join(random.choices("#$%&xqzQZ!|~ ", k=random.randint(80, 300))) for _ in range(n)]


SCHEMA = "doc_id bigint, text string, lang string, bits string"


def test_probabilities_equal_a_plain_model(spark):
    texts = prose(25, 1)
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate([*texts, "zzz", None])], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(25)] + [(25, 1, 1), (26, 1, 0)], "doc_id bigint, quality int, toxic int")
    bits = C.tables(C.kneser_ney(C.count_grams(docs, labels)))["en"]
    p = by_hand(texts)
    rng = np.random.default_rng(2)
    for gram in [*C.grams(texts[0])[:200].tolist(), *rng.integers(0, C.SYMBOLS**3, 200).tolist()]:
        parts = (gram // C.SYMBOLS**2, gram // C.SYMBOLS % C.SYMBOLS, gram % C.SYMBOLS)
        assert math.isclose(bits[gram], -math.log2(p(parts)), rel_tol=1e-4)
    rows = (2.0 ** -bits.astype(float)).reshape(-1, C.SYMBOLS).sum(axis=1)
    assert np.allclose(rows, 1, atol=1e-4)


def test_held_out_accuracy_and_cases(spark):
    good, bad = prose(300, 3), junk(100, 4)
    docs = [(i, t, "en", "x") for i, t in enumerate(good + bad)]
    docs += [(900, None, "en", "x"), (901, "", "en", "x"), (902, "short", "en", "x"), (903, bad[0], "xx", "x"), (904, bad[0], None, "x")]
    docs += [(905, "the of and " * 30_000, "en", "x"), (0, good[0], "en", "x"), (None, good[1], "en", "x")]
    labels = [(i, 1, 0) for i in range(150)] + [(i, 0, 0) for i in range(300, 350)] + [(3, 0, 0), (None, 1, 0), (4, 1, None)]
    got = C.classify(
        spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    ).collect()
    assert len(got) == len(docs)
    kept = {r.doc_id: r.kept for r in got}
    held_out = [kept[i] for i in range(150, 300)], [kept[i] for i in range(350, 400)]
    assert sum(held_out[0]) >= 147 and sum(held_out[1]) == 0
    assert (kept[900], kept[901], kept[902], kept[903], kept[904]) == (False, False, True, True, True)
    assert next(r for r in got if r.doc_id == 901).perplexity is None


def test_symbols():
    assert C.symbols(" A b\n\t c1ÉéŁ ") .tolist() == [3, 1, 5, 1, 6, 2, 3, 4 + C._SMALL.index("é"), 3]
    assert len(C.symbols(None)) == 0 and len(C.grams("ab")) == 2
    assert max(C.symbols("\U0001f600~—").tolist()) == C._REST


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert C.classify(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "text " * 20, "en", "x")], SCHEMA)
    assert [r.kept for r in C.classify(one, labels).collect()] == [True]


def test_words_of_one_spelling_class_are_told_apart(spark):
    """Texts of the same 64 symbols in the same order, one of trusted words and one of none."""
    random.seed(7)
    words = ["\u0442\u043e", "\u043d\u0430", "\u043a\u0430", "\u0432\u0441\u0435", "\u043e\u043d\u0430"]
    texts = [" ".join(random.choices(words, k=random.randint(40, 60))) for _ in range(120)]
    turn = str.maketrans({c: chr(ord(c) + 0x400) for c in set("".join(words))})
    strange = [t.translate(turn) for t in texts[:20]]
    assert all(np.array_equal(C.symbols(a), C.symbols(b)) for a, b in zip(texts, strange))
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts + strange)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in C.classify(docs, labels).collect()}
    assert sum(kept[i] for i in range(80, 120)) >= 38 and not any(kept[i] for i in range(120, 140))


def by_words(texts, name="en"):
    """Bits of a text under an interpolated modified Kneser-Ney model of words, with dictionaries."""
    line = lambda t: ["", *C._WORDS.findall(t), " "]
    two = Counter(p for t in texts for p in zip(line(t), line(t)[1:]))
    one = Counter(w for _, w in two)

    def smoothed(counts, context):
        t = [sum(1 for v in counts.values() if v == k) for k in range(5)]
        ds = []
        for k in (1, 2, 3):
            d = k - (k + 1) * t[1] / (t[1] + 2 * t[2]) * t[k + 1] / t[k] if t[k] and t[1] else 0.5
            ds.append(min(max(d, 0.05), k - 0.05))
        total, given = Counter(), defaultdict(float)
        for g, n in counts.items():
            total[context(g)] += n
            given[context(g)] += ds[min(n, 3) - 1]
        share = {g: (n - ds[min(n, 3) - 1]) / total[context(g)] for g, n in counts.items()}
        return share, {c: given[c] / total[c] for c in total}

    share2, back2 = smoothed(two, lambda g: g[0])
    share1, back1 = smoothed(one, lambda g: 0)

    def bits(text, spelled):
        total = 0.0
        for v, w in zip(line(text), line(text)[1:]):
            p = share1[w] if w in share1 else back1[0] * 2.0 ** -spelled(w)
            total -= math.log2(share2.get((v, w), 0.0) + back2.get(v, 1.0) * p)
        return total

    return bits


def test_bits_equal_a_plain_model_of_words(spark):
    random.seed(11)
    words = [f"{a}{b}" for a in ("ma", "To", "re", "\u043d\u0430", "7") for b in ("", "n", "ly", "st")]
    texts = [" ".join(random.choices(words, weights=range(1, 21), k=random.randint(5, 40))) + "." for _ in range(60)]
    asked = [*texts[:10], "man never Toly, rest!", "zzz", "", None, "man man man"]
    frame = lambda rows: spark.createDataFrame([(i, "en", t) for i, t in enumerate(rows)], "doc_id bigint, model string, text string")
    tables = C.tables(C.kneser_ney(C._gram_counts(frame(texts).withColumnRenamed("model", "language"))))
    model, unknown = C.word_model(C.count_pairs(frame(texts)))
    rows = C.word_bits(frame(asked), spark.sparkContext.broadcast(tables), model).collect()
    base, plain = unknown.collect()[0]["unknown"], by_words(texts)
    spelled = lambda w: float(C._spelled([("en", w)], tables)[0])
    assert len(rows) == len(asked)
    for r in rows:
        got = r.spelled + r.n_words * base + r.saved
        assert math.isclose(got, plain(asked[r.doc_id] or "", spelled), rel_tol=1e-4, abs_tol=1e-3)


def varied(n, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghilmnoprstu"), size=k)) for k in rng.integers(2, 9, 400)]
    return [" ".join(rng.choice(words, size=k)) for k in rng.integers(60, 200, n)]


def left_behind(folder):
    sizes = Counter()
    for at in folder.rglob("*.parquet"):
        sizes[at.relative_to(folder).parts[0].rsplit("-", 1)[0]] += at.stat().st_size
    return sizes


def test_little_is_written_and_nothing_big_is_left(spark, tmp_path, monkeypatch):
    texts = varied(200, 12)
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id bigint, quality int, toxic int")
    rows = docs.selectExpr("doc_id", "text", "'en' as model")
    pairs = C.count_pairs(rows).toPandas()
    seen = len({p for t in texts for p in zip(["", *C._WORDS.findall(t)], [*C._WORDS.findall(t), " "])})
    assert sum(len(c) for c in pairs.select_dtypes("object").to_numpy().ravel() if isinstance(c, bytes)) < 20 * seen
    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    assert C.classify(docs, labels).count() == len(texts)
    left = left_behind(tmp_path)
    assert left and not {"trusted-texts", "pair-counts", "word-counts", "word-values", "word-weights", "pair-weights"} & set(left)


def test_parts_and_shards_change_no_bits(spark, monkeypatch):
    texts = [*varied(60, 13), "", "ab " * 500]
    frame = spark.createDataFrame([(i, f"en/{i % 2}", t) for i, t in enumerate(texts)], "doc_id bigint, model string, text string")
    tables = spark.sparkContext.broadcast(C.tables(C.kneser_ney(C._gram_counts(frame.selectExpr("'en' as language", "text")))))
    found = []
    for rounds, parts, bits in ((4, 4, 6), (2, 1, 9)):
        monkeypatch.setattr(C, "ROUNDS", rounds)
        monkeypatch.setattr(C, "PARTS", parts)
        model, _ = C.word_model(C.count_pairs(frame, bits), bits)
        found.append({r.doc_id: (r.n_words, r.spelled, r.saved) for r in C.word_bits(frame, tables, model, bits).collect()})
    assert found[0] == found[1] and len(found[0]) == len(texts)
