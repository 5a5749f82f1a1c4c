import random

from tidemark.llm import line_dedup

MIN = line_dedup.MIN_CHARS


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    a, b = sorted((a, b), key=len)
    return a[i:] == b[i + 1 :]


def by_hand(rows):
    places = [
        ((d if d is not None else -1, i), line.strip(" "))
        for d, t in dict.fromkeys(rows) if t is not None for i, line in enumerate(t.split("\n"))
    ]
    places = sorted(p for p in places if len(p[1]) >= MIN)
    dropped, near = set(), set()
    for k, (at, line) in enumerate(places):
        same = any(line == other for _, other in places[:k])
        if same or any(within_one(line, other) for _, other in places[:k]):
            dropped.add(at)
            if not same:
                near.add(at)
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0))
            continue
        key = d if d is not None else -1
        lines = [x for i, x in enumerate(t.split("\n")) if (key, i) not in dropped]
        out.append((d, "\n".join(lines), sum(1 for a in near if a[0] == key)))
    return out


def edited(line):
    i = random.randrange(len(line))
    return random.choice([line[:i] + line[i + 1 :], line[:i] + "é" + line[i:], line[:i] + "z" + line[i + 1 :], line[:i] + "\U0001f600" + line[i:]])


def corpus():
    random.seed(7)
    fresh = lambda n: "".join(random.choices("abcdeé  ", k=n)).strip().ljust(n, "q")
    pool = [fresh(random.choice([MIN - 1, MIN, MIN + 1, 40, 41, 120, 700])) for _ in range(40)]
    pool += ["Page number 000 of the long book", "x" * 5000, "ab" * 40]
    for _ in range(160):
        pool.append(edited(random.choice(pool)))
    pool += [f"Page number {i:03d} of the long book" for i in range(0, 300, 7)]
    rows = []
    for d in range(90):
        lines = random.choices([*pool, "", "  ", "}"], k=random.randint(0, 9))
        rows.append((d, "\n".join(f" {x}" if random.random() < 0.1 else x for x in lines)))
    return rows + [(200, None), (201, ""), (None, pool[3] + "\n" + fresh(50)), (5, rows[5][1]), (5, rows[5][1])]


def test_kept_lines_equal_all_pairs(spark):
    rows = corpus()
    frame = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id bigint, text string, keep string").repartition(4)
    got = line_dedup.dedup_lines(frame).select("doc.doc_id", "text", "n_near").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    want = by_hand(rows)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(w[2] for w in want) > 50


def test_stage_keeps_columns_and_drops_emptied_documents(spark):
    line = "this line is long enough to count"
    rows = [(1, line, 33, "a"), (2, line, 33, "b"), (3, line + "\nshort", 39, "c"), (4, "", 0, "d"), (5, None, None, "e")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, n_kept string")
    got = line_dedup.drop_repeated_lines(frame)
    assert got.columns == frame.columns
    assert sorted(map(tuple, got.collect())) == [(1, line, 33, "a"), (3, "short", 5, "c"), (4, "", 0, "d"), (5, None, None, "e")]


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
