import random

import numpy as np
import pytest

from tidemark.llm import token_counts, tokens
from tidemark.llm.common import new_folder


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_counts_equal_the_tokenizer(spark, block):
    random.seed(block)
    texts = [None, "", " ", "one", *("word " * random.choice([0, 1, 5, 40, 400]) for _ in range(25)), "<|endoftext|>"]
    rows = [(None if i == 3 else i, t, "x") for i, t in enumerate(texts)] + [(2, " ", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, file string").repartition(3)
    if block == 1:
        docs = docs.where("length(text) < 30 or text is null")
    got = token_counts.count_tokens(docs, block=block).select("doc_id", "n_tokens").collect()
    want = [(r.doc_id, len(tokens.encode_array(r.text))) for r in docs.collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_foreign_files(spark):
    from tidemark.llm import store

    folder = new_folder(spark, "tokens-test")
    ids = [5, 6, 50256, 50256, 7, 50256, 8, 9]
    with store.whole_file(folder, "a.tokens") as out:
        out.write(np.array(ids, "<u2").tobytes())
    with store.whole_file(folder, "b.tokens") as out:
        out.write(b"")
    for block in (1, 2, 3, 100):
        got = token_counts.scan_token_files(spark, folder, block).collect()
        assert sorted(map(tuple, got)) == [("a.tokens", 0, 2), ("a.tokens", 1, 0), ("a.tokens", 2, 1)]


def test_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_markers_and_long_white_space(spark):
    rows = [(1, "a<|endoftext|>b"), (2, "x" + " " * 1_000_000), (3, "\n" * 1_000_000)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 9, 2: 1_000_001, 3: 500_000}
