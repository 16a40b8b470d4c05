import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quiremill.llm import token_trees as T
from quiremill.llm.queries import sample_edits

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, tokens int, label string"


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as f:
        return T.PieceCounter(f.read())


def test_random_edits_equal_a_full_encoding(counter):
    rng = random.Random(6)
    pool = ["the", " the", "  ", "\n\n", " \n", "don't", "'s", "123", " 45", "!?", " ...", "É", "日本", "\U0001F600", "x", " ", "\t", "\x1c", "\x85", "\u3000"]
    for size in [0, 1, 3, 60, 400, 2000]:
        text = "".join(rng.choices(pool, k=size))
        tree = T.TokenTree.of(text, counter)
        for _ in range(150):
            new = "".join(rng.choices(pool, k=rng.choice([0, 0, 1, 2, 5, 200])))
            start, length = rng.randrange(len(text) + 3), rng.choice([0, 1, 2, 7, 300, 5000])
            text, n = tree.edit(text, start, length, new, counter)
            pieces = counter.pattern.findall(text)
            assert tree.pack() == T.TokenTree.of(text, counter).pack() and tree.chars == len(text)
            assert tree.tokens == len(counter.encoding.encode_ordinary(text)) and tree.pieces == len(pieces)
            if size == 2000 and len(new) < 10:
                assert n < 40                   # only the surroundings are encoded
        assert T.TokenTree.unpack(tree.pack()).tokens == tree.tokens


def test_rows_and_odd_edits(spark, counter):
    rows = [(1, "one two three", 0, "x"), (2, None, 0, "x"), (3, "", 0, "x"), (1, "one two three", 0, "x"), (None, "no key", 0, "x"),
            (4, "long text, " * 30000, 0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    edits = spark.createDataFrame(
        [(1, 2, 0, 3, "1"), (1, 1, 4, 3, "zwei"), (2, 1, 5, 5, "new"), (4, 1, 100, 7, None), (None, 1, 99, 1, "!"), (9, 1, 0, 0, "none")],
        "doc_id long, seq int, start int, length int, replacement string")
    trees = T.build_trees(docs, PATH)
    got = T.apply_edits(T.with_edits(trees, edits), PATH).collect()
    count = lambda t: len(counter.encoding.encode_ordinary(t or ""))
    want = {1: "1 zwei three", 2: "new", 3: "", None: "no key!", 4: ("long text, " * 30000)[:100] + ("long text, " * 30000)[107:]}
    assert len(got) == len(rows)
    for r in got:
        before = next(t for i, t, *_ in rows if i == r.doc_id)
        assert (r.text, r.n_tokens, r.n_tokens_edited, r.label) == (want[r.doc_id], count(before), count(want[r.doc_id]), "x")
    assert T.apply_edits(T.with_edits(trees.limit(0), edits), PATH).count() == 0


def test_query_edits_against_brute_force(spark, counter):
    rng = random.Random(9)
    texts = ["", "a", *[" ".join(rng.choices(["river", "don't", "42", "é,"], k=rng.randrange(200))) for _ in range(20)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("edits", sample_edits(F.col("text")))
    got = T.apply_edits(T.build_trees(docs, PATH), PATH).collect()
    for r in got:
        text, n = texts[r.doc_id], len(texts[r.doc_id])
        for start, length, new in ((n // 3, 0, text[:40]), (n // 2, 25, ""), (n * 3 // 4, 10, " in 2024, it's\n\n new")):
            text = text[:start] + new + text[start + length:]
        assert hashlib.sha256(r.text.encode()).digest() == hashlib.sha256(text.encode()).digest()
        assert r.n_tokens_edited == len(counter.encoding.encode_ordinary(text))
