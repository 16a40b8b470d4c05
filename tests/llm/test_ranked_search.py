"""Ranked search against scores of all documents in plain Python."""
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiremill.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, k):
    docs = [(d, words_of(t)) for d, t in docs if words_of(t)]
    n, length = len(docs), sum(len(w) for _, w in docs)
    held = Counter(t for _, w in docs for t in set(w))
    out = []
    for item, text in sorted(set((i, t) for i, t in items if t is not None)):
        scores = []
        for d, w in docs:
            tf, m = Counter(w), 100 - 75 + (75 * len(w) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
                        for t in words_of(text) if tf[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def made(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.4)) % 300}" for _ in range(400)] + ["É", "é", "Ab", "aB", "x_y", "日本"]
    text = lambda most: "".join(rng.choice(words) + rng.choice(" -_.\n") for _ in range(rng.randrange(most)))
    docs = [(i, rng.choice([None, text(80), text(80), text(12), text(12)])) for i in range(n)]
    docs += [(n, docs[0][1]), (None, docs[1][1]), (n + 1, ""), (3, docs[3][1])]
    items = [(i, text(15)) for i in range(20)] + [(3, "w1 w1 w2"), (50, None), (51, ""), (52, "nowhere")]
    return docs, items + items[:2]


@pytest.mark.parametrize("block", [7, 1 << 13])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "DOC_BLOCK", block)      # workers are started with the module; the rank function reads it there
    docs, items = made(300, block)
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("item_id", F.lit(0))
    got = ranked_search.search(left, spark.createDataFrame(items, "item_id long, text string"), k=5).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=repr) == brute_force(docs, items, 5)


def test_questions_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERY_BYTES", 300)
    docs, items = made(120, 1)
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=10)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(docs, items, 10)


def test_no_accumulator_beyond_the_bound(spark):
    """A frequent term of little weight opens none, yet the survivors' scores hold it."""
    rows = 1000
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(rows)), pa.array([10] * rows), pa.array([[0, 1] if i < 20 else [1] for i in range(rows)], pa.list_(pa.int32())),
         pa.array([[1, 1] if i < 20 else [1] for i in range(rows)], pa.list_(pa.int64()))], ["key", "n", "terms", "tf"])
    corpus = ranked_search.Corpus(rows, 10 * rows, {0: 20, 1: rows})
    block = ranked_search._Block(batch, corpus)
    query = [(0, corpus.weight(0)), (1, corpus.weight(1) + 1)]
    places, scores = ranked_search.best_of_block(block, query, 10, 0)
    assert places.tolist() == list(range(20)) and len(set(scores.tolist())) == 1
    assert scores[0] == sum(block.lists[t][2] * w for t, w in query)


def test_empty_tables_and_very_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(none, items).count() == 0
    docs = [(1, "a " * 200_000), (2, "b" * 300_000 + " a"), (3, "b")]
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(docs, [(1, "a b")], 10)
    assert ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string"), items.limit(0)).count() == 0
