"""Vector bin packing: laws of the result, against a greedy placement of all groups at once."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiremill.llm import vector_packing


def made(n, hot, seed):
    rng = random.Random(seed)
    texts = ["é" * rng.randrange(5) + "".join(rng.choice("abc  ") for _ in range(int(min(900, 30 * rng.paretovariate(1.3))))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(n + i, "copy of a text") for i in range(hot)] + [(None, None), (None, ""), (5, texts[5])]


def packed(spark, rows, shards):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("h", F.lit(1))
    return [r.asDict() for r in vector_packing.pack(docs, shards).collect()]


@pytest.mark.parametrize(("n", "hot", "shards", "parts"), [(3000, 0, 16, 1 << 18), (3000, 1500, 16, 400), (2500, 120, 5, 300)])
def test_balance_slots_and_groups(spark, monkeypatch, n, hot, shards, parts):
    monkeypatch.setattr(vector_packing, "PART_GROUPS", parts)
    rows = made(n, hot, n + hot)
    got = packed(spark, rows, shards)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), len((t or "").split())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["crc"], r["tokens"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(shards))
    for held in by.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    for name, most in (("size", 1.02), ("tokens", 1.08), (None, 1.08)):
        sums = [sum(r[name] if name else 1 for r in held) for held in by.values()]
        assert max(sums) <= most * sum(sums) / shards
    groups = defaultdict(Counter)
    for r in got:
        groups[r["crc"], r["size"]][r["shard"]] += 1
    split = [g for g, held in groups.items() if len(held) > 1]
    assert len(split) <= 1                                # the hot group: many rows, few bytes


def test_dot_product_rule():
    left = np.array([[0.5, 0.1, 0.5], [0.3, 0.6, 0.3], [0.9, 0.0, 0.9]])
    assert vector_packing.best_shard(np.array([0.1, 0.1, 0.1]), left) == (1, True)       # 0.12 against 0.11; the third has no room
    assert vector_packing.best_shard(np.array([0.1, 0.0, 0.1]), left) == (2, True)
    assert vector_packing.best_shard(np.array([1.0, 1.0, 1.0]), left) == (2, False)
    assert vector_packing.best_shard(np.zeros(3), np.ones((4, 3)), turn=2) == (2, True)


def test_a_group_is_split_only_as_far_as_needed():
    pieces = vector_packing.plan_heavy([(np.array([5.0, 5.0, 5.0]), 5000), (np.array([0.9, 0.9, 0.9]), 900)], np.ones((16, 3)))
    assert pieces[0] == 5 or pieces[0] == 8
    assert pieces[1] == 1
    assert vector_packing.plan_heavy([(np.array([3.0, 3.0, 3.0]), 1)], np.ones((4, 3))) == [1]     # one row is never cut


def test_empty_and_tiny_tables(spark):
    assert packed(spark, [], 4) == []
    got = packed(spark, [(None, None), (1, "x " * 100_000)], 4)
    assert sorted(r["size"] for r in got) == [1, 200_001] and all(r["slot"] == 0 for r in got)
