import hashlib
import math
import random
import re

import pytest
import xxhash

from quiremill.llm import imatch

SCHEMA = "doc_id long, text string, term string, block int, n_chars int"


def hashes(text):
    found = {w for w in re.split(r"[\W_]+", text.lower()) if w}
    return {h - (1 << 64) if h >> 63 else h for h in (xxhash.xxh64_intdigest(w.encode(), 42) for w in found)}


def brute(rows, band):
    rows = [(i, t or "") for i, t in rows]
    df = {}
    for _, t in rows:
        for h in hashes(t):
            df[h] = df.get(h, 0) + 1
    lexicon = {h for h, n in df.items() if len(rows) * math.exp(-band[1]) <= n <= len(rows) * math.exp(-band[0])}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))

    def subsets(text):
        mine = hashes(text) & lexicon
        return [frozenset(h for h in mine if h >> first & (1 << bits) - 1 == value)
                for bits, first, count in imatch.SUBSETS for value in range(count)]

    def near(a, b):
        x, y = subsets(a), subsets(b)
        some = [(p, q) for p, q in zip(x, y) if p or q]
        return sum(p == q for p, q in some) / len(some) if some else float(a == b)
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), near(t, edited), near(t, after)))
    return out


def got(spark, rows, band=imatch.IDF_BAND):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    return imatch.fingerprint_edits(df, band=band).collect()


@pytest.mark.parametrize("limit", [imatch.BROADCAST_TERMS, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", limit)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Été", "日本", "the"]
    rows = [(rng.randrange(10**6), " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 80, 400])))) for _ in range(150)]
    rows += [(7, None), (8, ""), (9, "\U0001F600 the"), (-5, rows[0][1]), (None, "null key one"), (None, "null key two"),
             (10, "same"), (10, "same"), (10, "other"), (11, "very long " * 40000)]
    found = got(spark, rows, (0.1, 7.0))
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 9), round(r[4], 9))
    mine = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found]
    assert sorted(map(key, mine)) == sorted(map(key, brute(rows, (0.1, 7.0))))


def test_equal_texts_have_equal_fingerprints(spark):
    found = got(spark, [(1, "a b c"), (2, "zz"), (3, "a b c"), (4, "")])
    prints = {r.doc_id: r.fingerprint for r in found}
    assert prints[1] == prints[3] and len({prints[1], prints[2], prints[4]}) == 3


def test_empty_table_and_single_row(spark):
    assert imatch.fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    [row] = got(spark, [(3, "abcd")])
    assert (row.edited_sha256, row.near_next) == (hashlib.sha256(b"abab").hexdigest(), 1.0)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    plan = imatch.fingerprint_edits(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
