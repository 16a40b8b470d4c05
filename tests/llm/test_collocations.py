"""Phrase collocations against counting in plain Python."""
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quiremill.llm import collocations

KINDS = "doc_id long, text string, lang string"


def brute_force(rows, least, longest, inside, top):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            held = counts.setdefault(lang, Counter())
            for size in range(1, longest + 1):
                held.update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    covered[p[i:i + size]] = max(covered[p[i:i + size]], a)
        found = []
        for p, a in candidates.items():
            if p in covered and covered[p] * 100 >= inside * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((" ".join(p), a, left, right, totals[lang], score))
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(found[:top], 1)]
    return sorted(out)


def made(n, seed):
    rng = random.Random(seed)
    words = ["a", "b", "C", "d", "É", "ß", "in", "x-y", "z'", "日本", "q\x1cr", " "]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "! "]) for _ in range(rng.randrange(0, 60)))
        rows.append((i, rng.choice([None, text, text, text]), rng.choice(["en", "en", "fr", None])))
    return rows + rows[:5]


@pytest.mark.parametrize(("longest", "top"), [(3, 2000), (2, 5), (4, 50)])
def test_equals_brute_force(spark, longest, top, monkeypatch):
    monkeypatch.setattr(collocations, "TRIE_PHRASES", 40)       # several tries, in several passes
    monkeypatch.setattr(collocations, "TRIES_AT_ONCE", 2)
    rows = made(150, longest)
    docs = spark.createDataFrame(rows, KINDS).withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(1))
    got = collocations.collocations(docs, least=4, longest=longest, inside=50, top=top).collect()
    assert sorted(map(tuple, got)) == brute_force(rows, 4, longest, 50, top)


def test_empty_null_and_very_long(spark):
    assert collocations.collocations(spark.createDataFrame([], KINDS)).count() == 0
    rows = [(1, None, None), (2, "", "en"), (3, "the cat " * 40_000, "en"), (4, "!!!", None)]
    got = collocations.collocations(spark.createDataFrame(rows, KINDS)).collect()
    assert sorted(map(tuple, got)) == brute_force(rows, 10, 3, 50, 2000)


def test_hashes_are_those_of_spark(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("fr"), F.lit("été")).alias("h")).first()
    want = xxhash.xxh64_intdigest("été".encode(), collocations._lang_seed(b"fr"))
    assert row["h"] & (1 << 64) - 1 == want


def test_trie_holds_its_rows_only():
    rng = np.random.default_rng(3)
    units = np.unique(rng.zipf(1.3, (4000, 4)) % collocations.UNIT, axis=0)
    base, check, ends = collocations.build_trie(units)
    assert len(set(ends.tolist())) == len(units)
    known = {tuple(r): e for r, e in zip(units.tolist(), ends.tolist())}
    for row in [*units[:500].tolist(), *(rng.zipf(1.3, (500, 4)) % collocations.UNIT).tolist()]:
        state = 0
        for u in row:
            to = int(base[state]) + u
            state = to if state is not None and check[to] == state else None
            if state is None:
                break
        assert state == known.get(tuple(row))


def test_a_position_is_walked_in_one_trie(monkeypatch):
    """However many tries are broadcast, a text position is walked in the one its phrase can be in, and counts are exact."""
    class Shared:
        def __init__(self, value):
            self.value = value

    rng = np.random.default_rng(5)
    words = np.concatenate([[0], rng.integers(1, 2**63, 300)]).astype(np.uint64)
    codes = (rng.zipf(1.2, 20_000) % 301).astype(np.int32)
    every = [np.full(1 << collocations.MAP_BITS - 6, 2**64 - 1, np.uint64)]
    at, found = collocations._safe(words, codes, 2, every)
    phrases = list(zip(words[codes[at]].view(np.int64).tolist(), words[codes[at + 1]].view(np.int64).tolist()))
    dealt = dict(zip(phrases, (collocations._deal(found) % 3).tolist()))
    tries, names = {}, {}
    for block in range(3):
        rows = sorted(p for p, b in dealt.items() if b == block)
        table = pa.table({"block": [block] * len(rows), "w1": [r[0] for r in rows], "w2": [r[1] for r in rows]})
        trie = collocations._tries(2)(table).to_pylist()[0]
        tries[block] = tuple(np.frombuffer(trie[n], t) for n, t in (("words", np.int64), ("base", np.int32), ("check", np.int32)))
        names |= {(block, e): r for e, r in zip(np.frombuffer(trie["ends"], np.int32).tolist(), rows)}
    walked, walk = [], collocations._walk
    monkeypatch.setattr(collocations, "_walk", lambda trie, w, c, at, size: walked.append(len(at)) or walk(trie, w, c, at, size))
    chunk = pa.RecordBatch.from_pydict({"words": [words.tobytes()], "codes": [collocations._packed(codes)]},
                                       schema=pa.schema({"words": pa.binary(), "codes": pa.binary()}))
    got = pa.Table.from_batches(collocations._occurrences(Shared(tries), 2, Shared(every), 3)(iter([chunk]))).to_pylist()
    assert sum(walked) == len(at) and len(walked) == 3
    assert {names[r["block"], r["state"]]: r["n"] for r in got} == Counter(phrases)


def test_chunks_are_small_rows_in_small_files(spark, monkeypatch):
    """A chunk is stored as packed bytes, few in a file, and goes to workers in batches of bounded size."""
    tables, keep = {}, collocations.stored
    monkeypatch.setattr(collocations, "stored", lambda df, name, **options: tables.setdefault(name, keep(df, name, **options)))
    monkeypatch.setattr(collocations, "FILE_CHUNKS", 2)
    monkeypatch.setattr(collocations, "POOL", 50)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(i, "one two three four. " * 20, "en") for i in range(40)], KINDS).coalesce(1)
    collocations.frequent_phrases(docs)
    chunks = tables["chunks"]
    assert dict(chunks.dtypes) == {"words": "binary", "codes": "binary"}
    files = [r["count"] for r in chunks.groupBy(F.input_file_name()).count().collect()]
    assert sum(files) > 2 and max(files) <= 2
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20
