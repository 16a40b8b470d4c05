import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quiremill.llm import brown_lm as B

SCHEMA = "doc_id long, text string, n int, word string, class int"


def naive_likelihood(bigrams, classes):
    size = max(classes) + 1
    table = np.zeros((size, size))
    for i, a in enumerate(classes):
        for j, b in enumerate(classes):
            table[a, b] += bigrams[i, j]
    f = lambda x: sum(v * math.log(v) for v in np.ravel(x) if v > 0)
    return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))


def test_exchange_ends_where_no_single_move_helps():
    rng = np.random.default_rng(4)
    bigrams = rng.poisson(2.0, (14, 14)).astype(float)
    bigrams[:6, 6:12] += rng.poisson(30, (6, 6))
    fixed = [3, 4]
    found = B.exchange(bigrams, 3, rounds=50).tolist()
    best = naive_likelihood(bigrams, found + fixed)
    assert best > naive_likelihood(bigrams, [i % 3 for i in range(12)] + fixed)
    for w in range(12):
        for c in range(3):
            assert naive_likelihood(bigrams, found[:w] + [c] + found[w + 1:] + fixed) <= best + 1e-6


def brute(rows, classes, held):
    token_lists = [(i, [w.decode() for w in (t or "").encode().lower().split()] + [None]) for i, t in rows]
    counts = Counter(w for i, ws in token_lists if not held(i) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    state = lambda w: "end" if w is None else classes[w] if counts[w] else "unk"
    pairs, after, sizes, kinds = Counter(), Counter(), Counter(), Counter()
    for i, ws in token_lists:
        if not held(i):
            for a, b in zip([None, *ws], ws):
                pairs[state(a), state(b)] += 1
                after[state(a)] += 1
                sizes[state(b)] += 1
    for w in counts:
        kinds[state(w)] += 1

    def p_class(a, b):
        return (pairs[a, b] + B.BACKOFF * sizes[b] / total) / (after[a] + B.BACKOFF)

    def p(a, w):
        if state(w) == "unk":
            return sum(p_class(a, c) * B.DISCOUNT * kinds[c] / sizes[c] for c in sizes if c != "end")
        return p_class(a, state(w)) * ((counts[w] - B.DISCOUNT) / sizes[state(w)] if w is not None else 1.0)

    out = []
    for i, ws in token_lists:
        out.append((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), total,
                    sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws),
                    sum(math.log10(p(state(a), w)) for a, w in zip([None, *ws], ws))))
    for a in [*range(B.CLASSES), "end", "unk"]:        # a probability distribution after any state
        assert abs(sum(p(a, w) for w in counts) + p(a, "never seen") - 1) < 1e-9
    return out


@pytest.mark.parametrize("chunk", [40, B.CHUNK_TOKENS])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(B, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(B, "CORE_WORDS", 8)
    tables = {}
    monkeypatch.setattr(B, "stored", lambda df, name, keep=B.stored: tables.setdefault(name, keep(df, name)))
    rng = random.Random(2)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"V{i}" for i in range(20)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(12)) for w in ("the", rng.choice(nouns), rng.choice(verbs)))) for i in range(80)]
    rows += [(100, None), (101, ""), (None, "the n1"), (3, rows[3][1]), (102, "Été \t\n THE x" * 50), (103, "unseen words only here")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    held = B.crc_held(7, 2)
    got = [tuple(r) for r in B.score_documents(df, held).collect()]
    names = {xxhash.xxh64_intdigest(w): w.decode() for _, t in rows for w in (t or "").encode().lower().split()}
    lexicon = tables["lexicon"].collect()
    classes = {names[r.word & (1 << 64) - 1]: r["class"] for r in lexicon}
    assert len(classes) == len(lexicon)
    want = brute(rows, classes, lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2)
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6))
    assert sorted(map(key, got)) == sorted(map(key, want))
    better = [r for r in got if r[1] and r[2] == r[3]]
    assert sum(r[6] for r in better) > sum(r[5] for r in better)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", 0, "", 0), (2, None, 0, "", 0)], SCHEMA)
    assert B.score_documents(df.limit(0), B.crc_held(7, 2)).count() == 0
    rows = B.score_documents(df, lambda key: True).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)}
    [row] = [r for r in B.score_documents(df, lambda key: key == 1).collect() if r.doc_id == 1]
    assert math.isfinite(row.score) and row.n_known == 1


@pytest.mark.parametrize("share", [0.3, 0.01])
def test_core_is_counted_over_all_chunks(spark, monkeypatch, share):
    # "thin" never makes up much of a chunk but is the most frequent word of all; the others fill one chunk each.
    texts = [" ".join(["thin"] * 4 + [f"w{i}"] * (6 + i % 3) + [f"x{i}", "y"]) for i in range(12)]
    seen, plain = [], B.core_bigrams
    monkeypatch.setattr(B, "CHUNK_TOKENS", 1)
    monkeypatch.setattr(B, "CORE_SHARE", share)
    monkeypatch.setattr(B, "CORE_WORDS", 4)
    monkeypatch.setattr(B, "core_bigrams", lambda table, core: seen.append(core) or plain(table, core))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert B.score_documents(docs, lambda key: False).count() == 12
    times = Counter(w for t in texts for w in t.split())
    hashed = {w: np.uint64(xxhash.xxh64_intdigest(w.encode())) for w in times}
    best = sorted(times, key=lambda w: (-times[w], hashed[w].view(np.int64)))[:4]
    assert sorted(seen[0].tolist()) == sorted(int(hashed[w]) for w in best)
