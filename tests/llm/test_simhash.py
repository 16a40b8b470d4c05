import random

import xxhash
from pyspark.sql import functions as F

from quiremill.llm import simhash
from quiremill.llm.components import components

SCHEMA = "doc_id long, text string, fp string, mask int"      # clashing extra columns


def brute_fp(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words] if len(words) < size else [words[i:i + size] for i in range(len(words) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, near):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in items:
        for j in items:
            if i < j and near(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in items}


def five_words(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_keep_one_of_similar_texts(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    rows, groups = [], {}
    for g in range(40):
        base = rng.choices(words, k=rng.randint(100, 400))
        for c in range(rng.choice([1, 2, 5])):
            text = list(base)
            for _ in range(len(base) // 100 if c else 0):
                text[rng.randrange(len(base))] = rng.choice(words)
            rows.append((len(rows), " ".join(text), "x", 1))
            groups.setdefault(g, []).append(len(rows) - 1)
    rows += [(900, None, "x", 1), (901, "", "x", 1), (None, rows[0][1], "x", 1), rows[0]]
    half = rows[3][1].split()
    rows.append((902, " ".join(half[:len(half) // 2] + rng.choices(words, k=len(half) // 2)), "x", 1))      # half the text is another
    want = sorted(g[0] for g in groups.values()) + [900, 902]
    for limit in (simhash.GROUP_ROWS, 3):
        monkeypatch.setattr(simhash, "GROUP_ROWS", limit)
        kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
        assert kept.columns == ["doc_id", "text", "fp", "mask"] and sorted(r.doc_id for r in kept.collect()) == want
    assert simhash.keep_one(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_keep_one_at_the_border_and_in_crowded_keys(spark, monkeypatch):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(50000)]
    texts = []
    for k in range(300):                  # appended, cut off or replaced in one run: similarities from 0.78 to 0.85
        base = rng.choices(words, k=rng.randint(150, 500))
        new = rng.choices(words, k=round(len(base) * (1 / rng.uniform(0.78, 0.85) - 1)))
        at = rng.randrange(len(base) - len(new))
        other = [base + new, base[len(new):], base[:at] + new[:len(new) // 2] + base[at + len(new) // 2:]][k % 3]
        texts += [" ".join(base), " ".join(other)]
    passage = rng.choices(words, k=60)
    for _ in range(40):                   # one passage in all; chains in which only neighbours are similar
        text = passage + rng.choices(words, k=40)
        for _ in range(3):
            texts.append(" ".join(text))
            text = text[:60] + text[68:] + rng.choices(words, k=8)
    texts += [" ".join(passage[:k]) for k in range(5, 60)]
    shingles = [five_words(t) for t in texts]
    holders = {}
    for i, s in enumerate(shingles):
        for x in s:
            holders.setdefault(x, set()).add(i)
    met = {i: set().union(*(holders[x] for x in s)) for i, s in enumerate(shingles)}
    near = lambda i, j: j in met[i] and 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j])
    want = sorted(set(brute_components(range(len(texts)), near).values()))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    for limit in (simhash.GROUP_ROWS, 4):
        monkeypatch.setattr(simhash, "GROUP_ROWS", limit)
        assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == want


def test_keep_one_on_all_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder.replace('0.001', '0.01')}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    shingles = {r.doc_id: five_words(r.text) for r in rows}
    holders = {}
    for i, s in shingles.items():
        for x in s:
            holders.setdefault(x, set()).add(i)
    met = {i: set().union(*(holders[x] for x in s)) if s else {j for j, o in shingles.items() if not o} for i, s in shingles.items()}
    near = lambda i, j: j in met[i] and 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j])
    want = sorted(set(brute_components(sorted(shingles), near).values()))
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want
    assert len(want) < len(rows)


def test_long_fingerprints_measure_similarity():
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}".encode() for _ in range(3000)]
    for share in (0.005, 0.01, 0.02):
        other = [w if rng.random() > share else b"new%d" % rng.randrange(10**6) for w in base]
        a, b = five_words(b" ".join(base).decode()), five_words(b" ".join(other).decode())
        bits = sum(((int(x) ^ int(y)) & (1 << 64) - 1).bit_count()
                   for x, y in zip(simhash.long_fingerprint(base, 5), simhash.long_fingerprint(other, 5)))
        jaccard = len(a & b) / len(a | b)
        assert simhash.most_bits(min(1, jaccard + 0.06)) - 25 <= bits <= simhash.most_bits(jaccard - 0.06) + 10


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = simhash.near_duplicates(df).collect()
    fps = {i: brute_fp(t, 3) for i, t in rows}
    want = brute_components(sorted(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component) for r in got) == sorted((i, fps[i], want[i]) for i, _ in rows)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 30)       # several levels of longer keys
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "Ünd", "日本"]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 20, 300])))))
    base = [rng.choice(words) for _ in range(400)]
    for i in range(60, 120):
        base[rng.randrange(400)] = rng.choice(words)
        rows.append((i, "\t".join(base).upper()))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One"), (204, "one"), (205, "a long text " * 60000)]
    check(spark, rows)


def test_null_keys_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d", "", 0), (5, "a b c d", "", 0), (5, "a b c d", "", 0)], SCHEMA)
    assert sorted((r.doc_id or 0, r.component) for r in simhash.near_duplicates(df).collect()) == [(0, 5), (5, 5), (5, 5)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_submasks_nest_and_cover():
    for mask in (0, (1 << 40) - 1):
        parts = [m ^ mask for m in simhash.submasks(mask, 4)]
        assert sum(parts) == ~mask & (1 << 64) - 1 and all(not p & mask for p in parts)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {299: 299, 300: 299}
    assert got == want


def test_pipeline_default_is_whole_text(spark):
    a, b = "x y z " * 5000 + "tail one", "x y z " * 5000 + "other end"
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert df.count() == 2 and simhash.near_duplicates(df).select(F.countDistinct("component")).first()[0] == 1


def test_near_sets_meet_by_their_simhash(spark):
    rows = [(i, 10, (i << 5 | low) - (1 << 62)) for i, low in ((1, 0), (2, 7), (3, 31))]
    rows += [(9, 10, rows[0][2]), (8, 0, rows[0][2])]
    got = simhash._simhash_pairs(spark.createDataFrame(rows, "node long, size int, fp long")).collect()
    apart = {(a[0], b[0]) for a in rows for b in rows if a[0] > b[0] and a[1] and b[1] and bin((a[2] ^ b[2]) & (1 << 64) - 1).count("1") <= 3}
    assert apart >= {(r.a, r.b) for r in got} >= {(3, 2), (9, 1)}


def test_shared_shingles_of_a_bucket_leave_in_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa
    monkeypatch.setattr(simhash, "ROWS_OUT", 100)
    rng = np.random.default_rng(1)
    sets = {int(n): np.unique(rng.integers(0, 300, 40)).astype(np.uint32) for n in range(-20, 20)}
    packs = []
    for b in (3, 5):
        for half in (list(sets)[:25], list(sets)[15:]):                    # some nodes come twice
            packs.append((b, np.concatenate([sets[n] for n in half]).tobytes(), np.array([len(sets[n]) for n in half], np.uint32).tobytes(),
                          np.array(half, np.int64).tobytes()))
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*packs), (pa.int64(), *[pa.binary()] * 3))], ["b", "g", "l", "n"])
    out = list(simhash._count_buckets(iter([batch])))
    assert max(o.num_rows for o in out) == 100
    held = {g: [n for n in sets if g in sets[n]] for g in range(300)}
    want = sorted((n, b << 32 | g, len(held[g])) for b in (3, 5) for g in held for n in held[g] if len(held[g]) > 1)
    assert sorted(tuple(r.values()) for o in out for r in o.to_pylist()) == want
