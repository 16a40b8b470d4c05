import random
import re
import time

from quiremill.llm import secret_scan as S

SCHEMA = "doc_id long, text string, label int, value string, score double"


def make_docs(n=300, seed=4):
    rng = random.Random(seed)
    words = ["the", "house", "river", "token", "window", "password", "garden", "Straße", "número"]
    rows, secrets = [], {}
    for i in range(n):
        body = rng.choices(words, k=30)
        kind, value = i % 6, None
        if kind == 0:
            value = "".join(rng.choices("0123456789abcdef", k=40))
            body[10] = f'token = "{value}"'
        elif kind == 1:
            value = "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
            body[10] = value
        elif kind == 2:
            body[10] = f"garden.house{rng.randrange(1000)}@mail{rng.randrange(9)}.example.com"
        elif kind == 3:
            body[10] = f"https://window.example.com/house/river-garden-{rng.randrange(10**6)}/index_{i}"
        secrets[i] = value
        rows.append((i, " ".join(body), 0, "x", 0.5))
    return rows, secrets


def test_finds_secrets_and_leaves_the_rest(spark):
    rows, secrets = make_docs()
    rows += [(1000, None, 0, "", 0.0), (1001, "", 0, "", 0.0), (None, rows[0][1], 0, "", 0.0), rows[0], (1002, "long word " * 50000, 0, "", 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = S.scan(docs)
    got = found.where("secret").collect()
    assert {(r.doc_id, r.value) for r in got if r.doc_id is not None and r.doc_id < 1000} == {(i, v) for i, v in secrets.items() if v}
    clean = S.redact(docs, found)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    for r in clean.collect():
        i = 0 if r.doc_id is None else r.doc_id
        text = next(t for d, t, *_ in rows if d == i)
        assert r.text == (text.replace(secrets[i], S.MASK) if secrets.get(i) else text)


def test_spans_do_not_overlap_and_known_shapes():
    text = 'key: "abc-def_0123456789abcdef==" x password=hunter2! AbCdEfGhIjKlMnOpQrStUvWx ofthhethshandmore'
    spans = S.candidates(text)
    assert [text[a:b] for a, b in spans] == ["abc-def_0123456789abcdef==", "hunter2!", "AbCdEfGhIjKlMnOpQrStUvWx"]
    assert S.coverage("rivergarden42", {"river", "garden"}) == 11 / 13


def test_unlabelled_alike_and_empty(spark):
    docs = spark.createDataFrame([(1, "password=notahexvalue", 0, "", 0.0)], SCHEMA)
    assert [r.score for r in S.scan(docs).collect()] == [1.0]
    assert [r.score for r in S.scan(spark.createDataFrame([(1, "order number 1234567890123", 0, "", 0.0)], SCHEMA)).collect()] == [0.0]
    empty = docs.limit(0)
    assert S.scan(empty).count() == 0 and S.redact(empty, S.scan(empty)).count() == 0


def test_dictionary_counts_everything(spark):
    docs = spark.createDataFrame([(1, "river, River (river) x1 garden"), (2, None)], "doc_id long, text string")
    assert S.dictionary(docs, share=0.5) == {"river"} and S.dictionary(docs) == {"river", "garden"}


def test_long_runs_take_time_in_proportion():
    began = time.perf_counter()
    for run in ("a" * 100_000, "B" * 100_000 + "c", "aB" * 50_000, "aB" + "c" * 100_000, "x" * 50_000 + "9" * 50_000, "a=" + "b" * 100_000, "key: " * 20_000):
        S.candidates(run)
    assert time.perf_counter() - began < 1
    old = re.compile(r"(?=.*[a-z].*[A-Z].*[a-z].*[A-Z])")
    rng = random.Random(4)
    for _ in range(3000):
        value = "".join(rng.choice("abAB/_") for _ in range(rng.randrange(12)))
        assert bool(S._MIXED.match(value)) == bool(old.match(value))
