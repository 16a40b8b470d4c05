import random
from collections import Counter

import numpy as np

from quiremill.llm import language_id as L
from quiremill.llm.common import remainder

SCHEMA = "doc_id long, text string, lang string, score double, lang_pred string"


def corpus(n=240):
    rng = random.Random(3)
    words = {"aa": ["the", "of", "and", "thing"], "bb": ["der", "und", "schön", "nicht"], "cc": ["él", "que", "año", "ción"]}
    rows = []
    for i in range(n):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.randint(3, 60))).capitalize(), lang, 0.0, ""))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus() + [(900, None, "aa", 0.0, ""), (901, "", "bb", 0.0, ""), (902, "123 !?", None, 0.0, ""), (903, "the of and " * 40000, None, 0.0, ""),
                       (None, "der und nicht", None, 0.0, ""), (0, "der und nicht schön", "bb", 0.0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = L.train(docs.where(remainder("doc_id", 4) != 2))
    assert model.languages == ["aa", "bb", "cc"] and (model.weights == 0).any()
    held = {r.doc_id for r in docs.where(remainder("doc_id", 4) == 2).collect()}
    got = L.identify(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: lang for i, _, lang, *_ in rows if i is not None and 0 < i < 900}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in held and r.doc_id in truth)
    others = {r.doc_id: r.lang_pred for r in got if (r.doc_id or 0) >= 900 or r.doc_id is None}
    assert others == {900: "und", 901: "und", 902: "und", 903: "aa", None: "bb"}
    kept = L.keep_known(docs, model, 0.3)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {900, 901, 902}


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "text", None, 0.0, "")], SCHEMA)
    assert [tuple(r) for r in L.identify(docs, L.train(docs)).collect()] == [(1, "und", 0.0)]
    assert L.identify(docs.limit(0), L.train(docs.limit(0))).count() == 0


def test_ngrams_over_block_borders(monkeypatch):
    text = "Abcäöü日本x" * 30
    whole = L.ngram_counts(text)
    monkeypatch.setattr(L, "BLOCK_CHARS", 7)
    assert (L.ngram_counts(text) == whole).all() and whole.sum() == 3 * len(text) - 3
    assert L.ngram_counts("a").sum() == 1 and L.ngram_counts("").sum() == 0


def test_document_frequencies_cover_all_rows(spark):
    rows = corpus(60)
    model = L.train(spark.createDataFrame(rows, SCHEMA), rows_per_language=5)
    df = Counter()
    for _, t, *_ in rows:
        df.update(np.flatnonzero(L.ngram_counts(t)).tolist())
    want = np.array([np.log((1 + len(rows)) / (1 + df[k])) + 1 for k in range(L.DIMS)])
    assert np.allclose(model.idf, want)


def test_language_of_few_texts_and_many_copies(spark):
    rng = random.Random(8)
    many = {" ".join(rng.choices(["der", "und", "schön", "nicht"], k=12)) for _ in range(300)}
    few = [" ".join(rng.choices(["the", "of", "and", "thing"], k=9)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in few], "text string")
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    few = [t for t in few if hashes[t] % 1_000_003 > 200_000][:6]       # none of them passed when rows were drawn
    hot = min(many, key=lambda t: spark.sql("select xxhash64(:t)", args={"t": t}).first()[0])
    rows = [(t, "aa") for t in few * 100] + [(t, "bb") for t in [*many, *[hot] * 300]] + [("él que año ción", "cc")] * 200
    docs = spark.createDataFrame([(i, t, lang, 0.0, "") for i, (t, lang) in enumerate(rows)], SCHEMA)
    model = L.train(docs, rows_per_language=20)
    got = {r.doc_id: r.lang_pred for r in L.identify(docs, model).collect()}
    assert [got[i] for i in range(len(rows))] == [lang for _, lang in rows]


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 4000)
    right = rng.random(4000) < 0.8
    logits = [np.array([9.0, -9.0]) * (1 if (y == 0) == r else -1) for y, r in zip(labels, right)]
    t = L.fit_temperature(logits, labels.tolist())
    assert abs(L.softmax(np.array([9.0, -9.0]) / t)[0] - 0.8) < 0.03
