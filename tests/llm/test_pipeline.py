import random
import re

import pytest
from public_tokenizers import path
from test_simhash import brute_components, five_words
from tokenizers import Tokenizer

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "Eaea ndorea as erthndly edst threeain for heed thheha thatnd the thnt estion ntes a onenble"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents with known copies, leaks and secrets, and what each stage must leave of them."""
    rng = random.Random(7)
    syllables = {"en": ["th", "on", "er", "ing", "and"], "de": ["sch", "ung", "en", "keit", "ü"]}
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        words = ["".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(8, 120))]
        text = " ".join(words).capitalize()
        if i % 12 == 3:
            text += " " + ITEM + " end."
        elif i % 12 == 5:
            text += ' token = "' + "".join(rng.choices("0123456789abcdef", k=40)) + '" end'
        rows.append((i, text, lang, "s", len(text)))
    for k in range(40, 60):            # near copies: one word in a hundred is another
        words = ["".join(rng.choices(syllables["en"], k=rng.randint(2, 6))) for _ in range(300)]
        rows.append((400 + k, " ".join(words), "en", "s", len(" ".join(words))))
        words[50] = words[250] = "changed"
        rows.append((500 + k, " ".join(words), "en", "s", len(" ".join(words))))
    rows += [(200 + k, rows[k][1], rows[k][2], "copy", rows[k][4]) for k in range(8)] + [rows[10], (None, rows[11][1], "en", "s", 5)]
    rows += [(300, None, "en", "s", 0), (301, "", "en", "s", 0), (302, "12 34 !", "en", "s", 7), (303, "very longthing text " * 9000, "en", "s", 180000)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_stages_against_brute_force(spark, made):
    folder, rows = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(P.STAGES)
    kept = stages["language_id"](spark, docs, folder)
    want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert kept.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, want))

    unique = stages["simhash_near_dedup"](spark, spark.createDataFrame(want, SCHEMA), folder)
    shingles = {r[0]: five_words(r[1]) for r in want if r[0] is not None}
    groups = brute_components(sorted(shingles), lambda i, j: len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]))
    assert len(set(groups.values())) <= len(groups) - 28
    want = [r for k, r in enumerate(want) if r[0] is not None and groups[r[0]] == r[0] and r not in want[:k]]
    assert unique.columns == docs.columns and sorted(tuple(r) for r in unique.collect()) == sorted(want)

    clean = stages["benchmark_decontamination"](spark, spark.createDataFrame(want, SCHEMA), folder)
    want = [r for r in want if ITEM not in r[1]]
    assert sorted(tuple(r) for r in clean.collect()) == sorted(want)

    safe = stages["secret_scan"](spark, spark.createDataFrame(want, SCHEMA), folder)
    hide = lambda t: re.sub('(token = ")[0-9a-f]{40}"', r'\1[SECRET]"', t)
    want = [(i, hide(t), lang, s, n if hide(t) == t else len(hide(t))) for i, t, lang, s, n in want]
    assert sorted(tuple(r) for r in safe.collect()) == sorted(want) and any("[SECRET]" in r[1] for r in want)

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    last = {r.doc_id: r for r in stages["bpe_encoding"](spark, spark.createDataFrame(want, SCHEMA), folder).collect()}
    assert {i: r.ids for i, r in last.items()} == {r[0]: library.encode(r[1], add_special_tokens=False).ids for r in want}

    whole = P.run(spark, folder)
    assert sorted((r.doc_id, r.n_tokens) for r in whole.select("doc_id", "n_tokens").collect()) == sorted((i, r.n_tokens) for i, r in last.items())


def test_empty_table(spark, made, tmp_path):
    folder, _ = made
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
