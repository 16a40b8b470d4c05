"""Errors of single steps, and type rules by words against their patterns."""
import re

import pytest
from pyspark.sql import functions as F

from quiremill.functions import text as X
from quiremill.functions import values as V
from quiremill.operators import documents as D

KINDS = "doc_id long, text string"


def test_a_failing_step_leaves_the_others(spark):
    def first_number(text):
        return int(re.findall(r"\d+", text)[0])

    steps = [D.Step("first_number", first_number, "bigint"), D.Step("words", str.split, "array<string>")]
    rows = [(1, "Mail a@b.com 42 times"), (2, "no digit here"), (3, None), (4, ""), (5, "Invoice from Acme\nTotal: , due 7")]
    got = {r.doc_id: r for r in D.analyze(spark.createDataFrame(rows, KINDS), steps=steps).collect()}
    assert len(got) == 5
    assert (got[1].n_emails, got[1].first_number, got[1].words, got[1].errors) == (1, 42, ["Mail", "a@b.com", "42", "times"], ["classify: no rule fits"])
    assert got[2].errors == ["classify: no rule fits", "first_number: IndexError: list index out of range"]
    assert got[2].first_number is None and got[2].words == ["no", "digit", "here"]
    assert got[3].errors[0] == "extract_text: missing" and got[3].first_number is None and got[3].words is None
    assert got[4].errors[0] == "extract_text: empty" and got[4].errors[-1].startswith("first_number: IndexError")
    assert got[5].doc_type == "invoice" and "normalize: no number in total" in got[5].errors and got[5].first_number == 7


def test_errors_stay_short(spark):
    def fail(text):
        raise ValueError(text * 1000)

    row = D.analyze(spark.createDataFrame([(1, "long")], KINDS), steps=[D.Step("own", fail)]).first()
    assert row.own is None and len(row.errors[-1]) == D.ERROR_CHARS


@pytest.mark.parametrize("case", [str, str.upper])
def test_word_lookup_equals_the_patterns(spark, case):
    """Every pattern alone, in a text, cut short, run together with letters, digits and signs."""
    sample = {r"\binv[-\s]?\d+": "inv-12", r"\bdate.*:": "dates of all:", r"\bname.*:": "name x:", r"\bالاسم.*:": "الاسم ك:"}
    texts = []
    for _, _, patterns in V.DOCUMENT_RULES:
        for p in patterns:
            word = sample.get(p, p.replace(r"\b", ""))
            texts += [word, f"a {word}, b", f"x{word}", f"{word}9", f"_{word}", f"({word})", f"{word}-{word}", word.replace(" ", "  "), word.replace(" ", "\n"),
                      f"é{word}", f"{word}́", word[:-1], f"{word}‍", f"{word} z"]
    rows = [(i, case(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, KINDS).withColumn("s", F.lower("text"))
    flat = [(k, i, p) for k, _, patterns in V.DOCUMENT_RULES for i, p in enumerate(patterns)]
    docs = docs.withColumn("w", X.rule_words(F.col("s"))).select("*", *[m.alias(f"m_{k}") for k, m in X.rule_masks(F.col("s"), F.col("w")).items()])
    by_regex = [F.col("s").rlike("(?idU)" + p).alias(f"r_{k}_{i}") for k, i, p in flat]
    wrong = []
    for r in docs.select("s", *[f"m_{k}" for k, _, _ in V.DOCUMENT_RULES], *by_regex).collect():
        wrong += [(r.s, p) for k, i, p in flat if bool(r[f"m_{k}"] >> i & 1) != r[f"r_{k}_{i}"]]
    assert not wrong
