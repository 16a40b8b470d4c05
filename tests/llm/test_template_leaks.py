import random
import re

import pytest

from quiremill.llm import template_leaks as T

DOCS = "doc_id long, text string, item_id int, h int, size int"
ITEMS = "item_id long, text string, key int"
ITEM = ("The farmer sells eggs near Boston for 12 dollars each week. Later the farmer meets Anna and gives her "
        "3 kg of corn because Anna paid 12 coins for the eggs.")


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 9) for i, t in items], ITEMS)
    found = T.leaks(d, b, **options)
    rest = T.remove(d, found)
    assert rest.columns == d.columns
    return {(r.doc_id, r.item_id): r for r in found.collect()}, sorted((r.doc_id or -1) for r in rest.collect())


def test_verbatim_changed_and_inconsistent(spark):
    filler = "some other words stand here before and after it"
    changed = ITEM.replace("Boston", "Chicago").replace("12", "75").replace("Anna", "Maria").replace("3 kg", "8 lb")
    mixed = ITEM.replace("12 dollars", "75 dollars").replace("3 kg", "8 lb").replace("Anna and", "Maria and").replace("Anna paid", "Laura paid")
    docs = [(1, f"{filler}. {ITEM} {filler}"), (2, f"{filler}. {changed}"), (3, mixed), (4, filler), (5, None), (6, ""),
            (7, ITEM[:60]), (8, f"{filler}. {ITEM}\n{ITEM}"), (None, ITEM), (1, f"{filler}. {ITEM} {filler}"), (9, "12 13 14 " * 50000)]
    found, rest = run(spark, docs, [(10, ITEM), (11, None), (12, ""), (13, "5 6 7")])
    assert {k: v.kind for k, v in found.items()} == {
        (1, 10): "verbatim", (2, 10): "re-parameterised", (8, 10): "verbatim", (None, 10): "verbatim"}
    assert rest == [3, 4, 5, 6, 7, 9]


@pytest.mark.parametrize("limit", [T.BROADCAST_WINDOWS, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(T, "BROADCAST_WINDOWS", limit)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.choice([3, 5, 12, 30]))) for i in range(20)] + [(99, "only five words in here")]
    docs = []
    for i in range(60):
        parts = [text(20), rng.choice(items)[1] if i % 2 else text(5), text(20)]
        docs.append((i, " ".join(parts)))
    found, _ = run(spark, docs, items)

    def covered(doc, item):
        d, b = doc.split(), item.split()
        n = min(T.WINDOW, len(b))
        mine = {tuple(d[i:i + n]) for i in range(len(d) - n + 1)}
        theirs = [tuple(b[i:i + n]) for i in range(len(b) - n + 1)]
        return sum(w in mine for w in theirs) / len(theirs)
    want = {(i, j): covered(d, b) for i, d in docs for j, b in items if covered(d, b) >= T.COVERAGE}
    assert {k: round(v.coverage, 9) for k, v in found.items()} == {k: round(v, 9) for k, v in want.items()}


def test_empty_tables(spark):
    assert run(spark, [], [(1, ITEM)]) == ({}, []) and run(spark, [(1, ITEM)], [])[1] == [1]


def test_units_follow_numbers_only():
    canon = T.Canon()
    _, _, slot, _ = canon.read(["Run 5 miles, in 3.5 hours to Paris by day. Then 7kg"])
    assert slot.tolist() == [0, T.NUMBER, T.UNIT, 0, T.NUMBER, T.UNIT, 0, T.NAME, 0, 0, 0, T.NUMBER]
    assert re.fullmatch(T._NUMBER, "1,200.50")
