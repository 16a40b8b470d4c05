"""Workflow columns, cleaning changes and totals, accuracy, errors, pages after a row, scoped search."""
import pytest
from pyspark.sql import functions as F

from quiremill.operators import analytics as A
from quiremill.operators import cleaning as C
from quiremill.operators import documents as D
from quiremill.operators import relational as R
from quiremill.plans.workflow import run_workflow
from quiremill.streaming import jobs


def test_column_steps(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    out = run_workflow(df, [{"op": "duplicate", "col": "b", "name": "c"}, {"op": "delete", "cols": ["a"]}])
    assert out.columns == ["b", "c"] and tuple(out.first()) == ("x", "x")
    with pytest.raises(ValueError):
        run_workflow(df, [{"op": "none"}])


def test_cleaning_changes_and_totals(spark):
    df = spark.createDataFrame([(1, "15/03/2023", "5.0", "$1,234.50"), (2, "2023-01-15", "7", None), (3, "", "", ""), (4, "2023-01-15", "7", None)],
                               "id int, a string, b string, c string")
    changes = {tuple(r) for r in C.cleaning_changes(df, "id").collect()}
    assert (1, "normalize_dates", "a", "15/03/2023", "2023-03-15") in changes and (1, "normalize_numbers", "b", "5.0", "5") in changes
    assert (1, "normalize_currencies", "c", "$1,234.50", "1234.50 USD") in changes and {c[0] for c in changes} == {1}
    assert {c[1] for c in C.cleaning_changes(df, "id", ["normalize_dates"]).select("id", "rule").collect()} == {"normalize_dates"}
    row = C.cleaning_totals(df, C.clean_text_table(df, "id")).first()
    assert (row.rows_before, row.rows_after, row.normalized_dates, row.normalized_currencies, row.anomalies) == (4, 2, 1, 1, 0)


def test_accuracy_and_errors(spark):
    found = spark.createDataFrame([("a", True), ("a", False), ("a", False), ("b", False)], "entity_type string, corrected boolean")
    assert {tuple(r) for r in A.extraction_accuracy(found).collect()} == {("a", 3, 1, 0.666667), ("b", 1, 0, 1.0)}
    docs = spark.createDataFrame([(1, None), (2, "  "), (3, "Invoice 12"), (4, "zzz")], "doc_id int, text string")
    errors = {r.doc_id: r.errors for r in D.analyze(docs).collect()}
    assert errors[1][0] == "extract_text: missing" and errors[2][0] == "extract_text: empty"
    assert errors[3] == [] and errors[4] == ["classify: no rule fits"]


def test_pages_after_a_row_cover_all_rows(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(25)], "id int, g int")
    order, seen = {"g": "desc", "id": "asc"}, []
    page = R.page_of(df, [F.desc("g"), F.col("id")], 1, 7).collect()
    while page:
        seen += [(r.g, r.id) for r in page]
        page = R.page_after(df, order, [page[-1].g, page[-1].id], 7).collect()
    assert seen == sorted(((i % 3, i) for i in range(25)), key=lambda x: (-x[0], x[1]))


def test_held_sources_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(jobs, "HELD_SOURCES", 3)
    rows = [(i, f"s{i % 10}", True, 1.0, "2024-01-01 00:00:00") for i in range(100)]
    pings = spark.createDataFrame(rows, "id bigint, source string, ok boolean, latency double, at string").select(
        "id", "source", "ok", "latency", F.to_timestamp_ntz("at").alias("pinged_at"))
    totals = jobs.reduce_pings(pings).groupBy("source").agg(F.sum("total").alias("n")).collect()
    assert {r.source: r.n for r in totals} == {f"s{i}": 10 for i in range(10)}
