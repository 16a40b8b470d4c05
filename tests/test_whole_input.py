"""No operator stops at a prefix, a first file or a first rows: input beyond each earlier cut."""
import json
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiremill.functions import labels as L
from quiremill.functions import text as X
from quiremill.operators import cleaning as C
from quiremill.operators import datasets as DS
from quiremill.operators import documents as D
from quiremill.operators import grid as G
from quiremill.operators import relational as R
from quiremill.operators import search as S
from quiremill.operators import vectors as VE
from quiremill.sources import readers


def test_natural_sort_numbers_every_row(spark):
    names = spark.createDataFrame([(f"Item {i}",) for i in range(1500)], "name string").repartition(7)
    got = R.numbered(names, [R.natural_key("name"), F.col("name")]).collect()
    assert sorted((r.place, r.name) for r in got) == [(i + 1, f"Item {i}") for i in range(1500)]
    assert R.numbered(names.limit(0), [F.col("name")]).count() == 0


def test_json_mode_is_chosen_per_file(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n [\n{\"a\": 1},\n {\"a\": 2}]")
    (tmp_path / "b.json").write_text('{"a": 3}\n{"a": 4, "b": "x"}\n')
    for schema in (None, "a bigint"):
        assert sorted(r.a for r in readers.read_table(spark, str(tmp_path), "json", schema).collect()) == [1, 2, 3, 4]


def test_arrow_files_are_read(spark, tmp_path):
    table = pa.table({"a": [1, 2, 3]})
    with pa.ipc.new_file(str(tmp_path / "x.arrow"), table.schema) as out:
        out.write_table(table)
    assert readers.read_table(spark, str(tmp_path), "arrow").count() == 3


def test_types_are_inferred_from_all_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n" + "1,1\n" * 5000 + "x7,2.5\n")
    df = readers.read_table(spark, str(tmp_path), "csv")
    assert df.where("a = 'x7' AND b = 2.5").count() == 1 and df.where("a IS NULL OR b IS NULL").count() == 0
    assert readers.read_table(spark, str(tmp_path), "csv", infer_rows=5000).where("a IS NULL").count() == 1


def test_all_tables_of_html_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<table><tr><td>1</table><table><tr><td>2</table>")
    assert readers.read_table(spark, str(tmp_path), "html").count() == 2
    assert readers.read_table(spark, str(tmp_path), "html", first_only=True).count() == 1


def test_long_values_and_texts(spark):
    start = "https://example.com/" + "a" * 40
    docs = spark.createDataFrame([(1, f"{start}/1 {start}/2 " + "x" * 3000 + " invoice")], "doc_id int, text string")
    assert D.entities(docs, kinds=["url"]).count() == 2 and D.entities(docs, strict_reference=True).where("entity_type = 'url'").count() == 1
    assert D.analyze(docs).first().n_urls == 2 and D.classify_documents(docs).first().doc_type == "invoice"
    resume = spark.createDataFrame([("skills: " + "Spark, " * 100,)], "text string")
    value = resume.select(F.inline(X.field_entities("text", F.lit("resume")))).where("entity_type = 'skills_section'").first().value
    assert len(value) > 600
    large = json.dumps({"k": ["v" * 10] * 300})
    assert spark.range(1).select(L.sniff_type(F.lit(large).cast("binary")).alias("t")).first().t == "json"


def test_kinds_run_only_their_patterns(spark):
    docs = spark.createDataFrame([(1, "a@b.co")], "doc_id int, text string")
    plan = D.entities(docs, kinds=["email"])._jdf.queryExecution().optimizedPlan().toString()
    assert "https?" not in plan and "IBAN" not in plan and plan.count("regexp_extract_all") == 1


def test_short_texts_can_be_found(spark):
    docs = spark.createDataFrame([(1, "Tiny note."), (2, "Another one here."), (3, "More of it.")], "file_id int, text string")
    got = S.bm25(S.index_chunks(S.chunk_documents(docs)), S.questions(spark, ["tiny"])).collect()
    assert [r.file_id for r in got] == [1]


def test_surplus_cells_and_long_blocks(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, "h"), (1, 0, 1, 0, "a"), (1, 1, 1, 0, "b"), (1, 1, 1, 1, "c")],
                                  "doc_id int, table_no int, row int, col int, value string")
    assert sorted((r.header, r.value) for r in G.union_tables(cells).collect()) == [("col_1", "c"), ("h", "a"), ("h", "b")]
    words = spark.createDataFrame([(1, 1, "w" * 9, 0, i * 10, i * 10 + 9, 10) for i in range(200)],
                                  "doc_id int, page int, text string, top int, left int, right int, bottom int")
    assert len(G.words_to_blocks(words).first().content) == 1999 and len(G.words_to_blocks(words, content_chars=500).first().content) == 500


def test_repeated_key_raises(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="repeated key"):
        R.compare(df, df, ["k"])


def test_names_look_at_all_rows(spark):
    df = spark.createDataFrame([(i, "2024-01-01" if i < 60 else "no date") for i in range(61)], "id int, a string")
    assert C.suggest_names(df, ["id"]).count() == 0 and C.suggest_names(df, ["id"], strict_reference=True).first().suggestion == "phone"


def test_one_sample_per_feedback_row(spark):
    feedback = spark.createDataFrame([(1, 5, 7, 3, "f", "o", "c", None, None)], "id int, file_id int, dataset_id int, user_id int, "
                                     "field_name string, original_value string, corrected_value string, doc_type string, language string")
    datasets = spark.createDataFrame([(7, 3)], "id int, created_by int")
    analyses = spark.createDataFrame([(5, 1, "old", "en"), (5, 2, "new", "de")], "file_id int, created_at int, doc_type string, language string")
    assert [(r.doc_type, r.language) for r in DS.samples_from_feedback(feedback, datasets, analyses).collect()] == [("new", "de")]


def test_quartiles_with_nan_and_infinity(spark, monkeypatch):
    monkeypatch.setattr(C, "_EXACT_ROWS", 100)
    values = [float(i % 997) for i in range(3000)] + [math.nan] * 500 + [math.inf, -math.inf] * 5
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = C.quartiles(df, ["v"]).first()
    ordered = sorted(v for v in values if not math.isnan(v)) + [math.nan] * 500
    n = len(ordered)
    assert (row.n, row.q1, row.q3) == (n, ordered[n // 4], ordered[3 * n // 4])
    row = C.quartiles(spark.createDataFrame([(math.nan,)] * 3 + [(1.0,)], "v double"), ["v"]).first()
    assert row.q1 != row.q1


def test_many_vector_queries(spark):
    rows = [(i, [math.cos(i / 50), math.sin(i / 50)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(j, rows[j % 300][1]) for j in range(10_000)], "query_id long, embedding array<double>")
    got = VE.vector_topk(queries, vectors, 1)
    assert got.count() == 10_000 and got.where("vec_id <> query_id % 300 AND similarity < 0.999999").count() == 0
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_math_commands_are_whole_names():
    from quiremill.functions import values as V
    assert "varepsilon" in V.LATEX_COMMANDS and all(c.isalpha() or c in ",;:!" for c in V.LATEX_COMMANDS)


def test_words_of_a_page_move_once_and_packed(spark, tmp_path):
    """Pages are dealt out before they are cut into words, so grouping words by page moves none of them again."""
    from quiremill.plans import registry, tables
    texts = [None, "", " \n ", "one", "a\tb  c\nd ", " ".join(f"w{i}" for i in range(1201)), "\n".join(["x y"] * 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.page, r.top, r.left, r.text) for r in tables.words(registry.Tables(spark, str(tmp_path))).collect())
    expected = []
    for doc, text in enumerate(texts):
        for w, word in enumerate(re.split(r"[\n ]", text) if text is not None else []):
            if word:
                expected.append((doc, w // 400 + 1, w // 10 % 40 * 16 + w % 3, w % 10 * 45 + len(word) % 5, word))
    assert got == sorted(expected)
    plan = registry.QUERIES["words_to_blocks"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("posexplode(split(words") < plan.index("Exchange")


@pytest.mark.parametrize("per_batch", [3, 10_000])
def test_cells_of_pages_in_many_batches(spark, monkeypatch, per_batch):
    """Pages that begin and end within batches, words without a place or a text, against a plain loop; words move at most once."""
    rng = random.Random(7)
    words = [(p // 3, p % 3, rng.choice(["a", "b", "cc", None]), rng.choice([-90, 0, 3, 12, 13, 26, 40, 41, 99]), rng.choice([-7, 0, 20, 21, 31, 32, 60, 61]))
             for p in range(12) for _ in range(rng.choice([1, 2, 5, 40]))] + [(None, 1, "no page", 1, 1), (9, 9, "far", 2**31 - 1, -2**31), (9, 9, "off", -2**31, 2**31 - 1)]
    expected = {}
    for page in {w[:2] for w in words if w[0] is not None}:
        held, marks = [w for w in words if w[:2] == page], ([], [])
        for of, place, gap in ((marks[0], 3, 12), (marks[1], 4, 20)):
            for v in sorted({w[place] for w in held}):
                if not of or v - of[-1] > gap:
                    of.append(v)
        for w in held:
            row = max(i for i, m in enumerate(marks[0]) if m <= w[3])
            col = min(range(len(marks[1])), key=lambda i: (abs(marks[1][i] - w[4]), i))
            expected.setdefault((*page, row, col), []).append((w[4], w[3], w[2] or ""))
    expected = {k: " ".join(x[2] for x in sorted(v) if x[2]) for k, v in expected.items()}
    table = spark.createDataFrame(words, "doc_id bigint, page int, text string, top int, left int").repartition(2)
    monkeypatch.setattr(G, "DENSE", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    try:
        df = G.words_to_table(table)
        rows = [((r.doc_id, r.page, r.row, r.col), r.value) for r in df.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(expected) and dict(rows) == expected
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
