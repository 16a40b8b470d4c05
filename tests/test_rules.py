"""Hand-worked inputs and results of the rules."""
import random

import pytest
from pyspark.sql import functions as F

from quiremill.functions import cleaning as C
from quiremill.functions import labels as L
from quiremill.functions import text as X
from quiremill.functions import values as V
from quiremill.operators import cleaning as OC
from quiremill.operators import documents as D
from quiremill.operators import grid as G
from quiremill.operators import relational as R
from quiremill.operators import search as S
from quiremill.plans.workflow import run_workflow
from quiremill.sources import readers, sinks


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_dates(spark):
    cases = {
        "2023-01-15": "2023-01-15", "15/03/2023": "2023-03-15", "1.2.23": "2023-02-01", "2023/3/5": "2023-03-05",
        "٢٠٢٣-٠٥-٠١": "2023-05-01", "15 January 2023": "2023-01-15", "5 Jan. 99": "2099-01-05",
        "15 يناير 2023": "2023-01-15", "31/13/2023": "2023-13-31", "1/2/123": "0123-02-01", "hello": None,
        "15 Foo 2023": None, " 3-4-05\t": "2005-04-03", "": None, "12": None, "2023-1-5-7": None,
    }
    assert column(spark, list(cases), C.normalize_date("v")) == list(cases.values())


def test_numbers(spark):
    cases = {
        "1,234,567": "1234567", "5.0": "5", "5": "5", " 7 ": "7", "١٢٣": "123", "1e3": "1000", "1,2345": "12345",
        "12,34": None, "nan": None, "inf": None, "12d": None, "0.5": "0.5", "-12345678.25": "-12345678.25",
        "0.00001": "1e-05", "0.0001": "0.0001", "1e20": "100000000000000000000", "": None, ".5": "0.5", "-0.0": "0",
    }
    assert column(spark, list(cases), C.normalize_number("v")) == list(cases.values())


def test_currencies(spark):
    cases = {
        "$1,234.50": "1234.50 USD", "€ 20": "20 EUR", "£7": "7 GBP", "5usd": "5 USD", "1,000 ريال": "1000 ريال",
        "100 SAR": "100 SAR", "¥5": None, "12": None,
    }
    assert column(spark, list(cases), C.normalize_currency("v")) == list(cases.values())
    assert str(column(spark, ["$1,234.50"], C.currency_amount("v"))[0]) == "1234.5000000000"


def test_outliers(spark):
    def flags(values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r["__anomaly_v__"] for r in OC.flag_outliers(df, ["v"]).orderBy("i").collect()]

    assert flags(["10", "12", "11", "13", "1,00"]) == [False] * 4 + [True]
    assert flags(["1", "2", "1000"]) == [False] * 3
    assert flags(["3", "1", "4", "1", "5", "9", "2", "6"]) == [False] * 8
    assert flags(["x", None, "10", "12", "11", "13", "100"]) == [False] * 6 + [True]


@pytest.mark.parametrize("limit", [3, 50, 100000])
def test_quantiles_by_shrinking_brackets(spark, monkeypatch, limit):
    monkeypatch.setattr(OC, "_EXACT_ROWS", limit)
    values = [float((i * 7919) % 503) for i in range(2000)] + [5.0] * 900 + [0.25, -3.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    n, ordered = len(values), sorted(values)
    found = OC.positional_quantiles(df, {"v": F.col("v")}, (1, 2, 3))["v"]
    assert found == {"n": n, **{q: ordered[q * n // 4] for q in (1, 2, 3)}}


def test_rows_and_duplicates(spark):
    df = spark.createDataFrame([(1, "", "  "), (2, "x", ""), (3, "y", "z"), (4, "y", "z"), (5, None, None)], "id int, a string, b string")
    kept = OC.drop_blank_rows(df, ["a", "b"])
    assert [r.id for r in OC.dedup_keep_first(kept, "id").orderBy("id").collect()] == [2, 3]
    nan = spark.createDataFrame([(None, float("nan")), (None, None)], "a string, b double")
    assert OC.drop_empty_rows(nan).count() == 1
    none = spark.createDataFrame([], "a string, b double")
    assert OC.drop_empty_cols(none).columns == ["a", "b"]


def test_text_table_counts_only_changes(spark):
    df = spark.createDataFrame([(1, "5.0", "100 SAR"), (2, "5", "$3"), (3, "1/2/2023", None)], "id int, a string, b string")
    out = {r.id: r for r in OC.clean_text_table(df, "id").collect()}
    assert (out[1].a, out[1].normalized_numbers, out[1].normalized_currencies) == ("5", 1, 0)
    assert (out[2].a, out[2].normalized_numbers, out[2].b, out[2].normalized_currencies) == ("5", 0, "3 USD", 1)
    assert (out[3].a, out[3].normalized_dates) == ("2023-02-01", 1)


def test_name_suggestions(spark):
    df = spark.createDataFrame([(1, "a@b.co", "2024-01-02", "1,234.5", "+1 555-0100"), (2, "c@d.org", "2024-02-03", "7", "555 0101 2")],
                               "id int, p string, q string, r string, s string")
    rows = lambda **k: {r["column"]: r["suggestion"] for r in OC.suggest_names(df, ["id"], **k).collect()}
    assert rows() == {"p": "email", "q": "date", "r": "amount", "s": "phone"}
    assert rows(strict_reference=True)["q"] == "phone"


def test_language_and_type(spark):
    docs = spark.createDataFrame([
        (1, "Invoice No 12 total amount", ""), (2, "هذه فاتورة رقم 7", ""), (3, "balance credit", ""), (4, "zzz", ""), (5, "", ""),
        (6, "date: name:", ""), (7, None, "inv-77.pdf"), (8, "x" * 3000 + " invoice", "")], "doc_id int, text string, filename string")
    got = {r.doc_id: r for r in D.classify_documents(docs).collect()}
    assert (got[1].doc_type, got[1].confidence, got[1].language) == ("invoice", 0.87, "en")
    assert (got[2].doc_type, got[2].confidence, got[2].language) == ("invoice", 0.85, "ar")
    assert (got[3].doc_type, got[3].confidence) == ("bank_statement", 0.84)
    assert (got[4].doc_type, got[4].confidence, got[4].signals) == ("unknown", 0.3, [])
    assert (got[5].doc_type, got[5].confidence) == ("unknown", 0.0)
    assert (got[6].doc_type, got[6].confidence) == ("form", 0.72)
    assert (got[7].doc_type, got[7].signals) == ("invoice", [r"\binv[-\s]?\d+"])
    assert got[8].doc_type == "invoice"
    assert {r.doc_id: r.doc_type for r in D.classify_documents(docs, head=3000).collect()}[8] == "unknown"


def test_type_survives_filters(spark):
    docs = spark.createDataFrame([(1, "Invoice No 12")], "doc_id int, text string")
    df = D.with_type(docs).where("doc_type = 'invoice' AND confidence > 0.5")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("invoice\\b") == 2      # pattern and "tax invoice", once each
    assert df.count() == 1


def test_entities(spark):
    docs = spark.createDataFrame([
        (1, "mail a@b.co and a@b.co see https://x.io/p"), (2, "DE44500105175407324931"), (3, "......."),
        (4, "call +1 (555) 010-0199 on 5 Jan. 2024")], "doc_id int, text string")
    rows = lambda **k: sorted((r.doc_id, r.entity_type, r.value, r.confidence) for r in D.entities(docs, **k).collect())
    got = rows()
    assert [g for g in got if g[0] == 1] == [(1, "email", "a@b.co", 0.98), (1, "url", "https://x.io/p", 0.98)]
    assert [g for g in got if g[0] == 2] == [(2, "iban", "DE44500105175407324931", 0.92)]
    assert [g for g in got if g[0] == 3] == []
    assert (3, "phone", ".......", 0.75) in rows(strict_reference=True)
    assert (4, "date", "5 Jan. 2024", 0.85) in got and any(g[:2] == (4, "phone") for g in got)


def test_type_fields(spark):
    text = ("ACME Ltd\nInvoice No: INV-77\nfrom Acme Corp\nto Bob\nTotal: 1,234.50\nVAT no: GB123\nprice $ 12.50\n"
            "skills: Spark, SQL\n\nlinkedin.com/in/ann-b\naccount no: 12-34\nbalance 9,9\neffective date: 2024-01-02\n"
            "A1234567 nationality: Omani\nid number: 12345678")
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")

    def fields(kind):
        rows = docs.select(F.inline(X.field_entities("text", F.lit(kind)))).collect()
        return {r.entity_type: r.value for r in rows}

    assert fields("invoice") == fields("receipt")
    got = fields("invoice")
    assert (got["invoice_number"], got["supplier"], got["customer"]) == ("INV-77", "Acme Corp", "Bob")
    assert (got["total"], got["tax_number"], got["currency"]) == ("1,234.50", "GB123", "$ 12.50")
    assert fields("bank_statement") == {"account_number": "12-34", "balance": "9,9"}
    assert fields("resume") == {"full_name": "ACME Ltd", "skills_section": "Spark, SQL", "linkedin": "linkedin.com/in/ann-b"}
    assert fields("contract")["effective_date"].startswith("2024-01-02")
    assert fields("passport") == {"passport_number": "A1234567", "nationality": "Omani"}
    assert fields("id") == {"id_number": "12345678"}
    assert fields("unknown") == {}


def test_suggestions(spark):
    docs = spark.createDataFrame([(1, "Invoice 7 a@b.co " + "x" * 200, "PDF", True)], "doc_id int, text string, format string, has_tables boolean")
    got = [(r["rank"], r.suggestion_type, r.title) for r in D.suggestions(D.analyze(docs)).orderBy("rank").collect()]
    assert [g[1] for g in got] == ["extract_tables", "export_invoice_json", "convert_excel", "convert_word", "extract_emails",
                                   "clean_data", "search_document"]
    assert got[4][2] == "Export 1 email address(es)"


def test_chunks(spark):
    sent = lambda n: "a" * (n - 1) + "."
    docs = spark.createDataFrame([
        (1, ""), (2, "  \n "), (3, "short text."), (4, f"{sent(300)} {sent(300)}"), (5, f"{sent(200)} {sent(200)} {sent(60)}"),
        (6, f"{sent(350)} {sent(60)} {sent(100)}")], "doc_id int, text string")
    got = {}
    for r in S.chunk_documents(docs).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(len(r.chunk_text))
    # The 60-character sentence of document 6 is repeated in its second chunk.
    assert got == {3: [11], 4: [300, 300], 5: [401, 60], 6: [350, 161]}


def test_bm25_fixture(spark):
    chunks = spark.createDataFrame([(1, 0, "apple pie here"), (2, 0, "banana split here"), (3, 0, "cherry tart here")],
                                   "file_id int, chunk_index int, chunk_text string")
    ask = lambda q, c=chunks: S.bm25(c, S.questions(spark, [q])).collect()
    assert [(r.file_id, round(r.score, 4)) for r in ask("apple")] == [(1, 0.5108)]
    assert ask("a") == []
    assert ask("apple", chunks.where("file_id < 3")) == []
    assert ask("apple", chunks.where("false")) == []


def test_merge_and_compare(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "a int, b string")
    b = spark.createDataFrame([(2, "Y"), (3, "z"), (4, "w")], "a int, b string")
    c = spark.createDataFrame([(9, True)], "a int, c boolean")
    assert R.merge_vertical([a, c], ["one", "two"]).columns == ["a", "b", "source_file", "source_order", "c"]
    found = R.compare(a, b, ["a"])
    assert [tuple(r) for r in found["added"].collect()] == [(4, "w")]
    assert [tuple(r) for r in found["removed"].collect()] == [(1, "x")]
    assert [tuple(r) for r in found["changed"].collect()] == [(2, "b", "y", "Y")]
    doubled = R.compare(a.union(a), a)
    assert "changed" not in doubled and doubled["removed"].count() == 3
    with pytest.raises(ValueError):
        R.merge_vertical([a], ["one"])


def test_labels(spark):
    assert column(spark, [0, 1023, 1280, 1024**2, 5 * 1024**4, 1024**5, None], L.human_size("v"), "bigint") == [
        "0.0 B", "1023.0 B", "1.2 KB", "1.0 MB", "5.0 TB", "1.0 PB", "0.0 B"]
    assert column(spark, [0, 1280, 3 * 1024**3], L.human_size_short("v"), "bigint") == ["0 B", "1.2 KB", "3.00 GB"]
    assert column(spark, ["a" * 5, "a" * 11, None], L.truncate_suffix("v", 10)) == ["a" * 5, "a" * 7 + "...", ""]
    assert column(spark, ["A.XLSX", "noext", "b.ppt", "c.pdf"], L.type_by_extension("v")) == ["spreadsheet", None, "presentation", None]
    assert column(spark, ["ok\n---\n\n * \nb", "ا\n!!"], C.strip_junk_lines("v")) == ["ok\nb", "ا"]
    assert column(spark, [r"x $a+b$", r"\frac12", r"\pm", r"\foo", "$5", r"\leftarrow", None], L.has_math("v")) == [
        True, True, True, False, False, True, False]
    assert column(spark, ["مرحبا abc", "hello", "שלום"], L.is_rtl("v")) == [True, False, True]


def test_sniff(spark):
    cases = [(b"%PDF-1", "pdf"), (b"\x89PNG\r", "png"), (b"\xff\xd8\xff\xe0", "jpg"), (b"GIF89a", "gif"), (b"RIFF1234WEBPxx", "webp"),
             (b"BMxx", "bmp"), (b"<?xml?><svg>", "svg"), (b"PK\x03\x04..word/x", "docx"), (b"PK\x03\x04..xl/x", "xlsx"),
             (b"PK\x03\x04..", "zip"), (b'{"a": 1}', "json"), (b"[broken", "txt"), (b"<p>x", "xml"), (b"a,b\n1,2", "csv"),
             (b"plain", "txt"), (b"\xfe\x00\xff\xfe", "bin")]
    got = column(spark, [bytearray(c) for c, _ in cases], L.sniff_type("v"), "binary")
    assert got == [e for _, e in cases]


def test_grid(spark):
    heads = spark.createDataFrame([(1, i, n) for i, n in enumerate(["a", " ", "a", "a", ""])], "table_id int, col int, name string")
    assert [r["name"] for r in G.dedup_headers(heads).orderBy("col").collect()] == ["a", "col", "a_1", "a_2", "col_1"]
    cells = spark.createDataFrame([(1, 0, 0, "x"), (1, 0, 1, "1,5"), (1, 1, 0, "2")], "table_id int, row int, col int, value string")
    assert {r.header for r in G.promote_header(cells).collect()} == {"Column 1", "Column 2"}
    assert [r["values"] for r in G.cells_to_grid(cells).orderBy("row").collect()] == [["x", "1,5"], ["2", ""]]
    at = spark.range(3).select(F.element_at(F.array(*map(F.lit, [0, 27, 702])), (F.col("id") + 1).cast("int")).alias("v"))
    assert [r[0] for r in at.select(G.column_letters(F.col("v"))).collect()] == ["A", "AB", "AAA"]


def test_words_far_apart(spark, monkeypatch):
    words = spark.createDataFrame([(1, 1, "a", 0, 0), (1, 1, "b", 12, 30), (1, 1, "c", 13, 41), (1, 1, "d", 13, 15)],
                                  "doc_id int, page int, text string, top int, left int")
    run = lambda: sorted((r.row, r.col, r.value) for r in G.words_to_table(words).collect())
    dense = run()
    # Marks are 0 and 30 on the left: 15 lies half-way and goes to the first.
    assert dense == [(0, 0, "a"), (0, 1, "b"), (1, 0, "d"), (1, 1, "c")]
    monkeypatch.setattr(G, "DENSE", 1)
    assert run() == dense


def test_html_spans(spark):
    page = "<table><tr><th colspan=2>h</th></tr><tr><td rowspan=2>a</td><td>b <b>c</b></td></tr><tr><td>d</td></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, "<p>none</p>")], "page_id int, html string")
    got = {(r.row, r.col): r.value for r in readers.html_cells(pages).collect()}
    assert got == {(0, 0): "h", (0, 1): "h", (1, 0): "a", (1, 1): "b c", (2, 0): "a", (2, 1): "d"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,s\n1,x\nbad,y\n3,z\n")
    got = readers.read_delimited(spark, str(tmp_path / "a.csv"), schema="n int, s string").collect()
    assert [(r.n, r.s) for r in got] == [(1, "x"), (None, "y"), (3, "z")]
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 2}]')
    assert {r.a for r in readers.read_json(spark, str(tmp_path / "b.json")).collect()} == {1, 2}
    (tmp_path / "c.yaml").write_text("a: 1\nb: x\n")
    assert [tuple(r) for r in readers.read_yaml(spark, str(tmp_path / "c.yaml"), "a int, b string").collect()] == [(1, "x")]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x", "nope")
    with pytest.raises(ValueError):
        sinks.write_table(spark.range(1), str(tmp_path / "x"), "nope")
    assert readers.file_metadata(spark, str(tmp_path)).count() == 3


def test_workflow_and_filters(spark):
    df = spark.createDataFrame([(1, " a "), (2, None), (3, "c")], "id int, s string")
    out = run_workflow(df, [{"op": "trim"}, {"op": "fill", "value": "?"}, {"op": "filter", "rule": {"op": "not", "rules": [{"op": "eq", "col": "s", "value": "?"}]}},
                            {"op": "sort", "cols": ["-id"]}])
    assert [tuple(r) for r in out.collect()] == [(3, "c"), (1, "a")]
    with pytest.raises(ValueError):
        run_workflow(df, [{"op": "nope"}])
    with pytest.raises(ValueError):
        R.filter_builder({"op": "nope", "col": "id", "value": 1})


def test_numbers_found_from_the_first_digit_on(spark):
    """What is found after cutting what has no digit is what the patterns find in the whole text, whose head they do not see."""
    rng = random.Random(5)
    bits = ["word ", "é", "\u0301", "\U0001f600", "+", "(", ") ", "-", ".", " \u2003", "\n", "\u00a0", "٣", "1", "55", "2024-01-05", " 5 Jan 2024", "DE4450010517", "XDE445001", "12345678", ". " * 30, "no digits here " * 5]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([1, 3, 8, 20]))) for _ in range(3000)] + ["", None, "." * 90 + "1234567", "a" * 99 + "DE44500105"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    whole = {"dates": F.regexp_extract_all("text", F.lit("(?iU)" + V.DATE), 0), "ibans": F.regexp_extract_all("text", F.lit("(?U)" + V.IBAN), 0)}
    runs = F.transform(F.regexp_extract_all("text", F.lit("(?U)" + V.PHONE), 1), lambda r: F.regexp_replace(r, r"(?U)\s+", ""))
    whole["phones"] = F.filter(runs, lambda r: F.length(F.regexp_replace(r, r"(?U)\D", "")) >= V.PHONE_MIN_DIGITS)
    got = df.select("text", *[f("text").alias(f.__name__) for f in (X.dates, X.ibans, X.phones)], *[c.alias("all_" + k) for k, c in whole.items()]).collect()
    assert [r for r in got for k in whole if r[k] != r["all_" + k]] == []
    assert all(sum(bool(r[k]) for r in got) > 100 for k in whole)
    rest = df.where("id = 0").select(X._from_digits(F.lit("plain words " * 1000 + "call 5550100")).alias("t")).first().t
    assert len(rest) < 100
