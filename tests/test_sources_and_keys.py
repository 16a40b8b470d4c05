"""Rejected records, common keys, and counters observed while a table is written."""
import pytest
from pyspark.sql import functions as F

from quiremill.operators import cleaning as C
from quiremill.operators import keys as K
from quiremill.sources import readers


def test_rejects_of_delimited_text_json_and_xml(spark, tmp_path):
    files = {
        "csv": ["1,a,1.5\n2,b,x\n3,c\n4,d,2.5\n", "5,e,3.5\n"],
        "json": ['{"id":1,"x":"a","y":1.5}\n{"id":2,"x":\n{"id":"no","x":"c","y":1}\n', '{"id":4,"x":"d","y":2.5}\n'],
        "xml": ["<t><row><id>1</id><x>a</x><y>1.5</y></row><row><id>no</id><x>b</x><y>2</y></row></t>", "<t><row><id>4</id><x>d</x><y>2.5</y></row></t>"],
    }
    want = {"csv": ([(1, "a", 1.5), (4, "d", 2.5), (5, "e", 3.5)], [(1, 0), (2, 2)]), "json": ([(1, "a", 1.5), (4, "d", 2.5)], [(1, 0), (1, 2)]),
            "xml": ([(1, "a", 1.5), (4, "d", 2.5)], [(1, 0), (1, 1)])}
    for fmt, texts in files.items():
        folder = tmp_path / fmt
        folder.mkdir()
        for i, text in enumerate(texts):
            (folder / f"{i}.{fmt}").write_text(text)
        rows, rejects, totals = readers.read_with_rejects(spark, str(folder), fmt, "id int, x string, y double")
        assert sorted(map(tuple, rows.collect())) == want[fmt][0], fmt
        assert sorted((r.rows, r.rejected) for r in totals.collect()) == want[fmt][1], fmt
        found = rejects.collect()
        assert len(found) == sum(n for _, n in want[fmt][1]) and all(r.file.endswith(f"0.{fmt}") and r.block_start == 0 and r.record for r in found)
    with pytest.raises(ValueError, match="no rejects"):
        readers.read_with_rejects(spark, "x", "parquet", "id int")


def test_common_key_by_values(spark):
    a = spark.range(1000).select((F.col("id") * 7).alias("order_no"), (F.col("id") % 5).alias("kind"), F.concat(F.lit("n"), "id").alias("name"))
    b = spark.range(3000).select((F.col("id") % 5).alias("sort"), (F.col("id") % 900 * 7).cast("string").alias("ref"), F.lit(None).cast("string").alias("none"))
    row = K.common_key(a, b).first()
    assert tuple(row) == ("order_no", "ref", 1000, 900, 900)
    joined = K.join_on_common_key(a, b)
    assert joined.count() == 3000 and joined.columns == ["order_no", "kind", "name", "sort", "none"]


def test_no_common_key(spark):
    a, b = spark.range(50), spark.range(100, 150).select(F.col("id").alias("other"))
    assert K.common_key(a, b).count() == 0 and K.common_key(a.limit(0), b).count() == 0
    repeats = spark.createDataFrame([(1,), (1,), (2,), (2,)], "x int")
    assert K.common_key(repeats, repeats).count() == 0          # no side is free of repeats
    with pytest.raises(ValueError, match="no common key"):
        K.join_on_common_key(a, b)


def test_report_observed_while_writing(spark, tmp_path):
    rows = [(" a ", 1, None), (" a ", 1, None), ("b", None, None), (None, None, None), (None, None, None), ("b ", None, None)]
    df = spark.createDataFrame(rows, "s string, n int, empty string")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    cleaned, report = C.clean_to(source, str(tmp_path / "out"))
    assert report == C.cleaning_report(source).first().asDict()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, cleaned.collect()), key=key) == sorted(map(tuple, C.clean_table(source).collect()), key=key)
    none, report = C.clean_to(source.limit(0), str(tmp_path / "none"))
    assert none.columns == ["s", "n", "empty"] and report["original_rows"] == report["result_rows"] == 0


def test_cells_of_many_pages_leave_together():
    import pyarrow as pa
    from quiremill.sources import readers
    page = "<table><tr><th>a</th></tr><tr><td> {} </td></tr></table><table><tr><td>z</td></tr></table>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array([page.format(i) for i in range(1000)])], ["k", "html"])
    for first, n in ((False, 3), (True, 2)):
        out = list(readers._cells_of("k", first)(iter([batch])))
        assert len(out) == 1 and out[0].num_rows == 1000 * n
        assert [tuple(r.values()) for r in out[0].slice(n * 7, 2).to_pylist()] == [(7, 0, 0, 0, "a"), (7, 0, 1, 0, "7")]


def test_streams_read_tables_in_folders(spark, folder, tmp_path):
    """A table may be a folder of files; its stream then reads all of them."""
    import shutil
    from quiremill.plans import registry, load
    load()
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{folder}/labels.parquet", tmp_path)
    found = registry.QUERIES["stream_index"](spark, str(tmp_path))
    cut = registry.QUERIES["chunk_documents"](spark, str(tmp_path))
    assert found.count() == cut.count() > 60 and found.exceptAll(cut.select(found.columns)).isEmpty()


def test_parts_go_on_in_other_files(spark, tmp_path, monkeypatch):
    from quiremill.sources import sinks
    df = spark.range(0, 7000, 1, 1).select("id", F.concat(F.lit("x"), "id").alias("s"))
    monkeypatch.setattr(sinks, "FILE_BYTES", 40_000)
    import pyarrow as pa
    pieces = [pa.RecordBatch.from_pydict({"id": list(range(i, i + 3500))}) for i in (0, 3500)]
    files = [[r for piece in f for r in piece["id"].to_pylist()] for f in sinks._files_of(iter(pieces))]
    assert len(files) == 2 and sum(files, []) == list(range(7000))
    monkeypatch.undo()
    for fmt in ("yaml", "feather"):
        sinks.write_table(df, str(tmp_path / fmt), fmt)
        assert [p.name for p in (tmp_path / fmt).iterdir()] == [f"part-00000.{fmt}"]
        assert readers.read_table(spark, str(tmp_path / fmt), fmt, df.schema).exceptAll(df).isEmpty()


def test_yaml_items_one_by_one():
    import yaml
    for text in ("- {a: 1}\n- &k {b: [x]}\n- *k\n- {<<: *k, c: 2}\n- null\n", "a: 1\n", "", "[]", "--- \n- a: 2020-01-01\n"):
        loaded = yaml.safe_load(text)
        assert list(readers._yaml_records(text.encode())) == (loaded if isinstance(loaded, list) else [loaded])
    records = readers._yaml_records(b"- 1\n- 2\n- [\n")
    assert [next(records), next(records)] == [1, 2]            # what comes later is not read yet


def test_xml_goes_on_in_other_files(spark, tmp_path, monkeypatch):
    from quiremill.sources import sinks
    monkeypatch.setattr(sinks, "XML_ROWS", 400)
    df = spark.range(0, 1000, 1, 1).select("id", F.concat(F.lit("x"), "id").alias("s"))
    sinks.write_table(df, str(tmp_path / "xml"), "xml")
    assert len([p for p in (tmp_path / "xml").iterdir() if p.name.startswith("part")]) == 3
    got = readers.read_table(spark, str(tmp_path / "xml"), "xml", df.schema)
    assert got.count() == 1000 and got.exceptAll(df).isEmpty()
