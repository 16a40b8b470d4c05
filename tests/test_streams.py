"""Streaming operators over several batches."""
import pytest
from pyspark.sql import functions as F

from quiremill.operators import search as S
from quiremill.operators import versions as VS
from quiremill.streaming import jobs

EVENTS = "id bigint, source string, ok boolean, latency double, pinged_at timestamp_ntz"


def write(spark, path, rows):
    df = spark.createDataFrame(rows, "id bigint, source string, ok boolean, latency double, at string")
    df.select("id", "source", "ok", "latency", F.to_timestamp_ntz("at").alias("pinged_at")).coalesce(1).write.mode("append").parquet(path)


def test_ping_state_over_batches(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], EVENTS).schema
    for batch in range(3):
        write(spark, inbox, [(batch * 8 + i, "ab"[i % 2], i != 3, 1.0, f"2024-01-0{batch + 1} 00:00:0{i}") for i in range(8)])
        jobs.run_ping_state(jobs.stream_folder(spark, inbox, schema), out)
    rows = spark.read.parquet(f"{out}/data").groupBy("source").agg(F.max_by(F.struct("total", "fails", "last_ids"), "batch").alias("s")).collect()
    got = {r.source: tuple(r.s) for r in rows}
    assert got["a"] == (12, 0, "22,20,18,16,14,12,10,8,6,4")
    assert got["b"] == (12, 3, "23,21,19,17,15,13,11,9,7,5")
    assert {r.source: tuple(r)[1:] for r in jobs.ping_table(spark, out).collect()} == got       # read back from the state


def test_pings_reduced_at_once(spark):
    rows = [(i, [None, "a", "b", "hot"][min(i % 7, 3)], None if i % 11 == 0 else i % 5 > 0, 1.0, f"2024-01-01 00:00:{i % 60:02d}") for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, source string, ok boolean, latency double, at string").coalesce(1)
    got = jobs.reduce_pings(df.select("id", "source", "ok", "latency", F.to_timestamp_ntz("at").alias("pinged_at"))).collect()
    for source in (None, "a", "b", "hot"):
        mine = [r for r in rows if r[1] == source]
        part = [r for r in got if r.source == source]
        assert sum(r.total for r in part) == len(mine) and sum(r.fails for r in part) == sum(not r[2] for r in mine)
        assert [r.id for r in part] == [r[0] for r in sorted(mine, key=lambda r: (r[4], r[0]), reverse=True)[:10]]


def test_days_close_with_the_watermark(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], EVENTS).schema
    write(spark, inbox, [(1, "a", True, 1.0, "2024-01-01 10:00:00"), (2, "a", True, 1.0, "2024-01-02 10:00:00")])
    run = lambda: jobs.run_available(jobs.daily_counts(jobs.stream_folder(spark, inbox, schema), "pinged_at", "10 minutes"), out)
    run()
    write(spark, inbox, [(3, "a", True, 1.0, "2024-01-01 11:00:00"), (4, "a", True, 1.0, "2024-01-04 10:00:00")])   # one row is late
    run()
    got = {str(r.day): r["count"] for r in spark.read.parquet(f"{out}/data").collect()}
    assert got == {"2024-01-01": 1, "2024-01-02": 1}


def test_open_days_and_late_rows_count(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], EVENTS).schema
    for rows in ([(1, "a", True, 1.0, "2024-01-01 10:00:00"), (2, "a", True, 1.0, "2024-01-04 10:00:00")],
                 [(3, "a", True, 1.0, "2024-01-01 11:00:00")]):
        write(spark, inbox, rows)
        jobs.run_updates(jobs.daily_counts(jobs.stream_folder(spark, inbox, schema), "pinged_at"), out)
    assert {str(r.day): r["count"] for r in jobs.newest(spark, out, ["day"]).collect()} == {"2024-01-01": 2, "2024-01-04": 1}


def test_index_replaces_files(spark, tmp_path):
    inbox, table = str(tmp_path / "in"), str(tmp_path / "table")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    schema = docs([]).schema
    run = lambda: jobs.index_stream(jobs.stream_folder(spark, inbox, schema), table, str(tmp_path / "check"))
    docs([(1, "x" * 60 + "."), (2, "y" * 60 + "."), (3, "z" * 60 + ".")]).write.parquet(inbox)
    run()
    docs([(1, "w" * 70 + "."), (3, "now short")]).write.mode("append").parquet(inbox)
    run()
    got = {r.file_id: r.chunk_text[0] for r in S.read_chunks(spark, table).collect()}
    assert got == {1: "w", 2: "y", 3: "n"}
    S.delete_chunks(spark, table, spark.createDataFrame([(1,)], "file_id bigint"))
    assert sorted(r.file_id for r in S.read_chunks(spark, table).collect()) == [2, 3]


def test_broken_write_leaves_chunks_intact(spark, tmp_path):
    table, small = str(tmp_path / "table"), str(tmp_path / "small")
    chunks = lambda rows: spark.createDataFrame(rows, "file_id bigint, chunk_index int, chunk_text string")
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "file_id bigint")
    read = lambda path: sorted((r.file_id, r.chunk_text) for r in S.read_chunks(spark, path).collect())
    S.replace_chunks(spark, table, chunks([(1, 0, "a"), (2, 0, "b"), (3, 0, "c")]))
    # A write that ends between the chunks and the list of files, and one whose job fails.
    chunks([(1, 0, "lost"), (2, 0, "lost")]).write.parquet(f"{table}/chunks/version=2")
    with pytest.raises(Exception, match="broken"):
        S.replace_chunks(spark, table, chunks([(1, 0, "lost")]).withColumn("chunk_text", F.raise_error(F.lit("broken"))))
    assert read(table) == [(1, "a"), (2, "b"), (3, "c")]
    S.replace_chunks(spark, table, chunks([(1, 0, "new")]), ids(1, 2))
    assert read(table) == [(1, "new"), (3, "c")]
    S.delete_chunks(spark, table, ids(3, 9))
    S.replace_chunks(spark, table, chunks([(2, 0, "again")]))
    S.compact_chunks(spark, table, small)
    assert read(table) == read(small) == [(1, "new"), (2, "again")]


def test_late_rows_are_counted(spark, tmp_path):
    """Three batches: of rows behind the watermark none counts, and each is in the figure of its batch."""
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], EVENTS).schema
    at = lambda i, day, hour=10: (i, "a", True, 1.0, f"2024-01-{day:02d} {hour}:00:00")
    for rows in ([at(1, 1), at(2, 5)], [at(3, 1), at(4, 1, 11), at(5, 2), at(6, 5), at(7, 9)], [at(8, 5), at(9, 9), at(10, 9)]):
        write(spark, inbox, rows)
        jobs.run_updates(jobs.daily_counts(jobs.stream_folder(spark, inbox, schema), "pinged_at", "1 hour"), out, ["day"])
    late = jobs.late_rows(spark, out, ["day"]).where("input_rows > 0").orderBy("batch").collect()
    assert [(r.input_rows, r.counted, r.dropped) for r in late] == [(2, 2, 0), (5, 2, 3), (3, 2, 1)]
    assert [r.dropped_groups > 0 for r in late] == [False, True, True]
    assert {str(r.day): r["count"] for r in jobs.newest(spark, out, ["day"]).collect()} == {"2024-01-01": 1, "2024-01-05": 2, "2024-01-09": 3}


def test_newest_reads_a_base_and_what_follows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BASE_EVERY", 2)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], EVENTS).schema
    for n in range(5):
        write(spark, inbox, [(n, "a", True, 1.0, f"2024-01-0{n % 2 + 1} 10:00:00")])
        jobs.run_updates(jobs.daily_counts(jobs.stream_folder(spark, inbox, schema), "pinged_at"), out, ["day"])
    found = jobs.newest(spark, out, ["day"])
    assert {str(r.day): r["count"] for r in found.collect()} == {"2024-01-01": 3, "2024-01-02": 2}
    assert {f.split("/batch=")[0].rsplit("/", 1)[1] for f in found.inputFiles()} == {"base", "data"}
    assert len({f.split("/batch=")[1].split("/")[0] for f in found.inputFiles() if "/data/" in f}) == 1


def test_analyses_entities_and_chunks_together_or_not(spark, tmp_path):
    """A batch breaks off between its writes: all parts stay, and the repeated batch replaces all three."""
    inbox, table, check = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "check")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    schema = docs([]).schema
    state = {"broken": None}

    def parts(batch):
        found = jobs.analysis_parts(batch)
        if state["broken"]:
            first = found[state["broken"]]
            found[state["broken"]] = first.withColumn(first.columns[-1], F.raise_error(F.lit("broken")))
        return found

    run = lambda: jobs.analyze_stream(jobs.stream_folder(spark, inbox, schema), table, check, parts)
    look = lambda: {p: sorted(map(str, VS.read(spark, table, p).collect())) for p in ("analyses", "entities", "chunks")}
    docs([(1, "Invoice No: 77. Mail a@b.com."), (2, "Plain words."), (3, None)]).write.parquet(inbox)
    run()
    before = look()
    assert len(before["analyses"]) == 3 and len(before["chunks"]) == 2 and any("a@b.com" in r for r in before["entities"])
    docs([(1, "Nothing of that kind, mail x@y.org."), (2, "")]).write.mode("append").parquet(inbox)
    for part in ("analyses", "entities", "chunks"):
        state["broken"] = part
        with pytest.raises(Exception, match="broken"):
            run()
        assert look() == before
    state["broken"] = None
    run()
    after = look()
    assert len(after["analyses"]) == 3 and len(after["chunks"]) == 1 and [("a@b.com" in r, "x@y.org" in r) for r in after["entities"]] == [(False, True)]
    assert len(VS.committed(spark, table)) == 2


def test_documents_in_a_folder_are_analyzed(spark, folder, tmp_path):
    from quiremill.plans import load, registry
    load()
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(30)
    docs.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.QUERIES["stream_analyze"](spark, str(tmp_path))
    assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in docs.collect())
