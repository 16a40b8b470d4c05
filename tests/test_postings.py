"""The stored index against the scores of plain ranking, and what a search reads."""
import pytest
from pyspark.sql import functions as F

from quiremill.operators import postings as P
from quiremill.operators import search as S
from quiremill.plans.registry import Tables

ASK = {"q1": "The hand of whst and the the tion", "q2": "elle avec la tion", "q3": "zzzz", "q4": "", "q5": "the"}


@pytest.fixture(scope="module")
def chunks(spark, folder):
    docs = Tables(spark, folder).documents.select(F.col("doc_id").alias("file_id"), "text")
    return S.chunk_documents(docs).cache()


def listed(df, *columns):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(("rows", "terms"), [(8, 2000), (1024, 1)])
def test_equals_plain_ranking(spark, chunks, monkeypatch, rows, terms):
    monkeypatch.setattr(P, "BLOCK_ROWS", rows)
    monkeypatch.setattr(P, "READ_TERMS", terms)
    index, queries = P.build(chunks), S.questions(spark, ASK)
    columns = ("query_id", "file_id", "chunk_index", "score")
    assert listed(P.scores(index, queries), *columns) == listed(S.bm25_scores(chunks, queries), *columns)
    for k in (1, 5, 400):
        assert listed(P.search(index, queries, k), *columns, "rank") == listed(S.bm25(chunks, queries, k), *columns, "rank")
    assert listed(index.vocabulary(), "term", "df", "idf") == listed(S.term_stats(chunks), "term", "df", "idf")
    assert index.rows.count() == chunks.count()


def test_blocks_that_cannot_enter_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 16)
    rows = [(i, 0, "needle here" if i == 500 else "straw " * (1 + i % 5) + f"n{i}") for i in range(1000)]
    chunks = spark.createDataFrame(rows, "file_id long, chunk_index int, chunk_text string").coalesce(1)
    index, queries = P.build(chunks), S.questions(spark, {"q": "needle straw straw"})
    seen = P.open_blocks(index, queries, 1).first()
    assert seen["blocks"] == 63 and seen["open"] <= 4
    assert listed(P.search(index, queries, 1), "file_id", "rank") == [(500, 1)]


def test_a_search_reads_its_terms_only(spark, chunks):
    index = P.build(chunks)
    plan = P._hits(index, S.questions(spark, ["hand"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket#" in plan.split("PartitionFilters")[1][:120]
    assert "EqualTo(term,hand)" in plan or "In(term, [hand])" in plan


def test_a_common_term_is_many_groups(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 32)
    chunks = spark.range(2000).select(F.col("id").alias("file_id"), F.lit(0).alias("chunk_index"), F.lit("same words here").alias("chunk_text"))
    index = P.build(chunks)
    assert index.postings.agg(F.max(F.size("entries"))).first()[0] <= 32
    got = P.search(index, S.questions(spark, {"q": "words"}), 3)
    assert listed(got, "file_id", "rank") == listed(S.bm25(chunks, S.questions(spark, {"q": "words"}), 3), "file_id", "rank")


def test_empty_index_and_texts_without_words(spark):
    kinds = "file_id long, chunk_index int, chunk_text string"
    for rows in ([], [(1, 0, None), (2, 0, "! ?")]):
        index = P.build(spark.createDataFrame(rows, kinds))
        assert P.search(index, S.questions(spark, ["a word"])).count() == 0
        assert index.vocabulary().count() == 0


def test_an_index_is_built_anew_when_its_files_change(spark, tmp_path):
    path = str(tmp_path / "docs")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    docs([(1, "one word")]).write.parquet(path)
    first = P.stored_index(spark.read.parquet(path), "docs", ("doc_id",), "text")
    assert P.stored_index(spark.read.parquet(path), "docs", ("doc_id",), "text").path == first.path
    docs([(2, "two words")]).write.mode("append").parquet(path)
    again = P.stored_index(spark.read.parquet(path), "docs", ("doc_id",), "text")
    assert again.path != first.path and again.n == 2


def test_blocks_are_counted_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 16)
    texts = [" ".join(f"w{(i * j) % 7}" for j in range(1 + i % 9)) for i in range(100)]
    rows = [(i, i, t.split()) for i, t in enumerate(texts)]
    held = spark.createDataFrame(rows, f"doc_id long, _row long, {P.TERMS} array<string>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        blocks = P._blocks(held, ("doc_id",), 3.0)
        assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
        got = {(r.term, r.block): (r.n, r.best, sorted((e.doc_id, e.tf, e.length) for e in r.entries)) for r in blocks.collect()}
        assert blocks.count() == len(got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i, _, words in rows:
        for w in set(words):
            want.setdefault((w, i // 16), []).append((i, words.count(w), len(words)))
    assert {k: (len(v), sorted(v)) for k, v in want.items()} == {k: (n, e) for k, (n, _, e) in got.items()}
    assert all(abs(best - max(P.gain(tf, n, 3.0) for _, tf, n in e)) < 1e-12 for _, best, e in got.values())


@pytest.mark.parametrize("splits", [1, 3])
def test_lists_move_packed_by_bucket(spark, monkeypatch, splits):
    """Lists are packed a few rows a task, a bucket of common terms in as many parts as there are splits, and come out as they were."""
    monkeypatch.setattr(P, "BLOCK_ROWS", 16)
    rows = [(i, i, [f"w{(i * j) % 50}" for j in range(1 + i % 9)] + ["é"]) for i in range(300)]
    held = spark.createDataFrame(rows, f"doc_id long, _row long, {P.TERMS} array<string>").repartitionByRange(3, "_row").sortWithinPartitions("_row")
    seen = lambda df: sorted((r.term, r.block, r.n, r.best, sorted(map(tuple, r.entries))) for r in df.collect())
    packed = P._packed(held, ("doc_id",), 3.0, 8, splits)
    parts = packed.select("part", "bucket").collect()
    assert len(parts) <= 3 * 8 and all((p - b) % 8 < splits for p, b in parts)
    assert {b for p, b in parts if p != b} <= {r[0] for r in spark.createDataFrame([("é",), *((f"w{i}",) for i in range(50))], "term string").select(
        P._bucket("term", 8)).collect()} and (splits > 1 or all(p == b for p, b in parts))
    kinds = f"{P._kinds(held, ('doc_id',))}, bucket int"
    unpacked = packed.select("bucket", "lists").mapInArrow(P._unpack(3.0), kinds)
    assert seen(unpacked) == seen(P._blocks(held, ("doc_id",), 3.0))
    assert unpacked.where(F.col("bucket") != P._bucket("term", 8)).count() == 0


def test_an_index_stores_texts_and_lists_once(spark, tmp_path, monkeypatch):
    """No tokens beside the texts, no lists beside the sorted ones, and one file a bucket however many tasks read the rows."""
    kinds = "file_id long, chunk_index int, chunk_text string"
    rows = spark.createDataFrame([(i, 0, f"word w{i % 90} x{i}") for i in range(1000)], kinds).repartition(6)
    stored, keep = [], P.written
    monkeypatch.setattr(P, "written", lambda df, name: stored.append(name) or keep(df, name))
    index = P.build(rows, path=str(tmp_path / "index"))
    assert stored == []
    assert P.TERMS not in spark.read.parquet(f"{index.path}/rows").columns
    files = list(tmp_path.glob("index/postings/bucket=*/*.parquet"))
    assert len(files) == index.buckets == 8
