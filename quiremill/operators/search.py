"""Chunking, BM25 ranking, extractive answers and chunk tables."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiremill.functions import text as X
from quiremill.functions import values as V
from quiremill.functions.cleaning import strip
from quiremill.operators import versions
from quiremill.operators.relational import latest_per_key, top_n_per_key
from quiremill.session import written

BROADCAST_TERMS = 100_000   # query terms; beyond it the join is left to AQE


# --- chunks ------------------------------------------------------------------------

def _spans(lengths, size: int, overlap: int, shortest: int) -> tuple[list[int], list[int]]:
    """First sentence (from 1) and sentence count of every chunk of one document."""
    starts, counts = [], []
    lo = held = 0

    def close(end: int) -> None:
        if end > lo and held + (end - lo - 1) >= shortest:
            starts.append(lo + 1)
            counts.append(end - lo)

    for i, n in enumerate(lengths):
        if i > lo and held + n > size:
            close(i)
            tail = 0
            j = i
            while j > lo and tail + lengths[j - 1] <= overlap:
                j -= 1
                tail += lengths[j]
            lo, held = j, tail
        held += n
    close(len(lengths))
    return starts, counts


def chunk_documents(docs: DataFrame, size: int = V.CHUNK_CHARS, overlap: int = V.CHUNK_OVERLAP,
                    shortest: int = 1, text: str = "text") -> DataFrame:
    """Documents cut into overlapping runs of sentences: chunk_index and chunk_text.

    The cut points depend on sentence lengths only, so Python sees integers, not
    text; splitting and joining stay in the JVM. Other columns are kept. Every text with a
    sentence has a chunk; ``shortest`` leaves out shorter chunks (``values.CHUNK_MIN`` is the strict rule).
    """
    @F.pandas_udf("starts array<int>, counts array<int>")
    def spans(lengths: pd.Series) -> pd.DataFrame:
        pairs = [_spans(x.tolist(), size, overlap, shortest) for x in lengths]
        return pd.DataFrame(pairs, columns=["starts", "counts"])

    rest = [c for c in docs.columns if c != text]
    cut = docs.select(*rest, F.coalesce(X.sentences(text), F.array().cast("array<string>")).alias("_s")).withColumn(
        "_spans", spans(F.transform("_s", lambda s: F.length(s))))
    texts = F.transform(
        F.arrays_zip("_spans.starts", "_spans.counts"),
        lambda z: F.array_join(F.slice("_s", z["starts"], z["counts"]), " "),
    )
    return cut.select(*rest, F.posexplode(texts).alias("chunk_index", "chunk_text"))


# --- term statistics ----------------------------------------------------------------

TERMS = "terms"     # column of the tokens of a text, where an index holds them


def index_chunks(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """The chunks as a stored table with the tokens of every text, which searches then need not cut again."""
    return written(chunks.withColumn(TERMS, X.tokens(text)), "index")


def _tokens(chunks: DataFrame, text: str) -> Column:
    return F.col(TERMS) if TERMS in chunks.columns else X.tokens(text)


def vocabulary(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """(term, df, total): chunks that hold each term, from one pass.

    The row of the empty term stands for the chunks themselves: its df is their
    number, its total the number of all tokens. Chunks without tokens do not count.
    """
    toks = chunks.select(_tokens(chunks, text).alias("_t")).where(F.size("_t") > 0)
    terms = toks.select(F.size("_t").alias("n"), F.explode(F.concat(F.array_distinct("_t"), F.array(F.lit("")))).alias("term"))
    counted = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n"))
    return counted.select("term", "df", F.when(F.col("term") == "", F.col("n")).otherwise(F.lit(0)).alias("total"))


def index_terms(chunks: DataFrame, text: str = "chunk_text") -> tuple[DataFrame, dict[str, float]]:
    """The vocabulary as a stored table, and its figures: chunks, mean length and idf floor.

    The table is written once to the shared folder, so the text is tokenized once for
    all statistics; one row of figures comes to the driver.
    """
    vocab = written(vocabulary(chunks, text), "vocabulary")
    total = vocab.where("term = ''").agg(F.max("df").alias("n"), F.max("total").alias("tokens")).first()
    n = total["n"] or 0
    if not n:
        return vocab, {"n": 0, "mean_length": 1.0, "floor": 0.0}
    mean = vocab.where("term <> ''").agg(F.avg(raw_idf(F.lit(n)))).first()[0]
    return vocab, {"n": n, "mean_length": total["tokens"] / n, "floor": mean * V.BM25_EPSILON}


def _idf(figures: dict[str, float]) -> Column:
    raw = raw_idf(F.lit(figures["n"]))
    return F.when(raw < 0, F.lit(figures["floor"])).otherwise(raw)


def raw_idf(n: Column) -> Column:
    return F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def term_stats(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """(term, df, idf) with the floor for very common terms: a quarter of the mean idf."""
    vocab, figures = index_terms(chunks, text)
    return vocab.where("term <> ''").select("term", "df", _idf(figures).alias("idf"))


def questions(spark: SparkSession, texts: dict[str, str] | list[str]) -> DataFrame:
    """(query_id, question) from Python values."""
    rows = list(texts.items()) if isinstance(texts, dict) else [(f"q{i}", t) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "query_id string, question string")


def scope_chunks(chunks: DataFrame, user_id: int | None = None, file_ids: list[int] | None = None,
                 doc_type: str | None = None, language: str | None = None,
                 date_range: tuple[str, str] | None = None) -> DataFrame:
    """The chunks a search may see; statistics are computed on these only."""
    if user_id is not None:
        chunks = chunks.where(F.col("user_id") == user_id)
    if file_ids:
        chunks = chunks.where(F.col("file_id").isin(file_ids))
    if doc_type:
        chunks = chunks.where(F.col("doc_type") == doc_type)
    if language:
        chunks = chunks.where(F.col("language") == language)
    if date_range:
        chunks = chunks.where(F.col("created_at").between(*[F.to_timestamp_ntz(F.lit(d)) for d in date_range]))
    return chunks


def bm25_scores(chunks: DataFrame, queries: DataFrame, keys: tuple[str, ...] = ("file_id", "chunk_index"),
                text: str = "chunk_text") -> DataFrame:
    """(query_id, *keys, score) for every chunk that shares a term with a query.

    One pass stores the vocabulary, a second one scores: chunk tokens meet the
    query terms in a hash join, hits are counted per chunk on the map side. The
    query side is broadcast when its counted terms are few.
    """
    keys = list(keys)
    vocab, figures = index_terms(chunks, text)
    wanted = (
        queries.select("query_id", F.explode(X.tokens("question")).alias("term"))
        .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    )
    # Query terms are counted, so a large set of questions is joined by shuffle instead.
    few = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    small = F.broadcast if few else lambda df: df
    terms = vocab.join(small(wanted), "term").select(
        "query_id", "term", (F.col("times") * _idf(figures)).alias("weight"))
    toks = chunks.select(F.struct(*keys).alias("_key"), _tokens(chunks, text).alias("_t")).where(F.size("_t") > 0)
    hits = toks.select("_key", F.size("_t").alias("_len"), F.explode("_t").alias("term")).join(small(terms), "term")
    k1, b = V.BM25_K1, V.BM25_B
    # One grouping: the weight of a term stands beside it, so counts of a chunk's terms are gathered and summed in place.
    counted = hits.groupBy("query_id", "_key", "_len").agg(F.collect_list(F.struct("term", "weight")).alias("_h"))
    gain = lambda tf: tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / figures["mean_length"]))
    score = F.aggregate(
        F.array_distinct("_h"), F.lit(0.0),
        lambda s, h: s + h["weight"] * gain(F.size(F.filter("_h", lambda x: x["term"] == h["term"]))))
    return counted.select("query_id", *[F.col(f"_key.{k}").alias(k) for k in keys], score.alias("score"))


def bm25(chunks: DataFrame, queries: DataFrame, top_k: int = 5, keys: tuple[str, ...] = ("file_id", "chunk_index"),
         text: str = "chunk_text", **scope) -> DataFrame:
    """The best chunks of every query with a positive score: (query_id, *keys, score, rank)."""
    scored = bm25_scores(scope_chunks(chunks, **scope), queries, keys, text)
    # Scores are compared at nine decimals, so the order does not depend on summation order.
    order = [F.desc(F.round("score", 9)), *[F.col(k) for k in keys]]
    return top_n_per_key(scored.where("score > 0"), ["query_id"], order, top_k)


def with_sources(ranked: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("file_id", "chunk_index"),
                 names: DataFrame | None = None) -> DataFrame:
    """Ranked chunks with text and file name, taken from the chunks or from ``names`` (file_id, filename).

    A missing name becomes ``file #<id>``.
    """
    found = chunks.join(ranked, list(keys))
    found = found if names is None else found.join(names, "file_id", "left")
    name = F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.concat(F.lit("file #"), F.col("file_id").cast("string")))
    return found.withColumn("file_name", name)


# --- answers -------------------------------------------------------------------------------

def answer_sentences(sources: DataFrame, queries: DataFrame) -> DataFrame:
    """Scored sentences of the first three chunks of every query.

    Score: share of the question's words in the sentence, less 0.1 per chunk rank and
    0.01 per sentence position.
    """
    asked = queries.select("query_id", F.array_distinct(X.tokens("question", 1)).alias("_q"))
    pieces = sources.where(F.col("rank") <= V.ANSWER_CHUNKS).select(
        "query_id", "rank", "file_id", "file_name", "chunk_text",
        F.posexplode_outer(X.answer_pieces("chunk_text")).alias("position", "sentence"))
    words = F.array_distinct(X.tokens("sentence", 1))
    overlap = F.size(F.array_intersect("_q", words))
    score = (overlap / F.greatest(F.size("_q"), F.lit(1)) - (F.col("rank") - 1) * V.RANK_PENALTY
             - F.col("position") * V.POSITION_PENALTY)
    return pieces.join(asked, "query_id").select(
        "query_id", "rank", "file_id", "file_name", "chunk_text", "position", "sentence",
        F.when(F.col("sentence").isNotNull(), overlap).alias("overlap"),
        F.when(F.col("sentence").isNotNull(), F.round(score, 9)).alias("score"))


def extractive_answers(sources: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, answer): up to three best distinct sentences, or the first chunk when none fits.

    Gathering is bounded: a query brings the sentences of three chunks.
    """
    scored = answer_sentences(sources, queries)
    pool = scored.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("sentence").isNotNull(), F.struct("score", "file_name", "sentence"))), asc=False)
        .alias("c"),
        F.min(F.struct("rank", "chunk_text"))["chunk_text"].alias("top_text"))
    first, second, third = [F.get("c", F.lit(i)) for i in range(3)]
    take_2 = (second["score"] > 0) & (second["sentence"] != first["sentence"])
    take_3 = take_2 & (third["score"] > 0) & ~third["sentence"].isin(first["sentence"], second["sentence"])
    parts = F.concat_ws(" ", first["sentence"], F.when(take_2, second["sentence"]), F.when(take_3, third["sentence"]))
    names = F.array_distinct(F.filter(F.transform(F.slice("c", 1, 3), lambda x: x["file_name"]), lambda x: x != ""))
    named = F.when(F.size(names) > 1, F.concat(
        strip(parts), F.lit("\n\n(مصدر: "), F.array_join(F.slice(names, 1, 2), " · "), F.lit(")"))).otherwise(strip(parts))
    fallback = strip(F.col("top_text").substr(1, V.ANSWER_FALLBACK_CHARS))
    answer = F.when(F.coalesce(first["score"], F.lit(0.0)) <= 0, fallback).otherwise(named.substr(1, V.ANSWER_CHARS))
    return pool.select("query_id", answer.alias("answer"))


def assemble_context(sources: DataFrame, budget: int = V.CONTEXT_CHARS, top: int | None = None,
                     sep: str = "\n\n---\n\n") -> DataFrame:
    """(query_id, context): source blocks in rank order, cut at a character budget."""
    if top is not None:
        sources = sources.where(F.col("rank") <= top)
    block = F.concat(F.lit("["), F.col("file_name"), F.lit("، مقطع "), (F.col("chunk_index") + 1).cast("string"),
                     F.lit("]\n"), F.col("chunk_text"))
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("_block")).over(before), F.lit(0))
    fitted = sources.withColumn("_block", block).withColumn("_used", used).where(F.col("_used") < budget)
    cut = F.substring("_block", F.lit(1), (F.lit(budget) - F.col("_used")).cast("int"))
    return fitted.withColumn("_block", cut).groupBy("query_id").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "_block"))), lambda x: x["_block"]), sep).alias("context"))


def source_snippets(sources: DataFrame) -> DataFrame:
    return sources.select("query_id", "rank", "file_id", "file_name", "chunk_index",
                          F.col("chunk_text").substr(1, V.SNIPPET_CHARS).alias("snippet"), F.round("score", 4).alias("score"))


def index_stats(chunks: DataFrame, approximate: bool = False) -> DataFrame:
    files = F.approx_count_distinct("file_id") if approximate else F.count_distinct("file_id")
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks"), files.alias("indexed_files"))


# --- chunk tables -------------------------------------------------------------------------------

def replace_chunks(spark: SparkSession, path: str, chunks: DataFrame, files: DataFrame | None = None, tag: str | None = None) -> None:
    """Replace all chunks of some files in a chunk table.

    ``files`` lists the file ids to replace (default: those in ``chunks``), so a file whose new
    text gives no chunk loses its old ones only when it is listed. A table is a series of versions, see ``versions``:
    a write that breaks off changes nothing, several writers may work at once, and small versions are put together by themselves.
    """
    versions.replace(spark, path, {"chunks": chunks}, chunks if files is None else files, tag)


def delete_chunks(spark: SparkSession, path: str, files: DataFrame) -> None:
    """Remove all chunks of the listed files: a version that lists them and holds no chunk of theirs."""
    versions.replace(spark, path, {}, files)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The newest chunks of every file."""
    return versions.read(spark, path, "chunks")


def compact_chunks(spark: SparkSession, path: str, target: str | None = None) -> None:
    """Put all versions of a chunk table together, in place or as the first version of a new table."""
    if target is None:
        versions.compact(spark, path)
    else:
        replace_chunks(spark, target, read_chunks(spark, path))


def reindex_texts(files: DataFrame, analyses: DataFrame, quick: DataFrame) -> DataFrame:
    """Text to index per file: newest completed analysis, else the quickly extracted text."""
    done = latest_per_key(
        analyses.where((F.col("status") == "completed")).select("file_id", F.col("id").alias("analysis_id"), "raw_text"),
        ["file_id"], ["analysis_id"])
    joined = files.select(F.col("id").alias("file_id")).join(done, "file_id", "left").join(quick, "file_id", "left")
    text = F.coalesce(F.nullif("raw_text", F.lit("")), "quick_text")
    return joined.select("file_id", "analysis_id", text.alias("text")).where(F.coalesce(strip("text"), F.lit("")) != "")
