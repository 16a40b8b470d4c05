"""A stored index of postings: a search reads the blocks of its terms, and of these only what can enter the best."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.functions import text as X
from quiremill.functions import values as V
from quiremill.operators.relational import top_n_per_key
from quiremill.operators.search import TERMS, raw_idf
from quiremill.session import scratch_path, shared_dir, written
from quiremill.sources.folders import exists, file_facts

BLOCK_ROWS = 1024            # rows whose postings of one term stand together
BUCKET_POSTINGS = 4_000_000  # blocks of terms are dealt into folders of about so many postings
READ_TERMS = 2_000           # a search for more terms joins them instead of listing them in its filters
SEED_BLOCKS = 4              # blocks of a question that are scored first, for the score to beat
PACK_POSTINGS = 500_000      # postings that a task packs together, by bucket, before it passes them on
SPLIT_ROWS = 1 << 22         # so many rows more, and the lists of a bucket with common terms are sorted in one task more
HOT_BUCKET = 1.5             # a bucket with so many times the mean postings has common terms


@dataclass(frozen=True)
class PostingIndex:
    """A stored index: rows below ``rows``, block lists below ``postings``, document frequencies below ``terms``."""
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int
    n: int
    mean_length: float
    floor: float

    @property
    def rows(self) -> DataFrame:
        """The indexed rows with all their columns."""
        return self.spark.read.parquet(f"{self.path}/rows").drop("_size", "_row")

    @property
    def terms(self) -> DataFrame:
        """(term, df, bucket)"""
        return self.spark.read.schema("term string, df bigint, bucket int").parquet(f"{self.path}/terms")

    @property
    def postings(self) -> DataFrame:
        """(term, block, n, best, entries, bucket): a term's postings in a block of neighbouring rows."""
        return _read_postings(self.rows, self.path, self.keys)

    def idf(self) -> Column:
        raw = raw_idf(F.lit(self.n))
        return F.when(raw < 0, F.lit(self.floor)).otherwise(raw)

    def vocabulary(self) -> DataFrame:
        """(term, df, idf), with the floor for very common terms."""
        return self.terms.select("term", "df", self.idf().alias("idf"))


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def gain(tf: Column, length: Column, mean_length: float) -> Column:
    """What a term of weight one adds to a score."""
    k1, b = V.BM25_K1, V.BM25_B
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def _lists(keys: tuple[str, ...], mean_length: float):
    """(term, block, n, best, entries): the postings of each term in a block of neighbouring rows, without a shuffle.

    The input holds the keys, ``_row`` in ascending order and the tokens. Tokens of a block are numbered and counted as arrays. A block that is
    cut by the splits of a file comes in two parts, which are searched as two.
    """
    shift = BLOCK_ROWS.bit_length() - 1

    def one(rows: pa.Table, block: int) -> pa.RecordBatch:
        length = pc.list_value_length(rows[TERMS]).to_numpy()
        coded = pc.list_flatten(rows[TERMS]).combine_chunks().dictionary_encode()
        pairs = coded.indices.to_numpy().astype(np.int64) * len(length) + np.repeat(np.arange(len(length)), length)
        pairs, tf = np.unique(pairs, return_counts=True)
        term, row = np.divmod(pairs, len(length))
        begin = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(begin, len(term))
        best = np.maximum.reduceat(gain(tf, length[row], mean_length), begin)
        named = {k: rows[k].combine_chunks().take(pa.array(row)) for k in keys}
        named |= {"tf": pa.array(tf, pa.int32()), "length": pa.array(length[row], pa.int32())}
        entries = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(named.values()), list(named)))
        return pa.RecordBatch.from_arrays([
            coded.dictionary, pa.array(np.full(len(begin), block), pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(best), entries],
            ["term", "block", "n", "best", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None                                        # rows of a block that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            blocks = rows["_row"].to_numpy() >> shift
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for at, end in zip(cuts[:-2], cuts[1:-1]):
                yield one(rows.slice(at, end - at), blocks[at])
            rest = rows.slice(cuts[-2])
        if rest is not None:
            yield one(rest, rest["_row"][0].as_py() >> shift)

    return run


def _blocks(held: DataFrame, keys: tuple[str, ...], mean_length: float) -> DataFrame:
    """The lists of ``_lists`` as rows."""
    return held.select(*keys, "_row", TERMS).mapInArrow(_lists(keys, mean_length), _kinds(held, keys))


def _packed(held: DataFrame, keys: tuple[str, ...], mean_length: float, buckets: int, splits: int = 1) -> DataFrame:
    """(part, bucket, lists): the same lists, packed by bucket."""
    lists = _lists(keys, mean_length)
    return held.select(*keys, "_row", TERMS).mapInArrow(lambda batches: _pack(lists(batches), buckets, splits), "part int, bucket int, lists binary")


def _pack(runs: Iterator[pa.RecordBatch], buckets: int, splits: int = 1) -> Iterator[pa.RecordBatch]:
    """(part, bucket, lists): lists of some blocks, sorted and packed by bucket, so that few bytes move."""
    def bucket(term: str) -> int:                          # as ``_bucket``
        return (xxhash.xxh64_intdigest(term.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.Table.from_batches(held).select(["term", "block", "entries"]).combine_chunks()
        coded = lists["term"].combine_chunks().dictionary_encode()
        at = np.array([bucket(t) % buckets for t in coded.dictionary.to_pylist()], np.int32)
        place = np.empty(len(at), np.int64)
        place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(at))
        code, block = coded.indices.to_numpy(), lists["block"].to_numpy()
        order = np.lexsort((block, place[code], at[code]))
        lists, at, split = lists.take(pa.array(order)), at[code][order], xxhash.xxh64_intdigest(block[:1].tobytes()) % splits
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        sizes = np.add.reduceat(pc.list_value_length(lists["entries"]).to_numpy(), starts)
        hot = (sizes > HOT_BUCKET * sizes.sum() / buckets).tolist()
        for begin, end, often in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], hot):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, lists.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(lists.slice(begin, end - begin))
            one = int(at[begin])
            yield pa.RecordBatch.from_arrays([pa.array([(one + often * split) % buckets], pa.int32()), pa.array([one], pa.int32()),
                                              pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "bucket", "lists"])

    held, n = [], 0
    for run in runs:
        held.append(run)
        n += len(run.column("entries").values)
        if n >= PACK_POSTINGS:
            yield from pack(held)
            held, n = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield from pack(held)


def _unpack(mean_length: float):
    """(term, block, n, best, entries, bucket) of packed lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, lists in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in pa.ipc.open_stream(lists.as_buffer()):
                    term, block, entries = part.columns
                    flat, n = entries.flatten(), pc.list_value_length(entries).to_numpy().astype(np.int64)
                    found = gain(flat.field("tf").to_numpy(), flat.field("length").to_numpy(), mean_length)
                    best = np.maximum.reduceat(found, np.cumsum(n) - n)
                    yield pa.RecordBatch.from_arrays([term, block, pa.array(n), pa.array(best), entries, pa.array(np.full(len(n), bucket, np.int32))],
                                                     ["term", "block", "n", "best", "entries", "bucket"])
    return run


def build(rows: DataFrame, keys: tuple[str, ...] = ("file_id", "chunk_index"), text: str = "chunk_text",
          path: str | None = None) -> PostingIndex:
    """Store an index of the rows below ``path`` (default: a new folder in the shared one).

    Texts are cut into tokens for the figures, and again for the counts, rather than stored as tokens. Counts meet by (term, block of
    neighbouring rows), so however many rows hold a term, a list has at most ``BLOCK_ROWS``. Each block carries the best gain of its
    postings. Lists move once, packed by bucket, and are sorted by bucket and term there; beyond ``SPLIT_ROWS`` a common term is
    split over tasks and files. The figures of the whole index are written last and make it readable.
    """
    spark = rows.sparkSession
    path = path or scratch_path(spark, "postings")
    cut = rows.withColumns({"_size": F.size(X.tokens(text)), "_row": F.monotonically_increasing_id()})
    cut.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/rows").where("_size > 0")
    n, tokens = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    mean = tokens / n if n else 1.0
    buckets = max(8, tokens // BUCKET_POSTINGS)
    lists = _packed(held.select(*keys, "_row", X.tokens(text).alias(TERMS)), keys, mean, buckets, 1 + n // SPLIT_ROWS)
    lists = lists.repartitionById(buckets, "part").select("bucket", "lists").mapInArrow(_unpack(mean), f"{_kinds(cut, keys)}, bucket int")
    ordered = lists.sortWithinPartitions("bucket", "term", "block")
    ordered.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    terms = _read_postings(cut, path, keys).groupBy("term", "bucket").agg(F.sum("n").alias("df"))
    terms.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    terms = spark.read.schema("term string, df bigint, bucket int").parquet(f"{path}/terms")
    mean_idf = terms.agg(F.avg(raw_idf(F.lit(n)))).first()[0] or 0.0
    figures = [(",".join(keys), buckets, n, float(mean), mean_idf * V.BM25_EPSILON)]
    spark.createDataFrame(figures, "keys string, buckets bigint, n bigint, mean_length double, floor double").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/figures")
    return open_index(spark, path)


def _kinds(rows: DataFrame, keys: tuple[str, ...]) -> str:
    kinds = ", ".join(f"{k}: {rows.schema[k].dataType.simpleString()}" for k in keys)
    return f"term string, block bigint, n bigint, best double, entries array<struct<{kinds}, tf: int, length: int>>"


def _read_postings(rows: DataFrame, path: str, keys: tuple[str, ...]) -> DataFrame:
    return rows.sparkSession.read.schema(f"{_kinds(rows, keys)}, bucket int").parquet(f"{path}/postings")


def open_index(spark: SparkSession, path: str) -> PostingIndex:
    row = spark.read.parquet(f"{path}/figures").first()
    return PostingIndex(spark, path, tuple(row["keys"].split(",")), row["buckets"], row["n"], row["mean_length"], row["floor"])


def stored_index(rows: DataFrame, name: str, keys: tuple[str, ...] = ("file_id", "chunk_index"), text: str = "chunk_text") -> PostingIndex:
    """The index of the rows under a name, built unless the shared folder holds one of the same input files as they are now.

    ``name`` stands for what the plan above the files does; two plans must not share one.
    """
    spark = rows.sparkSession
    facts = sorted(file_facts(spark, f) for f in rows.inputFiles())
    digest = hashlib.sha256(repr(("packed", name, keys, text, facts)).encode()).hexdigest()[:32]
    path = f"{shared_dir(spark)}/quiremill/index-{digest}"
    return open_index(spark, path) if exists(spark, f"{path}/figures/_SUCCESS") else build(rows, keys, text, path)


def _hits(index: PostingIndex, queries: DataFrame) -> DataFrame:
    """(query_id, block, best, weight, entries): the blocks of every question's terms that the index holds.

    Few terms are named in the filters, so that only their folders and row groups are read.
    """
    asked = queries.select("query_id", F.explode(X.tokens("question")).alias("term")).groupBy("query_id", "term").agg(
        F.count(F.lit(1)).alias("times")).withColumn("bucket", _bucket("term", index.buckets))
    asked = written(asked, "asked")
    named = asked.select("bucket", "term").distinct().limit(READ_TERMS + 1).collect()
    terms, blocks = index.terms, index.postings
    if len(named) <= READ_TERMS:
        mine = F.col("bucket").isin(sorted({r.bucket for r in named})) & F.col("term").isin([r.term for r in named])
        terms, blocks, asked = terms.where(mine), blocks.where(mine), F.broadcast(asked)
    weights = written(terms.join(asked, ["bucket", "term"]).select(
        "query_id", "bucket", "term", (F.col("times") * index.idf()).alias("weight")), "weights")
    weights = F.broadcast(weights) if len(named) <= READ_TERMS else weights
    return blocks.join(weights, ["bucket", "term"]).select("query_id", "block", "best", "weight", "entries")


def _scored(index: PostingIndex, hits: DataFrame) -> DataFrame:
    """(query_id, *keys, score): lists of a question's block meet whole, and are added up where they meet."""
    met = hits.select("query_id", "block", "weight", "entries").repartition("query_id", "block")
    each = met.select("query_id", "block", "weight", F.inline("entries"))
    add = F.sum(F.col("weight") * gain(F.col("tf"), F.col("length"), index.mean_length)).alias("score")
    return each.groupBy("query_id", "block", *index.keys).agg(add).drop("block")


def scores(index: PostingIndex, queries: DataFrame) -> DataFrame:
    """(query_id, *keys, score) for every row that shares a term with a question."""
    return _scored(index, _hits(index, queries))


def _open(index: PostingIndex, hits: DataFrame, top_k: int, order: list[Column], seeds: int) -> DataFrame:
    """(query_id, block, open): whether a block of a question promises enough to be scored."""
    bounds = written(hits.groupBy("query_id", "block").agg(F.sum(F.greatest("weight", F.lit(0.0)) * F.col("best")).alias("bound")), "bounds")
    first = top_n_per_key(bounds, ["query_id"], [F.desc("bound"), F.col("block")], seeds).select("query_id", "block")
    begun = _scored(index, hits.join(first, ["query_id", "block"], "left_semi")).where("score > 0")
    least = top_n_per_key(begun, ["query_id"], order, top_k).where(F.col("rank") == top_k)
    least = written(least.select("query_id", F.col("score").alias("least")), "least")
    enough = F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6)          # scores are compared at nine decimals
    return bounds.join(least, "query_id", "left").select("query_id", "block", enough.alias("open"))


def _order(index: PostingIndex) -> list[Column]:
    return [F.desc(F.round("score", 9)), *[F.col(k) for k in index.keys]]


def search(index: PostingIndex, queries: DataFrame, top_k: int = 5, seeds: int = SEED_BLOCKS) -> DataFrame:
    """(query_id, *keys, score, rank): the best rows of every question with a positive score, as ``search.bm25`` ranks them.

    A block can give a row no more than the sum of its terms' best gains. The blocks that promise most are scored
    first; a block that promises less than the ``top_k``-th score found there is not read further. The result is exact.
    """
    hits = _hits(index, queries)
    kept = _open(index, hits, top_k, _order(index), seeds).where("open").select("query_id", "block")
    found = _scored(index, hits.join(kept, ["query_id", "block"], "left_semi"))
    return top_n_per_key(found.where("score > 0"), ["query_id"], _order(index), top_k)


def open_blocks(index: PostingIndex, queries: DataFrame, top_k: int = 5, seeds: int = SEED_BLOCKS) -> DataFrame:
    """(query_id, blocks, open): how many blocks hold a question's terms, and how many of them a search scores."""
    found = _open(index, _hits(index, queries), top_k, _order(index), seeds)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("open").alias("open"))
