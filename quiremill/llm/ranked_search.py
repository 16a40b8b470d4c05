"""Ranked lexical search, term at a time with a limit on accumulators: rare terms first, exact integer scores."""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiremill.llm.common import stored

QUERY_BYTES = 16 << 20       # text of the questions that one pass answers
DOC_BLOCK = 1 << 13          # documents whose postings a task holds at a time
SPLIT = 64                   # first ranks are taken in so many parts of a question's candidates

#: A term is a run of letters, digits and characters beyond ASCII; only A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | bytes | None) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return data.translate(_FOLD).split()


@dataclass
class Corpus:
    """What scores need to know of the whole corpus: documents with a term, their terms, and documents a term."""
    docs: int
    length: int
    holding: dict[int, int]

    def weight(self, term: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * self.holding.get(term, 0) + 1)))


def _count_terms(wanted) -> object:
    """(key, n, terms, tf) of every document that has a term: its length, and how often it holds the questions' terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = wanted.value
        for batch in batches:
            text, picks, lengths, found, often = batch.column(1).cast(pa.binary()), [], [], [], []
            for i in range(batch.num_rows):
                words = terms(text[i].as_py())
                if not words:
                    continue
                held = {number[w]: n for w, n in Counter(words).items() if w in number}
                picks.append(i)
                lengths.append(len(words))
                found.append(np.fromiter(held.keys(), np.int32, len(held)))
                often.append(np.fromiter(held.values(), np.int64, len(held)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(picks, pa.int32())), pa.array(lengths, pa.int64()),
                 pa.array(found, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))], ["key", "n", "terms", "tf"])
    return run


class _Block:
    """Postings of some documents: for a term, their places and its impact on their scores."""

    def __init__(self, batch: pa.RecordBatch, corpus: Corpus):
        lists = batch.column(2)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(batch.num_rows), sizes)
        term = lists.flatten().to_numpy(zero_copy_only=False)
        tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)
        n = batch.column(1).to_numpy(zero_copy_only=False)
        m = 25 + 75 * n * corpus.docs // corpus.length
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.impact, self.rows = doc[order], impact[order], batch.num_rows
        term = term[order]
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(self.impact, starts) if len(term) else starts
        stops = np.append(starts[1:], len(term))
        self.lists = {t: (a, b, x) for t, a, b, x in zip(term[starts].tolist(), starts.tolist(), stops.tolist(), most.tolist())}


def best_of_block(block: _Block, query: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the documents that may be among the ``k`` best; ``floor`` is the kth best score known before.

    ``query`` holds (term, weight times repeats), rare terms first. A term's list opens accumulators
    as long as the terms from it on can reach the kth best partial score; after that it only updates those that exist. A
    partial score never exceeds the whole one, and equal scores may still enter, so nothing is lost.
    """
    here = [(*block.lists[t], w) for t, w in query if t in block.lists]
    rest = sum(most * w for _, _, most, w in here)
    if not rest or rest < floor:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    score, live, open_ = np.zeros(block.rows, np.int64), np.zeros(block.rows, bool), True
    for a, b, most, w in here:
        doc, gain = block.doc[a:b], block.impact[a:b] * w
        if open_ and rest < floor:                        # documents without an accumulator stay below the kth
            open_ = False
        if open_:
            live[doc] = True
            score[doc] += gain
            held = score[live]
            if len(held) >= k:
                floor = max(floor, int(np.partition(held, len(held) - k)[len(held) - k]))
        else:
            old = live[doc]
            score[doc[old]] += gain[old]
        rest -= most * w
    places = np.flatnonzero(live & (score >= max(floor, 1)))
    return places, score[places]


def _rank(queries, corpus: Corpus, k: int):
    """(query, part, key, score): the best documents of those a task reads, for every question."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight: dict[int, int] = {}
        plans = []
        for terms_of in queries.value:
            for t in terms_of:
                if t not in weight:
                    weight[t] = corpus.weight(t)
            plans.append([(t, weight[t] * terms_of[t]) for t in sorted(terms_of, key=lambda t: (corpus.holding.get(t, 0), t))])
        best: list[list[tuple]] = [[] for _ in plans]     # (-score, key is null, key), best first
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_BLOCK):
                block_rows = batch.slice(at, DOC_BLOCK)
                block, keys = _Block(block_rows, corpus), block_rows.column(0)
                for q, plan in enumerate(plans):
                    held = best[q]
                    places, scores = best_of_block(block, plan, k, -held[k - 1][0] if len(held) >= k else 0)
                    if len(places):
                        new = [(-s, x is None, x) for s, x in zip(scores.tolist(), keys.take(pa.array(places)).to_pylist())]
                        best[q] = sorted(held + new, key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0))[:k]
        rows = [(q, x, -s) for q, held in enumerate(best) for s, _, x in held]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], keys.type), pa.array([r[2] for r in rows], pa.int64())],
                ["query", "key", "score"])
    return run


def _answer(docs: DataFrame, questions: list[bytes], k: int, key: str, text: str) -> DataFrame:
    """(query int, key, rank, score) for some questions, by their place in the list."""
    spark = docs.sparkSession
    number: dict[bytes, int] = {}
    asked = [Counter(number.setdefault(t, len(number)) for t in terms(q)) for q in questions]
    kind = docs.schema[key].dataType.simpleString()
    wanted = spark.sparkContext.broadcast(number)         # terms of QUERY_BYTES of questions
    postings = stored(docs.where(docs[text].isNotNull()).select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        _count_terms(wanted), f"key {kind}, n long, terms array<int>, tf array<long>"), "postings")
    docs_, length = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = postings.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()      # a row for each asked term
    corpus = Corpus(docs_, max(length, 1), dict(zip(holding["term"].to_pylist(), holding["count"].to_pylist())))
    found = postings.mapInArrow(_rank(spark.sparkContext.broadcast(asked), corpus, k), f"query int, key {kind}, score long")
    order = [F.desc("score"), F.asc_nulls_last("key")]
    found = found.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(SPLIT)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id",
           question: str = "text") -> DataFrame:
    """(item, rank, key, score): the ``k`` best documents for every row of ``items``, of those with a score above 0.

    Documents are dealt over the tasks, each of which walks the lists of a question's terms in its documents, rarest term first,
    with the kth best score of its earlier documents as the first limit. Statistics cover all documents; what tasks
    find is ranked over all. Questions are answered some at a time, so what is broadcast is bounded however many there are.

    Equal scores come by rising key, NULL keys last. NULL and empty texts have no term: such documents do not count, such questions
    find nothing. Repeated documents rank each for itself; repeated rows of ``items`` answer once, and rows that
    share an id but not the text are separate questions, each with ranks from 1. Empty tables give no row. Integers have 64 bits.
    """
    asked = items.select(items[item].alias("item"), items[question].alias("question")).where("question IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.octet_length("question"))).first()[0] or 0
    parts = size // QUERY_BYTES + 1
    asked = asked.withColumn("part", F.pmod(F.xxhash64("item", "question"), F.lit(parts)))
    spark, found = docs.sparkSession, None
    for part in range(parts):
        rows = asked.where(F.col("part") == part).select("item", "question").toArrow()        # about QUERY_BYTES
        names = spark.createDataFrame(rows.select(["item"]).append_column("query", pa.array(range(rows.num_rows), pa.int32())),
                                      f"item {items.schema[item].dataType.simpleString()}, query int")
        answer = _answer(docs, [q.encode() for q in rows["question"].to_pylist()], k, key, text)
        answer = answer.join(F.broadcast(names), "query").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
        found = answer if found is None else found.union(answer)
    return found
