"""Class-based bigram language model in the manner of Brown: exchange clustering, then smoothed scores.

The work is laid out in chunks. A chunk holds the tokens of some documents as numbers into its own word list,
so that every later pass is array arithmetic. What is known of words corpus-wide travels by
joins on the words' 64-bit hashes; nothing that grows with the vocabulary is broadcast or sent to the driver.

1. Tokens: texts become chunks with word lists and counts.
2. Core: bigrams of the ``CORE_WORDS`` most frequent words, exactly counted (a matrix of fixed size), feed the exchange algorithm, which
   moves a word to the class that raises the likelihood most until none moves.
3. Every other word is moved once, from the class of rare words to its best class, given all its
   contexts in the training texts.
4. Transitions between the classes of all words are counted, and every document is scored.
"""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quiremill.llm.common import SLICE_ROWS, ascii_words, stored

CORE_WORDS = 512          # words that are clustered by full exchange; also fixes what the driver holds
CORE_SHARE = 2e-5         # words that make up so much of a chunk are the first to be counted for the core
BROADCAST_WORDS = 1 << 16  # words that may be of the core and go to every task; more are joined by a shuffle
CLASSES = 24              # classes that words are assigned to
CHUNK_TOKENS = 1 << 20    # a chunk ends at about so many tokens
EXCHANGE_ROUNDS = 12
DISCOUNT = 0.5            # taken from every word's count, and kept for unknown words
BACKOFF = 5.0             # weight of the class frequencies in the transitions

RARE = CLASSES            # contexts: the classes, words outside the core, the end of a text
END = CLASSES + 1
CONTEXTS = CLASSES + 2
COUNT_MASK = (1 << 22) - 1
WORD_BITS = 28            # bits of a word's place in its chunk; a word is named by chunk and place in one number
UNKNOWN = CLASSES         # classes of tokens when scoring: the classes, unknown words, the end
STATES = CLASSES + 2


def chunks(docs: DataFrame, held: Callable[[str], bool]) -> DataFrame:
    """Chunks of whole texts (columns key and text). The word at place 0 is the end of a text."""
    key_type = docs.schema["key"].dataType.simpleString()
    schema = (f"chunk long, keys array<{key_type}>, held binary, starts binary, tokens binary, words binary, counts binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, number = (context.partitionId() if context else 0), count()

        def fresh():
            numbers: defaultdict[bytes, int] = defaultdict(count(1).__next__)
            return numbers, [], [], []

        numbers, keys, flags, lists = fresh()
        size = 0

        def pack() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            tokens = np.concatenate(lists)
            learned = np.repeat(~np.array(flags, bool), np.diff(starts))
            counts = np.bincount(tokens[learned], minlength=len(numbers) + 1)
            hashes = np.array([0, *map(xxhash.xxh64_intdigest, numbers)], np.uint64)
            return pa.RecordBatch.from_arrays([
                pa.array([part << 12 | next(number)], pa.int64()), pa.array([keys], pa.list_(batch.schema.field(0).type)),
                *[pa.array([x.tobytes()], pa.binary()) for x in (
                    np.array(flags, np.uint8), starts, _planes(tokens), hashes, counts.astype(np.int32))]],
                ["chunk", "keys", "held", "starts", "tokens", "words", "counts"])

        batch = None
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = ascii_words(text.as_py())
                ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                lists.append(np.append(ids, np.int32(0)))
                keys.append(key)
                flags.append(held(key))
                size += len(ids) + 1
                if size >= CHUNK_TOKENS:
                    yield pack()
                    numbers, keys, flags, lists = fresh()
                    size = 0
        if keys:
            yield pack()

    return docs.select("key", "text").mapInArrow(run, schema)


def _planes(tokens: np.ndarray) -> np.ndarray:
    """Numbers with their low 16 bits first and the rest behind them, which takes less room: most are small."""
    return np.concatenate([(tokens & 0xFFFF).astype(np.uint16).view(np.uint8), (tokens >> 16).astype(np.uint16).view(np.uint8)])


def _from_planes(blob: bytes) -> np.ndarray:
    low, high = np.frombuffer(blob, np.uint16).reshape(2, -1)
    return high.astype(np.int32) << 16 | low


@dataclass
class Chunk:
    """One chunk as arrays; those whose columns were not read are empty."""
    keys: list
    held: np.ndarray
    starts: np.ndarray
    tokens: np.ndarray
    words: np.ndarray
    counts: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Chunk:
        array = lambda name, kind: np.frombuffer(row.get(name, b""), kind)
        return cls(row.get("keys", []), array("held", np.uint8).astype(bool), array("starts", np.int64), _from_planes(row.get("tokens", b"")),
                   array("words", np.uint64), array("counts", np.int32))

    def learned(self) -> np.ndarray:
        """Which tokens belong to training texts."""
        return np.repeat(~self.held, np.diff(self.starts))

    def before(self, values: np.ndarray, first: int) -> np.ndarray:
        """The value of the token before each one; ``first`` before a text."""
        out = np.empty_like(values)
        out[1:], out[:1] = values[:-1], first
        out[self.starts[:-1]] = first
        return out


def per_chunk(table: DataFrame, work: Callable[[Chunk, int], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """One call of ``work`` for every chunk; the arrays it returns are the columns of its rows."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                out = work(Chunk.read(row), row["chunk"])
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names)
                row = out = None
            batch = None
            pa.default_memory_pool().release_unused()      # a worker is reused; it need not hold what it has read
    return table.mapInArrow(run, schema)


def most_frequent(table: DataFrame, total: int) -> list:
    """(word, n) of the ``CORE_WORDS`` words most frequent in the training texts, equal counts by hash: exactly.

    Sums over the chunks where a word makes up at least a share are too low by less than the share of all other chunks. Their
    ``CORE_WORDS``-th is a count to reach; words that may reach it are counted in all chunks. No word that reaches it stays below
    its share of all tokens in every chunk, so a share that is not lower than that is lowered to it.
    """
    def above(share: float) -> DataFrame:
        def pick(c: Chunk, _: int) -> dict[str, np.ndarray]:
            size = int(c.counts.sum())
            at = c.counts >= max(1, share * size * (1 - 1e-9))
            at[0] = False
            return {"word": c.words[at].view(np.int64), "n": c.counts[at].astype(np.int64), "size": np.full(at.sum(), size, np.int64)}

        return per_chunk(table.select("chunk", "words", "counts"), pick, "word long, n long, size long")

    def sums(share: float) -> tuple[DataFrame, int]:
        found = stored(above(share).groupBy("word").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "frequent")
        best = found.orderBy(F.desc("n"), "word").limit(CORE_WORDS).agg(F.count("*"), F.min("n")).first()
        return found, best[1] if best[0] == CORE_WORDS else 0

    share = CORE_SHARE
    found, least = sums(share)
    if share * total >= least:
        share = least / max(total, 1)
        found, least = sums(share)
    if share:
        may = found.where(F.col("n") + F.lit(share) * (F.lit(total) - F.col("size")) >= least - 1).select("word")
        may = F.broadcast(may) if may.count() <= BROADCAST_WORDS else may
        found = above(0).join(may, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
    return found.orderBy(F.desc("n"), "word").limit(CORE_WORDS).select("word", "n").collect()


def exchange(bigrams: np.ndarray, classes: int, rounds: int = EXCHANGE_ROUNDS) -> np.ndarray:
    """Classes of the core words by the exchange algorithm.

    ``bigrams`` counts neighbours among the core words, followed by two fixed classes of their own (words outside the
    core, the end). Words start in classes by rank; each is moved to the class of the highest likelihood, in rank order.
    """
    n = len(bigrams) - 2
    if n <= 0:
        return np.zeros(0, np.int64)
    xlogx = lambda x: x * np.log(np.maximum(x, 1))
    where = np.concatenate([np.arange(n) % classes, [classes, classes + 1]])
    member = np.eye(classes + 2)[where]
    right, left = bigrams @ member, bigrams.T @ member           # counts of a word with the class after / before it
    table = member.T @ right
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            old, self_count = where[w], bigrams[w, w]
            r, c = right[w].copy(), left[w].copy()
            # Take the word out of its class.
            r[old] -= self_count
            c[old] -= self_count
            table[old] -= r
            table[:, old] -= c
            table[old, old] -= self_count
            # The likelihood is the sum of x log x over the table less that over its margins.
            rows, cols = table[:classes] + r, table[:, :classes] + c[:, None]
            gain = (xlogx(rows) - xlogx(table[:classes])).sum(axis=1) + (xlogx(cols) - xlogx(table[:, :classes])).sum(axis=0)
            own = np.diagonal(table)[:classes]
            gain += xlogx(own + r[:classes] + c[:classes] + self_count) - xlogx(own + r[:classes]) - xlogx(own + c[:classes]) + xlogx(own)
            out_, in_ = table.sum(axis=1)[:classes], table.sum(axis=0)[:classes]
            gain -= xlogx(out_ + r.sum() + self_count) - xlogx(out_) + xlogx(in_ + c.sum() + self_count) - xlogx(in_)
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else old
            table[new] += r
            table[:, new] += c
            table[new, new] += self_count
            if new != old:
                moved += 1
                where[w] = new
                member[w] = np.eye(classes + 2)[new]
                right[:, old] -= bigrams[:, w]
                right[:, new] += bigrams[:, w]
                left[:, old] -= bigrams[w]
                left[:, new] += bigrams[w]
        if not moved:
            break
    return where[:n]


def core_bigrams(table: DataFrame, core: np.ndarray) -> np.ndarray:
    """Neighbour counts of the core words, of all others as one, and of the end, over all training texts."""
    size = len(core) + 2

    def work(c: Chunk, _: int) -> dict[str, np.ndarray]:
        states = core_places(c.words, core)[c.tokens]
        codes = (c.before(states, len(core) + 1) * size + states)[c.learned()]
        counts = np.bincount(codes, minlength=size * size)
        at = np.flatnonzero(counts)
        return {"at": at.astype(np.int32), "n": counts[at]}

    rows = per_chunk(table, work, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()    # (core + 2)**2 at most
    out = np.zeros(size * size)
    out[rows["at"].to_numpy(int)] = rows["n"].to_numpy(float)
    return out.reshape(size, size)


def core_places(words: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Place in ``core`` (sorted hashes) of each word of a chunk; len(core) for others, one more for the end."""
    if len(core):
        at = np.minimum(np.searchsorted(core, words), len(core) - 1)
        out = np.where(core[at] == words, at, len(core)).astype(np.int32)
    else:
        out = np.zeros(len(words), np.int32)
    out[0] = len(core) + 1
    return out


def rare_contexts(table: DataFrame, core: np.ndarray, contexts: np.ndarray) -> DataFrame:
    """(word, codes): of each chunk's training words outside the core, the class pairs they stand between.

    A code packs a pair and how often the word stands there; the counts of a word's codes add up to its own.
    """
    def work(c: Chunk, _: int) -> dict[str, np.ndarray]:
        states = contexts[core_places(c.words, core)].astype(np.uint8)[c.tokens]
        pick = c.learned() & (states == RARE)
        at = np.flatnonzero(pick)
        after = states[np.minimum(at + 1, len(states) - 1)]     # each text ends in an end token, so none looks into the next
        code = c.before(states, END)[at].astype(np.int64) * CONTEXTS + after
        pairs, n = np.unique(c.tokens[at] * np.int64(CONTEXTS ** 2) + code, return_counts=True)
        while (n > COUNT_MASK).any():                          # a count that is too large is given in parts
            large = n > COUNT_MASK
            pairs, n = np.append(pairs, pairs[large]), np.append(np.where(large, COUNT_MASK, n), n[large] - COUNT_MASK)
            order = np.argsort(pairs, kind="stable")
            pairs, n = pairs[order], n[order]
        local, code = pairs // CONTEXTS ** 2, pairs % CONTEXTS ** 2
        first = np.flatnonzero(np.diff(local, prepend=-1))
        packed = (code << 22 | n).astype(np.uint32)
        offsets = np.append(first, len(packed)) * 4
        blob = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed.tobytes())])
        return {"word": c.words[local[first]].view(np.int64), "codes": blob.cast(pa.binary())}

    return per_chunk(table, work, "word long, codes binary")


def assign_rare(contexts: DataFrame, gains: np.ndarray) -> DataFrame:
    """(word, n, class): the best class of each word outside the core, from its rows sorted by word.

    ``gains`` holds the change in likelihood for each class pair (rows) and class. A word has a row for each chunk it
    stands in; rows are walked in order, and one running sum is kept.
    """
    table = gains.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, np.ndarray] | None = None       # a word that may go on

        def rows(words, counts, scores) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(
                np.argmax(scores, axis=1) if len(words) else np.zeros(0), pa.int32())], ["word", "n", "class"])

        for batch in batches:
            if not batch.num_rows:
                continue
            word, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            packed = np.frombuffer(b"".join(blobs), np.uint32)
            begin = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])[:-1]])
            times = (packed & COUNT_MASK).astype(np.int64)
            n = np.add.reduceat(times, begin)
            score = np.add.reduceat(table[packed >> 22] * times[:, None], begin, axis=0)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words, counts, scores = word[first], np.add.reduceat(n, first), np.add.reduceat(score, first, axis=0)
            if last is not None:
                if last[0] == words[0]:
                    counts[0] += last[1]
                    scores[0] += last[2]
                else:
                    yield rows([last[0]], [last[1]], last[2][None])
            last = (int(words[-1]), int(counts[-1]), scores[-1])
            yield rows(words[:-1], counts[:-1], scores[:-1])
        if last is not None:
            yield rows([last[0]], [last[1]], last[2][None])

    ordered = contexts.repartition("word").sortWithinPartitions("word")
    return ordered.mapInArrow(run, "word long, n long, class int")


SCORED = ("held boolean, n_tokens long, n_known long, base double, emission double, codes binary")


def score_chunks(table: DataFrame, lexicon: DataFrame, sizes: np.ndarray, kinds: np.ndarray, total: int, distinct: int) -> DataFrame:
    """(key, held, n_tokens, n_known, base, emission, codes): sums over every text.

    ``lexicon`` holds (word, n, class). ``codes`` packs the counts of a text's class transitions as pairs of
    32-bit integers. Words meet their chunk by a join on the hash and a grouping by chunk.
    """
    def listed(c: Chunk, chunk: int) -> dict[str, np.ndarray]:
        return {"place": chunk << WORD_BITS | np.arange(1, len(c.words), dtype=np.int64), "word": c.words[1:].view(np.int64)}

    at = F.col("place").bitwiseAND(F.lit((1 << WORD_BITS) - 1).cast("long"))
    named = per_chunk(table.select("chunk", "words"), listed, "place long, word long").join(lexicon, "word").select(
        F.shiftright("place", WORD_BITS).alias("chunk"), (at * 256 + F.col("class")).alias("known"), "n")
    key_type = table.schema["keys"].dataType.elementType.simpleString()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            c = Chunk.read(row)
            n, state = np.zeros(len(c.words)), np.full(len(c.words), UNKNOWN, np.int16)
            known = right.column("known").to_numpy()
            at = known >> 8
            n[at], state[at] = right.column("n").to_numpy(), known & 255
            n[0], state[0] = ends, STATES - 1
            base = np.log10((n + 1) / (total + distinct + 1))
            with np.errstate(divide="ignore", invalid="ignore"):
                emission = np.where(n > 0, np.log10((n - DISCOUNT) / np.append(sizes, [1, 1])[state]), 0.0)
            emission[0] = 0.0
            states = state[c.tokens]
            codes = c.before(states, STATES - 1) * STATES + states
            small = np.int32 if len(c.keys) * STATES ** 2 < 1 << 31 else np.int64
            text = np.repeat(np.arange(len(c.keys), dtype=small), np.diff(c.starts))
            text *= STATES ** 2
            text += codes
            add = lambda values: np.add.reduceat(values[c.tokens], c.starts[:-1])
            pairs, times = np.unique(text, return_counts=True)
            del text, codes, states
            where = np.searchsorted(pairs // STATES ** 2, np.arange(len(c.keys) + 1))
            packed = np.stack([pairs % STATES ** 2, times], axis=1).astype(np.int32)
            blobs = [packed[a:b].tobytes() for a, b in zip(where[:-1].tolist(), where[1:].tolist())]
            out.append(pa.table({
                "key": pa.array(c.keys, left.schema.field("keys").type.value_type), "held": pa.array(c.held),
                "n_tokens": np.diff(c.starts), "n_known": add((n > 0).astype(np.int64)), "base": add(base),
                "emission": add(emission), "codes": pa.array(blobs, pa.binary())}))
        return pa.concat_tables(out)

    ends = int(kinds[-1])
    table = table.select("chunk", "keys", "held", "starts", "tokens", "words")
    return table.groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(score, f"key {key_type}, {SCORED}")


def transition_counts(scored: DataFrame) -> np.ndarray:
    """Counts of class transitions over all training texts: a matrix of fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STATES ** 2, np.int64)
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32).reshape(-1, 2)
            total += np.bincount(pairs[:, 0], weights=pairs[:, 1], minlength=STATES ** 2).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "n"])

    rows = scored.where("not held").select("codes").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(STATES ** 2)
    out[rows["at"].to_numpy(int)] = rows["n"].to_numpy(float)
    return out.reshape(STATES, STATES)


def transition_logs(counts: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log10 of the smoothed transition probabilities, with the mass of unknown words as a state of its own.

    Rows are the states before. A row is smoothed by the class frequencies. Every word's discount goes to
    the unknown word, so that words of all classes, the unknown word and the end sum to one after any state.
    """
    freq = np.append(sizes, kinds[-1]).astype(float)             # classes, end
    known = np.delete(counts, UNKNOWN, axis=1)
    total = freq.sum()
    if not total:
        return np.zeros((STATES, STATES))
    share = freq / total
    p = (known + BACKOFF * share) / (known.sum(axis=1, keepdims=True) + BACKOFF)
    left = np.where(sizes > 0, DISCOUNT * kinds[:-1] / np.maximum(sizes, 1), 0.0)       # discounted share of each class
    unknown = p[:, :-1] @ left
    if not left.any():                                           # no words to discount: one count for the unknown word
        p, unknown = p * total / (total + 1), np.full(STATES, 1 / (total + 1))
    with np.errstate(divide="ignore"):
        return np.log10(np.insert(p, UNKNOWN, unknown, axis=1))


def score_documents(docs: DataFrame, held: Callable[[str], bool], key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of every whole text.

    Learned from the texts whose key is not held out. Tokens are words (runs without ASCII white space, A-Z in
    lower case) and one end; NULL and empty texts are the end alone. ``base_score`` is the add-one unigram model's,
    ``score`` the class model's; both give probability to the known words, one unknown word and the end.
    Repeated rows and NULL keys are scored one by one; an empty table gives no rows. If there is nothing to learn
    from, every token is unknown and the score is 0.
    """
    rows = docs.select(docs[key].alias("key"), docs[column].alias("text"))
    table = stored(chunks(rows, held), "chunks")
    # The hash 0 stands for the end of a text; no word is known to have it.
    sums = per_chunk(table.select("chunk", "counts"), lambda c, _: {
        "tokens": c.counts.sum(keepdims=True, dtype=np.int64), "ends": c.counts[:1].astype(np.int64)}, "tokens long, ends long")
    total, ends = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("ends"), F.lit(0))).first()

    top = most_frequent(table, total)
    by_rank = np.array([r.word for r in top], np.int64).view(np.uint64)
    order = np.argsort(by_rank)
    core = by_rank[order]
    bigrams = core_bigrams(table, core)
    ranked = np.append(np.argsort(order), [len(core), len(core) + 1])          # place in core of each rank
    found = exchange(bigrams[np.ix_(ranked, ranked)], CLASSES)
    classes = found[order] if len(core) else found                             # by place in core
    contexts = np.concatenate([classes, [RARE, END]]).astype(np.int64)
    member = np.eye(CONTEXTS)[contexts]
    between = member.T @ bigrams @ member
    with_class = np.log(between[:, :CLASSES] + 0.5) - np.log(between[:, :CLASSES].sum(axis=0) + 0.5 * CONTEXTS)
    then_class = np.log(between[:CLASSES] + 0.5) - np.log(between[:CLASSES].sum(axis=1, keepdims=True) + 0.5 * CONTEXTS)
    gains = (with_class[:, None, :] + then_class.T[None, :, :]).reshape(CONTEXTS ** 2, CLASSES)
    rare = assign_rare(rare_contexts(table, core, contexts), gains)
    spark = docs.sparkSession
    exact = bigrams.sum(axis=0)                                                # occurrences of each core word, by place
    listed = [(r.word, int(exact[p]), int(classes[p])) for r, p in zip(top, ranked.tolist())]
    lexicon = stored(rare.union(spark.createDataFrame(listed, "word long, n long, class int")), "lexicon")
    distinct = lexicon.count() + (ends > 0)
    stats = {r["class"]: r for r in lexicon.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    sizes = np.array([stats[c].n if c in stats else 0 for c in range(CLASSES)], np.int64)
    kinds = np.array([stats[c].words if c in stats else 0 for c in range(CLASSES)] + [ends], np.int64)
    scored = stored(score_chunks(table, lexicon, sizes, kinds, total, distinct), "scored")
    logs = transition_logs(transition_counts(scored), sizes, kinds).ravel()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                blobs = part.column(1).to_pylist()
                sums = [float(logs[(p := np.frombuffer(b, np.int32).reshape(-1, 2))[:, 0]] @ p[:, 1]) for b in blobs]
                scores = np.array(sums) + part.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), *part.columns[3:]],
                                                 ["key", "score", "held", "n_tokens", "n_known", "base"])

    kind = docs.schema[key].dataType.simpleString()
    done = scored.select("key", "codes", "emission", "held", "n_tokens", "n_known", "base").mapInArrow(
        finish, f"key {kind}, score double, held boolean, n_tokens long, n_known long, base double")
    return done.select(
        F.col("key").alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score")


def crc_held(modulus: int, value: int) -> Callable[[object], bool]:
    """Holds out the keys whose crc32 as text leaves ``value``; NULL counts as empty text."""
    return lambda key: zlib.crc32(str("" if key is None else key).encode()) % modulus == value
