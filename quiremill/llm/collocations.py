"""Phrase collocations: candidates that a hashed filter cannot lose, counted by double-array tries over all text positions."""
from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.llm.common import in_batches, stored
from quiremill.session import written

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"      # end a piece
NO_LANG = "und"
MAP_BITS = 26                # bits of a filter of words or phrases, as a power of two: 8 MB
POOL = 1 << 19               # text positions that are numbered together
FILE_CHUNKS = 8              # chunks of a stored file, which a task may decode as a whole
TASKS_PER_CORE = 3           # where each task passes on every word or candidate it meets, more tasks would move more rows
CELLS = 1 << 21              # phrases that a task counts by hash before it passes them on
HELD_WORDS = 500_000         # different words whose counts a task holds
TRIE_PHRASES = 1 << 18       # candidates of one trie
TRIES_AT_ONCE = 6            # tries that are broadcast for one pass over the text
UNIT = 1024                  # a word's number is read by a trie as two units below this
SPLIT = 64                   # first ranks are taken in so many parts of a language

_FOLD = bytes(10 if c in BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, ``\\n`` at the end of a piece; some are empty."""
    return text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")


def _lang_seed(lang: bytes) -> int:
    return xxhash.xxh64_intdigest(lang, 42)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    lang, text = (batch.column(i).cast(pa.binary()) for i in (0, 1))
    for i in range(batch.num_rows):
        yield lang[i].as_py(), text[i].as_py()


# --- words and chunks ---------------------------------------------------------------------

def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of the texts a task reads, in bounded parts; the empty word stands for all words of the language."""
    held: dict[bytes, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(b"", None)
            counts.pop(b"\n", None)
            counts[b""] = counts.total()
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang.decode()] * len(words)), words, pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
        held.clear()

    for batch in batches:
        for lang, text in _texts(batch):
            held[lang].update(tokens(text))
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from flush()
    yield from flush()


class _Codes(dict):
    """Numbers of the words of one chunk and language; 0 for a word that the filter drops, -1 for no word."""

    def __init__(self, seed: int, hashes: list[int], bits: np.ndarray):
        super().__init__({b"": -1, b"\n": 0})
        self.seed, self.hashes, self.bits = seed, hashes, bits

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        at = h & (1 << MAP_BITS) - 1
        self[word] = code = len(self.hashes) if int(self.bits[at >> 6]) >> (at & 63) & 1 else 0
        if code:
            self.hashes.append(h)
        return code


def _chunks(bits: np.ndarray, spark):
    """Rows (words, codes): a chunk of whole texts as packed numbers into its own list of word hashes; 0 breaks phrases."""
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes, parts, size = {}, [0], [], 0

        def flush() -> pa.RecordBatch:
            codes = np.concatenate(parts)
            codes = codes[codes >= 0]
            codes = codes[(codes > 0) | np.concatenate([[False], codes[:-1] > 0])]        # one break is enough
            words = np.array(hashes, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array([words.tobytes()], pa.binary()), pa.array([_packed(codes)], pa.binary())], ["words", "codes"])

        for batch in batches:
            for lang, text in _texts(batch):
                code = known.get(lang)
                if code is None:
                    code = known[lang] = _Codes(_lang_seed(lang), hashes, shared.value)
                found = tokens(text)
                found.append(b"\n")
                parts.append(np.fromiter(map(code.__getitem__, found), np.int32, len(found)))
                size += len(found)
                if size >= POOL:
                    yield flush()
                    known, hashes, parts, size = {}, [0], [], 0
        if parts:
            yield flush()
    return run


def _packed(codes: np.ndarray) -> bytes:
    """Numbers with the first bytes of all before the second bytes, which are stored in less room."""
    return np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        words, codes = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            yield np.frombuffer(words[i].as_buffer(), np.uint64), _unpacked(codes[i].as_buffer())
        batch = words = codes = None
        pa.default_memory_pool().release_unused()


# --- the filter ---------------------------------------------------------------------------

def bit_map(df: DataFrame, column: str) -> np.ndarray:
    """The low bits of hashes as a bit map of fixed size; at most 2**(MAP_BITS - 6) words of it reach the driver."""
    at = F.col(column).bitwiseAND((1 << MAP_BITS) - 1)
    rows = df.select(at.alias("at")).selectExpr("shiftright(at, 6) AS slot", "shiftleft(1L, CAST(at & 63 AS INT)) AS bit")
    found = rows.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << MAP_BITS - 6, np.int64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64((1 << MAP_BITS) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def phrase_hash(front: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its words but the last, and the last word's."""
    x = front * np.uint64(0x9E3779B97F4A7C15) ^ (word + (front >> np.uint64(29)))
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _windows(words: np.ndarray, codes: np.ndarray, size: int, maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all phrases of ``size`` words whose shorter parts the maps hold (of 2 words, 3 words, ...)."""
    live = codes > 0
    hashes = words[codes]
    for k in range(2, size + 1):
        both = live[:-1] & live[1:]                       # the first and the last k - 1 words
        at = np.flatnonzero(both)
        found = phrase_hash(hashes[at], words[codes[at + k - 1]])
        if k == size:
            return at, found
        keep = _held(maps[k - 2], found)
        at, found = at[keep], found[keep]
        live, hashes = np.zeros(len(both), bool), np.zeros(len(both), np.uint64)
        live[at], hashes[at] = True, found
    raise ValueError("a phrase has two words at least")


def _cells(size: int, maps, bits: int):
    """(cell, n): phrases that may be frequent, counted by some bits of their hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            cells, n = np.unique(np.concatenate(parts) & np.uint64((1 << bits) - 1), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(n, pa.int64())], ["cell", "n"])

        for words, codes in _each_chunk(batches):
            parts.append(_windows(words, codes, size, maps.value)[1])
            held += len(parts[-1])
            if held >= CELLS:
                yield flush()
                parts, held = [], 0
        if parts:
            yield flush()
    return run


def _names(size: int) -> list[str]:
    return [f"w{i}" for i in range(1, size + 1)]


def _safe(words: np.ndarray, codes: np.ndarray, size: int, maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the phrases that every map holds, the last one made for this size."""
    at, found = _windows(words, codes, size, maps)
    keep = _held(maps[size - 2], found)
    return at[keep], found[keep]


def _candidates(size: int, maps):
    """(w1, ..., h): the different phrases of a chunk that every map holds, with what deals them to blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, codes in _each_chunk(batches):
            at, found = _safe(words, codes, size, maps.value)
            found, first = np.unique(found, return_index=True)
            at = at[first]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(words[codes[at + i]].view(np.int64)) for i in range(size)), pa.array(_deal(found))], [*_names(size), "h"])
    return run


def _deal(found: np.ndarray) -> np.ndarray:
    """The bits of phrases' hashes by which they are dealt to blocks."""
    return (found >> np.uint64(40)).astype(np.int32)


# --- tries --------------------------------------------------------------------------------

def _bases_wide(nodes: list[np.ndarray], free: np.ndarray, first: int, rng: np.random.Generator) -> list[int]:
    """A base for every node, one after the other: of many next to a random one, the first at which all its units fall on free places."""
    span, out = np.arange(512), []
    for units in nodes:
        while True:
            at = int(rng.integers(first, len(free) - UNIT - len(span)))
            fits = free[at + units[0] + span]
            for u in units[1:].tolist():
                fits &= free[at + u + span]
            if fits.any():
                break
        at += int(fits.argmax())
        free[at + units] = False
        out.append(at)
    return out


def _bases_narrow(units: np.ndarray, free: np.ndarray, first: int, rng: np.random.Generator) -> np.ndarray:
    """A base for every node of the same few units: all try a random one at once, those that meet no other keep it."""
    out, left = np.zeros(len(units), np.int64), np.arange(len(units))
    owner = np.full(len(free), -1, np.int64)
    while len(left):
        base = rng.integers(first, len(free) - UNIT, len(left))
        places = base[:, None] + units[left]
        fits = np.flatnonzero(free[places].all(axis=1))
        owner[places[fits]] = fits[:, None]
        fits = fits[(owner[places[fits]] == fits[:, None]).all(axis=1)]
        free[places[fits]] = False
        out[left[fits]] = base[fits]
        left = np.delete(left, fits)
    return out


def build_trie(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, ends) of a double-array trie over distinct rows of units below ``UNIT``.

    From state s, unit u leads to t = base[s] + u if check[t] = s. State 0 is the root; ``ends`` has each row's last state.
    Nodes with several children are placed in a region of their level that stays mostly free, the widest first; a lone child then
    takes any free place.
    """
    rng = np.random.default_rng(0)
    state, free = np.zeros(len(units), np.int64), np.zeros(1, bool)
    edges_of = []
    for level in range(units.shape[1]):
        edges, back = np.unique(state * UNIT + units[:, level], return_inverse=True)
        parent, unit = edges // UNIT, edges % UNIT
        starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        sizes = np.diff(np.append(starts, len(edges)))
        base = np.zeros(len(starts), np.int64)
        first = len(free)
        free = np.concatenate([free, np.ones(4 * int(sizes[sizes > 1].sum()) + 4 * UNIT, bool)])
        wide = np.flatnonzero(sizes > 16)
        wide = wide[np.argsort(-sizes[wide], kind="stable")]
        base[wide] = _bases_wide([unit[starts[i]:starts[i] + sizes[i]] for i in wide.tolist()], free, first, rng)
        for size in range(16, 1, -1):
            some = np.flatnonzero(sizes == size)
            base[some] = _bases_narrow(unit[starts[some][:, None] + np.arange(size)], free, first, rng)
        lone = np.flatnonzero(sizes == 1)
        spare = np.flatnonzero(free[UNIT:])[:len(lone)] + UNIT
        if len(spare) < len(lone):
            more = len(lone) - len(spare)
            spare = np.concatenate([spare, np.arange(len(free), len(free) + more)])
            free = np.concatenate([free, np.ones(more, bool)])
        base[lone] = spare - unit[starts[lone]]
        free[spare] = False
        target = np.repeat(base, sizes) + unit
        edges_of.append((parent[starts], base, target, parent))
        state = target[back.ravel()]
    used = int(np.flatnonzero(~free)[-1]) + 1
    bases, check = np.zeros(used, np.int32), np.full(used + UNIT, -1, np.int32)
    for nodes, base, target, parent in edges_of:
        bases[nodes], check[target] = base, parent
    return bases, check, state


def _tries(size: int):
    """One row a block: the trie of its candidates with its list of words, and the last state of each candidate."""
    def build(block: pa.Table) -> pa.Table:
        rows = np.stack([block[n].to_numpy() for n in _names(size)], axis=1)
        words, number = np.unique(rows, return_inverse=True)
        number = number.reshape(rows.shape)
        units = np.stack([number // UNIT, number % UNIT], axis=2).reshape(len(rows), -1)
        base, check, ends = build_trie(units)
        packed = [x.tobytes() for x in (words, base, check, ends.astype(np.int32), np.ascontiguousarray(rows))]
        return pa.table({"block": pa.array([block["block"][0].as_py()], pa.int32()),
                         **{n: pa.array([x], pa.binary()) for n, x in zip(("words", "base", "check", "ends", "rows"), packed)}})
    return build


def _walk(trie: tuple[np.ndarray, np.ndarray, np.ndarray], words: np.ndarray, codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Last states of the phrases at some positions that the trie holds: every position advances at once, one unit after the other."""
    known, base, check = trie
    asked = np.zeros(len(words), bool)
    for k in range(size):
        asked[codes[at + k]] = True
    asked[0] = False                                      # a break
    asked = np.flatnonzero(asked)
    wanted = words[asked].view(np.int64)
    place = np.searchsorted(known, wanted)
    place[place == len(known)] = 0
    number = np.full(len(words), -1, np.int32)
    number[asked] = np.where(known[place] == wanted, place, -1)
    state = np.zeros(len(at), np.int32)
    for k in range(size):
        now = number[codes[at + k]]
        live = now >= 0
        at, state, now = at[live], state[live], now[live]
        for high in (True, False):
            to = base[state] + (now // UNIT if high else now % UNIT)
            live = check[to] == state
            at, state, now = at[live], to[live], now[live]
    return state


def _occurrences(tries, size: int, maps, blocks: int):
    """(block, state, n): how often each accepting state is reached in the chunks that a task reads.

    A position can only hold a candidate where the maps hold its phrase, and then one of the block its hash is dealt to, as
    the candidates are: so it is walked in one trie, however many there are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {block: np.zeros(len(trie[2]), np.int64) for block, trie in tries.value.items()}
        for words, codes in _each_chunk(batches):
            at, found = _safe(words, codes, size, maps.value)
            mine = _deal(found) % blocks
            for block, trie in tries.value.items():
                np.add.at(sums[block], _walk(trie, words, codes, at[mine == block], size), 1)
        for block, n in sums.items():
            where = np.flatnonzero(n)
            for i in range(0, len(where), POOL):
                part = where[i:i + POOL]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), block, np.int32)), pa.array(part, pa.int32()), pa.array(n[part])], ["block", "state", "n"])
    return run


def _ends(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ends, rows in zip(*(batch.column(i).to_pylist() for i in range(3))):
                state, rows = np.frombuffer(ends, np.int32), np.frombuffer(rows, np.int64).reshape(-1, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(state), block, np.int32)), pa.array(state), *(pa.array(rows[:, i].copy()) for i in range(size))],
                    ["block", "state", *_names(size)])
    return run


def _counted(chunks: DataFrame, candidates: DataFrame, size: int, least: int, maps) -> DataFrame:
    """(w1, ..., a): the candidates with ``least`` occurrences or more, counted by tries of bounded size, some at a time."""
    spark, names = chunks.sparkSession, _names(size)
    blocks = -(-candidates.count() // TRIE_PHRASES) or 1
    kind = "block int, words binary, base binary, check binary, ends binary, rows binary"
    dealt = candidates.select(F.pmod("h", F.lit(blocks)).cast("int").alias("block"), *names)
    tries = stored(dealt.groupBy("block").applyInArrow(_tries(size), kind), "tries")
    found = None
    for at in range(0, blocks, TRIES_AT_ONCE):
        some = tries.where(F.col("block").between(at, at + TRIES_AT_ONCE - 1)).select("block", "words", "base", "check").toArrow()
        arrays = {b: (np.frombuffer(w, np.int64), np.frombuffer(x, np.int32), np.frombuffer(c, np.int32))
                  for b, w, x, c in zip(*(some[n].to_pylist() for n in ("block", "words", "base", "check")))}
        shared = spark.sparkContext.broadcast(arrays)     # at most TRIES_AT_ONCE tries of TRIE_PHRASES candidates
        part = written(in_batches(chunks, _occurrences(shared, size, maps, blocks), "block int, state int, n long")
                       .groupBy("block", "state").agg(F.sum("n").alias("a")).where(F.col("a") >= least), "occurrences")
        shared.unpersist()
        found = part if found is None else found.union(part)
    ends = in_batches(tries.select("block", "ends", "rows"), _ends(size), "block int, state int, " + ", ".join(f"{n} long" for n in names))
    return written(found.join(ends, ["block", "state"]).select(*names, "a"), f"phrases_{size}")


# --- phrases ------------------------------------------------------------------------------

def frequent_phrases(docs: DataFrame, least: int = 10, longest: int = 3, text: str = "text",
                     lang: str = "lang") -> tuple[DataFrame, dict[int, DataFrame]]:
    """(words, phrases): words (lang, word, h, n) and, by size, phrases (w1, ..., a) of hashed words, all with ``least`` or more.

    The row of the empty word has the number of all words of the language. A phrase can only be as frequent as its parts,
    so those of size k are looked for where their parts of size k - 1 are frequent: they are first counted by hashes, where none can be
    missed; the different phrases at the hashes that reach ``least`` are the candidates, which tries count in the text. What is
    broadcast has a fixed size: bit maps of hashes, and tries of so many candidates. Words of a language travel as 64-bit hashes.
    Texts, and chunks as packed bytes, go to workers in small batches.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(docs[text], F.lit("")).alias("text"))
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    counts = in_batches(rows.coalesce(tasks), _count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(counts.where((F.col("n") >= least) | (F.col("word") == "")).select("lang", "word", F.xxhash64("lang", "word").alias("h"), "n"), "words")
    chunks = in_batches(rows, _chunks(bit_map(words.where("word <> ''"), "h"), spark), "words binary, codes binary")
    chunks = stored(chunks, "chunks", maxRecordsPerFile=FILE_CHUNKS)
    few = chunks.coalesce(tasks)
    total = words.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(MAP_BITS, min(64, int(total).bit_length() + 4))           # far more cells than phrases, at any size
    maps, phrases = [], {}
    for size in range(2, longest + 1):
        names = _names(size)
        cells = in_batches(chunks, _cells(size, spark.sparkContext.broadcast(list(maps)), bits), "cell long, n long")
        cells = cells.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        maps.append(bit_map(cells, "cell"))
        shared = spark.sparkContext.broadcast(list(maps))
        found = in_batches(few, _candidates(size, shared), ", ".join(f"{n} long" for n in names) + ", h int")
        phrases[size] = _counted(few, written(found.distinct(), "candidates"), size, least, shared)
    return words, phrases


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    wide = [F.col(c).cast("decimal(19,0)") for c in (a, l, r)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide[0] * wide[0], wide[1] * wide[2])


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, inside: int = 50, top: int = 2000, text: str = "text",
                 lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language whose words belong together.

    Words are runs without blanks and tabs, A-Z in lower case, within pieces that end at ``.,;:!?`` and line ends. A candidate is a phrase of
    2 to ``longest`` words with ``least`` occurrences (a) or more, overlapping ones included. It is cut in two where the score
    floor(1000000 * a * a / (l * r)) is lowest, at the first such place; l and r count the parts, n all words of the language.
    Candidates inside a longer one that has ``inside`` percent of their occurrences go. Order: score, occurrences (both falling), phrase in
    byte order. Counts and scores are exact. A NULL language is ``und``; NULL and empty texts have no word, and an empty
    table gives no row. Repeated rows count again. Other columns are ignored.
    """
    words, phrases = frequent_phrases(docs, least, longest, text, lang)
    known = words.where("word <> ''")
    totals = words.where("word = ''").select("lang", F.col("n").alias("all"))
    parts = {1: known.select(F.col("h").alias("w1"), F.col("n").alias("a")), **phrases}
    found, covered = None, None
    for size in range(longest, 1, -1):
        names = _names(size)
        rows = phrases[size].join(known.select("lang", F.col("h").alias("w1"), F.col("n").alias("l1")), "w1")
        for k in range(1, size):                          # the counts of the parts of every cut
            left, right = names[:k], names[k:]
            if k > 1:
                rows = rows.join(parts[k].withColumnRenamed("a", f"l{k}"), left)
            rows = rows.join(parts[size - k].select(*(F.col(a).alias(b) for a, b in zip(_names(size - k), right)), F.col("a").alias(f"r{k}")), right)
        cuts = [F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
                for k in range(1, size)]
        rows = rows.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
        if covered is not None:                           # phrases of this size inside others of one word more, with the largest count there
            rows = rows.join(covered, names, "left").where(F.col("within").isNull() | (F.col("within") * 100 < F.col("a") * inside))
        if size > 2:                                      # what is still longer is no more frequent
            ends = [phrases[size].select(*(F.col(a).alias(b) for a, b in zip(part, _names(size - 1))), "a") for part in (names[:-1], names[1:])]
            covered = ends[0].union(ends[1]).groupBy(*_names(size - 1)).agg(F.max("a").alias("within"))
        rows = rows.select("lang", F.array(*names).alias("words"), "a", "cut.l", "cut.r", "cut.score")
        found = rows if found is None else found.union(rows)
    # Only phrases that the ties at the end of the ranks leave open need their words to be told apart.
    best = [F.desc("score"), F.desc("a")]
    found = found.withColumn("rank", F.rank().over(Window.partitionBy("lang", F.pmod(F.xxhash64("words"), F.lit(SPLIT))).orderBy(*best))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    found = written(found.drop("rank"), "ranked")
    for i in range(longest):
        found = found.withColumn("h", F.get("words", F.lit(i))).join(known.select("h", F.col("word").alias(f"t{i}")), "h", "left").drop("h")
    found = found.withColumn("phrase", F.concat_ws(" ", *(f"t{i}" for i in range(longest))))
    order = [*best, F.asc("phrase")]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return found.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("all").alias("n"), "score")
