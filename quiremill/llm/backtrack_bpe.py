"""Byte-pair encoding by longest matches with backtracking, decoding by offsets.

An Aho-Corasick automaton gives the longest vocabulary entry at every position of a word.
An entry is taken when it may stand beside the previous one: a pair is compatible when
merging in rank order would never join characters across their border. If no entry fits,
the previous one is shortened. Every border is rejected at most once, so a word takes linear time,
and the result equals that of merging pairs in rank order.
"""
from __future__ import annotations

import json
import unicodedata
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from quiremill.llm.common import arrow_map

END = "\x00"               # stands for the end of a word inside entries
CACHE_WORDS = 120_000      # words whose ids a task keeps, and as many of the time before
CACHE_PAIRS = 1 << 17      # pairs of entries whose fit a task keeps

# White space as the vocabulary's normaliser knows it: U+001C to U+001F are none.
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_NO_SPACE = regex.compile(r"[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    chars = dict(zip(shown, map(chr, shown))) | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary with word ends (JSON of the tokenizers library)."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model, suffix = data["model"], data["model"]["end_of_word_suffix"]
        known = model["vocab"]
        plain = lambda t: t[:-len(suffix)] + END if t.endswith(suffix) else t
        self.ids = {plain(t): i for t, i in known.items()}
        self.parts: dict[int, tuple[int, int]] = {}        # id -> the pair it is merged from
        self.merged: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (known[a], known[b]), known[a + b]
            self.merged[pair] = whole
            self.parts[whole] = pair
        self.rank = {i: n for n, i in enumerate(self.merged.values(), 1)}
        self.length = {i: len(t) for t, i in self.ids.items()}
        self.shorter: dict[int, int] = {}                   # id -> the longest entry that is a proper prefix
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (len(t), i))
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in self.ids:
                    self.shorter[i] = self.ids[t[:n]]
                    break
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.piece = regex.compile(split)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        by_id = {i: t for t, i in known.items()} | {i: t for t, i in self.special.items()}
        entries = [(by_id.get(i, "") + " ").encode() for i in range(max(by_id, default=-1) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(entries), np.uint8)

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two neighbouring entries.

        Both entries are undone towards the border, the later merge first. A merge across the
        border wins if its rank is before all merges undone so far; of equal ranks the left one comes first.
        """
        known = self.compatible.get((left, right))
        if known is not None:
            return known
        a, b, good = left, right, True
        bound = float("inf")            # merges across the border count up to here
        while good:
            across = self.merged.get((a, b))
            if across is not None and self.rank[across] < bound:
                good = False
                break
            ra, rb = self.rank.get(a, 0), self.rank.get(b, 0)
            if not ra and not rb:
                break
            if ra > rb:
                a, bound = self.parts[a][1], ra
            else:                       # at equal rank the entry on the left is merged first
                b, bound = self.parts[b][0], rb + 0.5
        if len(self.compatible) >= CACHE_PAIRS:
            self.compatible.clear()
        self.compatible[left, right] = good
        return good

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        text = "".join([self.alphabet[b] for b in piece.encode("utf-8", "surrogatepass")]) + END
        size = len(text)
        longest: list[int | None] = [None] * (size + 1)
        for end, (length, i) in self.automaton.iter(text):
            longest[end - length + 1] = i           # ends ascend, so the last one is the longest
        dead = bytearray(size + 1)
        out: list[int] = []
        at, entry = 0, longest[0]
        while at < size:
            while entry is not None:
                end = at + self.length[entry]
                if not dead[end] and (end == size or longest[end] is not None) and (not out or self.fits(out[-1], entry)):
                    break
                entry = self.shorter.get(entry)
            if entry is None:
                dead[at] = 1
                if not out:
                    raise ValueError(f"no encoding for {piece!r}")
                entry = out.pop()
                at -= self.length[entry]
            else:
                out.append(entry)
                at = end
                entry = longest[at]
        return out

    def _keep(self, word: str, found: bytes) -> bytes:
        if len(self.cache) >= CACHE_WORDS:      # words that still occur move on from the older half
            self.older, self.cache = self.cache, {}
        self.cache[word] = found
        return found

    def _word(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            pieces = self.piece.findall(word)
            found = self._piece(word) if pieces == [word] else b"".join(map(self._piece, pieces))
        return self._keep(word, found)

    def _piece(self, piece: str) -> bytes:
        found = self.cache.get(piece) or self.older.get(piece)
        if found is None:
            ids = self.encode_piece(piece)
            found = self._keep(piece, pack(f"={len(ids)}i", *ids))
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as packed 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or "<" not in text:
            return self._plain(text)
        return b"".join(
            np.int32(self.special[part]).tobytes() if part in self.special else self._plain(part)
            for part in self.cut.split(text))

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text)
        # A sigma has one lower form here, wherever it stands.
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        words = text.split() if not _NO_SPACE.search(text) else [w for w in _SPACE.split(text) if w]
        cache, make = self.cache, self._word
        return b"".join([cache.get(w) or make(w) for w in words])

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of ids in UTF-8: entries as the vocabulary writes them, joined by spaces."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        sizes = self.offsets[ids + 1] - start
        shift = np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
        return self.blob[shift + np.arange(len(shift))][:-1].tobytes()


DECODE_IDS = 1 << 18       # ids decoded at a time


def encode_documents(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), column: str = "text") -> DataFrame:
    """(the columns in ``keep``, ids array<int>, decoded string): the exact encoding of every whole text.

    ``vocabulary`` is the path of a JSON file of the tokenizers library: byte-level BPE with
    word ends, NFC and lower case. Special tokens in a text become their ids, none are added, and
    ``decoded`` is made from the ids. NULL and empty texts give no ids and an empty string;
    repeated rows are encoded one by one; other columns are not read.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())     # one file of fixed size

    def make():
        bpe = WordBpe(spec.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [bpe.encode(t) for t in batch.column(len(keep)).to_pylist()]
            ids = np.frombuffer(b"".join(packed), np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            decoded = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                blocks = [bpe.decode(ids[i:min(i + DECODE_IDS, b)]) for i in range(a, b, DECODE_IDS)]
                decoded.append(b" ".join(blocks))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            return pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], lists, pa.array(decoded, pa.binary()).cast(pa.string())], [*keep, "ids", "decoded"])
        return work

    rows = docs.select(*keep, docs[column].alias("_text"))
    schema = StructType(rows.schema.fields[:-1]).add("ids", ArrayType(IntegerType())).add("decoded", "string")
    return arrow_map(rows, make, schema)
