"""Edit-aware token counts: a segment tree of pre-tokens per document, updated around edits only."""
from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from quiremill.llm.common import arrow_map

BLOCK = 64                   # pieces in a leaf of the tree
CACHE_PIECES = 400_000       # distinct pieces whose token counts a task keeps

# White space as the vocabulary's library knows it: U+001C to U+001F are none.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = PATTERN.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")

#: A piece ends where its next character ends it, or one before (white space in front of a word).
CONTEXT = 2

EDITS = "array<struct<start:int,length:int,replacement:string>>"


class PieceCounter:
    """Token counts of pieces under a byte-level vocabulary in tiktoken's format."""

    def __init__(self, ranks: bytes) -> None:
        table = {base64.b64decode(t): int(n) for t, n in map(bytes.split, ranks.splitlines()) if t}
        self.encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(_CUT)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        """Tokens of one piece; alone, a piece is cut no further."""
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def pieces(self, text: str, start: int = 0) -> Iterator[str]:
        return (m.group() for m in self.pattern.finditer(text, start))


class TokenTree:
    """Leaves hold the lengths and token counts of consecutive pieces; a heap holds the sums above them."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray) -> None:
        self.leaves = [(lengths[i:i + BLOCK], counts[i:i + BLOCK]) for i in range(0, len(lengths), BLOCK)]
        self._raise()

    @classmethod
    def of(cls, text: str, counter: PieceCounter) -> TokenTree:
        pieces = counter.pattern.findall(text)
        known, count = counter.known.get, counter.count
        counts = [n if (n := known(p)) is not None else count(p) for p in pieces]
        return cls(np.fromiter(map(len, pieces), np.int32, len(pieces)), np.array(counts, np.int32))

    @classmethod
    def unpack(cls, blob: bytes) -> TokenTree:
        return cls(*np.frombuffer(blob, np.int32).reshape(2, -1))

    def pack(self) -> bytes:
        return np.concatenate([np.concatenate([leaf[k] for leaf in self.leaves] or [np.zeros(0, np.int32)]) for k in (0, 1)]).tobytes()

    def _raise(self) -> None:
        """All sums anew: after the number of leaves has changed."""
        self.width = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.width), np.int64)
        for i, leaf in enumerate(self.leaves):
            self.sums[:, self.width + i] = leaf[0].sum(), leaf[1].sum()
        level = self.width
        while level > 1:
            self.sums[:, level // 2:level] = self.sums[:, level:2 * level:2] + self.sums[:, level + 1:2 * level:2]
            level //= 2

    def _update(self, leaf: int) -> None:
        """The sums on the path from one leaf to the root."""
        at = self.width + leaf
        self.sums[:, at] = self.leaves[leaf][0].sum(), self.leaves[leaf][1].sum()
        while at > 1:
            at //= 2
            self.sums[:, at] = self.sums[:, 2 * at] + self.sums[:, 2 * at + 1]

    @property
    def chars(self) -> int:
        return int(self.sums[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def pieces(self) -> int:
        return sum(len(leaf[0]) for leaf in self.leaves)

    def find(self, position: int) -> tuple[int, int, int]:
        """(leaf, piece in it, first character) of the last piece that starts at or before a position."""
        at, first = 1, 0
        while at < self.width:
            at *= 2
            if position - first >= self.sums[0, at] and self.sums[0, at + 1]:
                first += int(self.sums[0, at])
                at += 1
        leaf = at - self.width
        ends = np.cumsum(self.leaves[leaf][0])
        piece = min(int(np.searchsorted(ends, position - first, side="right")), len(ends) - 1)
        return leaf, piece, first + (int(ends[piece - 1]) if piece else 0)

    def edit(self, text: str, start: int, length: int, replacement: str, counter: PieceCounter) -> tuple[str, int]:
        """Apply an edit to the tree; (the new text, the number of pieces that were encoded for it).

        Pieces that end ``CONTEXT`` characters before the edit stay. From there the new text is cut until a
        cut behind the edit falls on an old one; from a common cut on, both texts are cut alike.
        """
        start = min(max(start, 0), len(text))
        stop = min(start + max(length, 0), len(text))
        new = text[:start] + replacement + text[stop:]
        if not self.leaves:
            fresh = TokenTree.of(new, counter)
            self.leaves = fresh.leaves
            self._raise()
            return new, self.pieces
        shift = len(replacement) - (stop - start)
        leaf, piece, cut = self.find(max(0, start - CONTEXT))
        last_leaf, last_piece, old = leaf, piece, cut               # the first old piece that stays behind the edit
        lengths, counts, at, met = [], [], cut, False
        for m in counter.pattern.finditer(new, cut):
            at = m.end()
            lengths.append(at - m.start())
            counts.append(counter.count(m.group()))
            while last_leaf < len(self.leaves) and (old < stop or old + shift < at):
                old += int(self.leaves[last_leaf][0][last_piece])
                last_piece += 1
                if last_piece == len(self.leaves[last_leaf][0]):
                    last_leaf, last_piece = last_leaf + 1, 0
            if at >= start + len(replacement) and old >= stop and old + shift == at:
                met = True
                break
        if not met:                                                  # the new text is cut to its end
            last_leaf, last_piece = len(self.leaves), 0
        head, tail = self.leaves[leaf], self.leaves[last_leaf] if last_leaf < len(self.leaves) else None
        parts = [np.concatenate([head[k][:piece], np.array(added, np.int32), tail[k][last_piece:] if tail else np.zeros(0, np.int32)])
                 for k, added in ((0, lengths), (1, counts))]
        if last_leaf == leaf and 0 < len(parts[0]) <= 2 * BLOCK:
            self.leaves[leaf] = (parts[0], parts[1])
            self._update(leaf)
        else:
            self.leaves[leaf:last_leaf + 1] = [(parts[0][i:i + BLOCK], parts[1][i:i + BLOCK]) for i in range(0, len(parts[0]), BLOCK)]
            self._raise()
        return new, len(lengths)


def _shared_counter(docs: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())       # one file of fixed size
    return lambda: PieceCounter(ranks.value)


def build_trees(docs: DataFrame, vocabulary: str, column: str = "text") -> DataFrame:
    """The rows with columns ``tree`` (the packed tree of the whole text) and ``n_tokens``; NULL counts as empty.

    The table may be stored, and edits applied to it later by ``apply_edits``.
    """
    counter = _shared_counter(docs, vocabulary)
    at = docs.columns.index(column)

    def make():
        own = counter()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            trees = [TokenTree.of(t.as_py() or "", own) for t in batch.column(at)]
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([t.pack() for t in trees], pa.binary()), pa.array([t.tokens for t in trees], pa.int64())],
                [*batch.schema.names, "tree", "n_tokens"])
        return work

    return arrow_map(docs, make, StructType(docs.schema.fields[:]).add("tree", BinaryType()).add("n_tokens", LongType()))


def apply_edits(rows: DataFrame, vocabulary: str, column: str = "text", edits: str = "edits") -> DataFrame:
    """Rows of ``build_trees`` with a column of edits (start, length, replacement), brought up to date.

    Edits are applied in order, each to the text that the one before left; start and length are clipped to the
    text, NULL edits and fields change nothing. ``text`` and ``tree`` become the edited ones; added are
    ``n_tokens_edited``, ``n_pieces`` (after the edits) and ``n_reencoded`` (pieces encoded for the edits).
    """
    counter = _shared_counter(rows, vocabulary)
    names = rows.columns

    def make():
        own = counter()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, trees, tokens, pieces, encoded = [], [], [], [], []
            for text, blob, changes in zip(batch.column(names.index(column)), batch.column(names.index("tree")), batch.column(names.index(edits))):
                before = text.as_py()
                text, tree, n = before or "", TokenTree.unpack(blob.as_py()), 0
                for e in changes.as_py() or ():
                    if e is not None:
                        text, m = tree.edit(text, e["start"] or 0, e["length"] or 0, e["replacement"] or "", own)
                        n += m
                texts.append(None if before is None and not text else text)
                trees.append(tree.pack())
                tokens.append(tree.tokens)
                pieces.append(tree.pieces)
                encoded.append(n)
            new = {column: pa.array(texts, pa.string()), "tree": pa.array(trees, pa.binary())}
            return pa.RecordBatch.from_arrays(
                [*[new.get(c, batch.column(i)) for i, c in enumerate(names)], pa.array(tokens, pa.int64()),
                 pa.array(pieces, pa.int32()), pa.array(encoded, pa.int32())], [*names, "n_tokens_edited", "n_pieces", "n_reencoded"])
        return work

    schema = StructType(rows.schema.fields[:]).add("n_tokens_edited", LongType()).add("n_pieces", IntegerType()).add("n_reencoded", IntegerType())
    return arrow_map(rows, make, schema)


def with_edits(rows: DataFrame, edits: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """The rows of ``build_trees`` with their edits (key, seq, start, length, replacement) gathered in order."""
    gathered = edits.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct(order, "start", "length", "replacement"))).alias("_e"))
    joined = rows.join(gathered, rows[key].eqNullSafe(gathered["_key"]), "left")
    return joined.select(*rows.columns, F.transform(
        "_e", lambda e: F.struct(*[e[c].alias(c) for c in ("start", "length", "replacement")])).cast(EDITS).alias("edits"))
