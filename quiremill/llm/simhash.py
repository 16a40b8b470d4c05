"""SimHash near-duplicates: fingerprints, blocks by the pigeonhole principle, exact distances."""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiremill.llm.common import arrow_map, ascii_words, in_batches, stored
from quiremill.llm.components import components
from quiremill.session import written

SEED = 42
BLOCK_SHINGLES = 1 << 16     # shingles whose bits are counted at a time
GROUP_ROWS = 1024            # fingerprints of one block key that are compared in one task


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles with repeats, in blocks; a shorter sequence is one shingle."""
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) < size:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[:len(words) - size + 1], ends[size - 1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK_SHINGLES):
        pairs = zip(starts[at:at + BLOCK_SHINGLES].tolist(), ends[at:at + BLOCK_SHINGLES].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def fingerprint(text: str | None, size: int) -> int:
    """A bit is set if it is set in over half of the shingle hashes; no word gives 0."""
    return _majority(shingle_hashes(ascii_words(text), size))


def _majority(blocks: Iterable[np.ndarray]) -> int:
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in blocks:
        total += len(hashes)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big", signed=True) if total else 0


def fingerprints(docs: DataFrame, size: int = 3, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, text_hash, fp long): the 64-bit SimHash of every whole text; NULL counts as empty."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [fingerprint(t.as_py(), size) for t in batch.column(2)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["key", "text_hash", "fp"])
        return work

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), F.xxhash64(docs[column]).alias("text_hash"), docs[column].alias("text"))
    return arrow_map(rows, make, f"key {kind}, text_hash long, fp long")


def submasks(mask: int, blocks: int) -> list[int]:
    """The mask, joined in turn with each of ``blocks`` even parts of the bits that it leaves free."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = [free[len(free) * k // blocks:len(free) * (k + 1) // blocks] for k in range(blocks)]
    return [mask | sum(1 << i for i in part) for part in parts]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _group_links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one group of distinct fingerprints."""
    n = len(values)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= distance)
        for j in (near + i + 1).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                out.append((i, j))
    return out


def _compare(distance: int):
    """Walk rows sorted by (mask, value); groups are bounded, so one is kept at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((3, 0), np.int64)
        for batch in _with_end(batches):
            if batch is None:
                rows, ready = rest, rest.shape[1]
            else:
                new = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64)
                rows = np.concatenate([rest, new], axis=1)
                last = np.flatnonzero((rows[1:, 1:] != rows[1:, :-1]).any(axis=0))
                ready = int(last[-1]) + 1 if len(last) else 0
            if not ready:
                rest = rows
                continue
            fps, keys, rest = rows[0, :ready].view(np.uint64), rows[1:, :ready], rows[:, ready:]
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            sizes = np.diff(np.append(starts, ready))
            left, right = [], []
            for at, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                group = fps[at:at + size]
                for i, j in _group_links(group, distance):
                    left.append(group[i])
                    right.append(group[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (left, right)], ["a", "b"])
    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): edges that connect the distinct fingerprints (column fp) at ``distance`` or fewer bits.

    Of ``distance + 1`` blocks of bits a close pair shares one, so fingerprints meet on (block, value).
    A key with more than ``GROUP_ROWS`` members is not compared: its members meet on
    longer keys, made by cutting the free bits into ``distance + 1`` blocks again. Since the
    fingerprints differ, a key with r free bits has at most 2^r members, so this ends. Within
    a key only a spanning forest of the close pairs is returned; all links stay connected by it.
    """
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in submasks(0, distance + 1)])).alias("mask"))
    found = None
    while True:
        rows = rows.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
        sizes = rows.groupBy("mask", "value").count()
        crowded = written(sizes.where(F.col("count") > GROUP_ROWS).select("mask", "value"), "crowded")
        some = not crowded.isEmpty()
        ready = rows.join(crowded, ["mask", "value"], "left_anti") if some else rows
        ready = ready.select("fp", "mask", "value").repartition("mask", "value").sortWithinPartitions("mask", "value")
        near = ready.mapInArrow(_compare(distance), "a long, b long")
        found = near if found is None else found.union(near)
        if not some:
            return found
        deeper = rows.join(crowded, ["mask", "value"], "left_semi").select("fp", "mask")
        rows = written(arrow_map(deeper, lambda: _deepen(distance + 1), "fp long, mask long").distinct(), "deeper")


def _deepen(blocks: int):
    known: dict[int, list[int]] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, masks = [], []
        for fp, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if mask not in known:
                known[mask] = [_signed(m) for m in submasks(mask & (1 << 64) - 1, blocks)]
            masks += known[mask]
            fps += [fp] * blocks
        return pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(masks, pa.int64())], ["fp", "mask"])
    return work


def _rooted(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, root): every distinct fingerprint of the rows with the smallest one reachable over links."""
    distinct = written(rows.select("fp").distinct(), "distinct_fingerprints")
    roots = components(links(distinct, distance))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 3, key: str = "doc_id",
                    column: str = "text") -> DataFrame:
    """(key, fp, component): every row with its fingerprint and the smallest key reachable over links.

    Words are runs of characters other than ASCII white space, with A-Z in lower case; shingles of ``size`` words
    keep repeats. Rows with equal fingerprints are linked, so only distinct ones are
    compared. NULL and empty texts have fingerprint 0, like any other. Rows with a NULL key are
    kept and never name a component unless all its keys are NULL. Repeated rows stay repeated.
    """
    rows = written(fingerprints(docs, size, key, column), "fingerprints")
    first = rows.groupBy("fp").agg(F.min("key").alias("first"))
    labelled = written(first.join(_rooted(rows, distance), "fp"), "rooted")
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component"))
    named = labelled.join(smallest, "root").select("fp", "component")
    return rows.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


# --- wider similarity --------------------------------------------------------------------

PARTS = 8                    # 64-bit parts of a long fingerprint
DEVIATIONS = 5               # pairs whose bits differ by more deviations than this are not verified
SMALL_SET = 64               # sets with fewer shingles are verified whatever their bits
BROADCAST_NODES = 500_000    # more candidates meet their texts by a shuffle
PACK = 1 << 20               # shingles that a task packs together
BUCKET = 1 << 21             # shingles of a bucket, about: those are counted together
ROWS_OUT = 1 << 17           # rows that leave a task together
SIMHASH_BITS = 3             # differing bits at which the fingerprints of whole sets link
TURNS = (1, None)            # partners that a node is held against in a round: the nearest one, then all others
#: Odd multipliers that make the parts out of one hash of a shingle.
_MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) | 1) & (1 << 64) - 1 for i in range(PARTS)], np.uint64)


def _long_bits(blocks: Iterable[np.ndarray]) -> np.ndarray:
    total, ones = 0, np.zeros((PARTS, 64), np.int64)
    for hashes in blocks:
        total += len(hashes)
        for i, m in enumerate(_MULTIPLIERS):
            x = hashes * m
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            ones[i] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    if not total:
        return np.zeros(PARTS, np.int64)
    return np.packbits(ones * 2 > total, axis=1).view(np.int64).ravel()


def long_fingerprint(words: list[bytes], size: int) -> np.ndarray:
    """A SimHash of ``PARTS`` times 64 bits over word shingles; no word gives zeros."""
    return _long_bits(shingle_hashes(words, size))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The different shingle hashes of a whole text, sorted; no word gives none."""
    found = list(shingle_hashes(ascii_words(text), size))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _blocks(grams: np.ndarray) -> Iterator[np.ndarray]:
    return (grams[at:at + BLOCK_SHINGLES] for at in range(0, len(grams), BLOCK_SHINGLES))


def most_bits(similarity: float, deviations: float = 1) -> int:
    """Differing bits of two long fingerprints whose shingle sets have this Jaccard similarity, and some deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * PARTS
    return int(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def least_shared(size, similarity: float):
    """Shingles that a set of ``size`` shares at least with any set of this Jaccard similarity to it."""
    return np.ceil(size * similarity - 1e-9).astype(np.int64)


def _signatures(docs: DataFrame, size: int, key: str, column: str) -> DataFrame:
    """(key, text_hash, node, size, twins, fp) of every text: ``node`` is a hash of its set of shingles, ``size`` their number.

    ``fp`` is the 64-bit SimHash of the set. ``twins`` are so many of them that others of the text might be taken for them by 32 bits.
    """
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(text.as_py(), size) for text in batch.column(2)]
            nodes = np.array([xxhash.xxh64_intdigest(grams.tobytes()) for grams in sets], np.uint64).view(np.int64)
            twins = [len(g) - len(np.unique(g.astype(np.uint32))) for g in sets]
            fps = [_majority(_blocks(g)) for g in sets]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes), pa.array([len(g) for g in sets], pa.int32()), pa.array(twins, pa.int32()),
                 pa.array(fps, pa.int64())], ["key", "text_hash", "node", "size", "twins", "fp"])
        return work

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), F.xxhash64(docs[column]).alias("text_hash"), docs[column].alias("text"))
    return arrow_map(rows, make, f"key {kind}, text_hash long, node long, size int, twins int, fp long")


def _packed(size: int, buckets: int):
    """(bucket, grams, lengths, nodes): the shingles of many texts by bucket, 32 bits of each, text after text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nodes = np.array(list(held), np.uint64).view(np.int64)
            owner = np.repeat(np.arange(len(held)), [len(g) for g in held.values()])
            grams = np.concatenate(list(held.values()))
            bucket = (grams >> np.uint64(32)) % np.uint64(buckets)
            order = np.lexsort((owner, bucket))
            bucket, owner, grams = bucket[order], owner[order], grams[order].astype(np.uint32)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for at, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
                who, lengths = np.unique(owner[at:stop], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[at])], pa.int64()), pa.array([grams[at:stop].tobytes()], pa.binary()),
                     pa.array([lengths.astype(np.uint32).tobytes()], pa.binary()), pa.array([nodes[who].tobytes()], pa.binary())],
                    ["bucket", "grams", "lengths", "nodes"])

        for batch in batches:
            for text in batch.column(0):
                grams = shingle_set(text.as_py(), size)
                if len(grams):
                    node = xxhash.xxh64_intdigest(grams.tobytes())
                    total += len(grams) if node not in held else 0
                    held[node] = grams
                if total >= PACK:
                    yield from flush()
                    held, total = {}, 0
        if held:
            yield from flush()
    return run


def _shared_of(bucket: int, packs: list[tuple[pa.Buffer, pa.Buffer, pa.Buffer]]) -> Iterator[pa.RecordBatch]:
    """(node, gram, n): the shingles of a bucket that several nodes hold, beside each of them, with the number of holders."""
    names, owner = np.unique(np.concatenate([np.frombuffer(n, np.int64) for _, _, n in packs]), return_inverse=True)
    owner = np.repeat(owner.astype(np.uint32), np.concatenate([np.frombuffer(x, np.uint32) for _, x, _ in packs]))
    both = np.concatenate([np.frombuffer(g, np.uint32) for g, _, _ in packs]).astype(np.uint64)
    both <<= np.uint64(32)
    both |= owner
    del owner
    both.sort()
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]                # a text's copies count once
    grams = (both >> np.uint64(32)).astype(np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    holders = np.diff(np.append(starts, len(grams)))
    del grams, starts
    both = both[np.repeat(holders > 1, holders)]
    holders = holders[holders > 1].astype(np.int32)
    holders = np.repeat(holders, holders)
    for at in range(0, len(both), ROWS_OUT):
        part = both[at:at + ROWS_OUT]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[part & np.uint64(0xFFFFFFFF)]), pa.array((part >> np.uint64(32) | np.uint64(bucket << 32)).view(np.int64)),
             pa.array(holders[at:at + ROWS_OUT])], ["node", "gram", "n"])


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, grams, lengths, nodes) sorted by bucket; one bucket is held at a time."""
    now, packs = None, []
    for batch in batches:
        for i, bucket in enumerate(batch.column(0).to_pylist()):
            if bucket != now and packs:
                yield from _shared_of(now, packs)
                packs = []
            now = bucket
            packs.append(tuple(batch.column(k)[i].as_buffer() for k in (1, 2, 3)))
    if packs:
        yield from _shared_of(now, packs)


def _keys(docs: DataFrame, nodes: DataFrame, size: int, similarity: float, column: str) -> DataFrame:
    """(node, size, keys): nodes that may be similar to others, with so many of their rarest shingles that similar ones have one in common.

    Shingles are put in order by the number of nodes that hold them, counted over all texts. Those of one node only come
    first and need no key. A node of which less than ``least_shared`` are held by others is similar to none. ``keys`` are structs (key, most):
    if the first shingle that two nodes have in common is this one, the other node has at most ``most`` shingles, for only what
    comes after it can be shared as well. A shingle is known by
    its bucket and 32 bits: a few seem to be shared that are not, which costs time only, since links are verified; a few of one
    text seem to be the same, which lowers what it must share.
    """
    total = nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = total // BUCKET + 1
    packed = in_batches(docs.select(column), _packed(size, buckets), "bucket long, grams binary, lengths binary, nodes binary")
    packed = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    shared = stored(packed.mapInArrow(_count_buckets, "node long, gram long, n int"), "shared")
    least = F.ceil(F.col("size") * similarity - 1e-9).cast("int") - F.col("twins")
    known = shared.groupBy("node").agg(F.count("*").cast("int").alias("m")).join(nodes.select("node", "size", "twins"), "node")
    known = known.where(F.col("m") >= least).select("node", "size", (F.col("m") + F.col("twins")).alias("room"), (F.col("m") - least + 1).alias("n_keys"))
    known = written(known, "known")
    entries = F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("entries")          # one text's shingles
    held = shared.join(known.select("node"), "node").groupBy("node").agg(entries).join(known, "node")
    most = lambda i: F.floor((F.col("room") - i) * ((1 + similarity) / similarity) - F.col("size") + 1e-6).cast("int")
    rarest = F.transform(F.slice("entries", F.lit(1), F.col("n_keys")), lambda e, i: F.struct(e["gram"].alias("key"), most(i).alias("most")))
    return stored(held.select("node", "size", rarest.alias("keys")), "keys")


def _with_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, lead) of rows (key, node, size, most) sorted by key: nodes of a key beside its first, if sizes allow; no group is held."""
    held: np.ndarray | None = None                        # key, node, size, most of the first row of the last key
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        new = np.concatenate([[held is None or held[0] != rows[0, 0]], rows[0, 1:] != rows[0, :-1]])
        leads = np.concatenate([rows[:, :1] if held is None else held[:, None], rows[:, new]], axis=1)[:, np.cumsum(new)]
        held = leads[:, -1].copy()
        pick = ~new & (rows[1] != leads[1]) & (rows[2] <= leads[3]) & (leads[2] <= rows[3])
        yield pa.RecordBatch.from_arrays([pa.array(rows[1, pick]), pa.array(leads[1, pick])], ["node", "lead"])


def _compare_parts(similarity: float):
    """Candidates (a, b) of other labels within groups of rows (key, low, high, part, node, label, size, most, check) sorted by the first three."""
    bound = most_bits(similarity, DEVIATIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 8 + PARTS
        rest = np.empty((0, width), np.int64)
        for batch in _with_end(batches):
            if batch is None:
                rows, ready = rest, len(rest)
            else:
                checks = batch.column(8).flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS)
                front = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(8)], axis=1)
                rows = np.concatenate([rest, np.concatenate([front, checks], axis=1)])
                last = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
                ready = int(last[-1]) + 1 if len(last) else 0
            if not ready:
                rest = rows
                continue
            now, rest = rows[:ready], rows[ready:]
            starts = np.flatnonzero(np.concatenate([[True], (now[1:, :3] != now[:-1, :3]).any(axis=1)]))
            for at, stop in zip(starts.tolist(), [*starts[1:].tolist(), ready]):
                group = now[at:stop]
                one = group[group[:, 3] == group[:, 1]]
                other = one if group[0, 1] == group[0, 2] else group[group[:, 3] == group[:, 2]]
                node, label, size, most, bits = other[:, 4], other[:, 5], other[:, 6], other[:, 7], other[:, 8:].view(np.uint64)
                for i, row in enumerate(one):
                    pick = label != row[5]
                    if other is one:
                        pick[:i + 1] = False
                    pick &= (size <= row[7]) & (row[6] <= most) & (np.minimum(size, row[6]) >= least_shared(np.maximum(size, row[6]), similarity))
                    where = np.flatnonzero(pick)
                    if not len(where):
                        continue
                    differ = np.bitwise_count(bits[where] ^ row[8:].view(np.uint64)).sum(axis=1, dtype=np.int64)
                    where = where[(differ <= bound) | (np.minimum(size[where], row[6]) < SMALL_SET)]
                    if len(where):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.maximum(node[where], row[4])), pa.array(np.minimum(node[where], row[4]))], ["a", "b"])
    return run


def _sets(keys: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, column: str) -> DataFrame:
    """(node, size, grams, check): the sets of the nodes that have keys, read again from their texts, with long fingerprints."""
    needed = written(nodes.join(keys.select("node"), "node").select("node", F.col("text_hash").alias("_text_hash")), "candidate_nodes")
    texts = docs.select(F.xxhash64(docs[column]).alias("_text_hash"), docs[column].alias("text"))
    texts = texts.join(F.broadcast(needed) if needed.count() <= BROADCAST_NODES else needed, "_text_hash").select("node", "text")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t.as_py(), size) for t in batch.column(1)]
        checks = [_long_bits(_blocks(g)) for g in found]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(g) for g in found], pa.int32()), pa.array([g.view(np.int64) for g in found], pa.list_(pa.int64())),
             pa.array(checks, pa.list_(pa.int64()))], ["node", "size", "grams", "check"])

    once = texts.groupBy("node").agg(F.min("text").alias("text"))         # copies of a text
    return stored(arrow_map(once, lambda: sets, "node long, size int, grams array<long>, check array<long>"), "candidate_sets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of nodes whose sets have the Jaccard similarity; sizes and long fingerprints spare most of the others."""
    facts = sets.select("node", "size", "check")
    for end in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("node").alias(end), F.col("size").alias(f"{end}_size"), F.col("check").alias(f"{end}_check")), end)
    differ = F.aggregate(F.zip_with("a_check", "b_check", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    small = F.least("a_size", "b_size")
    pairs = written(pairs.where(small >= F.greatest("a_size", "b_size") * similarity - 1e-9).where(
        (small < SMALL_SET) | (differ <= most_bits(similarity, DEVIATIONS))).select("a", "b"), "candidates")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y")

    def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            good.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return written(arrow_map(both, lambda: exact, "a long, b long"), "links")


def _labelled(rows: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """The rows with the label of a node: the smallest node that links connect it to, itself without links."""
    named = labels.select(F.col("node").alias(node), F.col("root").alias(label))
    return rows.join(named, node, "left").withColumn(label, F.coalesce(label, node))


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes whose SimHashes are equal or link at ``SIMHASH_BITS`` by blocks, each group of equal ones by its first node."""
    nodes = nodes.where("size > 0")
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "simhash_leads")
    equal = nodes.join(first, "fp").where("node <> lead").select(F.col("node").alias("x"), F.col("lead").alias("y"))
    ends = [first.select(F.col("fp").alias(e), F.col("lead").alias(f"{e}_lead")) for e in ("a", "b")]
    near = links(first.select("fp"), SIMHASH_BITS).join(ends[0], "a").join(ends[1], "b").select("a_lead", "b_lead")
    return equal.union(near).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _similar_links(keys: DataFrame, sets: DataFrame, similarity: float, simhash_pairs: DataFrame) -> DataFrame:
    """(a, b): links that connect the nodes of exact Jaccard similarity ``similarity`` or more.

    Pairs that meet by their SimHash are verified first. What lies further apart than its few bits, down to the similarity, is
    found by the keys: such nodes share one. Every node is held against the first nodes of its keys, those for which the key leaves most room (a text
    of which others are edited copies is such a node), in rounds: the one with which it
    shares most keys, then all others, each time only those to which no links connect it yet. So a
    group of near copies gives little more than a forest. All other pairs of a key that links do not connect are compared after that.
    A key of more than ``GROUP_ROWS`` nodes is split into parts, and every two parts meet in a task of their own.
    Fingerprints only spare pairs ``DEVIATIONS`` deviations beyond the similarity; each link is verified on the shingles.
    """
    one = keys.select("node", "size", F.inline("keys")).select("key", "node", "size", "most")
    stars = one.repartition("key").sortWithinPartitions("key", F.desc("most"), "node").mapInArrow(_with_first, "node long, lead long")
    turn = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "lead"))       # as many as a node has keys
    partners = written(stars.groupBy("node", "lead").agg(F.count("*").alias("n")).withColumn("turn", turn), "partners")
    most = partners.agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0]
    found, done = _verified(simhash_pairs, sets, similarity), 0
    labels = written(components(found), "labels")
    for turns in TURNS:
        if done >= most:
            break
        now = partners.where((F.col("turn") > done) & (F.col("turn") <= (done + turns if turns else most)))
        done = done + turns if turns else most
        open_ = _labelled(_labelled(now, labels, "node", "x"), labels, "lead", "y").where("x <> y")
        more = _verified(open_.select(F.col("node").alias("a"), F.col("lead").alias("b")), sets, similarity)
        found = found.union(more)
        labels = written(components(found), "labels")

    members = written(_labelled(one, labels, "node", "label"), "members")
    open_ = members.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    open_ = open_.where("low <> high").select("key", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("parts"))
    facts = sets.select("node", "check")
    split = members.join(open_, "key").join(facts, "node").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "label", "size", "most", "check")
    split = split.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    pairs = split.mapInArrow(_compare_parts(similarity), "a long, b long").distinct()
    tested = partners.select(F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b"))
    rest = _verified(pairs.join(tested, ["a", "b"], "left_anti"), sets, similarity)
    return found.union(rest)


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The documents, with all their columns, reduced to one of each group of near-duplicates.

    Texts are near-duplicates if their sets of shingles of ``size`` words have a Jaccard similarity of ``similarity`` or more, or
    if such pairs connect them. Texts first meet by the SimHash of their sets, at ``SIMHASH_BITS`` differing bits by blocks; pairs of the
    similarity that differ in more bits meet on their rarest shingles, as many as such a pair cannot miss; which are rare is
    counted over all texts. Long fingerprints spare far pairs, and every link is verified on the sets. The
    smallest key stays, NULL keys last, then the smaller hash of the text; of rows equal in both, one stays. NULL and
    empty texts are copies of each other.
    """
    rows = written(_signatures(docs, size, key, column), "signatures")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "text_hash")
    nodes = written(rows.groupBy("node").agg(
        F.first("size").alias("size"), F.first("twins").alias("twins"), F.first("fp").alias("fp"), F.min("text_hash").alias("text_hash"), F.min(order).alias("first")), "nodes")
    keys = _keys(docs, nodes, size, similarity, column)
    links = _similar_links(keys, _sets(keys, nodes, docs, size, column), similarity, _simhash_pairs(nodes))
    rooted = nodes.select("node", "first").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    winners = rooted.groupBy("root").agg(F.min("first").alias("w")).select(
        F.col("w.key").alias("_key"), F.col("w.text_hash").alias("_hash"))
    hashed = docs.withColumn("_hash", F.xxhash64(F.col(column)))
    kept = hashed.join(winners, hashed[key].eqNullSafe(winners["_key"]) & (hashed["_hash"] == winners["_hash"]), "left_semi")
    return kept.dropDuplicates([key, "_hash"]).drop("_hash")
