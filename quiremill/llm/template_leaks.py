"""Benchmark decontamination: windows of canonical templates, joined by hash and checked for consistent slots."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiremill.llm.common import arrow_map
from quiremill.session import written

WINDOW = 8                     # tokens of a window; an item with fewer is one window of its own length
COVERAGE = 0.5                 # share of an item's windows that a document must hold
BLOOM_BITS = 22                # the filter that spares the join most windows has a fixed size
BROADCAST_WINDOWS = 200_000    # more benchmark windows are joined by a shuffle
CACHE_TOKENS = 120_000         # distinct tokens whose templates a task keeps

#: Words that are units after a number.
UNITS = frozenset("""
mm cm dm m km in inch inches ft foot feet yd yard yards mile miles meter meters metre metres centimeter centimeters kilometer kilometers
mg g kg t gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds oz ounce ounces
ml cl dl l liter liters litre litres gallon gallons pint pints cup cups
s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
c f k degree degrees % percent w kw watt watts v volt volts a amp amps j joule joules cal kcal calories hz khz mhz
mph kmh b kb mb gb tb byte bytes bit bits
usd eur gbp cent cents dollar dollars euro euros pence yen rupee rupees
""".split())

_NUMBER = re.compile(r"[$€£¥]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?%?")
_NUMBER_UNIT = re.compile(r"[+-]?\d[\d.,]*([^\W\d_]+)")
_EDGE = re.compile(r"^[^\w$€£¥+-]+|[^\w%]+$")

WORD, NUMBER, UNIT, NAME, LINK = 0, 1, 2, 4, 8       # flags of a token; LINK: it ends a sentence
_CODES = {NUMBER: 0x9D39247E33776D41, UNIT: 0x2AF7398005AAA5C7, NAME: 0x44DB015024623547}
_P = np.uint64(0x9E3779B97F4A7C15)


class Canon:
    """Templates of tokens: 64-bit codes, flags and slot values, looked up by local numbers."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.codes, self.flags, self.values = [], [], []

    def _number(self, token: str) -> int:
        self.numbers[token] = n = len(self.codes)
        value = _EDGE.sub("", token)
        flags = LINK if token[-1] in ".!?:" or token[-1] in "\"')" and token[-2:-1] in ".!?" else 0
        if _NUMBER.fullmatch(value) or (m := _NUMBER_UNIT.fullmatch(value)) and m.group(1).lower() in UNITS:
            flags |= NUMBER
        else:
            if value.lower() in UNITS:
                flags |= UNIT
            if value[:1].isupper() and len(value) > 1:
                flags |= NAME
        low = value.lower()
        self.codes.append(xxhash.xxh64_intdigest(low))
        self.flags.append(flags)
        self.values.append(low)
        return n

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token numbers, codes, slot flags, first token of each text) of whole texts."""
        if len(self.codes) > CACHE_TOKENS:
            self._clear()
        lists = [(t or "").split() for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        known, make = self.numbers.get, self._number
        local = np.fromiter(
            (n if (n := known(w)) is not None else make(w) for x in lists for w in x), np.int64, int(starts[-1]))
        flags = np.array(self.flags, np.uint8)[local] if len(local) else np.zeros(0, np.uint8)
        codes = np.array(self.codes, np.uint64)[local] if len(local) else np.zeros(0, np.uint64)
        before = np.concatenate([[LINK], flags[:-1]]).astype(np.uint8)
        before[starts[:-1][sizes > 0]] = LINK
        slot = np.where(flags & NUMBER, NUMBER, 0).astype(np.uint8)
        slot[(flags & UNIT > 0) & (before & NUMBER > 0)] = UNIT
        slot[(slot == 0) & (flags & NAME > 0) & (before & LINK == 0)] = NAME
        for kind, code in _CODES.items():
            codes[slot == kind] = code
        return local, codes, slot, starts


def windows(codes: np.ndarray, slot: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, first token, hash) of all windows of ``size`` tokens of which at least half are plain words."""
    count = len(codes) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total = total * _P + codes[k:k + count]
    total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(size)
    total ^= total >> np.uint64(32)
    plain = np.concatenate([[0], np.cumsum(slot == 0)])
    at = np.arange(count)
    text = np.searchsorted(starts, at, side="right") - 1
    good = (at + size <= starts[text + 1]) & (2 * (plain[size:] - plain[:-size]) >= size)
    return text[good], at[good], total[good]


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BLOOM_BITS) - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(BLOOM_BITS) & mask).astype(np.int64)


def _rows(canon: Canon, batch: pa.RecordBatch, sizes: list[int], keep, whole: bool) -> pa.RecordBatch:
    """Windows of a slice of (key, text_hash, text); ``whole`` keeps a window's size for short texts only."""
    local, codes, slot, starts = canon.read(batch.column(2).to_pylist())
    lengths = np.diff(starts)
    texts, places, hashes, widths = [], [], [], []
    for size in sizes:
        text, at, h = windows(codes, slot, starts, size)
        pick = (np.minimum(lengths[text], WINDOW) == size) if whole else keep(h)
        texts.append(text[pick])
        places.append(at[pick])
        hashes.append(h[pick])
        widths.append(np.full(int(pick.sum()), size))
    text, at, h, width = map(np.concatenate, (texts, places, hashes, widths))
    values = canon.values
    slots = [[values[local[i]] for i in range(a, a + n) if slot[i]] for a, n in zip(at.tolist(), width.tolist())]
    index = pa.array(text, pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(index), batch.column(1).take(index), pa.array(at - starts[text], pa.int32()),
         pa.array(width, pa.int32()), pa.array(h.view(np.int64)), pa.array(slots, pa.list_(pa.string()))],
        ["key", "text_hash", "place", "size", "h", "slots"])


def template_windows(rows: DataFrame, sizes: list[int], bloom: np.ndarray | None) -> DataFrame:
    """(key, text_hash, place, size, h, slots) of the windows of whole texts (columns key and text)."""
    shared = None if bloom is None else rows.sparkSession.sparkContext.broadcast(np.packbits(bloom))    # a fixed size

    def make():
        canon = Canon()
        if shared is None:
            return lambda batch: _rows(canon, batch, sizes, None, True)
        bits = np.unpackbits(shared.value).astype(bool)

        def keep(hashes: np.ndarray) -> np.ndarray:
            a, b = _bits(hashes)
            return bits[a] & bits[b]
        return lambda batch: _rows(canon, batch, sizes, keep, False)

    kind = rows.schema["key"].dataType.simpleString()
    return arrow_map(rows.select("key", F.xxhash64("text").alias("text_hash"), "text"), make,
                     f"key {kind}, text_hash long, place int, size int, h long, slots array<string>")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", column: str = "text",
          coverage: float = COVERAGE) -> DataFrame:
    """(key, text_hash, item, windows, coverage, kind, place): documents that hold a benchmark item.

    Numbers, units after numbers, and names (capitals within a sentence) become typed placeholders. A document and an
    item meet on equal windows of the template. Along one alignment each slot value of the item must
    stand for one value only; alignments that fail this are dropped. A document holds an item if the
    others cover ``coverage`` of its windows: ``verbatim`` if all slots are equal, else
    ``re-parameterised``. NULL, empty and all-placeholder texts hold nothing; equal rows of a document
    give one result; items with the same key and different texts are one item with all windows.
    """
    items = benchmark.select(benchmark[item].alias("key"), benchmark[column].alias("text"))
    theirs = written(template_windows(items, list(range(1, WINDOW + 1)), None).select(
        F.col("key").alias("item"), F.col("text_hash").alias("version"), F.col("place").alias("item_place"),
        "size", "h", F.col("slots").alias("item_slots")).distinct(), "benchmark_windows")
    sizes = sorted(r.size for r in theirs.select("size").distinct().collect())           # at most WINDOW
    bloom = np.zeros(1 << BLOOM_BITS, bool)
    low = theirs.select(F.explode(F.array(
        F.col("h").bitwiseAND(F.lit((1 << BLOOM_BITS) - 1).cast("long")),
        F.shiftrightunsigned("h", BLOOM_BITS).bitwiseAND(F.lit((1 << BLOOM_BITS) - 1).cast("long")))).alias("bit")).distinct()
    bloom[low.toPandas()["bit"].to_numpy(np.int64)] = True        # at most 2**BLOOM_BITS rows
    rows = docs.select(docs[key].alias("key"), docs[column].alias("text"))
    mine = template_windows(rows, sizes, bloom)
    small = theirs.count() <= BROADCAST_WINDOWS
    met = mine.join(F.broadcast(theirs) if small else theirs, ["size", "h"])
    paired = met.withColumn("offset", F.col("place") - F.col("item_place"))
    pair = F.transform(F.arrays_zip("item_slots", "slots"), lambda p: F.struct(p["item_slots"].alias("a"), p["slots"].alias("b")))
    line = paired.groupBy("key", "text_hash", "item", "version", "offset").agg(
        F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_set(pair))).alias("pairs"))
    consistent = line.where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))))
    found = consistent.groupBy("key", "text_hash", "item", "version").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("windows"),
        F.max(F.exists("pairs", lambda p: p["a"] != p["b"])).alias("changed"), F.min("offset").alias("place"))
    totals = theirs.groupBy("item", "version").agg(F.count("*").alias("total"))
    share = found.join(totals, (found["item"].eqNullSafe(totals["item"])) & (found["version"] == totals["version"])).select(
        found["key"].alias(key), "text_hash", found["item"].alias(item), found["version"], "windows",
        (F.col("windows") / F.col("total")).alias("coverage"),
        F.when(F.col("changed"), "re-parameterised").otherwise("verbatim").alias("kind"), "place").where(F.col("coverage") >= coverage)
    best = W.partitionBy(key, "text_hash", item).orderBy(F.desc("coverage"), "kind", "version")
    return share.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "version")


def remove(docs: DataFrame, found: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The documents that hold no benchmark item."""
    gone = found.select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone, docs[key].eqNullSafe(gone["_key"]) & (F.xxhash64(docs[column]) == gone["_hash"]), "left_anti")
