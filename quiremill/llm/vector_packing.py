"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly, groups of equal texts stay together."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiremill.llm.common import WORD_PATTERN
from quiremill.session import written

HEAVY = 64                   # a group of more than this part of a shard is placed ahead of the others
UNEVEN = 1 / 16              # a piece's weights in two dimensions differ by so much of a shard at most, which other groups make up for
PART_GROUPS = 1 << 18        # groups that one sequence of placements holds, about
SLOT_CHUNKS = 1024           # a shard's rows are numbered in so many parts
GROUP = ["h", "crc", "size"]
DIMS = ["bytes", "tokens", "rows"]


def best_shard(weight: np.ndarray, left: np.ndarray, turn: int = 0) -> tuple[int, bool]:
    """(shard, does it fit): where the dot product of a weight with the residual capacity is highest, if it can among those it fits.

    ``left`` has a row for each shard. Equal products go to the first shard from ``turn`` on.
    """
    score = left @ weight
    fits = (left >= weight).all(axis=1)
    if fits.any():
        score = np.where(fits, score, -np.inf)
    n = len(score)
    return int((np.argmax(np.roll(score, -turn)) + turn) % n), bool(fits.any())


def plan_heavy(groups: list[tuple[np.ndarray, int]], left: np.ndarray) -> list[int]:
    """Pieces for each heavy group (weight, rows), the largest first: one if a shard takes it whole, else as few as fit.

    A group of many short texts, say, would take most of a shard's rows and few of its bytes; it is cut until other groups can even that out.
    """
    left, out = left.copy(), []
    for weight, rows in groups:
        pieces = min(rows, max(1, math.ceil((weight.max() - weight.min()) / UNEVEN)))
        while True:
            now, places = left.copy(), []
            for _ in range(pieces):
                shard, fits = best_shard(weight / pieces, now)
                now[shard] -= weight / pieces
                places.append(fits)
            if all(places) or pieces >= rows or weight.max() / pieces <= 1 / HEAVY:
                break
            pieces = min(rows, pieces * 2 if pieces < 8 else pieces + pieces // 4)
        left = now
        out.append(pieces)
    return out


def _place(capacity: np.ndarray, left: np.ndarray, shares: dict[int, np.ndarray]):
    """Rows (part, bytes, tokens, rows, group), sorted by part and falling weight, with the shard of each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now = None, left
        for batch in batches:
            weights = np.stack([batch.column(i).to_numpy().astype(np.float64) for i in (1, 2, 3)], axis=1) / capacity
            parts, found = batch.column(0).to_pylist(), np.empty(batch.num_rows, np.int32)
            for i, p in enumerate(parts):
                if p != part:
                    part, now = p, left * shares[p]       # its part of what the heavy groups leave
                found[i], _ = best_shard(weights[i], now, p % len(left))
                now[found[i]] -= weights[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4, 7)), pa.array(found)], [*GROUP, "shard"])
    return run


def pack(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, crc, tokens, shard, slot): every row with its shard from 0 and its place there, gapless from 0.

    A row weighs the bytes of its text and one, its words, and one row; shards get near equal sums of all three. Rows of equal texts
    are a group. A group goes whole to the shard where the dot product of its weight with the residual capacity is highest, heavy ones
    first; one that fits no shard whole, or is too uneven to be made up for, is cut into as few pieces as do. Heavy groups, whose number is bounded by the number of
    shards, are placed on the driver. The others are dealt into parts by hash, and each part fills its own share of every shard's
    residual capacity, in Spark, group by group. NULL and empty texts are a group of size 1; NULL keys are rows like any other, equal
    weights are placed by hash, repeated rows each get a slot of their own, and an empty table gives no row.
    """
    whole = F.coalesce(docs[text], F.lit(""))
    rows = written(docs.select(
        docs[key].alias("key"), F.xxhash64(whole).alias("h"), F.crc32(whole.cast("binary")).alias("crc"),
        (F.octet_length(whole) + 1).cast("long").alias("size"), F.regexp_count(whole, F.lit(WORD_PATTERN)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row")), "rows")
    groups = written(rows.groupBy(*GROUP).agg(
        F.sum("size").alias("bytes"), F.sum("words").alias("tokens"), F.count("*").alias("rows")), "groups")
    totals = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in DIMS), F.count("*")).first()
    capacity = np.maximum(np.array(totals[:3], np.float64) / shards, 1e-9)
    share = F.greatest(*(F.col(c) / float(x) for c, x in zip(DIMS, capacity)))
    groups = groups.withColumn("share", share)
    heavy = groups.where(F.col("share") > 1 / HEAVY).orderBy(F.desc("share"), *GROUP).collect()      # fewer than 3 * HEAVY * shards

    left = np.ones((shards, 3))
    weight = lambda r: np.array([r[c] for c in DIMS], np.float64) / capacity
    pieces = plan_heavy([(weight(r), r["rows"]) for r in heavy], left)
    spark = docs.sparkSession
    known = spark.createDataFrame([(*(r[c] for c in GROUP), n) for r, n in zip(heavy, pieces)], "h long, crc long, size long, pieces int")
    rows = rows.join(F.broadcast(known), GROUP, "left").withColumn(
        "piece", F.pmod(F.xxhash64("row"), F.coalesce("pieces", F.lit(1))).cast("int"))
    some = rows.where("pieces IS NOT NULL")
    exact = some.groupBy(*GROUP, "piece").agg(F.sum("size").alias("bytes"), F.sum("words").alias("tokens"), F.count("*").alias("rows")).collect()
    placed = []
    for r in sorted(exact, key=lambda r: (-weight(r).max(), *(r[c] for c in GROUP), r["piece"])):
        shard, _ = best_shard(weight(r), left)
        left[shard] -= weight(r)
        placed.append((*(r[c] for c in GROUP), r["piece"], shard))
    where = spark.createDataFrame(placed, "h long, crc long, size long, piece int, shard int")
    some = some.join(F.broadcast(where), [*GROUP, "piece"]).select("key", "row", *GROUP, "words", "shard")

    parts = totals[3] // PART_GROUPS + 1
    light = groups.where(F.col("share") <= 1 / HEAVY).withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int"))
    sums = {r["part"]: np.array([r[c] for c in DIMS], np.float64) for r in light.groupBy("part").agg(*(F.sum(c).alias(c) for c in DIMS)).collect()}
    all_light = np.maximum(sum(sums.values(), np.zeros(3)), 1e-9)
    shares = {p: x / all_light for p, x in sums.items()}
    light = light.repartition(parts, "part").sortWithinPartitions("part", F.desc("share"), *GROUP)
    light = light.select("part", *DIMS, *GROUP).mapInArrow(_place(capacity, left, shares), "h long, crc long, size long, shard int")
    light = written(light, "light")
    others = rows.where("pieces IS NULL").join(light, GROUP).select("key", "row", *GROUP, "words", "shard")

    out = some.union(others).withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(SLOT_CHUNKS)))
    out = written(out, "sharded")
    before = out.groupBy("shard", "chunk").count().withColumn(
        "first", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("key", "row")) - 1
    out = out.withColumn("place", place).join(F.broadcast(before.drop("count")), ["shard", "chunk"])
    return out.select(F.col("key").alias(key), "size", F.col("crc"), F.col("words").alias("tokens"), "shard", (F.col("first") + F.col("place")).alias("slot"))
