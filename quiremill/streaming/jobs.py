"""Structured Streaming forms of the event-driven operators."""
from __future__ import annotations

import json
import threading
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from quiremill.functions.cleaning import is_blank
from quiremill.operators import documents as D
from quiremill.operators import search as S
from quiremill.operators import versions
from quiremill.sources import folders

HISTORY = 10          # rows of history kept per source
HELD_SOURCES = 20_000  # rows, and so sources, that a task reduces at once


def stream_folder(spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None) -> DataFrame:
    """New Parquet files below a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def run_available(stream: DataFrame, out: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Process what is there into a folder, exactly once, and stop."""
    query = (stream.writeStream.outputMode(mode).format(fmt).option("path", f"{out}/data")
             .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()


def as_instant(ts: str) -> Column:
    """A timestamp without zone read as UTC, which watermarks need, whatever the session zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(ts)))


def daily_counts(events: DataFrame, ts: str, delay: str | None = None) -> DataFrame:
    """Rows per day. Without ``delay`` every row counts, however late, and the state is one number per day.

    With a delay a day is closed, and may be emitted in append mode, once the watermark has passed its end; later
    rows are then dropped, and counted by ``late_rows`` after ``run_updates``.
    """
    timed = events.select(as_instant(ts).alias("at"))
    timed = timed if delay is None else timed.withWatermark("at", delay)
    counts = timed.groupBy(F.window("at", "1 day")).agg(F.count(F.lit(1)).alias("count"))
    day = F.date_from_unix_date((F.unix_seconds("window.start") / 86400).cast("int"))
    return counts.select(day.alias("day"), "count")


BASE_EVERY = 16      # batches of updates that a reader meets before they are put together


class DroppedRows(StreamingQueryListener):
    """What every batch of a query read, and what its state operators dropped behind the watermark."""

    def __init__(self) -> None:
        self.noted: dict[str, list[tuple]] = defaultdict(list)
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.noted[str(p.runId)].append((p.batchId, p.numInputRows, dropped, p.eventTime.get("watermark")))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()

    def of(self, run: str) -> list[tuple]:
        """The notes of a run, which come in their own time: those of its last batch before the note of its end."""
        self.ended[run].wait(60)
        return self.noted[run]


def run_updates(stream: DataFrame, out: str, keys: list[str] | None = None) -> None:
    """Write the changed rows of every batch below its number; a repeated batch replaces its own.

    With ``keys`` the current rows are written as a base every ``BASE_EVERY`` batches, so what ``newest`` reads does not grow
    with the number of batches. What batches read and dropped is noted, see ``late_rows``.
    """
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")
        if keys and number % BASE_EVERY == BASE_EVERY - 1:
            newest(batch.sparkSession, out, keys).write.mode("overwrite").parquet(f"{out}/base/batch={number}")

    listener = DroppedRows()
    spark.streams.addListener(listener)
    try:
        query = (stream.writeStream.outputMode("update").foreachBatch(save)
                 .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
        noted = listener.of(str(query.runId))
    finally:
        spark.streams.removeListener(listener)
    if noted:
        rows = spark.createDataFrame(noted, "batch bigint, input_rows bigint, dropped_groups bigint, watermark string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{out}/progress/run={query.runId}")


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that were written whole."""
    numbers = [int(n.removeprefix("batch=")) for n in folders.names(spark, folder) if n.startswith("batch=")]
    return sorted(n for n in numbers if folders.exists(spark, f"{folder}/batch={n}/_SUCCESS"))


def newest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The current row of every key among the updates that ``run_updates`` wrote: the last base and the batches after it."""
    base = max(_batches(spark, f"{out}/base"), default=-1)
    later = [f"{out}/data/batch={n}" for n in _batches(spark, f"{out}/data") if n > base]
    found = None
    for root, paths in ((f"{out}/base", [f"{out}/base/batch={base}"] * (base >= 0)), (f"{out}/data", later)):
        if paths:
            rows = spark.read.option("basePath", root).parquet(*paths)
            found = rows if found is None else found.unionByName(rows)
    rest = [c for c in found.columns if c not in keys and c != "batch"]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def late_rows(spark: SparkSession, out: str, keys: list[str], count: str = "count") -> DataFrame:
    """(batch, input_rows, counted, dropped, dropped_groups, watermark) of every batch of a running count.

    ``dropped`` are the rows that came too late: those read less those by which the counts grew. ``dropped_groups`` is the state
    operators' own figure, which sees a task's rows of one key as one.
    """
    before = F.lag(count, 1, 0).over(Window.partitionBy(*keys).orderBy("batch"))
    grown = spark.read.parquet(f"{out}/data").select("batch", *keys, (F.col(count) - before).alias("more"))
    counted = grown.groupBy("batch").agg(F.sum("more").alias("counted"))
    noted = spark.read.parquet(f"{out}/progress").groupBy("batch").agg(
        *[F.max(c).alias(c) for c in ("input_rows", "dropped_groups", "watermark")])
    counted_rows = F.coalesce("counted", F.lit(0))
    return noted.join(counted, "batch", "left").select(
        "batch", "input_rows", counted_rows.alias("counted"), (F.col("input_rows") - counted_rows).alias("dropped"), "dropped_groups", "watermark")


def first_per_key(requests: DataFrame, ts: str, key: str, delay: str) -> DataFrame:
    """At most one request per key within the delay."""
    timed = requests.withColumn("_at", as_instant(ts)).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_at")


def _tag(spark: SparkSession, checkpoint: str, number: int) -> str:
    """A batch's name, the same when it is repeated: the query's id lives as long as its checkpoint."""
    return f"{json.loads(folders.read_text(spark, f'{checkpoint}/metadata'))['id']}-{number}"


def index_stream(docs: DataFrame, table: str, checkpoint: str) -> None:
    """Cut arriving documents into chunks and replace the chunks of their files.

    A document without text leaves its file as it was. A repeated batch takes the version that it had begun, or
    does nothing if that one counts already.
    """
    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = batch.withColumnRenamed("doc_id", "file_id").where(~is_blank("text"))
        S.replace_chunks(spark, table, S.chunk_documents(files), files, _tag(spark, checkpoint, number))

    query = (docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def analysis_parts(docs: DataFrame) -> dict[str, DataFrame]:
    """What is stored of documents (doc_id, text and what ``documents.analyze`` knows): analyses, entities and chunks by file_id."""
    found = D.entities(D.with_type(docs), F.col("doc_type"))
    chunks = S.chunk_documents(docs.select(F.col("doc_id").alias("file_id"), "text"))
    return {"analyses": D.analyze(docs).withColumnRenamed("doc_id", "file_id"), "entities": found.withColumnRenamed("doc_id", "file_id"),
            "chunks": chunks.select("file_id", "chunk_index", "chunk_text")}


def analyze_stream(docs: DataFrame, table: str, checkpoint: str,
                   parts: Callable[[DataFrame], dict[str, DataFrame]] = analysis_parts) -> None:
    """Analyze arriving documents and replace the analyses, entities and chunks of their files, all three or none.

    A batch writes one version of ``table``, which counts by a commit written last. A batch that breaks off leaves all
    parts as they were; repeated, it goes to the version that it had begun, or does nothing if that one counts. A
    document without text is analyzed too, and then has neither entity nor chunk. Read the parts with ``versions.read``.
    """
    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = batch.select(F.col("doc_id").alias("file_id"))
        versions.replace(spark, table, parts(batch), files, _tag(spark, checkpoint, number))

    query = (docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


_PING = "source string, total bigint, fails bigint, id bigint, at bigint, ok boolean, latency double"


def reduce_pings(pings: DataFrame) -> DataFrame:
    """Per batch of rows and source: counters and the newest ten rows, for all sources of the batch at once.

    This is the map-side half of ``ping_state``: a source with very many rows sends ten of a batch to its
    state at most. Counters ride on the first of them. ``at`` is in microseconds.
    """
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, HELD_SOURCES):
                yield reduced(batch.slice(start, HELD_SOURCES))

    def reduced(batch: pa.RecordBatch) -> pa.RecordBatch:
        source = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        number, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        failed = ~batch.column(3).fill_null(False).to_numpy(zero_copy_only=False)
        order = np.lexsort((-number, -at, source))
        first = np.concatenate([[True], source[order][1:] != source[order][:-1]])
        place = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        kept = order[place < HISTORY]
        leads = first[place < HISTORY]
        counters = [np.where(leads, np.bincount(source, weights=w)[source[kept]], 0).astype(np.int64) for w in (None, failed)]
        rows = batch.take(pa.array(kept))
        return pa.RecordBatch.from_arrays(
            [rows.column(0), *map(pa.array, counters), *(rows.column(i) for i in range(1, 5))],
            ["source", "total", "fails", "id", "at", "ok", "latency"])

    rows = pings.select("source", "id", F.unix_micros(as_instant("pinged_at")).alias("at"), "ok", F.col("latency").cast("double").alias("latency"))
    return rows.mapInArrow(shrink, _PING)


class PingState(StatefulProcessor):
    """Counters of a source as a value, its newest rows as a list."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "total bigint, fails bigint")
        self.history = handle.getListState("history", "id bigint, at bigint, ok boolean, latency double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total, fails = self.counters.get() if self.counters.exists() else (0, 0)
        held = [tuple(h) for h in self.history.get()] if self.history.exists() else []
        for r in rows:
            total, fails = total + r.total, fails + r.fails
            held.append((r.id, r.at, r.ok, r.latency))
        held = sorted(held, key=lambda h: (h[1], h[0]), reverse=True)[:HISTORY]
        self.counters.update((total, fails))
        self.history.put(held)
        yield Row(source=key[0], total=total, fails=fails, last_ids=",".join(str(h[0]) for h in held))

    def close(self) -> None:
        pass


def ping_state(pings: DataFrame) -> DataFrame:
    """Running totals and the last ten rows per source, updated with every batch; needs the state store that ``run_ping_state`` sets.

    The state has no time to live: with one, Spark runs batches without data for ever, and a run over what is there does not end.
    """
    return reduce_pings(pings).groupBy("source").transformWithState(
        PingState(), "source string, total bigint, fails bigint, last_ids string", "Update", "None")


_STORE = "spark.sql.streaming.stateStore.providerClass"


def run_ping_state(pings: DataFrame, out: str) -> None:
    """Write every update of ``ping_state`` with its batch number; the state itself is the current table, see ``ping_table``."""
    spark = pings.sparkSession
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run_updates(ping_state(pings), out, ["source"])
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def ping_table(spark: SparkSession, out: str) -> DataFrame:
    """(source, total, fails, last_ids) as the state holds them now: no update that was ever written is read."""
    part = lambda name: spark.read.format("statestore").option("path", f"{out}/checkpoint").option("stateVarName", name).load()
    counters = part("counters").select("key.source", "value.total", "value.fails")
    newest_first = F.sort_array(F.collect_list(F.struct("list_element.at", "list_element.id")), asc=False)        # ten rows of a source
    history = part("history").groupBy("key.source").agg(newest_first.alias("h"))
    ids = F.array_join(F.transform("h", lambda h: h["id"].cast("string")), ",")
    return counters.join(history.select("source", ids.alias("last_ids")), counters["source"].eqNullSafe(history["source"]), "left").select(
        counters["source"], "total", "fails", "last_ids")
