"""Nearest vectors by cells: vectors stored around the centers of a clustering, of which a query probes some."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.operators.relational import top_n_per_key
from quiremill.session import scratch_path, written

FIT_VECTORS = 50_000         # vectors that the centers are fitted on, at most
MOST_CELLS = 4_096
PART_VECTORS = 8_192         # vectors of a cell that meet queries in one task
PART_QUERIES = 1_024         # queries that they meet at a time
STEP_QUERIES = 64            # queries of a part that are compared at once
BLOCK_BYTES = 4 << 20        # bytes of a packed block of vectors or queries, about
FILE_BLOCKS = 4              # blocks of a stored file, which a task may decode as a whole
TASKS_PER_CORE = 3           # parts of the queries, at least
CELL_VECTORS = 64            # vectors of a cell, about, while there are fewer than MOST_CELLS
TUNING_QUERIES = 256         # vectors whose exact neighbours tell how many cells to probe, at most
TUNING_K = 10


@dataclass(frozen=True)
class CellIndex:
    """A stored index: vectors below ``vectors``, in folders by cell, and the centers of the cells."""
    spark: SparkSession
    path: str
    kinds: str               # columns of the vectors
    centers: np.ndarray
    recalls: np.ndarray      # measured share of true neighbours in the nearest 1, 2, ... cells

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.kinds).parquet(f"{self.path}/vectors")

    def probes(self, recall: float) -> int:
        """The fewest cells that reached a recall on the tuning queries."""
        return int(np.searchsorted(self.recalls, recall - 1e-12)) + 1 if len(self.recalls) and self.recalls[-1] >= recall else len(self.centers)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _closeness(column: pa.Array, centers: np.ndarray) -> np.ndarray:
    """Cosines of vectors to the centers; a single center is near to all."""
    return unit(_matrix(column)) @ centers.T if len(centers) > 1 else np.ones((len(column), 1))


def _fit(vectors: DataFrame, cells: int, total: int) -> np.ndarray:
    """Centers of a clustering of different vectors, at most ``FIT_VECTORS`` of them, taken by hash."""
    share = max(1, -(-total // FIT_VECTORS))
    taken = vectors.select("embedding").where(F.pmod(F.xxhash64("embedding"), F.lit(share)) == 0).distinct().limit(FIT_VECTORS)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    rows = taken.where(norm > 0).select(array_to_vector(F.transform("embedding", lambda x: x.cast("double") / norm)).alias("features"))
    rows = written(rows, "fit")
    if cells == 1 or not rows.head(1):
        return np.zeros((1, 1))
    model = KMeans(k=cells, seed=7, maxIter=8, initSteps=2).fit(rows)
    return unit(np.array(model.clusterCenters()))


def build_cells(vectors: DataFrame, path: str | None = None, cells: int | None = None) -> CellIndex:
    """Store (vec_id, embedding) in cells: the cell of a vector is the center of the highest cosine.

    The centers are fitted on a bounded sample, every vector is stored. Files are cut by ranges of cell and hash, so a cell that
    holds a great part of all vectors is written by several tasks.
    """
    spark = vectors.sparkSession
    path = path or scratch_path(spark, "cells")
    rows = vectors.select("vec_id", "embedding").where("embedding IS NOT NULL")
    total = rows.count()
    cells = cells or min(MOST_CELLS, max(1, total // CELL_VECTORS))
    centers = _fit(rows, cells, total)
    shared = spark.sparkContext.broadcast(centers)        # at most MOST_CELLS vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argmax(_closeness(batch.column(1), shared.value), axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell int"
    found = rows.mapInArrow(assign, kinds)
    found = found.repartitionByRange("cell", F.xxhash64("vec_id")).sortWithinPartitions("cell")
    found.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    recalls = _tuned(spark.read.schema(kinds).parquet(f"{path}/vectors"), centers, total)
    spark.createDataFrame([(i, c.tolist(), float(r), kinds) for i, (c, r) in enumerate(zip(centers, recalls))],
                          "cell int, center array<double>, recall double, kinds string").write.mode("overwrite").parquet(f"{path}/centers")
    return CellIndex(spark, path, kinds, centers, recalls)


def _tuned(vectors: DataFrame, centers: np.ndarray, total: int) -> np.ndarray:
    """Share of the exact neighbours of some vectors, taken by hash, that lie in their nearest 1, 2, ... cells."""
    share = max(1, -(-total // TUNING_QUERIES))
    queries = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(share)) == 0).orderBy(F.xxhash64("vec_id", F.lit(2))).limit(TUNING_QUERIES)
    queries = written(queries.select(F.col("vec_id").alias("query_id"), "embedding"), "tuning")
    whole = vectors.select("vec_id", "embedding", F.lit(0).alias("cell"))
    near = nearest_in_parts(whole, queries.withColumn("cell", F.lit(0)), TUNING_K + 1).where("query_id <> vec_id")
    cells = near.join(vectors.select("vec_id", F.col("cell").alias("cell")), "vec_id").groupBy("query_id").agg(F.collect_list("cell").alias("cells"))
    rows = queries.join(cells, "query_id").toArrow()      # at most TUNING_QUERIES rows of TUNING_K cells
    if not rows.num_rows:
        return np.ones(len(centers))
    order = np.argsort(-_closeness(rows["embedding"].combine_chunks(), centers), axis=1)
    place = np.argsort(order, axis=1)
    found = np.concatenate([place[i, c] for i, c in enumerate(rows["cells"].to_pylist())])
    return np.cumsum(np.bincount(found, minlength=len(centers))) / len(found)


def open_cells(spark: SparkSession, path: str) -> CellIndex:
    rows = spark.read.parquet(f"{path}/centers").orderBy("cell").collect()      # at most MOST_CELLS
    return CellIndex(spark, path, rows[0].kinds, np.array([r.center for r in rows]), np.array([r.recall for r in rows]))


def _probed(queries: DataFrame, centers: np.ndarray, probes: int) -> DataFrame:
    """(query_id, embedding, cell): every query beside the cells whose centers are nearest to it."""
    shared = queries.sparkSession.sparkContext.broadcast(centers)
    probes = min(probes, len(centers))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART_QUERIES):
                part = batch.slice(at, PART_QUERIES)
                near = np.argpartition(-_closeness(part.column(1), shared.value), probes - 1, axis=1)[:, :probes]
                rows = part.take(pa.array(np.repeat(np.arange(part.num_rows), probes)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.ravel().astype(np.int32))], [*rows.schema.names, "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(pick, f"{kinds}, cell int")


def _nearest_of(k: int, metric: str):
    """The ``k`` best vectors of a part for every query of a part."""
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, names = vectors["vec_id"].combine_chunks(), queries["query_id"].combine_chunks()
        kinds = {"query_id": names.type, "vec_id": ids.type, "similarity": pa.float64()}
        if not len(ids) or not len(names):
            return pa.table({n: pa.array([], t) for n, t in kinds.items()})
        v, q = (_matrix(x["embedding"].combine_chunks()) for x in (vectors, queries))
        if metric == "cosine":
            v, q = unit(v), unit(q)
        order = np.argsort(np.array(ids.to_pylist()), kind="stable")
        v, out = v[order], []
        for at in range(0, len(q), STEP_QUERIES):
            raw = q[at:at + STEP_QUERIES] @ v.T
            score = np.nan_to_num(np.round(raw, 9), copy=False, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            least = np.partition(score, -k, axis=1)[:, -k, None] if k < len(v) else -np.inf
            row, col = np.nonzero(score >= least)
            best = np.lexsort((col, -score[row, col], row))                                # ties are told by id
            row, col = row[best], col[best]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col = row[first], col[first]
            out.append(pa.table({"query_id": names.take(pa.array(at + row)), "vec_id": ids.take(pa.array(order[col])), "similarity": pa.array(raw[row, col])}))
        return pa.concat_tables(out)
    return run


def nearest_in_parts(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, vec_id, similarity, rank): the best vectors of the same cell for (query_id, embedding, cell).

    Both sides of a cell are cut into parts of bounded size, by their counts, and every two parts meet in a
    group of their own, which passes on ``k`` rows a query. No vector or query reaches the driver, and a cell that holds
    a great part of all vectors is many groups.
    """
    spark = vectors.sparkSession
    v = vectors.select("cell", "vec_id", "embedding")
    here, asked = (df.groupBy("cell").count().select("cell", F.ceil(F.col("count") / most).cast("int").alias(name))
                   for df, most, name in ((v, PART_VECTORS, "v_parts"), (queries, PART_QUERIES, "q_parts")))
    parts = written(here.join(asked, "cell"), "parts")    # a row for each probed cell, at most MOST_CELLS
    few = [r.cell for r in parts.select("cell").limit(MOST_CELLS + 1).collect()]
    v = v.where(F.col("cell").isin(few)) if len(few) <= MOST_CELLS else v
    v = v.join(F.broadcast(parts), "cell").withColumn("v_part", _part("vec_id", "v_parts"))
    q = queries.join(F.broadcast(parts), "cell").withColumn("q_part", _part("query_id", "q_parts"))
    v = v.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1))).select("cell", "v_part", "q_part", "vec_id", "embedding")
    q = q.withColumn("v_part", F.explode(F.sequence(F.lit(0), F.col("v_parts") - 1))).select("cell", "v_part", "q_part", "query_id", "embedding")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, similarity double"
    group = ["cell", "v_part", "q_part"]
    found = v.groupBy(*group).cogroup(q.groupBy(*group)).applyInArrow(_nearest_of(k, metric), kinds)
    return top_n_per_key(found, ["query_id"], [F.desc(F.round("similarity", 9)), F.col("vec_id")], k)


def _blocks(rows: int):
    """(block, packed): rows as Arrow bytes, so many at a time, and fewer where they are wide."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0

        def pack() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            name = uuid.uuid4().int >> 65
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "packed"])

        for batch in batches:
            step = max(1, min(rows, BLOCK_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                if held and (n + part.num_rows > rows or size + part.nbytes > BLOCK_BYTES):
                    yield pack()
                    held, n, size = [], 0, 0
                held.append(part)
                n, size = n + part.num_rows, size + part.nbytes
        if held:
            yield pack()
    return run


class _Best:
    """The ``k`` best vectors so far for every query of a block."""

    def __init__(self, queries: pa.Table, k: int, metric: str):
        self.names, self.k, self.metric = queries["query_id"].combine_chunks(), k, metric
        q = _matrix(queries["embedding"].combine_chunks())
        self.q = unit(q) if metric == "cosine" else q
        self.least = np.full(len(q), -np.inf)              # what a vector must reach, once there are ``k``
        self.row, self.raw, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def meet(self, vectors: pa.Table) -> None:
        ids = vectors["vec_id"].combine_chunks()
        order = pc.sort_indices(ids, null_placement="at_start")
        ids, v = ids.take(order), _matrix(vectors["embedding"].combine_chunks().take(order))
        v = unit(v) if self.metric == "cosine" else v
        rows, cols, raws = [], [], []
        for at in range(0, len(self.q), STEP_QUERIES):
            raw = self.q[at:at + STEP_QUERIES] @ v.T
            least = self.least[at:at + STEP_QUERIES, None]
            row, col = np.nonzero(~(raw < least - 2e-9))    # rounding moves a score by less; NaN is below all, and told apart next
            if len(row) > 4 * self.k * len(raw):            # many: the first ``k`` of a query here, ties by id
                score = _score(raw)
                least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k, None]) if self.k < len(v) else least
                above = score > least
                ties = (score == least) & (np.cumsum(score == least, axis=1) <= self.k)
                row, col = np.nonzero(above | ties)
            rows.append(at + row)
            cols.append(col)
            raws.append(raw[row, col])
        self._add(np.concatenate(rows), np.concatenate(raws), ids.take(pa.array(np.concatenate(cols))))

    def _add(self, row: np.ndarray, raw: np.ndarray, ids: pa.Array) -> None:
        if not len(row):
            return
        if self.ids is not None:
            row, raw, ids = np.concatenate([self.row, row]), np.concatenate([self.raw, raw]), pa.concat_arrays([self.ids, ids])
        place = np.empty(len(row), np.int64)
        place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(row))
        score = _score(raw)
        best = np.lexsort((place, -score, row))             # ties are told by id
        row = row[best]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        best = best[kept]
        self.row, self.raw, self.ids, score = row[kept], raw[best], ids.take(pa.array(best)), score[best]
        last = np.searchsorted(self.row, np.arange(len(self.q)), "right") - 1
        full = np.bincount(self.row, minlength=len(self.q)) == self.k
        self.least[full] = score[last[full]]

    def found(self) -> Iterator[pa.Table]:
        if self.ids is not None:
            yield pa.table({"query_id": self.names.take(pa.array(self.row)), "vec_id": self.ids, "similarity": pa.array(self.raw)})


def _score(raw: np.ndarray) -> np.ndarray:
    return np.nan_to_num(np.round(raw, 9), copy=False, nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def _read(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def nearest_of_all(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, vec_id, similarity, rank): the best of all vectors for (query_id, embedding), without cells.

    Vectors are stored once as packed blocks. A task holds a block of queries and their best so far, and reads the stored vectors block by
    block; so neither side is copied for the other, however many there are, and nothing but queries and ``k`` rows for each is moved.
    """
    spark = vectors.sparkSession
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, similarity double"
    path = scratch_path(spark, "vectors")
    packed = vectors.select("vec_id", "embedding").mapInArrow(_blocks(PART_VECTORS), "block long, packed binary")
    packed.write.options(compression="zstd", maxRecordsPerFile=FILE_BLOCKS).parquet(path)
    theirs = spark.read.schema(packed.schema).parquet(path).coalesce(1)                     # a task reads all, one file after the other
    most = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-queries.count() // PART_VECTORS))
    mine = queries.select("query_id", "embedding").repartition(most).mapInArrow(_blocks(PART_VECTORS), "block long, packed binary")

    def run(pairs: Iterator) -> Iterator[tuple[bytes]]:
        name, best = None, None

        def done() -> Iterator[tuple[bytes]]:
            for found in best.found() if best else ():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, found.schema) as out:
                    out.write_table(found)
                yield (sink.getvalue().to_pybytes(),)

        for ours, others in pairs:
            if ours.block != name:
                yield from done()
                name, best = ours.block, _Best(_read(ours.packed), k, metric)
            best.meet(_read(others.packed))
        yield from done()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in batch.column(0):
                yield from pa.ipc.open_stream(found.as_buffer())

    found = spark.createDataFrame(mine.rdd.cartesian(theirs.rdd).mapPartitions(run), "found binary", verifySchema=False)
    found = written(found.mapInArrow(unpack, kinds), "neighbours")
    return top_n_per_key(found, ["query_id"], [F.desc(F.round("similarity", 9)), F.col("vec_id")], k)


def _part(key: str, parts: str) -> Column:
    """A part by row, so that rows with equal keys are dealt out too."""
    return F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.col(parts)).cast("int")


def search_cells(index: CellIndex, queries: DataFrame, k: int = 5, probes: int | None = None, least_recall: float = 0.95) -> DataFrame:
    """(query_id, vec_id, similarity, rank): about the ``k`` nearest vectors by cosine, from the ``probes`` nearest cells.

    Without a number the cells are as many as reached ``least_recall`` when the index was built. Queries (query_id, embedding)
    may be as many as the vectors; only the folders of probed cells are read. With as many probes as cells the result is exact.
    """
    asked = queries.select("query_id", "embedding").where("embedding IS NOT NULL")
    return nearest_in_parts(index.vectors, _probed(asked, index.centers, probes or index.probes(least_recall)), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): how many of the exact neighbours were found."""
    hit = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("recall"))
