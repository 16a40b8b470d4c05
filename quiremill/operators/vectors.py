"""Nearest vectors and rank fusion."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.operators.cells import CellIndex, build_cells, nearest_of_all, recall, search_cells, unit
from quiremill.operators.relational import top_n_per_key

QUERY_BLOCK = 2048   # query vectors that go to every task; more meet the vectors in parts


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, metric: str = "cosine",
                block: int = QUERY_BLOCK, exact: bool = True, index: CellIndex | None = None,
                probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the ``k`` nearest vectors of every query.

    ``queries`` holds (query_id, embedding), ``vectors`` (vec_id, embedding). Queries up to a ``block``
    go to every task, which multiplies its vectors with them and keeps ``k`` rows per query and batch, so pairs are never
    materialized. More queries are dealt out in blocks, which meet the stored vectors block by block, without the driver.

    Without ``exact`` only the ``probes`` nearest cells of ``index`` (built here if there is none) are searched, by default as many as
    reach a recall of 0.95.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric: {metric}")
    if not exact:
        if metric != "cosine":
            raise ValueError("cells are searched by cosine")
        return search_cells(index or build_cells(vectors), queries, k, probes)
    queries = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL")
    id_type = queries.schema["query_id"].dataType.simpleString()
    rows = queries.limit(block + 1).toPandas()            # one block
    if len(rows) > block:
        return nearest_of_all(vectors.where("embedding IS NOT NULL"), queries, k, metric)
    if not len(rows):
        return vectors.select(F.lit(None).cast(id_type).alias("query_id"), "vec_id",
                              F.lit(0.0).alias("similarity"), F.lit(0).cast("bigint").alias("rank")).where("false")
    order = [F.desc(F.round("similarity", 9)), F.col("vec_id")]
    return top_n_per_key(_nearest(rows, vectors, k, metric, id_type), ["query_id"], order, k)


def _nearest(rows: pd.DataFrame, vectors: DataFrame, k: int, metric: str, id_type: str) -> DataFrame:
    ids = rows["query_id"].to_numpy()
    matrix = np.stack(rows["embedding"].to_numpy()).astype("float64")
    if metric == "cosine":
        matrix = unit(matrix)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            theirs = np.stack(batch["embedding"].to_numpy()).astype("float64")
            if metric == "cosine":
                theirs = unit(theirs)
            similar = matrix @ theirs.T
            keep = min(k, similar.shape[1])
            # Ties at the cut stay: everything at least as good as the k-th best is passed on.
            cut = np.partition(similar, similar.shape[1] - keep, axis=1)[:, similar.shape[1] - keep]
            q, v = np.nonzero(similar >= cut[:, None] - 1e-9)
            yield pd.DataFrame({"query_id": ids[q], "vec_id": batch["vec_id"].to_numpy()[v], "similarity": similar[q, v]})

    kind = dict(vectors.dtypes)["vec_id"]
    return vectors.select("vec_id", "embedding").where("embedding IS NOT NULL").mapInPandas(
        scan, f"query_id {id_type}, vec_id {kind}, similarity double")


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(query_id, embedding): mean vector of every label.

    Dimensions are averaged per (label, dimension), combined map-side; the result
    has one row per label.
    """
    long = vectors.select(F.col(label).cast("string").alias("query_id"), F.posexplode("embedding").alias("dim", "x"))
    means = long.groupBy("query_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("embedding"))


def hybrid_topk(lexical: DataFrame, dense: DataFrame, k: int = 5, c: int = 60, item: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of two ranked tables (query_id, item, rank)."""
    part = lambda df: df.select("query_id", item, (F.lit(1.0) / (F.lit(c) + F.col("rank"))).alias("_s"))
    fused = part(lexical).unionByName(part(dense)).groupBy("query_id", item).agg(F.sum("_s").alias("score"))
    return top_n_per_key(fused, ["query_id"], [F.desc(F.round("score", 12)), F.col(item)], k)
