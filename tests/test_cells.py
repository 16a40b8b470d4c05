"""Vectors in cells: recall against the exact form, and the exact form in parts."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quiremill.operators import cells as CE
from quiremill.operators import vectors as VE

KINDS = "vec_id long, embedding array<float>"


def table(spark, m, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in row]) for i, row in enumerate(m)], KINDS)


def brute_force(m, ids, queries, k):
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    return {q: sorted(ids, key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:k] for q in queries}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16)) * 3
    return (centers[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32).astype(np.float64)


def test_recall_of_every_fiftieth(spark, clustered):
    vectors = table(spark, clustered)
    index = CE.build_cells(vectors)
    queries = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = VE.vector_topk(queries, vectors, 10, exact=False, index=index)
    exact = VE.vector_topk(queries, vectors, 10)
    assert found(exact) == brute_force(clustered, range(3000), range(0, 3000, 50), 10)
    row = VE.recall(got, exact).first()
    assert row["queries"] == 60 and row["recall"] >= 0.9
    assert index.probes(0.95) < len(index.centers) / 2          # far from all cells
    again = CE.open_cells(spark, index.path)
    assert np.allclose(again.centers, index.centers) and again.probes(0.95) == index.probes(0.95)


def test_recall_of_the_given_vectors(spark, folder):
    vectors = spark.read.parquet(f"{folder.replace('0.001', '0.1')}/embeddings.parquet").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = VE.vector_topk(queries, vectors, 10, exact=False)
    assert VE.recall(got, VE.vector_topk(queries, vectors, 10)).first()["recall"] >= 0.9


def test_all_cells_are_exact(spark, clustered):
    vectors = table(spark, clustered[:500])
    queries = vectors.where("vec_id < 25").withColumnRenamed("vec_id", "query_id")
    got = VE.vector_topk(queries, vectors, 4, exact=False, index=CE.build_cells(vectors, cells=6), probes=6)
    assert found(got) == brute_force(clustered[:500], range(500), range(25), 4)


def test_a_hot_cell_is_many_small_groups(spark, clustered, monkeypatch):
    """Half of all vectors are one: its cell is cut into parts, ties go by id, and no group is large."""
    monkeypatch.setattr(CE, "PART_VECTORS", 50)
    monkeypatch.setattr(CE, "PART_QUERIES", 20)
    m = np.concatenate([clustered[:400], np.repeat(clustered[7:8], 400, axis=0)])
    vectors = table(spark, m)
    queries = vectors.where("vec_id % 16 = 7 OR vec_id > 700").withColumnRenamed("vec_id", "query_id")
    asked = [r.query_id for r in queries.collect()]
    got = VE.vector_topk(queries, vectors, 6, exact=False, index=CE.build_cells(vectors, cells=8), probes=8)
    assert found(got) == brute_force(m, range(800), asked, 6)
    assert found(VE.vector_topk(queries, vectors, 6, block=0)) == brute_force(m, range(800), asked, 6)


def test_null_zero_and_no_vectors(spark):
    none = spark.createDataFrame([], KINDS)
    queries = table(spark, np.eye(3)).withColumnRenamed("vec_id", "query_id")
    assert VE.vector_topk(queries, none, 3, exact=False).count() == 0
    assert VE.vector_topk(queries, none, 3, block=0).count() == 0
    some = table(spark, np.array([[1.0, 0, 0], [0, 0, 0], [1, 1, 0]])).union(spark.createDataFrame([(9, None)], KINDS))
    got = found(VE.vector_topk(queries, some, 2, exact=False))
    assert got == {0: [0, 2], 1: [2, 0], 2: [0, 1]}
    assert found(VE.vector_topk(queries.where(F.col("query_id") == 5), some, 2)) == {}


def test_parts_are_compared_in_bounded_room():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    v, q = rng.integers(-2, 3, (8192, 4)).astype(float), rng.integers(-2, 3, (1024, 4)).astype(float)       # many ties
    v[7, 0] = np.nan
    ids = rng.permutation(8192)
    tables = [pa.table({name: pa.array(i), "embedding": pa.array(m.tolist(), pa.list_(pa.float64()))}) for name, i, m in (
        ("vec_id", ids, v), ("query_id", np.arange(1024), q))]
    tracemalloc.start()
    got = CE._nearest_of(3, "dot")(*tables).to_pydict()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    score = np.where(np.isnan(q @ v.T), -np.inf, q @ v.T)
    want = [(i, int(ids[j])) for i in range(1024) for j in np.lexsort((ids, -score[i]))[:3]]
    assert list(zip(got["query_id"], got["vec_id"])) == want and most < 100 << 20
