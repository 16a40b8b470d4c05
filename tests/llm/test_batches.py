import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from quiremill.llm import backtrack_bpe, common

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    old = spark.conf.get(LIMIT, None)
    spark.conf.unset(LIMIT)
    yield
    spark.conf.unset(LIMIT) if old is None else spark.conf.set(LIMIT, old)


def seen(spark):
    def work(batch):
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    docs = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("long text "), 5000).alias("text"))      # 30 MB in one task
    return common.arrow_map(docs, lambda: work, "n long, size long").agg(F.sum("n").alias("n"), F.max("size").alias("most")).first()


def test_long_texts_come_in_small_batches(spark, unset):
    got = seen(spark)
    assert got.n == 600 and got.most <= common.BATCH_BYTES + 100_000


def test_a_limit_of_the_session_holds(spark, unset):
    spark.conf.set(LIMIT, str(1 << 20))
    assert seen(spark).most <= (1 << 20) + 100_000 and spark.conf.get(LIMIT) == str(1 << 20)


def test_pairs_that_a_task_keeps_are_bounded(monkeypatch):
    with open(path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    texts = [f"anti{a}establish{b}ments" for a in range(40) for b in "abcdefgh"]
    free = backtrack_bpe.WordBpe(spec)
    expected = [free.encode(t) for t in texts]
    assert len(free.compatible) > 20
    monkeypatch.setattr(backtrack_bpe, "CACHE_PAIRS", 20, raising=False)
    bpe = backtrack_bpe.WordBpe(spec)
    assert [bpe.encode(t) for t in texts] == expected
    assert len(bpe.compatible) <= 20
