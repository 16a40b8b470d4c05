"""Helpers shared by the corpus operators."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quiremill.session import scratch_path

SLICE_ROWS = 1024      # rows of an Arrow batch that a worker handles at a time
BATCH_BYTES = 4 << 20  # bytes of a batch that goes to a worker, about; Spark's own limit is 10,000 rows of any length

#: A word is a run of characters other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over batches of about ``BATCH_BYTES``, so that long texts don't fill an executor and its workers.

    The limit is set for the session, unless it has one.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Any]], schema: str | StructType) -> DataFrame:
    """``in_batches`` over slices of at most ``SLICE_ROWS`` rows.

    ``make`` runs once in every task and returns the function from a slice to a table or
    batch with the columns of ``schema``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = work(batch.slice(at, SLICE_ROWS))
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out
                out = None
            batch = None
            pa.default_memory_pool().release_unused()      # a worker is reused; it need not hold what it has read
    return in_batches(df, run, schema)


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """A table in the shared folder, written with strong compression and read back: for large packed columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo a number; NULL counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
