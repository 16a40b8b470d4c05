"""Session helpers: local sessions for tests, and the shared scratch folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quiremill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="quiremill-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/quiremill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back.

    The result survives lost executors, unlike cached blocks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SPLIT_BYTES = 32 * 1024 * 1024
DEALT_BYTES = 2 * 1024 * 1024


def _size(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys, so many parts that each stems from about 2 MB of the stored ``source``.

    A part whose rows are unpacked many times over, as words, then still sorts in a task's memory.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(3 * cores, -(-_size(source) // DEALT_BYTES)), *keys)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly work on a small input, which often sits in one file.

    An input with at least one 32 MB split per core is left as it is: it comes in
    enough tasks, and moving it would cost more than it gives.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _size(df) < cores * SPLIT_BYTES else df
