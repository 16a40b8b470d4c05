"""Tables that replace the rows of some files at a time: in versions, with one commit for all parts, by several writers at once.

Below a table's folder stand ``<part>/version=<n>`` (rows with a ``file_id``), ``files/version=<n>`` (the files whose rows that
version holds, with the version they stem from), ``claims/<n>`` (numbers taken by writers) and ``commits/<n>``. A
version counts once its commit is there, which is written last and in one step. A reader takes each file's newest version.
"""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.sources import folders

COMPACT_AFTER = 32           # versions that a reader meets before a writer puts them together


def claim(spark: SparkSession, table: str, tag: str | None = None) -> int:
    """The number of a new version, which no other writer gets: its marker is created exclusively, and who comes second tries the next.

    A writer that comes back under the same ``tag`` gets the number that it had.
    """
    if tag is not None and folders.exists(spark, f"{table}/tags/{tag}"):
        return int(folders.read_text(spark, f"{table}/tags/{tag}"))
    taken = [int(n) for n in folders.names(spark, f"{table}/claims") if n.isdigit()]
    for part in _parts(spark, table):
        taken += _versions(spark, table, part)
    number = max(taken, default=0) + 1
    while not folders.create_new(spark, f"{table}/claims/{number}", tag or ""):
        number += 1
    if tag is not None and not folders.create_new(spark, f"{table}/tags/{tag}", str(number)):
        return int(folders.read_text(spark, f"{table}/tags/{tag}"))
    return number


def _parts(spark: SparkSession, table: str) -> list[str]:
    return [n for n in folders.names(spark, table) if n not in ("claims", "commits", "tags") and not n.startswith((".", "_"))]


def _versions(spark: SparkSession, table: str, part: str) -> list[int]:
    return [int(n.removeprefix("version=")) for n in folders.names(spark, f"{table}/{part}") if n.startswith("version=")]


def committed(spark: SparkSession, table: str) -> list[int]:
    """The versions that count, without those that a later one has put together."""
    found, merged = [], set()
    for name in folders.names(spark, f"{table}/commits"):
        number, _, kind = name.partition(".")
        if number.isdigit():
            found.append(int(number))
            if kind == "merged":
                merged |= set(json.loads(folders.read_text(spark, f"{table}/commits/{name}")))
    return sorted(set(found) - merged)


def replace(spark: SparkSession, table: str, parts: dict[str, DataFrame], files: DataFrame, tag: str | None = None,
            compact_after: int | None = COMPACT_AFTER) -> int:
    """Replace the rows of the listed files in all parts at once; the version written.

    A write that breaks off leaves every part as it was. A file that is listed and has no row in a part loses those it had.
    With a ``tag`` a repeated write goes to the version it had begun, or does nothing if that one counts already. Of two writers the
    one with the higher number wins for the files that both list; no other file is touched. Beyond ``compact_after``
    versions the smaller ones are put together.
    """
    version = claim(spark, table, tag)
    if tag is not None and version in committed(spark, table) + _merged(spark, table):
        return version
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{table}/{name}/version={version}")
    listed = files.select("file_id").distinct().withColumn("asof", F.lit(version).cast("long"))
    listed.write.mode("overwrite").parquet(f"{table}/files/version={version}")
    folders.create_new(spark, f"{table}/commits/{version}", "")
    if compact_after is not None and len(committed(spark, table)) > compact_after:
        compact(spark, table, _small(spark, table))
    return version


def _merged(spark: SparkSession, table: str) -> list[int]:
    """Versions that have been put together into others."""
    return [v for n in folders.names(spark, f"{table}/commits") if n.endswith(".merged")
            for v in json.loads(folders.read_text(spark, f"{table}/commits/{n}"))]


def _read(spark: SparkSession, table: str, part: str, versions: list[int]) -> DataFrame:
    there = set(_versions(spark, table, part))
    paths = [f"{table}/{part}/version={v}" for v in versions if v in there]
    return spark.read.option("basePath", f"{table}/{part}").option("mergeSchema", True).parquet(*(paths or [f"{table}/{part}"]))


def _newest(spark: SparkSession, table: str, versions: list[int]) -> DataFrame:
    """(file_id, version, asof): where each file's rows are, and which write they stem from."""
    files = _read(spark, table, "files", versions)
    return files.groupBy("file_id").agg(F.max(F.struct("asof", "version")).alias("_n")).select("file_id", "_n.version", "_n.asof")


def read(spark: SparkSession, table: str, part: str, versions: list[int] | None = None) -> DataFrame:
    """The newest rows of every file in a part."""
    versions = committed(spark, table) if versions is None else versions
    rows = _read(spark, table, part, versions)
    found = rows.where(F.col("version").isin(versions)).join(_newest(spark, table, versions).drop("asof"), ["file_id", "version"])
    return found.select(*[c for c in rows.columns if c != "version"])


def _small(spark: SparkSession, table: str) -> list[int]:
    """The versions to put together: the smaller ones, up to those that are larger than all below them."""
    parts = _parts(spark, table)
    sizes = sorted((sum(folders.size(spark, f"{table}/{p}/version={v}") for p in parts), v) for v in committed(spark, table))
    chosen, total = [], 0
    for n, (size, version) in enumerate(sizes):
        if n > 1 and size > total:
            break
        chosen.append(version)
        total += size
    return chosen


def compact(spark: SparkSession, table: str, versions: list[int] | None = None) -> int:
    """Put some versions (default: all) together into a new one; the version written.

    Rows keep the number of the write that they stem from, so a write that was begun before and ends later still wins.
    Files without rows stay listed, since an older version may hold rows of theirs, unless all versions are put together and no
    write is open.
    """
    live = committed(spark, table)
    versions = live if versions is None else versions
    number = claim(spark, table)
    open_ = {int(n) for n in folders.names(spark, f"{table}/claims") if n.isdigit()} - {number, *live, *_merged(spark, table)}
    newest = _newest(spark, table, versions)
    held = None
    for part in _parts(spark, table):
        if part == "files" or not set(versions) & set(_versions(spark, table, part)):
            continue
        rows = read(spark, table, part, versions)
        rows.write.mode("overwrite").parquet(f"{table}/{part}/version={number}")
        ids = spark.read.parquet(f"{table}/{part}/version={number}").select("file_id")
        held = ids if held is None else held.union(ids)
    if set(versions) == set(live) and not open_ and held is not None:
        newest = newest.join(held.distinct(), "file_id", "left_semi")
    newest.select("file_id", "asof").write.mode("overwrite").parquet(f"{table}/files/version={number}")
    folders.create_new(spark, f"{table}/commits/{number}.merged", json.dumps(sorted(versions)))
    return number


def vacuum(spark: SparkSession, table: str) -> list[int]:
    """Remove the folders of versions that have been put together; readers that began before may still need them."""
    gone = sorted(set(_merged(spark, table)) - set(committed(spark, table)))
    for part in _parts(spark, table):
        for version in set(gone) & set(_versions(spark, table, part)):
            folders.remove(spark, f"{table}/{part}/version={version}")
    return gone
