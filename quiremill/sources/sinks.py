"""Writers."""
from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


XML_ROWS = 20_000                # rows of an XML file, which is read by one task as a whole


def write_table(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists", **options) -> None:
    """Write a table in any supported format; unknown formats raise."""
    fmt = fmt.lower().lstrip(".")
    writer = df.write.mode(mode).options(**options)
    if fmt in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").option("escape", '"').csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    elif fmt in ("json", "ndjson"):
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "xml":
        writer.format("xml").option("rowTag", options.get("rowTag", "row")).option(
            "maxRecordsPerFile", options.get("maxRecordsPerFile", XML_ROWS)).save(path)
    elif fmt == "feather":
        write_parts(df, path, "feather", _feather_part)
    elif fmt in ("yaml", "yml"):
        write_parts(df, path, "yaml", _yaml_part)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def write_jdbc(df: DataFrame, url: str, table: str = "data", mode: str = "errorifexists",
               partitions: int | None = None, properties: dict[str, str] | None = None) -> None:
    """Write to a database table, ``data`` by default, over a bounded number of connections."""
    df = df.coalesce(partitions) if partitions else df
    df.write.mode(mode).jdbc(url, table, properties=properties or {})


FILE_BYTES = 16 * 1024 * 1024     # a part goes on in another file at about so many bytes of its rows: readers hold a file at a time
PIECE_ROWS = 1_000               # rows written at a time


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(at, PIECE_ROWS)


def _feather_part(batches: Iterator[pa.RecordBatch], path: str) -> int:
    rows, writer = 0, None
    with open(path, "wb") as out:
        for batch in batches:
            writer = writer or pa.ipc.new_file(out, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer:
            writer.close()
    return rows


def _yaml_part(batches: Iterator[pa.RecordBatch], path: str) -> int:
    import yaml
    rows = 0
    with open(path, "w", encoding="utf-8") as out:
        for batch in batches:
            if batch.num_rows:
                yaml.dump(batch.to_pylist(), out, Dumper=getattr(yaml, "CSafeDumper", yaml.SafeDumper),
                          allow_unicode=True, sort_keys=False)
            rows += batch.num_rows
    return rows


def _files_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
    """The rows of a part, file by file; each is to be read before the next."""
    pieces = _pieces(batches)

    def one(piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held = 0
        while piece is not None:
            yield piece
            held += piece.nbytes
            if held >= FILE_BYTES:
                return
            piece = next(pieces, None)

    while (first := next(pieces, None)) is not None:
        yield one(first)


def write_parts(df: DataFrame, path: str, ext: str, write_part) -> None:
    """Files of bounded size per partition, written batch by batch into a mounted shared folder.

    Names are fixed by the partition and the number of the file, and all files of a task appear by renames when the last one is written,
    so a task that runs again replaces its own files and never leaves half of one.
    """
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError("this format is written through a mounted folder, not an object store")
    os.makedirs(path, exist_ok=False)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"{path}/part-{task.partitionId():05d}"
        rows, drafts = 0, []
        for part in _files_of(batches):
            drafts.append(f"{stem}.{len(drafts)}.{task.taskAttemptId()}.tmp")
            rows += write_part(part, drafts[-1])
        target = lambda n: f"{stem}-{n:05d}.{ext}" if n else f"{stem}.{ext}"
        for n, draft in enumerate(drafts):
            os.replace(draft, target(n))
        n = len(drafts)
        while os.path.exists(target(n)):                  # of an earlier attempt that dealt its rows otherwise
            os.unlink(target(n))
            n += 1
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    df.mapInArrow(save, "rows bigint").agg(F.sum("rows")).collect()


def safe_name(c: str | Column) -> Column:
    """Sheet name with everything but letters, digits, blank, ``_`` and ``-`` replaced by ``_``."""
    return F.regexp_replace(c, r"[^\p{L}\p{N} _-]", "_")


def write_by_sheet(df: DataFrame, path: str, fmt: str = "parquet", column: str = "sheet") -> None:
    """One folder per sheet. Rows are not regrouped first, so a huge sheet is written by many tasks."""
    tagged = df.withColumn("sheet_safe", safe_name(column))
    tagged.write.partitionBy("sheet_safe").format(fmt).save(path)


def export_dataset(samples: DataFrame, path: str, split_col: str = "split") -> None:
    """JSON lines in one folder per split."""
    samples.write.partitionBy(split_col).json(path)


def export_entities(entities: DataFrame, path: str, entity_type: str = "all", fmt: str = "csv") -> None:
    """One entity type, or all, as CSV or JSON."""
    write_table(entities_of(entities, entity_type), path, fmt)


def entities_of(entities: DataFrame, entity_type: str = "all") -> DataFrame:
    return entities if entity_type == "all" else entities.where(F.col("entity_type") == entity_type)
