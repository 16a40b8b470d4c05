"""Readers. Formats Spark knows go to ``spark.read``; the others are parsed per file inside tasks."""
from __future__ import annotations

import io
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiremill.session import written


def _fmt(fmt: str) -> str:
    return fmt.lower().lstrip(".")


def read_table(spark: SparkSession, path: str, fmt: str, schema: str | T.StructType | None = None, **options) -> DataFrame:
    """Read a table of any supported format; unknown formats raise."""
    fmt = _fmt(fmt)
    if fmt in ("csv", "txt", "tsv"):
        return read_delimited(spark, path, "\t" if fmt == "tsv" else ",", schema, **options)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt in ("json", "ndjson"):
        return read_json(spark, path, schema)
    if fmt == "xml":
        return read_xml(spark, path, schema=schema, **options)
    if fmt in ("yaml", "yml"):
        return read_yaml(spark, path, schema)
    if fmt in ("feather", "arrow"):
        return read_feather(spark, path, schema)
    if fmt in ("html", "htm"):
        return read_html_files(spark, path, **options)
    if fmt == "jdbc":
        return read_jdbc(spark, path, **options)
    raise ValueError(f"unsupported format: {fmt}")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema: str | T.StructType | None = None,
                   multi_line: bool = False, infer_rows: int | None = None) -> DataFrame:
    """Delimited text with a header; values that do not fit a declared type become NULL.

    Without a schema, types are inferred from all lines, so every value fits its column.
    ``infer_rows`` looks at the first lines only, which spares a scan; later values that do not fit
    are then NULL. Quoted line breaks need ``multi_line``, which makes a file one task.
    """
    options = {"header": True, "sep": sep, "mode": "PERMISSIVE", "multiLine": multi_line, "escape": '"'}
    if schema is None:
        if infer_rows is None:
            return spark.read.options(**options, inferSchema=True).csv(path)
        head = [r["value"] for r in spark.read.text(path).take(infer_rows)]
        schema = spark.read.options(**options, inferSchema=True).csv(spark.sparkContext.parallelize(head, 1)).schema
    return spark.read.options(**options).schema(schema).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON arrays and files with one object per line, told apart by each file's first character.

    A folder may hold both. Names of array files come to the driver, as the listing of any table does.
    """
    # Lines of a file's first block are walked in order by one task, so the smallest row number is the first line.
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.substring(F.trim("value"), 1, 1).alias("first"), F.monotonically_increasing_id().alias("row"))
    opening = lines.groupBy("file").agg(F.min_by("first", F.struct("at", "row")).alias("first"))
    files = {True: [], False: []}
    for r in opening.collect():
        files[r["first"] == "["].append(r["file"])
    reader = lambda array: (spark.read.option("multiLine", array) if schema is None
                            else spark.read.option("multiLine", array).schema(schema))
    if not (files[True] and files[False]):
        return reader(bool(files[True])).json(path)
    if schema is None:        # one schema for both, from all values of both
        both = reader(True).json(files[True]).limit(0).unionByName(reader(False).json(files[False]).limit(0), allowMissingColumns=True)
        schema = both.schema
    return reader(True).json(files[True]).unionByName(reader(False).json(files[False]))


def read_xml(spark: SparkSession, path: str, row_tag: str = "row", schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema is not None else reader).load(path)


REJECTED = "_rejected"


def read_with_rejects(spark: SparkSession, path: str, fmt: str, schema: str | T.StructType, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, rejects, totals) of delimited text, JSON lines or XML with a declared schema.

    A record that does not fit the schema is none of the rows: it stands in the rejects as (file, block_start, record), with the start
    of the block of the file that its task read. Totals are (file, rows, rejected). The files are parsed
    once, into a table that all three read.
    """
    kinds = {"csv": ("csv", {"sep": ",", "escape": '"'}), "tsv": ("csv", {"sep": "\t", "escape": '"'}), "json": ("json", {}), "xml": ("xml", {"rowTag": "row"})}
    fmt = {"txt": "csv", "ndjson": "json"}.get(_fmt(fmt), _fmt(fmt))
    if fmt not in kinds:
        raise ValueError(f"no rejects are kept for {fmt}")
    name, own = kinds[fmt]
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*schema.fields, T.StructField(REJECTED, T.StringType())])
    reader = spark.read.format(name).schema(wide).options(**{"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED, **own, **options})
    parsed = written(reader.load(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block_start")), "parsed")
    bad = F.col(REJECTED).isNotNull()
    rows = parsed.where(~bad).select(*schema.fieldNames())
    rejects = parsed.where(bad).select(F.col("_file").alias("file"), F.col("_block_start").alias("block_start"), F.col(REJECTED).alias("record"))
    totals = parsed.groupBy(F.col("_file").alias("file")).agg(F.count_if(~bad).alias("rows"), F.count_if(bad).alias("rejected"))
    return rows, rejects, totals


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, partitions: int = 32,
              properties: dict[str, str] | None = None, catalog_query: str | None = None) -> DataFrame:
    """A database table, read in parallel ranges of a numeric column when one is named.

    Without a table name the first one by name is taken from ``catalog_query``, a
    query of the source that lists its tables in its first column.
    """
    properties = properties or {}
    if table is None:
        if not catalog_query:
            raise ValueError("name a table or give a query that lists the tables")
        names = spark.read.jdbc(url, f"({catalog_query}) t", properties=properties)
        first = names.select(F.min(names.columns[0])).first()[0]
        if first is None:
            raise ValueError("the database has no tables")
        table = first
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=properties)
    if lower is None or upper is None:
        bounds = spark.read.jdbc(url, f"(SELECT MIN({partition_column}) lo, MAX({partition_column}) hi FROM {table}) b",
                                 properties=properties).first()
        lower, upper = bounds[0] or 0, bounds[1] or 0
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties)


# --- formats parsed in Python tasks ----------------------------------------------------

def _files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def _yaml_records(content: bytes) -> Iterator:
    """The items of a YAML list, or its one other value, each built from the parser's events when its turn comes."""
    import yaml
    from yaml.composer import Composer
    from yaml.constructor import SafeConstructor
    from yaml.resolver import Resolver

    if not hasattr(yaml, "CSafeLoader"):
        loaded = yaml.safe_load(content)
        yield from loaded if isinstance(loaded, list) else [loaded]
        return

    class Loader(yaml.cyaml.CParser, Composer, SafeConstructor, Resolver):
        def __init__(self) -> None:
            yaml.cyaml.CParser.__init__(self, content)
            Composer.__init__(self)
            SafeConstructor.__init__(self)
            Resolver.__init__(self)

    loader = Loader()
    loader.get_event()                                    # the stream begins
    if loader.check_event(yaml.StreamEndEvent):
        yield None
        return
    loader.get_event()                                    # the document begins
    items = loader.check_event(yaml.SequenceStartEvent)
    if items:
        loader.get_event()
    while not (items and loader.check_event(yaml.SequenceEndEvent)):
        yield loader.construct_document(loader.compose_node(None, None))
        if not items:
            break
    if items:
        loader.get_event()
    loader.get_event()                                    # the document ends
    if not loader.check_event(yaml.StreamEndEvent):
        raise ValueError("a YAML file holds one document")


def read_yaml(spark: SparkSession, path: str, schema: str | T.StructType | None) -> DataFrame:
    """YAML lists of maps (one map gives one row) with a declared schema; keys outside it are ignored."""
    if schema is None:
        raise ValueError("YAML needs a declared schema")
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.fieldNames()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                records = _yaml_records(content.as_py())
                while part := list(islice(records, 1_000)):
                    text = [[None if r.get(n) is None else str(r[n]) for r in part] for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in text], names)

    as_text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = _files(spark, path, "*.y*ml").select("content").mapInArrow(parse, as_text)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_feather(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Arrow IPC files, one task per file, batch by batch. Without a schema it comes from the first file."""
    files = _files(spark, path, "*.{feather,arrow}")
    if schema is None:
        from pyspark.sql.pandas.types import from_arrow_schema
        first = files.select("content").first()
        if first is None:
            raise ValueError(f"no files in {path}")
        schema = from_arrow_schema(pa.ipc.open_file(pa.BufferReader(first["content"])).schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                source = pa.ipc.open_file(pa.BufferReader(content.as_buffer()))
                for i in range(source.num_record_batches):
                    yield source.get_batch(i)

    return files.select("content").mapInArrow(parse, schema)


class _TableParser(HTMLParser):
    """Collects the cells of the tables of one page; spans repeat their value."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[int, int, int, str]] = []
        self.tables = 0
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append({"no": self.tables, "row": -1, "taken": {}, "cell": None})
            self.tables += 1
        elif self.open and tag == "tr":
            self._close()
            self.open[-1]["row"] += 1
            self.open[-1]["col"] = 0
        elif self.open and tag in ("td", "th") and self.open[-1]["row"] >= 0:
            self._close()
            spans = {k: int(v) for k, v in attrs if k in ("rowspan", "colspan") and v and v.isdigit()}
            self.open[-1]["cell"] = ([], spans)

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close()
            if tag == "table":
                self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][0].append(data)

    def _close(self) -> None:
        table = self.open[-1]
        if not table["cell"]:
            return
        parts, spans = table["cell"]
        table["cell"] = None
        value = " ".join("".join(parts).split())
        while (table["row"], table["col"]) in table["taken"]:
            table["col"] += 1
        for r in range(table["row"], table["row"] + max(spans.get("rowspan", 1), 1)):
            for c in range(table["col"], table["col"] + max(spans.get("colspan", 1), 1)):
                table["taken"][(r, c)] = True
                self.cells.append((table["no"], r, c, value))
        table["col"] += max(spans.get("colspan", 1), 1)


CELLS_HELD = 50_000          # cells of many small pages that leave a task together


def _cells_of(key: str, first_only: bool):
    """Batches (key, html) to batches of cells: one page is parsed at a time, the cells of many leave together."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cells = [], []

            def rows() -> pa.RecordBatch:
                kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string())
                columns = [keys, *(zip(*cells) if cells else ([],) * 4)]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [key, "table_no", "row", "col", "value"])

            for page, text in zip(batch.column(0), batch.column(1)):
                parser = _TableParser()
                parser.feed(text.as_py())
                parser.close()
                found = [c for c in parser.cells if c[0] == 0] if first_only else parser.cells
                keys += [page.as_py()] * len(found)
                cells += found
                if len(cells) >= CELLS_HELD:
                    yield rows()
                    keys, cells = [], []
            yield rows()
    return parse


def html_cells(pages: DataFrame, key: str = "page_id", html: str = "html", first_only: bool = False) -> DataFrame:
    """Cells (key, table_no, row, col, value) of the tables in HTML pages.

    Pages without a table never leave the JVM.
    """
    kind = dict(pages.dtypes)[key]
    tabular = pages.where(F.lower(html).contains("<table")).select(key, html)
    return tabular.mapInArrow(_cells_of(key, first_only), f"{key} {kind}, table_no int, row int, col int, value string")


def read_html_files(spark: SparkSession, path: str, first_only: bool = False) -> DataFrame:
    """Cells of all tables of every HTML file, or of its first one, keyed by path."""
    pages = _files(spark, path).select(F.col("path").alias("page_id"), F.col("content").cast("string").alias("html"))
    return html_cells(pages, first_only=first_only)


# --- sheets and folders ------------------------------------------------------------------

def select_sheets(df: DataFrame, sheets: list[str] | None, column: str = "sheet") -> DataFrame:
    """Rows of the named sheets; names that do not exist are ignored. Prunes partitions by sheet."""
    return df.where(F.col(column).isin(sheets)) if sheets else df


def list_sheets(df: DataFrame, column: str = "sheet") -> DataFrame:
    return df.select(column).distinct()


def merge_folder(spark: SparkSession, glob: str, fmt: str, **options) -> DataFrame:
    """All files of a folder as one table with the file name of every row."""
    df = read_table(spark, glob, fmt, **options)
    return df.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes and newest change per extension below a folder, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", "length", "modificationTime")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.groupBy(ext.alias("format")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))
