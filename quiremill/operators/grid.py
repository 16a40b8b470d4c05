"""Cell grids, header rules and positioned words."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiremill.functions import labels as L
from quiremill.functions import values as V
from quiremill.functions.cleaning import strip

# Cells: (table_id, row, col, value); headers: (table_id, col, name).


def rows_to_cells(df: DataFrame, table_id: Column, row_id: str, cols: list[str] | None = None) -> DataFrame:
    """One line per cell; NULL and NaN become empty text, values are stripped."""
    cols = cols or [c for c in df.columns if c != row_id]
    types = dict(df.dtypes)

    def text(c: str) -> Column:
        value = F.col(c)
        if types[c] in ("double", "float"):
            value = F.nanvl(value, F.lit(None).cast(types[c]))
        return F.coalesce(strip(value.cast("string")), F.lit(""))

    cells = F.array(*[
        F.struct(F.lit(i).alias("col"), F.lit(c).alias("header"), text(c).alias("value")) for i, c in enumerate(cols)
    ])
    return df.select(table_id.alias("table_id"), F.col(row_id).alias("row"), F.inline(cells))


def cells_to_rows(cells: DataFrame, headers: list[str], width: int) -> DataFrame:
    """Records of a grid: one column per header, ``col_N`` where a header is missing.

    The columns are known, so one grouped aggregation does the pivot.
    """
    names = [headers[i] if i < len(headers) else f"col_{i}" for i in range(width)]
    picks = [F.max(F.when(F.col("col") == i, F.col("value"))).alias(n) for i, n in enumerate(names)]
    return cells.groupBy("table_id", "row").agg(*picks)


def cells_to_grid(cells: DataFrame) -> DataFrame:
    """Dense rows (table_id, row, values): every cell of the rectangle, ``""`` where none is stored."""
    size = cells.groupBy("table_id").agg(F.max("row").alias("_rows"), F.max("col").alias("_cols"))
    stored = cells.groupBy("table_id", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", F.col("value")))).alias("_cells")
    )
    every = size.select("table_id", "_cols", F.explode(F.sequence(F.lit(0), F.col("_rows"))).alias("row"))
    filled = every.join(stored, ["table_id", "row"], "left")
    values = F.transform(
        F.sequence(F.lit(0), F.col("_cols")),
        lambda c: F.coalesce(F.element_at(F.coalesce("_cells", F.create_map().cast("map<int,string>")), c), F.lit("")),
    )
    return filled.select("table_id", "row", values.alias("values"))


def header_tables(cells: DataFrame, all_filled: bool = False) -> DataFrame:
    """(table_id, has_header): whether the first row of each table is a header.

    Default rule: no non-empty cell of the row is a plain number (dots and commas
    ignored). ``all_filled``: every cell of the row is non-empty.
    """
    value = strip("value")
    digits = F.translate(value, ".,", "").rlike(r"(?U)^\d+$")
    is_header = F.bool_and(value != "") if all_filled else F.bool_and((value == "") | ~digits)
    return cells.where("row = 0").groupBy("table_id").agg(is_header.alias("has_header"))


def promote_header(cells: DataFrame, all_filled: bool = False) -> DataFrame:
    """Data cells with their header: promoted first row, or ``Column N`` names.

    Only first-row cells are grouped; the cells then meet their table's header
    through an equi-join that AQE may broadcast or split when one table is huge.
    """
    flags = header_tables(cells, all_filled)
    names = cells.where("row = 0").select("table_id", "col", strip("value").alias("_name"))
    joined = cells.join(flags, "table_id", "left").join(names, ["table_id", "col"], "left")
    promoted = F.coalesce("has_header", F.lit(False))
    return joined.where(~(promoted & (F.col("row") == 0))).select(
        "table_id",
        (F.col("row") - promoted.cast("int")).alias("row"),
        "col",
        F.when(promoted, F.coalesce("_name", F.lit(""))).otherwise(
            F.concat(F.lit("Column "), (F.col("col") + 1).cast("string"))).alias("header"),
        strip("value").alias("value"),
    )


def dedup_headers(headers: DataFrame) -> DataFrame:
    """Unique names per table: blank becomes ``col``, repeats get ``_1``, ``_2``.

    A table has one header row, so the window holds its column count.
    """
    name = F.when(strip("name") == "", F.lit("col")).otherwise(strip("name"))
    seen = F.row_number().over(Window.partitionBy("table_id", "_name").orderBy("col")) - 1
    return headers.withColumn("_name", name).select(
        "table_id", "col",
        F.when(seen == 0, F.col("_name")).otherwise(F.concat_ws("_", "_name", seen.cast("string"))).alias("name"),
    )


def math_cells(cells: DataFrame) -> DataFrame:
    """Addresses ``R<row>C<col>`` of cells that hold LaTeX."""
    address = F.concat(F.lit("R"), F.col("row").cast("string"), F.lit("C"), F.col("col").cast("string"))
    return cells.where(L.has_math("value")).select("table_id", address.alias("address"), "value")


def formula_cells(cells: DataFrame) -> DataFrame:
    """Cells whose text starts with ``=``, with spreadsheet addresses such as ``AB12``."""
    return cells.where(F.col("value").startswith("=")).select(
        "table_id", F.concat(column_letters(F.col("col")), (F.col("row") + 1).cast("string")).alias("address"),
        F.col("value").alias("formula"),
    )


def column_letters(index: Column) -> Column:
    """Spreadsheet letters of a zero-based column number, up to three letters."""
    letter = lambda n: F.char((n % 26 + 65).cast("bigint"))
    tens = F.floor(index / 26) - 1
    return F.when(index < 26, letter(index)).when(index < 702, F.concat(letter(tens), letter(index))).otherwise(
        F.concat(letter(F.floor(tens / 26) - 1), letter(tens), letter(index))
    )


def chem_cells(cells: DataFrame) -> DataFrame:
    return cells.where(L.has_chemical("value"))


def union_tables(cells: DataFrame, doc: str = "doc_id", table: str = "table_no") -> DataFrame:
    """Rows of all tables of a document under the header of its first table.

    Data cells keep (table, row) as their order; cells beyond the header width go under ``col_<n>``.
    """
    first = cells.groupBy(doc).agg(F.min(table).alias("_first"))
    header = (
        cells.where("row = 0").join(first, doc).where(F.col(table) == F.col("_first"))
        .select(doc, "col", F.coalesce(F.nullif(F.col("value"), F.lit("")),
                                       F.concat(F.lit("col_"), F.col("col").cast("string"))).alias("header"))
    )
    named = F.coalesce("header", F.concat(F.lit("col_"), F.col("col").cast("string")))
    return cells.where("row > 0").join(header, [doc, "col"], "left").select(doc, table, "row", "col", named.alias("header"), "value")


# --- positioned words: (doc_id, page, text, top, left, right, bottom) ------------------------

DENSE = 100_000     # words of whole pages that are placed in one go; a longer page is one go


def _marks_of(page: np.ndarray, value: pa.ChunkedArray, gap: int, halfway: bool) -> np.ndarray:
    """Number, within its page, of the mark that each word belongs to; 0 without a coordinate.

    A page's marks lie more than ``gap`` apart, its least value first. A mark reaches to the pixel before the next one, or ``halfway``.
    """
    known = value.is_valid().to_numpy()
    if not known.any():
        return np.zeros(len(page), np.int32)
    pixels = value.fill_null(0).to_numpy().astype(np.int64)
    least = pixels[known].min()
    span = pixels[known].max() - least + gap + 2          # one axis for all pages, which lie more than a gap apart
    at = page * span + np.where(known, pixels - least, 0)
    seen = np.unique(at[known])
    following, chosen, i = np.searchsorted(seen, seen + gap, "right").tolist(), [], 0
    while i < len(seen):
        chosen.append(i)
        i = following[i]
    marks = seen[chosen]
    owner = marks // span
    ends = marks[1:] - 1
    if halfway:
        ends = np.where(owner[1:] == owner[:-1], (marks[1:] + marks[:-1]) // 2, ends)
    number = np.searchsorted(ends, at) - np.searchsorted(owner, page)
    return np.where(known, number, 0).astype(np.int32)


def _cells(words: pa.Table, sizes: list[int], keys: list[str]) -> pa.RecordBatch:
    """The cells of whole pages, whose words follow each other."""
    page = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    row = _marks_of(page, words["top"], V.ROW_REACH, False)
    col = _marks_of(page, words["left"], V.COLUMN_GAP, True)
    cell = (page * (row.max() + 1) + row) * (col.max() + 1) + col
    order = pc.sort_indices(
        pa.table({"cell": cell, "left": words["left"], "top": words["top"], "text": words["text"]}),
        sort_keys=[(c, "ascending") for c in ("cell", "left", "top", "text")], null_placement="at_start")
    cell = cell[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    text = words["text"].take(order)
    before = np.concatenate([[0], np.cumsum(text.is_valid().to_numpy())])
    lists = pa.ListArray.from_arrays(
        pa.array(before[np.append(first, len(cell))], pa.int32()), text.drop_null().combine_chunks())
    lead = order.to_numpy()[first]
    found = [words[k].take(pa.array(lead)).combine_chunks() for k in keys]
    return pa.RecordBatch.from_arrays(
        [*found, pa.array(row[lead]), pa.array(col[lead]), pc.binary_join(lists, " ")], [*keys, "row", "col", "value"])


def words_to_table(words: DataFrame, page_keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """(…, row, col, value): words gathered into table cells by position.

    Rows start at the first word more than 12 pixels below the row before; columns
    start where left edges are more than 20 pixels apart; a word goes to the nearest
    column, the earlier one if two are as near. A window brings a page's words together with their number; many
    pages are then placed at once, and a task holds one page and a batch of words at a time.
    """
    keys, at_once = list(page_keys), DENSE
    near = words.dropna(subset=keys).select(
        *keys, "text", F.col("top").cast("int").alias("top"), F.col("left").cast("int").alias("left"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_size"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < held[0].column(len(keys) + 3)[0].as_py():
                continue
            table = pa.Table.from_batches(held)
            size, start, end, sizes = table["_size"].to_numpy(), 0, 0, []
            while end < rows and end + size[end] <= rows:
                sizes.append(int(size[end]))
                end += sizes[-1]
                if end - start >= at_once:
                    yield _cells(table.slice(start, end - start), sizes, keys)
                    start, sizes = end, []
            if sizes:
                yield _cells(table.slice(start, end - start), sizes, keys)
            held, rows = table.slice(end).to_batches(), rows - end

    fields = [words.schema[k] for k in keys]
    return near.mapInArrow(place, T.StructType([*fields, *T.StructType.fromDDL("row int, col int, value string")]))


def words_to_blocks(words: DataFrame, page_keys: tuple[str, ...] = ("doc_id", "page"),
                    width: float = 1.0, height: float = 1.0, content_chars: int | None = None) -> DataFrame:
    """Paragraph and header blocks of each page with boxes scaled by page size.

    ``content_chars`` cuts the text of a block (``values.BLOCK_CHARS`` is the strict rule).

    Words of the same height are combined first, so the line and block windows run
    over the distinct heights of a page.
    """
    keys = list(page_keys)
    ordered = lambda order: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order, "text"))), lambda w: w["text"]), " ")
    levels = words.groupBy(*keys, "top").agg(
        ordered("left").alias("text"), F.min("left").alias("x1"), F.max("right").alias("x2"), F.max("bottom").alias("bottom"))
    by_top = Window.partitionBy(*keys).orderBy("top")
    new_line = (F.col("top") - F.lag("top").over(by_top) >= V.LINE_GAP).cast("int")
    levels = levels.withColumn("line", F.sum(F.coalesce(new_line, F.lit(0))).over(by_top))
    lines = levels.groupBy(*keys, "line").agg(
        ordered("top").alias("text"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
        F.min("x1").alias("x1"), F.max("x2").alias("x2"))
    by_line = Window.partitionBy(*keys).orderBy("line")
    new_block = (F.col("top") - F.lag("bottom").over(by_line) >= V.BLOCK_GAP).cast("int")
    lines = lines.withColumn("block", F.sum(F.coalesce(new_block, F.lit(0))).over(by_line))
    blocks = lines.groupBy(*keys, "block").agg(
        ordered("line").alias("text"), F.count(F.lit(1)).alias("n_lines"),
        F.min("x1").alias("x1"), F.min("top").alias("y1"), F.max("x2").alias("x2"), F.max("bottom").alias("y2"))
    tall = (F.col("y2") - F.col("y1")) / F.col("n_lines") > V.HEADER_HEIGHT
    kind = F.when((F.length("text") < V.HEADER_CHARS) & tall, "header").otherwise("paragraph")
    return blocks.select(
        *keys, "block", kind.alias("element_type"), (F.col("x1") / width).alias("x1"), (F.col("y1") / height).alias("y1"),
        (F.col("x2") / width).alias("x2"), (F.col("y2") / height).alias("y2"), "n_lines",
        (F.col("text") if content_chars is None else F.col("text").substr(1, content_chars)).alias("content"))
