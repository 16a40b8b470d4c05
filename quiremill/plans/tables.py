"""Queries over sources, sinks, cell grids, positioned words and table cleaning."""
from __future__ import annotations

from pyspark.sql import functions as F

from quiremill.functions import cleaning as FC
from quiremill.functions import labels as L
from quiremill.functions import values as V
from quiremill.operators import cleaning as C
from quiremill.operators import grid as G
from quiremill.plans import relations as rel
from quiremill.plans.registry import SQL, Tables, plan
from quiremill.plans.relations import FILES, with_
from quiremill.session import dealt, scratch_path, spread
from quiremill.sources import readers, sinks

# --- sources and sinks -----------------------------------------------------------------

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ORDERS_SQL = f"SELECT {', '.join(ORDERS)} FROM orders"
CUSTOMERS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUSTOMERS_SQL = f"SELECT {', '.join(CUSTOMERS)} FROM customer"


def _through(t: Tables, df, fmt: str, schema=None, **options):
    """Write a table in a format and read it back with the reader of that format."""
    path = scratch_path(t.spark, fmt)
    sinks.write_table(df, path, fmt)
    return readers.read_table(t.spark, path, fmt, schema, **options)


@plan("scan_parquet", ORDERS_SQL)
def scan_parquet(t: Tables):
    return readers.read_table(t.spark, t.path("orders"), "parquet").select(ORDERS)


def _wide_keys(df):
    return df.withColumns({c: F.col(c).cast("bigint") for c in ["o_orderkey", "o_custkey"]})


@plan("scan_csv", ORDERS_SQL)
def scan_csv(t: Tables):
    return _wide_keys(_through(t, t.orders.select(ORDERS), "csv"))


@plan("scan_tsv", ORDERS_SQL)
def scan_tsv(t: Tables):
    return _wide_keys(_through(t, t.orders.select(ORDERS), "tsv"))


@plan("scan_json", "SELECT doc_id, text, lang FROM documents")
def scan_json(t: Tables):
    return _through(t, t.documents.select("doc_id", "text", "lang"), "json")


@plan("scan_xml", CUSTOMERS_SQL.replace("c_nationkey", "CAST(c_nationkey AS BIGINT) AS c_nationkey"))
def scan_xml(t: Tables):
    return _through(t, t.customer.select(CUSTOMERS), "xml")


@plan("scan_yaml", CUSTOMERS_SQL)
def scan_yaml(t: Tables):
    df = t.customer.select(CUSTOMERS)
    return _through(t, df, "yaml", df.schema)


@plan("scan_feather", ORDERS_SQL)
def scan_feather(t: Tables):
    return _through(t, t.orders.select(ORDERS), "feather")


@plan("roundtrip_parquet", ORDERS_SQL)
def roundtrip_parquet(t: Tables):
    return _through(t, t.orders.select(ORDERS), "parquet")


@plan("roundtrip_csv", "SELECT doc_id, text, lang FROM documents")
def roundtrip_csv(t: Tables):
    # Texts hold line breaks, so the declared read is multi-line.
    df = t.documents.select("doc_id", "text", "lang")
    return _through(t, df, "csv", df.schema, multi_line=True)


@plan("roundtrip_json", ORDERS_SQL)
def roundtrip_json(t: Tables):
    df = t.orders.select(ORDERS)
    return _through(t, df, "ndjson", df.schema)


@plan("roundtrip_xml", ORDERS_SQL)
def roundtrip_xml(t: Tables):
    df = t.orders.select(ORDERS)
    return _through(t, df, "xml", schema=df.schema)


@plan("roundtrip_feather", "SELECT doc_id, text, n_chars FROM documents")
def roundtrip_feather(t: Tables):
    df = t.documents.select("doc_id", "text", "n_chars")
    return _through(t, df, "feather", df.schema)


@plan("html_tables", """SELECT c_custkey AS page_id, 0 AS table_no, r AS row, c AS col,
    CASE WHEN r = 0 THEN ['Name', 'Segment'][c + 1] WHEN c = 0 THEN c_name ELSE c_mktsegment END AS value
  FROM customer, (VALUES (0), (1)) a(r), (VALUES (0), (1)) b(c)""")
def html_tables(t: Tables):
    html = F.concat(
        F.lit("<html><body><p>x</p><table><tr><th>Name</th><th>Segment</th></tr><tr><td> "), F.col("c_name"),
        F.lit("</td><td><b>"), F.col("c_mktsegment"), F.lit("</b></td></tr></table></body></html>"))
    return readers.html_cells(spread(t.customer).select(F.col("c_custkey").alias("page_id"), html.alias("html")))


@plan("scan_rejects", """SELECT 'csv' AS kind, count(*) FILTER (WHERE o_orderkey % 97 <> 0) AS rows, count(*) FILTER (WHERE o_orderkey % 97 = 0) AS rejected,
    CAST(sum(o_orderkey) FILTER (WHERE o_orderkey % 97 = 0) AS BIGINT) AS rejected_keys FROM orders
  UNION ALL SELECT 'json', count(*) FILTER (WHERE o_orderkey % 89 <> 0), count(*) FILTER (WHERE o_orderkey % 89 = 0),
    CAST(sum(o_orderkey) FILTER (WHERE o_orderkey % 89 = 0) AS BIGINT) FROM orders""")
def scan_rejects(t: Tables):
    """Orders as delimited text and as JSON lines, some of them broken: good rows, rejects and the keys that rejected records still show."""
    kinds, found = "o_orderkey bigint, o_custkey bigint, o_totalprice double", None
    line = F.concat_ws(",", "o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, "?").otherwise(F.col("o_custkey").cast("string")), "o_totalprice")
    record = F.to_json(F.struct("o_orderkey", "o_custkey", "o_totalprice"))
    record = F.when(F.col("o_orderkey") % 89 == 0, F.regexp_replace(record, "}$", "")).otherwise(record)
    for fmt, text in (("csv", line), ("json", record)):
        path = scratch_path(t.spark, f"broken_{fmt}")
        spread(t.orders).select(text.alias("value")).write.text(path)
        rows, rejects, totals = readers.read_with_rejects(t.spark, path, fmt, kinds)
        key = F.regexp_extract("record", r"\d+", 0).cast("bigint")
        part = totals.agg(F.lit(fmt).alias("kind"), F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected"))
        part = part.join(rejects.agg(F.lit(fmt).alias("kind"), F.sum(key).alias("rejected_keys")), "kind")
        found = part if found is None else found.union(part)
    return found


@plan("select_sheets", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3', 'missing')")
def select_sheets(t: Tables):
    return readers.select_sheets(t.documents, ["src1", "src3", "missing"], "source").select("doc_id", "source")


@plan("list_sheets", "SELECT DISTINCT source FROM documents")
def list_sheets(t: Tables):
    return readers.list_sheets(t.documents, "source")


@plan("sheet_totals", """SELECT source, count(*) AS total_rows, CAST(max(n_chars) AS BIGINT) AS widest FROM documents GROUP BY source""")
def sheet_totals(t: Tables):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("total_rows"), F.max("n_chars").alias("widest"))


@plan("write_by_sheet", """SELECT concat(source, '_', lang) AS sheet_safe, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars
  FROM documents GROUP BY ALL""")
def write_by_sheet(t: Tables):
    path = scratch_path(t.spark, "sheets")
    named = t.documents.select("doc_id", "n_chars", F.concat("source", F.lit("/"), "lang").alias("sheet"))
    sinks.write_by_sheet(named, path)
    return t.spark.read.parquet(path).groupBy("sheet_safe").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@plan("merge_folder", "SELECT o_orderkey, o_totalprice, 'parquet' AS kind FROM orders")
def merge_folder(t: Tables):
    path = scratch_path(t.spark, "folder")
    orders = t.orders.select("o_orderkey", "o_totalprice")
    sinks.write_table(orders.where("o_totalprice < 100000"), f"{path}/a", "parquet")
    sinks.write_table(orders.where("o_totalprice >= 100000"), f"{path}/b", "parquet")
    merged = readers.merge_folder(t.spark, f"{path}/*", "parquet")
    return merged.select("o_orderkey", "o_totalprice", L.extension("source_file").alias("kind"))


@plan("export_dataset", """SELECT doc_id, CASE WHEN toxic = 1 THEN 'val' ELSE 'train' END AS split, CAST(quality AS BIGINT) AS quality FROM labels""")
def export_dataset(t: Tables):
    path = scratch_path(t.spark, "dataset")
    samples = t.labels.select("doc_id", "quality", F.when(F.col("toxic") == 1, "val").otherwise("train").alias("split"))
    sinks.export_dataset(samples, path)
    return t.spark.read.json(path).select("doc_id", "split", "quality")


@plan("table_metadata", " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS rows, CAST({c} AS BIGINT) AS columns FROM {n}"
    for n, c in [("orders", 6), ("lineitem", 11), ("events", 6), ("documents", 5), ("pages", 3)]))
def table_metadata(t: Tables):
    # Row counts come from the Parquet footers; no column is read.
    parts = [getattr(t, n) for n in ["orders", "lineitem", "events", "documents", "pages"]]
    names = ["orders", "lineitem", "events", "documents", "pages"]
    out = None
    for name, df in zip(names, parts):
        line = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))
        out = line if out is None else out.unionByName(line)
    return out


@plan("file_metadata", r"""WITH l AS (SELECT concat_ws(',', n_nationkey, n_name, n_regionkey) AS csv,
    concat('{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '","n_regionkey":', n_regionkey, '}') AS json FROM nation)
SELECT 'csv' AS format, CAST(1 AS BIGINT) AS files, CAST(sum(strlen(csv) + 1) + strlen('n_nationkey,n_name,n_regionkey') + 1 AS BIGINT) AS bytes FROM l
UNION ALL SELECT 'json', 1, CAST(sum(strlen(json) + 1) AS BIGINT) FROM l""")
def file_metadata(t: Tables):
    path = scratch_path(t.spark, "listed")
    nation = t.nation.coalesce(1)
    nation.write.option("header", True).csv(f"{path}/a")
    nation.write.json(f"{path}/b")
    return readers.file_metadata(t.spark, path).select("format", "files", "bytes")


# Bytes in hexadecimal: blanks, all but blanks, all but a line feed.
_BLANK = "(?:09|0A|0B|0C|0D|1C|1D|1E|1F|20|85|A0)"
_SOLID = "(?:0[0-8EF]|1[0-9AB]|2[1-9A-F]|[3-79BC-F][0-9A-F]|8[0-46-9A-F]|A[1-9A-F])"
_NOT_LF = "(?:0[0-9B-F]|[1-9A-F][0-9A-F])"


@plan("sniff_type", rf"""WITH c AS (SELECT concat('page ', page_id) AS name, html AS s FROM pages UNION ALL SELECT concat('doc ', doc_id), text FROM documents
    UNION ALL SELECT concat('event ', event_id), props FROM events),
  h AS (SELECT name, s, hex(encode(s)) AS x FROM c)
SELECT name, CASE WHEN starts_with(s, 'BM') THEN 'bmp' WHEN (starts_with(s, '{{') OR starts_with(s, '[')) AND json_valid(s) THEN 'json' WHEN starts_with(s, '<') THEN 'xml'
    WHEN regexp_matches(substr(x, 1, 1000), '^{_BLANK}*{_NOT_LF}*2C{_NOT_LF}*0A(?:..)*?{_SOLID}') AND regexp_matches(substr(x, 1, 1000), '^{_BLANK}*{_SOLID}{_NOT_LF}*0A') THEN 'csv'
    WHEN regexp_matches(substr(x, 1001, 2), '^[89AB]') THEN 'bin' ELSE 'txt' END AS ext FROM h""")
def sniff_type(t: Tables):
    contents = (
        t.pages.select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("name"), F.col("html").cast("binary").alias("content"))
        .union(t.documents.select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.col("text").cast("binary")))
        .union(t.events.select(F.concat(F.lit("event "), F.col("event_id").cast("string")), F.col("props").cast("binary"))))
    return contents.select("name", L.sniff_type("content").alias("ext"))


@plan("type_by_ext", with_(FILES, body="""SELECT id, CASE WHEN format IN ('xlsx', 'csv') THEN 'spreadsheet' END AS doc_type FROM files"""))
def type_by_ext(t: Tables):
    return rel.files(t).select("id", L.type_by_extension("original_name").alias("doc_type"))


@plan("file_category", with_(FILES, body="""SELECT id, CASE WHEN format IN ('pdf', 'docx') THEN 'document' WHEN format IN ('xlsx', 'csv') THEN 'spreadsheet'
  ELSE 'other' END AS category FROM files"""))
def file_category(t: Tables):
    return rel.files(t).select("id", L.file_category("format").alias("category"))


@plan("canonical_url", """
SELECT page_id, 'plain' AS kind, url FROM pages
UNION ALL SELECT page_id, 'redirect', url FROM pages
UNION ALL SELECT page_id, 'drive', concat('https://drive.google.com/uc?export=download&id=F', page_id) FROM pages
UNION ALL SELECT page_id, 'drive id', concat('https://drive.google.com/uc?export=download&id=G', page_id) FROM pages
UNION ALL SELECT page_id, 'share', concat('https://www.dropbox.com/s/', page_id, '/a.csv?dl=1') FROM pages
UNION ALL SELECT page_id, 'share bare', concat('https://www.dropbox.com/s/', page_id, '/a.csv?dl=1') FROM pages
UNION ALL SELECT page_id, 'code', concat('https://raw.githubusercontent.com/u/r/main/d/', page_id, '.csv') FROM pages""")
def canonical_url(t: Tables):
    key = F.col("page_id").cast("string")
    link = lambda kind, url: F.struct(F.lit(kind).alias("kind"), url.alias("link"))
    links = F.array(
        link("plain", F.col("url")),
        link("redirect", F.concat(F.lit("https://www.google.com/url?sa=t&url="), F.url_encode("url"))),
        link("drive", F.concat(F.lit("https://drive.google.com/file/d/F"), key, F.lit("/view"))),
        link("drive id", F.concat(F.lit("https://drive.google.com/open?id=G"), key)),
        link("share", F.concat(F.lit("https://www.dropbox.com/s/"), key, F.lit("/a.csv?dl=0"))),
        link("share bare", F.concat(F.lit("https://www.dropbox.com/s/"), key, F.lit("/a.csv"))),
        link("code", F.concat(F.lit("https://github.com/u/r/blob/main/d/"), key, F.lit(".csv"))))
    return t.pages.select("page_id", F.inline(links)).select("page_id", "kind", L.canonical_url("link").alias("url"))


# --- cell grids -----------------------------------------------------------------------------

_CELLS = """cells AS (SELECT CAST(c_nationkey AS BIGINT) AS table_id, c_custkey AS row, unnest([0, 1, 2]) AS col,
  unnest(['c_name', 'c_acctbal', 'c_mktsegment']) AS header, unnest([c_name, CAST(c_acctbal AS VARCHAR), c_mktsegment]) AS value FROM customer)"""


def _cells(t: Tables):
    return G.rows_to_cells(t.customer, F.col("c_nationkey").cast("bigint"), "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"])


@plan("rows_to_cells", with_(_CELLS, body="SELECT * FROM cells"))
def rows_to_cells(t: Tables):
    return _cells(t)


@plan("cells_to_rows", with_(_CELLS, body="""SELECT table_id, row, max(value) FILTER (WHERE col = 0) AS name,
  max(value) FILTER (WHERE col = 1) AS balance, max(value) FILTER (WHERE col = 2) AS col_2 FROM cells GROUP BY table_id, row"""))
def cells_to_rows(t: Tables):
    return G.cells_to_rows(_cells(t), ["name", "balance"], 3)


@plan("cells_to_grid", """WITH g AS (SELECT conv_id AS table_id, max(turn) AS m FROM conversations GROUP BY conv_id)
SELECT table_id, CAST(row AS INTEGER) AS row, concat(coalesce(CASE WHEN role <> 'assistant' THEN role END, ''), '|', coalesce(CAST(length(text) AS VARCHAR), '')) AS cells
FROM (SELECT table_id, unnest(range(0, m + 1)) AS row FROM g) LEFT JOIN conversations ON conv_id = table_id AND turn = row""")
def cells_to_grid(t: Tables):
    cells = t.conversations.select(
        F.col("conv_id").alias("table_id"), F.col("turn").cast("int").alias("row"),
        F.inline(F.array(F.struct(F.lit(0).alias("col"), F.col("role").alias("value")),
                         F.struct(F.lit(1).alias("col"), F.length("text").cast("string").alias("value")))))
    grid = G.cells_to_grid(cells.where("value <> 'assistant'"))
    return grid.select("table_id", "row", F.array_join("values", "|").alias("cells"))


_TURNS = """turns AS (SELECT conv_id AS table_id, CAST(turn AS INTEGER) AS row, unnest([0, 1]) AS col,
  unnest([role, CASE WHEN length(text) > 200 THEN CAST(length(text) AS VARCHAR) ELSE role END]) AS value FROM conversations)"""


def _turns(t: Tables):
    second = F.when(F.length("text") > 200, F.length("text").cast("string")).otherwise(F.col("role"))
    return t.conversations.select(
        F.col("conv_id").alias("table_id"), F.col("turn").cast("int").alias("row"),
        F.inline(F.array(F.struct(F.lit(0).alias("col"), F.col("role").alias("value")), F.struct(F.lit(1).alias("col"), second.alias("value")))))


@plan("promote_header", with_(_TURNS, body=r"""SELECT c.table_id, c.row - (CASE WHEN h.ok THEN 1 ELSE 0 END) AS row, c.col,
    CASE WHEN h.ok THEN n.value ELSE concat('Column ', c.col + 1) END AS header, c.value
  FROM turns c LEFT JOIN (SELECT table_id, bool_and(NOT regexp_full_match(value, '\d+')) AS ok FROM turns WHERE row = 0 GROUP BY table_id) h USING (table_id)
  LEFT JOIN turns n ON n.table_id = c.table_id AND n.col = c.col AND n.row = 0
  WHERE NOT (coalesce(h.ok, false) AND c.row = 0)"""))
def promote_header(t: Tables):
    return G.promote_header(_turns(t))


@plan("dedup_headers", """SELECT table_id, col, CASE WHEN k = 0 THEN name ELSE concat(name, '_', k) END AS name FROM (
  SELECT p_size AS table_id, p_partkey AS col, CASE WHEN p_brand = 'Brand#11' THEN 'col' ELSE p_brand END AS name,
    row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) - 1 AS k FROM part)""")
def dedup_headers(t: Tables):
    name = F.when(F.col("p_brand") == "Brand#11", F.lit("  ")).otherwise(F.concat(F.col("p_brand"), F.lit(" ")))
    return G.dedup_headers(t.part.select(F.col("p_size").alias("table_id"), F.col("p_partkey").alias("col"), name.alias("name")))


@plan("null_sentinels", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS o_orderpriority FROM orders""")
def null_sentinels(t: Tables):
    marked = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderpriority") == "5-LOW", "nan").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return C.null_sentinels(marked)


_FORMULAS = r"""f AS (SELECT CAST(p_size AS BIGINT) AS table_id, CAST(p_partkey AS INTEGER) AS row, 1 AS col,
  CASE WHEN p_partkey % 9 = 4 THEN concat('=A', p_size, '*2') WHEN p_retailprice > 950 THEN concat('area $x^2$ and \frac{', p_size, '}{2}')
    WHEN p_retailprice > 930 THEN concat('H2O ', p_brand) ELSE p_name END AS value FROM part)"""


def _formulas(t: Tables):
    size = F.col("p_size").cast("string")
    value = (F.when(F.col("p_partkey") % 9 == 4, F.concat(F.lit("=A"), size, F.lit("*2")))
             .when(F.col("p_retailprice") > 950, F.concat(F.lit("area $x^2$ and \\frac{"), size, F.lit("}{2}")))
             .when(F.col("p_retailprice") > 930, F.concat(F.lit("H2O "), F.col("p_brand"))).otherwise(F.col("p_name")))
    return t.part.select(F.col("p_size").cast("bigint").alias("table_id"), F.col("p_partkey").cast("int").alias("row"),
                         F.lit(1).alias("col"), value.alias("value"))


@plan("formula_cells", with_(_FORMULAS, body="SELECT table_id, concat('B', row + 1) AS address, value AS formula FROM f WHERE starts_with(value, '=')"))
def formula_cells(t: Tables):
    return G.formula_cells(_formulas(t))


@plan("math_cells", with_(_FORMULAS, body=r"SELECT table_id, concat('R', row, 'C1') AS address, value FROM f WHERE regexp_matches(value, '\$[^$]+\$|\\frac')"))
def math_cells(t: Tables):
    return G.math_cells(_formulas(t))


@plan("chem_cells", with_(_FORMULAS, body=r"SELECT * FROM f WHERE regexp_matches(value, '\b(?:[A-Z][a-z]?\d*){2,}\b|\b[A-Z][a-z]?\d+\b')"))
def chem_cells(t: Tables):
    return G.chem_cells(_formulas(t))


@plan("union_tables", with_(_TURNS, body="""SELECT doc_id, table_no, row, t.col, coalesce(nullif(h.value, ''), concat('col_', t.col)) AS header, t.value
  FROM (SELECT length(role) + CAST(floor(table_id / 10) AS BIGINT) * 100 AS doc_id, table_id AS table_no, row, col, turns.value FROM turns JOIN (SELECT conv_id, min(role) AS role FROM conversations GROUP BY 1) ON conv_id = table_id
    UNION ALL SELECT length(role) + CAST(floor(conv_id / 10) AS BIGINT) * 100, conv_id, 1, 7, role FROM (SELECT conv_id, min(role) AS role FROM conversations GROUP BY 1)) t
  LEFT JOIN (SELECT doc_id, col, value FROM (SELECT length(role) + CAST(floor(table_id / 10) AS BIGINT) * 100 AS doc_id, table_id, row, col, turns.value, min(table_id) OVER (PARTITION BY length(role) + CAST(floor(table_id / 10) AS BIGINT) * 100) AS first FROM turns JOIN (SELECT conv_id, min(role) AS role FROM conversations GROUP BY 1) ON conv_id = table_id) WHERE table_id = first AND row = 0) h USING (doc_id, col)
  WHERE row > 0"""))
def union_tables(t: Tables):
    roles = t.conversations.groupBy(F.col("conv_id").alias("table_id")).agg(F.min("role").alias("role"))
    roles = roles.withColumn("n", F.length("role").cast("bigint"))
    # A cell beyond the width of every header belongs to each table.
    beyond = roles.select("table_id", F.lit(1).alias("row"), F.lit(7).alias("col"), F.col("role").alias("value"))
    every = _turns(t).select("table_id", "row", "col", "value").unionByName(beyond)
    cells = every.join(roles, "table_id").select(
        (F.col("n") + F.floor(F.col("table_id") / 10) * 100).alias("doc_id"), F.col("table_id").alias("table_no"), "row", "col", "value")
    return G.union_tables(cells)


# --- positioned words -------------------------------------------------------------------------

_WORDS = r"""words AS (
  SELECT doc_id, CAST(w // 400 + 1 AS INTEGER) AS page, word AS text, (w // 10 % 40) * 16 + w % 3 AS top, w % 10 * 45 + length(word) % 5 AS lft,
    w % 10 * 45 + length(word) % 5 + 6 * length(word) AS rgt, (w // 10 % 40) * 16 + w % 3 + 10 + 4 * (w // 10 % 3) AS bottom
  FROM (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS w
    FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS l FROM documents))
  WHERE word <> '')"""


PAGE_WORDS = 400


def words(t: Tables):
    """Every word of every document on pages of 40 lines with ten words each.

    Documents are cut into pages, and pages dealt out, before words: a text moves once and packed, and whatever
    groups or joins words by their page finds them in one place.
    """
    cut = t.documents.select("doc_id", F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ").alias("words"))
    starts = F.sequence(F.lit(1), F.array_size("words"), F.lit(PAGE_WORDS))
    texts = F.transform(starts, lambda n: F.array_join(F.slice("words", n, PAGE_WORDS), " "))
    pages = cut.select("doc_id", F.posexplode(texts).alias("number", "words")).select(
        "doc_id", (F.col("number") + 1).alias("page"), "words")
    each = dealt(pages, t.documents, "doc_id", "page").select(
        "doc_id", "page", F.posexplode(F.split("words", " ")).alias("n", "text")).where("text <> ''")
    w = (F.col("page") - 1) * PAGE_WORDS + F.col("n")
    line = F.floor(w / 10).cast("int")
    top = (line % 40) * 16 + w % 3
    left = (w % 10) * 45 + F.length("text") % 5
    return each.select(
        "doc_id", "page", "text", top.alias("top"), left.alias("left"),
        (left + 6 * F.length("text")).alias("right"), (top + 10 + 4 * (line % 3)).alias("bottom"))


@plan("words_to_table", "WITH RECURSIVE " + _WORDS + r""",
tops AS (SELECT DISTINCT doc_id, page, top FROM words), lefts AS (SELECT DISTINCT doc_id, page, lft FROM words),
r(doc_id, page, mark) AS (SELECT doc_id, page, min(top) FROM tops GROUP BY ALL
  UNION ALL SELECT r.doc_id, r.page, min(t.top) FROM r JOIN tops t ON t.doc_id = r.doc_id AND t.page = r.page AND t.top > r.mark + 12 GROUP BY ALL),
c(doc_id, page, mark) AS (SELECT doc_id, page, min(lft) FROM lefts GROUP BY ALL
  UNION ALL SELECT c.doc_id, c.page, min(t.lft) FROM c JOIN lefts t ON t.doc_id = c.doc_id AND t.page = c.page AND t.lft > c.mark + 20 GROUP BY ALL),
ri AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY mark) - 1 AS i FROM r),
ci AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY mark) - 1 AS i FROM c),
tr AS (SELECT doc_id, page, top, max(i) AS row FROM tops JOIN ri USING (doc_id, page) WHERE mark <= top GROUP BY ALL),
lc AS (SELECT doc_id, page, lft, arg_min(i, abs(mark - lft) * 100000 + i) AS col FROM lefts JOIN ci USING (doc_id, page) GROUP BY ALL)
SELECT doc_id, page, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, string_agg(text, ' ' ORDER BY lft, top, text) AS value
FROM words JOIN tr USING (doc_id, page, top) JOIN lc USING (doc_id, page, lft) GROUP BY ALL""")
def words_to_table(t: Tables):
    return G.words_to_table(words(t))


@plan("words_to_blocks", with_(_WORDS, body=r""",
lv AS (SELECT doc_id, page, top, string_agg(text, ' ' ORDER BY lft, text) AS text, min(lft) AS x1, max(rgt) AS x2, max(bottom) AS bottom FROM words GROUP BY ALL),
ln AS (SELECT *, sum(CASE WHEN top - prev >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY top) AS line
  FROM (SELECT *, lag(top) OVER (PARTITION BY doc_id, page ORDER BY top) AS prev FROM lv)),
l2 AS (SELECT doc_id, page, line, string_agg(text, ' ' ORDER BY top) AS text, min(top) AS top, max(bottom) AS bottom, min(x1) AS x1, max(x2) AS x2 FROM ln GROUP BY ALL),
b AS (SELECT *, sum(CASE WHEN top - prev >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line) AS block
  FROM (SELECT *, lag(bottom) OVER (PARTITION BY doc_id, page ORDER BY line) AS prev FROM l2)),
g AS (SELECT doc_id, page, block, string_agg(text, ' ' ORDER BY line) AS text, count(*) AS n_lines, min(x1) AS x1, min(top) AS y1, max(x2) AS x2, max(bottom) AS y2 FROM b GROUP BY ALL)
SELECT doc_id, page, CAST(block AS BIGINT) AS block, CASE WHEN length(text) < 80 AND (y2 - y1) / n_lines > 14 THEN 'header' ELSE 'paragraph' END AS element_type,
  x1 / 600 AS x1, y1 / 800 AS y1, x2 / 600 AS x2, y2 / 800 AS y2, n_lines, text AS content FROM g""").replace(")\n,\nlv", "),\nlv"))
def words_to_blocks(t: Tables):
    return G.words_to_blocks(words(t), width=600.0, height=800.0)


# --- typed cleaning ------------------------------------------------------------------------------

_DIRTY = """dirty AS (
  SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE concat('  ', c_mktsegment, chr(9)) END AS segment,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_nationkey END AS nation, NULL::VARCHAR AS nothing FROM customer)"""


def _dirty(t: Tables):
    gone = F.col("c_mktsegment") == "MACHINERY"
    return t.customer.select(
        F.when(~gone, F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("\t"))).alias("segment"),
        F.when(~gone, F.col("c_nationkey")).alias("nation"), F.lit(None).cast("string").alias("nothing"))


@plan("drop_empty_rows", with_(_DIRTY, body="SELECT * FROM dirty WHERE segment IS NOT NULL"))
def drop_empty_rows(t: Tables):
    return C.drop_empty_rows(_dirty(t))


@plan("drop_empty_cols", with_(_DIRTY, body="SELECT segment, nation FROM dirty"))
def drop_empty_cols(t: Tables):
    return C.drop_empty_cols(_dirty(t))


@plan("dedup_rows", with_(_DIRTY, body="SELECT DISTINCT * FROM dirty"))
def dedup_rows(t: Tables):
    return C.dedup_rows(_dirty(t))


@plan("trim_strings", with_(_DIRTY, body="SELECT trim(segment, concat(' ', chr(9))) AS segment, nation, nothing FROM dirty"))
def trim_strings(t: Tables):
    return C.trim_strings(_dirty(t))


@plan("fill_nulls", with_(_DIRTY, body="SELECT coalesce(segment, 'n/a') AS segment, nation, coalesce(nothing, 'n/a') AS nothing FROM dirty"))
def fill_nulls(t: Tables):
    return C.fill_nulls(_dirty(t), "n/a")


@plan("clean_table", with_(_DIRTY, body="""SELECT DISTINCT trim(segment, concat(' ', chr(9))) AS segment, nation FROM dirty WHERE segment IS NOT NULL"""))
def clean_table(t: Tables):
    return C.clean_table(_dirty(t), fill="n/a")


@plan("cleaning_report", with_(_DIRTY, body="""SELECT count(*) AS original_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty WHERE segment IS NOT NULL)) AS result_rows,
    count(*) FILTER (WHERE segment IS NULL) AS empty_rows,
    count(*) FILTER (WHERE segment IS NOT NULL) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty WHERE segment IS NOT NULL)) AS duplicate_rows,
    CAST(3 AS BIGINT) AS original_cols, CAST(2 AS BIGINT) AS result_cols, CAST(2 AS BIGINT) AS trimmed_cols FROM dirty"""))
def cleaning_report(t: Tables):
    return C.cleaning_report(_dirty(t))


@plan("clean_observed", SQL["cleaning_report"])
def clean_observed(t: Tables):
    """The report that the plan which writes the cleaned table has counted."""
    cleaned, report = C.clean_to(_dirty(t), scratch_path(t.spark, "cleaned"), fill="n/a")
    return t.spark.createDataFrame([tuple(report.values())], ", ".join(f"{k} bigint" for k in report))


@plan("clean_written", SQL["clean_table"])
def clean_written(t: Tables):
    return C.clean_to(_dirty(t), scratch_path(t.spark, "cleaned"), fill="n/a")[0]


@plan("dedup_keep_first", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber")
def dedup_keep_first(t: Tables):
    return C.dedup_keep_first(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey")


# --- untyped cleaning -------------------------------------------------------------------------------

_RAW = """raw AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%-d/%-m/%Y')
    WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y.%m.%d') WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%-d %B %Y')
    WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%d-%m-%y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
  format('{:,.2f}', o_totalprice) AS amount,
  CASE o_orderstatus WHEN 'F' THEN concat('$', format('{:,.2f}', o_totalprice)) WHEN 'O' THEN concat('€ ', format('{:,.2f}', o_totalprice))
    ELSE concat(format('{:,.2f}', o_totalprice), ' sar') END AS price FROM orders)"""
_DAY = """CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN concat('20', strftime(o_orderdate, '%y-%m-%d')) ELSE strftime(o_orderdate, '%Y-%m-%d') END"""
_AMOUNT = "CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END"
_PRICE = "concat(format('{:.2f}', o_totalprice), CASE o_orderstatus WHEN 'F' THEN ' USD' WHEN 'O' THEN ' EUR' ELSE ' SAR' END)"


def raw(t: Tables, *more: str):
    """Orders as untyped text: mixed date shapes, grouped numbers, prices with symbols or codes. ``more`` names columns to keep."""
    shapes = {"1-URGENT": "d/M/yyyy", "2-HIGH": "yyyy.MM.dd", "3-MEDIUM": "d MMMM yyyy", "4-NOT SPECIFIED": "dd-MM-yy"}
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    for priority, shape in shapes.items():
        day = F.when(F.col("o_orderpriority") == priority, F.date_format("o_orderdate", shape)).otherwise(day)
    amount = F.format_number("o_totalprice", 2)
    price = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("$"), amount))
             .when(F.col("o_orderstatus") == "O", F.concat(F.lit("€ "), amount)).otherwise(F.concat(amount, F.lit(" sar"))))
    return spread(t.orders).select(F.col("o_orderkey").alias("id"), day.alias("day"), amount.alias("amount"), price.alias("price"), *more)


@plan("arabic_digits", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS digits FROM orders")
def arabic_digits(t: Tables):
    arabic = F.translate(F.col("o_orderkey").cast("string"), V.WESTERN_DIGITS, V.ARABIC_INDIC_DIGITS)
    return t.orders.select("o_orderkey", FC.arabic_digits(arabic).alias("digits"))


@plan("normalize_date", f"SELECT o_orderkey AS id, {_DAY} AS day FROM orders")
def normalize_date(t: Tables):
    return raw(t).select("id", FC.normalize_date("day").alias("day"))


@plan("normalize_number", f"SELECT o_orderkey AS id, {_AMOUNT} AS amount FROM orders")
def normalize_number(t: Tables):
    return raw(t).select("id", FC.normalize_number("amount").alias("amount"))


@plan("normalize_currency", f"SELECT o_orderkey AS id, {_PRICE} AS price FROM orders")
def normalize_currency(t: Tables):
    return raw(t).select("id", FC.normalize_currency("price").alias("price"))


@plan("drop_blank_rows", with_(_RAW, body="SELECT r.id, day, amount FROM raw r JOIN orders ON o_orderkey = r.id WHERE o_orderstatus <> 'P'"))
def drop_blank_rows(t: Tables):
    keep = F.col("o_orderstatus") != "P"
    blanked = raw(t, "o_orderstatus").select(
        "id", F.when(keep, F.col("day")).otherwise("  ").alias("day"), F.when(keep, F.col("amount")).alias("amount"))
    return C.drop_blank_rows(blanked, ["day", "amount"])


@plan("clean_all", f"""WITH q AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT max(v) FILTER (WHERE k = n // 4) AS q1, max(v) FILTER (WHERE k = 3 * n // 4) AS q3 FROM q)
SELECT o_orderkey AS id, concat('order ', o_orderkey) AS name, false AS __anomaly_name__, {_DAY} AS day, {_AMOUNT} AS amount, {_PRICE} AS price, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END AS normalized_dates, 1 AS normalized_numbers,
  1 AS normalized_currencies, false AS __anomaly_day__,
  o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1) AS __anomaly_amount__, false AS __anomaly_price__
FROM orders, b WHERE o_orderstatus <> 'P'""")
def clean_all(t: Tables):
    # Rows of one status are blanked, and every row gets a later copy. The name keeps equal texts of different orders apart.
    keep = F.col("o_orderstatus") != "P"
    name = F.concat(F.lit("order "), F.col("id").cast("string"))
    blanked = raw(t, "o_orderstatus").select(
        "id", *[F.when(keep, c).otherwise("").alias(n) for n, c in [
            ("name", name), ("day", F.col("day")), ("amount", F.col("amount")), ("price", F.col("price"))]])
    doubled = blanked.unionByName(blanked.withColumn("id", F.col("id") + 10_000_000_000))
    return C.clean_text_table(doubled, "id")


@plan("cleaning_changes", f"""WITH {_RAW}, o AS (SELECT id, raw.day AS d, raw.amount AS a, raw.price AS p, {_DAY} AS day, {_AMOUNT} AS amount, {_PRICE} AS price FROM raw JOIN orders ON o_orderkey = id)
SELECT id, 'normalize_dates' AS rule, 'day' AS "column", d AS old, day AS new FROM o WHERE d <> day
UNION ALL SELECT id, 'normalize_numbers', 'amount', a, amount FROM o WHERE a <> amount
UNION ALL SELECT id, 'normalize_currencies', 'price', p, price FROM o WHERE p <> price""")
def cleaning_changes(t: Tables):
    return C.cleaning_changes(raw(t), "id")


@plan("cleaning_totals", f"""WITH {_RAW}, o AS (SELECT id, raw.day AS d, raw.amount AS a, raw.price AS p, {_DAY} AS day, {_AMOUNT} AS amount, {_PRICE} AS price FROM raw JOIN orders ON o_orderkey = id)
SELECT 2 * count(*) AS rows_before, count(*) AS rows_after, CAST(count(*) FILTER (WHERE d <> day) AS BIGINT) AS normalized_dates,
  CAST(count(*) FILTER (WHERE a <> amount) AS BIGINT) AS normalized_numbers, CAST(count(*) FILTER (WHERE p <> price) AS BIGINT) AS normalized_currencies FROM o""")
def cleaning_totals(t: Tables):
    named = raw(t).withColumn("name", F.concat(F.lit("order "), F.col("id").cast("string")))
    doubled = named.unionByName(named.withColumn("id", F.col("id") + 10_000_000_000))
    rules = [r for r in C.ALL_RULES if r != "detect_anomalies"]
    return C.cleaning_totals(doubled, C.clean_text_table(doubled, "id", rules))


_POSITIONS = """SELECT column_name AS "column", n, max(v) FILTER (WHERE k = n // 4) AS q1, max(v) FILTER (WHERE k = 3 * n // 4) AS q3 FROM (
  SELECT column_name, v, row_number() OVER (PARTITION BY column_name ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY column_name) AS n FROM (
    UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME column_name VALUE v))
  GROUP BY column_name, n"""


@plan("quartiles", _POSITIONS)
def quartiles(t: Tables):
    return C.quartiles(spread(t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax")), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@plan("iqr_outliers", """WITH q AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events),
b AS (SELECT max(v) FILTER (WHERE k = n // 4) AS q1, max(v) FILTER (WHERE k = 3 * n // 4) AS q3 FROM q)
SELECT event_id, value, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS __anomaly_value__ FROM events, b""")
def iqr_outliers(t: Tables):
    return C.flag_outliers(t.events.select("event_id", "value"), ["value"])


_CONTACTS = """contacts AS (SELECT c_custkey, concat(replace(lower(c_name), '#', '.'), '@example.com') AS a, concat('+1 555-0', 100 + c_nationkey) AS b,
  '2024-01-15' AS c, CAST(abs(c_acctbal) AS VARCHAR) AS d, c_mktsegment AS e FROM customer)"""


def _contacts(t: Tables):
    return t.customer.select(
        "c_custkey", F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")), F.lit("@example.com")).alias("a"),
        F.concat(F.lit("+1 555-0"), (F.col("c_nationkey") + 100).cast("string")).alias("b"), F.lit("2024-01-15").alias("c"),
        F.abs("c_acctbal").cast("string").alias("d"), F.col("c_mktsegment").alias("e"))


@plan("suggest_names", with_(_CONTACTS, body=r""", h AS (SELECT * FROM contacts)
SELECT 'a' AS "column", 'email' AS suggestion FROM h HAVING bool_and(regexp_matches(a, '^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$'))
UNION ALL SELECT 'b', 'phone' FROM h HAVING bool_and(regexp_matches(b, '^\+?[\d\s\-]{7,16}$'))
UNION ALL SELECT 'c', 'date' FROM h HAVING bool_and(regexp_matches(c, '^\d{4}-\d{2}-\d{2}$'))
UNION ALL SELECT 'd', 'amount' FROM h HAVING bool_and(regexp_matches(d, '^[\d,\.]+$'))""").replace(")\n, h", "), h"))
def suggest_names(t: Tables):
    return C.suggest_names(_contacts(t), ["c_custkey"])


@plan("apply_names", with_(_CONTACTS, body="SELECT c_custkey, a AS email, b AS phone, c AS date, d AS amount, e FROM contacts"))
def apply_names(t: Tables):
    contacts = _contacts(t)
    return C.apply_names(contacts, C.suggest_names(contacts, ["c_custkey"]))


@plan("invalid_values", """SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS rows FROM orders GROUP BY ALL
  UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY ALL""")
def invalid_values(t: Tables):
    text = t.orders.select("o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string").alias("o_custkey"))
    return C.invalid_values(text, {"o_orderpriority": "int", "o_orderstatus": "date", "o_custkey": "bigint"})


@plan("entity_amounts", r"""SELECT id, regexp_extract(replace(replace(concat('Total ', amount, ' of ', day), ',', ''), ' ', ''), '[\d.]+') AS amount FROM raw""".join([f"WITH {_RAW}\n", ""]))
def entity_amounts(t: Tables):
    text = F.concat(F.lit("Total "), F.col("amount"), F.lit(" of "), F.col("day"))
    return raw(t).select("id", FC.first_number(text).alias("amount"))


@plan("normalize_arabic", r"""SELECT p_partkey, translate(regexp_replace(translate(p_name, 'abcdeimnoprst', 'أإآىةـًابتثجح'), '[\x{064B}-\x{065F}\x{0670}\x{0640}]', '', 'g'), 'أإآٱىة', 'اااايه') AS folded FROM part""")
def normalize_arabic(t: Tables):
    arabic = F.translate("p_name", "abcdeimnoprst", "أإآىةـًابتثجح")
    return t.part.select("p_partkey", FC.normalize_arabic(arabic).alias("folded"))


# As many Arabic letters as the part's size behind its Latin brand and name.
@plan("is_rtl", r"""SELECT p_partkey, p_size // 2 > length(regexp_replace(concat(p_brand, ' ', p_name), '[^a-zA-Z]', '', 'g')) AS rtl FROM part""")
def is_rtl(t: Tables):
    mixed = F.concat("p_brand", F.lit(" "), "p_name", F.lit(" 12 "), F.repeat(F.lit("م"), F.floor(F.col("p_size") / 2).cast("int")))
    return t.part.select("p_partkey", L.is_rtl(mixed).alias("rtl"))


@plan("strip_junk_lines", r"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[\p{L}\p{N}]')), chr(10)) AS text FROM documents""")
def strip_junk_lines(t: Tables):
    return t.corpus.select("doc_id", FC.strip_junk_lines("text").alias("text"))


@plan("human_size", """SELECT o_orderkey, CASE WHEN s < 1024 THEN printf('%.1f B', s) WHEN s < 1024^2 THEN printf('%.1f KB', s / 1024)
  WHEN s < 1024^3 THEN printf('%.1f MB', s / 1024^2) WHEN s < 1024^4 THEN printf('%.1f GB', s / 1024^3) ELSE printf('%.1f TB', s / 1024^4) END AS size
  FROM (SELECT o_orderkey, CAST(floor(o_totalprice * o_custkey) AS DOUBLE) AS s FROM orders)""")
def human_size(t: Tables):
    return t.orders.select("o_orderkey", L.human_size(F.floor(F.col("o_totalprice") * F.col("o_custkey"))).alias("size"))


@plan("time_since", """SELECT event_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN concat(s // 60, ' minutes ago') WHEN s < 86400 THEN concat(s // 3600, ' hours ago')
  WHEN s < 604800 THEN concat(s // 86400, ' days ago') ELSE strftime(ts, '%Y-%m-%d') END AS label
  FROM (SELECT event_id, ts, CAST(floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 1000000) AS BIGINT) AS s FROM events)""")
def time_since(t: Tables):
    return t.events.select("event_id", L.time_since("ts", t.events.agg(F.max("ts")).scalar()).alias("label"))


@plan("truncate_suffix", """SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE concat(substring(text, 1, 397), '...') END AS text FROM documents""")
def truncate_suffix(t: Tables):
    return t.documents.select("doc_id", L.truncate_suffix("text", 400).alias("text"))
