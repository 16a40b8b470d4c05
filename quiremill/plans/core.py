"""Queries of the relational core: filters, joins, aggregates, per-key selections, sorts, unions."""
from __future__ import annotations

from pyspark.sql import functions as F

from quiremill.operators import analytics as A
from quiremill.operators import cleaning as C
from quiremill.operators import keys as K
from quiremill.operators import relational as R
from quiremill.plans import relations as rel
from quiremill.plans.registry import Tables, plan
from quiremill.plans.relations import ANALYSES, FEEDBACK, FILES, LOG, PINGS, with_
from quiremill.plans.workflow import run_workflow

MONEY = "decimal(18,2)"


def as_of(df, column):
    return df.agg(F.max(column)).scalar()


# --- projections and filters -----------------------------------------------------------

@plan("project", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def project(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")


@plan("filter_eq", with_(FILES, body="SELECT id, owner_id, size_bytes FROM files WHERE status = 'ready' AND format = 'pdf'"))
def filter_eq(t: Tables):
    return rel.files(t).where((F.col("status") == "ready") & (F.col("format") == "pdf")).select("id", "owner_id", "size_bytes")


@plan("filter_in", with_(FILES, body="SELECT id, format FROM files WHERE format IN ('pdf', 'csv')"))
def filter_in(t: Tables):
    return rel.files(t).where(F.col("format").isin("pdf", "csv")).select("id", "format")


@plan("filter_ilike", with_(FILES, body=(
    "SELECT id, original_name, name FROM files WHERE original_name ILIKE '%7_.PDF%' OR name ILIKE '%7_.PDF%'")))
def filter_ilike(t: Tables):
    return rel.files(t).where(R.contains_ignore_case(["original_name", "name"], "7_.PDF")).select("id", "original_name", "name")


@plan("filter_recent", """SELECT event_id, user_id, event_type FROM events
  WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS""")
def filter_recent(t: Tables):
    return t.events.where(R.newer_than("ts", as_of(t.events, "ts"), 7)).select("event_id", "user_id", "event_type")


@plan("old_files", with_(FILES, body="""SELECT id, owner_id, CAST(created_at AS DATE) AS created FROM files
  WHERE created_at < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAYS AND NOT is_favorite"""))
def old_files(t: Tables):
    old = R.old_files(rel.files(t), as_of(t.orders, "o_orderdate"), days=365)
    return old.select("id", "owner_id", F.to_date("created_at").alias("created"))


@plan("filter_notnull", with_(ANALYSES, body="""SELECT file_id, part_id, doc_type, processing_ms FROM analyses
  WHERE doc_type IS NOT NULL"""))
def filter_notnull(t: Tables):
    return rel.analyses(t).where(F.col("doc_type").isNotNull()).select("file_id", "part_id", "doc_type", "processing_ms")


@plan("list_files", with_(FILES, body="""SELECT id, owner_id, original_name, size_bytes FROM files
  WHERE (original_name ILIKE '%report 1%' OR name ILIKE '%report 1%') AND format = 'pdf' AND is_locally_stored"""))
def list_files(t: Tables):
    found = R.list_files(rel.files(t), search="report 1", fmt="pdf", only_local=True)
    return found.select("id", "owner_id", "original_name", "size_bytes")


@plan("lookup", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name = 'Customer#000000042'")
def lookup(t: Tables):
    return t.customer.where(F.col("c_name") == "Customer#000000042").select("c_custkey", "c_name", "c_mktsegment").limit(1)


@plan("in_progress_files", with_(FILES, ANALYSES, body="""SELECT id, owner_id FROM files
  WHERE EXISTS (SELECT 1 FROM analyses a WHERE a.file_id = files.id AND a.status IN ('pending', 'running'))"""))
def in_progress_files(t: Tables):
    active = rel.analyses(t).where(F.col("status").isin("pending", "running")).select(F.col("file_id").alias("id"))
    return rel.files(t).join(active, "id", "left_semi").select("id", "owner_id")


@plan("replace_regex", r"""SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '*', 'g') AS p_name,
  regexp_replace(p_type, '[aeiou]+', '*', 'g') AS p_type FROM part""")
def replace_regex(t: Tables):
    return R.replace_regex(t.part.select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], "[aeiou]+", "*")


@plan("replace_text", "SELECT o_orderkey, replace(o_orderpriority, '-', '.') AS o_orderpriority FROM orders")
def replace_text(t: Tables):
    return R.replace_text(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "-", ".")


@plan("split_col", """SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS level,
  split_part(o_orderpriority, '-', 2) AS label FROM orders""")
def split_col(t: Tables):
    return R.split_col(t.orders, "o_orderpriority", "-", ["level", "label"]).select("o_orderkey", "level", "label")


@plan("merge_cols", """SELECT c_custkey, concat_ws(' / ', c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS label
  FROM customer""")
def merge_cols(t: Tables):
    return R.merge_cols(t.customer, ["c_name", "c_mktsegment", "c_nationkey"], " / ", "label").select("c_custkey", "label")


@plan("cast_col", """SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS level,
  TRY_CAST(split_part(o_orderpriority, '-', 2) AS INTEGER) AS label FROM orders""")
def cast_col(t: Tables):
    parts = R.split_col(t.orders, "o_orderpriority", "-", ["level", "label"]).select("o_orderkey", "level", "label")
    return R.cast_cols(parts, {"level": "int", "label": "int"})


@plan("calc_col", """SELECT l_orderkey, l_linenumber, l_partkey,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue FROM lineitem""")
def calc_col(t: Tables):
    return R.calc_col(t.lineitem, "revenue",
                      "cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as double)").select(
        "l_orderkey", "l_linenumber", "l_partkey", "revenue")


RULE = {"op": "and", "rules": [
    {"op": "or", "rules": [
        {"op": "starts", "col": "o_orderpriority", "value": "1"},
        {"op": "ends", "col": "o_orderpriority", "value": "HIGH"},
        {"op": "regex", "col": "o_orderpriority", "value": "^[45]-L"}]},
    {"op": "not", "rules": [{"op": "eq", "col": "o_orderstatus", "value": "P"}]},
    {"op": "between", "col": "o_totalprice", "value": [50000, 400000]},
    {"op": "date_from", "col": "o_orderdate", "value": "1996-01-01 00:00:00"},
    {"op": "expr", "value": "o_custkey <> o_orderkey"}]}


@plan("filter_builder", r"""SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
  WHERE (starts_with(o_orderpriority, '1') OR suffix(o_orderpriority, 'HIGH') OR regexp_matches(o_orderpriority, '^[45]-L'))
    AND NOT (o_orderstatus = 'P') AND o_totalprice BETWEEN 50000 AND 400000
    AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_custkey <> o_orderkey""")
def filter_builder(t: Tables):
    return t.orders.where(R.filter_builder(RULE)).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@plan("truncate_text", "SELECT doc_id, substring(text, 1, 500) AS head FROM documents")
def truncate_text(t: Tables):
    return t.documents.select("doc_id", F.substring("text", 1, 500).alias("head"))


@plan("workflow", r"""SELECT o_orderkey, level, o_totalprice / 2 AS half FROM (
    SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS level, o_totalprice FROM orders WHERE o_totalprice > 100000)""")
def workflow(t: Tables):
    return run_workflow(t.orders, [
        {"op": "filter", "rule": {"op": "gt", "col": "o_totalprice", "value": 100000}},
        {"op": "split_col", "col": "o_orderpriority", "sep": "-", "names": ["level", "label"]},
        {"op": "calc", "name": "half", "expression": "o_totalprice / 2"},
        {"op": "select", "cols": ["o_orderkey", "level", "half"]}])


@plan("workflow_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderstatus AS status_before FROM orders")
def workflow_columns(t: Tables):
    return run_workflow(t.orders, [
        {"op": "duplicate", "col": "o_orderstatus", "name": "status_before"}, {"op": "delete", "cols": ["o_orderpriority", "o_orderdate"]}])


# --- joins ---------------------------------------------------------------------------------

@plan("join_inner", with_(FILES, ANALYSES, body="""SELECT f.owner_id, count(*) AS analyses, CAST(sum(a.processing_ms) AS BIGINT) AS total_ms
  FROM analyses a JOIN files f ON a.file_id = f.id GROUP BY f.owner_id"""))
def join_inner(t: Tables):
    # Analyses shrink to one row per file before the join, so a busy file is one row in it.
    per_file = rel.analyses(t).groupBy(F.col("file_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("processing_ms").alias("ms"))
    joined = rel.files(t).join(per_file, "id")
    return joined.groupBy("owner_id").agg(F.sum("n").alias("analyses"), F.sum("ms").alias("total_ms"))


@plan("join_three_way", with_(FILES, ANALYSES, body="""SELECT f.format, p.p_brand AS entity_type, count(*) AS n
  FROM analyses a JOIN files f ON a.file_id = f.id JOIN part p ON p.p_partkey = a.part_id
  WHERE f.format IS NOT NULL GROUP BY ALL"""))
def join_three_way(t: Tables):
    files = rel.files(t).where("format IS NOT NULL").select(F.col("id").alias("file_id"), "format")
    parts = t.part.select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("entity_type"))
    joined = rel.analyses(t).select("file_id", "part_id").join(files, "file_id")
    per_part = joined.groupBy("format", "part_id").agg(F.count(F.lit(1)).alias("n"))
    return per_part.join(parts, "part_id").groupBy("format", "entity_type").agg(F.sum("n").alias("n"))


@plan("acceptance_rate", with_(FILES, ANALYSES, body="""SELECT owner_id, count(accepted) AS judged,
    count(*) FILTER (WHERE accepted) AS accepted,
    CASE WHEN count(accepted) > 0 THEN round_even(count(*) FILTER (WHERE accepted) / count(accepted) * 100, 1) ELSE 0.0 END AS rate
  FROM files JOIN analyses ON file_id = id GROUP BY owner_id"""))
def acceptance_rate(t: Tables):
    per_file = rel.analyses(t).groupBy(F.col("file_id").alias("id")).agg(
        F.count("accepted").alias("judged"), F.count_if("accepted").alias("accepted"))
    by_owner = rel.files(t).join(per_file, "id").groupBy("owner_id").agg(
        F.sum("judged").alias("judged"), F.sum("accepted").alias("accepted"))
    return by_owner.withColumn("rate", A.percent(F.col("accepted"), F.col("judged")))


@plan("index_flag", "SELECT o_orderkey AS id, o_orderkey IN (SELECT doc_id FROM documents) AS is_indexed FROM orders")
def index_flag(t: Tables):
    files = t.orders.select(F.col("o_orderkey").alias("id"))
    return R.membership_flag(files, t.documents.select(F.col("doc_id").alias("id")), "id", "is_indexed")


@plan("semi", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT doc_id FROM documents)")
def semi(t: Tables):
    return t.orders.join(t.documents, F.col("o_orderkey") == F.col("doc_id"), "left_semi").select("o_orderkey", "o_totalprice")


@plan("anti", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM documents)")
def anti(t: Tables):
    return t.orders.join(t.documents, F.col("o_orderkey") == F.col("doc_id"), "left_anti").select("o_orderkey", "o_totalprice")


@plan("parent_child_count", """SELECT c_custkey, c_name, count(o_orderkey) AS file_count
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def parent_child_count(t: Tables):
    return R.count_children(t.customer.select("c_custkey", "c_name"), t.orders, "c_custkey", "o_custkey", "file_count")


@plan("analysis_bundle", with_(ANALYSES, body="""SELECT o_orderkey AS file_id, o_orderstatus AS status, coalesce(n_tables, 0) AS n_tables,
    coalesce(n_entities, 0) AS n_entities, coalesce(n_suggestions, 0) AS n_suggestions, first_entity
  FROM orders
  LEFT JOIN (SELECT file_id, count(*) FILTER (WHERE status = 'completed') AS n_tables, count(doc_type) AS n_entities,
      count(accepted) AS n_suggestions, min(doc_type) AS first_entity FROM analyses GROUP BY file_id) a ON a.file_id = o_orderkey"""))
def analysis_bundle(t: Tables):
    # Every child relation is reduced to one row per parent in one pass before the join.
    children = rel.analyses(t).groupBy("file_id").agg(
        F.count_if(F.col("status") == "completed").alias("n_tables"), F.count("doc_type").alias("n_entities"),
        F.count("accepted").alias("n_suggestions"), F.min("doc_type").alias("first_entity"))
    parents = t.orders.select(F.col("o_orderkey").alias("file_id"), F.col("o_orderstatus").alias("status"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ["n_tables", "n_entities", "n_suggestions"]}
    return parents.join(children, "file_id", "left").withColumns(zero)


@plan("coalesce_name", with_(FILES, body="""SELECT d.doc_id AS file_id,
    coalesce(CASE WHEN f.format IS NOT NULL THEN f.original_name END, concat('file #', d.doc_id)) AS file_name
  FROM documents d LEFT JOIN files f ON f.id = d.doc_id"""))
def coalesce_name(t: Tables):
    named = rel.files(t).where("format IS NOT NULL").select(F.col("id").alias("file_id"), "original_name")
    joined = t.documents.select(F.col("doc_id").alias("file_id")).join(named, "file_id", "left")
    label = F.coalesce("original_name", F.concat(F.lit("file #"), F.col("file_id").cast("string")))
    return joined.select("file_id", label.alias("file_name"))


@plan("merge_horizontal", """SELECT c.c_custkey AS key, c.c_name AS name_1, s.s_name AS name_2, c_acctbal AS bal_1, s_acctbal AS bal_2,
    c_mktsegment FROM customer c JOIN supplier s ON c.c_custkey = s.s_suppkey""")
def merge_horizontal(t: Tables):
    left = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), "c_mktsegment")
    right = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return R.merge_horizontal([left, right], ["key"])


@plan("common_key", """SELECT 'orders' AS "left", 'lineitem' AS "right", 'o_orderkey' AS left_column, 'l_orderkey' AS right_column,
    (SELECT count(DISTINCT o_orderkey) FROM orders) AS left_distinct, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS right_distinct,
    (SELECT count(DISTINCT o_orderkey) FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey) AS shared
  UNION ALL SELECT 'customer', 'orders', 'c_custkey', 'o_custkey', (SELECT count(DISTINCT c_custkey) FROM customer),
    (SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT c_custkey) FROM customer SEMI JOIN orders ON o_custkey = c_custkey)""")
def common_key(t: Tables):
    """By which columns orders belong to their lines, and customers to their orders."""
    found = None
    for left, right in (("orders", "lineitem"), ("customer", "orders")):
        part = K.common_key(getattr(t, left), getattr(t, right)).select(F.lit(left).alias("left"), F.lit(right).alias("right"), "*")
        found = part if found is None else found.union(part)
    return found


@plan("join_found", "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey")
def join_found(t: Tables):
    return K.join_on_common_key(t.customer, t.orders).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


# --- aggregates ------------------------------------------------------------------------------

@plan("count_all", "SELECT count(*) AS n FROM lineitem")
def count_all(t: Tables):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))


@plan("count_if", """SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS ready, count(*) FILTER (WHERE o_totalprice > 300000) AS large,
  count(*) AS total FROM orders""")
def count_if(t: Tables):
    return t.orders.agg(F.count_if(F.col("o_orderstatus") == "F").alias("ready"),
                        F.count_if(F.col("o_totalprice") > 300000).alias("large"), F.count(F.lit(1)).alias("total"))


@plan("total_size", with_(FILES, body="SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_size_bytes FROM files"))
def total_size(t: Tables):
    return A.total_size(rel.files(t))


@plan("avg_processing", with_(ANALYSES, body="""SELECT doc_type, round_even(coalesce(avg(processing_ms), 0) / 1000, 1) AS seconds
  FROM analyses GROUP BY doc_type"""))
def avg_processing(t: Tables):
    return rel.analyses(t).groupBy("doc_type").agg(A.average_seconds("processing_ms").alias("seconds"))


@plan("format_counts", with_(FILES, body="SELECT coalesce(nullif(format, ''), 'unknown') AS format, count(*) AS count FROM files GROUP BY 1"))
def format_counts(t: Tables):
    return A.counts_by(rel.files(t), "format")


@plan("doc_type_dist", with_(FILES, ANALYSES, body="""SELECT doc_type, count(*) AS count FROM analyses a JOIN files f ON a.file_id = f.id
  WHERE a.status = 'completed' AND doc_type IS NOT NULL GROUP BY doc_type ORDER BY count DESC, doc_type"""))
def doc_type_dist(t: Tables):
    done = rel.analyses(t).where("status = 'completed' AND doc_type IS NOT NULL")
    per_file = done.groupBy("file_id", "doc_type").agg(F.count(F.lit(1)).alias("n"))
    kept = per_file.join(rel.files(t).select(F.col("id").alias("file_id")), "file_id")
    return kept.groupBy("doc_type").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "doc_type")


@plan("daily_trend", """SELECT CAST(ts AS DATE) AS day, count(*) AS count FROM events
  WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAYS GROUP BY 1 ORDER BY 1""")
def daily_trend(t: Tables):
    return A.daily_trend(t.events, "ts", as_of(t.events, "ts"), 30)


@plan("top_entities", """SELECT p_brand AS entity_type, count(*) AS count FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1 ORDER BY count DESC, entity_type LIMIT 15""")
def top_entities(t: Tables):
    per_part = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    joined = per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    counts = joined.groupBy(F.col("p_brand").alias("entity_type")).agg(F.sum("n").alias("count"))
    return counts.orderBy(F.desc("count"), "entity_type").limit(15)


@plan("distinct_keys", "SELECT DISTINCT l_orderkey FROM lineitem")
def distinct_keys(t: Tables):
    return t.lineitem.select("l_orderkey").distinct()


@plan("overview", with_(FILES, ANALYSES, FEEDBACK, body="""
SELECT f.owner_id, count(*) AS total_files,
  count(*) FILTER (WHERE f.created_at >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAYS) AS files_this_week,
  CAST(coalesce(sum(done), 0) AS BIGINT) AS completed_analyses,
  round_even(coalesce(sum(ms) / nullif(sum(done), 0), 0) / 1000, 1) AS avg_processing_sec,
  CAST(coalesce(sum(ents), 0) AS BIGINT) AS total_entities, CAST(coalesce(sum(tabs), 0) AS BIGINT) AS total_tables,
  coalesce(max(g.n), 0) AS total_feedback,
  CASE WHEN sum(judged) > 0 THEN round_even(sum(acc) / sum(judged) * 100, 1) ELSE 0.0 END AS suggestion_acceptance_rate
FROM files f
LEFT JOIN (SELECT file_id, count(*) FILTER (WHERE status = 'completed') AS done,
    sum(processing_ms) FILTER (WHERE status = 'completed') AS ms, count(doc_type) AS ents,
    count(*) FILTER (WHERE processing_ms > 2500) AS tabs, count(accepted) AS judged, count(*) FILTER (WHERE accepted) AS acc
  FROM analyses GROUP BY file_id) a ON a.file_id = f.id
LEFT JOIN (SELECT user_id, count(*) AS n FROM feedback GROUP BY user_id) g ON g.user_id = f.owner_id
GROUP BY f.owner_id"""))
def overview(t: Tables):
    facts = rel.analyses(t)
    return A.overview(rel.files(t), facts, facts.where("doc_type IS NOT NULL"), facts.where("processing_ms > 2500"),
                      rel.feedback(t), facts, as_of(t.orders, "o_orderdate"))


@plan("storage_stats", with_(FILES, body="""
SELECT owner_id, count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
  count(*) FILTER (WHERE is_locally_stored) AS locally_stored, count(*) FILTER (WHERE NOT is_locally_stored) AS cloud_files,
  count(*) FILTER (WHERE is_favorite) AS favorites, max(formats) AS formats
FROM files JOIN (SELECT owner_id AS o, string_agg(concat(fmt, '=', n), ',' ORDER BY fmt) AS formats FROM
  (SELECT owner_id, coalesce(format, 'unknown') AS fmt, count(*) AS n FROM files GROUP BY ALL) GROUP BY owner_id) ON o = owner_id
GROUP BY owner_id"""))
def storage_stats(t: Tables):
    text = F.array_join(F.transform(F.map_entries("formats"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return A.storage_stats(rel.files(t)).withColumn("formats", text)


@plan("ping_stats", with_(PINGS, body="""SELECT count(*) AS total_pings, count(*) FILTER (WHERE NOT ok) AS total_fails,
  strftime(max(pinged_at), '%Y-%m-%d %H:%M:%S') AS last_ping_at, arg_max(latency_ms, pinged_at) AS last_latency_ms, arg_max(ok, pinged_at) AS last_status
  FROM pings"""))
def ping_stats(t: Tables):
    return A.ping_stats(rel.pings(t)).withColumn("last_ping_at", F.date_format("last_ping_at", "yyyy-MM-dd HH:mm:ss"))


@plan("dashboard", with_(FILES, LOG, body="""
SELECT f.owner_id, total_files, total_size_bytes, coalesce(ops, 0) AS total_operations, recent_files, favorites, coalesce(recent_ops, 0) AS recent_operations
FROM (SELECT owner_id, count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
    least(count(*), 6) AS recent_files, least(count(*) FILTER (WHERE is_favorite), 4) AS favorites FROM files GROUP BY owner_id) f
LEFT JOIN (SELECT user_id, count(*) AS ops, least(count(*), 8) AS recent_ops FROM log GROUP BY user_id) l ON l.user_id = f.owner_id"""))
def dashboard(t: Tables):
    parts = A.dashboard(rel.files(t), rel.log(t))
    shown = lambda name, key: parts[name].groupBy(F.col(key).alias("owner_id")).agg(F.count(F.lit(1)).alias(name))
    out = parts["totals"].drop("total_size_human")
    for name, key in [("recent_files", "owner_id"), ("favorites", "owner_id"), ("recent_operations", "user_id")]:
        out = out.join(shown(name, key), "owner_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


@plan("flags_by_group", """SELECT event_type AS task, count(*) AS count, (SELECT bool_or(event_type = 'error') FROM events) AS has_error,
  (SELECT bool_or(event_type = 'refund') FROM events) AS has_refund FROM events GROUP BY event_type""")
def flags_by_group(t: Tables):
    models = t.events.select(F.col("event_type").alias("task"))
    return A.flags_by_group(models, "task", {"has_error": "error", "has_refund": "refund"})


@plan("profile_shape", """SELECT column_name AS column, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
    WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END AS dtype, (SELECT count(*) FROM orders) AS total_rows, CAST(6 AS BIGINT) AS total_cols
  FROM (DESCRIBE SELECT * FROM orders) d(column_name, data_type, a, b, c, e)""")
def profile_shape(t: Tables):
    return A.profile_shape(t.orders)


@plan("null_counts", """WITH w AS (SELECT count(*) - count(nullif(o_orderpriority, '5-LOW')) AS o_orderpriority,
    count(*) - count(nullif(o_orderstatus, 'P')) AS o_orderstatus, count(*) - count(o_orderkey) AS o_orderkey FROM orders)
  UNPIVOT w ON o_orderpriority, o_orderstatus, o_orderkey INTO NAME "column" VALUE nulls""")
def null_counts(t: Tables):
    return C.null_counts(t.orders.select(
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_orderkey"))


@plan("ops_usage", with_(LOG, body="""SELECT type, count(*) AS n, count(DISTINCT user_id) AS users,
  round(CAST(sum(CAST(duration_ms AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS avg_ms FROM log GROUP BY type"""))
def ops_usage(t: Tables):
    total = F.sum(F.col("duration_ms").cast(MONEY)).cast("double")
    return rel.log(t).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"),
        F.round(total / F.count(F.lit(1)), 4).alias("avg_ms"))


@plan("corrections_by_field", with_(FEEDBACK, body="""SELECT field_name, count(*) AS n,
  count(*) FILTER (WHERE used_in_training) AS used FROM feedback GROUP BY field_name"""))
def corrections_by_field(t: Tables):
    return rel.feedback(t).groupBy("field_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("used_in_training").alias("used"))


@plan("mean_rating", with_(FEEDBACK, body="SELECT count(*) AS n, round(avg(rating), 6) AS mean_rating FROM feedback"))
def mean_rating(t: Tables):
    return rel.feedback(t).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rating"), 6).alias("mean_rating"))


@plan("pivot", """SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS "F",
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_linestatus = 'O') AS DOUBLE) AS "O" FROM lineitem GROUP BY l_returnflag""")
def pivot(t: Tables):
    total = F.sum(F.col("l_quantity").cast(MONEY)).cast("double")
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(total)


_TOTALS = """count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price"""


def _totals():
    return {"n": F.count(F.lit(1)), "price": F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double")}


@plan("rollup", f"""SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS grouping_id, {_TOTALS}
  FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup(t: Tables):
    return A.rollup_table(t.lineitem, ["l_returnflag", "l_linestatus"], _totals())


@plan("cube", f"""SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS grouping_id, {_TOTALS}
  FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube(t: Tables):
    return A.cube_table(t.lineitem, ["l_returnflag", "l_linestatus"], _totals())


# --- per-key selections ------------------------------------------------------------------------

@plan("latest_per_key", """SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_id, event_type FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(t: Tables):
    latest = R.latest_per_key(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    return latest.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_id", "event_type")


@plan("recent_n_per_owner", with_(FILES, body="""SELECT owner_id, id, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, id DESC) AS rank
  FROM files QUALIFY rank <= 6"""))
def recent_n_per_owner(t: Tables):
    top = R.top_n_per_key(rel.files(t), ["owner_id"], [F.desc("created_at"), F.desc("id")], 6)
    return top.select("owner_id", "id", "rank")


@plan("favorites_n", with_(FILES, body="""SELECT owner_id, id, row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC, id DESC) AS rank
  FROM files WHERE is_favorite QUALIFY rank <= 4"""))
def favorites_n(t: Tables):
    top = R.top_n_per_key(rel.files(t).where("is_favorite"), ["owner_id"], [F.desc("updated_at"), F.desc("id")], 4)
    return top.select("owner_id", "id", "rank")


@plan("one_default_per_group", """SELECT p_partkey, p_type,
  row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey DESC) = 1 AS is_default FROM part""")
def one_default_per_group(t: Tables):
    flagged = R.one_default_per_group(t.part.select("p_partkey", "p_type", "p_retailprice"), "p_type", "p_partkey", ["p_retailprice"])
    return flagged.select("p_partkey", "p_type", "is_default")


@plan("last_10_pings", with_(PINGS, body="""SELECT source, id, ok, row_number() OVER (PARTITION BY source ORDER BY pinged_at DESC, id DESC) AS rank
  FROM pings QUALIFY rank <= 10"""))
def last_10_pings(t: Tables):
    top = R.top_n_per_key(rel.pings(t), ["source"], [F.desc("pinged_at"), F.desc("id")], 10)
    return top.select("source", "id", "ok", "rank")


# --- sorts and pages ------------------------------------------------------------------------------

@plan("sort_by", with_(FILES, body="SELECT id, original_name, size_bytes FROM files ORDER BY size_bytes, id"))
def sort_by(t: Tables):
    return R.sort_files(rel.files(t), "size", "asc").select("id", "original_name", "size_bytes")


@plan("paginate", with_(FILES, body="""SELECT id, size_bytes, (SELECT count(*) FROM files) AS total,
  (SELECT CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) FROM files) AS pages FROM files ORDER BY created_at DESC, id LIMIT 20 OFFSET 40"""))
def paginate(t: Tables):
    files = rel.files(t)
    totals = R.page_totals(files, 20)
    page = R.page_of(files, [F.desc("created_at"), F.col("id")], page=3, per_page=20).select("id", "size_bytes")
    return page.withColumns({c: totals.select(c).scalar() for c in ["total", "pages"]})


@plan("paginate_after", with_(FILES, body="""SELECT id FROM files WHERE created_at < TIMESTAMP '1995-06-01' OR (created_at = TIMESTAMP '1995-06-01' AND id > 100)
  ORDER BY created_at DESC, id LIMIT 20"""))
def paginate_after(t: Tables):
    return R.page_after(rel.files(t).select("id", "created_at"), {"created_at": "desc", "id": "asc"}, ["1995-06-01", 100]).select("id")


@plan("sort_multi", "SELECT c_custkey, c_mktsegment, c_name FROM customer ORDER BY c_mktsegment, c_name")
def sort_multi(t: Tables):
    return t.customer.select("c_custkey", "c_mktsegment", "c_name").orderBy("c_mktsegment", "c_name")


@plan("preview", "SELECT o_orderkey, o_orderstatus, o_totalprice, 'table' AS content_type FROM orders ORDER BY o_orderkey LIMIT 100")
def preview(t: Tables):
    from quiremill.functions.values import TEXT_COLUMN_NAMES
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    is_text = len(df.columns) == 1 and df.columns[0].lower() in TEXT_COLUMN_NAMES
    return df.orderBy("o_orderkey").limit(100).withColumn("content_type", F.lit("text" if is_text else "table"))


@plan("natural_sort", r"""SELECT name, row_number() OVER (ORDER BY lvl, num) AS place FROM (
    SELECT DISTINCT concat('Size ', p_size, ' of ', p_brand) AS name, p_size AS lvl, CAST(regexp_extract(p_brand, '\d+') AS INTEGER) AS num FROM part)
""")
def natural_sort(t: Tables):
    names = t.part.select(F.concat(F.lit("Size "), F.col("p_size").cast("string"), F.lit(" of "), F.col("p_brand")).alias("name")).distinct()
    return R.numbered(names, [R.natural_key("name"), F.col("name")])


@plan("custom_sort", """SELECT o_orderkey, o_orderpriority,
    CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS place
  FROM orders ORDER BY place, o_orderkey""")
def custom_sort(t: Tables):
    order = ["2-HIGH", "5-LOW", "1-URGENT"]
    df = t.orders.select("o_orderkey", "o_orderpriority", R.custom_rank("o_orderpriority", order).alias("place"))
    return R.custom_sort(df, "o_orderpriority", order, [F.col("o_orderkey")])


@plan("array_slice", """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank, l_partkey
  FROM lineitem QUALIFY rank <= 5""")
def array_slice(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    top = R.top_n_per_key(rows, ["l_orderkey"], [F.col(c) for c in ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]], 5)
    return top.select("l_orderkey", "rank", "l_partkey")


# --- unions and comparisons ---------------------------------------------------------------------------

@plan("merge_vertical", """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::VARCHAR AS brand, 'customers' AS source_file, 1 AS source_order FROM customer
  UNION ALL SELECT s_suppkey, s_name, NULL, NULL, 'suppliers', 2 FROM supplier
  UNION ALL SELECT p_partkey, p_name, NULL, p_brand, 'parts', 3 FROM part""")
def merge_vertical(t: Tables):
    return R.merge_vertical([
        t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")),
        t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")),
    ], ["customers", "suppliers", "parts"])


_LEFT = "l AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_totalprice < 400000)"
_RIGHT = """r AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderstatus = 'F' THEN lower(o_orderpriority) ELSE o_orderpriority END AS priority FROM orders WHERE o_totalprice > 50000)"""


def _versions(t: Tables):
    o = t.orders
    left = o.where("o_totalprice < 400000").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    right = o.where("o_totalprice > 50000").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderstatus") == "F", F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("priority"))
    return left, right


@plan("compare_added", with_(_LEFT, _RIGHT, body="SELECT * FROM r WHERE id NOT IN (SELECT id FROM l)"))
def compare_added(t: Tables):
    return R.compare(*_versions(t), keys=["id"], check_keys=False)["added"]


@plan("compare_removed", with_(_LEFT, _RIGHT, body="SELECT * FROM l WHERE id NOT IN (SELECT id FROM r)"))
def compare_removed(t: Tables):
    return R.compare(*_versions(t), keys=["id"], check_keys=False)["removed"]


@plan("compare_changed", with_(_LEFT, _RIGHT, body="""SELECT l.id, 'status' AS "column", l.status AS old, r.status AS new FROM l JOIN r USING (id) WHERE l.status IS DISTINCT FROM r.status
  UNION ALL SELECT l.id, 'priority', l.priority, r.priority FROM l JOIN r USING (id) WHERE l.priority IS DISTINCT FROM r.priority"""))
def compare_changed(t: Tables):
    return R.compare(*_versions(t), keys=["id"], check_keys=False)["changed"]


@plan("compare_rows", """WITH a AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY ALL),
  b AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity < 40 GROUP BY ALL)
  SELECT l_orderkey, l_linenumber, b.n - coalesce(a.n, 0) AS surplus FROM b LEFT JOIN a USING (l_orderkey, l_linenumber) WHERE b.n > coalesce(a.n, 0)""")
def compare_rows(t: Tables):
    # The key repeats, so rows are compared as a multiset.
    keys = ["l_orderkey", "l_linenumber"]
    left, right = t.lineitem.where("l_quantity > 10").select(keys), t.lineitem.where("l_quantity < 40").select(keys)
    return R.compare(left, right)["added"]
