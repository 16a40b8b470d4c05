"""The metadata relations, derived from the given tables, each with its SQL twin."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.plans.registry import Tables

_FORMATS = {"1-URGENT": "pdf", "2-HIGH": "xlsx", "3-MEDIUM": "csv", "4-NOT SPECIFIED": "docx"}


def files(t: Tables) -> DataFrame:
    ext = F.lit(None).cast("string")
    for priority, e in _FORMATS.items():
        ext = F.when(F.col("o_orderpriority") == priority, F.lit(e)).otherwise(ext)
    key = F.col("o_orderkey").cast("string")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"),
        F.concat(F.lit("Report "), key, F.lit("."), F.coalesce(ext, F.lit("bin"))).alias("original_name"),
        F.concat(F.lower("o_orderstatus"), F.lit("_"), key).alias("name"),
        F.floor("o_totalprice").alias("size_bytes"), ext.alias("format"),
        F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "processing")
        .otherwise("failed").alias("status"),
        (F.col("o_totalprice") > 300000).alias("is_favorite"),
        (F.col("o_orderstatus") == "F").alias("is_locally_stored"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


def analyses(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("file_id"),
        F.when(F.col("l_returnflag") == "A", "invoice").when(F.col("l_returnflag") == "R", "resume").alias("doc_type"),
        F.when(F.col("l_linestatus") == "F", "completed").otherwise("running").alias("status"),
        (F.col("l_quantity") * 100).cast("bigint").alias("processing_ms"),
        F.col("l_shipdate").alias("created_at"), F.col("l_partkey").alias("part_id"),
        F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("accepted"))


def log(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("type"),
        F.col("value").alias("duration_ms"), F.col("ts").alias("started_at"))


def pings(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("source"),
        (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"), F.col("ts").alias("pinged_at"))


def feedback(t: Tables) -> DataFrame:
    """Corrections of documents by the owners of the files with the same id."""
    owners = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("user_id"))
    return t.labels.join(owners, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("file_id"), "user_id",
        F.when(F.col("toxic") == 1, "total").otherwise("date").alias("field_name"),
        F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("original_value"),
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("corrected_value"),
        F.col("quality").alias("rating"), (F.col("toxic") == 1).alias("used_in_training"))


FILES = """files AS (
  SELECT *, concat('Report ', id, '.', coalesce(format, 'bin')) AS original_name FROM (
    SELECT o_orderkey AS id, o_custkey AS owner_id, concat(lower(o_orderstatus), '_', o_orderkey) AS name,
      CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'pdf' WHEN '2-HIGH' THEN 'xlsx' WHEN '3-MEDIUM' THEN 'csv'
        WHEN '4-NOT SPECIFIED' THEN 'docx' END AS format,
      CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
      o_totalprice > 300000 AS is_favorite, o_orderstatus = 'F' AS is_locally_stored,
      o_orderdate AS created_at, o_orderdate AS updated_at
    FROM orders))"""
ANALYSES = """analyses AS (
  SELECT l_orderkey AS file_id, CASE l_returnflag WHEN 'A' THEN 'invoice' WHEN 'R' THEN 'resume' END AS doc_type,
    CASE l_linestatus WHEN 'F' THEN 'completed' ELSE 'running' END AS status,
    CAST(l_quantity * 100 AS BIGINT) AS processing_ms, l_shipdate AS created_at, l_partkey AS part_id,
    CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS accepted
  FROM lineitem)"""
LOG = """log AS (
  SELECT event_id AS id, user_id, event_type AS type, value AS duration_ms, ts AS started_at FROM events)"""
PINGS = """pings AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS source, event_type <> 'error' AS ok, value AS latency_ms,
    ts AS pinged_at FROM events)"""
FEEDBACK = """feedback AS (
  SELECT doc_id AS id, doc_id AS file_id, o_custkey AS user_id,
    CASE toxic WHEN 1 THEN 'total' ELSE 'date' END AS field_name, concat('v', doc_id) AS original_value,
    concat('c', doc_id) AS corrected_value, quality AS rating, toxic = 1 AS used_in_training
  FROM labels JOIN orders ON doc_id = o_orderkey)"""


def with_(*relations: str, body: str) -> str:
    return "WITH " + ",\n".join(relations) + "\n" + body
