"""Streaming queries over the given tables, run to the end of what is there."""
from __future__ import annotations

from pyspark.sql import functions as F

from quiremill.functions import text as X
from quiremill.operators import search as S
from quiremill.operators import versions
from quiremill.plans.registry import SQL, Tables, plan
from quiremill.plans.relations import PINGS, with_
from quiremill.plans.searching import CHUNKS
from quiremill.plans.text import CONTACTS, contact_lines
from quiremill.session import scratch_path
from quiremill.sources import folders
from quiremill.streaming import jobs


def _stream(t: Tables, name: str):
    """The files of a table as a stream: those of its folder, or the one file of its name among other tables."""
    if folders.is_folder(t.spark, t.path(name)):
        return jobs.stream_folder(t.spark, t.path(name), getattr(t, name).schema)
    return jobs.stream_folder(t.spark, t.folder, getattr(t, name).schema, f"{name}.parquet")


@plan("stream_daily", "SELECT CAST(ts AS DATE) AS day, count(*) AS count FROM events GROUP BY 1")
def stream_daily(t: Tables):
    out = scratch_path(t.spark, "daily")
    jobs.run_updates(jobs.daily_counts(_stream(t, "events"), "ts"), out, ["day"])
    return jobs.newest(t.spark, out, ["day"])


@plan("stream_dedup", "SELECT DISTINCT user_id FROM events")
def stream_dedup(t: Tables):
    out = scratch_path(t.spark, "dedup")
    first = jobs.first_per_key(_stream(t, "events").select("user_id", "ts"), "ts", "user_id", "60 days")
    jobs.run_available(first.select("user_id"), out)
    return t.spark.read.schema("user_id bigint").parquet(f"{out}/data")


@plan("stream_index", "WITH RECURSIVE " + CHUNKS + " SELECT file_id, chunk_index, chunk_text FROM chunks")
def stream_index(t: Tables):
    out = scratch_path(t.spark, "index")
    jobs.index_stream(_stream(t, "documents").select("doc_id", "text"), f"{out}/table", f"{out}/checkpoint")
    return S.read_chunks(t.spark, f"{out}/table")


@plan("stream_analyze", f"""SELECT a.*, coalesce(n_chunks, 0) AS n_chunks, n_emails + n_phones + n_dates + n_urls + n_ibans AS n_entities
  FROM (SELECT doc_id, doc_type, confidence, language, pipeline_used, n_emails, n_phones, n_dates, n_urls, n_ibans, n_fields FROM ({SQL["analyze_documents"]})) a
  LEFT JOIN (WITH RECURSIVE {CONTACTS}, {CHUNKS.replace("FROM documents", "FROM contacts")} SELECT file_id AS doc_id, count(*) AS n_chunks FROM chunks GROUP BY ALL) USING (doc_id)""")
def stream_analyze(t: Tables):
    """Arriving documents, analyzed and indexed in one versioned table, joined from its three parts."""
    out = scratch_path(t.spark, "analyses")
    jobs.analyze_stream(contact_lines(_stream(t, "documents")), f"{out}/table", f"{out}/checkpoint")
    analyses, entities, chunks = (versions.read(t.spark, f"{out}/table", part) for part in ("analyses", "entities", "chunks"))
    common = entities.where(F.col("entity_type").isin(list(X.COMMON))).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_entities"))
    cut = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    found = analyses.join(common, "file_id", "left").join(cut, "file_id", "left").fillna(0, ["n_entities", "n_chunks"])
    return found.select(
        F.col("file_id").alias("doc_id"), "doc_type", "confidence", "language", "pipeline_used", "n_emails", "n_phones", "n_dates", "n_urls", "n_ibans",
        "n_fields", "n_chunks", F.col("n_entities").cast("int").alias("n_entities"))


@plan("stream_late", """WITH closed AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events WHERE event_id % 2 = 0)
SELECT CAST(event_id % 2 AS INTEGER) AS arrival, count(*) AS input_rows,
  count(*) FILTER (WHERE event_id % 2 = 1 AND date_trunc('day', ts) + INTERVAL 1 DAY <= mark) AS dropped FROM events, closed GROUP BY ALL""")
def stream_late(t: Tables):
    """Half of the events arrive first; of those that follow, the ones behind the watermark are dropped and counted."""
    inbox, out, last = scratch_path(t.spark, "inbox"), scratch_path(t.spark, "late"), []
    for half in (0, 1):
        t.events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(inbox)
        jobs.run_updates(jobs.daily_counts(jobs.stream_folder(t.spark, inbox, t.events.schema), "ts", "2 days"), out, ["day"])
        last.append(jobs.late_rows(t.spark, out, ["day"]).agg(F.max("batch")).first()[0])
    late = jobs.late_rows(t.spark, out, ["day"])
    return late.groupBy((F.col("batch") > last[0]).cast("int").alias("arrival")).agg(
        F.sum("input_rows").alias("input_rows"), F.sum("dropped").alias("dropped"))


@plan("stream_ping_state", with_(PINGS, body="""SELECT source, count(*) AS total, count(*) FILTER (WHERE NOT ok) AS fails, max(last_ids) AS last_ids FROM pings
  JOIN (SELECT source, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS last_ids FROM
    (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY pinged_at DESC, id DESC) AS rank FROM pings QUALIFY rank <= 10) GROUP BY source) USING (source)
  GROUP BY source"""))
def stream_ping_state(t: Tables):
    out = scratch_path(t.spark, "pings")
    events = _stream(t, "events")
    pings = events.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("source"),
        (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"), F.col("ts").alias("pinged_at"))
    jobs.run_ping_state(pings, out)
    return jobs.ping_table(t.spark, out)
