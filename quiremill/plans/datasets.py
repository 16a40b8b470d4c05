"""Queries that build training datasets from feedback and analyses."""
from __future__ import annotations

from pyspark.sql import functions as F

from quiremill.operators import analytics as A
from quiremill.operators import datasets as DS
from quiremill.operators import documents as D
from quiremill.plans import relations as rel
from quiremill.plans.registry import Tables, plan
from quiremill.plans.relations import FEEDBACK, with_

# Customers outside one segment own the dataset with their own number.
_DATASETS = "datasets AS (SELECT c_custkey AS id, c_custkey AS created_by FROM customer WHERE c_mktsegment <> 'BUILDING')"


def _datasets(t: Tables):
    owners = t.customer.where("c_mktsegment <> 'BUILDING'")
    return owners.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("created_by"))


def _feedback(t: Tables):
    return rel.feedback(t).withColumns({
        "dataset_id": F.col("user_id"), "doc_type": F.lit(None).cast("string"), "language": F.lit(None).cast("string")})


def _analyses(t: Tables):
    return t.documents.select(F.col("doc_id").alias("file_id"), F.col("source").alias("doc_type"), F.col("lang").alias("language"))


def _versions(t: Tables):
    """Every analysis, and a later one of each third file."""
    first = _analyses(t).withColumn("created_at", F.lit(1))
    again = first.where("file_id % 3 = 0").withColumns({"doc_type": F.concat(F.lit("re"), "doc_type"), "created_at": F.lit(2)})
    return first.unionByName(again)


_SAMPLES = _DATASETS + """, samples AS (SELECT d.id AS dataset_id, f.id AS feedback_id, f.file_id, concat('feedback/', f.id) AS input_path,
  concat('{"correction":"', corrected_value, '","original":"', original_value, '","field":"', field_name, '"}') AS labels, CASE WHEN f.file_id % 3 = 0 THEN concat('re', a.source) ELSE a.source END AS doc_type, a.lang AS language, 'train' AS split
  FROM feedback f JOIN datasets d ON d.created_by = f.user_id LEFT JOIN documents a ON a.doc_id = f.file_id)"""


def samples(t: Tables):
    return DS.samples_from_feedback(_feedback(t), _datasets(t), _versions(t))


@plan("samples_from_feedback", with_(FEEDBACK, _SAMPLES, body="SELECT * FROM samples"))
def samples_from_feedback(t: Tables):
    return samples(t)


@plan("mark_used", with_(FEEDBACK, _SAMPLES, body="SELECT id, used_in_training OR id IN (SELECT feedback_id FROM samples) AS used_in_training FROM feedback"))
def mark_used(t: Tables):
    return DS.mark_used(_feedback(t), samples(t)).select("id", "used_in_training")


@plan("pending_feedback", with_(FEEDBACK, _SAMPLES, body="SELECT id, field_name FROM feedback WHERE NOT used_in_training AND id NOT IN (SELECT feedback_id FROM samples)"))
def pending_feedback(t: Tables):
    return DS.pending_feedback(_feedback(t), samples(t)).select("id", "field_name")


@plan("train_split", """SELECT doc_id, CASE WHEN s < 800 THEN 'train' WHEN s < 900 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT doc_id, (doc_id * 7919 + 13) % 1000 AS s FROM documents)""")
def train_split(t: Tables):
    # An arithmetic key, which other engines can repeat; the library default is a hash.
    return DS.train_split(t.documents.select("doc_id"), F.col("doc_id") * 7919 + 13)


@plan("dataset_stats", """SELECT split, doc_type, language, count(*) AS n FROM (SELECT source AS doc_type, lang AS language,
    CASE WHEN (doc_id * 7919 + 13) % 1000 < 800 THEN 'train' WHEN (doc_id * 7919 + 13) % 1000 < 900 THEN 'val' ELSE 'test' END AS split FROM documents) GROUP BY ALL""")
def dataset_stats(t: Tables):
    docs = t.documents.select("doc_id", F.col("source").alias("doc_type"), F.col("lang").alias("language"))
    return DS.dataset_stats(DS.train_split(docs, F.col("doc_id") * 7919 + 13))


_ENTITIES = """ents AS (SELECT l_orderkey AS file_id, l_returnflag AS entity_type, concat('v', l_partkey) AS value, l_linestatus = 'F' AS verified FROM lineitem)"""


def _entities(t: Tables):
    return t.lineitem.select(
        F.col("l_orderkey").alias("file_id"), F.col("l_returnflag").alias("entity_type"),
        F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("value"), (F.col("l_linestatus") == "F").alias("verified"))


@plan("samples_from_analysis", with_(_ENTITIES, body="""SELECT d.doc_id AS file_id, d.source AS doc_type, d.lang AS language, n_entities, concat('[', labels, ']') AS labels, 'train' AS split
  FROM documents d JOIN (SELECT file_id, CAST(sum(n) AS BIGINT) AS n_entities, string_agg(concat('{"entity_type":"', entity_type, '","value":"', value, '","n":', n, '}'), ',' ORDER BY entity_type) AS labels
    FROM (SELECT file_id, entity_type, count(*) AS n, min(value) AS value FROM ents WHERE verified GROUP BY file_id, entity_type) GROUP BY file_id) e ON e.file_id = d.doc_id"""))
def samples_from_analysis(t: Tables):
    return DS.samples_from_analysis(_analyses(t), _entities(t))


@plan("apply_corrections", with_(_ENTITIES, body="""SELECT e.file_id, e.entity_type, coalesce(c.fix, e.value) AS value, c.fix IS NOT NULL AS verified
  FROM (SELECT file_id, entity_type, min(value) AS value FROM ents GROUP BY ALL) e
  LEFT JOIN (SELECT l_orderkey AS file_id, l_returnflag AS entity_type, concat('c', arg_max(l_suppkey, l_shipdate * 1)) AS fix FROM
    (SELECT l_orderkey, l_returnflag, l_suppkey, epoch_us(l_shipdate) * 1000 + l_suppkey % 1000 AS l_shipdate FROM lineitem WHERE l_quantity > 40) GROUP BY ALL) c USING (file_id, entity_type)"""))
def apply_corrections(t: Tables):
    found = _entities(t).groupBy("file_id", "entity_type").agg(F.min("value").alias("value"))
    fixes = t.lineitem.where("l_quantity > 40").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_returnflag").alias("entity_type"), F.col("l_shipdate").alias("created_at"),
        F.col("l_suppkey").alias("id"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("corrected_value"))
    return D.apply_corrections(found, fixes, ["file_id", "entity_type"], ["created_at", "id"])


@plan("accuracy_by_type", with_(_ENTITIES, body="""SELECT entity_type, count(*) AS n, count(c.file_id) AS corrected, round((count(*) - count(c.file_id)) / count(*), 6) AS accuracy
  FROM (SELECT DISTINCT file_id, entity_type FROM ents) e
  LEFT JOIN (SELECT DISTINCT l_orderkey AS file_id, l_returnflag AS entity_type FROM lineitem WHERE l_quantity > 40) c USING (file_id, entity_type) GROUP BY entity_type"""))
def accuracy_by_type(t: Tables):
    found = _entities(t).select("file_id", "entity_type").distinct()
    fixed = t.lineitem.where("l_quantity > 40").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_returnflag").alias("entity_type")).distinct().withColumn("_c", F.lit(True))
    judged = found.join(fixed, ["file_id", "entity_type"], "left").withColumn("corrected", F.coalesce("_c", F.lit(False)))
    return A.extraction_accuracy(judged)
