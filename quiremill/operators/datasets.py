"""Training datasets from feedback and verified analyses."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiremill.operators.relational import latest_per_key


def samples_from_feedback(feedback: DataFrame, datasets: DataFrame, analyses: DataFrame | None = None) -> DataFrame:
    """One ``train`` sample per feedback row whose user owns the dataset it is added to.

    Type and language missing in the feedback are taken from the newest analysis of the file.
    """
    owned = feedback.join(datasets.select(F.col("id").alias("dataset_id"), "created_by"), "dataset_id").where(
        F.col("created_by") == F.col("user_id"))
    doc_type, language = F.col("doc_type"), F.col("language")
    if analyses is not None:
        known = latest_per_key(analyses.select(
            "file_id", "created_at", F.col("doc_type").alias("_type"), F.col("language").alias("_language")), ["file_id"], ["created_at"])
        known = known.drop("created_at")
        owned = owned.join(known, "file_id", "left")
        doc_type, language = F.coalesce("doc_type", "_type"), F.coalesce("language", "_language")
    labels = F.to_json(F.struct(
        F.col("corrected_value").alias("correction"), F.col("original_value").alias("original"), F.col("field_name").alias("field")))
    return owned.select(
        "dataset_id", F.col("id").alias("feedback_id"), "file_id",
        F.concat(F.lit("feedback/"), F.col("id").cast("string")).alias("input_path"),
        labels.alias("labels"), doc_type.alias("doc_type"), language.alias("language"), F.lit("train").alias("split"))


def mark_used(feedback: DataFrame, samples: DataFrame) -> DataFrame:
    used = samples.select(F.col("feedback_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    return feedback.join(used, "id", "left").withColumn(
        "used_in_training", F.coalesce("_used", "used_in_training", F.lit(False))).drop("_used")


def pending_feedback(feedback: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Feedback that is not used yet, by its flag and, if given, by the samples made so far."""
    open_ = feedback.where(~F.coalesce("used_in_training", F.lit(False)))
    return open_ if samples is None else open_.join(
        samples.select(F.col("feedback_id").alias("id")), "id", "left_anti")


def train_split(df: DataFrame, key: Column, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """Stable split by a number derived from the id: ``key`` is an integer column expression.

    The same id always falls into the same part, whatever the partitioning.
    """
    if abs(train + val + test - 1) > 1e-9:
        raise ValueError("the shares must sum to 1")
    slot = F.pmod(key, F.lit(1000))
    label = F.when(slot < round(train * 1000), "train").when(slot < round((train + val) * 1000), "val").otherwise("test")
    return df.withColumn("split", label)


def hashed_key(*ids: str) -> Column:
    """Default key of ``train_split``."""
    return F.xxhash64(*ids)


def samples_from_analysis(analyses: DataFrame, entities: DataFrame) -> DataFrame:
    """Samples of analyses with verified entities: how many, of which types, and the best value of each type.

    Entities are reduced per (file, type) before they meet the analyses.
    """
    per_type = entities.where("verified").groupBy("file_id", "entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("value"))
    gathered = per_type.groupBy("file_id").agg(
        F.sum("n").alias("n_entities"),
        F.to_json(F.array_sort(F.collect_list(F.struct("entity_type", "value", "n")))).alias("labels"))
    return analyses.join(gathered, "file_id").select(
        "file_id", "doc_type", "language", "n_entities", "labels", F.lit("train").alias("split"))


def dataset_stats(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    return samples.groupBy(*(by or ["split", "doc_type", "language"])).agg(F.count(F.lit(1)).alias("n"))
