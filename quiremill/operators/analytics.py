"""Usage statistics over the metadata relations, for one owner or for all owners at once."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiremill.functions import labels as L
from quiremill.operators.relational import top_n_per_key


def percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, 0 when the whole is 0."""
    return F.when(whole > 0, F.bround(part / whole * 100, 1)).otherwise(F.lit(0.0))


def total_size(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"))


def average_seconds(ms: str | Column) -> Column:
    """Mean of milliseconds as seconds with one decimal, 0 when there is none."""
    return F.bround(F.coalesce(F.avg(ms), F.lit(0.0)) / 1000, 1)


def counts_by(df: DataFrame, key: str, name: str = "count") -> DataFrame:
    """Rows per key with ``unknown`` for a missing or empty key."""
    label = F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("unknown"))
    return df.groupBy(label.alias(key)).agg(F.count(F.lit(1)).alias(name))


def daily_trend(df: DataFrame, ts: str, as_of: Column, days: int = 30) -> DataFrame:
    recent = df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("count")).orderBy("day")


def top_groups(df: DataFrame, key: str, n: int = 15) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), key).limit(n)


def per_file_analyses(analyses: DataFrame) -> DataFrame:
    """Analysis figures per file, combined before any join so that one busy file stays one row."""
    done = F.col("status") == "completed"
    return analyses.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("analyses"),
        F.count_if(done).alias("completed"),
        F.sum(F.when(done, F.col("processing_ms"))).alias("ms_sum"),
        F.count(F.when(done, F.col("processing_ms"))).alias("ms_count"),
    )


def overview(files: DataFrame, analyses: DataFrame, entities: DataFrame, tables: DataFrame,
             feedback: DataFrame, suggestions: DataFrame, as_of: Column) -> DataFrame:
    """Eight figures per owner.

    Each fact table is reduced to one row per file with its own single pass, the
    files carry the sums to their owners, and owners are unique on both sides of
    the last join.
    """
    facts = [
        per_file_analyses(analyses),
        entities.groupBy("file_id").agg(F.count(F.lit(1)).alias("entities")),
        tables.groupBy("file_id").agg(F.count(F.lit(1)).alias("tables")),
        suggestions.groupBy("file_id").agg(
            F.count("accepted").alias("judged"), F.count_if(F.col("accepted")).alias("accepted")),
    ]
    base = files.select(F.col("id").alias("file_id"), "owner_id", "created_at")
    wide = reduce(lambda a, b: a.join(b, "file_id", "left"), facts, base)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    by_owner = wide.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("created_at") >= as_of - F.expr("INTERVAL 7 DAYS")).alias("files_this_week"),
        total("completed").alias("completed_analyses"),
        F.bround(F.coalesce(F.sum("ms_sum") / F.nullif(F.sum("ms_count"), F.lit(0)), F.lit(0.0)) / 1000, 1)
        .alias("avg_processing_sec"),
        total("entities").alias("total_entities"),
        total("tables").alias("total_tables"),
        percent(total("accepted"), total("judged")).alias("suggestion_acceptance_rate"),
    )
    given = feedback.groupBy(F.col("user_id").alias("owner_id")).agg(F.count(F.lit(1)).alias("total_feedback"))
    return by_owner.join(given, "owner_id", "left").withColumn("total_feedback", F.coalesce("total_feedback", F.lit(0)))


def storage_stats(files: DataFrame) -> DataFrame:
    """Per owner: totals, local and cloud files, favorites and a format map.

    Formats are counted per (owner, format) first, so the map of an owner has one
    entry per format.
    """
    fmt = F.coalesce(F.nullif(F.col("format"), F.lit("")), F.lit("unknown")).alias("format")
    per_format = files.groupBy("owner_id", fmt).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("size"),
        F.count_if("is_locally_stored").alias("local"), F.count_if("is_favorite").alias("favorites"))
    return per_format.groupBy("owner_id").agg(
        F.sum("n").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size_bytes"),
        F.sum("local").alias("locally_stored"), (F.sum("n") - F.sum("local")).alias("cloud_files"),
        F.sum("favorites").alias("favorites"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("format", "n")))).alias("formats"))


def ping_stats(pings: DataFrame) -> DataFrame:
    last = F.max(F.struct("pinged_at", "id", "latency_ms", "ok"))
    return pings.agg(
        F.count(F.lit(1)).alias("total_pings"), F.count_if(~F.col("ok")).alias("total_fails"),
        last["pinged_at"].alias("last_ping_at"), last["latency_ms"].alias("last_latency_ms"), last["ok"].alias("last_status"))


def flags_by_group(models: DataFrame, key: str, flags: dict[str, str]) -> DataFrame:
    """Rows per task, each with flags telling whether a task is present anywhere."""
    counts = counts_by(models, key)
    present = counts.agg(*[F.coalesce(F.bool_or(F.col(key) == v), F.lit(False)).alias(n) for n, v in flags.items()])
    return counts.withColumns({n: present.select(n).scalar() for n in flags})


def dashboard(files: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """The parts of the start page, for all owners: totals, format counts, recent rows and favorites."""
    operations = log.groupBy(F.col("user_id").alias("owner_id")).agg(F.count(F.lit(1)).alias("total_operations"))
    totals = files.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"))
    totals = totals.join(operations, "owner_id", "left").withColumns({
        "total_operations": F.coalesce("total_operations", F.lit(0)),
        "total_size_human": L.human_size("total_size_bytes"),
    })
    return {
        "totals": totals,
        "formats": files.groupBy("owner_id", "format").agg(F.count(F.lit(1)).alias("count")),
        "recent_files": top_n_per_key(files, ["owner_id"], [F.desc("created_at"), F.desc("id")], 6),
        "recent_operations": top_n_per_key(log, ["user_id"], [F.desc("started_at"), F.desc("id")], 8),
        "favorites": top_n_per_key(files.where("is_favorite"), ["owner_id"], [F.desc("updated_at"), F.desc("id")], 4),
    }


def profile_shape(df: DataFrame) -> DataFrame:
    """(column, dtype, total_rows, total_cols), one line per column."""
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype")) for c, t in df.dtypes])
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        F.inline(lines), "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_cols"))


def pivot_table(df: DataFrame, rows: list[str], col: str, values: list, aggs: dict[str, Column]) -> DataFrame:
    """Pivot with known values, so no extra job looks for them."""
    return df.groupBy(*rows).pivot(col, values).agg(*[a.alias(n) for n, a in aggs.items()])


def rollup_table(df: DataFrame, cols: list[str], aggs: dict[str, Column]) -> DataFrame:
    return df.rollup(*cols).agg(F.grouping_id().cast("bigint").alias("grouping_id"), *[a.alias(n) for n, a in aggs.items()])


def cube_table(df: DataFrame, cols: list[str], aggs: dict[str, Column]) -> DataFrame:
    return df.cube(*cols).agg(F.grouping_id().cast("bigint").alias("grouping_id"), *[a.alias(n) for n, a in aggs.items()])


def extraction_accuracy(found: DataFrame, key: str = "entity_type") -> DataFrame:
    """(type, n, corrected, accuracy): share of the extracted values of each type that no correction changed.

    ``found`` holds one row per extracted value with the flag ``corrected``.
    """
    n, wrong = F.count(F.lit(1)), F.count_if("corrected")
    return found.groupBy(key).agg(n.alias("n"), wrong.alias("corrected"), F.round((n - wrong) / n, 6).alias("accuracy"))
