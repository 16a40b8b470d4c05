"""Finding the column by which two tables belong together."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKED = 3          # candidates that are checked exactly
LEAST_OVERLAP = 0.05  # estimated share of all values of a pair that both sides hold
KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DecimalType, T.DateType)


def _texts(df: DataFrame) -> dict[str, Column]:
    """Columns that can be keys, as text, so that equal values of different types agree."""
    return {f.name: F.col(f.name).cast("string") for f in df.schema.fields if isinstance(f.dataType, KEY_TYPES)}


def _sketches(df: DataFrame) -> list[tuple[str, bytes, int]]:
    """(column, sketch of its different values, values) from one pass; a sketch has a few kilobytes."""
    texts = _texts(df)
    row = df.agg(*[F.hll_sketch_agg(c).alias(f"s_{n}") for n, c in texts.items()], *[F.count(c).alias(f"n_{n}") for n, c in texts.items()]).first()
    return [(n, bytes(row[f"s_{n}"]), row[f"n_{n}"]) for n in texts if row[f"n_{n}"]]


def key_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_column, right_column, left_distinct, right_distinct, overlap): pairs of columns, by estimates from mergeable sketches.

    ``overlap`` is the share of the values of both that both hold. One side must be nearly free of repeats. Best first.
    """
    a, b = _sketches(left), _sketches(right)
    pairs = [(x, y, n, m, s, t) for x, s, n in a for y, t, m in b]
    kinds = "left_column string, right_column string, left_values bigint, right_values bigint, s binary, t binary"
    rows = left.sparkSession.createDataFrame(pairs, kinds)          # a row for every two columns
    rows = rows.select(
        "left_column", "right_column", "left_values", "right_values", F.hll_sketch_estimate("s").alias("left_distinct"),
        F.hll_sketch_estimate("t").alias("right_distinct"), F.hll_sketch_estimate(F.hll_union("s", "t")).alias("all"))
    shared = F.greatest(F.col("left_distinct") + F.col("right_distinct") - F.col("all"), F.lit(0))
    rows = rows.withColumn("overlap", shared / F.greatest("all", F.lit(1)))
    alone = (F.col("left_distinct") >= F.col("left_values") * 0.9) | (F.col("right_distinct") >= F.col("right_values") * 0.9)
    return rows.where(alone & (F.col("overlap") >= LEAST_OVERLAP)).orderBy(F.desc("overlap"), "left_column", "right_column").select(
        "left_column", "right_column", "left_distinct", "right_distinct", "overlap")


def common_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_column, right_column, left_distinct, right_distinct, shared): the pair of columns by which the tables belong together.

    The best candidates by estimate are counted exactly. The pair wins that shares the largest part of its values, of those of which one
    side has no repeat; none gives no row. NULLs are no values.
    """
    best = None
    for c in key_candidates(left, right).limit(CHECKED).collect():
        a = left.groupBy(_texts(left)[c.left_column].alias("v")).agg(F.count(F.lit(1)).alias("a"))
        b = right.groupBy(_texts(right)[c.right_column].alias("v")).agg(F.count(F.lit(1)).alias("b"))
        both = a.where("v IS NOT NULL").join(b.where("v IS NOT NULL"), "v", "full")
        found = both.agg(F.count("a").alias("left_distinct"), F.count("b").alias("right_distinct"),
                         F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"),
                         (F.coalesce(F.max("a") == 1, F.lit(False)) | F.coalesce(F.max("b") == 1, F.lit(False))).alias("alone"))
        found = found.select(F.lit(c.left_column).alias("left_column"), F.lit(c.right_column).alias("right_column"), "*")
        best = found if best is None else best.union(found)
    if best is None:
        kinds = "left_column string, right_column string, left_distinct bigint, right_distinct bigint, shared bigint"
        return left.sparkSession.createDataFrame([], kinds)
    share = F.col("shared") / (F.col("left_distinct") + F.col("right_distinct") - F.col("shared"))
    return best.where("alone AND shared > 0").orderBy(F.desc(share), "left_column", "right_column").limit(1).drop("alone")


def join_on_common_key(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """The tables joined by their common key, which keeps the left name; other names that clash get ``_2``."""
    key = common_key(left, right).first()
    if key is None:
        raise ValueError("the tables have no common key")
    clash = set(left.columns)
    renamed = right.select(*[F.col(c).alias(key.left_column if c == key.right_column else f"{c}_2" if c in clash else c) for c in right.columns])
    same = left.schema[key.left_column].dataType == renamed.schema[key.left_column].dataType
    if not same:
        renamed = renamed.withColumn(key.left_column, F.col(key.left_column).try_cast(left.schema[key.left_column].dataType))
    return left.join(renamed, key.left_column, how)
