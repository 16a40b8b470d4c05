"""Filters, lookups, joins, sorts, pages, merges and comparisons."""
from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiremill.functions.cleaning import all_of, any_of
from quiremill.session import written


# --- predicates ------------------------------------------------------------------

def contains_ignore_case(columns: list[str], query: str) -> Column:
    """Case-insensitive match in any column; ``%`` and ``_`` stay wildcards."""
    return any_of([F.col(c).ilike(f"%{query}%") for c in columns])


def newer_than(ts: str, as_of: Column, days: int) -> Column:
    return F.col(ts) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def list_files(files: DataFrame, owner_id: int | None = None, search: str | None = None,
               fmt: str | None = None, only_local: bool = False) -> DataFrame:
    """Files that pass every filter given; empty filters are skipped."""
    conditions = []
    if owner_id is not None:
        conditions.append(F.col("owner_id") == owner_id)
    if search:
        conditions.append(contains_ignore_case(["original_name", "name"], search))
    if fmt:
        conditions.append(F.col("format") == fmt)
    if only_local:
        conditions.append(F.col("is_locally_stored"))
    return files.where(all_of(conditions)) if conditions else files


def old_files(files: DataFrame, as_of: Column, days: int = 30, exclude_favorites: bool = True,
              owner_id: int | None = None) -> DataFrame:
    df = files.where(F.col("created_at") < as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    if owner_id is not None:
        df = df.where(F.col("owner_id") == owner_id)
    return df.where(~F.col("is_favorite")) if exclude_favorites else df


_LEAVES = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "between": lambda c, v: c.between(v[0], v[1]),
    "contains": lambda c, v: c.contains(v),
    "starts": lambda c, v: c.startswith(v),
    "ends": lambda c, v: c.endswith(v),
    "regex": lambda c, v: c.rlike(v),
    "date_from": lambda c, v: c >= F.to_timestamp_ntz(F.lit(v)),
    "date_to": lambda c, v: c < F.to_timestamp_ntz(F.lit(v)),
    "is_null": lambda c, v: c.isNull(),
    "not_null": lambda c, v: c.isNotNull(),
}


def filter_builder(rule: dict[str, Any]) -> Column:
    """Fold a rule tree into one predicate, which Catalyst pushes to the scan where it can.

    Inner nodes: ``{"op": "and"|"or"|"not", "rules": [...]}``; leaves:
    ``{"op": "gt", "col": "price", "value": 5}`` or ``{"op": "expr", "value": "a > b"}``.
    """
    op = rule["op"]
    if op in ("and", "or"):
        return (all_of if op == "and" else any_of)([filter_builder(r) for r in rule["rules"]])
    if op == "not":
        return ~filter_builder(rule["rules"][0])
    if op == "expr":
        return F.expr(rule["value"])
    if op not in _LEAVES:
        raise ValueError(f"unknown filter: {op}")
    return _LEAVES[op](F.col(rule["col"]), rule.get("value"))


# --- column edits ------------------------------------------------------------------

def replace_regex(df: DataFrame, cols: list[str], pattern: str, replacement: str) -> DataFrame:
    return df.withColumns({c: F.regexp_replace(c, pattern, replacement) for c in cols})


def replace_text(df: DataFrame, cols: list[str], old: str, new: str) -> DataFrame:
    return df.withColumns({c: F.replace(F.col(c), F.lit(old), F.lit(new)) for c in cols})


def split_col(df: DataFrame, col: str, sep: str, names: list[str]) -> DataFrame:
    """Split at a literal separator into named columns; missing parts are NULL."""
    parts = F.split(F.col(col), f"\\Q{sep}\\E")
    return df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(names)})


def merge_cols(df: DataFrame, cols: list[str], sep: str, name: str) -> DataFrame:
    return df.withColumn(name, F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]))


def cast_cols(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Change column types; values that do not fit become NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def calc_col(df: DataFrame, name: str, expression: str) -> DataFrame:
    return df.withColumn(name, F.expr(expression))


# --- sorting and pages ----------------------------------------------------------------

SORT_COLUMNS = {"name": "original_name", "size": "size_bytes", "updated_at": "updated_at"}


def sort_files(files: DataFrame, sort_by: str = "created_at", sort_order: str = "desc", key: str = "id") -> DataFrame:
    """Sort by one of four columns; unknown names mean ``created_at``, anything but ``asc`` is descending."""
    c = F.col(SORT_COLUMNS.get(sort_by, "created_at"))
    return files.orderBy(c.asc() if sort_order == "asc" else c.desc(), F.col(key))


def page_of(df: DataFrame, order: list[Column], page: int = 1, per_page: int = 20) -> DataFrame:
    """One page in a given order; Spark keeps only the rows up to its end per task."""
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def page_after(df: DataFrame, order: dict[str, str], last: list[Any], per_page: int = 20) -> DataFrame:
    """The page that follows a row, named by its values in the order: deep pages cost no more than the first.

    ``order`` maps columns to ``asc`` or ``desc``; ``last`` holds the last row's values.
    """
    behind, equal = F.lit(False), F.lit(True)
    for (c, way), value in zip(order.items(), last):
        bound = F.lit(value).cast(df.schema[c].dataType)
        behind = behind | (equal & (F.col(c) > bound if way == "asc" else F.col(c) < bound))
        equal = equal & (F.col(c) == bound)
    return df.where(behind).orderBy(*[F.col(c).asc() if way == "asc" else F.col(c).desc() for c, way in order.items()]).limit(per_page)


def page_totals(df: DataFrame, per_page: int = 20) -> DataFrame:
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.greatest(F.ceil(total / per_page), F.lit(1)).cast("bigint").alias("pages"))


def natural_key(c: str) -> Column:
    """Text whose digit runs are padded, so that plain ordering gives natural ordering."""
    padded = F.regexp_replace(F.lower(F.col(c)), r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{20})(?!\d)", "$1")


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Places 1, 2, … of all rows in a given order, without one task that sees them all.

    Rows are dealt out by ranges of the order and stored; a place is the number of rows in
    the ranges before (one count per range) and the place within its own range.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).collect()          # one row a range
    before, total = [], 0
    for r in sorted(sizes, key=lambda r: r["_range"]):
        before.append((r["_range"], total))
        total += r["_n"]
    starts = df.sparkSession.createDataFrame(before, "_range int, _before bigint")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, place).drop("_range", "_before")


def natural_sort(df: DataFrame, col: str, asc: bool = True) -> DataFrame:
    key = natural_key(col)
    return df.orderBy(key.asc() if asc else key.desc(), F.col(col))


def custom_rank(col: str, order: list[Any]) -> Column:
    """Position of a value in a list; values outside the list come last."""
    rank = F.lit(len(order))
    for i, value in reversed(list(enumerate(order))):
        rank = F.when(F.col(col) == value, F.lit(i)).otherwise(rank)
    return rank


def custom_sort(df: DataFrame, col: str, order: list[Any], then: list[Column]) -> DataFrame:
    return df.orderBy(custom_rank(col, order), *then)


# --- per-key selections -----------------------------------------------------------------

def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` columns of every key.

    A struct maximum is combined before the shuffle, so a key that holds a large
    share of the rows sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [*order, *rest]])


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of every key.

    Spark drops rows beyond ``n`` per key and task before the shuffle (window group
    limit), so hot keys stay small.
    """
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("bigint"))


def one_default_per_group(df: DataFrame, group: str, key: str, order: list[str], flag: str = "is_default") -> DataFrame:
    """Mark the row with the greatest ``order`` columns of every group as the only default."""
    chosen = df.groupBy(group).agg(F.max(F.struct(*order, key))[key].alias("_chosen"))
    return df.join(chosen, group, "left").withColumn(flag, F.col(key) == F.col("_chosen")).drop("_chosen")


# --- joins ----------------------------------------------------------------------------------

def membership_flag(df: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """Left join to the distinct keys of another table; the other side is reduced before the join."""
    keys = other.select(key).distinct().withColumn("_present", F.lit(True))
    return df.join(keys, key, "left").withColumn(flag, F.coalesce("_present", F.lit(False))).drop("_present")


def count_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str) -> DataFrame:
    """Child count of every parent, zero included. Children are counted before the join."""
    counts = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counts, parent_key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def merge_horizontal(dfs: list[DataFrame], keys: list[str], how: str = "inner",
                     suffixes: list[str] | None = None) -> DataFrame:
    """Join tables side by side; clashing columns get a suffix per table."""
    suffixes = suffixes or [f"_{i + 1}" for i in range(len(dfs))]
    names = [c for df in dfs for c in df.columns if c not in keys]
    clash = {c for c in names if names.count(c) > 1}
    renamed = [
        df.withColumnsRenamed({c: c + s for c in df.columns if c in clash}) for df, s in zip(dfs, suffixes)
    ]
    return reduce(lambda a, b: a.join(b, keys, how), renamed)


# --- unions and comparison ---------------------------------------------------------------------

def merge_vertical(dfs: list[DataFrame], names: list[str]) -> DataFrame:
    """Stack tables by column name with their source name and order."""
    if len(dfs) < 2:
        raise ValueError("a merge needs at least two tables")
    tagged = [
        df.withColumns({"source_file": F.lit(n), "source_order": F.lit(i)})
        for i, (df, n) in enumerate(zip(dfs, names), start=1)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def _long_changes(joined: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"l.{c}").cast("string").alias("old"),
                 F.col(f"r.{c}").cast("string").alias("new"), (~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))).alias("differs"))
        for c in values
    ])
    return (
        joined.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.explode(F.filter(cells, lambda x: x["differs"])).alias("x"))
        .select(*keys, "x.column", "x.old", "x.new")
    )


def keys_unique(df: DataFrame, keys: list[str]) -> bool:
    return df.groupBy(*keys).count().where("count > 1").isEmpty()


def compare(left: DataFrame, right: DataFrame, keys: list[str] | None = None,
            check_keys: bool = True) -> dict[str, DataFrame]:
    """Rows added and removed and cells changed from ``left`` to ``right``.

    Without keys, rows are compared as a multiset and ``changed`` is missing. A key that
    repeats raises; ``check_keys=False`` spares that pass where keys are known to be unique.
    """
    if keys and check_keys and not (keys_unique(left, keys) and keys_unique(right, keys)):
        raise ValueError(f"repeated key: {', '.join(keys)}")
    if not keys:
        return {"added": _surplus(right, left), "removed": _surplus(left, right)}
    l, r = left.alias("l"), right.alias("r")
    same = all_of([F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    values = [c for c in left.columns if c in right.columns and c not in keys]
    return {
        "added": r.join(l, same, "left_anti"),
        "removed": l.join(r, same, "left_anti"),
        "changed": _long_changes(l.join(r, same, "inner"), keys, values),
    }


def _surplus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` beyond their copies in ``b``, as (row, surplus) with one line per distinct row.

    Counting before the shuffle keeps a row that repeats very often cheap.
    """
    cols = a.columns
    counted = a.withColumn("_d", F.lit(1)).unionByName(b.select(cols).withColumn("_d", F.lit(-1)))
    return counted.groupBy(*cols).agg(F.sum("_d").alias("surplus")).where("surplus > 0")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
