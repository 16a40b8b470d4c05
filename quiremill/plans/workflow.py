"""Saved workflows: a list of steps folded over a table."""
from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.operators import cleaning as C
from quiremill.operators import relational as R

STEPS = {
    "filter": lambda df, rule: df.where(R.filter_builder(rule)),
    "select": lambda df, cols: df.select(*cols),
    "delete": lambda df, cols: df.drop(*cols),
    "duplicate": lambda df, col, name: df.withColumn(name, F.col(col)),
    "rename": lambda df, names: df.withColumnsRenamed(names),
    "replace_regex": R.replace_regex,
    "replace_text": R.replace_text,
    "split_col": R.split_col,
    "merge_cols": R.merge_cols,
    "cast": R.cast_cols,
    "calc": R.calc_col,
    "drop_empty_rows": C.drop_empty_rows,
    "drop_empty_cols": C.drop_empty_cols,
    "dedup": C.dedup_rows,
    "trim": C.trim_strings,
    "fill": C.fill_nulls,
    "null_sentinels": C.null_sentinels,
    "sort": lambda df, cols: df.orderBy(*[F.col(c.lstrip("-")).desc() if c.startswith("-") else F.col(c) for c in cols]),
}


def run_workflow(df: DataFrame, steps: list[dict[str, Any]]) -> DataFrame:
    """Apply ``{"op": name, **params}`` steps in order; unknown steps raise."""
    for step in steps:
        params = dict(step)
        op = params.pop("op")
        if op not in STEPS:
            raise ValueError(f"unknown step: {op}")
        df = STEPS[op](df, **params)
    return df
