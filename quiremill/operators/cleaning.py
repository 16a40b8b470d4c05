"""Table cleaning as DataFrame transforms, one select per step over all columns."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quiremill.functions import cleaning as C
from quiremill.functions import values as V
from quiremill.operators.relational import string_columns
from quiremill.session import written


# --- typed tables -------------------------------------------------------------------

def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose values are all NULL (NaN is a value)."""
    return df.where(~C.all_of([F.col(c).isNull() for c in df.columns]))


def non_null_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns])


def drop_empty_cols(df: DataFrame) -> DataFrame:
    """Drop columns without any value; a table without rows keeps its columns.

    One pass brings one row of counts to the driver to decide the schema.
    """
    counts = non_null_counts(df).first().asDict()
    if not counts.pop("_rows"):
        return df
    return df.drop(*[c for c, n in counts.items() if n == 0])


def trim_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: C.strip(c) for c in string_columns(df)})


def fill_nulls(df: DataFrame, value: str) -> DataFrame:
    return df.fillna(value)


def fill_nulls_typed(df: DataFrame, value: str) -> DataFrame:
    """Fill every column whose type the value fits."""
    return df.withColumns({f.name: F.coalesce(F.col(f.name), F.lit(value).try_cast(f.dataType)) for f in df.schema.fields})


def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_keep_first(df: DataFrame, row_id: str) -> DataFrame:
    """Keep the first copy, by row id, of rows equal in all other columns.

    Grouping with a minimum is combined map-side: a row copied many times does
    not gather in one task.
    """
    cols = [c for c in df.columns if c != row_id]
    return df.groupBy(*cols).agg(F.min(row_id).alias(row_id)).select(df.columns)


def clean_table(df: DataFrame, remove_empty_rows: bool = True, remove_empty_cols: bool = True,
                remove_duplicates: bool = True, trim_spaces: bool = True, fill: str | None = None) -> DataFrame:
    """Empty rows, empty columns, duplicates, trimming, filling, in this order.

    Duplicates are removed before trimming, so trimming can make new ones.
    """
    steps = [
        (remove_empty_rows, drop_empty_rows), (remove_empty_cols, drop_empty_cols),
        (remove_duplicates, dedup_rows), (trim_spaces, trim_strings),
        (fill is not None, lambda d: fill_nulls(d, fill)),
    ]
    for wanted, step in steps:
        if wanted:
            df = df.transform(step)
    return df


def null_sentinels(df: DataFrame) -> DataFrame:
    return df.withColumns({c: C.null_if_sentinel(c) for c in string_columns(df)})


def clean_to(df: DataFrame, path: str, fill: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(cleaned, report): write the cleaned table below ``path`` and count what it took on the way, in one pass over the input.

    The report has the fields of ``cleaning_report``; its counters are observed by the plan that writes. Which columns are
    empty is known only then, so they are written and left out when the table is read.
    """
    cols = df.columns
    empty = C.all_of([F.col(c).isNull() for c in cols])
    before, after = Observation(), Observation()
    rows = df.observe(before, F.count(F.lit(1)).alias("rows"), F.count_if(empty).alias("empty"), *[F.count(c).alias(f"n_{c}") for c in cols])
    rows = dedup_rows(drop_empty_rows(rows)).observe(after, F.count(F.lit(1)).alias("rows"))
    rows = trim_strings(rows)
    (rows if fill is None else fill_nulls(rows, fill)).write.mode("overwrite").parquet(path)
    seen, left = before.get, after.get
    gone = [c for c in cols if not seen[f"n_{c}"]] if seen["rows"] else []
    report = {
        "original_rows": seen["rows"], "result_rows": left["rows"], "empty_rows": seen["empty"],
        "duplicate_rows": seen["rows"] - seen["empty"] - left["rows"], "original_cols": len(cols), "result_cols": len(cols) - len(gone),
        "trimmed_cols": len(string_columns(df))}
    return df.sparkSession.read.schema(rows.schema).parquet(path).drop(*gone), report


def cleaning_report(df: DataFrame) -> DataFrame:
    """One row: rows before and after the row steps, and columns without values."""
    cols = df.columns
    empty = C.all_of([F.col(c).isNull() for c in cols])
    copies = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    counted = copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("original_rows"),
        F.coalesce(F.sum(F.when(empty, F.col("_n"))), F.lit(0)).alias("empty_rows"),
        F.coalesce(F.sum(F.when(~empty, F.col("_n") - 1)), F.lit(0)).alias("duplicate_rows"),
        _empty_columns(cols).alias("empty_cols"),
    )
    return counted.select(
        "original_rows", (F.col("original_rows") - F.col("empty_rows") - F.col("duplicate_rows")).alias("result_rows"),
        "empty_rows", "duplicate_rows", F.lit(len(cols)).cast("bigint").alias("original_cols"),
        (F.lit(len(cols)) - F.col("empty_cols")).cast("bigint").alias("result_cols"),
        F.lit(len(string_columns(df))).cast("bigint").alias("trimmed_cols"),
    )


def _empty_columns(cols: list[str]) -> Column:
    flags = [F.when(F.count(c) == 0, F.lit(1)).otherwise(F.lit(0)) for c in cols]
    total = F.lit(0)
    for flag in flags:
        total = total + flag
    return total


# --- untyped tables: every column is text ----------------------------------------------------

def as_text(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The raw text layer the rules work on."""
    keep = keep or []
    return df.select(*[c if c in keep else F.col(c).cast("string").alias(c) for c in df.columns])


def drop_blank_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows whose values are all NULL or white space."""
    return df.where(~C.all_of([C.is_blank(c) for c in (cols or df.columns)]))


def _rewrite(df: DataFrame, cols: list[str], steps: list) -> DataFrame:
    """Apply the steps of a rule to columns and count changed cells per row in ``_changed``.

    Every step is a select of its own, and the new values pass a one-element
    generator, so no later rule or filter repeats the work of this one.
    """
    out, names = df, {c: c for c in cols}
    for i, step in enumerate(steps):
        out = out.withColumns({f"_s{i}_{c}": step(F.col(names[c])) for c in cols})
        names = {c: f"_s{i}_{c}" for c in cols}
    fresh = out.select(*df.columns, F.inline(F.array(F.struct(*[F.col(names[c]).alias(f"_new_{c}") for c in cols]))))
    changed = F.lit(0)
    for c in cols:
        changed = changed + F.coalesce((F.col(f"_new_{c}") != F.col(c)).cast("int"), F.lit(0))
    return fresh.withColumn("_changed", changed).withColumns(
        {c: F.coalesce(f"_new_{c}", c) for c in cols}
    ).drop(*[f"_new_{c}" for c in cols])


RULES = {
    "normalize_dates": ("normalized_dates", C.DATE_STEPS),
    "normalize_numbers": ("normalized_numbers", C.NUMBER_STEPS),
    "normalize_currencies": ("normalized_currencies", C.CURRENCY_STEPS),
}
ALL_RULES = ["remove_empty", "remove_duplicates", *RULES, "detect_anomalies"]


def clean_text_table(df: DataFrame, row_id: str, rules: list[str] | None = None) -> DataFrame:
    """Run the chosen rules in their fixed order.

    Adds one counter column per rewriting rule (changed cells of the row) and one
    ``__anomaly_<col>__`` flag per column; sum the counters for a report.
    """
    rules = ALL_RULES if rules is None else rules
    cols = [c for c in df.columns if c != row_id]
    out = as_text(df, keep=[row_id])
    if "remove_empty" in rules:
        out = drop_blank_rows(out, cols)
    if "remove_duplicates" in rules:
        out = dedup_keep_first(out, row_id)
    for name, (counter, steps) in RULES.items():
        if name in rules:
            out = _rewrite(out, cols, steps).withColumnRenamed("_changed", counter)
    if "detect_anomalies" in rules:
        # The bounds need passes of their own: clean once, store, then look for outliers.
        out = flag_outliers(written(out, "cleaned"), cols)
    return out


def cleaning_changes(df: DataFrame, row_id: str, rules: list[str] | None = None) -> DataFrame:
    """(row_id, rule, column, old, new) of every cell that a rewriting rule changes.

    Rules run in their fixed order, each on what the one before left.
    """
    cols = [c for c in df.columns if c != row_id]
    kind = "array<struct<rule:string,column:string,old:string,new:string>>"
    out = as_text(df, keep=[row_id]).withColumn("_changes", F.array().cast(kind))
    for name, (_, steps) in RULES.items():
        if rules is None or name in rules:
            out = out.withColumns({f"_old_{c}": F.col(c) for c in cols})
            out = _rewrite(out, cols, steps)
            cells = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(c).alias("column"), F.col(f"_old_{c}").alias("old"),
                                       F.col(c).alias("new")) for c in cols])
            changed = F.filter(cells, lambda x: ~x["old"].eqNullSafe(x["new"]))
            out = out.withColumn("_changes", F.concat("_changes", changed)).drop("_changed", *[f"_old_{c}" for c in cols])
    return out.select(row_id, F.inline("_changes"))


def cleaning_totals(df: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: rows before and after, and the sum of every counter and flag that ``clean_text_table`` added."""
    counters = [F.sum(counter).alias(counter) for counter, _ in RULES.values() if counter in cleaned.columns]
    flags = [c for c in cleaned.columns if c.startswith("__anomaly_")]
    anomalies = [sum((F.count_if(c) for c in flags), F.lit(0)).alias("anomalies")] if flags else []
    after = cleaned.agg(F.count(F.lit(1)).alias("rows_after"), *counters, *anomalies)
    before = df.agg(F.count(F.lit(1)).alias("rows_before"))
    both = before.unionByName(after, allowMissingColumns=True)            # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


# --- quartiles and outliers ----------------------------------------------------------------------

_ACCURACY = 10000
_EXACT_ROWS = 100_000


def positional_quantiles(df: DataFrame, exprs: dict[str, Column], quarters: tuple[int, ...] = (1, 3)) -> dict[str, dict]:
    """Exact elements at sorted positions ``q*n//4`` of several columns.

    A sketch brackets every wanted rank; rows below and inside the bracket are
    counted, and the bracket shrinks until it is small enough for an exact
    selection. Every pass is one scan that returns one row, so neither a task nor
    the driver ever holds a whole column. NaN sorts behind all numbers; it is counted apart,
    so it never stands in the way of the brackets. The columns are stored once for all passes.
    """
    number = lambda e: F.when(~F.isnan(e.cast("double")), e)
    raw = df.select(*[e.alias(c) for c, e in exprs.items()])
    named = written(raw.select(*[number(F.col(c)).alias(c) for c in exprs],
                               *[F.isnan(F.col(c).cast("double")).alias(f"_nan_{c}") for c in exprs]), "numbers")
    spread = 3 / _ACCURACY
    marks_of = lambda p: [max(0.0, p - spread), p, min(1.0, p + spread)]
    first_marks = [m for q in quarters for m in marks_of(q / 4)]
    first = named.agg(*[
        e.alias(f"{what}_{i}") for i, c in enumerate(exprs) for what, e in [
            ("n", F.count(c)), ("nan", F.count_if(f"_nan_{c}")), ("lo", F.min(c)), ("hi", F.max(c)), ("p", F.percentile_approx(c, first_marks, _ACCURACY))]
    ]).first()
    open_: dict[tuple[str, int], dict] = {}
    found: dict[str, dict] = {}
    for i, c in enumerate(exprs):
        size = first[f"n_{i}"]
        n = size + first[f"nan_{i}"]
        found[c] = {"n": n}
        for j, q in enumerate(quarters if n else ()):
            if q * n // 4 >= size:
                found[c][q] = math.nan
                continue
            open_[(c, q)] = {"k": q * n // 4, "below": 0, "size": size, "lo": first[f"lo_{i}"], "hi": first[f"hi_{i}"],
                             "marks": first[f"p_{i}"][3 * j:3 * j + 3]}
    inside = lambda c, b: F.when(F.col(c).between(F.lit(b["lo"]), F.lit(b["hi"])), F.col(c))
    while wide := {key: b for key, b in open_.items() if b["size"] > _EXACT_ROWS and b["lo"] < b["hi"]}:
        stale = {key: b for key, b in wide.items() if not b["marks"]}
        if stale:
            marks = named.agg(*[
                F.percentile_approx(inside(c, b), marks_of((b["k"] - b["below"] + 0.5) / b["size"]), _ACCURACY).alias(f"p_{j}")
                for j, ((c, q), b) in enumerate(stale.items())]).first()
            for j, b in enumerate(stale.values()):
                b["marks"] = marks[f"p_{j}"]
        counts = []
        for j, ((c, q), b) in enumerate(wide.items()):
            # The middle of the bracket is a cut too, so every pass shrinks it.
            middle = (b["lo"] + b["hi"]) / 2
            b["cuts"] = sorted({*b["marks"], *([middle] if math.isfinite(middle) else [])})
            b["marks"] = None
            counts += [F.count_if(F.col(c) < F.lit(x)).alias(f"b_{j}_{m}") for m, x in enumerate(b["cuts"])]
            counts += [F.count_if(F.col(c) <= F.lit(x)).alias(f"t_{j}_{m}") for m, x in enumerate(b["cuts"])]
        row = named.agg(*counts).first()
        for j, b in enumerate(wide.values()):
            below = [row[f"b_{j}_{m}"] for m in range(len(b["cuts"]))]
            upto = [row[f"t_{j}_{m}"] for m in range(len(b["cuts"]))]
            for m, x in enumerate(b["cuts"]):
                if below[m] <= b["k"] < upto[m]:        # the element is exactly this value
                    b.update(lo=x, hi=x, below=below[m], size=upto[m] - below[m])
                    break
                if below[m] > b["k"]:
                    b.update(hi=x, size=min(b["size"], upto[m] - b["below"]))
                    break
                b.update(lo=x, below=below[m], size=b["size"] - (below[m] - b["below"]))
    last = [
        F.expr(f"percentile_disc({(b['k'] - b['below'] + 0.5) / b['size']!r}D) WITHIN GROUP (ORDER BY _v{j})").alias(f"v_{j}")
        for j, b in enumerate(open_.values())
    ]
    if last:
        picked = named.select(*[inside(c, b).alias(f"_v{j}") for j, ((c, q), b) in enumerate(open_.items())]).agg(*last).first()
        for j, (c, q) in enumerate(open_):
            found[c][q] = picked[f"v_{j}"]
    return found


def quartiles(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n, q1, q3) of numeric columns by position, not interpolated."""
    found = positional_quantiles(df, {c: F.col(c).cast("double") for c in cols})
    rows = [(c, f["n"], f.get(1), f.get(3)) for c, f in found.items()]
    return df.sparkSession.createDataFrame(rows, "column string, n bigint, q1 double, q3 double")


def flag_outliers(df: DataFrame, cols: list[str]) -> DataFrame:
    """Flag values outside q1 - 1.5 iqr and q3 + 1.5 iqr as ``__anomaly_<col>__``.

    Columns with fewer than four numbers are not judged. The bounds are plain
    numbers in the plan, so flagging is a map over the table.
    """
    values = {c: C.outlier_value(c) for c in cols}
    found = positional_quantiles(df, values)
    flags = {}
    for c in cols:
        n, q1, q3 = found[c]["n"], found[c].get(1), found[c].get(3)
        if n >= 4:
            reach = 1.5 * (q3 - q1)
            flag = (values[c] < q1 - reach) | (values[c] > q3 + reach)
            flags[f"__anomaly_{c}__"] = F.coalesce(flag, F.lit(False))
        else:
            flags[f"__anomaly_{c}__"] = F.lit(False)
    return df.withColumns(flags)


# --- reports on column content ------------------------------------------------------------------------

def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column from one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "nulls")


def invalid_values(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """(column, value, rows) of the values that do not fit the wanted types."""
    wide = df.select(*[
        F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.col(c)).alias(c) for c, t in types.items()
    ])
    long = wide.unpivot([], list(types), "column", "value").where("value IS NOT NULL")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


def suggest_names(df: DataFrame, order: list[str], strict_reference: bool = False) -> DataFrame:
    """(column, suggestion) from all non-empty values of a column.

    Dates and amounts are tried before phones. ``strict_reference`` looks at the first five non-empty values of
    the first 20 rows only, in the order email, phone, date, amount.
    """
    cols = [c for c in df.columns if c not in order]
    rows = as_text(df.orderBy(*order).limit(20) if strict_reference else df, keep=order)
    first = rows.unpivot(order, cols, "column", "value").where("value IS NOT NULL AND value <> ''")
    if strict_reference:
        nth = F.row_number().over(Window.partitionBy("column").orderBy(*order))
        first = first.withColumn("_nth", nth).where("_nth <= 5")
    tests = {"email": V.SUGGEST_EMAIL, "phone": V.SUGGEST_PHONE, "date": V.SUGGEST_DATE, "amount": V.SUGGEST_AMOUNT}
    names = list(tests) if strict_reference else ["email", "date", "amount", "phone"]
    label = F.lit(None).cast("string")
    for name in reversed(names):
        label = F.when(F.bool_and(F.col("value").rlike("(?U)" + tests[name])), F.lit(name)).otherwise(label)
    return first.groupBy("column").agg(label.alias("suggestion")).where("suggestion IS NOT NULL")


def apply_names(df: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Rename columns by a (column, suggestion) table, one row per column of ``df``; repeats get ``_2``."""
    rows = {r["column"]: r["suggestion"] for r in suggestions.collect()}
    names, used = {}, {}
    for c in df.columns:
        if c in rows:
            used[rows[c]] = used.get(rows[c], 0) + 1
            names[c] = rows[c] if used[rows[c]] == 1 else f"{rows[c]}_{used[rows[c]]}"
    return df.withColumnsRenamed(names)
