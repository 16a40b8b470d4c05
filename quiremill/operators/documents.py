"""Document analysis over a corpus: one row per document in, relations out."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiremill.functions import text as X
from quiremill.functions import values as V
from quiremill.functions.cleaning import strip

# Corpus columns: doc_id, text and, where known, filename, format, has_tables.


def _optional(docs: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in docs.columns else default


def with_type(docs: DataFrame, head: int | None = None, signals: bool = False) -> DataFrame:
    """Add doc_type, confidence and, if wanted, signals to documents.

    The keyword rules look at the whole text, or with ``head`` at so many leading characters
    (``values.CLASSIFY_HEAD`` is the strict rule). Its words are looked up once for all rules. Words, masks and best type go
    through one-element generators, which later filters cannot be pushed through: so
    each pattern runs once per document, whatever is asked of the result.
    """
    text, name = F.coalesce("text", F.lit("")), F.coalesce(_optional(docs, "filename", F.lit("")), F.lit(""))
    seen = F.lower(F.concat(text if head is None else text.substr(1, head), F.lit(" "), name))
    kinds = [kind for kind, _, _ in V.DOCUMENT_RULES]
    out = docs.withColumns({"_seen": seen, "_empty": (F.length(text) == 0) & (F.length(name) == 0)})
    out = out.select("*", F.inline(F.array(F.struct(X.rule_words(F.col("_seen")).alias("_words")))))
    masks = F.struct(*[m.alias(f"_m_{k}") for k, m in X.rule_masks(F.col("_seen"), F.col("_words")).items()])
    out = out.select(*docs.columns, "_empty", F.inline(F.array(masks)))
    best = X.best_rule({k: F.col(f"_m_{k}") for k in kinds}, F.col("_empty"))
    out = out.select(*docs.columns, F.inline(F.array(best)))
    if signals:
        out = out.withColumn("signals", X.rule_signals(F.col("doc_type"), F.col("mask")))
    return out.drop("rank", "mask")


def classify_documents(docs: DataFrame, head: int | None = None) -> DataFrame:
    """doc_id with type, confidence, signals and language."""
    found = with_type(docs, head, signals=True)
    return found.select("doc_id", "doc_type", "confidence", "signals", X.detect_language("text").alias("language"))


def entities(docs: DataFrame, doc_type: str | Column | None = None, strict_reference: bool = False,
             kinds: list[str] | None = None) -> DataFrame:
    """Entities in long form (doc_id, position, entity_type, value, normalized_value, confidence).

    Equal values of one type count once per document, the first one stays; ``strict_reference``
    takes values for equal that agree in their first 50 characters. Common entities come first, then the
    fields of the document type. ``kinds`` names the common entities wanted: only their patterns run.
    """
    found = X.common_entities("text", strict_reference, kinds)
    if doc_type is not None:
        found = F.concat(found, X.field_entities("text", doc_type, strict_reference))
    long = docs.select("doc_id", F.posexplode(found).alias("position", "e"))
    first = F.min(F.struct("position", "e.value", "e.confidence")).alias("_f")
    kept = long.groupBy(
        "doc_id", F.col("e.entity_type").alias("entity_type"),
        (F.col("e.value").substr(1, V.ENTITY_KEY_CHARS) if strict_reference else F.col("e.value")).alias("_key")
    ).agg(first)
    value = F.col("_f.value")
    return kept.select(
        "doc_id", F.col("_f.position").alias("position"), "entity_type", value.alias("value"),
        X.normalized_value(F.col("entity_type"), value).alias("normalized_value"), F.col("_f.confidence").alias("confidence"),
    )


def distinct_entities(values: Column) -> Column:
    """Number of different values."""
    return F.size(F.array_distinct(values))


ERROR_CHARS = 300


@dataclass(frozen=True)
class Step:
    """A step of one's own in an analysis: a Python function of a text, and the type of its result."""
    name: str
    run: Callable[[str], Any]
    kind: str = "string"


def isolated(text: str | Column, step: Step) -> Column:
    """STRUCT(value, error): the step's result, or NULL and what went wrong. A text on which it fails fails alone."""
    name, run = step.name, step.run

    @F.pandas_udf(f"value {step.kind}, error string")
    def attempt(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                rows.append((None if text is None else run(text), None))
            except Exception as e:  # noqa: BLE001  whatever a step raises is its result
                rows.append((None, f"{name}: {type(e).__name__}: {e}"[:ERROR_CHARS]))
        return pd.DataFrame(rows, columns=["value", "error"])

    return attempt(text)


def _said(step: str, *cases: tuple[Column, str]) -> Column:
    """The first case that holds, as an error of the step; NULL if none does."""
    return F.coalesce(*[F.when(case, F.lit(f"{step}: {what}")) for case, what in cases])


def analyze(docs: DataFrame, head: int | None = None, steps: Sequence[Step] = ()) -> DataFrame:
    """One analysis row per document: type, language, handler, entity counts, suggested actions and errors.

    Every step gives a value and an error, and ``errors`` gathers the latter: texts that are missing or empty, no rule that fits, amounts
    in which there is no number, and whatever a step of one's own raises. No step's failure touches another's
    value. ``steps`` add a column each, named as the step. All other steps are column expressions of one select; nothing is shuffled.
    """
    fmt = _optional(docs, "format", F.lit(""))
    tables = _optional(docs, "has_tables", F.lit(False))
    typed = with_type(docs.withColumns({"format": fmt, "has_tables": tables}), head).select(
        "doc_id", "text", "format", "has_tables", "doc_type", "confidence", X.detect_language("text").alias("language"),
        distinct_entities(X.emails("text")).alias("n_emails"), distinct_entities(X.phones("text")).alias("n_phones"),
        distinct_entities(X.dates("text")).alias("n_dates"), distinct_entities(X.urls("text")).alias("n_urls"),
        distinct_entities(X.ibans("text")).alias("n_ibans"),
        F.inline(F.array(F.struct(X.field_entities("text", "doc_type").alias("_fields")))),
    )
    typed = typed.withColumns({f"_own_{s.name}": isolated("text", s) for s in steps})
    handler = F.coalesce(*[F.when(F.col("doc_type") == k, F.lit(v)) for k, v in V.PIPELINE_NAMES.items()], F.lit("generic"))
    amounts = F.filter("_fields", lambda e: e["entity_type"].isin(V.AMOUNT_ENTITIES) & X.normalized_value(e["entity_type"], e["value"]).isNull())
    errors = F.concat(
        F.array(_said("extract_text", (F.col("text").isNull(), "missing"), (strip("text") == "", "empty")),
                _said("classify", (F.col("doc_type") == "unknown", "no rule fits"))),
        F.transform(amounts, lambda e: F.concat(F.lit("normalize: no number in "), e["entity_type"])),
        F.array(*[F.col(f"_own_{s.name}.error") for s in steps]).cast("array<string>"))
    return typed.select(
        "doc_id", "doc_type", "confidence", "language", handler.alias("pipeline_used"), "has_tables",
        "n_emails", "n_phones", "n_dates", "n_urls", "n_ibans", F.size("_fields").alias("n_fields"),
        X.suggestions(F.col("doc_type"), F.col("has_tables"), F.col("format"), F.col("text"),
                      F.col("n_emails"), F.col("n_phones")).alias("suggestions"),
        *[F.col(f"_own_{s.name}.value").alias(s.name) for s in steps],
        F.filter(errors, lambda e: e.isNotNull()).alias("errors"),
    )


def suggestions(analyses: DataFrame) -> DataFrame:
    """Suggested actions in long form, ranked per document by priority."""
    return analyses.select("doc_id", F.posexplode("suggestions").alias("_i", "s")).select(
        "doc_id", (F.col("_i") + 1).alias("rank"), "s.suggestion_type", "s.title", "s.priority", "s.action_params")


def entity_counts(found: DataFrame) -> DataFrame:
    """Entities grouped by document and type: count and first value.

    The values themselves stay in the long relation, so no group is gathered.
    """
    return found.groupBy("doc_id", "entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("position", "value"))["value"].alias("first_value"),
        F.max("confidence").alias("confidence"))


def apply_corrections(found: DataFrame, corrections: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Entities with their latest correction: corrected value where given, verified flag."""
    latest = corrections.groupBy(*keys).agg(F.max(F.struct(*order, "corrected_value"))["corrected_value"].alias("_fix"),
                                            F.lit(True).alias("_fixed"))
    joined = found.join(latest, keys, "left")
    return joined.withColumns({
        "value": F.coalesce("_fix", "value"), "verified": F.coalesce("_fixed", F.lit(False)),
    }).drop("_fix", "_fixed")
