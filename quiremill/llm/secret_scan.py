"""Secret scan: wide candidate patterns, then a random forest that removes false positives."""
from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm.common import arrow_map, in_batches
from quiremill.session import written

DICTIONARY_SHARE = 2e-5         # words that make up so much of the corpus are known: at most 50,000, by that share
SAMPLE_ROWS = 10_000            # labelled findings that the forest is fitted on: those of smallest hash
BROADCAST_ROWS = 100_000        # neighbour words or documents; more are joined by a shuffle
PRIOR_ROWS = 5.0                # weight of the overall share in a neighbour word's share
FLUSH_WORDS = 150_000           # distinct words that a task holds before it passes counts on
MASK = "[SECRET]"

_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}")
_ASSIGNED = re.compile(
    r"(?i)\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|key|auth|bearer)\b"
    r"[\"']?\s*[:=]\s*[\"']?([^\s\"'<>]{6,})")
_MIXED = re.compile(r"[^a-z]*+[a-z][^A-Z]*+[A-Z][^a-z]*+[a-z][^A-Z]*+[A-Z]")       # never goes back
_WORD = re.compile(r"[^\W\d_]{3,}")
#: Formats that label a finding as a secret without the forest.
KEY_FORMAT = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}")
HEX_FORMAT = re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}")

NUMBERS = ["length", "digits", "upper", "lower", "other", "entropy", "transitions", "known", "longest_letters", "separators",
           "assigned", "quoted", "mail", "link"]
FINDING = ("text_hash long, start int, stop int, value string, before string, after string, label int, "
           + ", ".join(f"{n} double" for n in NUMBERS))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may hold a secret, in order and without overlap."""
    spans = []
    for m in _RUN.finditer(text):
        value = m.group()
        if any(map(str.isdigit, value)) or len(value) >= 16 and value.isupper() or len(value) >= 20 and _MIXED.match(value):
            spans.append(m.span())
    if "=" in text or ":" in text:
        spans += [m.span(1) for m in _ASSIGNED.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3


def coverage(value: str, known: set[str]) -> float:
    """Share of the characters inside known words of three to twelve letters, longest first."""
    low, at, inside = value.lower(), 0, 0
    while at < len(low):
        step = next((n for n in range(min(12, len(low) - at), 2, -1) if low[at:at + n] in known), 0)
        inside += step
        at += step or 1
    return inside / len(low)


def describe(text: str, start: int, stop: int, known: set[str]) -> dict:
    value = text[start:stop]
    size = len(value)
    kinds = [_kind(c) for c in value]
    counts = Counter(value)
    left, right = text[max(0, start - 80):start], text[stop:stop + 80]
    before, after = _WORD.findall(left), _WORD.findall(right)
    assigned = bool(re.search(r"[=:]\s*[\"']?$", left))
    label = None
    if KEY_FORMAT.fullmatch(value) or assigned and HEX_FORMAT.fullmatch(value):
        label = 1
    elif not assigned:
        label = 0
    return {
        "start": start, "stop": stop, "value": value, "label": label,
        "before": before[-1].lower() if before else "", "after": after[0].lower() if after else "",
        "length": float(size), "digits": kinds.count(0) / size, "upper": kinds.count(1) / size, "lower": kinds.count(2) / size,
        "other": kinds.count(3) / size, "entropy": -sum(n / size * math.log2(n / size) for n in counts.values()),
        "transitions": sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, size - 1), "known": coverage(value, known),
        "longest_letters": max(map(len, re.findall(r"[^\W\d_]+", value)), default=0) / size,
        "separators": len(re.findall(r"[/_.-]", value)) / size, "assigned": float(assigned),
        "quoted": float(left[-1:] in "\"'" and left != ""), "mail": float(left[-1:] == "@" or right[:1] == "@" or "@" in value),
        "link": float(bool(re.search(r"(?:://|www\.|/)\S*$", left))),
    }


def dictionary(docs: DataFrame, column: str = "text", share: float = DICTIONARY_SHARE) -> set[str]:
    """Words (letters only, lower case) with at least ``share`` of all word occurrences of the corpus.

    There can be no more than ``1 / share`` of them, however large the corpus is.
    """
    def run(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out
        for batch in batches:
            for text in batch.column(0):
                held.update((text.as_py() or "").split())
                if len(held) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    counted = in_batches(docs.select(docs[column].alias("text")), run, "word string, n long")
    cleaned = counted.select(F.regexp_extract(F.lower("word"), r"^\P{L}*(\p{L}{3,12})\P{L}*$", 1).alias("word"), "n").where("word <> ''")
    counts = written(cleaned.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r.word for r in counts.where(F.col("n") >= total * share).collect()}


def find(docs: DataFrame, known: set[str], key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, text_hash, start, stop, value, ...): candidates of every whole text, with features and format labels."""
    words = docs.sparkSession.sparkContext.broadcast(known)      # a fixed number of words
    names = [f.split()[0] for f in FINDING.split(", ")][1:]

    def make():
        vocabulary = words.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, hashes, rows = [], [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                for a, b in candidates(text):
                    keys.append(i)
                    rows.append(describe(text, a, b, vocabulary))
            kinds = {"value": pa.string(), "before": pa.string(), "after": pa.string()} | dict.fromkeys(("start", "stop", "label"), pa.int32())
            at = pa.array(keys, pa.int64())
            columns = [pa.array([r[n] for r in rows], kinds.get(n, pa.float64())) for n in names]
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *columns], ["key", "text_hash", *names])
        return work

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[column].alias("text"), F.xxhash64(docs[column]).alias("text_hash"))
    return arrow_map(rows, make, f"key {kind}, {FINDING}")


def _with_neighbours(rows: DataFrame, shares: list[DataFrame], prior: float) -> DataFrame:
    for name, share in zip(("before", "after"), shares):
        share = F.broadcast(share) if share.count() <= BROADCAST_ROWS else share
        rows = rows.join(share, name, "left").withColumn(f"{name}_share", F.coalesce(f"{name}_share", F.lit(prior)))
    return rows


def judge(found: DataFrame, trees: int = 20, depth: int = 6, sample: int = SAMPLE_ROWS) -> DataFrame:
    """Adds ``score``, the forest's probability of a secret, to findings with features and a ``label`` (may be NULL).

    Shares of secrets by neighbouring word count all labelled findings; the forest is fitted on at most
    ``sample`` of them. If all labels are alike, that label is the score; without labels all findings
    score 1, so none is dropped.
    """
    labelled = found.where("label is not null")
    total = labelled.agg(F.count("*").alias("n"), F.avg("label").alias("p")).first()
    if not total.n or total.p in (0.0, 1.0):
        return found.withColumn("score", F.lit(1.0 if not total.n else float(total.p)))
    shares = [written(labelled.groupBy(name).agg(
        ((F.sum("label") + PRIOR_ROWS * total.p) / (F.count("*") + PRIOR_ROWS)).alias(f"{name}_share")), name)
        for name in ("before", "after")]
    inputs = [*NUMBERS, "before_share", "after_share"]
    rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(_with_neighbours(found, shares, total.p))
    picked = rows.where("label is not null").select("features", F.col("label").cast("double").alias("label"), F.xxhash64("value", "start").alias("h"))
    picked = written(picked.orderBy("h", "label").limit(sample), "secret_sample").coalesce(1)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11).fit(picked)
    return forest.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction", "before_share", "after_share")


def scan(docs: DataFrame, key: str = "doc_id", column: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, text_hash, start, stop, value, label, score, secret): every candidate with the forest's decision.

    What has the plain format of a key is always a secret; the forest sorts out the rest.
    Positions count code points; ``label`` is 1 where a key format or an assigned hexadecimal string is plain,
    NULL where an assigned value is neither, else 0. NULL and empty texts have no candidates; repeated
    rows give repeated findings; other columns are not read. Long texts and runs take time in proportion. Of findings with equal
    hashes the labelled sample takes any.
    """
    rows = docs.select(docs[key].alias("key"), docs[column].alias("text"))
    found = written(find(rows, dictionary(rows), "key"), "findings")
    return judge(found).select(
        F.col("key").alias(key), "text_hash", "start", "stop", "value", "label", "score", ((F.col("score") >= threshold) | F.coalesce(F.col("label") == 1, F.lit(False))).alias("secret"))


def redact(docs: DataFrame, findings: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The documents with every secret replaced by ``[SECRET]``; all other text and columns stay as they are.

    A column ``n_chars`` is set anew where the text changes.
    """
    spans = written(findings.where("secret").groupBy(F.col(key).alias("_key"), F.col("text_hash").alias("_hash")).agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("_spans")), "spans")
    spans = F.broadcast(spans) if spans.count() <= BROADCAST_ROWS else spans
    text = docs[column]
    joined = docs.join(spans, docs[key].eqNullSafe(spans["_key"]) & (F.xxhash64(text) == spans["_hash"]), "left")
    cleaned = F.aggregate(
        F.col("_spans"), F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            F.concat(s["done"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(MASK)).alias("done"), x["stop"].alias("at")),
        lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.char_length(text))))
    same = F.col("_spans").isNull()
    rows = joined.withColumn("_clean", F.when(same, text).otherwise(cleaned))
    new = {column: F.col("_clean")}
    if "n_chars" in docs.columns:
        size = F.char_length("_clean").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(same, docs["n_chars"]).otherwise(size)
    return rows.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


