"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiremill.llm.common import arrow_map, in_batches

DIMS = 1 << 15                 # hashed n-gram features
BLOCK_CHARS = 1 << 20          # characters whose n-grams are counted at a time
UNKNOWN = "und"
#: Different texts of each language that the model is fitted on.
SAMPLE_ROWS = 500

_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed character 1-, 2- and 3-grams of a whole text in lower case."""
    counts = np.zeros(DIMS, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), BLOCK_CHARS):
        part = points[max(0, at - 2):at + BLOCK_CHARS]
        new = at - max(0, at - 2)              # characters seen before, which only start longer n-grams
        one = part * _FACTORS[0]
        two = (one[:-1] ^ (part[1:] + np.uint32(1))) * _FACTORS[1]
        three = (two[:-1] ^ (part[2:] + np.uint32(1))) * _FACTORS[2]
        for grams in (one[new:], two[max(0, new - 1):], three):
            counts += np.bincount(grams >> np.uint32(17), minlength=DIMS)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray              # DIMS
    weights: np.ndarray          # DIMS x languages
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return tf_idf(ngram_counts(text), self.idf)

    def logits(self, where: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[where] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` with 0 without a letter or a model."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*self.features(text)) / self.temperature)
        best = int(np.argmax(p))             # ties: the first language by name
        return self.languages[best], float(p[best])


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    where = np.flatnonzero(counts)
    x = np.log1p(counts[where]) * idf[where]
    norm = np.sqrt(x @ x)
    return where, x / norm if norm else x


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max())
    return e / e.sum()


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5,
             beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by follow-the-regularised-leader with L1 and L2 penalties, one row at a time."""
    z, n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))      # the last row is the bias

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            where, x, label = rows[k]
            where, x = np.append(where, DIMS), np.append(x, 1.0)
            zs, ns = z[where], n[where]
            w = weights(zs, ns)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            z[where] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[where] = ns + g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: list[np.ndarray], labels: list[int]) -> float:
    """The temperature of least log loss on rows that the weights were not fitted on."""
    if not logits:
        return 1.0
    table, at = np.stack(logits), np.array(labels)

    def loss(t: float) -> float:
        v = table / t
        v = v - v.max(axis=1, keepdims=True)
        return float((np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(at)), at]).mean())
    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def train(docs: DataFrame, label: str = "lang", column: str = "text", rows_per_language: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on labelled rows; rows with a NULL label or without a letter are left out.

    Document frequencies of n-grams are counted over all labelled rows. The weights are fitted on at most
    ``rows_per_language`` different whole texts of each language, those with the smallest hash of
    the text; one in five of them only sets the temperature, unless its language has no other.
    """
    rows = docs.select(docs[label].alias("lang"), docs[column].alias("text")).where("lang is not null and text is not null")

    def count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(DIMS, np.int64)                  # one vector a task
        for batch in batches:
            for text in batch.column(0):
                found += ngram_counts(text.as_py()) > 0
        where = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(found[where])], ["at", "n"])

    frequent = (in_batches(rows.select("text"), count_documents, "at int, n long")
                .groupBy("at").agg(F.sum("n").alias("n")).toPandas())          # at most DIMS rows
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    df = np.zeros(DIMS)
    df[frequent["at"].to_numpy(int)] = frequent["n"].to_numpy()
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1
    model = LanguageModel(languages, idf, np.zeros((DIMS, len(languages))), np.zeros(len(languages)))
    if not languages:
        return model
    # Copies count once; the smallest hashes are kept in every task before they meet, and only their texts are read.
    hashed = rows.withColumn("h", F.xxhash64("text"))
    order = W.partitionBy("lang").orderBy("h")
    chosen = hashed.select("lang", "h").distinct().withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= rows_per_language).select("lang", "h")
    sample = hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def sparse(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [tf_idf(ngram_counts(t.as_py()), idf) if has_letter(t.as_py()) else ([], []) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([p[0] for p in pairs], pa.list_(pa.int32())),
             pa.array([p[1] for p in pairs], pa.list_(pa.float32())), batch.column(2)], ["lang", "at", "x", "h"])

    taken = arrow_map(sample.select("lang", "text", "h"), lambda: sparse, "lang string, at array<int>, x array<float>, h long")
    number = {k: i for i, k in enumerate(languages)}
    fit, held = [], []
    for r in sorted(taken.toPandas().itertuples(), key=lambda r: (r.h, r.lang)):
        if len(r.at):
            (held if r.h % 5 == 0 else fit).append((np.asarray(r.at), np.asarray(r.x, float), number[r.lang]))
    fitted = {y for _, _, y in fit}
    fit += [r for r in held if r[2] not in fitted]
    held = [r for r in held if r[2] in fitted]
    model.weights, model.bias = fit_ftrl(fit, len(languages))
    model.temperature = fit_temperature([model.logits(at, x) for at, x, _ in held], [y for _, _, y in held])
    return model


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, lang_pred, score): the language of every whole text, from the text alone.

    NULL texts, texts without a letter, and all texts if nothing was learned: ``und`` with score 0.
    Repeated rows are judged one by one; other columns are not read.
    """
    weights, idf = model.weights.astype(np.float32), model.idf.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(          # DIMS x languages numbers
        LanguageModel(model.languages, idf, weights, model.bias, model.temperature))

    def make():
        fitted = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [fitted.predict(t.as_py()) for t in batch.column(1)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], ["key", "lang_pred", "score"])
        return work

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[column].alias("text"))
    return arrow_map(rows, make, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def keep_known(docs: DataFrame, model: LanguageModel, least: float, column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is found with a score of ``least`` or more.

    Texts that are ``und`` go; the declared language plays no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)      # DIMS x languages numbers
    at = docs.columns.index(column)

    def make():
        fitted = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [fitted.predict(t.as_py()) for t in batch.column(at)]
            return batch.filter(pa.array([k != UNKNOWN and p >= least for k, p in found], pa.bool_()))
        return work

    return arrow_map(docs, make, docs.schema)
