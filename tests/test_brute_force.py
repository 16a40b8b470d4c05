"""Operators without an SQL twin against plain Python over the small tables."""
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiremill.functions import values as V
from quiremill.operators import documents as D
from quiremill.operators import search as S
from quiremill.operators import vectors as VE
from quiremill.plans.registry import Tables
from quiremill.plans.text import contacts, named


@pytest.fixture(scope="module")
def texts(spark, folder):
    rows = contacts(Tables(spark, folder)).select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


def first_of_each(values):
    seen = {}
    for v in values:
        seen.setdefault(v[:50], v)
    return list(seen.values())


def test_common_entities(spark, folder, texts):
    got = defaultdict(list)
    for r in D.entities(contacts(Tables(spark, folder))).orderBy("position").collect():
        got[r.doc_id, r.entity_type].append(r.value)
    squeeze = lambda runs: [re.sub(r"\s+", "", r) for r in runs]
    for doc, text in texts.items():
        phones = [p for p in squeeze(re.findall(V.PHONE, text)) if len(re.sub(r"\D", "", p)) >= 7]
        want = {
            "email": re.findall(V.EMAIL, text), "phone": phones,
            "date": [m.group(0) for m in re.finditer(V.DATE, text, re.I)],
            "url": re.findall(V.URL, text), "iban": re.findall(V.IBAN, text),
        }
        for kind, values in want.items():
            assert got[doc, kind] == first_of_each(values), (doc, kind)


def test_phones_as_found(spark, folder, texts):
    got = defaultdict(list)
    found = D.entities(contacts(Tables(spark, folder)), strict_reference=True).where("entity_type = 'phone'")
    for r in found.orderBy("position").collect():
        got[r.doc_id].append(r.value)
    for doc, text in texts.items():
        runs = [re.sub(r"\s+", "", p) for p in re.findall(V.PHONE, text)]
        assert got[doc] == first_of_each([r for r in runs if len(r) >= 7])


def test_type_fields(spark, folder, texts):
    """Every field of every type, against the first match of its patterns."""
    from quiremill.functions import text as X
    corpus = contacts(Tables(spark, folder))
    for kind in ["invoice", "bank_statement", "contract", "id"]:
        got = defaultdict(dict)
        for r in corpus.select("doc_id", F.inline(X.field_entities("text", F.lit(kind)))).collect():
            got[r.doc_id][r.entity_type] = r.value
        for doc, text in texts.items():
            want = {}
            for name, _, patterns, limit in V.TYPE_FIELDS[kind]:
                for p in patterns:
                    m = re.search(p, text, re.I)
                    if m:
                        want[name] = m.group(1).strip()[:limit]
                        break
            assert got[doc] == want, (doc, kind)


def test_types(spark, folder):
    corpus = named(Tables(spark, folder))
    texts = {r.doc_id: (r.text, r.filename) for r in corpus.collect()}
    for r in D.classify_documents(corpus).collect():
        text, name = texts[r.doc_id]
        seen = (text + " " + name).lower()
        best = (V.UNKNOWN_SCORE, "unknown", [])
        for kind, base, patterns in V.DOCUMENT_RULES:
            hits = [p for p in patterns if re.search(p, seen, re.I)]
            score = round(min(base + 0.02 * (len(hits) - 1), 0.97), 4)
            if hits and score > best[0]:
                best = (score, kind, hits)
        assert (r.confidence, r.doc_type, r.signals) == best


WORD = re.compile(r"[؀-ۿ\w]+")


def words(text, shortest=2):
    return [w for w in WORD.findall(text.lower()) if len(w) >= shortest]


def okapi(corpus, question):
    """Scores of {key: text} for a question, straight from the published formula."""
    docs = {k: words(t) for k, t in corpus.items()}
    docs = {k: d for k, d in docs.items() if d}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    scores = {}
    for k, d in docs.items():
        tf = Counter(d)
        scores[k] = sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in words(question))
    return scores


@pytest.fixture(scope="module")
def chunks(spark, folder):
    docs = Tables(spark, folder).documents.select(F.col("doc_id").alias("file_id"), "text")
    table = S.chunk_documents(docs).cache()
    return table


ASK = {"q1": "The hand of whst and the the tion", "q2": "elle avec la tion", "q3": "zzzz"}


def test_search_and_answers(spark, chunks):
    corpus = {(r.file_id, r.chunk_index): r.chunk_text for r in chunks.collect()}
    queries = S.questions(spark, ASK)
    best = S.bm25(chunks, queries)
    rows = best.orderBy("query_id", "rank").collect()
    expected = {}
    for q, question in ASK.items():
        scores = okapi(corpus, question)
        top = sorted((k for k in scores if scores[k] > 0), key=lambda k: (-round(scores[k], 9), k))[:5]
        assert [(r.file_id, r.chunk_index) for r in rows if r.query_id == q] == top
        assert all(abs(r.score - scores[r.file_id, r.chunk_index]) < 1e-9 for r in rows if r.query_id == q)
        expected[q] = top
    sources = S.with_sources(best, chunks.withColumn("filename", F.concat(F.lit("f"), (F.col("file_id") % 3).cast("string"))))
    answers = {r.query_id: r.answer for r in S.extractive_answers(sources, queries).collect()}
    assert answers == {q: answer(ASK[q], [(f"f{k[0] % 3}", corpus[k]) for k in top]) for q, top in expected.items() if top}


def answer(question, found):
    asked = set(words(question, 1))
    pool = []
    for rank, (name, text) in enumerate(found[:3]):
        pieces = [p.strip() for p in re.split(r"(?<=[.!?؟\n])\s*", text)]
        for place, piece in enumerate(p for p in pieces if len(p) > 15):
            shared = len(asked & set(words(piece, 1)))
            pool.append((round(shared / max(len(asked), 1) - rank * 0.1 - place * 0.01, 9), name, piece))
    pool.sort(reverse=True)
    if not pool or pool[0][0] <= 0:
        return found[0][1][:600].strip()
    chosen = []
    for score, _, piece in pool[:3]:
        if piece in chosen:
            break
        if score > 0:
            chosen.append(piece)
    names = list(dict.fromkeys(n for _, n, _ in pool[:3] if n))
    text = " ".join(chosen)
    if len(names) > 1:
        text += "\n\n(مصدر: " + " · ".join(names[:2]) + ")"
    return text[:800]


def test_answer_fallback_and_repeats(spark):
    def ask(question, *texts):
        sources = spark.createDataFrame([("q", i + 1, i, f"f{i}", i, t) for i, t in enumerate(texts)],
                                        "query_id string, rank int, file_id int, file_name string, chunk_index int, chunk_text string")
        got = S.extractive_answers(sources, S.questions(spark, {"q": question})).first().answer
        assert got == answer(question, [(f"f{i}", t) for i, t in enumerate(texts)])
        return got

    assert ask("nothing shared", "The first long sentence here. Another one of them.") == "The first long sentence here. Another one of them."
    ask("long sentence", "The long sentence is here. The long sentence is here. Some other sentence now.")
    ask("long sentence", "The long sentence is here.", "A long sentence is there.", "Also one long sentence.")
    assert ask("short", "tiny. bits.") == "tiny. bits."


def test_chunks_rebuild_documents(spark, folder, chunks):
    """Chunks are runs of sentences; without repeated starts they cover every sentence in order."""
    docs = {r.doc_id: r.text for r in Tables(spark, folder).documents.collect()}
    found = defaultdict(list)
    for r in chunks.orderBy("file_id", "chunk_index").collect():
        found[r.file_id].append(r.chunk_text)
    for doc, text in docs.items():
        sents = [s.strip() for p in re.split(r"\n{2,}", text.strip()) for s in re.split(r"(?<=[.!?؟])\s+", p.strip()) if s.strip()]
        want, open_, index = [], [], 0
        for s in sents + [None]:
            if open_ and (s is None or sum(map(len, open_)) + len(s) > 400):
                if open_:
                    want.append(" ".join(open_))
                keep = []
                while s is not None and open_ and sum(map(len, keep)) + len(open_[-1]) <= 80:
                    keep.insert(0, open_.pop())
                open_ = keep
            if s is not None:
                open_.append(s)
        assert found[doc] == want, doc


def test_context_budget(spark):
    sources = spark.createDataFrame([("q", i, i, "n", 0, "x" * 1500) for i in range(1, 5)],
                                    "query_id string, rank int, file_id int, file_name string, chunk_index int, chunk_text string")
    text = S.assemble_context(sources).first().context
    assert len(text.replace("\n\n---\n\n", "")) == 4000 and text.count("---") == 2


def test_nearest_vectors_in_blocks(spark, folder):
    vectors = Tables(spark, folder).embeddings.select("vec_id", "embedding")
    rows = vectors.orderBy("vec_id").collect()
    m = np.array([r.embedding for r in rows], dtype="float64")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    queries = vectors.where("vec_id < 30").withColumnRenamed("vec_id", "query_id")
    for block in (8, 1000):
        got = defaultdict(list)
        for r in VE.vector_topk(queries, vectors, 4, block=block).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        sims = np.round(m[:30] @ m.T, 9)
        for q in range(30):
            assert got[q] == sorted(ids.tolist(), key=lambda i: (-sims[q][i], i))[:4]


def test_blocks_keep_the_best_of_all(monkeypatch):
    """The best of vectors that come in blocks, with many ties, NaN and repeated ids, are those of one sort."""
    from quiremill.operators import cells
    rng = np.random.default_rng(11)
    for k, shape in ((3, 700), (5, 2), (40, 90)):
        v = rng.integers(-2, 3, (shape, 4)).astype(float)
        v[::9, 0] = np.nan
        q = rng.integers(-2, 3, (150, 4)).astype(float)
        ids = rng.integers(0, shape, shape)
        table = lambda name, key, m: pa.table({name: pa.array(key), "embedding": pa.array(m.tolist(), pa.list_(pa.float64()))})
        for metric in ("cosine", "dot"):
            best = cells._Best(table("query_id", np.arange(150), q), k, metric)
            for at in range(0, shape, 130):
                best.meet(table("vec_id", ids[at:at + 130], v[at:at + 130]))
            got = {}
            for r in pa.concat_tables(best.found()).to_pylist():
                got.setdefault(r["query_id"], []).append((r["vec_id"], r["similarity"]))
            raw = (cells.unit(q) @ cells.unit(v).T) if metric == "cosine" else q @ v.T
            for i in range(150):
                want = sorted(zip(cells._score(raw[i]).tolist(), ids.tolist()), key=lambda x: (-x[0], x[1]))[:k]
                assert [(-np.inf if np.isnan(x) else round(x, 9), n) for n, x in got[i]] == [(round(x, 9), n) for x, n in want]


def test_neighbours_of_many_move_queries_and_results_only(spark):
    """Vectors are not copied for parts of queries: what a job shuffles grows with queries and results, not with their pairs."""
    from quiremill.operators import cells
    rows = [(i, [float(i % 13), 1.0, float(i % 7)]) for i in range(4000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    got = cells.nearest_of_all(vectors, queries, 2)
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().executedPlan().toString()
    old = cells.nearest_in_parts(vectors.withColumn("cell", F.lit(0)), queries.withColumn("cell", F.lit(0)), 2)
    seen = lambda df: sorted((r.query_id, r.rank, r.vec_id, round(r.similarity, 9)) for r in df.collect())
    assert seen(got) == seen(old) and got.count() == 8000
