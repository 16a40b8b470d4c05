"""Queries over chunks: search, answers, chunk tables and vectors."""
from __future__ import annotations

from pyspark.sql import functions as F

from quiremill.operators import relational as R
from quiremill.operators import postings as P
from quiremill.operators import search as S
from quiremill.operators import vectors as VE
from quiremill.plans import relations as rel
from quiremill.plans.registry import Tables, plan
from quiremill.plans.relations import FILES
from quiremill.plans.text import SENTENCES
from quiremill.session import scratch_path, written

QUESTIONS = {
    "q1": "What is the hand of whst and the tion?", "q2": "elle avec la tion pour une lette",
    "q3": "der und nicht sch", "q4": "the the thinered",
}
_ASKED = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in QUESTIONS.items()) + ") v(query_id, question))"

# Chunks: walk the sentences of a document, remembering where the open chunk starts.
CHUNKS = SENTENCES + r""",
lens AS (SELECT doc_id, i, s, length(s) AS n, CAST(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS c FROM sents),
tails AS (SELECT a.doc_id, a.i, coalesce(min(b.i), a.i) AS tail, coalesce(min(b.c - b.n), a.c - a.n) AS tbase
  FROM lens a LEFT JOIN lens b ON b.doc_id = a.doc_id AND b.i < a.i AND b.i >= a.i - 80 AND (a.c - a.n) - (b.c - b.n) <= 80 GROUP BY a.doc_id, a.i, a.c, a.n),
steps AS (SELECT lens.*, tail, tbase FROM lens JOIN tails USING (doc_id, i)),
walk(doc_id, i, lo, base, c, cut) AS (
  SELECT doc_id, i, i, CAST(0 AS BIGINT), c, NULL::BIGINT FROM steps WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN s.c - w.base > 400 THEN greatest(w.lo, s.tail) ELSE w.lo END,
    CASE WHEN s.c - w.base > 400 THEN greatest(w.base, s.tbase) ELSE w.base END, s.c, CASE WHEN s.c - w.base > 400 THEN w.lo END
  FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
spans AS (SELECT doc_id, cut AS lo, i - 1 AS hi FROM walk WHERE cut IS NOT NULL
  UNION ALL SELECT doc_id, lo, i FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1),
joined AS (SELECT p.doc_id, p.hi, string_agg(l.s, ' ' ORDER BY l.i) AS chunk_text FROM spans p JOIN lens l ON l.doc_id = p.doc_id AND l.i BETWEEN p.lo AND p.hi GROUP BY p.doc_id, p.lo, p.hi),
chunks AS (SELECT doc_id AS file_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY hi) - 1 AS INTEGER) AS chunk_index, chunk_text FROM joined WHERE length(chunk_text) >= 1)"""
_REC = "WITH RECURSIVE "


def _bm25_sql(keys: str, source: str, text: str) -> str:
    """Ranking of ``source`` rows for ``asked``, as the relations toks, idf and scored."""
    k = keys.replace(", ", ", t.")
    return rf"""toks AS (SELECT {keys}, list_filter(regexp_extract_all(lower({text}), '[\x{{0600}}-\x{{06FF}}\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 1) AS ts FROM {source}),
docs AS (SELECT *, len(ts) AS dl FROM toks WHERE len(ts) > 0),
sizes AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM docs),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ts)) AS term FROM docs) GROUP BY term),
rawidf AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, sizes),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM rawidf) ELSE r END AS idf FROM rawidf),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_filter(regexp_extract_all(lower(question), '[\x{{0600}}-\x{{06FF}}\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 1)) AS term FROM asked) GROUP BY ALL),
tf AS (SELECT {keys}, dl, term, count(*) AS tf FROM (SELECT {keys}, dl, unnest(ts) AS term FROM docs) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
scored AS (SELECT query_id, t.{k}, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf t JOIN qt USING (term) JOIN idf USING (term), sizes GROUP BY query_id, t.{k})"""


def _ranked_sql(keys: str, n: int) -> str:
    return f"""ranked AS (SELECT query_id, {keys}, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {keys}) AS rank
  FROM scored WHERE score > 0 QUALIFY rank <= {n})"""


_CHUNK_KEYS = "file_id, chunk_index"
RANKED = _REC + ",\n".join([_ASKED, CHUNKS, _bm25_sql(_CHUNK_KEYS, "chunks", "chunk_text"), _ranked_sql(_CHUNK_KEYS, 5)]) + "\n"
_NAMES = f"""{FILES}, sources AS (SELECT r.query_id, r.rank, r.score, c.file_id, c.chunk_index, c.chunk_text, coalesce(f.original_name, concat('file #', c.file_id)) AS file_name
  FROM ranked r JOIN chunks c USING (file_id, chunk_index) LEFT JOIN (SELECT * FROM files WHERE format IS NOT NULL) f ON f.id = c.file_id)"""


def chunks(t: Tables, **scope):
    """Chunks of the documents a scope leaves."""
    docs = S.scope_chunks(t.corpus.select(F.col("doc_id").alias("file_id"), "text", F.col("lang").alias("language"),
                              F.substring("source", 4, 10).cast("bigint").alias("user_id")), **scope)
    return S.chunk_documents(docs)


def stored(t: Tables, **scope):
    """The stored postings of the chunks in scope, built by the first search that needs them."""
    return P.stored_index(chunks(t, **scope), f"chunks of documents {sorted(scope.items())}")


def whole(t: Tables):
    """The stored postings of whole documents."""
    return P.stored_index(t.corpus.select("doc_id", "text"), "documents", ("doc_id",), "text")


def asked(t: Tables):
    return S.questions(t.spark, QUESTIONS)


def sources(t: Tables):
    """The best chunks of every question with text and file name."""
    names = rel.files(t).where("format IS NOT NULL").select(F.col("id").alias("file_id"), F.col("original_name").alias("filename"))
    index = stored(t)
    best = P.search(index, asked(t))
    texts = index.rows.select("file_id", "chunk_index", "chunk_text")
    return S.with_sources(F.broadcast(best), texts, names=names)          # at most five rows per question


@plan("chunk_documents", _REC + CHUNKS + "\nSELECT * FROM chunks")
def chunk_documents(t: Tables):
    return chunks(t).select("file_id", "chunk_index", "chunk_text")


@plan("index_stats", _REC + CHUNKS + "\nSELECT count(*) AS total_chunks, count(DISTINCT file_id) AS indexed_files FROM chunks")
def index_stats(t: Tables):
    return S.index_stats(chunks(t))


@plan("term_stats", "WITH " + ",\n".join([_ASKED, _bm25_sql("doc_id", "documents", "text")]) + "\nSELECT term, df, round(idf, 6) AS idf FROM idf")
def term_stats(t: Tables):
    return whole(t).vocabulary().withColumn("idf", F.round("idf", 6))


@plan("bm25_scores", "WITH " + ",\n".join([_ASKED, _bm25_sql("doc_id", "documents", "text")]) + "\nSELECT query_id, doc_id, round(score, 6) AS score FROM scored")
def bm25_scores(t: Tables):
    found = P.scores(whole(t), asked(t))
    return found.withColumn("score", F.round("score", 6))


@plan("bm25_topk", RANKED + "SELECT query_id, file_id, chunk_index, round(score, 6) AS score, rank FROM ranked")
def bm25_topk(t: Tables):
    return P.search(stored(t), asked(t)).withColumn("score", F.round("score", 6))


@plan("bm25_scoped", _REC + ",\n".join([_ASKED, CHUNKS, "mine AS (SELECT c.* FROM chunks c JOIN documents d ON d.doc_id = c.file_id WHERE d.source = 'src3')",
      _bm25_sql(_CHUNK_KEYS, "mine", "chunk_text"), _ranked_sql(_CHUNK_KEYS, 5)]) + "\nSELECT query_id, file_id, chunk_index, round(score, 6) AS score, rank FROM ranked")
def bm25_scoped(t: Tables):
    # The scope is applied before chunking; statistics see the user's chunks only.
    return P.search(stored(t, user_id=3), asked(t)).withColumn("score", F.round("score", 6))


@plan("bm25_filtered", "WITH " + ",\n".join([_ASKED, "fr AS (SELECT * FROM documents WHERE lang = 'fr')", _bm25_sql("doc_id", "fr", "text"), _ranked_sql("doc_id", 10)])
      + "\nSELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked")
def bm25_filtered(t: Tables):
    docs = S.scope_chunks(t.corpus.select("doc_id", "text", F.col("lang").alias("language")), language="fr")
    found = P.search(P.stored_index(docs, "documents in French", ("doc_id",), "text"), asked(t), 10)
    return found.withColumn("score", F.round("score", 6))


@plan("bm25_by_type_and_date", "WITH " + ",\n".join([_ASKED, """picked AS (SELECT * FROM documents WHERE source IN ('src1', 'src2')
    AND TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-02-05')""",
      _bm25_sql("doc_id", "picked", "text"), _ranked_sql("doc_id", 10)]) + "\nSELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked")
def bm25_by_type_and_date(t: Tables):
    docs = t.corpus.select("doc_id", "text", F.when(F.col("source").isin("src1", "src2"), "report").otherwise("other").alias("doc_type"),
                           F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(doc_id % 60 as int))").alias("created_at"))
    # The scope is applied before the texts are cut into tokens.
    scoped = S.scope_chunks(docs, doc_type="report", date_range=("2024-01-10", "2024-02-05"))
    found = P.search(P.stored_index(scoped, "reports of some days", ("doc_id",), "text"), asked(t), 10)
    return found.withColumn("score", F.round("score", 6))


_BATCH = {f"b{i}": q for i, q in enumerate([
    "and the of", "that hand", "ein der die", "la le les", "nicht und", "question tion", "thing", "pour avec", "a", "zzzz qqqq"], 1)}


@plan("bm25_batch", "WITH " + ",\n".join(["asked AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _BATCH.items()) + ") v(query_id, question))",
      _bm25_sql("doc_id", "documents", "text"), _ranked_sql("doc_id", 5)]) + "\nSELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked")
def bm25_batch(t: Tables):
    found = P.search(whole(t), S.questions(t.spark, _BATCH), 5)
    return found.withColumn("score", F.round("score", 6))


_PIECES = r""", pieces AS (SELECT query_id, rank, file_id, position - 1 AS position0, sentence FROM (
    SELECT query_id, rank, file_id, sentence, row_number() OVER (PARTITION BY query_id, rank ORDER BY k) AS position FROM (
      SELECT query_id, rank, file_id, trim(unnest(l), concat(' ', chr(9), chr(10), chr(13))) AS sentence, generate_subscripts(l, 1) AS k FROM (
        SELECT query_id, rank, file_id, string_split(regexp_replace(chunk_text, '([.!?؟\n])\s*', concat('\1', chr(1)), 'g'), chr(1)) AS l FROM sources WHERE rank <= 3))
    WHERE length(sentence) > 15)),
qw AS (SELECT query_id, list_distinct(regexp_extract_all(lower(question), '[\x{0600}-\x{06FF}\p{L}\p{N}_]+')) AS q FROM asked)
SELECT query_id, rank, file_id, CAST(position0 AS INTEGER) AS position, sentence,
  CAST(len(list_intersect(q, list_distinct(regexp_extract_all(lower(sentence), '[\x{0600}-\x{06FF}\p{L}\p{N}_]+')))) AS INTEGER) AS overlap,
  round(len(list_intersect(q, list_distinct(regexp_extract_all(lower(sentence), '[\x{0600}-\x{06FF}\p{L}\p{N}_]+')))) / greatest(len(q), 1) - (rank - 1) * 0.1 - position0 * 0.01, 6) AS score
FROM pieces JOIN qw USING (query_id)"""


@plan("answer_sentences", RANKED + ", " + _NAMES + _PIECES)
def answer_sentences(t: Tables):
    found = S.answer_sentences(sources(t), asked(t)).where("sentence IS NOT NULL")
    return found.select("query_id", "rank", "file_id", "position", "sentence", "overlap", F.round("score", 6).alias("score"))


_ANSWER = RANKED + ", " + _NAMES + _PIECES.split("\nSELECT query_id, rank, file_id, CAST")[0] + r""",
pool AS (SELECT p.query_id, s.file_name, p.sentence,
    round(len(list_intersect(q, list_distinct(regexp_extract_all(lower(p.sentence), '[\x{0600}-\x{06FF}\p{L}\p{N}_]+')))) / greatest(len(q), 1) - (p.rank - 1) * 0.1 - position0 * 0.01, 9) AS score
  FROM pieces p JOIN qw USING (query_id) JOIN sources s ON s.query_id = p.query_id AND s.rank = p.rank),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_name DESC, sentence DESC) AS k FROM pool QUALIFY k <= 3),
three AS (SELECT query_id, max(score) FILTER (WHERE k = 1) AS s1, max(sentence) FILTER (WHERE k = 1) AS a, max(sentence) FILTER (WHERE k = 2 AND score > 0) AS b,
    max(sentence) FILTER (WHERE k = 3 AND score > 0) AS c, max(file_name) FILTER (WHERE k = 1) AS f1, max(file_name) FILTER (WHERE k = 2) AS f2, max(file_name) FILTER (WHERE k = 3) AS f3
  FROM best GROUP BY query_id)
SELECT src.query_id, CASE WHEN coalesce(s1, 0) <= 0 THEN trim(substring(chunk_text, 1, 600)) ELSE substring(concat(
    concat_ws(' ', a, CASE WHEN b <> a THEN b END, CASE WHEN b <> a AND c <> a AND c <> b THEN c END),
    CASE WHEN f2 <> f1 THEN concat(chr(10), chr(10), '(مصدر: ', f1, ' · ', f2, ')') WHEN f3 <> f1 THEN concat(chr(10), chr(10), '(مصدر: ', f1, ' · ', f3, ')') ELSE '' END), 1, 800) END AS answer
FROM sources src LEFT JOIN three t ON t.query_id = src.query_id WHERE src.rank = 1"""


@plan("extractive_answer", _ANSWER)
def extractive_answer(t: Tables):
    return S.extractive_answers(sources(t), asked(t))


@plan("assemble_context", RANKED + ", " + _NAMES + r""", b AS (SELECT query_id, rank, concat('[', file_name, '، مقطع ', chunk_index + 1, ']', chr(10), chunk_text) AS block FROM sources),
u AS (SELECT *, CAST(coalesce(sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM b)
SELECT query_id, string_agg(substring(block, 1, 4000 - used), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank) AS context FROM u WHERE used < 4000 GROUP BY query_id""")
def assemble_context(t: Tables):
    return S.assemble_context(sources(t))


@plan("source_snippets", RANKED + ", " + _NAMES + """ SELECT query_id, rank, file_id, file_name, chunk_index, substring(chunk_text, 1, 300) AS snippet, round(score, 4) AS score FROM sources""")
def source_snippets(t: Tables):
    return S.source_snippets(sources(t))


# --- chunk tables -------------------------------------------------------------------------

def _table(t: Tables) -> str:
    path = scratch_path(t.spark, "chunks")
    S.replace_chunks(t.spark, path, chunks(t).select("file_id", "chunk_index", "chunk_text"))
    return path


@plan("replace_chunks", _REC + CHUNKS + """ SELECT file_id, chunk_index, CASE WHEN file_id IN (SELECT doc_id FROM labels) THEN lower(chunk_text) ELSE chunk_text END AS chunk_text FROM chunks""")
def replace_chunks(t: Tables):
    path = _table(t)
    changed = t.corpus.join(t.labels.select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("file_id"), F.lower("text").alias("text"))
    S.replace_chunks(t.spark, path, S.chunk_documents(changed), files=changed)
    return S.read_chunks(t.spark, path)


@plan("delete_chunks", _REC + CHUNKS + " SELECT file_id, count(*) AS n FROM chunks WHERE file_id NOT IN (SELECT doc_id FROM labels) GROUP BY file_id")
def delete_chunks(t: Tables):
    path = _table(t)
    S.delete_chunks(t.spark, path, t.labels.select(F.col("doc_id").alias("file_id")))
    return S.read_chunks(t.spark, path).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@plan("reindex", """SELECT d.doc_id AS file_id, a.turn AS analysis_id, CAST(length(coalesce(nullif(a.text, ''), d.text)) AS INTEGER) AS chars
  FROM documents d LEFT JOIN (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) a
  ON a.conv_id = d.doc_id WHERE trim(coalesce(nullif(a.text, ''), d.text)) <> ''""")
def reindex(t: Tables):
    files = t.documents.select(F.col("doc_id").alias("id"))
    quick = t.documents.select(F.col("doc_id").alias("file_id"), F.col("text").alias("quick_text"))
    analyses = t.conversations.select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("id"), F.col("text").alias("raw_text"),
        F.when(F.col("role") == "assistant", "completed").otherwise("running").alias("status"))
    return S.reindex_texts(files, analyses, quick).select("file_id", "analysis_id", F.length("text").alias("chars"))


# --- vectors ----------------------------------------------------------------------------------

_CENTROIDS = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
centers AS (SELECT label, list(x ORDER BY d) AS c FROM (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e) GROUP BY label, d) GROUP BY label)"""


def _vectors(t: Tables):
    return t.embeddings.select("vec_id", "embedding", "label")


@plan("vector_topk", "WITH " + _CENTROIDS + """ SELECT CAST(c.label AS VARCHAR) AS query_id, vec_id, round(list_cosine_similarity(v, c), 6) AS similarity,
    row_number() OVER (PARTITION BY c.label ORDER BY round(list_cosine_similarity(v, c), 9) DESC, vec_id) AS rank FROM centers c, e QUALIFY rank <= 10""")
def vector_topk(t: Tables):
    found = VE.vector_topk(VE.centroids(_vectors(t)), _vectors(t), 10)
    return found.withColumn("similarity", F.round("similarity", 6))


@plan("similar_vectors", "WITH " + _CENTROIDS + """, best AS (SELECT e.label, e.vec_id, v FROM e JOIN centers c USING (label)
    QUALIFY row_number() OVER (PARTITION BY e.label ORDER BY round(list_cosine_similarity(v, c), 9) DESC, vec_id) = 1)
  SELECT b.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, b.v), 6) AS similarity,
    row_number() OVER (PARTITION BY b.vec_id ORDER BY round(list_cosine_similarity(e.v, b.v), 9) DESC, e.vec_id) AS rank FROM best b JOIN e ON e.vec_id <> b.vec_id QUALIFY rank <= 5""")
def similar_vectors(t: Tables):
    # For the most typical vector of every label: the nearest others.
    v = _vectors(t)
    centers = VE.centroids(v).select(F.col("query_id").cast("int").alias("label"), F.col("embedding").alias("center"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("embedding", "center") / F.sqrt(dot("embedding", "embedding") * dot("center", "center"))
    near = v.join(centers, "label").select("label", "vec_id", "embedding", F.round(cosine, 9).alias("s"))
    typical = near.groupBy("label").agg(F.max_by(F.struct("vec_id", "embedding"), F.struct("s", -F.col("vec_id"))).alias("m"))
    queries = typical.select(F.col("m.vec_id").alias("query_id"), F.col("m.embedding").alias("embedding"))
    found = VE.vector_topk(queries, v, 6).where("query_id <> vec_id").drop("rank")
    top = R.top_n_per_key(found, ["query_id"], [F.desc(F.round("similarity", 9)), F.col("vec_id")], 5)
    return top.withColumn("similarity", F.round("similarity", 6))


def _every_fiftieth(t: Tables):
    return _vectors(t).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@plan("vector_probes")
def vector_probes(t: Tables):
    """The ten nearest vectors of every fiftieth one, from the cells next to it."""
    found = VE.vector_topk(_every_fiftieth(t), _vectors(t), 10, exact=False)
    return found.withColumn("similarity", F.round("similarity", 6))


@plan("vector_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def vector_recall(t: Tables):
    """Whether the cells find nine tenths of the ten nearest vectors."""
    found = VE.vector_topk(_every_fiftieth(t), _vectors(t), 10, exact=False)
    measured = VE.recall(found, VE.vector_topk(_every_fiftieth(t), _vectors(t), 10))
    return measured.select("queries", (F.col("recall") >= 0.9).alias("enough"))


_ALL_PAIRS = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS rank FROM e a, e b QUALIFY rank <= 3"""


@plan("vector_neighbours", _ALL_PAIRS)
def vector_neighbours(t: Tables):
    """The three nearest vectors of every vector: as many queries as vectors, none of them in the driver."""
    found = VE.vector_topk(_vectors(t).select(F.col("vec_id").alias("query_id"), "embedding"), _vectors(t), 3, block=0)
    return found.withColumn("similarity", F.round("similarity", 6))


_HYBRID = {"0": "the hand of", "1": "elle avec la", "2": "der und nicht"}


@plan("hybrid_topk", "WITH " + ",\n".join(["asked AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _HYBRID.items()) + ") v(query_id, question))",
      _CENTROIDS, _bm25_sql("doc_id", "documents", "text"), _ranked_sql("doc_id", 20),
      """dense AS (SELECT CAST(c.label AS VARCHAR) AS query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY c.label ORDER BY round(list_cosine_similarity(v, c), 9) DESC, vec_id) AS rank
        FROM centers c, e WHERE c.label < 3 QUALIFY rank <= 20)"""]) + """
SELECT query_id, doc_id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_id) AS rank
FROM (SELECT query_id, doc_id, CAST(sum(CAST(1 AS DOUBLE) / (60 + r)) AS DOUBLE) AS s FROM (SELECT query_id, doc_id, rank AS r FROM ranked UNION ALL SELECT query_id, doc_id, rank FROM dense) GROUP BY query_id, doc_id)
QUALIFY rank <= 10""")
def hybrid_topk(t: Tables):
    lexical = P.search(whole(t), S.questions(t.spark, _HYBRID), 20)
    centers = VE.centroids(_vectors(t)).where(F.col("query_id").isin(list(_HYBRID)))
    dense = VE.vector_topk(centers, _vectors(t), 20).withColumnRenamed("vec_id", "doc_id")
    return VE.hybrid_topk(lexical, dense, 10).withColumn("score", F.round("score", 9))
