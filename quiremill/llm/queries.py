"""Registered queries of the corpus operators over the given tables."""
from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.llm import (backtrack_bpe, brown_lm, collocations, html_text, imatch, language_id, ranked_search, secret_scan, simhash, template_leaks,
                           token_trees, url_filter, vector_packing)
from quiremill.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_bpe_encode_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the exact encoding of every document, and of the text decoded from it."""
    found = backtrack_bpe.encode_documents(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), size=3, distance=3)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op8_imatch_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """I-Match fingerprint of every document and of its edited text."""
    return imatch.fingerprint_edits(table(spark, folder, "documents"))


@query
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from three quarters of the labelled ones."""
    docs = table(spark, folder, "documents")
    model = language_id.train(docs.where(remainder("doc_id", 4) != 2))
    found = language_id.identify(docs, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]


@query
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url; the trees learn from the urls that the rules label."""
    pages = table(spark, folder, "pages")
    host, path = url_filter.host_and_path(F.col("url"))
    _, verdict = url_filter.rule_of(host, path, URL_RULES)
    model = url_filter.train(pages.select("url", (verdict == "block").alias("block")))
    return url_filter.judge(pages, URL_RULES, model)


@query
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate in the documents with the forest's decision; values are shown as digests only."""
    found = secret_scan.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "start", "stop", F.sha2("value", 256).alias("value_sha256"), "label", "score", "secret")


@query
def op4_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that documents hold, verbatim or with other numbers, units and names."""
    return template_leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


@query
def op3_brown_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Class-based bigram scores of every document, learned from six sevenths of them."""
    return brown_lm.score_documents(table(spark, folder, "documents"), brown_lm.crc_held(7, 2))


def sample_edits(text: Column) -> Column:
    """Three edits of a text: its start is inserted at a third, its middle is cut, and its last quarter gets a phrase."""
    n = F.char_length(text)
    edit = lambda start, length, new: F.struct(
        start.cast("int").alias("start"), F.lit(length).alias("length"), new.alias("replacement"))
    return F.array(edit(n / 3, 0, F.substring(text, 1, 40)), edit(n / 2, 25, F.lit("")), edit(n * 3 / 4, 10, F.lit(" in 2024, it's\n\n new")))


@query
def op2_edit_aware_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document before and after three edits, the latter from the updated tree."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    trees = token_trees.build_trees(docs, path).withColumn("edits", sample_edits(F.col("text")))
    done = token_trees.apply_edits(trees, path)
    return done.select("doc_id", "n_tokens", "n_tokens_edited", "n_pieces", "n_reencoded", F.sha2("text", 256).alias("edited_sha256"))


@query
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases of two and three words that belong together, by language."""
    return collocations.collocations(table(spark, folder, "documents"), least=10, longest=3, inside=50, top=2000)


#: Lower case of A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op13_phrase_collocations"] = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS g
  FROM words, (VALUES (1), (2), (3)) AS sizes(k)),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1),
parts AS MATERIALIZED (
  SELECT *, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
cuts AS (
  SELECT p.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.g = p.first JOIN f y ON y.lang = p.lang AND y.g = p.rest),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inner_pairs AS (
  SELECT lang, pair, max(a) AS within
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS pair FROM candidates WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT m.* FROM lowest m LEFT JOIN inner_pairs i ON i.lang = m.lang AND i.pair = m.g
  WHERE within IS NULL OR 100 * within < 50 * m.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT r.lang, rank, g AS phrase, a, l, r.r, n, score::BIGINT AS score
FROM ranked r JOIN totals USING (lang) WHERE rank <= 2000"""


@query
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


_TERMS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL["op11_ranked_search"] = f"""
WITH asked AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
cut AS (SELECT doc_id, {_TERMS.format("text")} AS words FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT doc_id, len(words)::BIGINT AS n, words FROM cut WHERE len(words) > 0),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM lengths),
held AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(words) AS term FROM lengths)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, corpus GROUP BY term, docs),
impacts AS (
  SELECT doc_id, h.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // length))) AS impact
  FROM held h JOIN weights USING (term), corpus),
scores AS (
  SELECT item_id, doc_id, sum(repeats * impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING sum(repeats * impact) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores QUALIFY rank <= 10"""


@query
def op12_vector_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sixteen shards of near equal bytes, tokens and rows."""
    found = vector_packing.pack(table(spark, folder, "documents"), shards=16)
    return found.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
