"""Queries over document text: language, type, entities, suggestions, tokens."""
from __future__ import annotations

from pyspark.sql import functions as F

from quiremill.functions import text as X
from quiremill.functions import values as V
from quiremill.operators import documents as D
from quiremill.plans import relations as rel
from quiremill.plans.registry import SQL, Tables, plan
from quiremill.plans.relations import FILES, with_
from quiremill.session import scratch_path
from quiremill.sources import readers, sinks

def re2(pattern: str) -> str:
    """A type pattern for an engine whose word boundaries know ASCII only."""
    lead = rf"(?:^|[^\p{{L}}\p{{N}}_])" if pattern.startswith(r"\b") else ""
    tail = rf"(?:$|[^\p{{L}}\p{{N}}_])" if pattern.endswith(r"\b") else ""
    return lead + pattern.removeprefix(r"\b").removesuffix(r"\b") + tail


def _hits(patterns: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(t, '{re2(p)}') AS INTEGER)" for p in patterns)


# Headings put in front of the invented prose, so that every document type occurs.
HEADINGS = [
    "Tax Invoice 12, total amount and due date", "Cash receipt, paid", "Bank statement: balance and credit",
    "Curriculum vitae. Skills, education, work experience", "Contract: the parties and their signature",
    "Passport, nationality, date of birth", "National ID card", "Medical report of the patient by the doctor",
    "Abstract, introduction, keywords, references, doi", "Form. Name of the person: date:", "Certificate and award",
    "Spreadsheet", "هذه فاتورة رقم 7", "Balance paid by contract", "Notes",
]
_HEADING = "[" + ", ".join(f"'{h}'" for h in HEADINGS) + f"][doc_id % {len(HEADINGS)} + 1]"
LETTERS = f"letters AS (SELECT doc_id, source, concat({_HEADING}, chr(10), text) AS text FROM documents)"


def _classify_sql(seen: str, letters: str = LETTERS) -> str:
    scores = ",\n".join(
        f"SELECT doc_id, {i} AS rule, '{kind}' AS doc_type, {base} AS base, {_hits(patterns)} AS hits FROM seen"
        for i, (kind, base, patterns) in enumerate(V.DOCUMENT_RULES)).replace(",\nSELECT", "\nUNION ALL SELECT")
    return f"""WITH {letters}, seen AS (SELECT doc_id, lower({seen}) AS t FROM letters),
scores AS ({scores}),
best AS (SELECT doc_id, doc_type, round(least(base + 0.02 * (hits - 1), 0.97), 4) AS confidence FROM scores WHERE hits > 0
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(least(base + 0.02 * (hits - 1), 0.97), 4) DESC, rule) = 1),
lang AS (SELECT doc_id, CASE WHEN a > 0 AND a / (a + l) > 0.3 THEN 'ar' ELSE 'en' END AS language FROM (
  SELECT doc_id, length(regexp_replace(text, '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g')) AS a, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS l FROM letters))
SELECT doc_id, coalesce(doc_type, 'unknown') AS doc_type, CAST(coalesce(confidence, 0.3) AS DOUBLE) AS confidence, language
FROM lang LEFT JOIN best USING (doc_id)"""


WHOLE_SQL = _classify_sql("concat(text, ' ', source, '.txt')")


def named(t: Tables):
    """The whole corpus under headings, with a file name made of the source."""
    heading = F.element_at(F.array(*map(F.lit, HEADINGS)), (F.col("doc_id") % len(HEADINGS) + 1).cast("int"))
    return t.corpus.select("doc_id", F.concat(heading, F.lit("\n"), "text").alias("text"), F.concat("source", F.lit(".txt")).alias("filename"))


@plan("detect_language", """SELECT doc_id, CASE WHEN a > 0 AND a / (a + l) > 0.3 THEN 'ar' ELSE 'en' END AS latin, CASE WHEN l > 0 THEN 'ar' ELSE 'en' END AS arabic FROM (
  SELECT doc_id, length(regexp_replace(text, '[^\\x{0600}-\\x{06FF}]', '', 'g')) AS a, length(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS l FROM documents)""".replace("\\\\", "\\"))
def detect_language(t: Tables):
    arabic = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه")
    return t.corpus.select("doc_id", X.detect_language("text").alias("latin"), X.detect_language(arabic).alias("arabic"))


@plan("classify_documents", WHOLE_SQL)
def classify_documents(t: Tables):
    return D.classify_documents(named(t)).drop("signals")


@plan("classify_whole_documents", WHOLE_SQL)
def classify_whole_documents(t: Tables):
    return D.classify_documents(named(t), head=None).drop("signals")


_SIGNALS = "\nUNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS doc_type, '{p}' AS signal FROM seen WHERE regexp_matches(t, '{re2(p)}')"
    for kind, _, patterns in V.DOCUMENT_RULES for p in patterns)


@plan("classify_signals", f"""WITH {LETTERS}, typed AS ({WHOLE_SQL}), seen AS (SELECT doc_id, lower(concat(text, ' ', source, '.txt')) AS t FROM letters)
SELECT doc_id, doc_type, signal FROM ({_SIGNALS}) JOIN typed USING (doc_id, doc_type)""")
def classify_signals(t: Tables):
    return D.classify_documents(named(t)).select("doc_id", "doc_type", F.explode("signals").alias("signal"))


@plan("document_report", f"WITH typed AS ({WHOLE_SQL}) SELECT doc_type, language, count(*) AS n, round(avg(confidence), 4) AS confidence FROM typed GROUP BY ALL")
def document_report(t: Tables):
    found = D.classify_documents(named(t))
    return found.groupBy("doc_type", "language").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


# --- entities ----------------------------------------------------------------------------------

def contact_lines(docs):
    """Documents, each text followed by contact lines made from its own numbers."""
    key = F.col("doc_id").cast("string")
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    tail = F.concat(
        F.lit("\nInvoice No: INV-"), key, F.lit("\nfrom Acme "), key, F.lit("\nTotal: 1,"), F.lpad(key, 3, "0"),
        F.lit(".50\nsee https://x.io/"), key, F.lit(" on 2024-01-"), day,
        F.lit(" and https://x.io/"), key, F.lit(" DE44500105175407324931 balance 12 account no: 99-"), key,
        F.lit("\neffective date: 2024-02-"), day,
        F.lit(" amount: 7\nPassport A1234567 nationality: Omani\nid number: 12345678\n"))
    return docs.select("doc_id", F.concat("text", tail).alias("text"), F.concat("source", F.lit(".txt")).alias("filename"))


def contacts(t: Tables):
    return contact_lines(t.corpus)


CONTACTS = r"""contacts AS (SELECT doc_id, concat(text, chr(10), 'Invoice No: INV-', doc_id, chr(10), 'from Acme ', doc_id, chr(10), 'Total: 1,',
  left(lpad(CAST(doc_id AS VARCHAR), 3, '0'), 3), '.50', chr(10), 'see https://x.io/', doc_id, ' on 2024-01-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0'),
  ' and https://x.io/', doc_id, ' DE44500105175407324931 balance 12 account no: 99-', doc_id, chr(10), 'effective date: 2024-02-',
  lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0'), ' amount: 7', chr(10), 'Passport A1234567 nationality: Omani', chr(10), 'id number: 12345678', chr(10)) AS text FROM documents)"""


def _distinct_sql(pattern: str) -> str:
    return with_(CONTACTS, body=f"""SELECT doc_id, arg_min(value, position) AS value FROM (
  SELECT doc_id, unnest(v) AS value, generate_subscripts(v, 1) AS position FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS v FROM contacts))
  GROUP BY doc_id, value""")


def _of_type(t: Tables, kind: str):
    return D.entities(contacts(t), kinds=[kind]).select("doc_id", "value")


@plan("ner_emails", _distinct_sql(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"))
def ner_emails(t: Tables):
    return _of_type(t, "email")


# A phone is a stretch of 7 to 16 digits, blanks and signs with no digit on either side. RE2 has no look-around, so
# runs of such characters are cut first; then every possible start with its longest good end is listed,
# and each run is walked from one match to the first start behind it.
_PHONES = r"""runs AS (SELECT doc_id, k, r FROM (SELECT doc_id, unnest(l) AS r, generate_subscripts(l, 1) AS k FROM (
    SELECT doc_id, regexp_extract_all(text, '[\d\s\-().+]+') AS l FROM contacts)) WHERE length(regexp_replace(r, '\D', '', 'g')) >= 7),
spots AS (SELECT doc_id, k, r, s, CASE WHEN r[s] = '+' THEN 1 ELSE 0 END AS p FROM (SELECT doc_id, k, r, unnest(range(1, length(r) + 1)) AS s FROM runs)
  WHERE s = 1 OR NOT regexp_matches(r[s - 1], '\d')),
cand AS (SELECT doc_id, k, s, max(s + p + n) AS e FROM (SELECT *, unnest(range(7, 17)) AS n FROM spots)
  WHERE s + p + n - 1 <= length(r) AND NOT contains(substr(r, s + p, n), '+') AND NOT regexp_matches(substr(r, s + p + n, 1), '\d') GROUP BY ALL),
nxt AS (SELECT a.doc_id, a.k, a.s, a.e, min(b.s) AS t FROM cand a LEFT JOIN cand b ON b.doc_id = a.doc_id AND b.k = a.k AND b.s >= a.e GROUP BY ALL),
walk(doc_id, k, s, e, t) AS (SELECT n.doc_id, n.k, n.s, n.e, n.t FROM nxt n JOIN (SELECT doc_id, k, min(s) AS s FROM cand GROUP BY ALL) f ON f.doc_id = n.doc_id AND f.k = n.k AND f.s = n.s
  UNION ALL SELECT n.doc_id, n.k, n.s, n.e, n.t FROM walk w JOIN nxt n ON n.doc_id = w.doc_id AND n.k = w.k AND n.s = w.t),
phones AS (SELECT * FROM (SELECT w.doc_id, w.k, w.s, regexp_replace(substr(r, w.s, w.e - w.s), '\s+', '', 'g') AS value FROM walk w JOIN runs ON runs.doc_id = w.doc_id AND runs.k = w.k)
  WHERE length(regexp_replace(value, '\D', '', 'g')) >= 7)"""


@plan("ner_phones", f"WITH RECURSIVE {CONTACTS}, {_PHONES} SELECT DISTINCT doc_id, value FROM phones")
def ner_phones(t: Tables):
    return _of_type(t, "phone")


@plan("ner_dates", _distinct_sql("(?i)" + V.DATE))
def ner_dates(t: Tables):
    return _of_type(t, "date")


@plan("ner_urls", _distinct_sql(r'https?://[^\s<>"]+|www\.[^\s<>"]+'))
def ner_urls(t: Tables):
    return _of_type(t, "url")


@plan("ner_iban", _distinct_sql(r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b"))
def ner_iban(t: Tables):
    return _of_type(t, "iban")


def _field_pattern(pattern: str) -> str:
    """A field pattern for an engine with ASCII classes only."""
    lead = r"(?:^|[^\p{L}\p{N}_])" if pattern.startswith(r"\b(?:") else ""
    pattern = pattern.removeprefix(r"\b") if lead else pattern
    return lead + pattern.replace(r"[\w", r"[\p{L}\p{N}_").replace(r"\d\w", r"\d\p{L}\p{N}_").replace(r"\-\w]", r"\-\p{L}\p{N}_]")


def _field_sql(*kinds: str) -> str:
    """First match of each field's patterns in order."""
    lines = []
    for kind in kinds:
        for name, confidence, patterns, limit in V.TYPE_FIELDS[kind]:
            tried = [f"CASE WHEN regexp_matches(text, '(?i){q}') THEN trim(regexp_extract(text, '(?i){q}', 1), ' ' || chr(9) || chr(10)) END"
                     for q in map(_field_pattern, patterns)]
            value = f"coalesce({', '.join(tried)}, NULL)"
            value = f"substring({value}, 1, {limit})" if limit else value
            lines.append(f"SELECT doc_id, '{kind}' AS doc_type, '{name}' AS entity_type, {value} AS value, CAST({confidence} AS DOUBLE) AS confidence FROM contacts")
    return " UNION ALL ".join(lines)


def _fields_sql(*kinds: str, more: str = "") -> str:
    return with_(CONTACTS, body=f"SELECT * FROM ({_field_sql(*kinds)}{more}) WHERE value IS NOT NULL")


def _fields(t: Tables, *kinds: str):
    """Fields of the given types, read from every document."""
    parts = None
    for kind in kinds:
        found = contacts(t).select("doc_id", F.explode(X.field_entities("text", F.lit(kind))).alias("e"))
        found = found.select("doc_id", F.lit(kind).alias("doc_type"), "e.entity_type", "e.value", "e.confidence")
        parts = found if parts is None else parts.unionByName(found)
    return parts


@plan("ner_invoice", _fields_sql("invoice"))
def ner_invoice(t: Tables):
    return _fields(t, "invoice")


@plan("ner_bank", with_(CONTACTS, body=r"""
SELECT doc_id, 'bank_statement' AS doc_type, 'account_number' AS entity_type, regexp_extract(text, '(?i)(?:account|حساب)\s*(?:no\.?|number|رقم)?\s*[:\-]?\s*([\d\-]+)', 1) AS value, CAST(0.85 AS DOUBLE) AS confidence
  FROM contacts
UNION ALL SELECT doc_id, 'bank_statement', 'balance', regexp_extract(text, '(?i)(?:balance|رصيد)\s*[:\-]?\s*([\d,\.]+)', 1), 0.80 FROM contacts"""))
def ner_bank(t: Tables):
    return _fields(t, "bank_statement")


@plan("ner_resume", with_(CONTACTS, body=r"""SELECT * FROM (
  SELECT doc_id, 'resume' AS doc_type, 'full_name' AS entity_type, CASE WHEN length(line) < 60 THEN line END AS value, CAST(0.65 AS DOUBLE) AS confidence FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, concat(' ', chr(9), chr(13)))), lambda x: x <> '')[1] AS line FROM contacts)
  UNION ALL SELECT doc_id, 'resume', 'skills_section', CASE WHEN regexp_matches(text, '(?is)(?:skills|مهارات)[:\s\n]+(.*?)(?:\n\n|\z)')
    THEN trim(regexp_extract(text, '(?is)(?:skills|مهارات)[:\s\n]+(.*?)(?:\n\n|\z)', 1), concat(' ', chr(9), chr(10), chr(13))) END, 0.75 FROM contacts
  UNION ALL SELECT doc_id, 'resume', 'linkedin', nullif(regexp_extract(text, '(?i)linkedin\.com/in/[\p{L}\p{N}_\-]+'), ''), 0.95 FROM contacts) WHERE value IS NOT NULL"""))
def ner_resume(t: Tables):
    return _fields(t, "resume")


@plan("ner_contract", _fields_sql("contract"))
def ner_contract(t: Tables):
    return _fields(t, "contract")


@plan("ner_identity", _fields_sql("id", more=r"""
  UNION ALL SELECT doc_id, 'passport', 'passport_number', nullif(regexp_extract(text, '\b([A-Z]{1,2}\d{6,8})\b', 1), ''), 0.85 FROM contacts
  UNION ALL SELECT doc_id, 'passport', 'nationality', CASE WHEN regexp_matches(text, '(?i)(?:nationality|الجنسية)\s*[:\-]?\s*([A-Za-z\x{0600}-\x{06FF} ]{3,30})')
    THEN trim(regexp_extract(text, '(?i)(?:nationality|الجنسية)\s*[:\-]?\s*([A-Za-z\x{0600}-\x{06FF} ]{3,30})', 1)) END, 0.80 FROM contacts"""))
def ner_identity(t: Tables):
    return _fields(t, "passport", "id")


def _listed(kind: str, pattern: str) -> str:
    return f"""SELECT doc_id, '{kind}' AS entity_type, {list(X.COMMON).index(kind)} AS o, unnest(l) AS value, generate_subscripts(l, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{pattern}') AS l FROM contacts)"""


_ENTITIES = f"""found AS ({_listed("email", V.EMAIL)}
  UNION ALL SELECT doc_id, 'phone', 1, value, row_number() OVER (PARTITION BY doc_id ORDER BY k, s) FROM phones
  UNION ALL {_listed("date", "(?i)" + V.DATE)} UNION ALL {_listed("url", V.URL)} UNION ALL {_listed("iban", V.IBAN)}),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, i) - 1 AS position FROM found),
kept AS (SELECT doc_id, CAST(min(position) AS INTEGER) AS position, entity_type, value FROM placed GROUP BY doc_id, entity_type, value)"""
_SCORES = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in V.COMMON_CONFIDENCE.items()) + " END"


@plan("entities_dedup", f"""WITH RECURSIVE {CONTACTS}, {_PHONES}, {_ENTITIES}
SELECT doc_id, position, entity_type, value, CASE WHEN entity_type = 'date' THEN value END AS normalized_value, CAST({_SCORES} AS DOUBLE) AS confidence FROM kept""")
def entities_dedup(t: Tables):
    return D.entities(contacts(t))


@plan("entities_grouped", with_(CONTACTS, body=r"""SELECT doc_id, kind AS entity_type, count(DISTINCT value) AS n FROM (
  SELECT doc_id, 'url' AS kind, unnest(regexp_extract_all(text, 'https?://[^\s<>"]+|www\.[^\s<>"]+')) AS value FROM contacts
  UNION ALL SELECT doc_id, 'iban', unnest(regexp_extract_all(text, '\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b')) FROM contacts
  UNION ALL SELECT doc_id, 'email', unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b')) FROM contacts) GROUP BY ALL"""))
def entities_grouped(t: Tables):
    found = D.entities(contacts(t), kinds=["url", "iban", "email"])
    return D.entity_counts(found).select("doc_id", "entity_type", "n")


@plan("export_entities", _distinct_sql(r'https?://[^\s<>"]+|www\.[^\s<>"]+'))
def export_entities(t: Tables):
    path = scratch_path(t.spark, "entities")
    found = D.entities(contacts(t), kinds=["url"])
    sinks.export_entities(found.select("doc_id", "entity_type", "value"), path, "url")
    return readers.read_delimited(t.spark, path, schema="doc_id bigint, entity_type string, value string").select("doc_id", "value")


@plan("suggestions", f"""WITH RECURSIVE {LETTERS}, typed AS ({WHOLE_SQL}), {FILES}, {_PHONES.replace("FROM contacts", "FROM letters")},
p AS (SELECT doc_id, count(DISTINCT value) AS n_phones FROM phones GROUP BY doc_id),
d AS (SELECT d.doc_id, d.text, t.doc_type, coalesce(f.format, '') AS format, coalesce(f.is_favorite, false) AS has_tables,
    len(list_distinct(regexp_extract_all(d.text, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}\\b'))) AS n_emails, coalesce(n_phones, 0) AS n_phones
  FROM letters d JOIN typed t USING (doc_id) LEFT JOIN files f ON f.id = d.doc_id LEFT JOIN p USING (doc_id))
SELECT doc_id, suggestion_type, title, priority, row_number() OVER (PARTITION BY doc_id ORDER BY priority, rule) AS rank FROM (
  SELECT doc_id, 'extract_tables' AS suggestion_type, 'Extract tables to Excel' AS title, 1 AS priority, 0 AS rule FROM d WHERE has_tables
  UNION ALL SELECT doc_id, 'convert_excel', 'Convert to Excel', 2, 1 FROM d WHERE format = 'pdf'
  UNION ALL SELECT doc_id, 'convert_word', 'Convert to Word', 3, 2 FROM d WHERE format = 'pdf'
  UNION ALL SELECT doc_id, 'extract_emails', concat('Export ', n_emails, ' email address(es)'), 4, 3 FROM d WHERE n_emails > 0
  UNION ALL SELECT doc_id, 'extract_phones', concat('Export ', n_phones, ' phone number(s)'), 5, 4 FROM d WHERE n_phones > 0
  UNION ALL SELECT doc_id, 'export_invoice_json', 'Export invoice data as JSON', 1, 5 FROM d WHERE doc_type = 'invoice'
  UNION ALL SELECT doc_id, 'export_cv_json', 'Export CV data as JSON', 1, 6 FROM d WHERE doc_type = 'resume'
  UNION ALL SELECT doc_id, 'clean_data', 'Clean and normalize data', 6, 7 FROM d WHERE has_tables OR doc_type IN ('spreadsheet', 'bank_statement')
  UNION ALL SELECT doc_id, 'search_document', 'Search within this document', 7, 8 FROM d WHERE length(text) > 200)""")
def suggestions(t: Tables):
    files = rel.files(t).select(F.col("id").alias("doc_id"), "format", "is_favorite")
    docs = named(t).join(files, "doc_id", "left").withColumns(
        {"format": F.coalesce("format", F.lit("")), "has_tables": F.coalesce("is_favorite", F.lit(False))})
    typed = D.with_type(docs).withColumns(
        {"n_emails": D.distinct_entities(X.emails("text")), "n_phones": D.distinct_entities(X.phones("text"))})
    items = X.suggestions(F.col("doc_type"), F.col("has_tables"), F.col("format"), F.col("text"), F.col("n_emails"), F.col("n_phones"))
    ranked = typed.select("doc_id", F.posexplode(items).alias("i", "s"))
    return ranked.select("doc_id", "s.suggestion_type", "s.title", "s.priority", (F.col("i") + 1).cast("bigint").alias("rank"))


_FOUND_FIELDS = " UNION ALL ".join(
    f"SELECT doc_id, doc_type FROM ({SQL[name]})" for name in ("ner_invoice", "ner_bank", "ner_contract", "ner_identity", "ner_resume"))
_TYPED_CONTACTS = _classify_sql(
    "concat(text, ' ', source, '.txt')", CONTACTS + ", letters AS (SELECT doc_id, d.source, c.text FROM contacts c JOIN documents d USING (doc_id))")
_HANDLERS = "CASE doc_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.PIPELINE_NAMES.items()) + " ELSE 'generic' END"


@plan("analyze_documents", f"""WITH RECURSIVE {CONTACTS}, {_PHONES}, {_ENTITIES}, typed AS ({_TYPED_CONTACTS}),
fields AS (SELECT doc_id, doc_type FROM ({_FOUND_FIELDS}) UNION ALL SELECT doc_id, 'receipt' FROM ({SQL["ner_invoice"]})),
n AS (SELECT doc_id, {", ".join(f"CAST(count(*) FILTER (WHERE entity_type = '{k}') AS INTEGER) AS n_{k}s" for k in X.COMMON)} FROM kept GROUP BY doc_id),
f AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_fields FROM fields JOIN typed USING (doc_id, doc_type) GROUP BY doc_id),
d AS (SELECT * FROM typed JOIN contacts USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)),
s AS (SELECT doc_id, string_agg(kind, ',' ORDER BY priority, rule) AS suggestions FROM (
  SELECT doc_id, 'extract_emails' AS kind, 4 AS priority, 3 AS rule FROM d WHERE n_emails > 0 UNION ALL SELECT doc_id, 'extract_phones', 5, 4 FROM d WHERE n_phones > 0
  UNION ALL SELECT doc_id, 'export_invoice_json', 1, 5 FROM d WHERE doc_type = 'invoice' UNION ALL SELECT doc_id, 'export_cv_json', 1, 6 FROM d WHERE doc_type = 'resume'
  UNION ALL SELECT doc_id, 'clean_data', 6, 7 FROM d WHERE doc_type IN ('spreadsheet', 'bank_statement') UNION ALL SELECT doc_id, 'search_document', 7, 8 FROM d WHERE length(text) > 200) GROUP BY doc_id)
SELECT doc_id, doc_type, confidence, language, {_HANDLERS} AS pipeline_used, false AS has_tables, {", ".join(f"coalesce(n_{k}s, 0) AS n_{k}s" for k in X.COMMON)},
  coalesce(n_fields, 0) AS n_fields, coalesce(suggestions, '') AS suggestions, CASE WHEN doc_type = 'unknown' THEN 'classify: no rule fits' ELSE '' END AS errors FROM d LEFT JOIN s USING (doc_id)""")
def analyze_documents(t: Tables):
    return D.analyze(contacts(t)).withColumns({
        "suggestions": F.array_join(F.transform("suggestions", lambda s: s["suggestion_type"]), ","), "errors": F.array_join("errors", ";")})


# --- tokens and sentences ----------------------------------------------------------------------------

@plan("tokenize", r"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\x{0600}-\x{06FF}\p{L}\p{N}_]+'), lambda x: length(x) > 1), ' ') AS tokens FROM documents""")
def tokenize(t: Tables):
    return t.corpus.select("doc_id", F.array_join(X.tokens("text"), " ").alias("tokens"))


SENTENCES = r"""sents AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) AS i FROM (
  SELECT doc_id, p, trim(unnest(l), concat(' ', chr(9), chr(10), chr(13))) AS s, generate_subscripts(l, 1) AS k FROM (
    SELECT doc_id, p, string_split(regexp_replace(para, '([.!?؟])\s+', concat('\1', chr(1)), 'g'), chr(1)) AS l FROM (
      SELECT doc_id, unnest(ps) AS para, generate_subscripts(ps, 1) AS p FROM (
        SELECT doc_id, regexp_split_to_array(trim(text, concat(' ', chr(9), chr(10), chr(13))), '\n{2,}') AS ps FROM documents))))
  WHERE s <> '')"""


@plan("split_sentences", with_(SENTENCES, body="SELECT doc_id, i - 1 AS position, s AS sentence FROM sents"))
def split_sentences(t: Tables):
    return t.corpus.select("doc_id", F.posexplode(X.sentences("text")).alias("position", "sentence")).withColumn(
        "position", F.col("position").cast("bigint"))
