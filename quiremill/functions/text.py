"""Column expressions over document text: language, type, entities, tokens, sentences."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiremill.functions import values as V
from quiremill.functions.cleaning import _col, all_of, first_number, strip


def detect_language(c: str | Column) -> Column:
    """``ar`` when more than 30 % of the Arabic and Latin letters are Arabic, else ``en``."""
    text = _col(c)
    arabic = F.length(F.regexp_replace(text, r"[^\x{0600}-\x{06FF}]+", ""))
    latin = F.length(F.regexp_replace(text, r"[^a-zA-Z]+", ""))
    # Texts without an Arabic letter need no counting.
    return F.when(text.rlike(r"[\x{0600}-\x{06FF}]") & (arabic / (arabic + latin) > V.ARABIC_SHARE), "ar").otherwise("en")


def _needles(pattern: str) -> list[str]:
    """Literal text that a match of a type pattern must contain."""
    core = pattern.replace(r"\b", "")
    return [part for part in re.split(r"\[.*?\][?*+]?|\\d\+|\.\*", core) if part]


def _words_of(pattern: str) -> list[str] | None:
    """The words of a pattern that is nothing but whole words, one blank between them."""
    words = pattern.removeprefix(r"\b").removesuffix(r"\b").split(" ")
    plain = pattern.startswith(r"\b") and pattern.endswith(r"\b") and all(re.fullmatch(r"\w+", w) for w in words)
    return words if plain else None


_WHOLE_WORDS = {p: words for _, _, patterns in V.DOCUMENT_RULES for p in patterns if (words := _words_of(p))}


def rule_words(seen: Column) -> Column:
    """The different words of a lower-case text that stand in any type pattern: one pass over the text, whatever the number of rules."""
    known = sorted({w for words in _WHOLE_WORDS.values() for w in words})
    return F.array_intersect(F.split(seen, r"(?U)\W+"), F.array(*map(F.lit, known)))


def rule_hit(seen: Column, words: Column, pattern: str) -> Column:
    """Whether a keyword pattern occurs in lower-case text, of which ``words`` are those of ``rule_words``.

    A single word needs no further look. Several words must all be there before the regex
    sees the text; other patterns first have a plain substring test.
    """
    whole = _WHOLE_WORDS.get(pattern)
    if whole and len(whole) == 1:
        return F.array_contains(words, whole[0])
    needles = [F.array_contains(words, w) for w in whole] if whole else [seen.contains(n) for n in _needles(pattern)]
    return all_of(needles) & seen.rlike("(?idU)" + pattern)


def rule_masks(seen: Column, words: Column) -> dict[str, Column]:
    """One integer per document type whose bits tell which patterns occur in lower-case text."""
    masks = {}
    for kind, _, patterns in V.DOCUMENT_RULES:
        mask = F.lit(0)
        for bit, p in enumerate(patterns):
            mask = mask + F.when(rule_hit(seen, words, p), F.lit(1 << bit)).otherwise(F.lit(0))
        masks[kind] = mask
    return masks


def best_rule(masks: dict[str, Column], empty: Column) -> Column:
    """STRUCT(confidence, rank, doc_type, mask) of the best type; ties go to the earlier rule."""
    scored = []
    for number, (kind, base, _) in enumerate(V.DOCUMENT_RULES):
        hits = F.bit_count(masks[kind])
        score = F.round(F.least(F.lit(base) + V.SCORE_PER_EXTRA_HIT * (hits - 1), F.lit(V.SCORE_LIMIT)), 4)
        scored.append(F.when(hits > 0, F.struct(
            score.alias("confidence"), F.lit(-number).alias("rank"), F.lit(kind).alias("doc_type"), masks[kind].alias("mask"))))
    unknown = F.struct(
        F.when(empty, F.lit(0.0)).otherwise(F.lit(V.UNKNOWN_SCORE)).alias("confidence"), F.lit(1).alias("rank"),
        F.lit("unknown").alias("doc_type"), F.lit(0).alias("mask"))
    return F.coalesce(F.greatest(*scored), unknown)


def rule_signals(doc_type: Column, mask: Column) -> Column:
    """The patterns of the chosen type that occur."""
    signals = F.array().cast("array<string>")
    for kind, _, patterns in V.DOCUMENT_RULES:
        found = F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << i) > 0, F.lit(p)) for i, p in enumerate(patterns)]))
        signals = F.when(doc_type == kind, found).otherwise(signals)
    return signals


_NONE = "array<string>"
_IN_NUMBERS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "-().+"
_BEFORE_DIGITS = 40      # characters kept of what stands before: the letters of an IBAN, and a word with its marks


def _from_digits(c: Column) -> Column:
    """A text from a little before its first digit on. What has digits is found there as in the whole text.

    Most texts have few digits, late, and one run over what has none is far cheaper than a pattern tried at every place of it. The
    blanks, dashes and brackets before the first digit stay, since a phone number may begin with any of them.
    """
    bare = F.rtrim(F.regexp_extract(c, r"(?U)^\D*+", 0), F.lit(_IN_NUMBERS))
    return F.substr(c, F.greatest(F.length(bare) - _BEFORE_DIGITS, F.lit(1)))


def emails(c: str | Column) -> Column:
    c = _col(c)
    return F.when(c.contains("@"), F.regexp_extract_all(c, F.lit("(?U)" + V.EMAIL), 0)).otherwise(F.array().cast(_NONE))


def phones(c: str | Column, strict_reference: bool = False) -> Column:
    """Phone-like runs without white space.

    Runs of fewer than seven digits (dots, dashes, brackets) are dropped unless
    ``strict_reference`` asks for every run the pattern finds.
    """
    text = _col(c) if strict_reference else _from_digits(_col(c))
    runs = F.transform(
        F.regexp_extract_all(text, F.lit("(?U)" + V.PHONE), 1), lambda r: F.regexp_replace(r, r"(?U)\s+", "")
    )
    least = V.PHONE_MIN_DIGITS
    if strict_reference:
        return F.filter(runs, lambda r: F.length(r) >= least)
    return F.filter(runs, lambda r: F.length(F.regexp_replace(r, r"(?U)\D", "")) >= least)


def dates(c: str | Column) -> Column:
    return F.regexp_extract_all(_from_digits(_col(c)), F.lit("(?iU)" + V.DATE), 0)


def urls(c: str | Column) -> Column:
    c = _col(c)
    found = F.regexp_extract_all(c, F.lit("(?U)" + V.URL), 0)
    return F.when(c.contains("http") | c.contains("www."), found).otherwise(F.array().cast(_NONE))


def ibans(c: str | Column) -> Column:
    return F.regexp_extract_all(_from_digits(_col(c)), F.lit("(?U)" + V.IBAN), 0)


COMMON = {"email": emails, "phone": phones, "date": dates, "url": urls, "iban": ibans}


def _field(text: Column, patterns: list[str], limit: int | None = None) -> Column:
    """First group of the first pattern that matches, stripped; NULL when none matches."""
    found = None
    for p in patterns:
        p = "(?idU)" + p
        value = F.when(text.rlike(p), strip(F.regexp_extract(text, p, 1)))
        found = value if found is None else F.coalesce(found, value)
    return found.substr(1, limit) if limit else found


def _entity(kind: str, value: Column, confidence: float, guard: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("entity_type"), F.when(guard, value).alias("value"), F.lit(confidence).alias("confidence")
    )


def field_entities(text: str | Column, doc_type: str | Column, strict_reference: bool = False) -> Column:
    """ARRAY of the fields that belong to the document type, in pattern order.

    A resume's skills are its whole section; ``strict_reference`` cuts them at 300 characters.
    """
    text, doc_type = _col(text), _col(doc_type)
    fields = []
    kinds = {}
    for name, specs in V.TYPE_FIELDS.items():
        kinds.setdefault(id(specs), (specs, []))[1].append(name)
    for specs, names in kinds.values():
        for kind, confidence, patterns, limit in specs:
            fields.append(_entity(kind, _field(text, patterns, limit), confidence, doc_type.isin(names)))
    resume, passport = doc_type == "resume", doc_type == "passport"
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c]"), strip), lambda x: x != "")
    name = F.when(F.length(F.get(lines, F.lit(0))) < V.RESUME_NAME_CHARS, F.get(lines, F.lit(0)))
    skills_pattern, skills_confidence = V.RESUME_SKILLS
    skills_pattern = skills_pattern.replace(r"\Z", r"\z")  # Java's name for the very end
    skills = F.regexp_extract(text, "(?isU)" + skills_pattern, 1)
    skills = skills.substr(1, V.RESUME_SKILLS_CHARS) if strict_reference else skills
    linkedin_pattern, linkedin_confidence = V.RESUME_LINKEDIN
    linkedin = F.regexp_extract(text, "(?iU)" + linkedin_pattern, 0)
    fields += [
        _entity("full_name", name, V.RESUME_NAME_CONFIDENCE, resume),
        _entity("skills_section", F.when(text.rlike("(?isU)" + skills_pattern), strip(skills)), skills_confidence, resume),
        _entity("linkedin", F.when(linkedin != "", linkedin), linkedin_confidence, resume),
        _entity("passport_number",
                F.when(text.rlike("(?U)" + V.PASSPORT_NUMBER[0]), F.regexp_extract(text, "(?U)" + V.PASSPORT_NUMBER[0], 1)),
                V.PASSPORT_NUMBER[1], passport),
        _entity("nationality", _field(text, [V.NATIONALITY[0]]), V.NATIONALITY[1], passport),
    ]
    return F.filter(F.array(*fields), lambda e: e["value"].isNotNull())


def common_entities(text: str | Column, strict_reference: bool = False, kinds: list[str] | None = None) -> Column:
    """ARRAY of emails, phones, dates, URLs and IBANs in that order, all matches; ``kinds`` names those wanted."""
    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(
            F.lit(kind).alias("entity_type"), v.alias("value"), F.lit(V.COMMON_CONFIDENCE[kind]).alias("confidence")))

    return F.concat(*[
        tagged(kind, extract(text, strict_reference) if kind == "phone" else extract(text)) for kind, extract in COMMON.items()
        if kinds is None or kind in kinds
    ])


def normalized_value(kind: Column, value: Column) -> Column:
    """Amounts become plain numbers, dates are copied, other types have no normalized form."""
    return F.when(kind.isin(V.AMOUNT_ENTITIES), first_number(value)).when(kind.isin(V.DATE_ENTITIES), value)


def suggestions(doc_type: Column, has_tables: Column, file_format: Column, text: Column,
                n_emails: Column, n_phones: Column) -> Column:
    """ARRAY of suggested actions, lowest priority number first."""
    conditions = {
        "extract_tables": has_tables,
        "convert_excel": F.lower(file_format) == "pdf",
        "convert_word": F.lower(file_format) == "pdf",
        "extract_emails": n_emails > 0,
        "extract_phones": n_phones > 0,
        "export_invoice_json": doc_type == "invoice",
        "export_cv_json": doc_type == "resume",
        "clean_data": has_tables | doc_type.isin("spreadsheet", "bank_statement"),
        "search_document": F.length(text) > V.SEARCHABLE_CHARS,
    }
    counts = {"extract_emails": n_emails, "extract_phones": n_phones}
    items = []
    for order, (kind, (title, priority, action, extra)) in enumerate(V.SUGGESTIONS.items()):
        label = F.replace(F.lit(title), F.lit("{n}"), counts[kind].cast("string")) if kind in counts else F.lit(title)
        params = F.create_map(*[F.lit(x) for pair in {"action": action, **extra}.items() for x in pair])
        items.append(F.when(F.coalesce(conditions[kind], F.lit(False)), F.struct(
            F.lit(priority).alias("priority"), F.lit(order).alias("rule"), F.lit(kind).alias("suggestion_type"),
            label.alias("title"), F.to_json(params).alias("action_params"))))
    return F.array_sort(F.filter(F.array(*items), lambda s: s.isNotNull()))


def tokens(c: str | Column, min_length: int = 2) -> Column:
    """Lower-case words of Arabic and other letters, digits and underscores."""
    run = V.TOKEN.removesuffix("+") + "{%d,}" % min_length
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(run), 0)


_SPACE = "(?U)"


def sentences(c: str | Column) -> Column:
    """Sentences of a text: paragraphs at blank lines, then splits after ``. ! ? ؟``."""
    paragraphs = F.split(strip(c), r"\n{2,}")
    split = F.flatten(F.transform(paragraphs, lambda p: F.split(strip(p), _SPACE + r"(?<=[.!?؟])\s+")))
    return F.filter(F.transform(split, strip), lambda s: s != "")


def answer_pieces(c: str | Column) -> Column:
    """Pieces of a chunk for answers: cut after sentence ends and line breaks, longer than 15 characters."""
    pieces = F.split(_col(c), _SPACE + r"(?<=[.!?؟\n])\s*")
    return F.filter(F.transform(pieces, strip), lambda s: F.length(s) > V.ANSWER_MIN_SENTENCE)
