"""Column expressions of the cleaning rules. Everything stays inside the JVM."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiremill.functions import values as V


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.trim(_col(c), F.lit(V.BLANKS))


def arabic_digits(c: str | Column) -> Column:
    return F.translate(_col(c), V.ARABIC_INDIC_DIGITS, V.WESTERN_DIGITS)


_ISO = r"^\d{4}-\d{2}-\d{2}$"
_DAY_FIRST = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$"
_YEAR_FIRST = r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$"
_NAMED_MONTH = r"^(\d{1,2})\s+([A-Za-z\x{0600}-\x{06FF}]+)\.?\s+(\d{2,4})$"


def _month_number(word: Column) -> Column:
    """Month of a name; a word is first looked up by its first three letters."""
    pairs = [x for i, names in enumerate(zip(V.MONTHS_EN, V.MONTHS_AR), start=1) for n in names for x in (n, f"{i:02d}")]
    months = F.create_map(*map(F.lit, pairs))
    return F.coalesce(F.try_element_at(months, F.lower(word).substr(1, 3)), F.try_element_at(months, word))


def _then(steps: list, c: str | Column) -> Column:
    value = _col(c)
    for step in steps:
        value = step(value)
    return value


def _ordered_date(v: Column) -> Column:
    """Year, month and day in order and padded; text of another shape stays as it is."""
    numeric = F.regexp_replace(F.regexp_replace(v, _DAY_FIRST, "$3-$2-$1"), _YEAR_FIRST, "$1-$2-$3")
    named = F.concat(
        F.regexp_extract(v, _NAMED_MONTH, 3), F.lit("-"), _month_number(F.regexp_extract(v, _NAMED_MONTH, 2)),
        F.lit("-"), F.regexp_extract(v, _NAMED_MONTH, 1))
    ordered = F.when(v.rlike(r"[A-Za-z\x{0600}-\x{06FF}]"), named).otherwise(numeric)
    padded = F.regexp_replace(ordered, r"-(\d)(?=-|$)", "-0$1")
    padded = F.regexp_replace(F.regexp_replace(padded, r"^(\d{2})-", "20$1-"), r"^(\d{3})-", "0$1-")
    return F.when(v.rlike(r"^\d.{5}"), padded)      # a cheap test: most cells do not start with a digit


# The rules as steps. A table-wide rewrite gives each step a column of its own, so
# that values used several times are computed once.
DATE_STEPS = [
    lambda c: arabic_digits(strip(c)),
    _ordered_date,
    lambda d: F.when(d.rlike(_ISO), d),
]


def normalize_date(c: str | Column) -> Column:
    """``YYYY-MM-DD`` text for the known date shapes (day first), else NULL.

    No calendar check: ``31/13/2023`` becomes ``2023-13-31``.
    """
    return _then(DATE_STEPS, c)


_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _plain_number(c: Column) -> Column:
    v = arabic_digits(strip(c))
    grouped = v.contains(",") | v.contains("،")
    return F.when(grouped, F.regexp_replace(v, r"(?<=\d)[,،](?=\d{3})", "")).otherwise(v)


def _to_double(v: Column) -> Column:
    return F.when(v.rlike(_NUMBER), v.try_cast("double"))


def parse_number(c: str | Column) -> Column:
    """DOUBLE of localized number text, NULL when it is not a number."""
    return _then([_plain_number, _to_double], c)


def number_text(x: Column) -> Column:
    """Text of a double: whole numbers without a fraction, no exponent from 0.0001 up to 1e20."""
    plain = F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    tiny = F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), r"E(-?)(\d)$", "E$10$2")
    return (
        F.when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e20) | (x == 0), plain)
        .when((F.abs(x) >= 1e20) & (F.abs(x) < 1e37), x.cast("decimal(38,0)").cast("string"))
        .otherwise(F.replace(tiny, F.lit("E"), F.lit("e")))
    )


NUMBER_STEPS = [_plain_number, _to_double, number_text]


def normalize_number(c: str | Column) -> Column:
    """Plain number text, NULL for text that is no number (``inf`` and ``nan`` are none)."""
    return _then(NUMBER_STEPS, c)


_SYMBOL_FIRST = r"^([\$€£])\s*([\d,.]+)$"
_CODE_LAST = r"(?iu)^([\d,.]+)\s*(" + "|".join(V.CURRENCY_WORDS) + r")$"


def _with_code(v: Column) -> Column:
    code = F.lit(None).cast("string")
    for symbol, name in V.CURRENCY_SYMBOLS.items():
        code = F.when(v.startswith(symbol), F.lit(name)).otherwise(code)
    amount_1 = F.replace(F.regexp_extract(v, _SYMBOL_FIRST, 2), F.lit(","), F.lit(""))
    amount_2 = F.replace(F.regexp_extract(v, _CODE_LAST, 1), F.lit(","), F.lit(""))
    last = F.when(v.rlike(_CODE_LAST), F.concat_ws(" ", amount_2, F.upper(F.regexp_extract(v, _CODE_LAST, 2))))
    return F.when(v.rlike(_SYMBOL_FIRST), F.concat_ws(" ", amount_1, code)).when(v.rlike(r"^[\d,.]"), last)


CURRENCY_STEPS = [strip, _with_code]


def normalize_currency(c: str | Column) -> Column:
    """``1234.50 USD`` from ``$1,234.50`` or ``1,234.50 usd``, else NULL."""
    return _then(CURRENCY_STEPS, c)


def currency_amount(c: str | Column) -> Column:
    """The amount of a normalized currency text as DECIMAL(38,10)."""
    return F.split_part(normalize_currency(c), F.lit(" "), F.lit(1)).try_cast("decimal(38,10)")


def outlier_value(c: str | Column) -> Column:
    """The number the outlier rule sees: commas removed, then parsed; NULL otherwise."""
    v = strip(F.replace(_col(c).cast("string"), F.lit(","), F.lit("")))
    return F.when(v.rlike(_NUMBER), v.try_cast("double"))


def null_if_sentinel(c: str | Column) -> Column:
    c = _col(c)
    return F.when(~c.isin(V.NULL_WORDS), c)


def is_blank(c: str | Column) -> Column:
    """True for NULL and for text of white space only."""
    return F.coalesce(strip(_col(c).cast("string")), F.lit("")) == ""


_DIACRITICS = r"[\x{064B}-\x{065F}\x{0670}\x{0640}]"


def normalize_arabic(c: str | Column) -> Column:
    """Fold Arabic spelling variants: alef, ya and ta-marbuta forms, marks and tatweel."""
    return F.translate(F.regexp_replace(_col(c), _DIACRITICS, ""), "أإآٱىة", "اااايه")


def first_number(c: str | Column) -> Column:
    """First run of digits and dots after removing commas and blanks; NULL when there is none."""
    run = F.regexp_extract(F.translate(_col(c), ", ", ""), r"[\d.]+", 0)
    return F.when(run != "", run)


def strip_junk_lines(c: str | Column) -> Column:
    """Drop blank lines and lines that hold no letter or digit."""
    lines = F.split(_col(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    keep = F.filter(lines, lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return F.array_join(keep, "\n")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
