"""Column expressions for labels shown to people, file kinds, URLs and math cells."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiremill.functions import values as V
from quiremill.functions.cleaning import _col, any_of


def _decimals(x: Column, places: int, unit: str) -> Column:
    # Half-even rounding first: the formatter alone would round halves up.
    return F.format_string(f"%.{places}f {unit}", F.bround(x, places))


def human_size(c: str | Column) -> Column:
    """``1.5 MB`` style text, one decimal, 1024 steps from B to PB."""
    size = F.coalesce(_col(c).cast("double"), F.lit(0.0))
    label = None
    for power, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        text = _decimals(size / F.lit(float(1024 ** power)), 1, unit)
        fits = size < float(1024 ** (power + 1))
        label = F.when(fits, text) if label is None else label.when(fits, text)
    return label.otherwise(_decimals(size / F.lit(float(1024 ** 5)), 1, "PB"))


def human_size_short(c: str | Column) -> Column:
    """Variant for account totals: whole bytes below 1 KB, two decimals from 1 GB on."""
    size = F.coalesce(_col(c).cast("bigint"), F.lit(0))
    k = 1024.0
    return (
        F.when(size < 1024, F.format_string("%d B", size))
        .when(size < 1024**2, _decimals(size / k, 1, "KB"))
        .when(size < 1024**3, _decimals(size / k**2, 1, "MB"))
        .otherwise(_decimals(size / k**3, 2, "GB"))
    )


def time_since(ts: str | Column, as_of: Column) -> Column:
    """``now``, ``5 minutes ago``, ``3 hours ago``, ``2 days ago`` or the date itself after a week."""
    ts = _col(ts)
    seconds = F.timestamp_diff("SECOND", ts, as_of)
    ago = lambda step, unit: F.concat((seconds / step).cast("bigint").cast("string"), F.lit(f" {unit} ago"))
    return (
        F.when(ts.isNull(), F.lit(""))
        .when(seconds < 60, F.lit("now"))
        .when(seconds < 3600, ago(60, "minutes"))
        .when(seconds < 86400, ago(3600, "hours"))
        .when(seconds < 604800, ago(86400, "days"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def truncate_suffix(c: str | Column, length: int = 100, suffix: str = "...") -> Column:
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.when(F.length(text) <= length, text).otherwise(
        F.concat(text.substr(1, length - len(suffix)), F.lit(suffix))
    )


def extension(name: str | Column) -> Column:
    """Lower-case text after the last dot, empty without a dot."""
    name = _col(name)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def type_by_extension(name: str | Column) -> Column:
    """Document type known from the extension alone, NULL when the content decides."""
    ext = extension(name)
    kind = F.lit(None).cast("string")
    for value in sorted(set(V.EXTENSION_TYPES.values())):
        names = [e for e, t in V.EXTENSION_TYPES.items() if t == value]
        kind = F.when(ext.isin(names), F.lit(value)).otherwise(kind)
    return kind


def is_category(ext: str | Column, category: str) -> Column:
    return F.coalesce(F.lower(_col(ext)).isin(V.FILE_CATEGORIES[category]), F.lit(False))


def file_category(ext: str | Column) -> Column:
    """image, video, audio, document or spreadsheet; ``other`` when none matches."""
    label = F.lit("other")
    for category in reversed(list(V.FILE_CATEGORIES)):
        label = F.when(is_category(ext, category), F.lit(category)).otherwise(label)
    return label


def sniff_type(content: str | Column, declared: Column | None = None) -> Column:
    """Extension found from the first bytes of a file; ``bin`` when nothing matches.

    ``declared`` replaces ``bin`` when the caller knows a content type.
    """
    content = _col(content)
    first = F.hex(F.substring(content, 1, 12))
    # Latin-1 keeps every byte, so the text tests below never fail on binary data.
    head = F.decode(F.substring(content, 1, 500), "ISO-8859-1")
    names = F.decode(F.substring(content, 1, 2000), "ISO-8859-1")
    starts = lambda *prefixes: any_of([first.startswith(p.encode("latin-1").hex().upper()) for p in prefixes])
    opening = F.decode(F.substring(content, 1, 1), "ISO-8859-1")
    json_like = opening.isin("{", "[") & F.try_parse_json(
        F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    ).isNotNull()
    lines = F.split(F.trim(head, F.lit(V.BLANKS)), "\n")
    return (
        F.when(starts("%PDF"), "pdf")
        .when(starts("\x89PNG"), "png")
        .when(starts("\xff\xd8\xff"), "jpg")
        .when(starts("GIF8"), "gif")
        .when(starts("RIFF") & (F.length(content) > 12) & (first.substr(17, 8) == b"WEBP".hex().upper()), "webp")
        .when(starts("BM"), "bmp")
        .when(starts("<svg", "<?xml") & F.lower(head).contains("<svg"), "svg")
        .when(starts("PK\x03\x04"),
              F.when(names.contains("word/"), "docx").when(names.contains("xl/"), "xlsx")
              .when(names.contains("ppt/"), "pptx").otherwise("zip"))
        .when(json_like, "json")
        .when(starts("<"), "xml")
        .when(head.contains(",") & head.contains("\n") & (F.size(lines) > 1) & F.element_at(lines, 1).contains(","), "csv")
        .when(F.is_valid_utf8(F.substring(content, 1, 500).cast("string")), "txt")
        .otherwise(F.lit("bin") if declared is None else declared)
    )


def canonical_url(c: str | Column) -> Column:
    """The address behind redirect, drive, share and code-view links; other URLs unchanged."""
    url = _col(c)
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    query = lambda name: F.try_parse_url(url, F.lit("QUERY"), F.lit(name))
    drive_id = F.regexp_extract(url, r"/file/d/([^/]+)", 1)
    download = lambda file_id: F.concat(F.lit("https://drive.google.com/uc?export=download&id="), file_id)
    code_path = F.regexp_extract(url, r"^[^/]*//[^/]*/([^/]+/[^/]+)/(?:[^/]+/)*?blob/", 1)
    code_rest = F.regexp_extract(url, r"/blob/(.+)$", 1)
    return (
        F.when(host.contains("google.com") & url.contains("/url?") & query("url").isNotNull(),
               F.url_decode(query("url")))
        .when(host.contains("drive.google.com") & (drive_id != ""), download(drive_id))
        .when(host.contains("drive.google.com") & query("id").isNotNull(), download(query("id")))
        .when(host.contains("dropbox.com") & url.contains("?dl=0"), F.replace(url, F.lit("?dl=0"), F.lit("?dl=1")))
        .when(host.contains("dropbox.com") & ~url.contains("?dl="), F.concat(url, F.lit("?dl=1")))
        .when(host.contains("github.com") & (code_path != "") & (code_rest != ""),
              F.concat(F.lit("https://raw.githubusercontent.com/"), code_path, F.lit("/"), code_rest))
        .otherwise(url)
    )


LATEX_COMMAND_PATTERN = r"\\(?:" + "|".join(V.LATEX_COMMANDS) + ")"


def has_math(c: str | Column) -> Column:
    """True when text holds LaTeX: ``$...$``, ``$$...$$`` or a known command."""
    text = _col(c)
    dollars = text.contains("$") & (text.rlike("(?s)" + V.LATEX_DISPLAY) | text.rlike("(?s)" + V.LATEX_INLINE))
    command = text.contains("\\") & text.rlike(LATEX_COMMAND_PATTERN)
    return F.coalesce(dollars | command, F.lit(False))


def has_chemical(c: str | Column) -> Column:
    return F.coalesce(_col(c).rlike("(?U)" + V.CHEMICAL), F.lit(False))


_RTL_SCRIPTS = r"\p{IsArabic}\p{IsHebrew}\p{IsSyriac}\p{IsThaana}\p{IsNko}"


def is_rtl(c: str | Column) -> Column:
    """True when right-to-left letters outnumber left-to-right letters."""
    text = _col(c)
    kept = lambda drop: F.length(F.regexp_replace(text, f"(?:{drop})+", ""))
    rtl = kept(f"[^{_RTL_SCRIPTS}]")
    rtl_letters = kept(f"[^{_RTL_SCRIPTS}]|[^\\p{{L}}]")
    return rtl > kept(r"[^\p{L}]") - rtl_letters
