"""Main text of web pages: semantic parts and subtrees that a site repeats are removed."""
from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm.common import arrow_map
from quiremill.llm.url_filter import host_and_path
from quiremill.session import written

#: A subtree is a template if it stands on at least so many different pages of a host, and on this share of them.
TEMPLATE_PAGES = 8
TEMPLATE_SHARE = 0.5
BROADCAST_HOSTS = 50_000          # more hosts with templates are joined by a shuffle

RAW = ("script", "style", "title", "textarea", "iframe", "noembed", "xmp")
DROPPED = {"nav", "footer", "aside", "form", "noscript", "template", "head", "menu", "dialog", "select", "button",
           "svg", "object", "canvas", "audio", "video", "datalist", "fieldset", "map", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FORMAT = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
         "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
         "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary",
         "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: An opening tag ends an open element of these names.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"},
        "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Parts of class, id and role names that mark what is no article text.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo",
         "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal",
         "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall", "comment", "comments", "commentlist",
         "replies", "respond", "disqus", "sidebar", "sidebars", "aside", "widget", "widgets", "menu", "menus", "nav",
         "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "share",
         "sharing", "social", "related", "recommended", "toolbar", "contentinfo", "complementary", "search", "hidden"}
#: Parts that mark a page's header, unless it is the header of the article.
HEADERS = {"header", "topbar", "top"}
OWN_HEADERS = {"entry", "article", "post", "story", "title"}
#: An article element with these is no article of its own.
MINOR_ARTICLES = {"comment", "comments", "reply", "replies", "teaser", "related", "recommended", "promo", "ad", "sponsored"}
ROOTS = {"html", "body", "article", "main"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=/>])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_CUT = re.compile(r"[^a-z0-9]+")


def marked(name: str, rest: str, inside: bool) -> bool:
    """Whether an opening tag says that its element is no article text; ``inside`` an article or main part or not."""
    if len(rest) < 5 or name in ROOTS and name != "article":
        return False
    if _HIDDEN.search(rest):
        return True
    for values in _NAMES.findall(rest):
        parts = set(_CUT.split(max(values, key=len).lower()))
        if parts & (MINOR_ARTICLES if name == "article" else MARKS):
            return True
        if not inside and name not in FORMAT and parts & HEADERS and not parts & OWN_HEADERS:
            return True
    return False


class Page:
    """Blocks of a page's article with the hashes of the subtrees they stand in."""

    def __init__(self, source: str | None) -> None:
        self.blocks: list[tuple[int, str, int]] = []               # container, text, number of the innermost element
        self.hashes: list[int] = []                                # by element number
        self.parents: list[int] = []                               # by element number, -1 at the outermost; always a smaller one
        self._read(source or "")

    def _read(self, source: str) -> None:
        # An element on the stack: name, dropped, container, number, what its subtree holds.
        stack: list[tuple[str, bool, int, int, list[str]]] = [("", False, 0, -1, [])]
        words: list[str] = []
        opened: Counter[str] = Counter()                           # names on the stack

        def flush() -> None:
            if words:
                text = " ".join("".join(words).split())
                words.clear()
                top = stack[-1]
                if text and not top[1]:
                    top[4].append(text)
                    self.blocks.append((top[2], text, top[3]))

        def pop() -> None:
            name, dropped, _, number, held = stack.pop()
            opened[name] -= 1
            if not dropped:
                h = xxhash.xxh64_intdigest("\x1f".join([name, *held])) if held else 0
                self.hashes[number] = h
                if held:
                    stack[-1][4].append(f"\x1e{h:x}")

        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at and not stack[-1][1]:
                words.append(html.unescape(source[at:m.start()]))
            at = m.end()
            if m["name"] is None:
                if m["raw"]:
                    words.append(" ")
                continue
            name = m["name"].lower()
            block = name in BLOCK
            if m["close"]:
                if block:
                    flush()
                if not opened[name]:
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        flush()
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][0] in ROOTS and name not in ROOTS:
                        break
                continue
            if name in VOID:
                words.append(" ")
                if block:
                    flush()
                continue
            if m["rest"].endswith("/>") and name in DROPPED:
                continue
            drop = name in DROPPED or marked(name, m["rest"], stack[-1][2] > 0)
            if name in FORMAT and not drop:
                continue
            if block or drop:
                flush()
            if block:
                closes = ENDS.get(name, frozenset()) | {"p"}
                while stack[-1][0] in closes:
                    pop()
            parent = stack[-1]
            container = max(parent[2], {"article": 2, "main": 1}.get(name, 1 if "role=\"main\"" in m["rest"] else 0))
            dropped = parent[1] or drop or (name == "header" and not container)
            if not dropped:
                self.hashes.append(0)
                self.parents.append(parent[3])
            opened[name] += 1
            stack.append((name, dropped, container, -1 if dropped else len(self.hashes) - 1, []))
        if not stack[-1][1]:
            words.append(html.unescape(source[at:]))
        flush()
        while len(stack) > 1:
            pop()
        best = max((c for c, _, _ in self.blocks), default=0)      # article, else main, else the body
        self.blocks = [b for b in self.blocks if b[0] == best]

    def subtrees(self) -> set[int]:
        """Hashes of the elements that hold a block of the article, without the outermost ones."""
        seen: set[int] = set()
        for _, _, n in self.blocks:
            while n >= 0 and n not in seen:
                seen.add(n)
                n = self.parents[n]
        return {self.hashes[n] for n in seen if self.parents[n] >= 0}

    def text(self, templates: set[int] | None = None) -> str:
        """The blocks outside all template subtrees, one a line."""
        if not templates:
            return "\n".join(t for _, t, _ in self.blocks)
        gone: list[bool] = []
        for h, parent in zip(self.hashes, self.parents):
            gone.append(h in templates or parent >= 0 and gone[parent])
        return "\n".join(t for _, t, n in self.blocks if n < 0 or not gone[n])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def site_templates(pages: DataFrame, url: str = "url", column: str = "html") -> DataFrame:
    """(host, templates array<long>): subtree hashes that recur on a host's pages.

    Counted over all pages; pages of a host with equal text count once, so copies of an article are no
    template. Pages are reduced to hashes in their tasks and counts are combined before the
    shuffle. At most ``1 / TEMPLATE_SHARE`` times the subtrees of an average page can be templates.
    """
    rows = pages.select(host_and_path(F.col(url))[0].alias("host"), F.col(column).alias("html"))

    def subtrees(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, lists = [], []
        for source in batch.column(1):
            page = Page(source.as_py())
            digests.append(_signed(xxhash.xxh64_intdigest(page.text())))
            lists.append([_signed(h) for h in page.subtrees() if h])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["host", "page", "found"])

    found = arrow_map(rows, lambda: subtrees, "host string, page long, found array<long>")
    different = written(found.groupBy("host", "page").agg(F.first("found").alias("found")), "subtrees")
    sizes = different.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= TEMPLATE_PAGES)
    counts = (different.select("host", F.explode("found").alias("subtree")).groupBy("host", "subtree").count()
              .where(F.col("count") >= TEMPLATE_PAGES))
    often = counts.join(sizes, "host").where(F.col("count") >= F.col("pages") * TEMPLATE_SHARE)
    return written(often.groupBy("host").agg(F.collect_set("subtree").alias("templates")), "templates")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", column: str = "html") -> DataFrame:
    """(key, url, text): the main text of every page.

    Menus, headers, footers, sidebars, notices, adverts, forms, comments and the like go by their tags, classes, ids and roles;
    of what is left the ``article`` counts, else ``main``, else the body; then subtrees that the site
    repeats go. Long and deeply nested pages take room and time in proportion. Character references are decoded, white space in a block becomes one space, blocks
    are joined by line feeds. NULL and empty pages give an empty text; NULL urls share one empty
    host; repeated rows are handled one by one; other columns are not read.
    """
    rows = pages.select(pages[key].alias("key"), pages[url].alias("url"), pages[column].alias("html"))
    templates = site_templates(rows, "url", "html")
    if templates.count() <= BROADCAST_HOSTS:
        templates = F.broadcast(templates)
    joined = rows.withColumn("host", host_and_path(F.col("url"))[0]).join(templates, "host", "left")
    joined = joined.select("key", "url", "html", "templates")

    def texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for source, known in zip(batch.column(2), batch.column(3)):
            out.append(Page(source.as_py()).text({h & (1 << 64) - 1 for h in known.as_py() or ()}))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["key", "url", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return arrow_map(joined, lambda: texts, f"key {kind}, url string, text string").withColumnRenamed("key", key)
