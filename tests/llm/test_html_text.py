import re
import time
import tracemalloc

from quiremill.llm import html_text
from quiremill.llm.html_text import Page

SCHEMA = "page_id long, url string, html string, text string, host int"


def test_article_without_the_rest():
    page = Page("""<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
      <body class="has-sidebar"><header>Top</header><nav><ul><li><a href="/x">Menu</a></ul></nav><!-- <p>no --><div class="ad box">Buy</div>
      <article><header><h1>Title &amp; more</h1></header><p>One\n two&nbsp;<b>bold<br><p>a &lt; b &#233;</p><div id="cookie-notice">ok</div>
      <ul><li>x<li>y</ul><table><tr><td>1<td>2</table><form><p>f</p></form><p>p <span class="advert">buy</span>q</p>
      <section class="reader-comments"><p>nice</p></section></article><aside>s</aside><footer>&copy; f</footer></body></html>""")
    assert page.text() == "Title & more\nOne two bold\na < b é\nx\ny\n1\n2\np\nq"


def test_without_article_and_broken_markup():
    assert Page("<body><div>a<p>b</body>").text() == "a\nb"
    assert Page("<main>m</main><p>rest").text() == "m"
    assert Page("1 < 2 and <b>x</b></p></div>").text() == "1 < 2 and x"
    assert Page('<p title="a>b">t</p><p x="unclosed>u</p>').text() == "t\nu"
    assert Page("<script>never closed <p>x").text() == "" and Page(None).text() == "" and Page("").text() == ""
    assert Page("<p>" + "long text " * 100000).text() == ("long text " * 100000).strip()
    assert Page("<div>" * 3000 + "deep").text() == "deep"


def test_deep_pages_take_room_in_proportion():
    source = "<div>x <i>y</i> " * 20_000 + "</span></section>" * 20_000
    tracemalloc.start()
    began = time.perf_counter()
    page = Page(source)
    took, (_, peak) = time.perf_counter() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert took < 5 and peak < 50e6                       # traced memory makes it several times slower
    assert page.text() == "\n".join(["x y"] * 20_000) and len(page.subtrees()) == 19_999
    inner = page.hashes[10_000]
    assert page.text({inner}) == "\n".join(["x y"] * 10_000)


def test_headers_and_minor_articles():
    page = """<body><div class="site-header">Logo</div><div class="entry-header"><h1>Title</h1></div><div>Text</div></body>"""
    assert Page(page).text() == "Title\nText"
    page = """<article><div class="header">Head</div><p>Text</p></article><article class="comment"><p>c</p></article>
      <section id="comments"><article><p>d</p></article></section>"""
    assert Page(page).text() == "Head\nText"


def brute_templates(pages):
    """Counts of subtrees over different pages, in plain Python."""
    hosts = {}
    for url, source in pages:
        host = re.sub(r"[/?#].*", "", (url or "").partition("://")[2], flags=re.S).lower()
        page = Page(source)
        hosts.setdefault(host, {})[page.text()] = page.subtrees() - {0}
    out = {}
    for host, found in hosts.items():
        every = [h for s in found.values() for h in s]
        need = max(html_text.TEMPLATE_PAGES, html_text.TEMPLATE_SHARE * len(found))
        out[host] = {h for h in every if every.count(h) >= need}
    return out


def test_site_templates_against_brute_force(spark):
    pages = [(f"https://Big.com/{i}", f"<div><div>Welcome to the site</div><p>story {i}</p><p>more {i % 2}</p></div>") for i in range(24)]
    pages += [("https://big.com/copy", pages[3][1])] * 30
    pages += [(f"http://small.com/{i}", f"<div><div>Welcome to the site</div><p>story {i}</p></div>") for i in range(5)]
    pages += [(None, "<p>x"), ("", None), ("no host", ""), (None, "<div><p>x</p></div>")]
    df = spark.createDataFrame([(i, u, h, "t", 1) for i, (u, h) in enumerate(pages)], SCHEMA)
    known = brute_templates(pages)
    assert known["big.com"] and not known["small.com"]
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert len(got) == len(pages)
    for i, (url, source) in enumerate(pages):
        host = re.sub(r"[/?#].*", "", (url or "").partition("://")[2]).lower()
        assert (got[i].url, got[i].text) == (url, Page(source).text(known[host]))
    assert "Welcome" not in got[0].text and "story 0" in got[0].text and "Welcome" in got[54].text


def test_shuffled_join_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(html_text, "BROADCAST_HOSTS", -1)
    df = spark.createDataFrame([(1, "http://a.b/", "<p>t</p>", "", 1), (None, None, None, None, None)], SCHEMA)
    assert sorted(r.text for r in html_text.extract(df).collect()) == ["", "t"]
    assert html_text.extract(df.limit(0)).count() == 0
