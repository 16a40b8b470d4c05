import math
import random

from pyspark.sql import functions as F

from quiremill.llm import url_filter
from quiremill.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, host string, score string, f int"


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for _, r in URL_RULES
            if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y", 3) for i, u in enumerate(urls)], SCHEMA)


def test_host_path_rule_and_verdict(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?q#f", "x://example.org/en/1", "x://example.org/en/2",
            "x://notexample.org/es/", "http://a.com/de/1#x", "http://com/fr/", "http://b.com", "http://É.com?/de/", "http://a.net/y\nz?b",
            "http://x.org?x=http://y.com/de/", "http://org/", "a://b://c.com/de/", "http://" + "long" * 5000 + ".com/de/"]
    urls += [f"https://h{i}.{s}/{p}/{i}" for i in range(60) for s in ("com", "org") for p in ("de", "fr", "es")]
    df = pages(spark, urls * 2)
    host, path = url_filter.host_and_path(F.col("url"))
    _, verdict = url_filter.rule_of(host, path, URL_RULES)
    model = url_filter.train(df.select("url", (verdict == "block").alias("block")))
    decisions = {rule: decision for decision, rule in URL_RULES}
    got = url_filter.judge(df, URL_RULES, model).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        url = urls[r.page_id % len(urls)]
        assert (r.host, r.path, r.rule) == brute(url)
        assert r.verdict == (decisions[r.rule] if r.rule else "block" if r.score >= 0.5 else "allow") and 0 <= r.score <= 1


def test_features_by_hand(spark):
    df = pages(spark, ["https://a1.b.com/x/yy/?p=1&q=2#z", None])
    rows = {r.page_id: r.f for r in url_filter.with_features(df.select("page_id", "url")).collect()}
    f, url = rows[0], "https://a1.b.com/x/yy/?p=1&q=2#z"
    entropy = -sum(url.count(c) / len(url) * math.log2(url.count(c) / len(url)) for c in set(url))
    assert (f.length, f.depth, f.parameters, f.host_labels, f.fragment, f.suffix1, f.suffix2) == (len(url), 2, 2, 3, 1, "com", "b.com")
    assert abs(f.entropy - entropy) < 1e-9 and abs(f.digit_ratio - 3 / len(url)) < 1e-9
    assert rows[1].length == 0 and rows[1].entropy == 0


def test_learns_held_out_urls(spark):
    rng = random.Random(2)
    make = lambda bad: (f"http://s{rng.randrange(10**6)}{rng.randrange(10**6)}.com/?{'&'.join(f'k{i}={i}' for i in range(5))}" if bad
                        else f"https://news.com/{rng.choice(['world', 'sport'])}/story")
    rows = [(make(i % 2), bool(i % 2)) for i in range(400)]
    model = url_filter.train(spark.createDataFrame(rows[:300], "url string, block boolean"))
    test = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[300:])], "page_id long, url string")
    got = url_filter.judge(test, [], model).collect()
    assert sum((r.verdict == "block") == rows[300 + r.page_id][1] for r in got) >= 98


def test_without_labels_and_empty(spark):
    none = spark.createDataFrame([("http://a.com/", None)], "url string, block boolean")
    model = url_filter.train(none)
    assert [r.verdict for r in url_filter.judge(pages(spark, ["http://q.net/", None]), [], model).collect()] == ["allow"] * 2
    assert url_filter.judge(pages(spark, ["x"]).limit(0), URL_RULES, url_filter.train(none.limit(0))).count() == 0


def test_no_python_in_the_plan(spark):
    df = pages(spark, [f"http://a{i}.com/" for i in range(20)])
    model = url_filter.train(df.select("url", (F.col("page_id") % 2 == 0).alias("block")))
    plan = url_filter.judge(df, URL_RULES, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
