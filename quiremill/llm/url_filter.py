"""URL filter: rules first, then gradient-boosted trees on lexical features, with DataFrame functions only."""
from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiremill.session import written

#: Labelled rows that the trees are fitted on: those with the smallest hash of the url.
SAMPLE_ROWS = 10_000
BROADCAST_SUFFIXES = 100_000      # more suffixes are joined by a shuffle
PRIOR_ROWS = 20.0                 # weight of the overall share in a suffix's share
SUFFIX_LABELS = (1, 2)            # a suffix is the host's last label, or its last two

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ["length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters",
           "fragment", "secure", "longest_segment", "other_ratio"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for NULL and without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return tuple(F.when(at > 0, part).otherwise("") for part in (host, path))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; NULL if none does.

    ``rules`` is a list such as ``("allow", "org/")``: a rule fits its host and all subdomains
    of it where the path starts with the rule's.
    """
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in sorted(rules, key=lambda r: len(r[1])):           # longer ones are put before
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, rule).otherwise(found)
        verdict = F.when(fits, decision).otherwise(verdict)
    return found, verdict


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    size = F.length(text)
    some = F.greatest(size, F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / some
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    entropy = F.aggregate(
        F.transform(chars, lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / some), F.lit(0.0),
        lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return {
        "length": size, "host_length": F.length(host), "path_length": F.length(path), "depth": F.size(segments),
        "host_labels": F.size(F.split(host, r"\.")), "digit_ratio": share("[^0-9]"), "entropy": entropy,
        "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")),
        "fragment": F.instr(text, "#") > 0, "secure": F.lower(F.substring(text, 1, 8)) == "https://",
        "longest_segment": F.coalesce(F.array_max(F.transform(segments, lambda s: F.length(s))), F.lit(0)),
        "other_ratio": share("[A-Za-z0-9]"),
    }


def with_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """The rows with host, path, lexical features and suffixes in a struct column ``f``."""
    host, path = host_and_path(urls[url])
    rows = urls.select("*", F.struct(host.alias("host"), path.alias("path")).alias("_p"))
    h, p = F.col("_p.host"), F.col("_p.path")
    features = {k: v.cast("double") for k, v in lexical_features(F.col(url), h, p).items()}
    suffixes = [F.substring_index(h, ".", -n).alias(f"suffix{n}") for n in SUFFIX_LABELS]
    return rows.select("*", F.struct(
        h.alias("host"), p.alias("path"), *suffixes, *[v.alias(k) for k, v in features.items()]).alias("f")).drop("_p")


class UrlModel:
    """Suffix statistics and trees; ``constant`` stands in where the labels are of one kind or absent."""

    def __init__(self, shares: list[DataFrame], prior: float, trees: GBTClassificationModel | None):
        self.shares, self.prior, self.trees = shares, prior, trees

    def with_shares(self, rows: DataFrame) -> DataFrame:
        for n, table in zip(SUFFIX_LABELS, self.shares):
            small = F.broadcast(table) if table.count() <= BROADCAST_SUFFIXES else table
            rows = rows.join(small, F.col(f"f.suffix{n}") == F.col(f"_suffix{n}"), "left").drop(f"_suffix{n}")
            rows = rows.withColumn(f"_share{n}", F.coalesce(f"_share{n}", F.lit(self.prior)))
        return rows

    def assembled(self, rows: DataFrame) -> DataFrame:
        """Adds the column ``_x`` with all features."""
        names = [f"_share{n}" for n in SUFFIX_LABELS]
        rows = self.with_shares(rows).withColumns({f"_{c}": F.col(f"f.{c}") for c in LEXICAL})
        columns = [*[f"_{c}" for c in LEXICAL], *names]
        return VectorAssembler(inputCols=columns, outputCol="_x").transform(rows).drop(*columns)

    def scored(self, rows: DataFrame) -> DataFrame:
        """Adds ``_score``, the probability of blocking."""
        if self.trees is None:
            return rows.withColumn("_score", F.lit(self.prior))
        out = self.trees.transform(self.assembled(rows))
        return out.withColumn("_score", vector_to_array("probability")[1])


def train(labelled: DataFrame, url: str = "url", label: str = "block", rows: int = SAMPLE_ROWS, rounds: int = 12,
          depth: int = 4) -> UrlModel:
    """Fit on rows with a url and a boolean label; NULL labels are left out.

    Suffix statistics count all labelled rows; the trees are fitted on at most ``rows`` of them.
    """
    known = with_features(labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("y"))
                          .where("y is not null"))
    total = known.agg(F.count("*").alias("n"), F.avg("y").alias("p")).first()
    prior = float(total.p or 0.0)
    shares = [written(known.groupBy(F.col(f"f.suffix{n}").alias(f"_suffix{n}")).agg(
        ((F.sum("y") + PRIOR_ROWS * prior) / (F.count("*") + PRIOR_ROWS)).alias(f"_share{n}")), f"suffix{n}")
        for n in SUFFIX_LABELS]
    model = UrlModel(shares, prior, None)
    if 0.0 < prior < 1.0:
        sample = known.orderBy(F.xxhash64("url"), "url", "y").limit(rows)
        sample = written(model.assembled(sample).select("_x", "y"), "url_sample").coalesce(1)
        model.trees = GBTClassifier(
            featuresCol="_x", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7).fit(sample)
    return model


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel, key: str = "page_id", url: str = "url",
          threshold: float = 0.5) -> DataFrame:
    """(key, host, path, rule, verdict, score): every row's verdict, from the longest rule or else from the trees.

    ``score`` is the model's probability of blocking, for all rows. NULL urls and urls without ``://``
    have empty host and path, fit no rule and are judged by their other features; repeated
    rows are judged one by one; other columns are not read.
    """
    rows = model.scored(with_features(pages.select(pages[key].alias("key"), pages[url].alias("url"))))
    rule, verdict = rule_of(F.col("f.host"), F.col("f.path"), rules)
    return rows.select(
        F.col("key").alias(key), F.col("f.host").alias("host"), F.col("f.path").alias("path"), rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("_score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        F.col("_score").alias("score"))
