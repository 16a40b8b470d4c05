"""I-Match fingerprints from a band of inverse document frequencies, with DataFrame functions only."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiremill.session import written

#: Terms with ln(documents / documents with the term) in this band make the lexicon.
IDF_BAND = (1.0, 7.0)
#: Randomised lexicon subsets: (bits, first bit, subsets); a subset holds about 1 / 2**bits of the lexicon.
SUBSETS = [(1, 0, 2), (3, 1, 4), (5, 4, 8), (7, 9, 16), (9, 16, 16), (11, 25, 16)]
BROADCAST_TERMS = 2_000_000       # a larger lexicon is joined by a shuffle
MARK = 0                          # stands in every document, so that none is lost in the lexicon join
TERM_SPLIT = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct terms: runs of letters and digits in lower case."""
    words = F.filter(F.split(F.lower(text), TERM_SPLIT), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, column: str = "text", band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """(term): terms inside the band, counted over all documents.

    A term of the band stands in at least exp(-band[1]) of all documents, so the lexicon has at most
    exp(band[1]) times as many terms as a document has on average, however many documents there are.
    """
    total = docs.count()
    found = docs.select(F.explode(terms(F.col(column))).alias("term")).groupBy("term").count()
    most, least = total * math.exp(-band[0]), total * math.exp(-band[1])
    return written(found.where(F.col("count").between(least, most)).select("term"), "lexicon")


def signatures(rows: Column) -> Column:
    """One hash for each lexicon subset over the sorted terms in it; NULL for none.

    The terms of a level's subsets are picked once, then told apart.
    """
    def level(bits: int, first: int, count: int) -> Column:
        part = lambda t: F.shiftright(t, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        picked = F.array(F.filter(rows, lambda t: part(t) < count))
        return F.flatten(F.transform(picked, lambda p: F.transform(
            F.transform(F.array(*[F.lit(v) for v in range(count)]), lambda v: F.filter(p, lambda t: part(t) == v)),
            lambda k: F.when(F.size(k) > 0, F.xxhash64(k)))))

    return F.concat(*[level(*s) for s in SUBSETS])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures among those that either has; NULL if neither has any."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    some = F.size(F.filter(both, lambda x: x["a"].isNotNull() | x["b"].isNotNull()))
    same = F.size(F.filter(both, lambda x: x["a"] == x["b"]))
    return F.when(some > 0, same / some)


def in_descending_blocks(docs: DataFrame, key: str, column: str, blocks: int) -> DataFrame:
    """(block, ghost, key, text): documents in blocks of neighbouring keys, each with its successor's row.

    Blocks follow the keys' quantiles, so they are even however the keys are spread; NULL
    keys come last, in a block of their own. The row after the last of a block is added to it as a
    ghost, which takes the first row of the following block; after the last block comes the first.
    """
    rows = docs.select(docs[key].alias("key"), docs[column].alias("text"))
    cuts = rows.agg(F.percentile_approx("key", [i / 32 for i in range(33)], 10_000)).first()[0]
    cuts = sorted(set(cuts or []))
    place = F.lit(0.0)
    for a, b in zip(cuts, cuts[1:]):
        place = place + F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("key") - a) / float(b - a)))
    each = blocks / max(1, len(cuts) - 1)
    rows = rows.withColumn("block", F.when(F.col("key").isNull(), -1).otherwise(F.floor(place * each)).cast("int"))
    heads = rows.groupBy("block").agg(F.max("key").alias("head")).orderBy(F.desc("block")).collect()    # a row a block
    follows = [(r.head, heads[i - 1].block) for i, r in enumerate(heads)]     # the first follows the last
    kind = docs.schema[key].dataType.simpleString()
    after = docs.sparkSession.createDataFrame(follows, f"head {kind}, into int")
    ghosts = rows.join(F.broadcast(after), F.col("key").eqNullSafe(F.col("head")))
    return (rows.select("block", F.lit(0).alias("ghost"), "key", "text")
            .unionByName(ghosts.select(F.col("into").alias("block"), F.lit(1).alias("ghost"), "key", "text")))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", column: str = "text",
                      band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """One row per document: fingerprints of the text and of its edited form, and their likeness.

    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The edited form ends, instead of in its last floor(n_chars / 2) code points, in the first as many (or
    all) of the next document, by descending key; after the last comes the first. Keys may
    be NULL (they come last) or repeat (then the smaller text comes first); NULL and empty texts
    have no terms. A text without lexicon terms is known by its digest: likeness is then 1 for equal
    texts and else 0. The whole work takes one shuffle of the texts: windows, grouping and
    likeness all use the blocks made for the order.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[column], F.lit("")).alias("text"))
    words = lexicon(rows, "text", band)
    size = words.count()
    words = words.union(spark.range(1).select(F.lit(MARK).cast("long")))
    blocks = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = W.partitionBy("block").orderBy("ghost", F.desc_nulls_last("key"), "text")
    follow = in_descending_blocks(rows, "key", "text", blocks).select(
        "block", "ghost", "key", "text", F.row_number().over(order).alias("place"),
        F.lead("text").over(order).alias("next"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half),
                      F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    tag = lambda found, kind: F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(kind).alias("kind")))
    marked = F.array(F.struct(F.lit(MARK).cast("long").alias("term"), F.lit(2).alias("kind")))
    one = follow.withColumn("edited", edited).select(
        "block", "place", "ghost", "key", n.cast("long").alias("n_chars"),
        F.unhex(F.sha2("text", 256)).alias("own"), F.unhex(F.sha2("edited", 256)).alias("other"),
        F.concat(tag(terms(F.col("text")), 0), tag(terms(F.col("edited")), 1), marked).alias("all"))
    # Digests are made before the terms are exploded: once for a document, and without its text in each row.
    one = one.select("*", F.explode("all").alias("t")).select(
        "block", "place", "ghost", "key", "n_chars", "own", "other", "t.term", "t.kind")
    kept = one.join(F.broadcast(words) if size <= BROADCAST_TERMS else words, "term")
    member = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("term")))
    whole = kept.groupBy("block", "place").agg(
        *[F.first(c).alias(c) for c in ("ghost", "key", "n_chars", "own", "other")],
        F.sort_array(member(0)).alias("mine"), F.sort_array(member(1)).alias("theirs"))
    signed = whole.select("block", "place", "ghost", "key", "n_chars", "own", "other",
                          signatures(F.col("mine")).alias("a"), signatures(F.col("theirs")).alias("b"))
    order = W.partitionBy("block").orderBy("place")
    signed = signed.withColumns({"c": F.lead("a").over(order), "following": F.lead("own").over(order)})
    print_of = lambda s, digest: F.when(
        F.exists(s, lambda x: x.isNotNull()),
        F.array_join(F.transform(s, lambda x: F.when(x.isNull(), "-").otherwise(F.lower(F.hex(x)))), ".")
    ).otherwise(F.concat(F.lit("="), F.lower(F.hex(digest))))
    near = lambda s, digest: F.coalesce(
        likeness(F.col("a"), s), (F.col("own") == digest).cast("double"))
    return signed.where("ghost = 0").select(
        F.col("key").alias(key), "n_chars", F.lower(F.hex("other")).alias("edited_sha256"),
        print_of(F.col("a"), F.col("own")).alias("fingerprint"),
        print_of(F.col("b"), F.col("other")).alias("edited_fingerprint"),
        near(F.col("b"), F.col("other")).alias("near_edited"), near(F.col("c"), F.col("following")).alias("near_next"))
