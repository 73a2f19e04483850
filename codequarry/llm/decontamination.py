"""Benchmark decontamination with a distributed positional inverted index.

The index stores the postings (term, document, position) of the training texts, one row each, for
every term that the benchmark has; other terms can be in no answer. A test phrase is a window of
consecutive item words. Its rarest term, by the index's own counts, gives the first candidates:
each posting minus the term's offset is a place where the phrase could begin. The list of the
next rarest term, moved by its offset, is intersected with them, and the next one; then the lists
of all remaining terms at once, for the few places left. What has every term in place is an exact
phrase match. ``proximity`` asks for all terms within a span of words instead of in line.

All steps are DataFrame operations. Document and benchmark texts are split as whole texts; null
and empty texts have no words. An item of fewer words than a window, but not none, is one window.
Item ids may repeat: rows of the same id add their windows to it. Documents are numbered by writing
them, and postings and hits go by that number: rows whose id repeats, or is null, are judged each for
itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.llm.common import broadcast_if_small
from codequarry.sources.storage import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    """The words of a text in order; none for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def test_windows(items: DataFrame, size: int = 13) -> DataFrame:
    """window_id, terms, items: the distinct windows with the ids of the items that have them."""
    parts = items.select(F.col("item_id"), words("text").alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    each = parts.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("terms"))
    grouped = each.groupBy("terms").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return written(grouped.select(F.monotonically_increasing_id().alias("window_id"), "terms", "items"), "windows")


def vocabulary(windows: DataFrame) -> DataFrame:
    """term, term_id: the distinct words of all windows, numbered for good by writing them."""
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    return written(terms.withColumn("term_id", F.monotonically_increasing_id()), "terms")


def window_terms(windows: DataFrame, terms: DataFrame) -> DataFrame:
    """window_id, length, offset, term_id: one row per word of each window."""
    each = windows.select("window_id", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
    return each.join(broadcast_if_small(terms), "term").drop("term")


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, text: the documents with a number for each row, fixed by writing them."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return written(rows, "numbered")


def build_index(docs: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, pos, term_id: postings of the terms given (term, term_id), written to the shared folder.

    ``key`` tells documents apart and becomes the index's doc_id.
    """
    placed = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.posexplode(words("text")).alias("pos", "term"))
    return written(placed.join(broadcast_if_small(terms), "term").select("doc_id", "pos", "term_id"), "postings")


def _ranked(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """window_id, offset, term_id, length, and the term's place by rarity within its window."""
    counts = index.groupBy("term_id").count()
    order = W.partitionBy("window_id").orderBy(F.coalesce("count", F.lit(0)), "term_id", "offset")
    return wanted.join(counts, "term_id", "left").withColumn("nth", F.row_number().over(order))


def _in_place(places: DataFrame, ranked: DataFrame, index: DataFrame, terms: Column, least: Column) -> DataFrame:
    """The places where the chosen terms of the window all stand at their offsets."""
    chosen = broadcast_if_small(ranked.filter(terms).select("window_id", "offset", "term_id"))
    asked = places.join(chosen, "window_id").withColumn("pos", F.col("start") + F.col("offset"))
    found = asked.join(index, ["doc_id", "pos", "term_id"])
    hits = found.groupBy("doc_id", "start", "window_id", "length").agg(F.countDistinct("offset").alias("n"))
    return hits.filter(F.col("n") >= least).drop("n")


def phrase_matches(index: DataFrame, wanted: DataFrame, rarest: int = 3) -> DataFrame:
    """doc_id, start, window_id, length of every exact occurrence.

    ``index`` is a written one with distinct (doc_id, pos, term_id); ``wanted`` has window_id,
    offset, term_id, length.
    """
    ranked = written(_ranked(index, wanted), "ranked")
    first = broadcast_if_small(ranked.filter("nth = 1").select("window_id", "offset", "term_id", "length"))
    places = index.join(first, "term_id").select(
        "doc_id", (F.col("pos") - F.col("offset")).alias("start"), "window_id", "length"
    ).filter("start >= 0")
    # the lists of the next rarest terms are short; the long ones are read for the places left
    early = ranked.filter(F.col("nth").between(2, rarest)).select("term_id").distinct()
    short = index.join(broadcast_if_small(early), "term_id", "left_semi")
    for nth in range(2, rarest + 1):
        alone = places.filter(F.col("length") < nth)
        more = places.filter(F.col("length") >= nth)
        places = alone.unionByName(_in_place(more, ranked, short, F.col("nth") == nth, F.lit(1)))
    places = written(places, "places")
    complete = places.filter(F.col("length") <= rarest)
    rest = _in_place(places.filter(F.col("length") > rarest), ranked, index, F.col("nth") > rarest, F.col("length") - rarest)
    return complete.unionByName(rest)


def proximity_matches(index: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """doc_id, window_id where all distinct terms of a window stand within ``span`` words.

    Begins at the postings of the rarest term and keeps what has the other terms near, one list
    after the other; then the narrowest stretch around each of them is measured.
    """
    terms = wanted.select("window_id", "term_id").distinct()
    counts = index.groupBy("term_id").count()
    order = W.partitionBy("window_id").orderBy(F.coalesce("count", F.lit(0)), "term_id")
    ranked = written(terms.join(counts, "term_id", "left").withColumn("nth", F.row_number().over(order)), "ranked")
    first = ranked.filter("nth = 1").select("window_id", "term_id")
    anchors = index.join(broadcast_if_small(first), "term_id").select("doc_id", "window_id", F.col("pos").alias("anchor"))
    asked = anchors.join(broadcast_if_small(ranked.select("window_id", "term_id")), "window_id")
    near = asked.join(index, ["doc_id", "term_id"]).filter(F.abs(F.col("pos") - F.col("anchor")) < span)
    # the stretches of ``span`` words, by first word, that hold both the anchor and the posting
    low = F.greatest(F.lit(0), F.greatest("anchor", "pos") - span + 1)
    stretches = near.select("doc_id", "window_id", "term_id", F.explode(F.sequence(low, F.least("anchor", "pos"))).alias("start"))
    found = stretches.groupBy("doc_id", "window_id", "start").agg(F.countDistinct("term_id").alias("n"))
    needed = ranked.groupBy("window_id").agg(F.count("*").alias("needed"))
    return found.join(broadcast_if_small(needed), "window_id").filter("n = needed").select("doc_id", "window_id").distinct()


def hit_words(matches: DataFrame) -> DataFrame:
    """doc_id, n_hit: words inside any match, overlaps counted once."""
    ends = matches.select("doc_id", "start", (F.col("start") + F.col("length")).alias("end")).groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    before = W.partitionBy("doc_id").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    return ends.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - fresh)).groupBy("doc_id").agg(F.sum("fresh").cast("bigint").alias("n_hit"))


def matches(docs: DataFrame, items: DataFrame, size: int = 13, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The exact occurrences of all test windows, documents by their ``key``, and the windows."""
    windows = test_windows(items, size)
    terms = vocabulary(windows)
    return phrase_matches(build_index(docs, terms, key), window_terms(windows, terms)), windows


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a ``share``-th of the words is hit)."""
    docs = numbered(docs)
    found, windows = matches(docs, items, size, "row")
    found = written(found, "matches")
    pairs = found.select("doc_id", "window_id").distinct().join(broadcast_if_small(windows.select("window_id", F.explode("items").alias("item"))), "window_id")
    names = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sizes = docs.select("row", "doc_id", F.size(words("text")).cast("bigint").alias("n_words"))
    rows = sizes.join(hit_words(found).join(names, "doc_id").withColumnRenamed("doc_id", "row"), "row", "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0).cast("bigint")), F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
