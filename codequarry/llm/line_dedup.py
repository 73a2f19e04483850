"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. Per line hash a HyperLogLog sketch of the sites
is built in each task and merged by aggregation. Lines whose estimate lies clearly on one side of
the threshold are decided by it; lines near the threshold get an exact count of distinct sites.
Of a boilerplate line the first holder (smallest id, then position) keeps its first occurrence;
all others lose it, so no wording leaves the corpus altogether.

Lines are compared without the spaces around them. Lines of fewer than ``min_words`` words are
never boilerplate; lines of more than ``long_words``, where that is given, are on ``long_sites`` sites. A null site counts as a site of its own. Null texts stay null, empty ones
empty. Repeated rows of an id are one holder with the same lines; rows without an id keep all lines. A text that loses all its lines
is empty; ``without_emptied`` drops such rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import broadcast_if_small
from codequarry.sources.storage import written

KEY = ["hash_a", "hash_b"]


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def lines(docs: DataFrame, min_words: int, min_sites: int = 3, long_words: int | None = None, long_sites: int = 2) -> DataFrame:
    """doc_id, site, pos, the 128-bit hash of every line with enough words, and the sites that make it boilerplate."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("site"),
        F.posexplode(_split(F.col("text"))).alias("pos", "line"),
    ).withColumn("line", F.trim("line"))
    enough = F.col("line").rlike(r"^\S+" + r"(\s+\S+)" * (min_words - 1)) if min_words else F.lit(True)
    least = F.lit(min_sites)
    if long_words is not None:
        least = F.when(F.col("line").rlike(r"^\S++(?:\s++\S++){%d}" % long_words), F.lit(long_sites)).otherwise(least)
    return rows.filter(enough).select(
        "doc_id", "site", "pos", least.alias("least"), F.xxhash64("line").alias("hash_a"), F.xxhash64("line", F.lit("second")).alias("hash_b")
    )


def spread(found: DataFrame, log2_registers: int = 12) -> DataFrame:
    """Per line hash: estimated number of sites, and its first holder."""
    return found.groupBy(*KEY).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log2_registers))).alias("sites"),
        F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"),
        F.first("least").alias("least"),
    )


def boilerplate(
    docs: DataFrame, min_sites: int = 3, min_words: int = 3, log2_registers: int = 12, long_words: int | None = None, long_sites: int = 2
) -> DataFrame:
    """Hash and first holder of every line on ``min_sites`` sites or more; ``long_sites`` for lines over ``long_words`` words."""
    found, least = lines(docs, min_words, min_sites, long_words, long_sites), F.col("least")
    # a sketch of 2^12 registers is off by 1.6 % as a rule; four times that and one site more is near
    margin = 1 + least * (4 * 1.04 / (1 << log2_registers) ** 0.5)
    likely = written(spread(found, log2_registers).filter((F.col("n") >= least) & (F.col("sites") >= least - margin)), "spread")
    near = likely.filter(F.col("sites") <= least + margin).select(*KEY)
    exact = (
        found.select(*KEY, "least", "site").join(broadcast_if_small(near), KEY, "left_semi")
        .distinct().groupBy(*KEY, "least").count().filter(F.col("count") >= least).select(*KEY)
    )
    sure = likely.filter(F.col("sites") > least + margin)
    return sure.unionByName(likely.join(exact, KEY, "left_semi")).select(*KEY, "first")


def removed_lines(docs: DataFrame, min_sites: int = 3, min_words: int = 3, long_words: int | None = None, long_sites: int = 2) -> DataFrame:
    """doc_id, removed: the places of the lines that a document loses."""
    marked = written(boilerplate(docs, min_sites, min_words, long_words=long_words, long_sites=long_sites), "boilerplate")
    later = F.struct("doc_id", "pos") != F.col("first")
    return (
        lines(docs, min_words).join(broadcast_if_small(marked), KEY).filter(later)
        .groupBy("doc_id").agg(F.collect_set("pos").alias("removed"))
    )


def dedup_lines(docs: DataFrame, min_sites: int = 3, min_words: int = 3, long_words: int | None = None, long_sites: int = 2) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, and n_lines, n_removed beside them."""
    places = removed_lines(docs, min_sites, min_words, long_words, long_sites).select(F.col("doc_id").alias("_holder"), "removed")
    rows = docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c not in ("doc_id", "source", "text")})
    kept = F.filter(_split(F.col("text")), lambda _, i: ~F.array_contains("removed", i))
    cleaned = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    own = [F.col(c) if c in ("doc_id", "source") else cleaned.alias("text") if c == "text" else F.col(f"_own_{c}").alias(c) for c in docs.columns]
    joined = rows.join(places, F.col("doc_id").cast("bigint") == F.col("_holder"), "left")
    return joined.select(
        *[o for o, c in zip(own, docs.columns) if c not in ("n_lines", "n_removed")],
        F.coalesce(F.size(_split(F.col("text"))), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def without_emptied(cleaned: DataFrame) -> DataFrame:
    """Drop the rows whose every word went with the removed lines."""
    return cleaned.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
