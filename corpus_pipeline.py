"""From raw documents to pieces: five stages, each written and read again.

quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece
encoding. Every stage works on all that the one before it kept; the first four return the columns
of ``documents``. Each is made to survive the loss of executors: what is used twice is written to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import decontamination, jaccard, line_dedup, pieces, quality
from codequarry.llm.common import free_name, table
from codequarry.sources.storage import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.keep_good(docs, quality.fit_texts(docs, table(spark, sf_dir, "labels")))


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that stand on many sites out of all documents but the first, and drops the
    documents that had nothing else. ``n_chars`` follows the text where there is such a column."""
    own = {c: free_name(docs, f"{c}_own") for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    kept = line_dedup.without_emptied(line_dedup.dedup_lines(docs.withColumnsRenamed(own)))
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", size)
    return kept.drop("n_lines", "n_removed").withColumnsRenamed({new: c for c, new in own.items()}).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five words, similarity 0.8 or more."""
    return jaccard.keep_first(docs, written(jaccard.similar_groups(docs, percent=80, size=5), "groups"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages. Rows without an id stay; rows of one id go together."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    name = free_name(docs, "held")
    held = found.filter("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(held, F.col("doc_id").cast("bigint") == F.col(name), "left_anti")


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces, score, others: the best segmentation of each text, and the second best."""
    return pieces.encode(docs, n=2)


STAGES = [
    ("quality classifier", good_documents), ("line dedup", own_lines), ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", uncontaminated), ("SentencePiece encoding", as_pieces),
]

#: Scores of a fitted classifier and segmentations are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
