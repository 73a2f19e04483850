"""Sentences, words and TF-IDF weights, within each document or over a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.functions.constants import english_stop_words
from codequarry.functions.text import count_words, sentence_array, word_array
from codequarry.plans.placement import place
from codequarry.plans.skew import HOT_ROWS, salted_join


def sentences_by_document(docs: DataFrame) -> DataFrame:
    """``doc_id, all``: the sentences of each text as one list, placed by document."""
    placed = place(docs.select("doc_id", "text"), "doc_id")
    return placed.select("doc_id", sentence_array(F.col("text")).alias("all"))


def _exploded(listed: DataFrame) -> DataFrame:
    # The outer form, because the plain one makes Spark split every text a second time to
    # filter out the empty ones first.
    return listed.select(
        "doc_id", F.size("all").alias("n_sent"), F.posexplode_outer("all").alias("sent_id", "sentence")
    ).filter(F.col("sentence").isNotNull())


def split_sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, n_sent, sent_id, sentence``; no shuffle."""
    return _exploded(docs.select("doc_id", sentence_array(F.col("text")).alias("all")))


def tokenize(sentences: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``doc_id, n_sent, sent_id, term`` with repeats; no shuffle."""
    stop = english_stop_words() if stop_words is None else stop_words
    return sentences.select(
        "doc_id", "n_sent", "sent_id", F.explode(word_array(F.col("sentence"), stop)).alias("term")
    )


def _smooth_idf(total, containing):
    return F.log((1 + total) / (1 + containing)) + 1


def sentence_weights(docs: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``doc_id, sent_id, n_words, term, w`` for every sentence of every document.

    The text is placed by ``doc_id`` once, before it is split; counting, document
    frequency and norm all run on that placement. A sentence without a usable word keeps
    one row with null ``term`` and ``w``.
    """
    stop = english_stop_words() if stop_words is None else stop_words
    counted = (
        _exploded(sentences_by_document(docs))
        .withColumn("n_words", count_words(F.col("sentence")))
        .withColumn("words", word_array(F.col("sentence"), stop))
        .select("doc_id", "n_sent", "sent_id", "n_words", F.explode_outer("words").alias("term"))
        .groupBy("doc_id", "sent_id", "n_sent", "n_words", "term")
        .agg(F.count("*").alias("tf"))
    )
    per_term = W.partitionBy("doc_id", "term")
    per_sentence = W.partitionBy("doc_id", "sent_id")
    raw = F.when(
        F.col("term").isNotNull(), F.col("tf") * _smooth_idf(F.col("n_sent"), F.count("*").over(per_term))
    )
    return (
        counted.withColumn("raw", raw)
        .withColumn("norm", F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(per_sentence)))
        .select("doc_id", "sent_id", "n_words", "term", (F.col("raw") / F.col("norm")).alias("w"))
    )


def tfidf(docs: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``doc_id, sent_id, term, w``: every document its own collection of sentences."""
    return (
        sentence_weights(docs, stop_words).filter(F.col("term").isNotNull())
        .select("doc_id", "sent_id", "term", "w")
    )


def term_counts(texts: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``id, term, tf`` for whole texts, placed by ``id``."""
    stop = english_stop_words() if stop_words is None else stop_words
    return (
        place(texts.select("id", "text"), "id")
        .select("id", F.explode(word_array(F.col("text"), stop)).alias("term"))
        .groupBy("id", "term")
        .agg(F.count("*").alias("tf"))
    )


def inverse_frequency(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """``term, df, idf`` over a table of texts."""
    total = texts.agg(F.count("*").alias("n")).scalar()
    return (
        counts.groupBy("term")
        .agg(F.count("*").alias("df"))
        .select("term", "df", _smooth_idf(total, F.col("df")).alias("idf"))
    )


#: Words of an idf table up to which it is broadcast (their lengths checked too); a larger one is joined by a shuffle.
WORDS, WORD_BYTES = 500_000, 32 << 20


def unit_weights(
    counts: DataFrame, idf: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``id, term, w`` with unit length per id; words without an idf are left out.

    A table of words within the bounds goes to the counts, which stay placed by ``id`` as
    ``term_counts`` placed them; the norms need no shuffle then. Beyond them both sides are
    shuffled by word, a word found in a large share of the texts is spread over many tasks, and
    a second placement by ``id`` gives the norms.
    """
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("id")))
    raw = (F.col("tf") * F.col("idf")).alias("raw")
    size = idf.limit(WORDS + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("bytes")).head()
    if size.n <= WORDS and (size.bytes or 0) <= WORD_BYTES:
        weighed = counts.join(F.broadcast(idf.select("term", "idf")), "term").select("id", "term", raw)
    else:
        hot = idf.filter(F.col("df") >= hot_rows).select("term")
        weighed = place(salted_join(counts, idf.select("term", "idf"), "term", ["id"], hot).select("id", "term", raw), "id")
    return weighed.withColumn("norm", norm).select("id", "term", (F.col("raw") / F.col("norm")).alias("w"))
