"""The registered queries of this package: whole tables in, the contracted columns out."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.llm import conversations, decontamination, html, jaccard, langid, line_dedup, pieces, pii, quality, simhash, topk, whitening
from codequarry.llm import token_counts as tokens
from codequarry.llm.common import table
from codequarry.sources.storage import written


def op1_quality_classifier(spark, folder):
    described = written(quality.features(table(spark, folder, "documents")), "features")
    return quality.score(described, quality.fit(described, table(spark, folder, "labels")))


def op2_decontamination(spark, folder):
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_token_counts(spark, folder):
    return tokens.token_counts(table(spark, folder, "documents"), limit=1024)


def op4_html_extraction(spark, folder):
    return html.main_texts(table(spark, folder, "pages"))


def op5_sentencepiece(spark, folder):
    return pieces.segmentation_digest(table(spark, folder, "documents"), n=2)


def op6_line_dedup(spark, folder):
    cleaned = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return cleaned.select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5")
    )


def op7_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    return langid.identify(docs, langid.learn(docs))


def op8_exact_topk(spark, folder):
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), topk.quantised("embedding", 1024).alias("vector")
    ).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op9_jaccard_join(spark, folder):
    return jaccard.similar_groups(table(spark, folder, "documents"), percent=90, size=3)


def op10_pii(spark, folder):
    docs = table(spark, folder, "documents")
    return pii.span_digest(docs, pii.find_spans(docs))


def op11_conversation_repair(spark, folder):
    talks = table(spark, folder, "conversations")
    return conversations.repair(conversations.damaged(talks), talks)


def op12_simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"), distance=3, size=3)


def op13_embedding_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"), k=4, scale=256)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_html_extraction": op4_html_extraction,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_exact_topk": op8_exact_topk,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_pii": op10_pii,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}
