"""Summaries by the rank of sentences in the similarity graph of their text."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators.tfidf import sentence_weights, sentences_by_document


def _ranked(s: np.ndarray, t: np.ndarray, w: np.ndarray, n: int, damping: float, steps: int) -> np.ndarray:
    """Rank times number of sentences, to nine places. The graph is never built: a step is two
    products with the sparse matrix of weights, less the link of a sentence with itself."""
    terms = int(t.max()) + 1 if len(t) else 0

    def linked(x: np.ndarray) -> np.ndarray:
        by_term = np.bincount(t, weights=w * x[s], minlength=terms)
        return np.bincount(s, weights=w * by_term[t], minlength=n) if len(t) else np.zeros(n)

    used = np.bincount(s, minlength=n) > 0
    degree = np.where(used, np.round(linked(np.ones(n)) - 1, 9), 0)
    alone = degree <= 0
    degree[alone] = 1
    p = np.full(n, 1 / n)
    for _ in range(steps):
        x = np.where(alone, 0, p / degree)
        p = (1 - damping) / n + damping * (linked(x) - x + p[alone].sum() / n)
    return np.round(p * n, 9)


def _chosen(sent, n_words, term, w, damping, steps, same, least, most) -> list[int]:
    ids, at = np.unique(sent, return_inverse=True)
    words = np.zeros(len(ids), dtype=np.int64)
    words[at] = n_words
    real = np.array([x is not None for x in term], dtype=bool)
    s, weight = at[real], w[real]
    names, t = np.unique(np.asarray(term, dtype=object)[real].astype(str), return_inverse=True)
    rank = _ranked(s, t, weight, len(ids), damping, steps)
    order = np.lexsort((ids, -rank))
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    rows = np.argsort(s, kind="stable")
    begin = np.searchsorted(s[rows], np.arange(len(ids) + 1))
    chosen, total = [], 0
    for i in order:
        own = rows[begin[i]:begin[i + 1]]
        if len(own):
            vector = np.zeros(len(names))
            vector[t[own]] = weight[own]
            near = np.round(np.bincount(s, weights=weight * vector[t], minlength=len(ids)), 9) >= same
            if (place[near] < place[i]).any():
                continue
        if total >= least and total + words[i] > most:
            break
        total += words[i]
        chosen.append(int(ids[i]))
    return sorted(chosen)


def graph_summary(
    docs: DataFrame,
    stop_words: Sequence[str] | None = None,
    min_words: int = 30,
    max_words: int = 130,
    same: float = 0.5,
    damping: float = 0.85,
    steps: int = 20,
    weights: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, summary``: the sentences of the highest rank that repeat no better one, in text order.

    Sentences of a text are linked by their cosine; ``steps`` power iterations rank them, and those
    without a link share theirs with all. A sentence is left out if its cosine with one of a higher
    rank (the earlier of equals) is at least ``same``, be that one left out or not. The rest is
    taken by rank while it fits ``max_words``, and until ``min_words`` even where it overruns them.
    A text is one input row; memory and time of a step grow with its words, not with pairs of
    sentences. ``weights`` are the ``sentence_weights`` of ``docs`` where they are at hand already.
    """

    @F.pandas_udf("array<int>")
    def choose(sent: pd.Series, n_words: pd.Series, term: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([
            _chosen(a, b, c, d.astype(float), damping, steps, same, min_words, max_words)
            for a, b, c, d in zip(sent, n_words, term, w)
        ])

    cells = F.collect_list(F.struct("sent_id", "n_words", "term", "w")).alias("c")
    chosen = (
        (sentence_weights(docs, stop_words) if weights is None else weights)
        .groupBy("doc_id").agg(cells)
        .select("doc_id", choose("c.sent_id", "c.n_words", "c.term", "c.w").alias("chosen"))
    )
    return chosen.join(sentences_by_document(docs), "doc_id").select(
        "doc_id", F.array_join(F.transform("chosen", lambda i: F.get("all", i)), " ").alias("summary")
    )
