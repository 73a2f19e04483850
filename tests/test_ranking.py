import numpy as np
import pytest

from codequarry.operators import ranking, tfidf

STOP = ["the", "is", "of", "and", "in"]
TEXT = (
    "Robots move boxes in factories. Robots move heavy boxes. Cats sleep. Factories need robots and boxes. "
    "Robots move boxes in factories. The. Heavy boxes need strong robots."
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT), (2, "Only one sentence here."), (3, "The. Of. Is."), (4, "  "), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def dense_ranks(spark, text, damping=0.85, steps=20):
    """The same ranks from the whole matrix of cosines."""
    rows = tfidf.sentence_weights(spark.createDataFrame([(1, text)], "doc_id long, text string"), STOP).collect()
    n, terms = 1 + max(r.sent_id for r in rows), sorted({r.term for r in rows if r.term})
    w = np.zeros((n, len(terms)))
    for r in rows:
        if r.term:
            w[r.sent_id, terms.index(r.term)] = r.w
    links = w @ w.T
    np.fill_diagonal(links, 0)
    degree = links.sum(axis=1)
    alone = degree < 1e-9
    p = np.full(n, 1 / n)
    for _ in range(steps):
        p = (1 - damping) / n + damping * (links @ np.where(alone, 0, p / np.where(alone, 1, degree)) + p[alone].sum() / n)
    return p * n, w @ w.T


def test_ranks_equal_those_of_the_whole_matrix(spark, docs):
    ranks, cosine = dense_ranks(spark, TEXT)
    order = sorted(range(len(ranks)), key=lambda i: (-round(ranks[i], 9), i))
    best = [i for nth, i in enumerate(order) if all(cosine[i, j] < 0.5 for j in order[:nth])]
    sentences = TEXT.replace(". ", ".|").split("|")
    got = {r.doc_id: r.summary for r in ranking.graph_summary(docs, STOP).collect()}
    assert got[1] == " ".join(sentences[i] for i in sorted(best))
    assert got[1].count("Robots move boxes in factories.") <= 1
    short = ranking.graph_summary(docs, STOP, min_words=1, max_words=3).filter("doc_id = 1").first().summary
    assert short == sentences[order[0]]


def test_small_and_empty_texts(spark, docs):
    got = {r.doc_id: r.summary for r in ranking.graph_summary(docs, STOP).collect()}
    assert got[2] == "Only one sentence here." and got[3] == "The. Of. Is." and not {4, 5} & set(got)
    assert ranking.graph_summary(docs.limit(0), STOP).count() == 0


def test_long_text_stays_within_its_words(spark):
    text = " ".join(f"Word{i % 97} meets word{i % 89} and thing{i % 83} today." for i in range(4000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    words = len(ranking.graph_summary(docs, STOP).first().summary.split())
    assert 30 <= words <= 130
