import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.operators import rendering, tfidf, topics

STOP = ["the", "is", "of", "and", "in"]
AI = (
    "\nMachines learn patterns from data. Learning machines improve with more data and better data.\n"
    "Search engines rank pages. Ranking pages needs signals from links and text.\n"
    "Robots move in factories! Do robots need maps? Maps of factories help robots move.\n"
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, AI), (2, "Only one sentence here."), (3, "Same words again. Same words again. Other thing entirely."),
        (4, "The. Of. Is."), (5, "   "), (6, "Alpha beta. The. Gamma delta."),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_sentences(docs):
    got = {}
    for r in tfidf.split_sentences(docs).orderBy("doc_id", "sent_id").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    assert len(got[1]) == 7 and got[1][0] == "Machines learn patterns from data."
    assert got[4] == ["The.", "Of.", "Is."] and 5 not in got


def test_words_are_unicode(spark):
    row = spark.createDataFrame([("Élan vital_1 a 漢字 x",)], "t string").select(T.word_array(F.col("t"))).first()
    assert row[0] == ["élan", "vital_1", "漢字"]


def test_weights_have_unit_length(docs):
    norms = tfidf.tfidf(docs, STOP).groupBy("doc_id", "sent_id").agg(F.sum(F.col("w") * F.col("w")).alias("n"))
    rows = norms.collect()
    assert rows and all(abs(r.n - 1) < 1e-12 for r in rows)
    assert not {4, 5} & {r.doc_id for r in rows}


def clustered(docs, k):
    return topics.cluster_documents(tfidf.tfidf(docs, STOP), k)


def test_clusters(docs):
    c = clustered(docs, 3)
    medoids = topics.cluster_medoid(c).collect()
    per_doc = {d: sorted(m.cluster for m in medoids if m.doc_id == d) for d in {m.doc_id for m in medoids}}
    assert per_doc == {1: [0, 1, 2], 2: [0], 3: [0, 1, 2], 6: [0, 1]}
    assert {(m.sent_id) for m in medoids if m.doc_id == 6} == {0, 2}
    members = topics.kmeans_topics(c).collect()
    assert sorted(m.sent_id for m in members if m.doc_id == 1) == list(range(7))
    assert all(0 <= m.cluster < 3 for m in members)


def test_result_does_not_depend_on_partitions(spark, docs):
    read = lambda: sorted(tuple(r) for r in topics.key_sentences(clustered(docs, 3)).collect())
    before = read()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert read() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_key_sentence_is_the_first_of_equals(docs):
    rows = [r for r in topics.key_sentences(clustered(docs, 3)).collect() if r.doc_id == 3]
    assert {(r.medoid, r.sent_id) for r in rows} <= {(0, 0), (1, 0), (2, 2)}


def test_summary(spark, docs):
    got = {r.doc_id: r.summary for r in topics.extractive_summary(docs, STOP).collect()}
    assert got[2] == "Only one sentence here." and got[4] == "The. Of. Is." and 5 not in got
    long = spark.createDataFrame([(1, " ".join(f"word{i} again here." * 1 + " filler" * 18 + "." for i in range(20)))], "doc_id long, text string")
    words = len(topics.extractive_summary(long, STOP).first().summary.split())
    assert 30 <= words <= 130
    huge = spark.createDataFrame([(1, "big " * 400 + ".")], "doc_id long, text string")
    assert len(topics.extractive_summary(huge, STOP).first().summary.split()) == 401


def test_diagrams(spark):
    points = spark.createDataFrame([(1, 1, "a <b>"), (1, 2, "c & d"), (1, 3, "e\n f")], "doc_id long, nth int, point string")
    summary = spark.createDataFrame([(1, "all > that")], "doc_id long, summary string")
    found = points.select("doc_id", "nth", F.col("point").alias("topic"), F.upper("point").alias("key_sentence")).filter("nth < 3")
    assert rendering.mindmap(found, summary, "Root").first().diagram.splitlines() == [
        "```mermaid", "mindmap", "  root((Root))", "    Summary[all &gt; that]",
        "    Topic 1[a &lt;b&gt;]", "      Key Point[A &lt;B&gt;]", "    Topic 2[c &amp; d]", "      Key Point[C &amp; D]", "```",
    ]
    assert rendering.flowchart(points, summary).first().diagram.splitlines() == [
        "```mermaid", "flowchart TD", "    A[all &gt; that]", "    A --> B1[a &lt;b&gt;]",
        "    A --> B2[c &amp; d]", "    A --> B3[e f]", "```",
    ]
    assert rendering.sequence_diagram(points).first().diagram.splitlines() == [
        "```mermaid", "sequenceDiagram", "    participant Human", "    participant AI",
        "    Human->>AI: Step 1", "    AI->>Human: c &amp; d", "    Human->>AI: Step 3", "```",
    ]


def test_corpus_topics(docs):
    found = [sorted(map(tuple, topics.corpus_topics(docs.repartition(n), 2, STOP).collect())) for n in (1, 8)]
    assert found[0] == found[1]
    assert {c for _, _, c in found[0]} == {0, 1} and {d for d, _, _ in found[0]} == {1, 2, 3, 6}
    assert topics.corpus_topics(docs.limit(0), 2, STOP).count() == 0


def test_products_of_common_and_of_rare_words_are_the_same(docs, monkeypatch):
    """Every product shuffled all cells before; now only those of words beyond ``COMMON``."""
    found = []
    for common in (1000, 2, 0):
        monkeypatch.setattr(topics, "COMMON", common)
        cells = topics.Cells(topics.corpus_cells(docs, STOP))
        assert cells.all_common == (common == 1000)
        centres = cells.table.groupBy("term", "df").agg(F.max("w").alias("a"), F.min("w").alias("b"))
        found.append(sorted((r.doc_id, r.sent_id, round(r.a, 9), round(r.b, 9)) for r in cells.dots(centres, ["a", "b"]).collect()))
        cells.close()
        assert not cells.table.is_cached
    assert found[0] == found[1] == found[2] and len(found[0]) > 3
