import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.functions import vectors as V
from codequarry.operators import embedding, generation, rendering, search
from codequarry.streaming.search import stream_search


def vectors(spark, data, name="id"):
    rows = [(i, [float(x) for x in v]) for i, v in data]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def brute(queries, data, k, metric):
    out = []
    for qi, q in queries:
        scored = []
        for i, v in data:
            q32, v32 = np.float32(q).astype(float), np.float32(v).astype(float)
            if metric == "l2":
                scored.append((round(float(((q32 - v32) ** 2).sum()), 9), i))
            elif np.linalg.norm(q32) * np.linalg.norm(v32) > 0:
                scored.append((round(-float(q32 @ v32 / np.linalg.norm(q32) / np.linalg.norm(v32)), 9), i))
        out += [(qi, r, i, round(abs(s), 6)) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.id, round(abs(r.score), 6)) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("blocks", [(4096, 200_000), (5, 40)])
def test_topk_equals_brute_force(spark, metric, blocks):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=8)) for i in range(150)] + [(i, np.ones(8)) for i in range(150, 220)]
    data.append((220, np.zeros(8)))
    queries = [(i, rng.normal(size=8)) for i in range(20)] + [(20, np.ones(8))]
    found = search.topk(
        vectors(spark, queries, "query_id"), vectors(spark, data).repartition(6), 5, metric, *blocks
    )
    assert got(found) == brute(queries, data, 5, metric)


def test_fewer_vectors_than_k_and_text_ids(spark):
    q = vectors(spark, [(1, [1, 0])], "query_id")
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None)], "id string, embedding array<double>")
    hits = search.topk(q, v, 5).orderBy("rank").collect()
    assert [(r.id, r.score) for r in hits] == [("a", 0.0), ("b", 0.0)]
    assert search.topk(q, v.limit(0), 5).count() == 0


def test_distance_profile(spark):
    q = vectors(spark, [(1, [0, 0]), (2, [3, 4])], "query_id")
    v = vectors(spark, [(1, [3, 4]), (2, [0, 0]), (3, [0, 5])])
    found = search.distance_profile(q, v).collect()
    rows = {r.query_id: (r.n, r.nearest, round(r["mean"], 6)) for r in found}
    assert rows == {1: (3, 0.0, round(50 / 3, 6)), 2: (3, 0.0, round(35 / 3, 6))}


@pytest.mark.parametrize("blocks", [(4096, None), (2, 3)])
def test_small_differences_of_long_vectors(spark, blocks):
    q = spark.createDataFrame([(1, [1e6, 0.0, 0.0]), (2, [1e3, 1e5, 0.0]), (3, [0.1, 0.2, 0.3])], "query_id long, embedding array<double>")
    data = [(1, [1e6, 0.01, 0.0]), (2, [1e6, 0.005, 0.0]), (3, [1e6, 0.0, 0.001]), (4, [1e3, 1e5, 0.002]), (5, [1e3, 1e5, 0.001]), (6, [0.1, 0.2, 0.3])]
    v = spark.createDataFrame(data, "id long, embedding array<double>")
    hits = {(r.query_id, r["rank"]): r.id for r in search.topk(q, v, 3, "l2", *blocks).collect()}
    assert [hits[1, n] for n in (1, 2, 3)] == [3, 2, 1] and [hits[2, n] for n in (1, 2)] == [5, 4] and hits[3, 1] == 6
    exact = v.join(q.withColumnRenamed("embedding", "e")).groupBy("query_id").agg(F.min(V.l2_distance(F.col("e"), F.col("embedding"))).alias("d"))
    near = {r.query_id: r.nearest for r in search.distance_profile(q, v).collect()}
    assert near == pytest.approx({r.query_id: r.d for r in exact.collect()}, abs=1e-12)


def test_vector_expressions(spark):
    row = spark.sql("select array(1d, 2d) a, array(3d, 4d) b, array(0d, 0d) z")
    out = row.select(V.l2_distance(F.col("a"), F.col("b")), V.cosine_similarity(F.col("a"), F.col("b")), V.cosine_similarity(F.col("a"), F.col("z"))).first()
    assert out[0] == 8 and abs(out[1] - 11 / math.sqrt(125)) < 1e-12 and out[2] is None


def text_brute(queries, texts, k):
    words = lambda t: Counter(w for w in t.lower().split() if len(w) > 1)
    tf = {i: words(t) for i, t in texts}
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(c):
        raw = {w: n * idf[w] for w, n in c.items() if w in idf}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / size for w, x in raw.items()}

    docs = {i: unit(c) for i, c in tf.items()}
    out = []
    for qi, t in queries:
        q = unit(words(t))
        scored = [(-round(sum(x * q[w] for w, x in d.items() if w in q), 9), i) for i, d in docs.items() if set(d) & set(q)]
        out += [(qi, r, i, round(-s, 6)) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def text_tables(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(40)]
    phrase = lambda n: " ".join(rng.choice(vocabulary, n)) + " hot"
    texts = [(i, phrase(int(rng.integers(3, 30)))) for i in range(80)] + [(80 + i, "same words here hot") for i in range(20)]
    queries = [(i, phrase(6)) for i in range(12)] + [(12, "same words"), (13, "nothing known")]
    return queries, texts


@pytest.mark.parametrize("options", [{}, {"hot_rows": 10}])
def test_text_search_equals_brute_force(spark, text_tables, options):
    queries, texts = text_tables
    q = spark.createDataFrame(queries, "query_id long, text string")
    t = spark.createDataFrame(texts, "id long, text string").repartition(3)
    found = search.topk_text(q, t, 5, stop_words=[], **options)
    assert got(found) == text_brute(queries, texts, 5)
    misses = search.with_misses(q, found).filter("hit_count = 0").collect()
    assert [(r.query_id, r.id) for r in misses] == [(13, None)]


def test_text_search_in_small_steps_and_by_shuffles(spark, text_tables, monkeypatch):
    from codequarry.operators import tfidf

    queries, texts = text_tables
    q = spark.createDataFrame(queries, "query_id long, text string")
    t = spark.createDataFrame(texts, "id long, text string")
    monkeypatch.setattr(tfidf, "WORDS", 3)
    monkeypatch.setattr(search, "WORDS", 3)
    monkeypatch.setattr(search, "BLOCK_BYTES", 2000)  # several blocks of queries and texts
    assert got(search.topk_text(q, t, 5, stop_words=[], hot_rows=10)) == text_brute(queries, texts, 5)
    assert search.topk_text(q.limit(0), t).count() == 0 and search.topk_text(q, t.limit(0)).count() == 0


def test_products_in_steps(monkeypatch):
    rng = np.random.default_rng(0)
    a, b = rng.random((7, 9)) * (rng.random((7, 9)) < 0.5), rng.random((9, 4)) * (rng.random((9, 4)) < 0.5)
    t, word = np.nonzero(a)
    q_word, q = np.nonzero(b)
    low, high = np.searchsorted(q_word, word, "left"), np.searchsorted(q_word, word, "right")
    for cells in (1, 5, 1000):
        monkeypatch.setattr(search, "CELLS", cells)
        assert np.allclose(search._products(t, a[t, word], low, high - low, q, b[q_word, q], 7, 4), a @ b)


def test_a_search_reads_only_the_folders_of_its_words(spark, text_tables):
    _, texts = text_tables
    index = search.text_index(spark.createDataFrame(texts, "id long, text string"), stop_words=[])
    read = search.search_text(spark.createDataFrame([(1, "w3")], "query_id long, text string"), index, 5, stop_words=[])
    assert read.count() == 5
    assert "bucket" in index[1].columns and index[1].select("bucket").distinct().count() > 10


def test_stream_gives_the_same_hits(spark, text_tables, tmp_path):
    queries, texts = text_tables
    source = tmp_path / "in"
    for n, part in enumerate((queries[:7], queries[7:])):
        spark.createDataFrame(part, "query_id long, text string").write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("query_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(source))
    index = search.text_index(spark.createDataFrame(texts, "id long, text string"), stop_words=[])
    for trigger in (None, {"availableNow": True}):  # the second run finds nothing new
        stream_search(
            stream, lambda b: search.search_text(b, index, 5, stop_words=[]), str(tmp_path / "out"), str(tmp_path / "state"), trigger
        ).awaitTermination()
    assert got(spark.read.parquet(str(tmp_path / "out"))) == text_brute(queries, texts, 5)


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, ""), (3, "?")], "id long, text string")
    rows = {r.id: r.embedding for r in embedding.embed(df, 16).collect()}
    assert all(len(v) == 16 for v in rows.values())
    assert abs(sum(x * x for x in rows[1]) - 1) < 1e-12 and sum(rows[2]) == 0 and sum(rows[3]) == 0

    @F.pandas_udf("array<float>")
    def lengths(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: [float(len(t))])

    assert {r.id: r.embedding for r in embedding.embed(df, model=lengths).collect()}[1] == [11.0]


def test_embeddings_count_words_inside_the_row(spark):
    """Words were rows before, and a join brought the vectors back to the texts."""
    df = spark.createDataFrame([(1, "a.java", "one two"), (1, "a.java", "two"), (2, None, None)], "id long, path string, text string")
    plan = embedding.embed(df, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    want = {r.id: r.embedding for r in embedding.embed(df, 16).collect()}
    assert len(want) == 2 and max(want[1]) == 2 / 5 ** 0.5
    rows = embedding.embed_rows(df, ["id"], "text", 16)
    assert rows.columns == ["id", "path", "text", "embedding"] and "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.id, r.path, r.text, r.embedding) for r in rows.collect()]
    key = lambda r: (r[0], r[2] or "")
    assert sorted(got, key=key) == sorted([(r.id, r.path, r.text, want[r.id]) for r in df.collect()], key=key)


def test_windows_cover_the_text_and_pool(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(1030))), (2, "")], "id long, text string")
    parts = df.select("id", F.explode(T.token_windows(F.col("text"))).alias("p")).collect()
    assert [len(r.p.split()) for r in parts] == [512, 512, 6, 0]
    assert " ".join(r.p for r in parts if r.id == 1) == df.first().text
    pooled = {r.id: r.embedding for r in embedding.embed_long(df, 512, 8).collect()}
    by_part = embedding.embed(spark.createDataFrame([(i, r.p) for i, r in enumerate(parts[:3])], "id long, text string"), 8)
    expect = np.mean([r.embedding for r in by_part.collect()], axis=0)
    assert np.allclose(pooled[1], expect) and pooled[2] == [0.0] * 8


def test_prompts_and_generation(spark):
    q = spark.createDataFrame([(1, "why?"), (2, "none")], "query_id long, text string")
    hits = spark.createDataFrame(
        [(1, 2, "method", "m()"), (1, 1, "class", "c { }")], "query_id long, rank int, kind string, content string"
    )
    typed = rendering.prompt(q, hits, "typed").collect()
    assert [r.prompt for r in typed] == [
        "Query: why?\n\nRelevant code contexts:\n\nclass:\nc { }\n\nmethod:\nm()\n"
        "\nBased on the above code contexts, please provide an answer to the query:"
    ]
    numbered = rendering.prompt(q, hits, "numbered")
    assert numbered.first().prompt == (
        "Query: why?\n\nRelevant code contexts:\n\nSnippet 1:\nc { }\n\nSnippet 2:\nm()\n"
        "\nBased on the above code snippets, please provide a detailed answer to the query."
    )

    def fussy(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("refused")
        return [p.upper() for p in prompts]

    p = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "fine")], "query_id long, prompt string").coalesce(1)
    rows = sorted(tuple(r) for r in generation.generate(p, fussy).collect())
    assert rows == [(1, "OK", None), (2, None, "ValueError: refused"), (3, "FINE", None)]
    short = sorted(tuple(r) for r in generation.generate(p, lambda prompts: prompts[:1]).collect())
    assert short == [(1, "ok", None), (2, "bad", None), (3, "fine", None)]
    none = generation.generate(p, lambda prompts: []).collect()
    assert {(r.response, r.error) for r in none} == {(None, "ValueError: 0 answers to 1 prompts")}


def test_stream_search_reads_tables_that_are_folders(spark, tmp_path):
    from codequarry.plans.queries import QUERIES

    docs = [(1, "red apples grow", "en"), (2, "green pears fall", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    turns = [(1, 1, "user", "apples"), (1, 2, "user", "pears")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(2).write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["stream_search"](spark, str(tmp_path)).select("query_id", "id").collect()
    assert sorted(map(tuple, found)) == [(1_000_001, 1), (1_000_002, 2)]
