"""Exact top-k against scoring every pair."""

import numpy as np
import pytest

from codequarry.llm import topk


def brute(rows, asked, k):
    out = []
    for q, v in asked:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["normal", "skewed", "ties", "negative"])
def test_blocks_against_all_pairs(kind):
    draw = np.random.default_rng(7)
    x = draw.normal(0, 300, (700, 12)).astype(np.int64)
    if kind == "skewed":
        x = (draw.pareto(1.0, (700, 12)) * 10).astype(np.int64) % 100_000
    if kind == "ties":
        x[:500] = x[0]
        x[500:] //= 200
    if kind == "negative":
        x = -abs(x)
    lists, rows = topk.SortedLists(np.arange(700), x), list(enumerate(x.tolist()))
    asked = np.arange(0, 700, 50)
    for q, (ids, scores) in zip(asked.tolist(), lists.top(asked, x[asked], 10)):
        assert [(q, n + 1, i, s) for n, (i, s) in enumerate(zip(ids.tolist(), scores.tolist()))] == brute(rows, [(q, rows[q][1])], 10)


def test_bounds_hold_at_every_depth():
    x = np.random.default_rng(9).normal(0, 300, (200, 8)).astype(np.int64)
    lists, asked = topk.SortedLists(np.arange(200), x), x[:5].T.astype(float)
    scores, widths = x @ asked, []
    for depth in (1, 10, 50, 100, 199, 200):
        lower, upper = lists.bounds(np.maximum(asked, 0), np.minimum(asked, 0), depth)
        assert (lower <= scores).all() and (scores <= upper).all()
        widths.append((upper - lower).sum())
    assert widths == sorted(widths, reverse=True) and widths[-1] == 0


def test_spark_rows_with_odd_vectors(spark):
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(0, 1, 6).tolist()) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6)]
    rows += [(304, []), (400, []), (305, [0.0] * 6), (500, [1.0, 2.0]), (501, [3.0, -1.0]), (100, rows[100][1]), (7, rows[100][1])]
    df = spark.createDataFrame([r + ("x",) for r in rows], "vec_id bigint, embedding array<double>, score string")
    v = df.select("vec_id", topk.quantised("embedding").alias("vector")).filter("vector is not null")
    plain = [(r.vec_id, list(r.vector)) for r in v.collect()]
    assert len(plain) == len(rows) - 4 and plain[0][1] == [int(np.floor(1024 * x)) for x in rows[0][1]]
    asked = v.filter("vec_id % 100 = 0").dropDuplicates(["vec_id"])
    got = topk.top_k(v, asked, 10, candidate_rows=40, query_rows=2).collect()
    want = brute(plain, [(r.vec_id, list(r.vector)) for r in asked.collect()], 10)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert topk.top_k(v.limit(0), asked).count() == 0 and topk.top_k(v, asked.limit(0)).count() == 0


def test_repeated_query_rows(spark):
    rows = [(100, [3, 1]), (100, [3, 1]), (1, [5, 0]), (2, [0, 5]), (3, [1, 1]), (4, [2, 2])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    got = topk.top_k(vectors, vectors.filter("vec_id = 100"), k=3)
    assert sorted(tuple(r) for r in got.collect()) == [(100, 1, 1, 15), (100, 2, 4, 8), (100, 3, 2, 5)]
    two = spark.createDataFrame([(100, [3, 1]), (100, [0, 1])], "vec_id bigint, vector array<bigint>")
    got = topk.top_k(vectors, two, k=1)
    assert sorted(tuple(r) for r in got.collect()) == [(100, 1, 1, 15), (100, 1, 2, 5)]
