import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm import whitening


def table(spark, rows, schema="vec_id bigint, embedding array<float>"):
    return spark.createDataFrame(rows, schema)


def plain(rows, k, scale=256):
    """(id, component) -> (n, deviation, |whitened|, explained), by the whole covariance matrix."""
    kept = [(i, [math.floor(scale * float(c)) for c in e]) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=float)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    centred = fit - fit.mean(0)
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in kept:
        white = (np.array(x) - fit.mean(0)) @ u[:, :k] / np.sqrt(e[:k])
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        out += [(i, c + 1, n, deviation, abs(white[c]), e[c] / np.trace(v)) for c in range(k)]
    return sorted(out)


def close(got, want):
    got = sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("dims", [6, 48])
def test_components_are_those_of_the_covariance(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(i, (rng.standard_normal(dims) * np.linspace(2, 0.5, dims)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # copies count once
    got = whitening.whiten(table(spark, rows), 4).collect()
    close(got, plain(rows, 4))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-12


def test_one_large_eigenvalue_does_not_hide_the_others(spark):
    rng = np.random.default_rng(1)
    scales = np.concatenate([[3000.0], np.linspace(1.2, 1.0, 47)])
    rows = [(i, (rng.standard_normal(48) * scales).astype(np.float32).tolist()) for i in range(400)]
    got = whitening.whiten(table(spark, rows), 4)
    assert got.agg(F.max("identity_error")).first()[0] < 1e-8
    x = np.unique([np.floor(256 * np.array(e, dtype=np.float32).astype(float)) for _, e in rows], axis=0)
    x = x - x.mean(0)
    want = np.linalg.eigvalsh(x.T @ x / len(x))[::-1]
    explained = [r.explained for r in got.filter("vec_id = 0").orderBy("component").collect()]
    assert np.allclose(explained, want[:4] / want.sum(), rtol=1e-8)


def test_vectors_that_take_no_part_and_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (None, [3.0, 1.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 0.0]), (8, [])]
    got = whitening.whiten(table(spark, rows), 4).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert {r.n for r in got} == {3}


def test_lengths_are_fitted_apart_and_constant_dimensions_give_no_component(spark):
    rows = [(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [0.0, 0.0, 1.0]), (6, [1.0] * 4)]
    got = sorted((r.vec_id, r.component, r.n) for r in whitening.whiten(table(spark, rows), 4).collect())
    assert got == [(1, 1, 2), (2, 1, 2), (3, 1, 3), (3, 2, 3), (4, 1, 3), (4, 2, 3), (5, 1, 3), (5, 2, 3)]


def test_empty_table_and_clashing_columns(spark):
    assert whitening.whiten(table(spark, []), 4).count() == 0
    rows = [(1, [1.0, 0.0], 5, 6), (2, [0.0, 2.0], 5, 6), (3, [1.0, 1.0], 5, 6)]
    clash = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, x int, n int")
    assert whitening.whiten(clash, 2).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(clash, 2).count() == 6


def test_deviations_beyond_a_long_are_null():
    assert whitening.deviations(np.array([[3, 0]]), 2, [2, 4]) == [16 + 16]
    assert whitening.deviations(np.array([[2**40], [0]]), 2, [0]) == [None, 0]
