"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become x = floor(scale * c). The fit list is each distinct x-vector once; mean and covariance
V are those of the fit list. The leading eigenvectors of V come from products V Q only: every product
is one pass over the written fit list, ``sum (x - mean)^T ((x - mean) Q) / n``, added up in Spark, so
V itself is never built and the driver holds a block of a few vectors.

A short Lanczos run bounds the spectrum. Each sweep applies a Chebyshev polynomial of V to the block
by its three-term recurrence, which damps the interval between the lower bound and the block's
smallest Ritz value, then does QR and Rayleigh-Ritz. A leading vector is certified, and locked, when
its residual ``|V q - e q|`` is at the noise of double arithmetic; locked vectors are projected out,
so one large eigenvalue does not slow the others. Sweeps end when the asked components are certified;
if they are not after ``SWEEPS`` sweeps, ``fit`` raises.

Vectors that are null or hold null or non-finite entries take no part. Vectors of each length are
whitened by a fit of their own. Components whose eigenvalue is zero to double precision do not exist:
fewer distinct vectors than components, or constant dimensions, give fewer rows, and a single distinct
vector or an empty table gives none. Rows with null or repeated ids stay rows of their own. Entries of
any size work as long as x is a long; ``deviation`` is null where its exact value is no long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import slices
from codequarry.llm.matrices import columns_of, summed
from codequarry.llm.topk import quantised
from codequarry.sources.storage import written

EPS = np.finfo(float).eps
# Vectors in the block at least; passes of a filter at most; growth of a filter at most; sweeps at most.
BLOCK, DEGREE, GROWTH, SWEEPS = 32, 10, 1e10, 200
LANCZOS = 6


@dataclass
class Whitening:
    """What a fit has learned: size and sums of the fit list, components, and how good they are."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column each
    trace: float
    residual: float
    passes: int
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the numerator is exact while it is a long."""
        return _centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray | None:
    """n * x - sums as longs, or None if a value may not fit."""
    if n * _largest(x) + max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, dtype=np.int64)
    return None


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    offsets = _offsets(x, n, sums)
    return x - np.array([s / n for s in sums]) if offsets is None else offsets / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the exact sum over dimensions of (n * x - sums)^2; None if that is no long."""
    offsets = _offsets(x, n, sums)
    if offsets is not None and x.shape[1] * _largest(offsets) ** 2 < 2**63:
        return (offsets * offsets).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def _dimension_sums(fit_list: DataFrame, dims: int) -> list[int]:
    """Exact sums per dimension, of any size."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dims, dtype=np.int64), np.zeros(dims, dtype=np.int64)
        for batch in batches:
            x = columns_of(batch, "x", dims)
            high, low = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(high), pa.array(low)], names=["row", "high", "low"])

    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    got = fit_list.mapInArrow(halves, "row int, high bigint, low bigint").groupBy("row").agg(*total).collect()
    sums = {r.row: int(r.high) * 2**32 + int(r.low) for r in got}
    return [sums.get(i, 0) for i in range(dims)]


class _Covariance:
    """Products with the covariance of the fit list; each is one pass."""

    def __init__(self, fit_list: DataFrame, dims: int, n: int, sums: list[int]):
        self.fit_list, self.dims, self.n, self.sums, self.passes = fit_list, dims, n, sums, 0

    def over(self, part, rows: int, columns: int) -> np.ndarray:
        dims, n, sums = self.dims, self.n, self.sums
        self.passes += 1
        return summed(self.fit_list, lambda b: part(_centred(columns_of(b, "x", dims), n, sums)), rows, columns) / n

    def times(self, q: np.ndarray) -> np.ndarray:
        return self.over(lambda c: c.T @ (c @ q), self.dims, q.shape[1])

    def trace(self) -> float:
        return float(self.over(lambda c: (c * c).sum(0)[:, None], self.dims, 1).sum())


def _lower_bound(v: _Covariance, rng: np.random.Generator) -> float:
    """A lower bound of the spectrum, as a few Lanczos steps see it."""
    q, before = rng.standard_normal(v.dims), np.zeros(v.dims)
    q, beta = q / np.linalg.norm(q), 0.0
    alphas, betas = [], []
    for _ in range(min(LANCZOS, v.dims)):
        w = v.times(q[:, None])[:, 0] - beta * before
        alphas.append(q @ w)
        w -= alphas[-1] * q
        beta = float(np.linalg.norm(w))
        betas.append(beta)
        if beta <= EPS * max(map(abs, alphas)):
            break
        before, q = q, w / beta
    values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1))
    return max(0.0, float(values[0] - abs(betas[-1] * vectors[-1, 0])))


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: falling values, vectors, their products and residuals."""
    h = q.T @ vq
    values, u = np.linalg.eigh((h + h.T) / 2)
    values, u = values[::-1], u[:, ::-1]
    q, vq = q @ u, vq @ u
    return values, q, vq, np.linalg.norm(vq - q * values, axis=0)


def _filtered(v: _Covariance, q: np.ndarray, vq: np.ndarray, values: np.ndarray, low: float, locked: np.ndarray) -> np.ndarray:
    """The block under a Chebyshev polynomial that is small between ``low`` and its smallest Ritz value."""
    high = float(values[-1])
    centre, half = (high + low) / 2, max((high - low) / 2, EPS * float(values[0]))
    outside = max((float(values[0]) - centre) / half, 1 + EPS)
    degree = int(max(1, min(DEGREE, np.log(GROWTH) / np.arccosh(outside))))
    sigma = start = half / max(float(values[0]) - centre, half)
    before, now = q, (vq - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        now = now - locked @ (locked.T @ now)
        after = 1 / (2 / start - sigma)
        before, now, sigma = now, 2 * (after / half) * (v.times(now) - centre * now) - sigma * after * before, after
    return now


def _orthonormal(y: np.ndarray, locked: np.ndarray) -> np.ndarray:
    for _ in range(2):
        y = y - locked @ (locked.T @ y)
        y = np.linalg.qr(y)[0]
    return y


def _leading(v: _Covariance, k: int) -> tuple[np.ndarray, float]:
    """The k leading eigenvectors, and the largest residual when they were certified."""
    rng = np.random.default_rng(13)
    block = min(v.dims, max(BLOCK, 2 * k))
    low = _lower_bound(v, rng) if block < v.dims else 0.0
    locked, worst = np.zeros((v.dims, 0)), 0.0
    q, top = _orthonormal(rng.standard_normal((v.dims, block)), locked), 0.0
    earlier = np.full(block, np.inf)
    for _ in range(SWEEPS):
        values, q, vq, residuals = _ritz(q, v.times(q))
        top = max(top, float(values[0]))
        still = (residuals <= 1e-10 * top) & (residuals >= earlier / 2)
        sure = (residuals <= 2 * v.dims * EPS * top) | still
        done = len(sure) if sure.all() else int(np.argmin(sure))
        if done:
            worst = max(worst, float(residuals[:done].max()))
            locked = np.concatenate([locked, q[:, :done]], axis=1)
        if locked.shape[1] >= k:
            return locked, worst
        q, vq, values, earlier = q[:, done:], vq[:, done:], values[done:], residuals[done:]
        q = _orthonormal(_filtered(v, q, vq, values, low, locked), locked)
    raise ArithmeticError(f"{locked.shape[1]} of {k} components certified after {SWEEPS} sweeps; residuals {earlier[:k]}")


def fit(xs: DataFrame, dims: int, k: int) -> Whitening | None:
    """Mean and the leading components of the distinct vectors of ``xs`` (x array<bigint>, ``dims`` entries each)."""
    fit_list = written(xs.select("x").distinct(), "fit-list")
    n = fit_list.count()
    if n < 2 or not dims:
        return None
    sums = _dimension_sums(fit_list, dims)
    v = _Covariance(fit_list, dims, n, sums)
    trace = v.trace()
    if trace <= 0:
        return None
    vectors, residual = _leading(v, min(k, dims))
    vectors = np.linalg.qr(vectors)[0]
    values, vectors, _, _ = _ritz(vectors, v.times(vectors))
    real = min(k, int((values > 4 * dims * EPS * trace).sum()))
    values, vectors = values[:real], vectors[:, :real]
    if not real:
        return None
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(real)])
    to_white = vectors / np.sqrt(values)
    centre = v.over(lambda c: (c @ to_white).sum(0)[:, None], real, 1)[:, 0]

    def spread(c: np.ndarray) -> np.ndarray:
        w = c @ to_white - centre
        return w.T @ w

    error = float(np.abs(v.over(spread, real, real) - np.eye(real)).max())
    return Whitening(n, sums, values, vectors, trace, residual, v.passes, error)


def whiten(vectors: DataFrame, k: int, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    ``vectors`` has vec_id and embedding.
    """
    xs = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised("embedding", scale).alias("x")).filter("x IS NOT NULL")
    lengths = sorted(r.dims for r in xs.select(F.size("x").alias("dims")).distinct().collect())
    result = None
    for dims in lengths:
        same = xs.filter(F.size("x") == dims)
        model = fit(same, dims, k)
        if model is not None:
            rows = _rows(same, dims, model)
            result = rows if result is None else result.unionByName(rows)
    return vectors.sparkSession.createDataFrame([], SCHEMA) if result is None else result


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _rows(xs: DataFrame, dims: int, model: Whitening) -> DataFrame:
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            x, rows = columns_of(batch, "x", dims), batch.num_rows
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n)),
                pa.array(deviations(x, model.n, model.sums), type=pa.int64()).take(pa.array(each)),
                pa.array(model.whitened(x).ravel()),
                pa.array(np.tile(model.values / model.trace, rows)),
                pa.array(np.full(rows * k, model.identity_error)),
            ], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return xs.mapInArrow(run, SCHEMA)
