"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few counts and shares. Boosting goes through the features in turn, round
after round; each step fits a shallow tree to the gradients of one feature's bins and adds it to
that feature's lookup table. Then the pairs of features whose joint bins explain most of what is
left get tables of their own in the same way. A score is a sum of table entries.

Fitting takes at most ``sample_rows`` labelled rows, those with the smallest hash of their id
(documented bound; 20,000 rows of 17 numbers reach the driver). Features, scores and decisions
cover all rows and whole texts. Null and empty texts are scored like any other (all counts 0).
Rows with a null label are no training rows; an id with several labels counts with the lowest.
Without labels of both kinds every score is the share of label 1, or 0.5 without any label.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import broadcast_if_small, fold, map_batches, slices
from codequarry.sources.storage import written

FEATURES = (
    "chars", "words", "letters", "upper", "digits", "punctuation", "marks", "symbols", "lines", "distinct_words",
    "word_length", "top_word", "repeated_lines", "distinct_pairs", "clean_ends", "longest_word", "capitals",
)
_KIND = np.zeros(256, dtype=np.int64)  # 1 lower or beyond ASCII, 2 upper, 3 digit, 4 .,;:'"()- , 5 !?, 6 symbol, 7 space, 8 line end
_KIND[128:] = 1
for _kind, _chars in enumerate(
    ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()-", "!?", "#$%&*+/<=>@[\\]^_`{|}~", " \t\r", "\n"), 1
):
    _KIND[[ord(c) for c in _chars]] = _kind


def text_features(text: str) -> list[float]:
    """The numbers that describe one whole text, in the order of FEATURES."""
    data = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KIND[np.frombuffer(data, dtype=np.uint8)], minlength=9)
    size = max(1, len(data))
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = text.split("\n")
    letters = max(1, int(kinds[1] + kinds[2]))
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), (kinds[1] + kinds[2]) / size, kinds[2] / letters,
        kinds[3] / size, kinds[4] / size, kinds[5] / size, kinds[6] / size, kinds[8] / size, len(counts) / n,
        len(data) / n, (max(counts.values()) if counts else 0) / n, 1 - len(set(lines)) / len(lines),
        len(set(zip(words, words[1:]))) / n, sum(map(str.isalnum, counts)) / max(1, len(counts)),
        float(np.log1p(max(map(len, counts), default=0))), sum(map(str.isupper, counts)) / max(1, len(counts)),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, features: one row per document."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(
        rows, lambda b: {"doc_id": b["doc_id"], "features": [text_features(t or "") for t in b["text"]]},
        "doc_id bigint, features array<double>",
    )


@dataclass
class AdditiveModel:
    """Bin borders per feature, a lookup table per feature, and one per chosen pair."""

    start: float
    borders: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1: one bin lookup and addition per table."""
        total = np.full(len(x), self.start)
        for j, (borders, values) in enumerate(zip(self.borders, self.tables)):
            total += values[np.searchsorted(borders, x[:, j], side="right")]
        for (i, j), (rows, columns, values) in self.pairs.items():
            total += values[np.searchsorted(rows, x[:, i], side="right"), np.searchsorted(columns, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _borders(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best split of ordered bins."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    if len(g) < 2:
        return 0.0, 0
    left, right = g[:-1], g[-1] - g[:-1]
    gain = left**2 / (h[:-1] + ridge) + right**2 / (h[-1] - h[:-1] + ridge) - g[-1] ** 2 / (h[-1] + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Step for each bin by a tree of so many levels over the ordered bins."""
    gain, at = _best_cut(grad, hess, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(grad), grad.sum() / (hess.sum() + ridge))
    return np.append(_tree(grad[:at], hess[:at], depth - 1, ridge), _tree(grad[at:], hess[at:], depth - 1, ridge))


def _pair_tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and steps of two levels: one cut of one axis, then a cut of the other axis on each side."""
    found = (0.0, np.zeros_like(grad))
    for g, h, turned in ((grad, hess, False), (grad.T, hess.T, True)):
        for at in range(1, len(g)):
            gain, parts = 0.0, []
            for side in (slice(0, at), slice(at, None)):
                a, b = g[side].sum(0), h[side].sum(0)
                own, cut = _best_cut(a, b, ridge)
                gain += own + a.sum() ** 2 / (b.sum() + ridge)
                steps = np.append(np.full(cut, a[:cut].sum() / (b[:cut].sum() + ridge)), np.full(len(a) - cut, a[cut:].sum() / (b[cut:].sum() + ridge)))
                parts.append(np.tile(steps, (len(g[side]), 1)))
            if gain > found[0]:
                steps = np.vstack(parts)
                found = (gain, steps.T if turned else steps)
    return found


def fit_arrays(
    x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 8, n_pairs: int = 8, rounds: int = 120,
    pair_rounds: int = 30, rate: float = 0.1, depth: int = 2, ridge: float = 1.0,
) -> AdditiveModel:
    """Fit the tables to a sample that fits in memory."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = AdditiveModel(float(np.log(share / (1 - share))), [], [], {})
    if not len(y) or y.min() == y.max():
        model.borders, model.tables = [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES)
        return model
    model.borders = [_borders(c, bins) for c in x.T]
    where = [np.searchsorted(b, c, side="right") for b, c in zip(model.borders, x.T)]
    model.tables = [np.zeros(len(b) + 1) for b in model.borders]
    total = np.full(len(y), model.start)
    for _ in range(rounds):
        for table, at in zip(model.tables, where):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(
                np.bincount(at, y - p, len(table)), np.bincount(at, p * (1 - p), len(table)), depth, ridge
            )
            table += step
            total += step[at]
    coarse = [_borders(c, pair_bins) for c in x.T]
    place = [np.searchsorted(b, c, side="right") for b, c in zip(coarse, x.T)]

    def joint(i: int, j: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at, p = place[i] * shape[1] + place[j], 1 / (1 + np.exp(-total))
        sums = [np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p))]
        return at, (sums[0], sums[1])

    ranked = sorted(
        ((_pair_tree(*joint(i, j)[1], ridge)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True
    )
    chosen = [(i, j) for _, i, j in ranked[:n_pairs]]
    for i, j in chosen:
        model.pairs[i, j] = (coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)))
    for _ in range(pair_rounds):
        for i, j in chosen:
            at, (grad, hess) = joint(i, j)
            step = rate * _pair_tree(grad, hess, ridge)[1]
            model.pairs[i, j][2][...] += step
            total += step.ravel()[at]
    return model


def fit(described: DataFrame, labels: DataFrame, sample_rows: int = 20_000, label_col: str = "quality") -> AdditiveModel:
    """Fit to the rows of ``described`` (doc_id, features) that have a label and are not held out."""
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(label_col).alias("label"))
    )
    rows = described.filter(fold("doc_id", 3) != 1).join(known, "doc_id")
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("features", "label").toArrow()
    x = np.array(sample.column("features").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit_arrays(x, (np.array(sample.column("label").to_pylist(), dtype=float) > 0).astype(float))


def fit_texts(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, label_col: str = "quality") -> AdditiveModel:
    """Fit to the same sample of ``docs`` (doc_id, text), describing only the texts in it."""
    named = labels.filter(F.col(label_col).isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    ids = docs.filter(fold("doc_id", 3) != 1).select(F.col("doc_id").cast("bigint").alias("doc_id")).join(named, "doc_id")
    ids = written(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).distinct(), "sample")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(broadcast_if_small(ids), "doc_id")
    return fit(features(rows), labels, sample_rows, label_col)


def score(described: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score, predicted for rows of (doc_id, features)."""

    def scored(b):
        s = model.score(np.array(b["features"], dtype=float).reshape(-1, len(FEATURES)))
        return {"doc_id": b["doc_id"], "score": s, "predicted": (s >= 0.5).astype("int32")}

    got = map_batches(described.select("doc_id", "features"), scored, "doc_id bigint, score double, predicted int")
    return got.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model accepts (score of 0.5 or more), all columns kept."""

    def accepts(batches):
        import pyarrow as pa

        for batch in slices(batches):
            at = batch.schema.names.index(text_col)
            x = [text_features(t or "") for t in batch.column(at).to_pylist()]
            if x:
                yield batch.filter(pa.array(model.score(np.array(x, dtype=float)) >= 0.5))

    return docs.mapInArrow(accepts, docs.schema)
