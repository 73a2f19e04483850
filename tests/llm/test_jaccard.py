"""Jaccard groups against comparing every pair."""

import random

import numpy as np
import pytest

from codequarry.llm import components, jaccard
from tests.llm import plain


def near_copies(draw, pool, start, n, words, edits):
    """Copies that drift apart from each other, so that groups are chains and rings."""
    base, out = [draw.choice(pool) for _ in range(words)], []
    for i in range(n):
        for _ in range(draw.randint(0, edits)):
            base[draw.randrange(words)] = draw.choice(pool)
        out.append((start + i, " ".join(base)))
    return out


def corpus(seed):
    draw = random.Random(seed)
    pool = [f"w{i}" for i in range(400)] + ["é", "Ünd", "\x1c", "a\xa0b"]
    rows = []
    for g in range(12):
        rows += near_copies(draw, pool, 1000 * g, 25, draw.choice([3, 10, 40, 100, 200]), draw.choice([1, 2, 4]))
    hub = [draw.choice(pool) for _ in range(300)]
    for i in range(60):  # near copies of one text, further from each other than from it
        own = list(hub)
        for _ in range(draw.randint(1, 9)):
            own[draw.randrange(300)] = draw.choice(pool)
        rows.append((20_000 + i, " ".join(own)))
    passage = " ".join(draw.choice(pool) for _ in range(30))
    rows += [(30_000 + i, passage + " " + " ".join(draw.choice(pool) for _ in range(draw.randint(0, 60)))) for i in range(60)]
    rows += [(40_000 + i, t) for i, t in enumerate([None, "", " \n", "one", "ONE", "one two", "One\ttwo", "two one", "x " * 20_000, "x " * 20_000])]
    rows += [(50_000 + i, "the very same text of a few words") for i in range(40)]
    return rows


@pytest.mark.parametrize("seed, blocks", [(1, (512, 4096)), (2, (3, 7))])
def test_against_all_pairs(spark, monkeypatch, seed, blocks):
    monkeypatch.setattr(jaccard, "QUERIES", blocks[0])
    monkeypatch.setattr(jaccard.ring_links, "__defaults__", (90, *blocks))
    rows = corpus(seed)
    docs = spark.createDataFrame([r + (5, "x") for r in rows], "doc_id bigint, text string, n_shingles int, key string")
    got = jaccard.similar_groups(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == plain.similar(rows)
    kept = jaccard.keep_first(docs, got)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in plain.similar(rows).values()}


def test_other_threshold_and_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "broadcast_if_small", lambda df: df)
    rows = corpus(3)[:200]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, percent=70).collect()} == plain.similar(rows, 70)


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d")], "doc_id bigint, text string")
    assert jaccard.similar_groups(docs.limit(0)).count() == 0
    assert sorted(((r.doc_id, r.component_id) for r in jaccard.similar_groups(docs).collect()), key=str) == [(1, 1), (1, 1), (2, 1), (None, 1)]


def test_components_of_chains_and_stars(spark):
    draw = random.Random(9)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(300 - i, 299 - i) for i in range(40)]
    links += [(draw.randint(400, 700), draw.randint(400, 700)) for _ in range(150)] + [(5, 5), (60, 0)]
    got = components.components(spark.createDataFrame(links, "x bigint, y bigint"))
    nodes = {n for l in links for n in l if l[0] != l[1]}
    assert {r.node: r.component for r in got.collect()} == plain.components([l for l in links if l[0] != l[1]], nodes)
    assert components.components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


def test_sketches_never_rule_out_a_link():
    draw = np.random.default_rng(3)
    for n in (1, 5, 100, 2040, 2100, 5000, 40_000):
        for _ in range(20):
            a = np.unique(draw.integers(0, 1 << 64, n, dtype=np.uint64))
            common = a[: len(a) - draw.integers(0, max(1, n // 15))]
            b = np.union1d(common, draw.integers(0, 1 << 64, draw.integers(0, max(1, n // 15)), dtype=np.uint64))
            links = 100 * len(common) >= 90 * (len(a) + len(b) - len(common))
            x, y = jaccard.sketch(a), jaccard.sketch(b)
            near = [jaccard._close(p, len(s), q[None, :], np.array([len(t)]), 90)[0] for p, s, q, t in ((x, a, y, b), (y, b, x, a))]
            assert near[0] == near[1] and (near[0] or not links)
        stranger = np.unique(draw.integers(0, 1 << 64, n, dtype=np.uint64))
        assert n < 100 or not jaccard._close(jaccard.sketch(a), len(a), jaccard.sketch(stranger)[None, :], np.array([len(stranger)]), 90)[0]


def test_slot_counts_cover_all_tasks(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} next{i % 7} last{i % 7}") for i in range(70)], "doc_id bigint, text string").repartition(5)
    order = jaccard.slot_order(jaccard.describe(docs))
    assert order.sum() == 70 and sorted(order[order > 0].tolist()) == [10] * 7 and order.dtype == np.uint32
