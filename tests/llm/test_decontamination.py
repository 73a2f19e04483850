"""Exact phrase and proximity matches against looking at every place."""

import random

import pytest

from codequarry.llm import decontamination as dc
from tests.llm import plain


def corpus(seed):
    draw = random.Random(seed)
    pool = ["the", "of", "A", "b", "É", "x1", "rare", "odd", "ünder", "9"]
    text = lambda n: " ".join(draw.choices(pool, weights=[30, 30, 10, 10, 5, 3, 2, 1, 1, 3], k=n))
    items = [(i, text(draw.randint(0, 30))) for i in range(25)] + [(30, None), (31, ""), (32, "of"), (33, "the the the"), (3, text(15)), (100, "the the the")]
    docs = [(i, text(draw.randint(0, 60))) for i in range(120)]
    docs += [(200 + i, text(8) + "; " + (items[i % 25][1] or "") + ". " + text(4)) for i in range(60)]
    docs += [(300, None), (301, ""), (302, "!!"), (303, text(20_000) + items[1][1]), (304, "of")]
    return docs, items


@pytest.mark.parametrize("seed, size", [(1, 13), (2, 4), (3, 2)])
def test_against_every_place(spark, seed, size):
    docs, items = corpus(seed)
    d = spark.createDataFrame([r + ("x", 1) for r in docs], "doc_id bigint, text string, start string, window_id int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = dc.contamination(d, b, size)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect())) == plain.contamination(docs, items, size)


def test_shuffle_joins_and_empty_tables(spark, monkeypatch):
    docs, items = corpus(4)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(dc, "broadcast_if_small", lambda df: df)
    assert sorted(map(tuple, dc.contamination(d, b, 5).collect())) == plain.contamination(docs, items, 5)
    assert dc.contamination(d.limit(0), b).count() == 0
    none = dc.contamination(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.n_hit or r.contaminated for r in none)


def test_rows_are_judged_by_their_own_text(spark):
    docs = [(1, "alpha gamma"), (1, "delta beta"), (None, "alpha beta"), (None, "beta"), (2, "alpha beta"), (2, "alpha beta"), (2, "alpha"), (None, None)]
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id bigint, text string, row int")
    b = spark.createDataFrame([(1, "alpha beta")], "item_id bigint, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in dc.contamination(d, b, 13).collect()), key=str)
    want = [(i, *((len((t or "").split()), 2, 1, True) if t == "alpha beta" else (len((t or "").split()), 0, 0, False))) for i, t in docs]
    assert got == sorted(want, key=str)


def test_proximity(spark):
    docs, items = corpus(5)
    docs = docs[:150]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items[:8], "item_id bigint, text string")
    windows = dc.test_windows(b, 4)
    terms = dc.vocabulary(windows)
    wanted = dc.window_terms(windows, terms)
    got = {tuple(r) for r in dc.proximity_matches(dc.build_index(d, terms), wanted, 6).collect()}
    want = set()
    for r in windows.collect():
        for doc, text in docs:
            w = plain.words(text)
            if any(set(r.terms) <= set(w[i:i + 6]) for i in range(len(w))):
                want.add((doc, r.window_id))
    assert got == want and want
