"""Line dedup against counting every line's sites."""

import random

import pytest

from codequarry.llm import line_dedup
from tests.llm import plain


@pytest.mark.parametrize("min_sites", [2, 3, 30])
def test_against_counts(spark, min_sites):
    draw = random.Random(min_sites)
    pool = [f"line number {i} of the pool" for i in range(60)] + ["two words", "x", "", " padded line of words "]
    rows = []
    for i in range(300):
        site = None if i % 50 == 0 else f"s{draw.randint(0, 40)}"
        own = [draw.choice(pool[: 1 + i % 64]) for _ in range(draw.randint(0, 6))]
        rows.append((i, "\n".join(own), site))
    rows += [(400, None, "s1"), (401, "", "s1"), (402, "\n\n", "s2"), (403, "word " * 50_000 + "\nline number 0 of the pool", "s3"), rows[7], rows[7]]
    docs = spark.createDataFrame([r + (1, "a", 5) for r in rows], "doc_id bigint, text string, source string, removed int, hash_a string, n_lines int")
    cleaned = line_dedup.dedup_lines(docs, min_sites)
    assert cleaned.columns == ["doc_id", "text", "source", "removed", "hash_a", "n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in cleaned.collect()), key=str)
    assert got == plain.dedup_lines(rows, min_sites, 3)
    kept = {r.doc_id for r in line_dedup.without_emptied(cleaned).collect()}
    assert kept == {i for i, t, n, gone in got if not gone or t.strip()} and {400, 401, 402} <= kept
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_shuffle_join_gives_the_same(spark, monkeypatch):
    rows = [(i, f"shared line of words\nown line number {i}", f"s{i % 5}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = sorted(map(tuple, line_dedup.dedup_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "broadcast_if_small", lambda df: df)
    assert sorted(map(tuple, line_dedup.dedup_lines(docs).collect())) == want
    assert sum(r[-1] for r in want) == 39


def test_long_lines_have_a_threshold_of_their_own(spark):
    long, edge = "word " * 50 + "end", "word " * 49 + "end"
    rows = [(i, f"{long}\n{edge}\nshort shared line\nown line {i}", f"s{i % 2}") for i in range(4)] + [(9, f"in site {long}\nx", "s0"), (10, f"in site {long}", "s0")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs, long_words=50).collect()}
    assert got[0] == (rows[0][1], 0) and got[3] == (f"{edge}\nshort shared line\nown line 3", 1)
    assert got[9][1] == got[10][1] == 0 and all(r.n_removed == 0 for r in line_dedup.dedup_lines(docs).collect())
