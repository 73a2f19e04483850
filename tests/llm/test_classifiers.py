"""Quality classifier and language identification: held-out accuracy, filters against sets, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm import langid, quality

GOOD = "the old house stands by a quiet river and its garden is full of green apple trees in late summer".split()
TONGUES = {
    "aa": "zando mirelo kafuna pelito ranoso".split(), "bb": "thwick ghorst blimph krasht vronk".split(),
    "cc": "éàoui lèvre naïque çaré uêtre".split(),
}


def good(draw):
    return " ".join(draw.choice(GOOD) for _ in range(draw.randint(5, 80))) + "."


def bad(draw):
    return " ".join(draw.choice(GOOD).upper() + "!!" for _ in range(draw.randint(5, 80)))


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(3)
    rows = [(i, good(draw) if i % 2 else bad(draw), i % 2) for i in range(600)]
    odd = [(1000, None, None), (1001, "", None), (1002, good(draw) * 200, 1), (1003, rows[1][1], 1), (1003, rows[1][1], 1)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows + odd], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows + odd] + [(None, 0), (3, None)], "doc_id bigint, quality int")
    return docs, labels


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    described = quality.features(docs)
    rows = quality.score(described, quality.fit(described, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and r.doc_id < 600]
    assert len(judged) > 100 and sum(r.predicted == r.doc_id % 2 for r in judged) > 0.97 * len(judged)
    kept = quality.keep_good(docs, quality.fit(described, labels))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.predicted)


def test_quality_without_labels_or_rows(labelled, spark):
    docs, labels = labelled
    described = quality.features(docs.limit(5))
    model = quality.fit(described, labels.limit(0))
    assert {r.score for r in quality.score(described, model).collect()} == {0.5}
    empty = quality.features(docs.limit(0))
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0


def test_interaction_is_learned():
    draw = np.random.default_rng(0)
    x = np.zeros((4000, len(quality.FEATURES)))
    x[:, :2] = draw.random((4000, 2))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    model = quality.fit_arrays(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


@pytest.fixture(scope="module")
def tongues(spark):
    draw = random.Random(4)
    rows = []
    for i in range(600):
        lang = sorted(TONGUES)[i % 3]
        rows.append((i, " ".join(draw.choice(TONGUES[lang]) for _ in range(draw.randint(2, 60))), lang))
    rows += [(700, None, "aa"), (701, "", "bb"), (702, "12 34 !!", "aa"), (703, "zando " * 50_000, None), (704, "q", None), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))


def test_language_on_held_out_rows(tongues):
    rows = langid.identify(tongues, langid.learn(tongues)).collect()
    assert len(rows) == tongues.count()
    judged = [r for r in rows if r.held_out and r.doc_id < 600]
    assert len(judged) > 80 and all(r.lang_pred == sorted(TONGUES)[r.doc_id % 3] for r in judged)
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in (700, 701, 702, 703)] == ["und", "und", "und", "aa"]
    assert by_id[704].lang_pred in TONGUES and all(0 <= r.score <= 1 for r in rows)


def test_language_of_empty_tables(tongues):
    filters = langid.learn(tongues)
    assert langid.identify(tongues.limit(0), filters).count() == 0
    unlearned = langid.learn(tongues.filter("doc_id > 1000"))
    assert {r.lang_pred for r in langid.identify(tongues.filter("doc_id < 3"), unlearned).collect()} == {"und"}


def test_filters_return_every_language_of_a_gram():
    draw = np.random.default_rng(1)
    sets = {l: np.unique(draw.integers(0, 1 << 32, 3000, dtype=np.uint32)) for l in "abcdefghij"}
    sets["b"] = np.union1d(sets["b"], sets["a"][:100])
    filters = langid.build_filters(sets, {l: 1 for l in sets})
    for j, l in enumerate(filters.languages):
        assert ((filters.languages_of(sets[l]) >> filters.masks.dtype.type(j)) & 1).all()  # none is missed
    strangers = draw.integers(0, 1 << 32, 100_000, dtype=np.uint32)
    strangers = strangers[~np.isin(strangers, np.concatenate(list(sets.values())))]
    for j in range(len(sets)):
        seen = ((filters.languages_of(strangers) >> filters.masks.dtype.type(j)) & 1).mean()
        assert abs(seen - filters.mistakes[j]) < 0.01


def test_grams_stay_inside_their_text():
    keys, starts = langid.grams(["ab", "", "1", "abc de", "x"])
    assert np.diff(starts).tolist() == [1, 0, 0, 5, 0] and len(keys) == 6


def test_more_languages_than_a_word_of_bits(spark):
    draw = random.Random(8)
    words = {f"l{j:02}": ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for j in range(70)}
    rows = [(i, " ".join(draw.choice(words[l]) for _ in range(20)), l) for i, l in enumerate(sorted(words) * 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    filters = langid.learn(docs)
    assert len(filters.languages) == 70 and filters.masks.shape[0] == 2
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, filters).collect()}
    assert got == {i: l for i, _, l in rows}


def test_fit_describes_the_sampled_texts_only(spark):
    draw = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(draw.choice(["good", "Words", "!!", "x1"]) for _ in range(i % 40))) for i in range(300)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(i % 40 > 20)) for i in range(0, 300, 2)] + [(None, 1), (4, None)], "doc_id bigint, quality int")
    one, other = quality.fit(quality.features(docs), labels, 60), quality.fit_texts(docs, labels, 60)
    assert one.start == other.start and all(np.array_equal(a, b) for a, b in zip(one.tables, other.tables))
