"""The pipeline's stages against plain versions of them, each on its own input."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codequarry.llm import pieces, quality
from codequarry.llm.common import table
from tests.llm import plain

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs, out = table(spark, FOLDER, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, FOLDER).cache()
        out.append((docs, kept))
        docs = kept
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_and_growth(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() <= before.count()
    assert stages[-1][1].count() == stages[-1][0].count() > 0


def test_quality_stage_keeps_what_the_model_accepts(spark, stages):
    before, after = stages[0]
    described = quality.features(before)
    scored = quality.score(described, quality.fit(described, table(spark, FOLDER, "labels"))).collect()
    assert {r.doc_id for r in scored if r.predicted} == {i for i, _ in texts(after)}
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    kept = {i for i, _ in texts(after)}
    assert sum(i in kept for i, q in labels.items() if q) >= 0.97 * sum(labels.values())


def test_line_stage(stages):
    before, after = stages[1]
    rows = [(r.doc_id, r.text, r.source) for r in before.collect()]
    want = {i: t for i, t, _, gone in plain.dedup_lines(rows, 3, 3) if not gone or t.strip()}
    assert dict(texts(after)) == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_join_stage(stages):
    before, after = stages[2]
    groups = plain.similar(texts(before), 80, 5)
    assert {i for i, _ in texts(after)} == {c for _, c in groups.values()}


def test_decontamination_stage(spark, stages):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    clean = {r[0] for r in plain.contamination(texts(before), items, 13) if not r[-1]}
    assert {i for i, _ in texts(after)} == clean


def test_pieces_give_the_texts_back(spark, stages):
    before, after = stages[4]
    back = {r.doc_id: r.text for r in pieces.decode(after).collect()}
    assert {i: hashlib.md5(t.encode()).hexdigest() for i, t in back.items()} == {i: hashlib.md5(t.encode()).hexdigest() for i, t in texts(before)}
    assert all(not r.others or r.others[0].score <= r.score for r in after.collect())


def test_run_writes_and_rereads_every_stage(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in stages[-1][1].collect())


def test_stages_keep_clashing_and_missing_columns(spark):
    rows = [(i, f"line one of {i}\nthe same old line", "s%d" % (i % 5), 7, 8, 9, 10) for i in range(10)]
    rows += [(None, "no id at all", None, 7, 8, 9, 10), (20, None, "s1", 7, 8, 9, 10), (21, "", "s1", 7, 8, 9, 10), (3, rows[3][1], "s3", 7, 8, 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, first int, held int, n_lines int, n_removed int")
    docs = docs.withColumnsRenamed({"first": "_first", "held": "_held"}).withColumn("held", F.lit(1)).withColumn("First", F.lit(2))
    for table_of in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, table_of, FOLDER)
            assert got.columns == docs.columns
            assert all(tuple(r)[3:] == (7, 8, 9, 10, 1, 2) for r in got.collect())
    cleaned = {r.doc_id: r.text for r in corpus_pipeline.own_lines(spark, docs, FOLDER).collect()}
    assert cleaned[0] == rows[0][1] and cleaned[9] == "line one of 9" and cleaned[20] is None and cleaned[None] == "no id at all"
