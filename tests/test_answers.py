import os
import uuid
from collections import Counter
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codequarry.operators import generation


def model(log, bad=()):
    """A model that notes every prompt it is asked."""

    def answer(prompts):
        if any(p in bad for p in prompts):
            raise RuntimeError("no")
        for p in prompts:
            Path(log, uuid.uuid4().hex).write_text(p)
        return [p.upper() for p in prompts]

    return answer


def asked(log):
    return Counter(Path(log, f).read_text() for f in os.listdir(log))


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "log")


def prompts(spark, rows):
    return spark.createDataFrame(rows, "query_id long, prompt string")


def test_no_prompt_is_asked_twice(spark, tmp_path, log):
    store = str(tmp_path / "store")
    first = prompts(spark, [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")])
    rows = sorted(map(tuple, generation.answer_once(first, model(log), store, batch=1).collect()))
    assert rows == [(1, "A", None, False), (2, "B", None, False), (3, "A", None, False), (4, None, None, False), (5, "", None, False)]
    later = generation.answer_once(first.union(prompts(spark, [(6, "c"), (7, "b")])), model(log), store)
    for _ in range(2):  # reading the result again asks nothing
        assert {r.query_id: (r.response, r.reused) for r in later.collect()} == {
            1: ("A", True), 2: ("B", True), 3: ("A", True), 4: (None, False), 5: ("", True), 6: ("C", False), 7: ("B", True)
        }
    assert asked(log) == Counter({"a": 1, "b": 1, "c": 1, "": 1})


def test_errors_are_asked_again(spark, tmp_path, log):
    store = str(tmp_path / "store")
    table = prompts(spark, [(1, "a"), (2, "b")])
    rows = {r.query_id: r for r in generation.answer_once(table, model(log, bad=["b"]), store, tasks=1).collect()}
    assert rows[1].response == "A" and rows[2].response is None and rows[2].error == "RuntimeError: no"
    rows = {r.query_id: r for r in generation.answer_once(table, model(log), store).collect()}
    assert rows[1].reused and not rows[2].reused and rows[2].response == "B" and asked(log) == Counter({"a": 1, "b": 1})


def test_a_second_attempt_goes_on_where_the_first_died(tmp_path, log):
    frame = pd.DataFrame({"digest": list("wxyz"), "prompt": list("abcd")})
    attempt = generation._asking(model(log), str(tmp_path / "run"), 1)(iter([frame]))
    next(attempt), next(attempt)
    attempt.close()
    again = pd.concat(generation._asking(model(log), str(tmp_path / "run"), 1)(iter([frame])))
    assert again["response"].tolist() == list("ABCD") and asked(log) == Counter("abcd")


def test_a_call_after_a_failed_one(spark, tmp_path, log):
    store = str(tmp_path / "store")

    def dies(texts):
        if "b" in texts:
            os._exit(1)
        return model(log)(texts)

    table = prompts(spark, [(i, p) for i, p in enumerate("acdeb")])
    with pytest.raises(Exception):
        generation.answer_once(table.orderBy("query_id"), dies, store, batch=1, tasks=1)
    before = asked(log)
    rows = generation.answer_once(table, model(log), store).collect()
    assert sorted(r.response for r in rows) == list("ABCDE")
    assert {r.response.lower() for r in rows if r.reused} == set(before) and asked(log) == Counter("abcde")


def test_empty_and_hot(spark, tmp_path, log):
    assert generation.answer_once(prompts(spark, []), model(log), str(tmp_path / "none")).count() == 0
    many = spark.range(500).select(F.col("id").alias("query_id"), F.lit("same").alias("prompt"))
    assert generation.answer_once(many, model(log), str(tmp_path / "store")).filter("response = 'SAME'").count() == 500
    assert asked(log) == Counter({"same": 1})
